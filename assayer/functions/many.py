"""One text against many: bounds and subsequences of whole columns of texts in machine words.

Every text of a chunk has, for each character, a bit mask of the places where it stands; the masks
of one character lie side by side, so that a step over one character of the other text handles the
whole chunk. A pair is given up as soon as the characters that are left cannot reach the
threshold any more.
"""

from __future__ import annotations

import numpy as np

from assayer.functions.similarity import SCORERS

COPIES = 8                  # copies of a character that a sketch tells apart
BUCKETS = 64                # characters of a sketch
MASK_BYTES = 1 << 25        # of one chunk
LONGEST = 1024              # characters; longer texts are scored one by one
STRIDE = 8                  # characters between two looks at what is still possible
ONE, ALL = np.uint64(1), ~np.uint64(0)


def _unary(counts: np.ndarray) -> np.ndarray:
    """Unary counts of the characters in buckets, bit ``k`` of byte ``c`` telling of more than ``k`` copies; a column for each text."""
    bits = ((np.uint16(1) << np.minimum(counts, COPIES).astype(np.uint16)) - np.uint16(1)).astype(np.uint8).view(np.uint64)
    return np.ascontiguousarray(bits.T)


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), lengths


def _head(text: str) -> list[int]:
    """The first four characters, 0 and below where there are none."""
    return [ord(c) for c in text[:4]] + list(range(-len(text[:4]) - 1, -5, -1))


class Chunk:
    """Texts of up to one length in words, with their masks."""

    def __init__(self, texts: list[str], rows: np.ndarray):
        self.rows = rows
        points, self.lengths = _points(texts)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.words = max(1, -(-int(self.lengths.max(initial=0)) // 64))
        self.masks = np.zeros((len(self.alphabet), self.words, len(texts)), np.uint64)
        row = np.repeat(np.arange(len(texts)), self.lengths)
        place = np.arange(len(points)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        np.bitwise_or.at(self.masks, (codes, place >> 6, row), ONE << (place & 63).astype(np.uint64))
        self.buckets = max(8, min(BUCKETS, -(-len(self.alphabet) // 8) * 8))
        self.unary = _unary(np.bincount(row * self.buckets + codes % self.buckets, minlength=len(texts) * self.buckets).reshape(len(texts), self.buckets))
        left = np.clip(self.lengths[None, :] - 64 * np.arange(self.words)[:, None], 0, 64)
        self.full = np.where(left == 64, ALL, (ONE << (left % 64).astype(np.uint64)) - ONE)
        # Texts of one length and equal first characters need the same number of matches.
        kinds = np.column_stack([np.array([_head(t) for t in texts], np.int64).reshape(len(texts), 4), self.lengths])
        self.kinds, kind = np.unique(kinds, axis=0, return_inverse=True)
        self.kind = kind.reshape(-1)

    def steps(self, text: str) -> list[int]:
        """The alphabet's numbers of the characters of ``text``, -1 for others."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        return np.where(self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points, at, -1).tolist() if len(self.alphabet) else [-1] * len(points)

    def shared(self, text: str, chosen: np.ndarray) -> np.ndarray:
        """At most so many characters of ``text`` are also in each chosen one."""
        steps = np.array(self.steps(text), np.int64)
        counts = np.bincount(steps[steps >= 0] % self.buckets, minlength=self.buckets)
        bits = np.bitwise_count(self.unary[:, chosen] & _unary(counts[None, :])).sum(axis=0, dtype=np.int64)
        return bits + int(np.maximum(counts - COPIES, 0).sum())

    def same(self, text: str) -> np.ndarray:
        """Equal first characters of every kind and ``text``, four at most."""
        return np.cumprod(self.kinds[:, :4][:, :len(text)] == _head(text)[:len(text)], axis=1).sum(axis=1)

    def subsequence(self, text: str, chosen: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The chosen texts whose longest common subsequence with ``text`` reaches ``need``, and its lengths."""
        row, full, masks = self.full[:, chosen], self.full[:, chosen], self.masks[:, :, chosen]
        lengths = self.lengths[chosen]
        steps = self.steps(text)
        for j, code in enumerate(steps):
            if code >= 0:
                hit = row & masks[code]
                carry = np.zeros(len(chosen), np.uint64)
                for w in range(self.words):
                    total = row[w] + hit[w]
                    over = total < row[w]
                    total += carry
                    over |= total < carry
                    row[w] = (total | (row[w] & ~hit[w])) & full[w]
                    carry = over.astype(np.uint64)
            if j % STRIDE == STRIDE - 1 or j == len(steps) - 1:
                common = lengths - np.bitwise_count(row).sum(axis=0, dtype=np.int64)
                live = common + (len(steps) - 1 - j) >= need
                if not live.any():
                    return chosen[:0], need[:0]
                if live.mean() < 0.75 or j == len(steps) - 1:
                    chosen, need, lengths, row, full, masks = chosen[live], need[live], lengths[live], row[:, live], full[:, live], masks[:, :, live]
        return chosen, lengths - np.bitwise_count(row).sum(axis=0, dtype=np.int64)

    def matching(self, text: str, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For texts of one word: how many characters of ``text`` each chosen one matches inside the Jaro window, the place
        (one bit) that every step took in it, 0 for none, and the alphabet's numbers of the steps."""
        reach = np.maximum(0, np.maximum(self.lengths[chosen], len(text)) // 2 - 1)
        inside = np.where(reach >= 63, ALL, (ONE << (reach % 63 + 1).astype(np.uint64)) - ONE)     # places that a step may take
        used, taken, codes = np.zeros(len(chosen), np.uint64), [], []
        for i, code in enumerate(self.steps(text)):
            if i:
                inside = (inside << ONE) | (i <= reach).astype(np.uint64)
            if code >= 0:
                free = self.masks[code, 0, chosen] & inside & ~used
                first = free & (~free + ONE)                   # the first free place
                used |= first
                taken.append(first)
                codes.append(code)
        return np.bitwise_count(used).astype(np.int64), np.array(taken, np.uint64).reshape(len(codes), len(chosen)), np.array(codes, np.int64)


def _swapped(taken: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Transpositions of a Jaro score: matched characters in the order of one text that differ from those in the order of the other, halved."""
    none = taken == 0
    here = codes[np.argsort(none, axis=0, kind="stable")]
    there = codes[np.argsort(np.where(none, ALL, taken), axis=0, kind="stable")]
    matched = np.arange(len(codes))[:, None] < (~none).sum(axis=0)
    return ((here != there) & matched).sum(axis=0) // 2


class Many:
    """Texts that are compared with one text after another."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.long = np.flatnonzero(lengths > LONGEST)
        self.chunks = []
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] <= LONGEST]
        at = 0
        while at < len(order):
            stop = min(len(order), at + 4096)
            while True:
                some = order[at:stop]
                words = max(1, -(-int(lengths[some].max()) // 64))
                letters = len(set().union(*[set(texts[k]) for k in some.tolist()]))
                if letters * words * len(some) * 8 <= MASK_BYTES or stop - at == 1:
                    break
                stop = at + max(1, (stop - at) // 2)
            self.chunks.append(Chunk([texts[k] for k in some.tolist()], some))
            at = stop

    def reach(self, text: str, alive: np.ndarray, algorithm: str, threshold: float) -> list[tuple[int, float]]:
        """Numbers and scores of the texts where ``alive`` that ``text``, as the first of the pair, resembles to ``threshold`` or more."""
        scorer, out = SCORERS[algorithm], []
        for k in self.long[alive[self.long]].tolist() if len(text) <= LONGEST else np.flatnonzero(alive).tolist():
            value = scorer(text, self.texts[k])
            if value >= threshold:
                out.append((k, value))
        if len(text) > LONGEST:
            return out
        for chunk in self.chunks:
            chosen = np.flatnonzero(alive[chunk.rows])
            if not len(chosen):
                continue
            chosen, value = _possible(chunk, text, chosen, algorithm, threshold)
            known = algorithm == "ratio" or algorithm == "jaro_winkler" and chunk.words == 1
            for k, score in zip(chunk.rows[chosen].tolist(), value.tolist()):
                exact = score if known else scorer(text, self.texts[k])
                if exact >= threshold:
                    out.append((k, exact))
        return out


def _winkler(matched: np.ndarray, swaps: np.ndarray | int, a: int, b: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Jaro-Winkler scores from matched characters, transpositions, lengths and equal first characters, step by step as for one pair."""
    some = np.maximum(matched, 1)
    jaro = np.where(matched > 0, (matched / a + matched / b + (matched - swaps) / some) / 3, 0.0)
    return 100.0 * np.where(jaro > 0.7, jaro + same * 0.1 * (1 - jaro), jaro)


def _matches(a: int, b: np.ndarray, same: np.ndarray, threshold: float) -> np.ndarray:
    """So many matched characters, if not more, a Jaro-Winkler score takes to reach the threshold."""
    need = threshold / 100.0
    jaro = np.where(need > 0.7, np.maximum(0.7, (need - 0.1 * same) / (1 - 0.1 * same)), need)
    return np.ceil((3 * jaro - 1) * a * b / (a + b) - 1e-6)


def _possible(chunk: Chunk, text: str, chosen: np.ndarray, algorithm: str, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The chosen texts that may reach the threshold; for the ratio, and for Jaro-Winkler in chunks of one word, with their scores, else with a number that says nothing."""
    if algorithm == "metaphone":
        return chosen, np.zeros(len(chosen))
    a, b = len(text), chunk.lengths[chosen]
    total = a + b
    shared = np.minimum(chunk.shared(text, chosen), np.minimum(a, b))
    if algorithm in ("ratio", "difflib"):
        live = 200.0 * shared >= threshold * total - 1e-9
        chosen, total = chosen[live], total[live]
        chosen, common = chunk.subsequence(text, chosen, np.ceil(threshold * total / 200.0 - 1e-9).astype(np.int64)) if len(chosen) else (chosen, total)
        return chosen, 200.0 * common / (a + chunk.lengths[chosen])
    same = chunk.same(text)
    if algorithm == "jaro_winkler":
        live = shared >= _matches(a, chunk.kinds[:, 4], same, threshold)[chunk.kind[chosen]]
    else:
        live = 0.4 * _winkler(shared, 0, a, b, same[chunk.kind[chosen]]) + 20.0 + 80.0 * shared / total >= threshold - 1e-9
    chosen, shared = chosen[live], shared[live]
    b, total, same = chunk.lengths[chosen], total[live], same[chunk.kind[chosen]]
    if chunk.words == 1:
        # Characters anywhere in both texts bound the score; only where it stays in reach are they matched inside the window.
        shared, taken, codes = chunk.matching(text, chosen)
    winkler = _winkler(shared, 0, a, b, same)
    if algorithm == "jaro_winkler":
        live = winkler >= threshold - 1e-9
        if chunk.words > 1:
            return chosen[live], np.zeros(int(live.sum()))
        return chosen[live], _winkler(shared[live], _swapped(taken[:, live], codes), a, b[live], same[live])
    best = 0.4 * winkler + 20.0                                # of "combined": the phonetic part adds 20 at most
    need = np.maximum(0, np.ceil((threshold - best) / 40.0 * total / 2 - 1e-9)).astype(np.int64)
    live = best + 0.4 * 200.0 * np.minimum(chunk.shared(text, chosen), np.minimum(a, b)) / total >= threshold - 1e-9
    chosen, _ = chunk.subsequence(text, chosen[live], need[live]) if live.any() else (chosen[:0], need[:0])
    return chosen, np.zeros(len(chosen))
