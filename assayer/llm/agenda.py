"""SentencePiece encoding of merge-type vocabularies by an agenda of neighbouring symbol pairs.

A text gets a blank in front and is cut into words: a word starts with the blanks before it, and
every line feed or other control character that no piece holds is one of its own. No piece holds characters from both sides of such a
cut, so words are merged on their own. Inside a word every pair of neighbouring symbols that is
a piece stands on an agenda. The pair with the best score is merged, of equal scores the
leftmost, and the new symbol's pairs with its neighbours join the agenda, until it is empty.
What is no piece then becomes bytes.

The new words of an Arrow batch are worked on side by side, all of one length in a matrix whose
rows are their agendas; each step takes the best pair of every row. Longer words have an agenda
each. Every distinct word is encoded once and then held against the sentencepiece library; a
word that the library cuts otherwise is an error, never a result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from assayer.llm.batches import pieces, texts, utf8
from assayer.llm.hashing import span_hashes
from assayer.llm.words import _spread

BLANK = "▁"
SIDE = 40             # characters up to which words are merged side by side
LONG = 1024           # characters from which a word is also cut where no piece holds the two characters
MET = 1 << 20         # words and
MET_IDS = 1 << 23     # ids that a worker keeps
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Vocabulary:
    """Pieces, scores and ids of a model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        normal = model.normalizer_spec
        if (model.trainer_spec.model_type != model.trainer_spec.BPE or not model.trainer_spec.byte_fallback or model.trainer_spec.treat_whitespace_as_suffix
                or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not normal.escape_whitespaces
                or any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces)):
            raise ValueError(f"{path} is no merge-type model with byte pieces, a blank in front and unchanged characters")
        self.pieces = [(p.piece, p.type) for p in model.pieces]
        whole = [(i, p) for i, p in enumerate(model.pieces) if p.type == NORMAL]
        self.ids = {p.piece: i for i, p in whole}
        self.score = {p.piece: p.score for _, p in whole}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        held = {c for p in self.ids for c in p}
        if "\n" in held or any(a != BLANK and b == BLANK for p in self.ids for a, b in zip(p, p[1:])):
            raise ValueError(f"{path} has pieces that go on after an inner blank or hold a line feed")
        self.alone = np.array([k < 32 and chr(k) not in held for k in range(256)])   # bytes that are in no piece
        self.beside = {p[k:k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.unknown_surface = model.trainer_spec.unk_surface

        # Symbols as numbers: a piece is its id, a character that is no piece follows after all ids.
        count = len(self.pieces)
        self.point = np.arange(0x110000, dtype=np.int64) + count
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.point[ord(piece)] = i
        self.base = count + 0x110000

        def number(part: str) -> int:
            return self.ids.get(part, count + ord(part) if len(part) == 1 else -1)
        pairs = {}
        for piece, i in self.ids.items():
            for k in range(1, len(piece)):
                a, b = number(piece[:k]), number(piece[k:])
                if a >= 0 and b >= 0:
                    pairs[a * self.base + b] = i
        self.pair_codes = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[c] for c in self.pair_codes.tolist()] + [count], np.int32)
        ranks = {s: k for k, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.none = len(ranks)
        self.rank = np.full(count + 1, self.none, np.int32)   # the last one is of pairs that are no piece
        for piece, i in self.ids.items():
            self.rank[i] = ranks[self.score[piece]]
        self.bytes_of: dict[int, list[int]] = {}

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each two neighbouring symbols make."""
        code = a * self.base + b
        at = np.searchsorted(self.pair_codes, code)
        hit = self.pair_codes[np.minimum(at, len(self.pair_codes) - 1)] == code
        return self.pair_ids[np.where(hit, at, len(self.pair_codes))]

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has; blanks are given as ``BLANK``."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        symbols, counts = self._side_by_side(points, lengths, words)
        return self._spelled(symbols, counts)

    def _side_by_side(self, points: np.ndarray, lengths: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        begins, counts, made = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64), []

        def finish(rows: np.ndarray, symbols: np.ndarray) -> None:
            counts[rows] = symbols.shape[1]
            made.append((rows, symbols))
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n)
            if n > SIDE:
                for row in rows.tolist():
                    finish(np.array([row]), np.array([self.one(words[row])], np.int64))
                continue
            symbols = self.point[points[begins[rows][:, None] + np.arange(n)]]
            pair = self.pairs(symbols[:, :-1], symbols[:, 1:])
            while len(rows):
                if symbols.shape[1] < 2:
                    finish(rows, symbols)
                    break
                rank = self.rank[pair]
                best = rank.argmin(axis=1)                     # the first of the smallest
                line = np.arange(len(rows))
                live = rank[line, best] < self.none
                if not live.all():
                    finish(rows[~live], symbols[~live])
                    rows, symbols, pair, best = rows[live], symbols[live], pair[live], best[live]
                    line = np.arange(len(rows))
                if not len(rows):
                    break
                symbols[line, best] = pair[line, best]
                width = symbols.shape[1] - 1
                move = np.arange(width) + (np.arange(width) > best[:, None])
                symbols = np.take_along_axis(symbols, move, 1)
                pair = np.take_along_axis(pair, move[:, :-1], 1)
                left, right = np.flatnonzero(best > 0), np.flatnonzero(best < width - 1)
                pair[left, best[left] - 1] = self.pairs(symbols[left, best[left] - 1], symbols[left, best[left]])
                pair[right, best[right]] = self.pairs(symbols[right, best[right]], symbols[right, best[right] + 1])
        ends = np.cumsum(counts)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        for rows, symbols in made:
            out[(ends - counts)[rows][:, None] + np.arange(symbols.shape[1])] = symbols
        return out, counts

    def one(self, word: str) -> list[int]:
        """Symbols of one word once its agenda is empty."""
        runs = [word]
        if len(word) > LONG:
            cuts = [0, *(k for k in range(1, len(word)) if word[k - 1:k + 1] not in self.beside), len(word)]
            runs = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        return [self.ids.get(s, len(self.pieces) + ord(s[0])) for run in runs for s in self._merged(run)]

    def _merged(self, word: str) -> list[str]:
        parts, last = list(word), len(word) - 1
        following, before = list(range(1, last + 2)), list(range(-1, last))
        agenda = []

        def propose(left: int) -> None:
            right = following[left]
            if right <= last:
                pair = parts[left] + parts[right]
                score = self.score.get(pair)
                if score is not None:
                    heapq.heappush(agenda, (-score, left, pair))
        for left in range(last):
            propose(left)
        while agenda:
            _, left, pair = heapq.heappop(agenda)
            right = following[left]
            if not parts[left] or right > last or parts[left] + parts[right] != pair:
                continue                                       # one of the two was merged with another
            parts[left], parts[right] = pair, ""
            following[left] = following[right]
            if following[left] <= last:
                before[following[left]] = left
            propose(left)
            if before[left] >= 0:
                propose(before[left])
        return [p for p in parts if p]

    def _spelled(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece as the ids of their bytes."""
        count = len(self.pieces)
        odd = symbols >= count
        if not odd.any():
            return symbols.astype(np.int32), counts
        point, which = np.unique(symbols[odd], return_inverse=True)
        spelled = [[self.byte[b] for b in chr(p - count).encode("utf-8")] for p in point.tolist()]
        sizes = np.ones(len(symbols), np.int64)
        sizes[odd] = np.array([len(s) for s in spelled])[which]
        starts = np.cumsum(np.array([0] + [len(s) for s in spelled]))[:-1]
        out = np.repeat(symbols, sizes)
        out[np.repeat(odd, sizes)] = np.array([i for s in spelled for i in s])[_spread(sizes[odd], starts[which])]
        owner = np.repeat(np.arange(len(counts)), counts)
        return out.astype(np.int32), np.bincount(owner, sizes, len(counts)).astype(np.int64)


class Met:
    """Ids of the words met so far, by the word's 64-bit hash; beyond ``MET`` words or ``MET_IDS`` ids it starts again empty."""

    def __init__(self):
        self.hashes, self.place, self.ends, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray, encode: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Rows of distinct ascending ``hashes``; ``encode`` gives ids and counts of those not met before."""
        if len(self.hashes) > MET or len(self.flat) > MET_IDS:
            self.__init__()
        at = np.searchsorted(self.hashes, hashes)
        new = np.ones(len(hashes), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != hashes[inside]
        if new.any():
            flat, counts = encode(np.flatnonzero(new))
            rows = len(self.ends) - 1 + np.arange(len(counts))
            self.ends = np.concatenate((self.ends, self.ends[-1] + np.cumsum(counts)))
            self.flat = np.concatenate((self.flat, flat))
            self.hashes, self.place = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.place, at[new], rows)
            at = np.searchsorted(self.hashes, hashes)
        return self.place[at]


class Coder:
    """Encodes and decodes batches of texts."""

    def __init__(self, path: str):
        import sentencepiece

        self.path, self.vocabulary, self.met = path, Vocabulary(path), Met()
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spelled = []
        for piece, kind in self.vocabulary.pieces:
            spelled.append({NORMAL: piece.replace(BLANK, " ").encode("utf-8"), UNKNOWN: self.vocabulary.unknown_surface.encode("utf-8"),
                            CONTROL: b"", BYTE: bytes([int(piece[3:5], 16)]) if kind == BYTE else b""}[kind])
        self.kind = np.array([k for _, k in self.vocabulary.pieces])
        self.opens = np.array([k == NORMAL and p.startswith(BLANK) for p, k in self.vocabulary.pieces])
        self.spelled, self.spelling = spelled, np.frombuffer(b"".join(spelled), np.uint8)
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.begins = np.append(0, np.cumsum(self.lengths))[:-1]
        self.mark = self.library.encode("\n")                  # a line feed is in no piece: nothing merges with it

    def _checked(self, spelled: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the agenda and, in one batch, by the library."""
        plain = [w.decode("utf-8") for w in spelled]
        ids, counts = self.vocabulary.encode([w.replace(" ", BLANK) for w in plain])
        expected = self.library.encode(["\n" + w for w in plain], num_threads=1)
        head = len(self.mark)
        theirs = np.fromiter((i for row in expected for i in row), np.int32)
        sizes = np.fromiter(map(len, expected), np.int64, len(expected))
        keep = np.ones(len(theirs), bool)
        keep[(np.cumsum(sizes) - sizes)[:, None] + np.arange(head)] = False
        if not (np.array_equal(sizes - head, counts) and np.array_equal(theirs[keep], ids)):
            ends = np.cumsum(counts)
            wrong = next(k for k, row in enumerate(expected) if row[head:] != ids[ends[k] - counts[k]:ends[k]].tolist())
            raise RuntimeError(f"{self.path}: the library cuts {plain[wrong][:80]!r} otherwise")
        return ids, counts

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another and the ``n + 1`` offsets between them."""
        column = pc.replace_substring(pc.fill_null(column, ""), BLANK, " ")
        full = pc.greater(pc.binary_length(column), 0)
        data, offsets = utf8(pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", column.type), column, pa.scalar("", column.type)), column))
        blank, control = data == 32, self.vocabulary.alone[data]
        start = blank | control
        start[1:] &= ~(blank[:-1] & blank[1:])
        start[1:] |= control[:-1]
        start[offsets[:-1][offsets[1:] > offsets[:-1]]] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(data))
        hashes, first, which = np.unique(span_hashes(data, begin, end), return_index=True, return_inverse=True)
        raw = data.tobytes()
        rows = self.met.find(hashes, lambda new: self._checked([raw[a:b] for a, b in zip(begin[first[new]].tolist(), end[first[new]].tolist())]))[which]
        ends = self.met.ends
        lengths = ends[rows + 1] - ends[rows]
        return self.met.flat[_spread(lengths, ends[rows])], np.append(0, np.cumsum(lengths))[np.searchsorted(begin, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts one after another and the offsets between them, as the library decodes each row of ids."""
        lengths = self.lengths[ids]
        data, ends = self.spelling[_spread(lengths, self.begins[ids])], np.append(0, np.cumsum(lengths))[offsets]
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        first = ends[full]
        plain = bool(self.opens[ids[offsets[full]]].all()) and bool((self.kind[ids] != UNKNOWN).all())
        try:
            plain and data.tobytes().decode("utf-8")
        except UnicodeDecodeError:
            plain = False
        if not plain:
            out = [self._spell(ids[a:b].tolist()) for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
            return np.frombuffer(b"".join(out), np.uint8), np.append(0, np.cumsum([len(o) for o in out]))
        keep = np.ones(len(data), bool)
        keep[first] = False                                    # the blank put in front
        return data[keep], ends - np.searchsorted(first, ends, "left")

    def _spell(self, ids: list[int]) -> bytes:
        """One row of any ids: bytes that make no character become the replacement character one by one."""
        out, run, lead = [], b"", True
        for i in [*ids, None]:
            if i is not None and self.kind[i] == BYTE:
                run += self.spelled[i]
                continue
            while run:
                size = next((k for k in (1, 2, 3, 4) if len(run) >= k and _is_character(run[:k])), 0)
                out.append(run[:size] if size else b"\xef\xbf\xbd")
                run, lead = run[size or 1:], False
            if i is None:
                break
            piece = self.spelled[i]
            if lead and self.opens[i]:
                out.append(piece[1:])
                lead = False
            else:
                out.append(piece)
                lead = lead and not piece
        return b"".join(out)


def _is_character(data: bytes) -> bool:
    try:
        return len(data.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


_CODERS: dict[str, Coder] = {}


def coder_of(path: str) -> Coder:
    """The worker process's coder, made once for all its tasks."""
    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def _encoded(path: str, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        decimal = [b"%d" % i for i in range(len(coder.lengths))]
        for batch in pieces(batches):
            if not batch.num_rows:
                continue
            ids, offsets = coder.encode(batch.column("text"))
            if digest:
                data, ends = coder.decode(ids, offsets)
                spelled, plain = [decimal[i] for i in ids.tolist()], data.tobytes()
                made = {"ids_sha256": pa.array([hashlib.sha256(b",".join(spelled[a:b])).hexdigest() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]),
                        "decoded_sha256": pa.array([hashlib.sha256(plain[a:b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())])}
            else:
                made = {"ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), *made.values()], names=["doc_id", "n_tokens", *made])
    return run


def _apply(docs: DataFrame, path: str, key: str, text: str, digest: bool, schema: str) -> DataFrame:
    source = texts(docs, f"`{key}`", f"`{text}`")
    return source.mapInArrow(_encoded(path, digest), f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, {schema}")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)``, one row per row of ``docs``: the library's ids without begin and end.

    ``path`` is a model file of merge type with byte pieces at the same place on every executor.
    A null or empty text has no ids. Ids of rows may be null or repeat; other columns are not
    read; an empty table gives no rows. A word of any length is handled whole.
    """
    return _apply(docs, path, key, text, False, "ids array<int>")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: digests of the decimal ids joined by commas and of the decoded text."""
    return _apply(docs, path, key, text, True, "ids_sha256 string, decoded_sha256 string")


def decode(rows: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``(doc_id, text)`` of each row of ids, as the library decodes them; null ids give an empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            data, ends = coder.decode(flat, np.append(0, np.cumsum(counts)))
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([raw[a:b].decode("utf-8") for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string())], names=["doc_id", "text"])
    source = rows.selectExpr(f"`{key}` AS doc_id", f"`{ids}` AS ids")
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, text string")
