"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as an embedding of its hash and the mean embedding of its character n-grams.
Windows of ``WINDOW`` words, each half overlapping the next, run through a GRU in either
direction; attention pools the states to one logit per window. A document is as toxic as its
worst window; a logistic curve over that logit and the number of windows, fitted on texts that
the network has not seen, gives the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from assayer.llm import hashing
from assayer.llm.batches import pieces, texts, utf8
from assayer.llm.quality import held_out, logistic, sample
from assayer.llm.words import _spread

WINDOW, STEP = 32, 16
HIDDEN, WORD, CHARS = 8, 8, 16
WORD_ROWS, CHAR_ROWS = 1 << 13, 1 << 14
GRAMS = (3, 4, 5, 6)     # bytes of the character n-grams, word ends included
PER_LABEL = 1600         # labelled texts of each kind that are fitted on
WINDOWS = (4, 12)        # windows of one clean and of one toxic text that an epoch trains on, drawn at random
EPOCHS, RATE, LOT = 8, 0.01, 256
STEPS = 400              # at least so many lots are trained on, over up to 8 times the epochs where texts are few

_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


class Words:
    """Words of a batch: which distinct word stands where, and the n-gram rows of each distinct word."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(pc.utf8_lower(pc.fill_null(column, "")))
        starts, ends, self.counts = hashing.word_spans(data, offsets)
        starts, ends = starts.copy(), ends.copy()
        for _ in range(4):   # up to four marks at either end belong to no word
            inner = ends - starts > 1
            ends -= inner & _MARKS[data[ends - 1]] if len(data) else 0
            inner = ends - starts > 1
            starts += inner & _MARKS[data[np.minimum(starts, len(data) - 1)]] if len(data) else 0
        hashes, first, self.which = np.unique(hashing.span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        self.word = (hashes >> np.uint64(32)).astype(np.int64) % WORD_ROWS
        begin, length = starts[first], ends[first] - starts[first]
        framed = length + 2
        stop = np.cumsum(framed)
        flat = np.full(int(stop[-1]) if len(stop) else 0, 2, np.uint32)
        flat[stop - 1] = 3
        inside = np.ones(len(flat), bool)
        inside[stop - 1] = False
        inside[stop - framed] = False
        flat[inside] = data[_spread(length, begin)]
        room = _spread_down(framed)          # bytes from each place to the end of its word
        rows, code = [], flat.copy()
        for n in range(1, max(GRAMS) + 1):
            if n > 1:
                shifted = np.zeros_like(flat)
                if n <= len(flat):
                    shifted[:len(flat) - n + 1] = flat[n - 1:]
                code = code * np.uint32(0x01000193) + shifted
            if n in GRAMS:
                mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                rows.append(np.where(room >= n, ((mixed ^ (mixed >> np.uint32(13))) % np.uint32(CHAR_ROWS)).astype(np.int32), -1))
        grid = np.stack(rows, axis=1) if len(flat) else np.zeros((0, len(GRAMS)), np.int32)
        valid = grid >= 0
        self.grams = grid[valid]
        per_place = valid.sum(axis=1)
        self.gram_ends = np.cumsum(per_place)[stop - 1] if len(stop) else np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.word)


def _spread_down(lengths: np.ndarray) -> np.ndarray:
    total = np.cumsum(lengths)
    return np.repeat(total, lengths) - np.arange(total[-1] if len(total) else 0)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window; the last window of a long text ends with it, a short text has one."""
    lengths = np.diff(counts)
    many = np.where(lengths == 0, 0, np.where(lengths <= WINDOW, 1, 1 + -(-(lengths - WINDOW) // STEP)))
    text = np.repeat(np.arange(len(lengths)), many)
    place = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = np.minimum(place * STEP, np.maximum(lengths[text] - WINDOW, 0))
    return counts[:-1][text] + begin, np.minimum(lengths[text], WINDOW), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _add_rows(out: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """``out[rows] += values`` where rows repeat."""
    if len(rows):
        order = np.argsort(rows, kind="stable")
        begin = np.flatnonzero(np.r_[True, rows[order][1:] != rows[order][:-1]])
        out[rows[order][begin]] += np.add.reduceat(values[order], begin, axis=0)


class Network:
    """Weights, the forward pass and the gradients."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        h, d = HIDDEN, WORD + CHARS

        def normal(*shape, scale):
            return (r.standard_normal(shape) * scale).astype(np.float32)

        self.w = {
            "word": normal(WORD_ROWS, WORD, scale=0.1), "char": normal(CHAR_ROWS, CHARS, scale=0.3),
            "input": normal(d, 6 * h, scale=d ** -0.5), "bias": np.zeros(6 * h, np.float32),
            "ahead": normal(h, 3 * h, scale=h ** -0.5), "back": normal(h, 3 * h, scale=h ** -0.5),
            "attend": normal(2 * h, scale=0.3), "out": normal(2 * h, scale=0.3), "shift": np.zeros(1, np.float32),
        }

    def inputs(self, words: Words, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Input of each distinct word and its projection to the gates of both directions.

        ``known`` is 0 for words that training hides, so that their characters must tell.
        """
        n, ends = len(words), np.append(0, words.gram_ends)
        x = np.zeros((n, WORD + CHARS), np.float32 if self.w["char"].dtype == np.float32 else np.float64)
        x[:, :WORD] = self.w["word"][words.word]
        if known is not None:
            x[:, :WORD] *= known[:, None]
        for at in range(0, n, 4096):   # the n-grams of some words at a time
            to = min(n, at + 4096)
            sums = np.add.reduceat(self.w["char"][words.grams[ends[at]:ends[to]]], ends[at:to] - ends[at], axis=0)
            x[at:to, WORD:] = sums / (ends[at + 1:to + 1] - ends[at:to])[:, None]
        return x, x @ self.w["input"] + self.w["bias"]

    def states(self, gates: np.ndarray, ids: np.ndarray, lengths: np.ndarray | None, keep: bool = False):
        """States ``[time, window, 2 * HIDDEN]``; ``lengths`` is None where all windows are full."""
        h, (n, steps) = HIDDEN, ids.shape
        out = np.zeros((steps, n, 2 * h), np.float32)
        saved = []
        for side, name in enumerate(("ahead", "back")):
            u = self.w[name]
            state = np.zeros((n, h), np.float32)
            part = np.ascontiguousarray(gates[:, 3 * h * side:3 * h * (side + 1)])
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x, hu = np.take(part, ids[:, t], axis=0, mode="clip"), state @ u
                zr = x[:, :2 * h]
                zr += hu[:, :2 * h]
                np.negative(zr, out=zr)
                np.exp(np.minimum(zr, 30, out=zr), out=zr)
                zr += 1
                np.reciprocal(zr, out=zr)
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(x[:, 2 * h:] + r * hu[:, 2 * h:])
                after = new + z * (state - new)
                if lengths is not None:
                    after = np.where((t < lengths)[:, None], after, state)
                if keep:
                    saved.append((side, t, state, z.copy(), r.copy(), new, hu[:, 2 * h:].copy()))
                state = after
                out[t, :, h * side:h * (side + 1)] = state
        return (out, saved) if keep else out

    def logits(self, out: np.ndarray, lengths: np.ndarray | None):
        """Logit of each window, with the attention weights."""
        e = np.tensordot(out, self.w["attend"], axes=1)
        if lengths is not None:
            e = np.where(np.arange(len(out))[:, None] < lengths, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        value = np.tensordot(out, self.w["out"], axes=1)
        return (a * value).sum(axis=0) + self.w["shift"][0], a, value

    def score(self, gates: np.ndarray, which: np.ndarray, begin: np.ndarray, lengths: np.ndarray, lot: int = 2048) -> np.ndarray:
        """Logits of all windows, full ones and short ones in lots of their own."""
        logit = np.zeros(len(begin), np.float32)
        for short in (False, True):
            mine = np.flatnonzero((lengths < WINDOW) == short)
            for at in range(0, len(mine), lot):
                w = mine[at:at + lot]
                place = begin[w][:, None] + np.arange(WINDOW)
                ids = which[np.minimum(place, len(which) - 1)]
                size = lengths[w] if short else None
                logit[w] = self.logits(self.states(gates, ids, size), size)[0]
        return logit

    def gradients(self, words: Words, ids: np.ndarray, lengths: np.ndarray, target: np.ndarray, weight: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted cross entropy over one lot of windows."""
        h, w, n = HIDDEN, self.w, len(ids)
        x, gates = self.inputs(words, known)
        out, saved = self.states(gates, ids, lengths, keep=True)
        logit, a, value = self.logits(out, lengths)
        d = ((_sigmoid(logit) - target) * weight / n).astype(np.float32)
        g = {"shift": np.array([d.sum()], np.float32)}
        d_value = a * d
        d_e = a * (value - (a * value).sum(axis=0)) * d
        g["out"] = np.tensordot(d_value, out, axes=((0, 1), (0, 1)))
        g["attend"] = np.tensordot(d_e, out, axes=((0, 1), (0, 1)))
        d_out = d_value[:, :, None] * w["out"] + d_e[:, :, None] * w["attend"]
        d_gates = np.zeros_like(gates)
        for side, name in ((0, "ahead"), (1, "back")):
            u, g[name] = w[name], np.zeros_like(w[name])
            spread = np.zeros((ids.shape[1], n, 3 * h), np.float32)
            d_state = np.zeros((n, h), np.float32)
            for _, t, before, z, r, new, hun in reversed([s for s in saved if s[0] == side]):
                d_after = d_state + d_out[t, :, h * side:h * (side + 1)]
                on = (t < lengths)[:, None]
                live = np.where(on, d_after, 0)
                d_new = live * (1 - z) * (1 - new * new)
                d_z = live * (before - new) * z * (1 - z)
                d_r = d_new * hun * r * (1 - r)
                d_hu = np.hstack((d_z, d_r, d_new * r))
                g[name] += before.T @ d_hu
                d_state = np.where(on, live * z, d_after) + d_hu @ u.T
                spread[t] = np.hstack((d_z, d_r, d_new))
            _add_rows(d_gates[:, 3 * h * side:3 * h * (side + 1)], ids.T.ravel(), spread.reshape(-1, 3 * h))
        g["bias"], g["input"] = d_gates.sum(axis=0), x.T @ d_gates
        d_x = d_gates @ w["input"].T
        g["word"] = np.zeros_like(w["word"])
        _add_rows(g["word"], words.word, d_x[:, :WORD] * known[:, None])
        counts = np.diff(np.append(0, words.gram_ends))
        g["char"] = np.zeros_like(w["char"])
        _add_rows(g["char"], words.grams, np.repeat(d_x[:, WORD:] / counts[:, None], counts, axis=0))
        return g


class _Some:
    """The distinct words of one lot."""

    def __init__(self, words: Words, used: np.ndarray):
        starts = np.append(0, words.gram_ends[:-1])[used]
        lengths = words.gram_ends[used] - starts
        self.word, self.grams, self.gram_ends = words.word[used], words.grams[_spread(lengths, starts)], np.cumsum(lengths)

    def __len__(self) -> int:
        return len(self.word)


def train(network: Network, words: Words, label: np.ndarray, share: float, seed: int = 3) -> None:
    """Fit by Adam. All windows of a toxic text count as toxic at first, later only its worst one and those thought toxic."""
    r = np.random.default_rng(seed)
    begin, lengths, text = windows(words.counts)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in network.w.items()}
    done = 0
    lots = 1 + (np.minimum(np.bincount(text, minlength=len(label)), np.array(WINDOWS)[label]).sum() if len(text) else 0) // LOT
    epochs = int(np.clip(STEPS // lots, EPOCHS, 8 * EPOCHS))
    for epoch in range(epochs):
        draw = r.random(len(begin))
        order = np.lexsort((draw, text))
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(np.r_[True, text[order][1:] != text[order][:-1]], np.arange(len(order)), 0)) if len(order) else order
        chosen = order[rank < np.array(WINDOWS)[label[text[order]]] * np.where(4 * epoch >= epochs, 1 + 3 * label[text[order]], 1)]
        if 4 * epoch >= epochs and len(chosen):
            logit = network.score(network.inputs(words)[1], words.which, begin[chosen], lengths[chosen])
            worst = np.full(len(label), -1e9)
            np.maximum.at(worst, text[chosen], logit)
            toxic = label[text[chosen]] == 1
            chosen = chosen[~toxic | (logit >= worst[text[chosen]]) | (logit > 0)]
        chosen = r.permutation(chosen)
        positive = max(1, int((label[text[chosen]] == 1).sum()))
        balance = max(1.0, (len(chosen) - positive) / positive) ** 0.5
        for at in range(0, len(chosen), LOT):
            lot = chosen[at:at + LOT]
            place = np.minimum(begin[lot][:, None] + np.arange(WINDOW), len(words.which) - 1)
            used, ids = np.unique(words.which[place], return_inverse=True)
            target = label[text[lot]].astype(np.float32)
            g = network.gradients(_Some(words, used), ids.reshape(place.shape), lengths[lot], target,
                                  np.where(target == 1, balance, 1.0).astype(np.float32), (r.random(len(used)) < 0.5).astype(np.float32))
            done += 1
            rate = RATE * (1 - 0.9 * epoch / epochs) * (1 - 0.999 ** done) ** 0.5 / (1 - 0.9 ** done)
            for k, d in g.items():
                first, second = moments[k]
                first += 0.1 * (d - first)
                second += 0.001 * (d * d - second)
                network.w[k] -= (rate * first / (np.sqrt(second) + 1e-6)).astype(np.float32)


class Model:
    def __init__(self, network: Network, curve: np.ndarray):
        self.network, self.curve = network, curve

    def worst(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Largest window logit and number of windows of each text; an empty text has the logit of no word."""
        begin, lengths, text = windows(words.counts)
        n = len(words.counts) - 1
        best, many = np.full(n, -np.inf), np.bincount(text, minlength=n)
        np.maximum.at(best, text, self.network.score(self.network.inputs(words)[1], words.which, begin, lengths))
        return np.where(many > 0, best, min(0.0, float(self.network.w["shift"][0]))), np.maximum(many, 1)

    def score(self, words: Words) -> np.ndarray:
        worst, many = self.worst(words)
        return _sigmoid(_features(worst, many) @ self.curve)


def _features(worst: np.ndarray, many: np.ndarray) -> np.ndarray:
    return np.stack((worst, np.log(many), np.ones(len(worst))), axis=1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_label: int = PER_LABEL, key: str = "doc_id", text: str = "text") -> Model:
    """Train on at most ``per_label`` texts of each label outside the held-out fifth of the ids.

    Three of four train the network, the fourth calibrates. Without texts of both labels every
    score is the share of label 1.
    """
    rows, counts = sample(docs, labels, label, per_label, key, text)
    total = sum(counts.get(k, 0) for k in (0, 1))
    share = counts.get(1, 0) / total if total else 0.5
    network = Network()
    used = [(k % 4, kind, body) for k, (_, kind, body) in enumerate(rows) if kind in (0, 1)]
    learn = [(kind, body) for turn, kind, body in used if turn]
    check = [(kind, body) for turn, kind, body in used if not turn]
    flat = np.array([0.0, 0.0, np.log((share + 1e-3) / (1 - share + 1e-3))])
    if len({k for k, _ in learn}) < 2 or len({k for k, _ in check}) < 2:
        return Model(network, flat)
    train(network, Words(pa.array([t for _, t in learn])), np.array([k for k, _ in learn]), share)
    model = Model(network, flat)
    kinds = np.array([k for k, _ in check], float)
    x = _features(*model.worst(Words(pa.array([t for _, t in check]))))
    weight = np.where(kinds == 1, share / kinds.mean(), (1 - share) / (1 - kinds.mean()))
    model.curve = logistic(x, kinds, weight)
    return model


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.score(Words(batch.column("text"))).astype(np.float64))], names=["doc_id", "score"])
    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per row of ``docs``.

    ``score`` is the probability of label 1 and depends on the text alone, on all its windows; a
    null text counts as empty, and all texts without words have one score. ``predicted`` is 1
    from ``threshold`` on. ``held_out`` tells that the id's crc32 is a multiple of 5 (false for a
    null id). Other columns are not read; an empty table gives no rows.
    """
    source = texts(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text)
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
