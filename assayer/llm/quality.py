"""Quality scores by compression.

Two zstandard dictionaries are trained, on texts labelled good and on texts labelled bad. A
text is compressed block by block with either. The difference of the sizes over their sum tells
which kind of text it resembles; the size over the length tells how repetitive it is. A
logistic curve over both, fitted on labelled texts that the dictionaries have not seen and
weighted to the share of labels, turns them into a probability.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from assayer.llm.batches import pieces, texts, utf8

PER_LABEL = 2000       # labelled texts of each kind that are fitted on, by the smallest hashes of their ids
FIT_BYTES = 1 << 23    # of the texts of each kind; a text that would exceed them is passed over, the others are fitted on whole
BLOCK = 1024           # bytes compressed at once, so that the dictionary matters in long texts as in short ones
DICTIONARY = 1 << 16   # bytes at most
LEAST = 1 << 12        # bytes of the smallest dictionary
LEVEL = 3


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray   # of the features, the last one is the intercept
    centre: np.ndarray
    scale: np.ndarray


def train_rows(labels: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """``(doc_id, label)`` of the rows to learn from: one per id, the smaller label where they differ; crc32 of the id modulo 5 is not 0."""
    rows = labels.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL")
    return rows.where(~held_out("doc_id")).groupBy("doc_id").agg(F.min("label").alias("label"))


def held_out(key: str):
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, per_label: int, key: str, text: str) -> tuple[list[tuple[int, int, str]], dict[int, int]]:
    """At most ``per_label`` labelled texts of label 0 and of label 1 with the id's rank by hash, and how many rows have each label.

    One text per id, the one with the smallest hash, and at most ``FIT_BYTES`` of each label: hashes and
    lengths are listed first, then only the chosen texts are fetched.
    """
    rows = train_rows(labels, label, key)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    picks = [rows.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    chosen = picks[0].unionByName(picks[1])   # bounded by 2 * per_label rows
    source = texts(docs, key, text).select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("body")).where("length(text) > 0")
    found = source.select("doc_id", "body", F.octet_length("text").alias("bytes")).join(F.broadcast(chosen), "doc_id")
    listed = found.groupBy("doc_id", "label").agg(F.min(F.struct("body", "bytes")).alias("t")).select("doc_id", "label", F.xxhash64("doc_id").alias("h"), "t.*").collect()
    held, picked = {0: 0, 1: 0}, {}
    for r in sorted(listed, key=lambda r: (r.h, r.doc_id)):
        if held[r.label] + r.bytes <= FIT_BYTES:
            held[r.label] += r.bytes
            picked[r.doc_id] = (r.label, r.body)
    wanted = docs.sparkSession.createDataFrame([(i, body) for i, (_, body) in picked.items()], "doc_id bigint, body bigint")
    got = dict(map(tuple, source.join(F.broadcast(wanted), ["doc_id", "body"]).groupBy("doc_id").agg(F.min("text")).collect()))
    return [(k, label, got[i]) for k, (i, (label, _)) in enumerate(picked.items())], counts


def blocks(data: bytes) -> list[bytes]:
    return [data[at:at + BLOCK] for at in range(0, len(data), BLOCK)]


class Sizes:
    """Compressed sizes of whole texts with the good and with the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        self.kinds = []
        for raw in (good, bad):
            kind = zstandard.DICT_TYPE_AUTO
            dictionary = zstandard.ZstdCompressionDict(raw, dict_type=kind)
            dictionary.precompute_compress(level=LEVEL)
            self.kinds.append(zstandard.ZstdCompressor(dict_data=dictionary, write_content_size=False, write_dict_id=False, write_checksum=False))

    def features(self, data: bytes) -> tuple[float, ...]:
        parts = blocks(data)
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.kinds)
        n = len(data)
        if not n:
            return (0.0, 0.0, 0.0, 0.0, 0.0)
        difference, ratio = (bad - good) / (bad + good), np.log((bad + good) / (2 * n))
        trust = n / (n + 300.0)   # short texts say little
        return (difference * trust, np.tanh(20 * difference) * trust, ratio * trust, ratio * ratio * trust, trust)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column of ``x`` is the intercept."""
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge * weight.sum() / len(x))
    penalty[-1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_label: int = PER_LABEL, key: str = "doc_id", text: str = "text") -> Model:
    """Train on at most ``per_label`` texts of each label outside the held-out fifth of the ids.

    Two of three train the dictionaries, the third calibrates. Without texts of both labels
    every score is the share of good labels, 0.5 where there are none.
    """
    rows, counts = sample(docs, labels, label, per_label, key, text)
    parts = {0: [], 1: []}
    calibration = []
    for k, (_, kind, body) in enumerate(rows):
        data = body.encode("utf-8")
        if kind in parts:
            (parts[kind].extend(blocks(data)) if k % 3 else calibration.append((kind, data)))
    good, bad = _dictionaries(parts[1], parts[0])
    total = sum(counts.get(k, 0) for k in (0, 1))
    share = counts.get(1, 0) / total if total else 0.5
    kinds = np.array([k for k, _ in calibration], float)
    if not (good and bad) or len(set(kinds.tolist())) < 2:
        start = np.log((share + 1e-3) / (1 - share + 1e-3))
        return Model(good, bad, np.array([0.0] * 5 + [start]), np.zeros(5), np.ones(5))
    sizes = Sizes(good, bad)
    x = np.array([sizes.features(d) for _, d in calibration])
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack(((x - centre) / scale, np.ones((len(x), 1))))
    weight = np.where(kinds == 1, share / max(kinds.mean(), 1e-9), (1 - share) / max(1 - kinds.mean(), 1e-9))
    return Model(good, bad, logistic(x, kinds, weight), centre, scale)


def _dictionaries(*labels: list[bytes]) -> list[bytes]:
    """A trained dictionary of each label's blocks, all of one size: a twentieth of the label with the fewest bytes, of short samples up to a half.

    Where the trainer refuses, the label's whole blocks up to that size, the smallest hashes first.
    """
    fewest = min(sum(map(len, parts)) for parts in labels)
    size = min(DICTIONARY, max(LEAST, min(1 << 14, fewest // 2), fewest // 20))
    return [_dictionary(parts, size) for parts in labels]


def _dictionary(parts: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, parts, k=32, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        out = b""
        for part in sorted(parts, key=lambda p: hashlib.blake2b(p, digest_size=8).digest()):
            if len(out) + len(part) <= size:
                out += part
        return out


def _scorer(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        sizes = Sizes(m.good, m.bad) if m.good and m.bad else None
        for batch in pieces(batches):
            data, offsets = utf8(batch.column("text"))
            raw, ends = data.tobytes(), offsets.tolist()
            x = np.array([sizes.features(raw[a:b]) if sizes else (0.0,) * 5 for a, b in zip(ends, ends[1:])]).reshape(batch.num_rows, 5)
            z = ((x - m.centre) / m.scale) @ m.weights[:-1] + m.weights[-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))], names=["doc_id", "body", "score"])
    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted, body)``, one row per row of ``docs``; ``body`` is the text's xxhash64, a null text as the empty one.

    ``score`` is the probability of label 1 and depends on the text alone; a null text counts as
    empty, and all empty texts have one score. ``predicted`` is 1 from ``threshold`` on.
    ``held_out`` tells that the id's crc32 is a multiple of 5 (false for a null id). Other columns
    are not read; an empty table gives no rows.
    """
    source = texts(docs, f"`{key}`", f"`{text}`").withColumn("body", F.xxhash64("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    scored = source.mapInArrow(_scorer(docs.sparkSession.sparkContext.broadcast(model)), f"doc_id {kind}, body bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "body")
