"""MinHash fingerprints of documents, their likeness, and near duplicates by signature bands.

A fingerprint is the minima of ``FUNCTIONS`` universal hash functions over the text's five-word
shingles, 16 bits of each. The share of equal minima estimates the Jaccard similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm import hashing
from assayer.llm.batches import pieces, texts, utf8
from assayer.llm.forest import _between_components, _edges, confirm
from assayer.operators.clusters import components
from assayer.session import cut

FUNCTIONS = 128
WORDS = 5
BANDS, ROWS = 25, 5   # sets of similarity 0.8 share a band but for 1 in 20,000


def signatures(column: pa.Array, permutations: hashing.Permutations, size: int) -> np.ndarray:
    """16 bits of each minimum, one row per text; a text without words has all bits set."""
    sets = hashing.word_shingles(*utf8(column), size)
    return np.stack([permutations.least(s) for s in sets]).astype(np.uint16) if sets else np.zeros((0, FUNCTIONS), np.uint16)


def _neighbours(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = hashing.Permutations(FUNCTIONS)
        block, ids, bodies = None, [], []

        def finished(upto: int) -> pa.RecordBatch:
            now, after = bodies[:upto], bodies[1:upto + 1]
            edited = []
            for own, following in zip(now, after):
                quarter = len(own) // 4
                edited.append(own[:len(own) - quarter] + following[:quarter])
            prints = signatures(pa.array(bodies[:upto + 1], pa.large_string()), permutations, size)
            changed = signatures(pa.array(edited, pa.large_string()), permutations, size)
            return pa.RecordBatch.from_arrays([
                pa.array(ids[:upto], pa.int64()), pa.array([len(t) for t in now], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in edited]),
                pa.array([p.tobytes().hex() for p in prints[:upto]]), pa.array([p.tobytes().hex() for p in changed]),
                pa.array((prints[:upto] == changed).mean(axis=1)), pa.array((prints[:upto] == prints[1:]).mean(axis=1)),
            ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        for batch in pieces(batches):
            targets = batch.column("target").to_numpy()
            for at in np.flatnonzero(np.r_[True, targets[1:] != targets[:-1]]).tolist() if batch.num_rows else []:
                rows = int(np.count_nonzero(targets == targets[at]))
                own = ~batch.column("copy").to_numpy(zero_copy_only=False)[at:at + rows]
                keep = int(own.sum())
                if targets[at] != block:
                    block, ids, bodies = targets[at], [], []
                ended = bool(ids) and len(bodies) > len(ids)
                if ended:   # the block's end has been handled with the first copy
                    continue
                last = min(rows, keep + 1)
                ids = ids + batch.column("doc_id")[at:at + keep].to_pylist()
                bodies = bodies + batch.column("text")[at:at + last].to_pylist()
                upto = len(bodies) - 1
                if upto > 0:
                    yield finished(upto)
                    if len(bodies) > len(ids):
                        ids, bodies = [None], [None, None]   # done
                    else:
                        ids, bodies = ids[upto:], bodies[upto:]
    return run


def edit_likeness(docs: DataFrame, size: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edit, and how alike they are.

    ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.
    The edit replaces the last quarter of the code points by as many of the next document's
    first ones, or all it has; next is the next greater id, after the last comes the first. Rows
    with equal ids follow each other by their text, null ids come first. A null text counts as
    empty; empty texts are alike. Other columns are not read; an empty table gives no rows.

    Ids are cut into blocks at their quantiles; a block gets its own rows and a copy of the
    first row of the next block, so texts are moved once and no task needs more than two at once.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    source = texts(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    order = source.select(F.coalesce("doc_id", F.lit(least)).alias("doc_id"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = np.unique(np.array(order.approxQuantile("doc_id", [i / (4 * tasks) for i in range(1, 4 * tasks)], 1 / (16 * tasks)) or [0], np.float64).astype(np.int64))

    @F.pandas_udf("int")
    def block(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, ids.to_numpy(), "right").astype(np.int32))

    firsts = sorted((r.target, r.first) for r in order.groupBy(block("doc_id").alias("target")).agg(F.min("doc_id").alias("first")).collect())   # one row per block
    if not firsts:
        return spark.createDataFrame([], schema)
    heads = np.array([first for _, first in firsts])
    before = np.roll(np.array([target for target, _ in firsts], np.int32), 1)

    @F.pandas_udf("array<int>")
    def targets(ids: pd.Series) -> pd.Series:
        values = ids.to_numpy()
        own = np.searchsorted(points, values, "right").astype(np.int32)
        place = np.searchsorted(heads, values)
        head = (place < len(heads)) & (heads[np.minimum(place, len(heads) - 1)] == values)
        return pd.Series([[int(b), int(before[p]) + (1 << 30)] if h else [int(b)] for b, p, h in zip(own, place, head)])

    sent = source.withColumn("targets", targets(F.coalesce("doc_id", F.lit(least)))).select("doc_id", "text", F.explode("targets").alias("target"))
    sent = sent.select("doc_id", "text", (F.col("target") % (1 << 30)).alias("target"), (F.col("target") >= (1 << 30)).alias("copy"))
    dealt = sent.repartition(tasks, "target").sortWithinPartitions("target", "copy", "doc_id", "text")
    return dealt.mapInArrow(_neighbours(size), schema)


def _band_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = hashing.Permutations(BANDS * ROWS, seed=29)
        step = np.uint64(0x9E3779B97F4A7C15)
        for batch in pieces(batches):
            sets = hashing.word_shingles(*utf8(batch.column("text")), size)
            n = len(sets)
            minima = (np.stack([permutations.least(s) for s in sets]) if n else np.zeros((0, BANDS * ROWS))).reshape(n, BANDS, ROWS).astype(np.uint64)
            band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * step, (n, BANDS)).copy()
            for r in range(ROWS):
                band = hashing.mix(band * step + minima[:, :, r])
            sums = np.array([(s.sum(), hashing.mix(s ^ step).sum()) for s in sets], np.uint64).reshape(n, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(np.array([len(s) for s in sets], np.int64)), pa.array(sums[:, 0].copy()), pa.array(sums[:, 1].copy()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * BANDS + 1, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel()))],
                names=["doc_id", "n_shingles", "sum_a", "sum_b", "bands"])
    return run


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: the smallest id reachable over links of similarity ``percent`` % or more.

    Texts with equal shingle sets are one class. Each band of a signature names a bucket, and a
    class is verified against the first of its bucket; that is one pair per row, whatever the
    bucket's size. Buckets that still hold several components are settled exactly by their rare
    shingles. Null, empty and blank texts and null ids are linked with nothing; a null id has a
    null component. Other columns are not read.
    """
    source = texts(docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")), key, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    made = cut(source.mapInArrow(_band_rows(size), "doc_id bigint, n_shingles bigint, sum_a bigint, sum_b bigint, bands array<bigint>"))
    digest = ["n_shingles", "sum_a", "sum_b"]
    members = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = members.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    heads = cut(members.join(classes.withColumnsRenamed({c: f"_{c}" for c in digest}), F.expr(
        "doc_id = rep AND n_shingles = _n_shingles AND sum_a = _sum_a AND sum_b = _sum_b")).select("doc_id", F.explode("bands").alias("band")).distinct())
    hubs = cut(heads.groupBy("band").agg(F.min("doc_id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "hub"))
    bucketed = cut(heads.join(hubs, "band"))
    bodies = cut(source.join(bucketed.select("doc_id").distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    pairs = bucketed.where("doc_id != hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = cut(confirm(pairs, bodies, size, percent))
    roots = components(_edges(links)).withColumnRenamed("node", "doc_id")
    rooted = cut(bucketed.join(roots, "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
    mixed = cut(rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band"))
    open_members = cut(rooted.join(mixed, "band", "left_semi").select("doc_id", "root").distinct())
    if not open_members.isEmpty():
        inner = cut(bodies.join(open_members, "doc_id"))
        links = links.unionByName(cut(confirm(cut(_between_components(inner, size, percent)), inner.drop("root"), size, percent)))
    final = components(_edges(links)).select(F.col("node").alias("rep"), "root")
    placed = classes.join(final, "rep", "left").select(*digest, F.coalesce("root", "rep").alias("_root"))
    return made.select("doc_id", *digest).join(placed, digest, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_root", "doc_id")).alias("component_id"))
