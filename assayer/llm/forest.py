"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text becomes its set of word shingles, a digest of the set and a signature of
   ``TREES * DEPTH`` minima. Texts with equal sets form a class; its smallest id stands for it.
2. Each tree reads the signature from another position on. Its first ``DEPTH`` minima name a
   region; inside it classes are sorted by the minima that follow, so that neighbours share the
   longest common prefixes. The sort is one range partitioning over all trees, which cuts a
   crowded region into as many tasks as it needs; nothing is grouped.
3. In a region of up to ``NEAR + 1`` classes all pairs of neighbours are candidates, in a larger
   one each class's likeliest neighbours. Candidates that agree in enough minima are confirmed
   on the full sets, and links are contracted to components.
4. Classes of larger regions are settled exactly. Each has its rarest shingles listed, as many
   as one of a linked pair must share; two components meet only at a listed shingle whose place
   still allows the overlap asked for. A crowd of copies is one component by then, and a text
   with too many words of its own meets nobody, so no region gives all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.llm import hashing
from assayer.llm.batches import pieces, texts, utf8
from assayer.operators.clusters import components
from assayer.session import cut, discard

TREES = 16
DEPTH = 4        # minima that name a region; classes of similarity 0.85 share one in some tree but for 1 in 130,000
NEAR = 32        # neighbours of a class that are all candidates in a small region
WIDE = 128       # neighbours among which the likeliest are chosen in a larger one
BEST = 4         # so many
BUCKETS = 1 << 16   # counters by which shingles are ordered from rare to frequent

_SKETCH = "doc_id bigint, body bigint, n_shingles bigint, sum_a bigint, sum_b bigint, regions array<bigint>, low binary"
_PAIRS = "a bigint, b bigint, agree int"


def _sketch(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutations = hashing.Permutations(TREES * DEPTH)
        step = np.uint64(0x9E3779B97F4A7C15)
        for batch in pieces(batches):
            sets = hashing.word_shingles(*utf8(batch.column("text")), size)
            n = len(sets)
            minima = np.stack([permutations.least(s) for s in sets]) if n else np.zeros((0, TREES * DEPTH), np.uint32)
            sums = np.array([(s.sum(), hashing.mix(s ^ step).sum()) for s in sets], np.uint64).reshape(n, 2)
            wide = minima.reshape(n, TREES, DEPTH).astype(np.uint64)
            region = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64) * step, (n, TREES)).copy()
            for d in range(DEPTH):
                region = hashing.mix(region * step + wide[:, :, d])
            low = (minima & np.uint32(255)).astype(np.uint8)
            counts = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("body"), pa.array(counts), pa.array(sums[:, 0].view(np.int64).copy()), pa.array(sums[:, 1].view(np.int64).copy()),
                pa.ListArray.from_arrays(pa.array(np.arange(0, n * TREES + 1, TREES, dtype=np.int32)), pa.array(region.view(np.int64).ravel())),
                pa.array([row.tobytes() for row in low], pa.binary()),
            ], names=["doc_id", "body", "n_shingles", "sum_a", "sum_b", "regions", "low"])
    return run


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """One row per document: hash of its text, size and digest of its shingle set, region in each tree, low bytes of the minima."""
    return docs.withColumn("body", F.xxhash64("text")).mapInArrow(_sketch(size), _SKETCH)


def _walk(least: int, percent: int):
    """Pairs of neighbours that agree in ``least`` minima or more: all of a small region, the ``BEST`` of each class
    in a larger one. There each class is also paired with itself, as a mark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "doc_id", "n_shingles")]
            now.append(np.frombuffer(b"".join(batch.column("order").to_pylist()), np.uint8).reshape(n, -1))
            old = 0 if kept is None else len(kept[0])
            region, ids, sizes, rows = now if kept is None else [np.concatenate(x) for x in zip(kept, now)]
            crowded = np.zeros(len(region) + 1, np.int32)
            over = np.flatnonzero(region[NEAR + 1:] == region[:-NEAR - 1])
            np.add.at(crowded, over, 1)
            np.add.at(crowded, over + NEAR + 2, -1)
            crowded = np.cumsum(crowded)[:-1] > 0
            found = []
            for lag in range(1, min(WIDE, len(region) - 1) + 1):
                at = max(0, old - lag)
                left = np.flatnonzero(region[at + lag:] == region[at:len(region) - lag]) + at
                if not len(left):
                    break
                right = left + lag
                ok = 100 * np.minimum(sizes[left], sizes[right]) >= percent * np.maximum(sizes[left], sizes[right])
                left, right = left[ok], right[ok]
                for part in range(0, len(left), 65536):
                    i, j = left[part:part + 65536], right[part:part + 65536]
                    agree = (rows[i] == rows[j]).sum(axis=1, dtype=np.int32)
                    fine = agree >= least
                    found.append((i[fine], j[fine], agree[fine]))
            marked = np.unique(ids[crowded])
            a, b, scores = [marked], [marked], [np.zeros(len(marked), np.int32)]
            if found:
                i, j, agree = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((ids[i], -agree, j))
                opens = np.r_[True, j[order][1:] != j[order][:-1]][:len(order)]
                places = np.arange(len(order))
                place = places - np.maximum.accumulate(np.where(opens, places, 0)) if len(order) else places
                order = order[(place < BEST) | ~crowded[j[order]]]
                i, j, agree = i[order], j[order], agree[order]
                a.append(np.minimum(ids[i], ids[j]))
                b.append(np.maximum(ids[i], ids[j]))
                scores.append(agree)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b, scores)], names=["a", "b", "agree"])
            tail = max(0, len(region) - WIDE)
            tail = max(tail, int(np.searchsorted(region, region[-1])))
            kept = [x[tail:] for x in (region, ids, sizes, rows)]
    return run


def _sorted_walk(classes: DataFrame, least: int, percent: int) -> DataFrame:
    size = TREES * DEPTH
    rotated = [F.concat(F.substring("low", DEPTH * (t + 1) + 1, size), F.substring("low", 1, DEPTH * (t + 1))) for t in range(TREES)]
    rows = classes.select("doc_id", "n_shingles", F.explode(F.arrays_zip(F.col("regions").alias("region"), F.array(*rotated).alias("order"))).alias("x"))
    rows = rows.select(F.col("x.region").alias("region"), F.col("x.order").alias("order"), "doc_id", "n_shingles")
    order = ["region", "order", "doc_id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_walk(least, percent), _PAIRS)


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "text_a"), "text_b"):
            left = hashing.word_shingles(*utf8(batch.column("text_a")), size)
            right = hashing.word_shingles(*utf8(batch.column("text_b")), size)
            linked = []
            for x, y in zip(left, right):
                both = np.sort(np.concatenate((x, y)))
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                linked.append(shared > 0 and 100 * shared >= percent * (len(x) + len(y) - shared))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(keep)
    return run


def confirm(pairs: DataFrame, bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full shingle sets are as similar as asked."""
    left = bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(_confirm(size, percent), "a bigint, b bigint")


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u != v")


def _buckets(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) % BUCKETS


def _bucket_counts(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in pieces(batches):
            for one in hashing.word_shingles(*utf8(batch.column("text")), size):
                total += np.bincount(_buckets(one), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])
    return run


def _rarest(size: int, percent: int, counts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = hashing.word_shingles(*utf8(batch.column("text")), size)
            order = [s[np.argsort(counts.value[_buckets(s)], kind="stable")] for s in sets]
            listed = [o[:len(o) + (-percent * len(o)) // 100 + 1] for o in order]
            rows = np.repeat(np.arange(len(sets)), [len(x) for x in listed])
            place = np.concatenate([np.arange(len(x), dtype=np.int64) for x in listed] or [np.zeros(0, np.int64)])
            flat = np.concatenate(listed or [np.zeros(0, np.uint64)]).view(np.int64)
            took = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(flat), batch.column("doc_id").take(took), batch.column("root").take(took), pa.array(place),
                                              pa.array(np.array([len(s) for s in sets], np.int64)).take(took)], names=["shingle", "doc_id", "root", "place", "n"])
    return run


def _between_components(bodies: DataFrame, size: int, percent: int) -> DataFrame:
    """Every pair ``(a, b)`` of ``bodies`` (``doc_id``, ``root``, ``text``) that can be linked and has two roots.

    Shingles have one order, from rare to frequent, with the bucket counters of ``BUCKETS``; any
    order is exact. Linked sets share at least ``percent`` % of either, so their first common
    shingle is among the first ``n - ceil(percent * n / 100) + 1`` of both, and after its place
    both must have enough left. The counters are the only thing that is broadcast.
    """
    sums = bodies.select("text").mapInArrow(_bucket_counts(size), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in sums:
        counts[bucket] = n
    shared = bodies.sparkSession.sparkContext.broadcast(counts)
    rows = cut(bodies.mapInArrow(_rarest(size, percent, shared), "shingle bigint, doc_id bigint, root bigint, place bigint, n bigint"))

    def mixed(frame: DataFrame) -> DataFrame:
        return cut(frame.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least")).where("low < high").select("shingle", "least"))

    met = mixed(rows)
    able = cut(rows.join(met, "shingle").where(f"{100 + percent} * (n - place) >= {percent} * (n + greatest(least, {percent} * n / 100))").drop("least"))
    met_again = mixed(able)
    left = able.join(met_again.select("shingle"), "shingle")
    right = left.select("shingle", *[F.col(c).alias(f"_{c}") for c in ("doc_id", "root", "place", "n")])
    pairs = cut(left).join(cut(right), "shingle").where(
        f"root < _root AND {100 + percent} * least(n - place, _n - _place) >= {percent} * (n + _n) AND 100 * least(n, _n) >= {percent} * greatest(n, _n)")
    return pairs.select(F.least("doc_id", "_doc_id").alias("a"), F.greatest("doc_id", "_doc_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, body, n_shingles, component_id, kept)``, one row per row of ``docs``; ``body`` is the text's xxhash64, a null text as the empty one.

    Documents are linked when ``100 * shared >= percent * united`` holds for their sets of
    distinct ``size``-word shingles (A-Z lowered, words split at ASCII blanks; a text with
    fewer words is one shingle). ``component_id`` is the smallest id reachable over links,
    ``kept`` marks the row that bears it. A null, empty or blank text has no shingle and is
    linked with nothing. A row with a null id is linked with nothing and kept, its
    ``component_id`` is null. Rows with the same id are judged by their own texts. Other
    columns are not read. Ids are whole numbers. An empty table gives an empty result.
    """
    source = texts(docs, key, text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    made = cut(sketches(source, size))
    digest = ["n_shingles", "sum_a", "sum_b"]
    members = made.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = members.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    heads = cut(members.join(classes.withColumnsRenamed({c: f"_{c}" for c in digest}), F.expr(
        "doc_id = rep AND n_shingles = _n_shingles AND sum_a = _sum_a AND sum_b = _sum_b")).select(
        "doc_id", "n_shingles", "regions", "low").dropDuplicates(["doc_id", "low"]))

    minima, share = TREES * DEPTH, percent / 100
    least = max(DEPTH, int(minima * share - 4.5 * sqrt(minima * share * (1 - share))))
    walked = cut(_sorted_walk(heads, least, percent).select("a", "b").distinct())
    involved = walked.select(F.col("a").alias("doc_id")).union(walked.select("b")).distinct()
    bodies = cut(source.join(involved.hint("merge"), "doc_id", "left_semi"))   # alike at every size
    links = cut(confirm(walked.where("a < b"), bodies, size, percent))
    roots = components(_edges(links))
    crowd = walked.where("a = b").select(F.col("a").alias("doc_id"))
    members = cut(bodies.join(crowd, "doc_id", "left_semi").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id")))
    if not members.isEmpty():
        more = cut(confirm(_between_components(members, size, percent), members.drop("root"), size, percent))
        if not more.isEmpty():
            roots = components(_edges(more.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))))
    final = roots.withColumnRenamed("node", "rep")
    discard(bodies, walked)

    placed = classes.join(final, "rep", "left").select(*digest, F.coalesce("root", "rep").alias("_root"))
    one = made.select("doc_id", "body", *digest)
    return one.join(placed, digest, "left").select(
        "doc_id", "body", "n_shingles",
        F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("_root", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
