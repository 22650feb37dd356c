"""Fixity audit of WARC replicas by Merkle trees, in DataFrame operations alone.

A record's leaf is its SHA-256. The records that start in one range of ``SPAN`` bytes of a file
are hashed in the order of their offsets to a node, ``FAN`` neighbouring ranges to the node
above, and so on to the file's root. Two replicas are compared root by root; only below roots
that differ are children read, level by level, down to the records that are changed, missing
or extra. Ranges go by offset, so a lost record disturbs its own branch only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import cut

SPAN = 1 << 16
FAN = 16
RECORDS_OF_FILE = 512


@dataclass
class Tree:
    """``leaves`` (file, offset, length, digest) and ``levels``: nodes (file, node, hash) from the ranges up to the roots."""

    leaves: DataFrame
    levels: list[DataFrame]

    @property
    def roots(self) -> DataFrame:
        return self.levels[-1].select("file", F.col("hash").alias("root"))


def record(uri: Column, body: Column) -> Column:
    """A WARC resource record as text; null parts are empty."""
    uri, body = F.coalesce(uri, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", per_file: int = RECORDS_OF_FILE) -> DataFrame:
    """``(file, offset, length, digest, id)``: leaves of the archive files that hold ``pages`` in the order of ids.

    A file has the pages of ``per_file`` consecutive ids. The record's bytes are hashed where the
    page is read; offsets come from the lengths alone. Null urls and bodies are empty. Rows with
    a null id go to file -1; rows with equal ids follow each other by digest.
    """
    made = pages.select(F.col(f"`{key}`").cast("bigint").alias("id"), record(F.col(f"`{url}`"), F.col(f"`{body}`")).alias("record"))
    hashed = made.select("id", F.coalesce(F.floor(F.col("id") / per_file), F.lit(-1)).cast("bigint").alias("file"),
                         F.octet_length("record").cast("bigint").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
    order = Window.partitionBy("file").orderBy("id", "digest", "length").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hashed.select("file", (F.sum("length").over(order) - F.col("length")).alias("offset"), "length", "digest", "id")


def build(leaves: DataFrame, height: int) -> Tree:
    """The tree over ``leaves`` with ``height`` levels above the ranges; every level is a table of its own."""
    kept = cut(leaves.select("file", "offset", "length", "digest"))
    lines = F.array_sort(F.collect_list(F.struct("offset", "length", "digest")))   # at most SPAN bytes of records
    level = cut(kept.groupBy("file", F.floor(F.col("offset") / SPAN).cast("bigint").alias("node")).agg(
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat_ws(":", x["offset"].cast("string"), x["length"].cast("string"), x["digest"])), "\n"), 256).alias("hash")))
    levels = [level]
    for _ in range(height):
        children = F.array_sort(F.collect_list(F.struct("node", "hash")))            # at most FAN
        level = cut(level.groupBy("file", F.floor(F.col("node") / FAN).cast("bigint").alias("parent")).agg(
            F.sha2(F.array_join(F.transform(children, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), "\n"), 256).alias("hash")).withColumnRenamed("parent", "node"))
        levels.append(level)
    return Tree(kept, levels)


def height(*leaves: DataFrame) -> int:
    """Levels above the ranges until every file has one root."""
    ends = [t.agg(F.max("offset")).first()[0] or 0 for t in leaves]
    ranges, levels = max(ends) // SPAN, 0
    while ranges:
        ranges, levels = ranges // FAN, levels + 1
    return levels


def audit(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """``(file, offset, status, length, digest, replica_length, replica_digest)``: the records that differ.

    ``status`` is ``changed``, ``missing`` (not in the replica) or ``extra`` (only there). Inputs
    are leaves with ``file``, ``offset``, ``length`` and ``digest``; other columns are not read.
    Repeated rows count as one leaf. Equal replicas, also empty ones, give no rows.
    """
    columns = ["file", "offset", "length", "digest"]
    first, second = primary.select(*columns).distinct(), replica.select(*columns).distinct()
    levels = height(first, second)
    one, two = build(first, levels), build(second, levels)

    def differing(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(F.col("file").alias("_file"), F.col("node").alias("_node"), F.col("hash").alias("_hash"))
        both = a.join(b, a["file"].eqNullSafe(b["_file"]) & (a["node"] == b["_node"]), "full_outer")
        return both.where(~F.col("hash").eqNullSafe(F.col("_hash"))).select(
            F.when(F.col("hash").isNull(), F.col("_file")).otherwise(F.col("file")).alias("file"), F.coalesce("node", "_node").alias("node"))

    def below(rows: DataFrame, parent: Column, bad: DataFrame) -> DataFrame:
        bad = bad.select(F.col("file").alias("_bad"), F.col("node").alias("_above"))
        return rows.join(bad, rows["file"].eqNullSafe(bad["_bad"]) & (parent == bad["_above"]), "left_semi")

    bad = cut(differing(one.levels[-1], two.levels[-1]))
    for level in range(levels - 1, -1, -1):
        parent = F.floor(F.col("node") / FAN).cast("bigint")
        bad = cut(differing(below(one.levels[level], parent, bad), below(two.levels[level], parent, bad)))
    span = F.floor(F.col("offset") / SPAN).cast("bigint")
    a = below(one.leaves, span, bad)
    b = below(two.leaves, span, bad).select(F.col("file").alias("_file"), F.col("offset").alias("_offset"), F.col("length").alias("replica_length"), F.col("digest").alias("replica_digest"))
    both = a.join(b, a["file"].eqNullSafe(b["_file"]) & (a["offset"] == b["_offset"]), "full_outer")
    status = F.when(F.col("replica_digest").isNull(), F.lit("missing")).when(F.col("digest").isNull(), F.lit("extra")).when(
        (F.col("digest") != F.col("replica_digest")) | (F.col("length") != F.col("replica_length")), F.lit("changed"))
    return both.withColumn("status", status).where("status IS NOT NULL").select(
        F.when(F.col("digest").isNull(), F.col("_file")).otherwise(F.col("file")).alias("file"), F.coalesce("offset", "_offset").alias("offset"),
        "status", "length", "digest", "replica_length", "replica_digest")
