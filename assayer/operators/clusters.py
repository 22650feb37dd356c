"""Rows linked by any shared column value, closed over chains (connected components)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.schema import col

from assayer import ROW_ID
from assayer.operators.skew import attach, group_sizes
from assayer.operators.values import union_all
from assayer.session import cut, discard


def hubs(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(row id, v, hubs)``: rows that share a value, the smallest rows of their shared values, and the least of these as ``v``."""
    parts = []
    for c in columns:
        present = df.where(col(c).isNotNull()).select(ROW_ID, c)
        hub = group_sizes(present, [c], F.min(ROW_ID).alias("v")).where("rows > 1")
        parts.append(attach(present, hub, [c]).select(ROW_ID, "v"))
    return union_all(parts).groupBy(ROW_ID).agg(F.min("v").alias("v"), F.collect_set("v").alias("hubs"))


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)``: smallest node reachable from each node that has an edge ``(u, v)``, u > v.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014). Every step keeps
    the component structure; steps follow until one changes nothing. Each is written to the
    checkpoint folder, and the one before is deleted.
    """
    current = cut(edges)
    size = _digest(current)
    while True:
        step = cut(_small_star(_large_star(current, size[0]), size[0]).distinct())
        discard(current)
        before, size = size, _digest(step)
        if size == before:
            break
        current = step
    return step.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        step.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def _digest(edges: DataFrame) -> tuple:
    """Size and two order-free hashes of a distinct edge set."""
    return tuple(edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("u", "v").cast("bigint")).alias("s")).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of the node's closed neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = group_sizes(both, ["u"], F.min("v").alias("m")).select("u", "rows", F.least("u", "m").alias("m"))
    joined = attach(both.where("v > u"), least, ["u"], total=2 * total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")   # repeated edges go with the small star


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Connect every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = group_sizes(down, ["u"], F.min("v").alias("m"))
    joined = attach(down, least, ["u"], total=2 * total)
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(
        least.select("u", F.col("m").alias("v")))


def or_groups(df: DataFrame, columns: list[str]) -> DataFrame:
    """Membership ``(group_id, _row_id, is_leader, score)`` of rows equal on any of the columns."""
    rows = cut(hubs(df, columns))
    # Only smallest rows of values are nodes; a row with one shared value brings no edge.
    edges = rows.where(F.size("hubs") > 1).select(F.explode("hubs").alias("u"), "v").where("u <> v").distinct()
    roots = components(edges)
    sizes = cut(group_sizes(rows, ["v"]).join(roots.withColumnRenamed("node", "v"), "v", "left").select("v", "rows", F.coalesce("root", "v").alias("root")))
    found = attach(rows.select(ROW_ID, "v"), sizes, ["v"]).select("root", F.col(ROW_ID).alias("node"))
    return found.select(F.col("root").alias("group_id"), F.col("node").alias(ROW_ID),
                        (F.col("node") == F.col("root")).alias("is_leader"), F.lit(100.0).alias("score"))
