"""Counting equal rows by digests: 24 bytes a row are shuffled, however long the values are.

Rows are grouped by 128 bits of hash of their values and nulls. Another 64 bits, taken over the
values in reverse order, travel along; two rows that agree in the first and differ in the second
are told apart by nothing but luck, so such a group is an error and never a wrong count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer import ROW_ID
from assayer.schema import col, quoted

DIGEST = ["_a", "_b"]


def digest(names: list[str]) -> list[Column]:
    """The two hashes of a tuple of values, nulls equal to each other and to nothing else."""
    cells = [e for c in names for e in (col(c).isNull(), col(c))]
    return [F.xxhash64(*cells).alias("_a"), F.xxhash64(F.lit(7), *cells).alias("_b")]


def _check(names: list[str]) -> Column:
    return F.xxhash64(F.lit(13), *[e for c in reversed(names) for e in (col(c), col(c).isNull())]).alias("_check")


def _present(names: list[str], missing: str) -> Column:
    """``missing`` tells which rows are left out: with ``all`` or ``any`` values null, or ``none``."""
    flags = [col(c).isNotNull() for c in names]
    out = flags[0]
    for flag in flags[1:]:
        out = (out | flag) if missing == "all" else (out & flag)
    return F.lit(True) if missing == "none" else out


def tallies(df: DataFrame, key_sets: list[tuple[list[str], str]], *aggregates: Column) -> DataFrame:
    """``(key_set, _a, _b, rows, ...)`` of all key sets from one scan; a set is its columns and which rows to leave out.

    Further aggregates see the row id. Rows combine in their task before the shuffle.
    """
    entry = lambda n, names, missing: F.when(_present(names, missing), F.struct(F.lit(n).alias("key_set"), *digest(names), _check(names)))
    ids = [ROW_ID] if ROW_ID in df.columns else []
    cells = df.select(*ids, F.explode(F.array_compact(F.array(*[entry(n, *s) for n, s in enumerate(key_sets)]))).alias("_k")).select(*ids, "_k.*")
    grouped = cells.groupBy("key_set", *DIGEST).agg(F.count(F.lit(1)).alias("rows"), F.min("_check").alias("_low"), F.max("_check").alias("_high"), *aggregates)
    sound = F.when(F.col("_low") == F.col("_high"), F.col("rows")).otherwise(F.raise_error(F.lit("two different rows have one digest")).cast("bigint"))
    return grouped.withColumn("rows", sound).drop("_low", "_high")


def repetition(df: DataFrame, key_sets: list[tuple[list[str], str]]) -> DataFrame:
    """``(key_set, total, distinct_rows, repeated, combos)`` per key set: its rows, different tuples, rows whose tuple repeats and repeated tuples."""
    found = tallies(df, key_sets).groupBy("key_set").agg(
        F.sum("rows").alias("total"), F.count(F.lit(1)).alias("distinct_rows"), F.sum(F.when(F.col("rows") > 1, F.col("rows"))).alias("repeated"), F.count_if(F.col("rows") > 1).alias("combos"))
    listed = df.sparkSession.createDataFrame([(n,) for n in range(len(key_sets))], "key_set int")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return F.broadcast(listed).join(found, "key_set", "left").select("key_set", zero("total"), zero("distinct_rows"), zero("repeated"), zero("combos"))


def first_rows(df: DataFrame, keys: list[str], missing: str = "none") -> DataFrame:
    """``(_a, _b, rows, first, last)``: every tuple of ``keys`` with its smallest and largest row id."""
    return tallies(df, [(keys, missing)], F.min(ROW_ID).alias("first"), F.max(ROW_ID).alias("last")).drop("key_set")


def with_digest(df: DataFrame, names: list[str], *others: str) -> DataFrame:
    return df.select(*[F.col(quoted(o)) for o in others], *digest(names))
