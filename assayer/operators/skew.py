"""Joining a large table to one row per key when some keys are very frequent."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.schema import col, cols, quoted

HOT_ROWS = 1_000_000   # a key below this many rows fits one task


def group_sizes(df: DataFrame, keys: list[str], *aggregates) -> DataFrame:
    """``rows`` per key tuple; map-side combine leaves one row per key and partition."""
    return df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("rows"), *aggregates)


def attach(df: DataFrame, per_key: DataFrame, keys: list[str], how: str = "inner",
           hot_rows: int = HOT_ROWS, total: int | None = None) -> DataFrame:
    """Join ``df`` with ``per_key`` on ``keys``, null-safe; ``rows`` is the key's size in ``df``.

    Every key above ``hot_rows`` rows is dealt to as many tasks as it holds that number, and its
    ``per_key`` row is repeated as often. The hashes of these keys are broadcast, 16 bytes for
    every ``hot_rows`` rows of ``df`` at most. The salt is a hash of the row, so a task that runs
    again sends its rows the same way. A known ``total`` of rows in ``df`` up to ``hot_rows``
    leaves no room for a hot key.
    """
    if total is not None and total <= hot_rows:
        renamed = per_key.withColumnsRenamed({k: f"_key_{k}" for k in keys})
        condition = F.lit(True)
        for k in keys:
            condition = condition & col(k).eqNullSafe(col(f"_key_{k}"))
        return df.join(renamed, condition, how).drop(*[f"_key_{k}" for k in keys])
    hot = (
        per_key.where(F.col("rows") > hot_rows)
        .select(F.xxhash64(*cols(keys)).alias("_hash"), "rows").groupBy("_hash").agg(F.max("rows").alias("rows"))
        .select("_hash", F.ceil(F.col("rows") / hot_rows).cast("int").alias("_salts"))
    )
    hot = F.broadcast(hot)
    left = (
        df.withColumn("_hash", F.xxhash64(*cols(keys))).join(hot, "_hash", "left")
        .withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*cols(df.columns)), F.col("_salts")), F.lit(0)).cast("int"))
        .drop("_hash", "_salts")
    )
    renamed = [col(k).alias(f"_key_{k}") for k in keys]
    others = [c for c in per_key.columns if c not in keys]
    right = (
        per_key.select(*renamed, *cols(others), F.xxhash64(*cols(keys)).alias("_hash")).join(hot, "_hash", "left")
        .withColumn("_salt_right", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_hash", "_salts")
    )
    condition = left["_salt"] == right["_salt_right"]
    for k in keys:
        condition = condition & left[quoted(k)].eqNullSafe(right[quoted(f"_key_{k}")])
    return left.join(right, condition, how).drop("_salt", "_salt_right", *[f"_key_{k}" for k in keys])


def members_of_repeated(df: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """Rows whose key tuple occurs more than once, nulls equal to each other.

    Rows with a unique tuple are removed by their id, so no task ever holds a whole group.
    """
    single = group_sizes(df, keys, F.min(row_id).alias("_single_id")).where("rows = 1")
    return df.join(single.select(F.col("_single_id").alias(row_id)), row_id, "left_anti")
