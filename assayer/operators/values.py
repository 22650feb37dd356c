"""Distinct values per column and everything that follows from them."""

from __future__ import annotations

import heapq
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import ROW_ID
from assayer.functions import text
from assayer.schema import TEXT, as_text, col, cols, comparable, families


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def value_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, rows)``, nulls kept as a value.

    One branch per column, each scanning and shuffling that column alone; grouping runs on the
    native type and only distinct values are turned into text.
    """
    names = comparable(df, columns)
    return union_all([
        df.groupBy(col(c).alias("_v")).agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit(c).alias("column"), as_text_value(df, c).alias("value"), "rows")
        for c in names
    ])


def as_text_value(df: DataFrame, column: str) -> Column:
    return F.col("_v") if families(df)[column] == TEXT else F.col("_v").cast("string")


def distinct_counts(df: DataFrame, columns: list[str] | None = None, approximate: bool = False) -> DataFrame:
    """``(column, distinct_count)`` of non-null values."""
    names = comparable(df, columns)
    if approximate:
        counted = df.agg(*[F.approx_count_distinct(col(c)).alias(c) for c in names])
        return counted.unpivot([], cols(names), "column", "distinct_count")
    return union_all([digest_counts(df, names[at:at + DIGESTS_PER_PASS]) for at in range(0, len(names), DIGESTS_PER_PASS)])


DIGESTS_PER_PASS = 16   # columns of one scan


def digest_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """``(column, distinct_count)`` from one scan: every value travels as 128 bits of hash with its column's number."""
    cell = lambda i, c: F.struct(F.lit(i).alias("i"), col(c).isNotNull().alias("there"), F.xxhash64(col(c)).alias("a"), F.xxhash64(F.lit(7), col(c)).alias("b"))
    cells = df.select(F.explode(F.array(*[cell(i, c) for i, c in enumerate(names)])).alias("x")).select("x.*").where("there")
    counted = cells.groupBy("i", "a", "b").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    listed = df.sparkSession.createDataFrame(list(enumerate(names)), "i int, column string")
    return F.broadcast(listed).join(counted, "i", "left").select("column", F.coalesce("n", F.lit(0).cast("bigint")).alias("distinct_count"))


def first_values(df: DataFrame, columns: list[str], k: int, condition=None, value=None) -> DataFrame:
    """First ``k`` matching cells of each column by row id: ``(column, _row_id, value)``.

    ``condition(name)`` defaults to not null. Each column keeps a heap of ``k`` rows per task.
    """
    keep = condition or (lambda c: col(c).isNotNull())
    shown = value or (lambda c: as_text(df, c))
    return union_all([
        df.where(keep(c)).select(F.lit(c).alias("column"), F.col(ROW_ID), shown(c).alias("value"))
        .orderBy(ROW_ID).limit(k)
        for c in columns
    ])


def smallest_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """``(column, value)``: the first ``k`` distinct values of each column in the order of their text.

    Every task keeps ``k`` values per column, and only these are shuffled and compared again.
    """
    def run(batches):
        kept: dict[int, list[str]] = {}
        for batch in batches:
            for i in range(batch.num_columns):
                values = set(pc.unique(pc.drop_null(batch.column(i))).to_pylist())
                kept[i] = heapq.nsmallest(k, values.union(kept.get(i, ())))
        if any(kept.values()):
            number, value = zip(*[(i, v) for i, listed in kept.items() for v in listed])
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), pa.array(value, pa.string())], names=["i", "value"])

    cells = df.select(*[as_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    near = cells.mapInArrow(run, "i int, value string").distinct()
    first = near.withColumn("_n", F.row_number().over(Window.partitionBy("i").orderBy("value"))).where(F.col("_n") <= k)
    return first.select(F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1).alias("column"), "value")


def top_values(df: DataFrame, columns: list[str], k: int, condition: str = "true") -> DataFrame:
    """``k`` most frequent values of each column with their rank, ties by value.

    Every column keeps a heap of ``k`` rows per task; only the chosen rows are ranked.
    """
    chosen = union_all([
        value_counts(df, [c]).where(condition).orderBy(F.col("rows").desc(), F.col("value").asc_nulls_first()).limit(k) for c in columns
    ])
    order = Window.partitionBy("column").orderBy(F.col("rows").desc(), F.col("value").asc_nulls_first())
    return chosen.withColumn("rank", F.row_number().over(order))


def repeated_values(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column, value, rows)``: every value that more than one row holds, null among them."""
    return value_counts(df, columns).where("rows > 1")


def duplicate_value_text(df: DataFrame, columns: list[str] | None = None, shown: int = 1000) -> DataFrame:
    """``value(count), ...`` of the ``shown`` most frequent repeated values per column, for display.

    ``repeated_values`` counts all of them; the function of that name lists them.
    """
    names = comparable(df, columns)
    value = F.when(text.blank(F.col("value")), F.lit("Missing Values")).otherwise(text.strip(F.col("value")))
    ranked = top_values(df, names, shown, "rows > 1").withColumn("shown", F.concat(value, F.lit("("), F.col("rows").cast("string"), F.lit(")")))
    listed = ranked.groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda s: s["shown"]), ", ").alias("duplicate_values")
    )
    totals = value_counts(df, names).groupBy("column").agg(F.count_if(F.col("rows") > 1).alias("repeated_values"))
    return totals.join(listed, "column", "left").select("column", F.coalesce("duplicate_values", F.lit("No duplicates")).alias("duplicate_values"), "repeated_values")


def repeated_value_groups(df: DataFrame, columns: list[str], total_rows: int, k: int = 10, ids: int = 5) -> DataFrame:
    """Top repeated values of each column with share and first row ids.

    The digests of at most ``k`` values per column, 24 bytes each, are broadcast and looked up in
    one scan; the ids come from a bounded per-task limit.
    """
    top = top_values(df, columns, k, "value is not null and rows > 1")
    number = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    hashes = lambda value: (F.xxhash64(value).alias("a"), F.xxhash64(F.lit(7), value).alias("b"))
    wanted = F.broadcast(top.select(number[F.col("column")].alias("i"), *hashes(F.col("value")), "rank"))
    cell = lambda i, c: F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("i"), *hashes(as_text(df, c))))
    cells = df.select(ROW_ID, F.explode(F.array_compact(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).alias("x")).select(ROW_ID, "x.*")
    hits = cells.join(wanted, ["i", "a", "b"])
    order = Window.partitionBy("i", "rank").orderBy(ROW_ID)
    first = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= ids)
    found = first.groupBy("i", "rank").agg(F.array_join(F.array_sort(F.collect_list(ROW_ID)).cast("array<string>"), ",").alias("row_ids"))
    listed = top.withColumn("i", number[F.col("column")]).join(found, ["i", "rank"])
    return listed.select(
        "column", "rank", F.substring("value", 1, 50).alias("value"), "rows",
        F.round(F.col("rows") / F.lit(total_rows) * 100, 2).alias("percentage"), "row_ids",
    )
