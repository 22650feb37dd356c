"""Scope, sampling and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer import ROW_ID
from assayer.operators.values import distinct_counts
from assayer.schema import as_text, col, cols, comparable, data_columns, families


def scoped(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Selected columns in table order; all when none is selected. The row id always stays."""
    chosen = [c for c in data_columns(df) if c in set(columns or [])] or data_columns(df)
    return df.select(*([ROW_ID] if ROW_ID in df.columns else []), *cols(chosen))


def drop_columns(df: DataFrame, rules: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The table without the columns and the rules without those that name them."""
    return df.drop(*columns), rules.where(~F.col("column").isin(columns))


def search(df: DataFrame, needle: str, columns: list[str] | None = None) -> DataFrame:
    """Rows with the literal text in any column, letter case ignored."""
    cells = F.array(*[as_text(df, c) for c in comparable(df, columns)])
    wanted = F.lower(F.lit(needle))
    return df.where(F.exists(cells, lambda v: F.coalesce(F.contains(F.lower(v), wanted), F.lit(False))))


def sample_percent(df: DataFrame, percent: int, seed: int = 42) -> DataFrame:
    """A share of the rows chosen by a hash of the row id, the same rows on every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(ROW_ID).cast("string")).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % 100 < percent)


def column_summary(df: DataFrame) -> DataFrame:
    """``(column, dtype, non_null, null_percentage, distinct_count)``; nested types have no distinct count."""
    names = data_columns(df)
    row = df.agg(*[F.struct(F.lit(c).alias("column"), F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
                            F.count(col(c)).alias("non_null"), F.count(F.lit(1)).alias("total")).alias(f"c{i}") for i, c in enumerate(names)])
    counted = row.select(F.inline(F.array(*[col(f"c{i}") for i in range(len(names))])))
    return counted.join(F.broadcast(distinct_counts(df)), "column", "left").select(
        "column", "dtype", "non_null", F.when(F.col("total") > 0, (F.col("total") - F.col("non_null")) / F.col("total") * 100).otherwise(0.0).alias("null_percentage"), "distinct_count")
