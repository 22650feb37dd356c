"""Writers. Every sink writes its partitions in parallel into a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer import ROW_ID
from assayer.operators.dedup import summaries
from assayer.operators.order import numbered
from assayer.operators.rules import Rule, failing_rows
from assayer.operators.select import sample_percent, scoped
from assayer.schema import cols

TASK_ROWS = 1_000_000       # that one task writes, in several batches one after another if they are small


def chosen(df: DataFrame, columns: list[str] | None, percent: int) -> DataFrame:
    rows = sample_percent(df, percent) if percent < 100 else df
    return scoped(rows, columns).drop(ROW_ID)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, percent: int = 100, delimiter: str = ",",
              quote: str = '"', encoding: str = "UTF-8", compression: str = "none") -> None:
    chosen(df, columns, percent).write.csv(path, header=True, sep=delimiter, quote=quote, escape=quote, encoding=encoding,
                                         compression=compression, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_parquet(df: DataFrame, path: str, columns: list[str] | None = None, percent: int = 100) -> None:
    chosen(df, columns, percent).write.parquet(path, compression="snappy")


def write_json(df: DataFrame, path: str, columns: list[str] | None = None, percent: int = 100, compression: str = "none") -> None:
    """One JSON record per line."""
    chosen(df, columns, percent).write.json(path, compression=compression, ignoreNullFields=False)


def write_batches(df: DataFrame, path: str, rows_per_file: int = 100_000, columns: list[str] | None = None, file_format: str = "csv") -> None:
    """Folder ``batch=i`` holds one file with the rows of places ``i * rows_per_file`` up to the next batch, by row id.

    Places come from counts per partition; a batch is written by one task, which sorts it.
    """
    size = max(1, rows_per_file)
    placed = numbered(df, [ROW_ID], "_place").withColumn("batch", F.floor(F.col("_place") / size).cast("bigint"))
    chosen_columns = [c for c in scoped(df, columns).columns if c != ROW_ID]
    if "batch" in chosen_columns:
        raise ValueError("a column named batch would clash with the folders")
    count = (placed.agg(F.max("batch")).first()[0] or 0) + 1
    # A task costs more than a small file, so tasks follow the rows and not the batches.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count * size // TASK_ROWS))
    batches = placed.repartition(int(min(count, tasks)), "batch").sortWithinPartitions("batch", "_place").select("batch", *cols(chosen_columns))
    writer = batches.write.partitionBy("batch")
    if file_format == "parquet":
        writer.parquet(path)
    else:
        writer.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_groups(df: DataFrame, membership: DataFrame, keys: list[str], match_type: str, path: str) -> None:
    """Group summary under ``summary`` and all member rows under ``members``."""
    summaries(df, membership, keys, match_type).write.parquet(f"{path}/summary")
    membership.select("group_id", ROW_ID).join(df, ROW_ID).write.parquet(f"{path}/members")


def write_failing(df: DataFrame, rule: Rule, path: str) -> None:
    """Full rows that break a rule, row id first."""
    rows = failing_rows(df, rule)
    rows.select(F.col(ROW_ID).alias("row_index"), *[c for c in df.columns if c != ROW_ID]).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_quarantine(quarantine: DataFrame, path: str) -> None:
    quarantine.write.mode("append").parquet(path)
