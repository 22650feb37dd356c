"""Row-local cleansing and quality counts on Structured Streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.operators.cleanse import STATE, Step, folded
from assayer.operators.rules import Rule, row_failure
from assayer.schema import cols


def cleanse_stream(stream: DataFrame, steps: list[Step], clean_path: str, quarantine_path: str, checkpoint: str) -> StreamingQuery:
    """Split a stream into clean and quarantined rows; every micro-batch is written exactly once
    per epoch folder, so a replayed epoch replaces its own files."""
    columns = stream.columns
    state = folded(stream, steps)

    def split(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        try:
            batch.where(F.col(STATE).isNull()).drop(STATE).write.mode("overwrite").parquet(f"{clean_path}/epoch={epoch}")
            bad = batch.where(F.col(STATE).isNotNull()).select(
                *cols(columns), F.col(f"{STATE}.reason").alias("Rejection_Reason"), F.col(f"{STATE}.column").alias("Rejected_Column"),
                F.current_timestamp().cast("string").alias("Rejected_At"))
            bad.write.mode("overwrite").parquet(f"{quarantine_path}/epoch={epoch}")
        finally:
            batch.unpersist()

    return state.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_issues(events: DataFrame, time_column: str, rules: list[Rule], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Failing rows per rule in tumbling windows; works on a stream and on a table."""
    timed = events.withWatermark(time_column, late) if events.isStreaming else events
    flags = {f"rule_{r.rule_id}": row_failure(events, r) for r in rules}
    counted = timed.groupBy(F.window(time_column, width)).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(c).alias(n) for n, c in flags.items()])
    return counted.select(F.col("window.start").alias("window_start"), "rows", *flags)
