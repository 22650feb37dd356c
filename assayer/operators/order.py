"""Places and running totals over a whole table, without a window over it.

Rows are range-partitioned and sorted inside their tasks. The tasks' totals are a table of one
row per task; its prefix sums, added to what a row counts inside its task, give the place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.schema import cols
from assayer.session import cut

TASK_BITS = 33              # of monotonically increasing ids: below them stands the row, above them the task


def lined_up(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """``df`` as a sorted table with ``_line``: the task's number and the row's place in it."""
    by = [o if isinstance(o, Column) else cols([o])[0] for o in order]
    return cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_line", F.monotonically_increasing_id()))


def _task() -> Column:
    return F.shiftright("_line", TASK_BITS)


def _before(per_task: DataFrame, names: list[str]) -> DataFrame:
    """Prefix sums of the tasks' totals: a row per task, so it is bounded by the number of partitions."""
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return per_task.select("_task", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in names])


def numbered(df: DataFrame, order: list[str | Column], place: str) -> DataFrame:
    """``df`` with its 0-based ``place`` by ``order``, sorted inside its partitions; rows that tie get places in any order."""
    lined = lined_up(df, order).withColumn("_task", _task())
    starts = _before(lined.groupBy("_task").agg(F.count(F.lit(1)).alias("rows")), ["rows"])
    inside = F.col("_line").bitwiseAND((1 << TASK_BITS) - 1)
    return lined.join(F.broadcast(starts), "_task").withColumn(place, F.col("_before_rows") + inside).drop("_task", "_line", "_before_rows")


def running_totals(df: DataFrame, order: list[str], weights: list[str]) -> DataFrame:
    """``df`` with ``less_<weight>`` per weight: its sum over all rows before, by ``order``, which must tell rows apart."""
    lined = lined_up(df, order).withColumn("_task", _task())
    starts = _before(lined.groupBy("_task").agg(*[F.sum(w).alias(w) for w in weights]), weights)
    earlier = Window.partitionBy("_task").orderBy("_line").rowsBetween(Window.unboundedPreceding, -1)
    upto = lined.select("*", *[F.coalesce(F.sum(w).over(earlier), F.lit(0)).alias(f"_in_{w}") for w in weights])
    joined = upto.join(F.broadcast(starts), "_task")
    return joined.select(*cols(df.columns), *[(F.col(f"_before_{w}") + F.col(f"_in_{w}")).alias(f"less_{w}") for w in weights])
