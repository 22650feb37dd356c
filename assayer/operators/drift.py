"""Drift of a table against a saved baseline of column statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.operators.profile import percent
from assayer.operators.quantiles import COLUMNS_PER_PASS, exact_quantiles, sketches
from assayer.operators.values import distinct_counts
from assayer.schema import NUMERIC, col, comparable, families
from assayer.session import cut

DISTINCT_SKETCH = 14        # log2 of the buckets of a sketch of distinct values


def baseline(df: DataFrame, columns: list[str] | None = None, mergeable: bool = False) -> DataFrame:
    """``(column, null_percentage, distinct_percentage, distinct_count, mean, std, min, max, median, row_count)``.

    A ``mergeable`` baseline also keeps the state of its sketches, ``quantiles`` and ``values``, so
    that ``merge`` can put the baselines of partitions or days together without their rows.
    """
    names = comparable(df, columns)
    numeric = [c for c in names if families(df)[c] == NUMERIC]
    state = cut(sketches(df, numeric)) if numeric else sketches(df, numeric)
    medians = {c: q[0] for c, q in exact_quantiles(df, numeric, [0.5], state).items()}
    rows = None
    for part in (names[at:at + COLUMNS_PER_PASS] for at in range(0, len(names), COLUMNS_PER_PASS)):
        fields = []
        for i, c in enumerate(part):
            number = col(c).cast("double") if c in numeric else F.lit(None).cast("double")
            distinct = F.hll_sketch_agg(F.xxhash64(col(c)) if c not in numeric else F.xxhash64(number), DISTINCT_SKETCH) if mergeable else F.lit(None).cast("binary")
            fields.append(F.struct(
                F.lit(c).alias("column"), F.count(F.lit(1)).alias("row_count"), F.count_if(col(c).isNull()).alias("null_count"),
                F.avg(number).alias("mean"), F.stddev_samp(number).alias("std"), F.min(number).alias("min"), F.max(number).alias("max"),
                F.lit(medians.get(c)).cast("double").alias("median"), distinct.alias("values"),
            ).alias(f"c{i}"))
        one = df.agg(*fields).select(F.inline(F.array(*[col(f"c{i}") for i in range(len(part))])))
        rows = one if rows is None else rows.unionByName(one)
    shown = ["distinct_count", "mean", "std", "min", "max", "median", "row_count"]
    joined = rows.join(F.broadcast(distinct_counts(df, names)), "column").join(F.broadcast(state.select("column", F.col("sketch").alias("quantiles"))), "column", "left")
    return joined.select(
        "column", percent(F.col("null_count"), F.col("row_count")).alias("null_percentage"),
        percent(F.col("distinct_count"), F.col("row_count")).alias("distinct_percentage"), *shown, *(["null_count", "quantiles", "values"] if mergeable else []))


def merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """The mergeable baseline of the rows of two mergeable baselines.

    Counts, means, deviations and ranges are those of all rows. Distinct values and medians come
    from the merged sketches, within about 1 % and 0.3 % of the rank; ``exact_quantiles`` with the
    merged state reads exact ones from the rows. A column of one side only keeps that side's.
    """
    both = first.withColumn("_n", _filled()).unionByName(second.withColumn("_n", _filled()))
    mean = F.sum(F.col("mean") * F.col("_n")) / F.sum(F.when(F.col("mean").isNotNull(), F.col("_n")))
    made = both.groupBy("column").agg(
        F.sum("row_count").alias("row_count"), F.sum("null_count").alias("null_count"), mean.alias("mean"),
        F.sum(F.coalesce("std", F.lit(0.0)) ** 2 * (F.col("_n") - 1)).alias("_inside"), F.collect_list(F.struct("mean", "_n")).alias("_parts"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("values").alias("values"), F.count("quantiles").alias("_sketched"))
    apart = F.aggregate("_parts", F.lit(0.0), lambda sofar, part: sofar + F.coalesce(part["_n"] * (part["mean"] - F.col("mean")) ** 2, F.lit(0.0)))
    filled = F.col("row_count") - F.col("null_count")
    distinct = F.least(F.hll_sketch_estimate("values"), filled)
    return made.withColumn("quantiles", F.when(F.col("_sketched") > 0, F.col("quantiles"))).withColumn("distinct_count", distinct).select(
        "column", percent(F.col("null_count"), F.col("row_count")).alias("null_percentage"), percent(F.col("distinct_count"), F.col("row_count")).alias("distinct_percentage"),
        "distinct_count", "mean", F.when(F.col("mean").isNotNull() & (filled > 1), F.sqrt((F.col("_inside") + apart) / (filled - 1))).alias("std"), "min", "max",
        F.when(F.col("quantiles").isNotNull(), F.kll_sketch_get_quantile_double("quantiles", F.lit(0.5))).alias("median"), "row_count", "null_count", "quantiles", "values")


def _filled():
    return F.when(F.col("mean").isNotNull(), F.col("row_count") - F.col("null_count")).otherwise(F.lit(0))


def detect(current: DataFrame, saved: DataFrame, null_threshold: float = 5.0, distinct_threshold: float = 10.0, sigmas: float = 2.0) -> DataFrame:
    """Alerts ``(column, type, baseline, current)`` between two statistics tables (one row per column)."""
    renamed = saved.select("column", *[col(c).alias(f"base_{c}") for c in ("null_percentage", "distinct_percentage", "mean", "std")], F.lit(True).alias("base_in"))
    joined = current.withColumn("now_in", F.lit(True)).join(renamed, "column", "full_outer")
    both = F.col("base_in") & F.col("now_in")
    alert = lambda condition, kind, old, new: F.when(condition, F.struct(
        F.lit(kind).alias("type"), old.cast("double").alias("baseline"), new.cast("double").alias("current")))
    moved = lambda c, limit: both & (F.abs(col(c) - col(f"base_{c}")) > limit)
    none = F.lit(None)
    alerts = F.array_compact(F.array(
        alert(F.col("base_in").isNull(), "new_column", none, none),
        alert(moved("null_percentage", null_threshold), "null_rate", F.col("base_null_percentage"), F.col("null_percentage")),
        alert(moved("distinct_percentage", distinct_threshold), "cardinality", F.col("base_distinct_percentage"), F.col("distinct_percentage")),
        alert(moved("mean", sigmas * F.col("base_std")) & (F.col("base_std") > 0), "mean_shift", F.col("base_mean"), F.col("mean")),
        alert(F.col("now_in").isNull(), "missing_column", none, none),
    ))
    return joined.select("column", F.explode(alerts).alias("a")).select("column", "a.type", "a.baseline", "a.current")
