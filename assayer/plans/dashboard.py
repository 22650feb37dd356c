"""Dashboards composed from the profile and the scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer.functions import bands, text
from assayer.functions.formats import CASE_TYPES, IDENTIFIER_TYPES, Glossary
from assayer.operators.rules import Rule
from assayer.operators.digests import repetition
from assayer.operators.values import distinct_counts, duplicate_value_text, repeated_value_groups
from assayer.plans.scorecard import dimension_scores, field_counts, overall
from assayer.schema import col, comparable, quoted

# Dimension names, their legacy spellings, and their order.
LEGACY_NAMES = {"Consistency": "Standardisation", "Validity": "Validation"}
DIMENSION_ORDER = ["Completeness", "Validation", "Uniqueness", "Standardisation", "Accuracy", "Timeliness", "Cross-field Validation"]


def summary(profiled: DataFrame, duplicate_rows: int) -> DataFrame:
    """One row of headline counts."""
    cells = F.sum("total_rows")
    return profiled.agg(
        F.max("total_rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.sum("null_count").alias("missing_cells"),
        F.round(F.when(cells > 0, F.sum("null_count") / cells * 100).otherwise(0.0), 2).alias("missing_percentage"),
        F.lit(duplicate_rows).cast("bigint").alias("duplicate_rows"),
        *[F.count_if(F.col("risk_level") == level).alias(f"{level.lower()}_risk") for level in ("Low", "Medium", "High")])


def extra_copies(df: DataFrame) -> int:
    """Rows beyond the first of every distinct full row."""
    return repetition(df, [(comparable(df), "none")]).select((F.col("total") - F.col("distinct_rows")).alias("n")).first()["n"]


def type_distribution(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("dtype").agg(F.count(F.lit(1)).alias("columns"))


def top_null_columns(profiled: DataFrame, k: int = 10) -> DataFrame:
    return profiled.where("null_percentage > 0").select("column", F.round("null_percentage", 1).alias("null_pct")).orderBy(F.col("null_pct").desc(), "column").limit(k)


def risk_counts(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("risk_level").agg(F.count(F.lit(1)).alias("columns"))


def top_issues(profiled: DataFrame, missing_percentage: float, duplicate_rows: int, total_rows: int, k: int = 8) -> DataFrame:
    """``(severity, message)``: table findings first, then column findings, most severe first."""
    spark = profiled.sparkSession
    table = []
    if missing_percentage > 5:
        level, label = ("critical", "High missing data rate") if missing_percentage > 20 else ("warning", "Missing data")
        table.append((level, f"{label}: {missing_percentage}% of cells are empty", -2))
    if duplicate_rows > 0:
        share = round(duplicate_rows / max(total_rows, 1) * 100, 1)
        table.append(("critical" if share > 10 else "warning", f"{duplicate_rows:,} duplicate rows ({share}%)", -1))
    of_table = spark.createDataFrame(table, "severity string, message string, place int")
    entry = lambda level, message: F.struct(F.lit(level).alias("severity"), message.alias("message"))
    quoted = lambda *parts: F.concat(F.lit("Column '"), F.col("column"), *parts)
    own = F.array_compact(F.array(
        F.when(F.col("risk_level") == "High", entry("critical", quoted(F.lit("' has HIGH risk (score "), F.col("risk_score").cast("string"), F.lit(")")))),
        F.when(F.col("null_percentage") > 50, entry("warning", quoted(F.lit("' is more than 50% null")))),
    ))
    findings = F.transform("violations", lambda v: entry("info", F.concat(F.lit("'"), F.col("column"), F.lit("': "), v)))
    of_columns = profiled.select("position", F.explode(F.concat(own, findings)).alias("e")).select("e.severity", "e.message", F.col("position").alias("place"))
    severity = F.when(F.col("severity") == "critical", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return of_table.unionByName(of_columns).orderBy(severity, "place", "message").limit(k).select("severity", "message")


def _uniqueness_share() -> Column:
    pct = F.col("distinct_percentage")
    return F.when(pct < 100, F.least(F.lit(100.0), pct * 1.2)).otherwise(90.0)


def kpi(profiled: DataFrame) -> DataFrame:
    """One row: table size, completeness and the mean weighted quality of the columns."""
    quality = (
        F.col("non_null_percentage") * 0.4 + _uniqueness_share() * 0.3 + F.when(F.col("consistent_case"), 100.0).otherwise(80.0) * 0.2
        + (100 - F.least(F.lit(20.0), F.coalesce("symbol_kinds", F.lit(0)) * 2.0)) * 0.1
    )
    fill = F.round((F.sum("total_rows") - F.sum("null_count")) / F.sum("total_rows") * 100, 2)
    return profiled.agg(
        F.max("total_rows").alias("rows"), F.count(F.lit(1)).alias("columns"), F.round(F.avg(quality), 1).alias("quality_pct"),
        fill.alias("completeness_pct"), F.sum("null_count").alias("missing_cells"))


def gauges(profiled: DataFrame) -> DataFrame:
    quality = (100 - F.col("null_percentage")) * 0.5 + _uniqueness_share() * 0.3 + (100 - F.col("risk_score")) * 0.2
    return profiled.agg(
        F.round(F.avg(quality), 1).alias("quality_gauge"),
        F.round(F.count_if(F.col("duplicate_count") > 0) / F.greatest(F.count(F.lit(1)), F.lit(1)) * 100, 1).alias("duplicate_risk_gauge"),
        F.avg("min_length").alias("mean_min_length"), F.avg("avg_length").alias("mean_avg_length"), F.avg("max_length").alias("mean_max_length"))


def type_buckets(profiled: DataFrame) -> DataFrame:
    kind = F.when(F.col("family") == "numeric", "Numeric").when(F.col("family") == "temporal", "DateTime").when(F.col("family") == "text", "Text").otherwise("Other")
    return profiled.groupBy(kind.alias("bucket")).agg(F.count(F.lit(1)).alias("columns"))


def most_distinct(profiled: DataFrame, k: int = 15) -> DataFrame:
    return profiled.select("column", "distinct_count", "duplicate_count").orderBy(F.col("distinct_count").desc(), "position").limit(k)


def profile_table(df: DataFrame, profiled: DataFrame) -> DataFrame:
    """Profile rows with the text of repeated values."""
    told = duplicate_value_text(df)
    return profiled.select("position", "column", "dtype", "total_rows", "non_null_count", "null_count", "null_percentage", "distinct_count", "duplicate_count",
                           "distinct_percentage", "min_length", "max_length", "avg_length", "risk_level", "risk_score").join(told, "column", "left")


def column_cards(df: DataFrame, profiled: DataFrame, total_rows: int, k: int = 10) -> DataFrame:
    """Profile table with the top repeated values of each column as an array."""
    groups = repeated_value_groups(df, comparable(df), total_rows, k).groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value", "rows", "percentage", "row_ids"))).alias("groups"))
    return profile_table(df, profiled).join(groups, "column", "left")


# Per-field quality

def field_scores(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Scores of the dimensions that apply to each field and their mean, worst first."""
    fields = field_counts(df, glossary)
    ids = [c for c in comparable(df) if glossary.semantic_type(c) in IDENTIFIER_TYPES]
    total, filled = F.col("total"), F.col("filled")
    if ids:
        fields = fields.join(F.broadcast(distinct_counts(df, ids)), "column", "left")
    else:
        fields = fields.withColumn("distinct_count", F.lit(None).cast("bigint"))
    some = lambda condition, value: F.when(condition & (filled > 0), value)
    mixed = filled - F.col("all_upper") - F.col("all_lower")
    scores = {
        "completeness": F.when(total > 0, filled / total).otherwise(0.0),
        "validation": some(F.col("has_pattern"), F.col("valid") / filled),
        "uniqueness": some(F.col("distinct_count").isNotNull(), F.col("distinct_count") / filled),
        "standardisation": some(F.col("semantic_type").isin(CASE_TYPES), F.greatest("all_upper", "all_lower", mixed) / filled),
    }
    scored = fields.withColumns(scores)
    present = F.array_compact(F.array(*scores))
    mean = F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x) / F.size(present)
    invalid = F.coalesce(F.col("checked") - F.col("valid"), F.lit(0))
    return scored.withColumn("mean", mean).select(
        "column", "semantic_type", "is_cde", *[F.round(s, 4).alias(s) for s in scores], F.round("mean", 4).alias("overall_score"),
        F.greatest(total - filled, invalid).cast("bigint").alias("non_compliant"), bands.threshold(F.col("mean")).alias("threshold"),
    ).orderBy("overall_score", "column")


def threshold_distribution(fields: DataFrame) -> DataFrame:
    return fields.groupBy("threshold").agg(F.count(F.lit(1)).alias("fields"))


def semantic_distribution(fields: DataFrame) -> DataFrame:
    return fields.groupBy(F.coalesce("semantic_type", F.lit("other")).alias("semantic_type")).agg(F.count(F.lit(1)).alias("fields"))


def dimension_buckets(fields: DataFrame, scores: DataFrame) -> DataFrame:
    """``(dimension, applicable_fields, high, medium, low)``: four dimensions by field, two by table."""
    named = fields.select(*[F.col(d.lower()).alias(d) for d in DIMENSION_ORDER[:4]])
    by_field = named.unpivot([], DIMENSION_ORDER[:4], "dimension", "score")
    by_table = scores.where(F.col("dimension").isin("Accuracy", "Timeliness")).select("dimension", F.when(F.col("enabled"), F.col("score")).alias("score"))
    level = bands.threshold(F.col("score"))
    count = lambda name: F.count_if(F.col("score").isNotNull() & (level == name)).alias(name.lower())
    return by_field.unionByName(by_table).groupBy("dimension").agg(F.count("score").alias("applicable_fields"), count("High"), count("Medium"), count("Low"))


def rules_by_dimension(rules: DataFrame) -> DataFrame:
    """``(dimension, rule_count)`` with legacy names folded, in canonical order."""
    canonical = F.coalesce(*[F.when(F.col("dimension") == old, new) for old, new in LEGACY_NAMES.items()], F.col("dimension"))
    order = F.array_position(F.array(*[F.lit(d) for d in DIMENSION_ORDER]), F.col("dimension"))
    counted = rules.groupBy(canonical.alias("dimension")).agg(F.count(F.lit(1)).alias("rule_count"))
    return counted.orderBy(F.when(order == 0, 99).otherwise(order), "dimension")


def quality_dashboard(current: DataFrame, original: DataFrame, glossary: Glossary, as_of: Column, cross_rules: list[Rule] | None = None) -> DataFrame:
    """Dimension scores of both versions side by side, with the overall score as a seventh row."""
    def scored(df: DataFrame, name: str) -> DataFrame:
        scores = dimension_scores(df, glossary, as_of, cross_rules)
        total = overall(scores).select(F.lit("Overall").alias("dimension"), F.col("overall_score").alias("score"))
        return scores.where("enabled").select("dimension", "score").unionByName(total).withColumnRenamed("score", name)

    both = scored(original, "original_score").join(scored(current, "current_score"), "dimension", "full_outer")
    return both.withColumn("change", F.round(F.col("current_score") - F.col("original_score"), 3))


def field_scorecard(df: DataFrame) -> DataFrame:
    """``(column, filled, fill_pct, distinct_count, distinct_pct)``."""
    names = comparable(df)
    counted = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(col(c)).alias("filled"), F.count(F.lit(1)).alias("total")).alias(f"c{i}") for i, c in enumerate(names)])
    rows = counted.select(F.inline(F.array(*[col(f"c{i}") for i in range(len(names))])))
    share = lambda n: F.round(F.when(F.col("total") > 0, col(n) / F.col("total")).otherwise(0.0), 4)
    return rows.join(F.broadcast(distinct_counts(df, names)), "column").select("column", "filled", share("filled").alias("fill_pct"), "distinct_count", share("distinct_count").alias("distinct_pct"))
