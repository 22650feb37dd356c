"""Lifecycle status of every rule, and totals by dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from assayer.functions import text
from assayer.operators.rules import Rule, evaluate
from assayer.plans.dashboard import DIMENSION_ORDER
from assayer.schema import as_text, col, comparable

STATUSES = ["actionable", "passed", "applied", "unmapped", "blocked_empty", "blocked_incomplete", "multi_cde", "invalid"]
SPARSE_BELOW = 0.20
CHECKS = ("pattern", "max_length", "reasonable_length")


def column_health(df: DataFrame) -> DataFrame:
    """``(column, non_empty, fill_rate)`` where blank text counts as empty; one scan."""
    names = comparable(df)
    row = df.agg(*[F.struct(F.lit(c).alias("column"), F.count_if(~text.blank(as_text(df, c))).alias("non_empty"), F.count(F.lit(1)).alias("total")).alias(f"c{i}") for i, c in enumerate(names)])
    rows = row.select(F.inline(F.array(*[col(f"c{i}") for i in range(len(names))])))
    return rows.select("column", "non_empty", F.when(F.col("total") > 0, F.col("non_empty") / F.col("total")).otherwise(0.0).alias("fill_rate"))


def statuses(df: DataFrame, rules: list[Rule], applied: DataFrame | None = None) -> DataFrame:
    """One terminal status per rule: ``(rule_id, column, dimension, status, issues, suggested_action)``.

    A rule of kind ``manual`` has no mechanical check. ``applied`` lists ``(column, kind,
    pattern)`` of rules already executed. Only rules that nothing blocks are evaluated, all in
    one scan.
    """
    spark = df.sparkSession
    known = set(comparable(df))
    health = {r["column"]: r["fill_rate"] for r in column_health(df).collect()}
    done = {(r["column"], r["kind"], r["pattern"]) for r in applied.collect()} if applied is not None else set()
    fixed, open_rules = [], []
    for rule in rules:
        status = _blocked(rule, known, health, done)
        if status:
            fixed.append((rule.rule_id, rule.column or ",".join(rule.columns), rule.dimension, status, 0, None))
        else:
            open_rules.append(rule)
    schema = "rule_id int, column string, dimension string, status string, issues bigint, suggested_action string"
    settled = spark.createDataFrame(fixed, schema)
    if not open_rules:
        return settled
    rejects = [r.rule_id for r in open_rules if r.kind in CHECKS]
    failing = F.col("issues") > 0
    evaluated = evaluate(df, open_rules).select(
        "rule_id", "column", "dimension", F.when(failing, "actionable").otherwise("passed").alias("status"), "issues",
        F.when(failing, F.when(F.col("rule_id").isin(rejects), "Reject row").otherwise("Fix value")).alias("suggested_action"))
    return evaluated.unionByName(settled)


def _blocked(rule: Rule, known: set[str], health: dict[str, float], done: set) -> str | None:
    first = rule.columns[0] if rule.columns else rule.column
    if first not in known:
        return "invalid"
    if len(rule.columns) > 1:
        return "multi_cde"
    fill = health[first]
    if fill == 0 and rule.dimension != "Completeness":
        return "blocked_empty"
    if rule.dimension not in ("Completeness", "Uniqueness") and 0 < fill < SPARSE_BELOW:
        return "blocked_incomplete"
    if rule.kind == "manual":
        return "unmapped"
    if (first, rule.kind, rule.params.get("pattern", "")) in done:
        return "applied"
    return None


def by_dimension(status_rows: DataFrame) -> DataFrame:
    """Counts of every status and failing rows per dimension, in the usual order."""
    counted = status_rows.groupBy("dimension").pivot("status", STATUSES).agg(F.count(F.lit(1)))
    failing = status_rows.groupBy("dimension").agg(
        F.count(F.lit(1)).alias("generated"), F.sum(F.when(F.col("status") == "actionable", F.col("issues")).otherwise(0)).alias("failing_rows"))
    order = F.array_position(F.array(*[F.lit(d) for d in DIMENSION_ORDER]), F.col("dimension"))
    return failing.join(counted.na.fill(0), "dimension").orderBy(F.when(order == 0, 99).otherwise(order), "dimension")
