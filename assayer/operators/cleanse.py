"""Cleansing: rules run in order on each row; a failing row leaves for the quarantine.

All rules of all columns fold into one projection. Each step reads the value the steps before
it produced, and the first failing step fixes the reason; later steps no longer change the row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer import ROW_ID
from assayer.functions import text
from assayer.schema import as_text, col, cols

STATE = "_failed"


@dataclass(frozen=True)
class Step:
    """One cleansing rule of one column. ``manual`` steps are kept for people and never run."""

    column: str
    mode: str                   # Clean, Replace, Extract, Validate, Case, Length, ManualReview
    pattern: str = ""
    replace: str = ""
    case: str = "UPPERCASE"
    length_mode: str = "Exact"
    min_length: int = 0
    max_length: int = 50
    exact_length: int = 10
    name: str = ""
    dimension: str = ""
    enabled: bool = True

    @property
    def label(self) -> str:
        return self.name or f"{self.mode} {self.column}"


REASONS = {"Extract": "No matches", "Validate": "Does not match", "Length": "Length check failed"}


def transformed(step: Step, value: Column) -> Column:
    """New value of a transforming step, the value itself for checks."""
    if step.mode == "Clean" and step.pattern:
        return F.regexp_replace(value, F.lit(text.java_pattern(step.pattern)), F.lit(""))
    if step.mode == "Replace" and step.pattern:
        return F.regexp_replace(value, F.lit(text.java_pattern(step.pattern)), F.lit(text.java_replacement(step.replace)))
    if step.mode == "Extract" and step.pattern:
        found = F.regexp_extract_all(value, F.lit(text.java_pattern(step.pattern)), F.lit(_group(step.pattern)))
        return F.coalesce(F.array_join(found, ""), F.lit(""))
    if step.mode == "Case":
        return {"UPPERCASE": F.upper, "lowercase": F.lower, "Title Case": text.title_case}[step.case](value)
    return value


def _group(pattern: str) -> int:
    """Find-all returns the group when the pattern has exactly one, else the whole match."""
    import re

    return 1 if re.compile(pattern).groups == 1 else 0


def rejected(step: Step, value: Column, result: Column) -> Column:
    """True where the step rejects the row. ``value`` is before and ``result`` after the step."""
    if step.mode == "Extract":
        return F.coalesce(result, F.lit("")) == ""
    if step.mode == "Validate" and step.pattern:
        return ~F.coalesce(text.matches(value, step.pattern), F.lit(False))
    if step.mode == "Length":
        length = F.char_length(value)
        checks = {
            # A missing length differs from every exact length but is neither too short nor too long.
            "Exact": ~F.coalesce(length == step.exact_length, F.lit(False)),
            "Minimum": F.coalesce(length < step.min_length, F.lit(False)),
            "Maximum": F.coalesce(length > step.max_length, F.lit(False)),
            "Range": F.coalesce(~length.between(step.min_length, step.max_length), F.lit(False)),
        }
        return checks.get(step.length_mode, F.lit(False))
    return F.lit(False)


def runnable(steps: list[Step], column: str | None = None, dimension: str | None = None) -> list[Step]:
    """Enabled automatic steps, optionally of one column or one dimension, in order by column."""
    chosen = [s for s in steps if s.enabled and s.mode != "ManualReview"
              and (column is None or s.column == column) and (dimension is None or s.dimension == dimension)]
    order = list(dict.fromkeys(s.column for s in chosen))
    return sorted(chosen, key=lambda s: order.index(s.column))


def folded(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Rows after all steps, plus ``_failed`` = struct(reason, column), null when the row passes."""
    state = df.withColumn(STATE, F.lit(None).cast("struct<reason:string,column:string>"))
    strings: set[str] = set()
    for step in runnable(steps):
        if step.column not in df.columns:
            continue
        data_type = T.StringType() if step.column in strings else df.schema[step.column].dataType
        value = text.stringify(col(step.column), data_type)
        result = transformed(step, value)
        changes = step.mode in ("Clean", "Replace", "Extract", "Case")
        new_columns = {}
        if changes:
            # Rows that already failed keep the value they failed with.
            new_columns[step.column] = F.when(F.col(STATE).isNull(), result).otherwise(value)
            strings.add(step.column)
        if step.mode in REASONS:
            verdict = F.struct(F.lit(f"{step.label} - {REASONS[step.mode]}").alias("reason"), F.lit(step.column).alias("column"))
            fails = rejected(step, value, result)
            new_columns[STATE] = F.when(F.col(STATE).isNotNull(), F.col(STATE)).when(fails, verdict)
        if new_columns:
            state = state.withColumns(new_columns)
    return state


def apply(df: DataFrame, steps: list[Step], rejected_at: str, **only) -> tuple[DataFrame, DataFrame]:
    """``(clean, quarantine)``; the two parts together hold every input row once."""
    state = folded(df, runnable(steps, **only))
    clean = state.where(F.col(STATE).isNull()).drop(STATE)
    quarantine = state.where(F.col(STATE).isNotNull()).select(
        *cols(df.columns), F.col(f"{STATE}.reason").alias("Rejection_Reason"),
        F.col(f"{STATE}.column").alias("Rejected_Column"), F.lit(rejected_at).alias("Rejected_At"),
    )
    return clean, quarantine


def summary(df: DataFrame, steps: list[Step]) -> DataFrame:
    """Rejected rows per column and reason."""
    return folded(df, steps).where(F.col(STATE).isNotNull()).groupBy(
        F.col(f"{STATE}.column").alias("column"), F.col(f"{STATE}.reason").alias("reason")).agg(F.count(F.lit(1)).alias("rejected"))


def _outcome(df: DataFrame, step: Step) -> tuple[Column, Column, Column]:
    before = text.stringify(col(step.column), df.schema[step.column].dataType)
    result = transformed(step, before)
    return before, result, rejected(step, before, result)


def preview(df: DataFrame, step: Step, k: int = 10) -> DataFrame:
    """Before, after and status of the first ``k`` non-null values."""
    before, result, fails = _outcome(df, step)
    return df.where(col(step.column).isNotNull()).orderBy(ROW_ID).limit(k).select(
        ROW_ID, before.alias("before"), F.when(fails, "[REJECT]").otherwise(result).alias("after"),
        F.when(fails, "Rejected").otherwise("Valid").alias("status"),
    )


def preview_failing(df: DataFrame, step: Step, limit: int = 20) -> DataFrame:
    """Full rows the step would reject, or a sample of changed rows for a transforming step."""
    before, result, fails = _outcome(df, step)
    if step.mode in REASONS:
        chosen, after, status = df.where(fails), F.lit("[REJECT]"), "Rejected"
    else:
        chosen, after, status = df.where(col(step.column).isNotNull()), result, "Transform"
    shown = [F.coalesce(as_text(df, c), F.lit("")).alias(c) if c != ROW_ID else col(c) for c in df.columns]
    return chosen.orderBy(ROW_ID).limit(limit).select(
        *shown, before.alias("_before"), after.alias("_after"), F.lit(status).alias("_status"))


def count_failing(df: DataFrame, step: Step) -> DataFrame:
    _, _, fails = _outcome(df, step)
    return df.agg(F.count_if(fails).alias("total_failing"), F.count(F.lit(1)).alias("total_rows"))
