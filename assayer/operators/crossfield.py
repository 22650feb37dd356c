"""Rules across the columns of one row, and the two fixes for their failing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer import ROW_ID
from assayer.functions import text
from assayer.operators.rules import Rule, checked_expression, failing_rows
from assayer.schema import as_text, col, cols


def arithmetic(target: str, addends: list[str], tolerance: float = 0.01, **extra) -> Rule:
    return Rule("cross_arithmetic", columns=(target, *addends), dimension="Cross-field Validation", params={"tolerance": tolerance}, **extra)


def conditional_presence(target: str, context: str, values: list[str], **extra) -> Rule:
    return Rule("cross_presence", columns=(target, context), dimension="Cross-field Validation", params={"values": list(values)}, **extra)


def prefix_from_sibling(target: str, sibling: str, contains: bool = False, **extra) -> Rule:
    return Rule("cross_contains" if contains else "cross_starts_with", columns=(target, sibling), dimension="Cross-field Validation", **extra)


def composite_unique(*columns: str, **extra) -> Rule:
    return Rule("cross_composite_unique", columns=columns, dimension="Cross-field Validation", **extra)


def expression(sql: str, columns: list[str], **extra) -> Rule:
    return Rule("cross_expression", columns=tuple(columns), dimension="Cross-field Validation", params={"sql": sql}, **extra)


def failure(df: DataFrame, rule: Rule) -> Column | None:
    names = rule.columns
    shown = [as_text(df, n) for n in names]
    if rule.kind == "cross_arithmetic":
        target, *addends = [text.to_number(col(n)) for n in names]
        total = addends[0]
        for addend in addends[1:]:
            total = total + addend
        # A missing operand makes the difference null, and null is no failure.
        return F.coalesce(F.abs(target - total) > rule.params["tolerance"], F.lit(False))
    if rule.kind == "cross_presence":
        wanted = [str(v).strip().lower() for v in rule.params["values"]]
        in_scope = F.lower(text.strip(shown[1])).isin(wanted)
        return F.coalesce(in_scope, F.lit(False)) & text.blank(shown[0])
    if rule.kind in ("cross_starts_with", "cross_contains"):
        target, sibling = (F.upper(text.strip(s)) for s in shown[:2])
        holds = target.contains(sibling) if rule.kind == "cross_contains" else target.startswith(sibling)
        return ~text.blank(shown[0]) & ~text.blank(shown[1]) & ~F.coalesce(holds, F.lit(False))
    if rule.kind == "cross_expression":
        return F.coalesce(checked_expression(df, rule.params["sql"]), F.lit(False))
    return None


def arithmetic_applies(df: DataFrame, rule: Rule) -> bool:
    """False when one of the columns holds no number at all; such a rule is left to manual review."""
    row = df.agg(*[F.count(text.to_number(col(n))).alias(n) for n in rule.columns]).first()
    return all(row[n] > 0 for n in rule.columns)


def fix(df: DataFrame, rule: Rule, action: str, rejected_at: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, quarantine)`` after ``drop`` or ``deduplicate``.

    ``drop`` removes every failing row, all copies included. ``deduplicate`` keeps the first
    row of each tuple; a tuple with nulls equals another with the same nulls.
    """
    if action == "drop":
        leaving = failing_rows(df, rule)
    elif action == "deduplicate" and rule.kind == "cross_composite_unique":
        names = list(rule.columns)
        first = df.groupBy(*cols(names)).agg(F.min(ROW_ID).alias(ROW_ID)).select(ROW_ID)
        leaving = df.join(first, ROW_ID, "left_anti")
    else:
        raise ValueError(f"{action} does not apply to {rule.kind}")
    kept = df.join(leaving.select(ROW_ID), ROW_ID, "left_anti").select(*cols(df.columns))
    reason = f"Cross-field · {rule.describe()[:80]} — {action}"
    quarantine = leaving.select(*cols(df.columns)).withColumns({
        "Rejection_Reason": F.lit(reason), "Rejected_Column": F.lit(" + ".join(rule.columns)), "Rejected_At": F.lit(rejected_at),
    })
    return kept, quarantine
