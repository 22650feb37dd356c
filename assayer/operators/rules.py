"""Typed rules. A row-local rule is one boolean column; all of a table's rules share one scan."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from assayer import ROW_ID
from assayer.functions import text
from assayer.operators.skew import group_sizes, members_of_repeated
from assayer.operators.values import union_all
from assayer.schema import as_text, col, data_columns, quoted

NO_ISSUES = "no issues"
ALNUM_WORDS = r"^[A-Za-z0-9\s]+$"
NO_SPECIAL = r"^[A-Za-z0-9\s\-_.]+$"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
RULES_PER_PASS = 60


@dataclass(frozen=True)
class Rule:
    """``kind`` names the check, ``params`` its arguments; several columns make it a multi-column rule."""

    kind: str
    column: str = ""
    dimension: str = "Validation"
    columns: tuple[str, ...] = ()
    params: dict[str, Any] = field(default_factory=dict, hash=False)
    source: str = "user"
    statement: str = ""
    rule_id: int = 0

    def describe(self) -> str:
        return self.statement or f"{self.kind}({', '.join(self.columns or (self.column,))})"


def _filled_text(df: DataFrame, column: str) -> Column:
    """Trimmed text of non-blank values, null otherwise."""
    shown = text.strip(as_text(df, column))
    return F.when(shown != "", shown)


def _when_filled(value: Column, fails: Column) -> Column:
    return F.coalesce(value.isNotNull() & fails, F.lit(False))


def row_failure(df: DataFrame, rule: Rule) -> Column | None:
    """Boolean column, true where the row breaks the rule; null for rules about whole columns."""
    kind, p = rule.kind, rule.params
    if rule.columns:
        return _multi_column(df, rule)
    c = col(rule.column)
    data_type = df.schema[rule.column].dataType
    shown = as_text(df, rule.column)
    filled = _filled_text(df, rule.column)
    number = text.to_number(c)
    if kind in ("not_blank", "valid_string"):
        return text.blank(shown)
    if kind == "not_null":
        return c.isNull()
    if kind == "allowed_values":
        allowed = [str(v).strip().lower() for v in p["values"]]
        return _when_filled(c, ~F.lower(text.strip(shown)).isin(allowed))
    if kind == "max_decimals":
        return _when_filled(number, text.decimals(number) > p["digits"])
    if kind == "numeric":
        return c.isNotNull() & number.isNull()
    if kind in ("max_length", "reasonable_length"):
        return _when_filled(c, F.char_length(shown) > p.get("length", 255))
    if kind == "uppercase":
        return _when_filled(filled, filled != F.upper(filled))
    if kind == "lowercase":
        return _when_filled(filled, filled != F.lower(filled))
    if kind == "alphanumeric":
        return _when_filled(filled, ~filled.rlike(ALNUM_WORDS))
    if kind == "no_special":
        return _when_filled(filled, ~filled.rlike(NO_SPECIAL))
    if kind == "range":
        return _when_filled(number, ~number.between(p["low"], p["high"]))
    if kind == "valid_date":
        return c.isNotNull() & text.to_time(c, data_type, p.get("formats")).isNull()
    if kind == "not_future":
        return F.coalesce(text.to_time(c, data_type, p.get("formats")) > F.to_timestamp(F.lit(p["as_of"])), F.lit(False))
    if kind == "not_negative":
        return _when_filled(number, number < 0)
    # The strict format checks also fail on a missing value.
    strict = {"digits_only": r"^\d+$", "email": EMAIL, "alnum_strict": "^[a-zA-Z0-9]+$"}
    if kind in strict:
        return ~F.coalesce(shown.rlike(strict[kind]), F.lit(False))
    if kind == "pattern":
        value = text.stringify(c, data_type)
        return c.isNotNull() & (text.strip(value) != "") & ~text.matches(value, p["pattern"])
    if kind == "transform":
        return c.isNotNull()
    if kind == "expression":
        return F.coalesce(checked_expression(df, p["sql"]), F.lit(False))
    return None


def checked_expression(df: DataFrame, sql: str) -> Column:
    """A user's failing-row condition: one boolean SQL expression over the row's own columns."""
    if re.search(r"\bselect\b", sql, re.IGNORECASE):
        raise ValueError("a rule expression may not hold a subquery")
    condition = F.expr(sql)
    kind = df.select(condition.alias("f")).schema["f"].dataType
    if not isinstance(kind, T.BooleanType):
        raise ValueError(f"a rule expression must be boolean, not {kind.simpleString()}")
    return condition


def _multi_column(df: DataFrame, rule: Rule) -> Column | None:
    names, every = rule.columns, rule.params.get("operator", "AND") == "AND"
    combine = lambda parts: _fold(parts, (lambda a, b: a | b) if every else (lambda a, b: a & b))
    if rule.kind in ("multi_complete", "multi_present"):
        return combine([col(n).isNull() for n in names])
    if rule.kind == "multi_pattern":
        return combine([~text.matches(F.coalesce(as_text(df, n), F.lit("")), rule.params["pattern"]) for n in names])
    if rule.kind.startswith("cross_"):
        from assayer.operators.crossfield import failure

        return failure(df, rule)
    return None


def _fold(parts, step):
    out = parts[0]
    for part in parts[1:]:
        out = step(out, part)
    return out


def group_count(df: DataFrame, rule: Rule) -> DataFrame | None:
    """One row ``issues`` for rules that compare a value with the rest of its column."""
    if rule.kind in ("unique", "unique_incl_null"):
        kept = df.where(col(rule.column).isNotNull()) if rule.kind == "unique" else df
        return _rows_in_groups(group_sizes(kept, [rule.column]))
    if rule.kind == "consistent_casing":
        value = text.strip(as_text(df, rule.column))
        spellings = df.where(col(rule.column).isNotNull()).select(value.alias("v")).distinct()
        return _rows_in_groups(spellings.groupBy(F.lower("v").alias("k")).agg(F.count(F.lit(1)).alias("rows")))
    if rule.kind == "format_mask_consistent":
        masked = df.where(col(rule.column).isNotNull()).groupBy(text.mask(text.strip(as_text(df, rule.column))).alias("m")).agg(F.count(F.lit(1)).alias("rows"))
        return masked.agg(F.when(F.count(F.lit(1)) > 1, F.sum("rows")).otherwise(0).alias("issues"))
    if rule.kind == "multi_unique" and rule.params.get("operator", "AND") == "AND":
        return _rows_in_groups(group_sizes(df, list(rule.columns)))
    if rule.kind == "cross_composite_unique":
        names = list(rule.columns)
        return _rows_in_groups(group_sizes(df.na.drop("all", subset=[quoted(n) for n in names]), names))
    if rule.kind == "multi_unique":
        return rows_with_any_repeat(df, list(rule.columns)).agg(F.count(F.lit(1)).alias("issues"))
    return None


def _rows_in_groups(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum(F.when(F.col("rows") > 1, F.col("rows"))), F.lit(0)).alias("issues"))


def rows_with_any_repeat(df: DataFrame, columns: list[str]) -> DataFrame:
    """Ids of the rows where at least one column repeats a non-null value."""
    hits = [members_of_repeated(df.where(col(c).isNotNull()).select(ROW_ID, c), [c], ROW_ID).select(ROW_ID) for c in columns]
    return union_all(hits).distinct()


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """``(rule_id, column, dimension, source, kind, statement, issues)``, one row per rule.

    Row-local rules are counted together in one aggregate per ``RULES_PER_PASS`` rules.
    """
    spark = df.sparkSession
    local, grouped = [], []
    for n, rule in enumerate(rules):
        condition = row_failure(df, rule)
        if condition is not None:
            local.append((n, condition))
        else:
            counted = group_count(df, rule)
            if counted is None:
                raise ValueError(f"unknown rule kind {rule.kind}")
            grouped.append((n, counted))
    parts = []
    for start in range(0, len(local), RULES_PER_PASS):
        batch = local[start:start + RULES_PER_PASS]
        row = df.agg(*[F.count_if(cond).alias(f"r{n}") for n, cond in batch])
        parts.append(row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("n"), col(f"r{n}").alias("issues")) for n, _ in batch]))))
    parts += [counted.select(F.lit(n).alias("n"), F.col("issues").cast("bigint").alias("issues")) for n, counted in grouped]
    described = spark.createDataFrame(
        [(n, r.rule_id, r.column or ",".join(r.columns), r.dimension, r.source, r.kind, r.describe()) for n, r in enumerate(rules)],
        "n int, rule_id int, column string, dimension string, source string, kind string, statement string",
    )
    return F.broadcast(described).join(union_all(parts), "n").drop("n")


def failing_rows(df: DataFrame, rule: Rule, limit: int | None = None) -> DataFrame:
    """Full rows that break the rule, by row id."""
    condition = row_failure(df, rule)
    if condition is not None:
        rows = df.where(condition)
    elif rule.kind == "unique":
        rows = members_of_repeated(df.where(col(rule.column).isNotNull()), [rule.column], ROW_ID)
    elif rule.kind == "unique_incl_null":
        rows = members_of_repeated(df, [rule.column], ROW_ID)
    elif rule.kind == "multi_unique" and rule.params.get("operator", "AND") == "AND":
        rows = members_of_repeated(df, list(rule.columns), ROW_ID)
    elif rule.kind == "multi_unique":
        rows = df.join(rows_with_any_repeat(df, list(rule.columns)), ROW_ID, "left_semi")
    elif rule.kind == "cross_composite_unique":
        names = list(rule.columns)
        rows = members_of_repeated(df.na.drop("all", subset=[quoted(n) for n in names]), names, ROW_ID)
    else:
        raise ValueError(f"{rule.kind} judges a column, not rows")
    return rows.orderBy(ROW_ID).limit(limit) if limit else rows


def examples(df: DataFrame, rules: list[Rule], k: int = 5, width: int = 50) -> DataFrame:
    """``(column, rule_id, example)``: the first ``k`` distinct failing values in row order.

    Each rule filters first; only failing distinct values are shuffled.
    """
    parts = []
    for rule in rules:
        name = rule.column or (rule.columns[0] if rule.columns else "")
        value = F.coalesce(as_text(df, name), F.lit(""))
        failing = failing_rows(df, rule).select(F.lit(rule.rule_id).alias("rule_id"), value.alias("value"), ROW_ID)
        parts.append(failing.groupBy("rule_id", "value").agg(F.min(ROW_ID).alias("first_id")).orderBy("first_id").limit(k))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("first_id", "value"))), lambda s: F.substring(s["value"], 1, width))
    return union_all(parts).groupBy("rule_id").agg(F.array_join(listed, "; ").alias("example"))


def evaluate_with_examples(df: DataFrame, rules: list[Rule]) -> DataFrame:
    by_row = [r for r in rules if r.kind not in ("consistent_casing", "format_mask_consistent")]
    shown = F.broadcast(examples(df, by_row))
    return evaluate(df, rules).join(shown, "rule_id", "left").withColumn("example", F.coalesce("example", F.when(F.col("issues") == 0, NO_ISSUES).otherwise(F.concat(F.col("issues").cast("string"), F.lit(" issues found")))))


def merge_results(results: DataFrame) -> DataFrame:
    """One row per (column, dimension, source): statements, summed counts, joined examples."""
    ordered = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rule_id", c))), lambda s: s[c]))
    told = F.filter(ordered("example"), lambda e: e != NO_ISSUES)
    return results.groupBy("column", "dimension", "source").agg(
        F.array_join(ordered("statement"), "; ").alias("statements"), F.sum("issues").alias("issues"), told.alias("_told"),
    ).select("column", "dimension", "source", "statements", "issues",
             F.when(F.size("_told") > 0, F.array_join("_told", "; ")).otherwise(NO_ISSUES).alias("example"))


def rules_in_data(df: DataFrame, rule_column: str) -> DataFrame:
    """``(column, statement)`` parsed from cells ``Column: rule`` or ``Column - rule``."""
    names = data_columns(df)
    cells = df.select(col(rule_column).cast("string").alias("cell")).where("cell is not null").distinct()
    separator = F.when(F.col("cell").contains(":"), ":").when(F.col("cell").contains("-"), "-")
    at = F.locate(":", F.col("cell"))
    at = F.when(separator == ":", at).otherwise(F.locate("-", F.col("cell")))
    return cells.where(separator.isNotNull()).select(
        text.strip(F.substring("cell", F.lit(1), at - 1)).alias("column"),
        text.strip(F.substring("cell", at + 1, F.char_length("cell"))).alias("statement"),
    ).where(F.col("column").isin(names)).distinct()
