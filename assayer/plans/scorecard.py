"""Six-dimension scorecard of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import ROW_ID
from assayer.functions import bands, text
from assayer.functions.formats import CASE_TYPES, REGULATORY_TYPES, Glossary
from assayer.operators.digests import repetition
from assayer.operators.rules import Rule, evaluate
from assayer.operators.values import distinct_counts, union_all
from assayer.schema import TEMPORAL, TEXT, as_text, col, cols, columns_of, comparable, data_columns, families

DIMENSIONS = ["Completeness", "Validation", "Uniqueness", "Standardisation", "Accuracy", "Timeliness"]
NO_SCORE = "dimension string, score double, records_impacted bigint, enabled boolean"


def stacked(row: DataFrame, entries: list[dict[str, Column]]) -> DataFrame:
    """One row per entry from a one-row aggregate."""
    return row.select(F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in e.items()]) for e in entries])))


def field_counts(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Per column: filled, blank text, valid values, case counts; one aggregate over one scan.

    ``checked`` and ``valid`` count non-null values against the column's pattern (null when it
    has none); ``blank_checked`` ones also leave out white-space values.
    """
    fams = families(df)
    aggregates, names = [], data_columns(df)
    for i, c in enumerate(names):
        pattern, shown = glossary.pattern(c), as_text(df, c) if fams[c] != "other" else F.lit(None).cast("string")
        valid = text.matches(shown, pattern) if pattern else F.lit(None).cast("boolean")
        is_text = fams[c] == TEXT
        case = text.case_class(shown)
        count = lambda condition: F.count_if(condition)
        none = F.lit(None).cast("bigint")
        fields = {
            "position": F.lit(i), "column": F.lit(c), "family": F.lit(fams[c]),
            "semantic_type": F.lit(glossary.semantic_type(c)).cast("string"), "is_cde": F.lit(glossary.recommended(c)),
            "total": F.count(F.lit(1)), "filled": F.count(col(c)),
            "has_pattern": F.lit(pattern is not None),
            "valid": count(valid) if pattern else none, "checked": F.count(col(c)) if pattern else none,
            "with_value": count(~text.blank(shown)) if pattern else none,
            "valid_with_value": count(~text.blank(shown) & valid) if pattern else none,
        }
        for name in ("upper", "lower", "title", "mixed", "other"):
            fields[name] = count(case == name) if is_text else none
        # The per-field dashboard knows three classes only.
        fields["all_upper"] = count(F.upper(shown) == shown) if is_text else none
        fields["all_lower"] = count(F.lower(shown) == shown) if is_text else none
        aggregates.append(F.struct(*[v.alias(k) for k, v in fields.items()]).alias(f"c{i}"))
    batches = []
    for start in range(0, len(aggregates), 20):
        row = df.agg(*aggregates[start:start + 20])
        batches.append(row.select(F.inline(F.array(*[col(f"c{i}") for i in range(start, min(start + 20, len(names)))]))))
    return union_all(batches)


def completeness(fields: DataFrame, rows_with_null: DataFrame) -> DataFrame:
    rate = F.col("filled") / F.col("total")
    summed = fields.agg(F.avg(rate).alias("score"), F.count_if(rate < 0.9).alias("low_fields"), F.count_if(rate < 0.5).alias("critical_fields"),
                        F.max("total").alias("total"))
    impacted = rows_with_null.withColumn("dimension", F.lit("Completeness"))
    return summed.withColumn("dimension", F.lit("Completeness")).join(impacted, "dimension").select(
        "dimension", F.coalesce("score", F.lit(0.0)).alias("score"),
        F.col("rows_with_null").alias("records_impacted"), (F.col("total") > 0).alias("enabled"))


def rows_with_any_null(df: DataFrame) -> DataFrame:
    missing = F.lit(False)
    for c in data_columns(df):
        missing = missing | col(c).isNull()
    return df.agg(F.count_if(missing).alias("rows_with_null"))


def _share(dimension: str, row: DataFrame, good: Column, whole: Column, bad: Column, unscored: float = 0.0) -> DataFrame:
    return row.select(
        F.lit(dimension).alias("dimension"), F.when(whole > 0, good / whole).otherwise(unscored).alias("score"),
        F.coalesce(bad, F.lit(0)).cast("bigint").alias("records_impacted"), F.coalesce(whole > 0, F.lit(False)).alias("enabled"))


def validation(fields: DataFrame) -> DataFrame:
    row = fields.agg(F.sum("valid").alias("good"), F.sum("checked").alias("whole"))
    return _share("Validation", row, F.col("good"), F.col("whole"), F.col("whole") - F.col("good"))


def standardisation(fields: DataFrame, glossary: Glossary) -> DataFrame:
    scoped = fields.where((F.col("family") == TEXT) & _case_scope(glossary))
    dominant = F.greatest("upper", "lower", "title", "mixed", "other")
    row = scoped.agg(F.sum(dominant).alias("good"), F.sum("filled").alias("whole"))
    return _share("Standardisation", row, F.col("good"), F.col("whole"), F.col("whole") - F.col("good"), 1.0)


def _case_scope(glossary: Glossary) -> Column:
    return F.col("semantic_type").isNull() | F.col("semantic_type").isin(CASE_TYPES) if glossary else F.lit(True)


def identifier_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, non_null, distinct_count, rate)``; the rate is null for an empty column."""
    filled = df.agg(*[F.count(col(c)).alias(c) for c in columns]).unpivot([], cols(columns), "column", "non_null")
    rate = F.when(F.col("non_null") > 0, F.col("distinct_count") / F.col("non_null"))
    return filled.join(F.broadcast(distinct_counts(df, columns)), "column").withColumn("rate", rate)


def identifiers(df: DataFrame, glossary: Glossary) -> list[tuple[str, float]]:
    """Columns typed as identifiers that are at least 95% unique, in table order, with the rate."""
    candidates = glossary.identifier_candidates(data_columns(df))
    if not candidates:
        return []
    rates = {r["column"]: r["rate"] for r in identifier_rates(df, candidates).collect()}
    return [(c, rates[c]) for c in candidates if rates[c] is not None and rates[c] >= 0.95]


def ordered_identifiers(df: DataFrame, glossary: Glossary) -> list[str]:
    """Most key-like first: generic ids, accounts, regulatory ids, others; then by uniqueness, position."""
    position = {c: i for i, c in enumerate(data_columns(df))}

    def tier(kind: str | None) -> int:
        if kind in ("numeric_id", "alphanumeric_id"):
            return 0
        return 1 if kind == "account_number" else 2 if kind in REGULATORY_TYPES else 3

    found = identifiers(df, glossary)
    return [c for c, _ in sorted(found, key=lambda e: (tier(glossary.semantic_type(e[0])), -e[1], position[e[0]]))]


def uniqueness(df: DataFrame, glossary: Glossary, repeats_expected: bool = False, ids_used: int = 4) -> DataFrame:
    """One minus the worst share of repeated rows: full rows, the composite of the first
    ``ids_used`` identifiers, or one identifier. Only full rows count where repeats are expected.
    All of them are counted in one scan, by digests."""
    key_sets = [(comparable(df), "none")]
    if not repeats_expected:
        ids = [c for c, _ in identifiers(df, glossary)][:ids_used]
        if ids:
            key_sets += [(ids, "none"), *[([c], "any") for c in ids]]
    row = repetition(df, key_sets).agg(F.max("repeated").alias("worst"), F.max("total").alias("total"))
    return _share("Uniqueness", row, F.col("total") - F.col("worst"), F.col("total"), F.col("worst"))


def accuracy(results: DataFrame) -> DataFrame:
    """Share of cross-field rules without a failing row; ``results`` comes from ``rules.evaluate``."""
    row = results.agg(F.count_if(F.col("issues") == 0).alias("good"), F.count(F.lit(1)).alias("whole"), F.sum("issues").alias("bad"))
    return _share("Accuracy", row, F.col("good"), F.col("whole"), F.col("bad"))


def timeliness(df: DataFrame, as_of: Column) -> DataFrame:
    dates = columns_of(df, TEMPORAL)
    row = df.agg(
        sum((F.count_if(col(c) > as_of) for c in dates), F.lit(0)).alias("bad"), sum((F.count(col(c)) for c in dates), F.lit(0)).alias("whole"))
    return _share("Timeliness", row, F.col("whole") - F.col("bad"), F.col("whole"), F.col("bad"), 1.0)


def dimension_scores(df: DataFrame, glossary: Glossary, as_of: Column, cross_rules: list[Rule] | None = None,
                     repeats_expected: bool = False) -> DataFrame:
    """``(dimension, score, records_impacted, enabled, rating, risk_level)``, six rows."""
    fields = field_counts(df, glossary)
    none = df.sparkSession.createDataFrame([("Accuracy", 0.0, 0, False)], NO_SCORE)
    parts = [
        completeness(fields, rows_with_any_null(df)), validation(fields), uniqueness(df, glossary, repeats_expected),
        standardisation(fields, glossary), accuracy(evaluate(df, cross_rules)) if cross_rules else none, timeliness(df, as_of),
    ]
    scored = union_all(parts)
    label = lambda column: F.when(F.col("enabled"), column).otherwise("—")
    return scored.select(
        "dimension", F.round("score", 3).alias("score"), "records_impacted", "enabled",
        label(bands.rating(F.col("score"))).alias("rating"), label(bands.risk(F.col("score"))).alias("risk_level"))


def overall(scores: DataFrame) -> DataFrame:
    row = scores.where("enabled").agg(F.round(F.avg("score"), 3).alias("overall_score"), F.count(F.lit(1)).alias("dimensions"))
    return row.withColumn("overall_rating", bands.rating(F.col("overall_score"))).withColumn("overall_risk", bands.risk(F.col("overall_score")))


# Code of the action proposed for a weak dimension.
ACTIONS = {
    "Completeness": "fill_blanks", "Validation": "cleanse_formats", "Uniqueness": "merge_duplicates",
    "Standardisation": "unify_spelling", "Accuracy": "resolve_rules", "Timeliness": "review_dates",
}


def remediation(scores: DataFrame) -> DataFrame:
    """Enabled dimensions below a perfect score, weakest first (six rows at most)."""
    order = F.create_map(*[F.lit(x) for i, d in enumerate(DIMENSIONS) for x in (d, i)])[F.col("dimension")]
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[F.col("dimension")]
    rank = F.row_number().over(Window.orderBy("score", order))
    return scores.where("enabled and score < 1.0").select(
        F.concat(F.lit("P"), rank.cast("string")).alias("priority"), "dimension", action.alias("action"), "score", "records_impacted")


# Columns whose number of distinct values is a headline figure.
HEADLINE_COLUMNS = ["Country", "country", "LAND1", "Currency", "currency", "WAERS"]


def key_statistics(df: DataFrame, glossary: Glossary, extra: list[str] | None = None) -> DataFrame:
    """``(label, value)``: rows, fields, distinct primary ids, overall fill, distinct headline values."""
    names = data_columns(df)
    ids = [c for c, _ in identifiers(df, glossary)][:1]
    headline = [c for c in (HEADLINE_COLUMNS + (extra or [])) if c in names][:1]
    filled = sum((F.count(col(c)) for c in names), F.lit(0)) / (F.count(F.lit(1)) * len(names))
    row = df.agg(F.count(F.lit(1)).cast("double").alias("rows"), filled.alias("fill"))
    entries = [("Total Records", F.col("rows")), ("Total Fields", F.lit(float(len(names)))), ("Overall Fill Rate", F.round("fill", 3))]
    out = stacked(row, [{"label": F.lit(label), "value": value} for label, value in entries])
    wanted = [(c, f"Unique {c} values") for c in ids] + [(c, f"{c} distinct values") for c in headline]
    for c, label in wanted:
        out = out.unionByName(distinct_counts(df, [c]).select(F.lit(label).alias("label"), F.col("distinct_count").cast("double").alias("value")))
    return out
