"""Detail reports behind each dimension of the scorecard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import ROW_ID
from assayer.functions import bands, text
from assayer.functions.formats import FORMATS, REGULATORY_TYPES, Glossary
from assayer.operators.digests import DIGEST, digest, repetition
from assayer.operators.rules import Rule, evaluate
from assayer.operators.skew import group_sizes
from assayer.operators.values import first_values, union_all
from assayer.plans.scorecard import _case_scope, field_counts, identifier_rates, ordered_identifiers, stacked
from assayer.schema import TEMPORAL, TEXT, as_text, col, cols, columns_of, comparable, data_columns, families, quoted

VERY_OLD = "1990-01-01"


# Completeness

def completeness_fields(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Fill of each field, worst first, with status and rank (one row per column)."""
    fields = field_counts(df, glossary)
    rate = F.col("filled") / F.col("total")
    rows = fields.select(
        "column", "total", "filled", (F.col("total") - F.col("filled")).alias("blank"), F.round(rate, 4).alias("fill_rate"),
        bands.fill_status(rate, F.col("is_cde")).alias("status"), "semantic_type", "is_cde")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("fill_rate", "column")))


def blank_samples(df: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` row ids of every column's missing cells."""
    return first_values(df, comparable(df), k, lambda c: col(c).isNull()).select("column", ROW_ID)


def completeness_buckets(fields: DataFrame) -> DataFrame:
    return fields.groupBy(bands.fill_bucket(F.col("fill_rate")).alias("bucket")).agg(F.count(F.lit(1)).alias("fields"))


def completeness_summary(fields: DataFrame) -> DataFrame:
    cde = lambda c: F.sum(F.when(F.col("is_cde"), col(c)))
    return fields.agg(
        F.count(F.lit(1)).alias("total_fields"), F.max("total").alias("rows"), F.round(F.sum("filled") / F.sum("total"), 4).alias("overall_fill_rate"),
        F.count_if("is_cde").alias("cde_count"), F.round(cde("filled") / cde("total"), 4).alias("cde_fill_rate"))


# Validation

def validation_fields(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Valid, invalid and blank counts of each column that has a pattern, worst first."""
    fields = field_counts(df, glossary).where("has_pattern")
    total, value, valid = F.col("total"), F.col("with_value"), F.col("valid_with_value")
    invalid, blank = value - valid, total - value
    share = lambda n: F.round(F.when(total > 0, n / total).otherwise(0.0), 4)
    return fields.select(
        "column", "semantic_type", value.alias("records_with_value"), valid.alias("valid"), share(valid).alias("valid_pct"),
        invalid.alias("invalid"), share(invalid).alias("invalid_pct"), blank.alias("blank"), share(blank).alias("blank_pct"),
        F.round(F.when(value > 0, valid / value).otherwise(0.0), 4).alias("validity_rate"),
    ).orderBy("validity_rate", F.col("invalid").desc(), "column")


def validation_summary(fields: DataFrame) -> DataFrame:
    return fields.agg(
        F.count(F.lit(1)).alias("typed_columns"), F.sum("valid").alias("valid_values"), F.sum("invalid").alias("invalid_values"),
        F.sum("blank").alias("blank_values"), F.round(F.coalesce(F.try_divide(F.sum("valid"), F.sum("records_with_value")), F.lit(0.0)), 4).alias("overall_validity_rate"))


def invalid_samples(df: DataFrame, glossary: Glossary, k: int = 10) -> DataFrame:
    """First ``k`` invalid values of each typed column with their row ids."""
    patterns = {c: glossary.pattern(c) for c in data_columns(df) if glossary.pattern(c)}
    bad = lambda c: ~text.blank(as_text(df, c)) & ~text.matches(as_text(df, c), patterns[c])
    return first_values(df, list(patterns), k, bad)


def skipped_columns(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Columns without a check and why (column metadata only)."""
    rows = [
        (c, glossary.semantic_type(c), "no canonical format check defined for this type" if glossary.semantic_type(c) else "no semantic type assigned")
        for c in data_columns(df) if not glossary.pattern(c)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, semantic_type string, reason string")


def semantic_breakdown(fields: DataFrame) -> DataFrame:
    return fields.groupBy(F.coalesce("semantic_type", F.lit("(unclassified)")).alias("semantic_type")).agg(F.count(F.lit(1)).alias("fields"))


# Uniqueness

def attribute_key(df: DataFrame, glossary: Glossary, primary: str | None, names_used: int = 1, ids_used: int = 2) -> list[str]:
    """Name and up to two regulatory ids that identify an entity without its primary key."""
    others = [c for c in data_columns(df) if c != primary]
    names = [c for c in others if glossary.semantic_type(c) == "free_text_name" and glossary.recommended(c)][:names_used]
    return names + [c for c in others if glossary.semantic_type(c) in REGULATORY_TYPES and c not in names][:ids_used]


def composite_key(df: DataFrame, glossary: Glossary, ids_used: int = 3) -> list[str]:
    ids = ordered_identifiers(df, glossary)
    return attribute_key(df, glossary, ids[0] if ids else None) or ids[:ids_used]


def composite_duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: repeated combinations, their rows and share; all-null tuples are left out."""
    total = df.agg(F.count(F.lit(1)).alias("t")).first()["t"]
    return repetition(df, [(keys, "all")]).select(
        F.lit(" + ".join(keys)).alias("key"), F.col("combos").alias("duplicate_combos"), F.col("repeated").alias("rows_in_duplicates"),
        F.round(F.col("repeated") / F.lit(max(total, 1)), 4).alias("duplicate_rate"))


def top_duplicates(df: DataFrame, keys: list[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent repeated tuples, ties by value."""
    return group_sizes(df.na.drop("all", subset=[quoted(n) for n in keys]), keys).where("rows > 1").orderBy(F.col("rows").desc(), *cols(keys)).limit(k)


def shared_identifiers(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, value, distinct_entities, rows)``: values of each identifier whose rows differ in some other column.

    One scan for all identifiers: a row sends (identifier's number, value, digest of the row) for
    each. Copies collapse before the identifier is grouped, so a frequent identifier never
    gathers its rows, and no other value is moved.
    """
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, distinct_entities bigint, rows bigint")
    cell = lambda i, c: F.when(col(c).isNotNull(), F.struct(F.lit(i).alias("i"), col(c).cast("string").alias("value")))
    cells = df.select(*digest(comparable(df)), F.explode(F.array_compact(F.array(*[cell(i, c) for i, c in enumerate(columns)]))).alias("x"))
    entities = cells.select("x.*", *DIGEST).groupBy("i", "value", *DIGEST).agg(F.count(F.lit(1)).alias("rows"))
    shared = entities.groupBy("i", "value").agg(F.count(F.lit(1)).alias("distinct_entities"), F.sum("rows").alias("rows")).where("distinct_entities > 1")
    name = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("i") + 1)
    return shared.select(name.alias("column"), "value", "distinct_entities", "rows")


def shared_risk(df: DataFrame, columns: list[str], repeats_expected: bool = False) -> DataFrame:
    """Per identifier: shared values, affected rows and the ten values with most entities."""
    found = shared_identifiers(df, columns).groupBy("column").agg(F.count(F.lit(1)).alias("shared_values"), F.sum("rows").alias("rows_affected"))
    listed = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return F.broadcast(listed).join(found, "column", "left").select("column", zero("shared_values"), zero("rows_affected")).withColumn(
        "severity", F.lit("informational" if repeats_expected else "high"))


def shared_samples(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return shared_identifiers(df, [column]).orderBy(F.col("distinct_entities").desc(), "value").limit(k).select("value", "distinct_entities")


def identifier_uniqueness(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Per identifier column: non-null, unique, duplicates, rate."""
    return identifier_rates(df, ordered_identifiers(df, glossary)).select(
        "column", "non_null", "distinct_count", (F.col("non_null") - F.col("distinct_count")).alias("duplicates"), F.round("rate", 4).alias("uniqueness_rate"))


def uniqueness_summary(df: DataFrame, glossary: Glossary) -> DataFrame:
    """One row: rows, distinct rows, repeated rows, the primary identifier and why it was chosen."""
    ids = ordered_identifiers(df, glossary)
    row = repetition(df, [(comparable(df), "none")]).select(F.col("total").alias("rows"), "distinct_rows", F.col("repeated").alias("full_row_duplicates"))
    return row.withColumn("primary_identifier", F.lit(ids[0] if ids else None).cast("string")) \
        .withColumn("identifier_columns", F.lit(",".join(ids))).withColumn("composite_key", F.lit(",".join(composite_key(df, glossary)))) \
        .withColumn("rationale", F.lit(_rationale(glossary, ids)))


def _rationale(glossary: Glossary, ids: list[str]) -> str:
    if not ids:
        return "No identifier columns were detected."
    kind = glossary.semantic_type(ids[0]) or "unknown"
    return f"Type: {kind}. " + (f"Chosen over {', '.join(ids[1:4])} by type, uniqueness and position." if ids[1:] else "Only identifier candidate in the dataset.")


# Standardisation

def text_scope(df: DataFrame, glossary: Glossary) -> list[str]:
    from assayer.functions.formats import CASE_TYPES

    return [c for c in columns_of(df, TEXT) if glossary.semantic_type(c) is None or glossary.semantic_type(c) in CASE_TYPES]


# Order that settles which case class is dominant among equals.
CASES = ["upper", "lower", "title", "mixed", "other"]


def case_patterns(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Per text column: counts of the five case classes, the dominant one and the consistency rate."""
    fields = field_counts(df.select(*cols(text_scope(df, glossary))), glossary)
    best = F.greatest(*CASES)
    dominant = F.coalesce(*[F.when(col(c) == best, c) for c in CASES])
    off = F.col("filled") - best
    return fields.select(
        "column", *CASES, dominant.alias("dominant"), off.alias("off_pattern"),
        F.round(F.when(F.col("filled") > 0, best / F.col("filled")).otherwise(1.0), 4).alias("consistency_rate"),
    ).orderBy("consistency_rate", "column")


def off_pattern_samples(df: DataFrame, patterns: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` values off the dominant case per column (60 characters shown)."""
    dominant = {r["column"]: r["dominant"] for r in patterns.select("column", "dominant").collect()}
    off = lambda c: text.case_class(col(c)) != dominant[c]
    return first_values(df, list(dominant), k, off, lambda c: F.substring(col(c), 1, 60))


def spellings(df: DataFrame, column: str) -> DataFrame:
    """``(column, key, value, rows)``: every spelling of a folded form that has two or more."""
    counted = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    keyed = counted.withColumn("key", text.fold_key(F.col("value"))).where("key != ''")
    many = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(many, "key").select(F.lit(column).alias("column"), "key", "value", "rows")


def spelling_variants(df: DataFrame, column: str, k: int = 20) -> DataFrame:
    """The ``k`` folded forms with most spellings: ``(column, key, distinct_spellings, total_rows, variants)``.

    ``variants`` joins all spellings of a chosen form; they share its folded text.
    """
    keyed = spellings(df, column)
    top = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("distinct_spellings"), F.sum("rows").alias("total_rows")) \
        .orderBy(F.col("distinct_spellings").desc(), F.col("total_rows").desc(), "key").limit(k)
    entry = F.struct((-F.col("rows")).alias("n"), "value", F.concat("value", F.lit("("), F.col("rows").cast("string"), F.lit(")")).alias("shown"))
    spelled = keyed.join(top.select("key"), "key", "left_semi").groupBy("key").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda s: s["shown"]), ", ").alias("variants"))
    return top.join(spelled, "key").select(F.lit(column).alias("column"), "key", "distinct_spellings", "total_rows", "variants")


def whitespace(df: DataFrame, glossary: Glossary) -> DataFrame:
    """Leading, trailing, double space and control characters per text column, where any occurs."""
    names = text_scope(df, glossary)
    row = df.agg(*[F.struct(F.lit(c).alias("column"), *[F.count_if(flag).alias(n) for n, flag in text.whitespace_issues(col(c)).items()]).alias(f"c{i}") for i, c in enumerate(names)])
    rows = row.select(F.inline(F.array(*[col(f"c{i}") for i in range(len(names))])))
    return rows.where("leading + trailing + doublespace + control_chars > 0")


def standardisation_summary(patterns: DataFrame) -> DataFrame:
    values = sum((col(c) for c in CASES), F.lit(0))
    return patterns.agg(
        F.count(F.lit(1)).alias("text_columns"), F.sum("off_pattern").alias("off_pattern_values"),
        F.round(F.when(F.sum(values) > 0, (F.sum(values) - F.sum("off_pattern")) / F.sum(values)).otherwise(1.0), 4).alias("overall_consistency"))


# Accuracy

def accuracy_rules(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Cross-field rules with failing rows, validity rate and status, failing first."""
    cross = [r for r in rules if "cross" in r.dimension.lower()]
    total = df.agg(F.count(F.lit(1)).alias("t")).first()["t"]
    results = evaluate(df, cross)
    return results.select(
        "rule_id", "statement", "column", "issues", F.round((F.lit(total) - F.col("issues")) / F.lit(max(total, 1)), 4).alias("validity_rate"),
        F.when(F.col("issues") == 0, "Passing").otherwise("Failing").alias("status"),
    ).orderBy(F.col("status") == "Passing", F.col("issues").desc(), "rule_id")


def accuracy_summary(rules: DataFrame) -> DataFrame:
    passing = F.count_if(F.col("status") == "Passing")
    return rules.agg(
        F.count(F.lit(1)).alias("total_rules"), passing.alias("rules_passing"), F.count_if(F.col("status") == "Failing").alias("rules_failing"),
        F.sum("issues").alias("total_violations"), F.round(passing / F.count(F.lit(1)), 4).alias("pass_rate"))


# Timeliness

def timeliness_columns(df: DataFrame, as_of: Column) -> DataFrame:
    """Per date column: populated, blank, future, very old, range and rate, worst first."""
    names = columns_of(df, TEMPORAL)
    old = F.to_timestamp(F.lit(VERY_OLD))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    row = df.agg(*[F.struct(
        F.lit(c).alias("column"), F.count(F.lit(1)).alias("total"), F.count(col(c)).alias("populated"), F.count_if(col(c).isNull()).alias("blank"),
        F.count_if(col(c) > as_of).alias("future_dated"), F.count_if(col(c) < old).alias("very_old"),
        shown(F.min(col(c))).alias("oldest"), shown(F.max(col(c))).alias("newest")).alias(f"c{i}") for i, c in enumerate(names)])
    rows = row.select(F.inline(F.array(*[col(f"c{i}") for i in range(len(names))])))
    good = F.col("populated") - F.col("future_dated") - F.col("very_old")
    return rows.withColumn("timeliness_rate", F.round(F.when(F.col("populated") > 0, good / F.col("populated")).otherwise(0.0), 4)).orderBy("timeliness_rate", "column")


def untimely_samples(df: DataFrame, as_of: Column, k: int = 5) -> DataFrame:
    """First ``k`` future and very old values of every date column."""
    names = columns_of(df, TEMPORAL)
    old = F.to_timestamp(F.lit(VERY_OLD))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    future = first_values(df, names, k, lambda c: col(c) > as_of, shown).withColumn("issue", F.lit("future"))
    return future.unionByName(first_values(df, names, k, lambda c: col(c) < old, shown).withColumn("issue", F.lit("very_old")))


def timeliness_summary(columns: DataFrame) -> DataFrame:
    bad = F.sum("future_dated") + F.sum("very_old")
    return columns.agg(
        F.count(F.lit(1)).alias("date_columns"), F.sum("future_dated").alias("total_future"), F.sum("very_old").alias("total_very_old"),
        F.round(F.when(F.sum("populated") > 0, (F.sum("populated") - bad) / F.sum("populated")).otherwise(1.0), 4).alias("overall_timeliness"))


# Rejects

def rejection_reasons(quarantine: DataFrame, k: int = 15) -> DataFrame:
    return quarantine.groupBy("Rejection_Reason").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("rows").desc(), "Rejection_Reason").limit(k)
