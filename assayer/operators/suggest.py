"""Suggestions derived from the profile: match rules and quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer.session import small

# Name fragments of columns that hold names or descriptions.
NAME_WORDS = ["name", "desc", "title", "product", "customer", "company", "vendor", "supplier", "brand", "item"]
# A column with one of these words in its name looks like a key.
KEY_NAME = r"(?i)\b(id|uid|code|key|number|no\.?)\b"


def match_rules(profiled: DataFrame) -> DataFrame:
    """Up to ten duplicate-search suggestions ``(rule_no, rule_type, columns, probability, confidence)``.

    Works on the profile, one row per column, so all steps are small.
    """
    p = small(profiled.select(
        "column", "position", "null_percentage", "distinct_percentage", "duplicate_count", "duplicate_percentage",
        (F.col("family") == "text").alias("is_text"), F.coalesce("avg_length", F.lit(0.0)).alias("avg_length"),
        F.coalesce("min_length", F.lit(0)).alias("min_length"), F.coalesce("max_length", F.lit(0)).alias("max_length"),
    ))
    u, avg = F.col("distinct_percentage"), F.col("avg_length")
    exact_score = (
        F.when((u >= 95) & (u < 100), 35).when((u >= 80) & (u < 95), 25).otherwise(0)
        + F.when(F.col("null_percentage") < 1, 20).when(F.col("null_percentage") < 5, 15).otherwise(0)
        + F.when(F.col("is_text") & (F.col("max_length") == F.col("min_length")) & avg.between(4, 20), 25).otherwise(0)
        + F.when((F.col("duplicate_percentage") > 0) & (F.col("duplicate_percentage") < 5), 15).otherwise(0)
    )
    named = F.lower("column").rlike("|".join(NAME_WORDS))
    fuzzy_score = (
        F.when(u.between(30, 90), 35).when((u >= 10) & (u < 30), 20).otherwise(0)
        + F.when(avg.between(10, 100), 25).when(avg > 100, 15).otherwise(0)
        + F.when(named, 25).otherwise(0) + F.when(F.col("duplicate_count") > 1, 15).otherwise(0)
    )
    best = Window.orderBy(F.col("score").desc(), "position")
    exact = p.where((F.col("duplicate_count") > 0) & (u < 100)).withColumn("score", exact_score).where("score >= 50").withColumn("n", F.row_number().over(best))
    fuzzy = p.where("is_text").withColumn("score", fuzzy_score).where("score >= 45").withColumn("n", F.row_number().over(best))
    single = lambda rows, kind, label: rows.where("n <= 4").select(
        F.lit(kind).alias("rule_type"), F.col("column").alias("columns"), label(F.col("score")).alias("probability"),
        F.col("score").cast("double").alias("confidence"), F.col("n").alias("seq"))
    exact_label = lambda s: F.when(s >= 85, "Strongest").when(s >= 75, "Very Strong").when(s >= 65, "Strong").otherwise("Good")
    fuzzy_label = lambda s: F.when(s >= 70, "Strong").when(s >= 60, "Good").otherwise("Medium")
    # Two exact and three fuzzy candidates at most.
    e = exact.where("n <= 2").select(F.col("column").alias("e"), F.col("score").alias("es"), F.col("n").alias("en"))
    f = fuzzy.where("n <= 3").select(F.col("column").alias("f"), F.col("score").alias("fs"), F.col("n").alias("fn"))
    spread = e.select("e", "es", "en", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("fn"))
    mean = (F.col("es") + F.col("fs")) / 2
    both = spread.join(f, "fn").where("e != f").select(
        F.lit("Combined").alias("rule_type"), F.concat("e", F.lit(" (Exact) + "), "f", F.lit(" (Fuzzy)")).alias("columns"),
        F.when(mean >= 75, "Enterprise").when(mean >= 65, "Strong").otherwise("Good").alias("probability"),
        mean.alias("confidence"), ((F.col("en") - 1) * 3 + F.col("fn")).alias("seq"))
    kind_order = F.when(F.col("rule_type") == "Exact", 0).when(F.col("rule_type") == "Fuzzy", 1).otherwise(2)
    found = single(exact, "Exact", exact_label).unionByName(single(fuzzy, "Fuzzy", fuzzy_label)).unionByName(both)
    # The list is filled in this order up to ten entries, then sorted by confidence.
    filled = found.withColumn("kind", kind_order).withColumn("place", F.row_number().over(Window.orderBy("kind", "seq"))).where("place <= 10")
    fallback = p.where("position = 0").select(
        F.lit("Exact").alias("rule_type"), F.col("column").alias("columns"), F.lit("Medium").alias("probability"),
        F.lit(50.0).alias("confidence"), F.lit(1).alias("seq"), F.lit(0).alias("kind"), F.lit(1).alias("place"), F.lit(0).alias("any"))
    total = filled.agg(F.count(F.lit(1)).alias("any"))
    # The fallback stands only when nothing else was found (zero rows match otherwise).
    result = filled.unionByName(fallback.join(F.broadcast(total), "any").drop("any"))
    ranked = result.withColumn("rank", F.row_number().over(Window.orderBy(F.col("confidence").desc(), "place")))
    return ranked.select(F.format_string("R%02d", "rank").alias("rule_no"), "rule_type", "columns", "probability", "confidence")


def _suggestion(condition: Column, dimension: str, kind: str, argument: Column | None = None) -> Column:
    return F.when(condition, F.struct(
        F.lit(dimension).alias("dimension"), F.lit(kind).alias("kind"),
        (argument if argument is not None else F.lit(None)).cast("string").alias("argument")))


def quality_rules(profiled: DataFrame) -> DataFrame:
    """Typed rules suggested by the profile: ``(column, dimension, kind, argument)``."""
    is_text = F.col("family") == "text"
    looks_like_key = F.col("column").rlike(KEY_NAME)
    # Text columns are judged by their values: all e-mail, all numeric, else a length limit.
    emails = is_text & (F.col("email_values") > 0) & (F.col("email_values") == F.col("non_null_count"))
    suggestions = F.array_compact(F.array(
        _suggestion((F.col("null_count") > 0) | looks_like_key, "Completeness", "not_blank"),
        _suggestion(looks_like_key | (F.col("distinct_percentage") > 95), "Uniqueness", "unique"),
        _suggestion(F.col("family") == "numeric", "Validation", "numeric"),
        _suggestion(F.col("family") == "temporal", "Validation", "valid_date"),
        _suggestion(F.col("family") == "temporal", "Timeliness", "not_future"),
        _suggestion(emails, "Validation", "email"),
        _suggestion(is_text & ~emails & (F.col("non_null_count") > 0), "Validation", "max_length", F.col("max_length")),
    ))
    return profiled.select("column", F.explode(suggestions).alias("s")).select("column", "s.dimension", "s.kind", "s.argument")
