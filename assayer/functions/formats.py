"""Registry of canonical formats by semantic type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Canonical pattern of each semantic type.
FORMATS = {
    "pan": r"^[A-Z]{5}\d{4}[A-Z]$",
    "gstin": r"^\d{2}[A-Z]{5}\d{4}[A-Z][A-Z\d]Z[A-Z\d]$",
    "tan": r"^[A-Z]{4}\d{5}[A-Z]$",
    "cin": r"^[LUu]\d{5}[A-Z]{2}\d{4}[A-Z]{3}\d{6}$",
    "ein": r"^\d{2}-?\d{7}$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "aadhaar": r"^\d{4}\s?\d{4}\s?\d{4}$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]{2,}$",
    "indian_pin": r"^[1-9]\d{5}$",
    "postal_code": r"(?i)^[A-Z0-9 \-]{3,12}$",
    "ifsc": r"^[A-Z]{4}0[A-Z0-9]{6}$",
    "iban": r"^[A-Z]{2}\d{2}[A-Z0-9]{1,30}$",
    "swift": r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$",
    "iso_country": r"^[A-Z]{2}$",
    "iso_currency": r"^[A-Z]{3}$",
    "phone": r"^[\d\s\-\+\(\)]{7,}$",
    "url": r"(?i)^https?://\S+$",
    "year": r"^(19|20)\d{2}$",
}

# Semantic types that identify a business entity.
IDENTIFIER_TYPES = [
    "pan", "gstin", "tan", "cin", "vat", "ein", "ssn", "aadhaar", "iban", "swift", "ifsc",
    "account_number", "numeric_id", "alphanumeric_id",
]
# Identifiers issued by an authority; an attribute of an entity, not its key.
REGULATORY_TYPES = ["pan", "gstin", "tan", "cin", "ein", "ssn", "aadhaar", "vat"]
# Semantic types whose letter case should be uniform.
CASE_TYPES = [
    "free_text_name", "free_text_address", "free_text_description", "enum_code", "iso_country", "iso_currency",
]
# Recommended columns of these types are still no identifiers.
NOT_IDENTIFIER_TYPES = [
    "free_text_name", "free_text_address", "free_text_description", "email", "phone", "url", "date",
    "datetime", "amount", "quantity", "percentage", "boolean", "iso_country", "iso_currency",
    "year", "enum_code",
]


class Glossary(dict):
    """Column name -> ``{semantic_type, recommended, regex}``, as classified outside this library."""

    def semantic_type(self, column: str) -> str | None:
        raw = self.get(column, {}).get("semantic_type")
        return str(raw).strip().lower().replace(" ", "_") or None if raw else None

    def recommended(self, column: str) -> bool:
        return bool(self.get(column, {}).get("recommended"))

    def pattern(self, column: str) -> str | None:
        """An explicit pattern wins over the registry."""
        return self.get(column, {}).get("regex") or FORMATS.get(self.semantic_type(column) or "")

    def identifier_candidates(self, columns: list[str]) -> list[str]:
        chosen = []
        for column in columns:
            if column not in self:
                continue
            kind = self.semantic_type(column)
            if kind in IDENTIFIER_TYPES:
                chosen.append(column)
            elif self.recommended(column) and kind is not None and kind not in NOT_IDENTIFIER_TYPES:
                chosen.append(column)
        return chosen


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FORMATS.items()), "semantic_type string, pattern string")


def resolve_patterns(rules: DataFrame, glossary: DataFrame) -> DataFrame:
    """Fill the pattern of each rule: its own, else the glossary's, else the registry's.

    ``rules`` has ``column`` and ``pattern``; ``glossary`` has ``column, semantic_type, regex``.
    The registry has 18 rows, so it is broadcast.
    """
    known = F.broadcast(registry(rules.sparkSession).withColumnRenamed("pattern", "registry_pattern"))
    types = glossary.select("column", F.when(F.trim("regex") != "", F.col("regex")).alias("glossary_pattern"), F.regexp_replace(F.lower(F.trim("semantic_type")), " ", "_").alias("semantic_type"))
    typed = types.join(known, "semantic_type", "left")
    own = F.when(F.trim("pattern") != "", F.col("pattern"))
    return (
        rules.join(typed, "column", "left")
        .withColumn("resolved_pattern", F.coalesce(own, F.col("glossary_pattern"), F.col("registry_pattern")))
        .withColumn("resolved_by", F.when(own.isNotNull(), "explicit").when(F.col("glossary_pattern").isNotNull(), "glossary").when(F.col("registry_pattern").isNotNull(), "registry").otherwise("none"))
        .drop("registry_pattern", "glossary_pattern")
    )
