"""Golden records: one surviving row per duplicate group, with the origin of every value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from assayer import ROW_ID
from assayer.functions import text
from assayer.operators.dedup import first_present
from assayer.schema import col, cols, data_columns, families

LEADER = "_leader_id"


def pick_leader(df: DataFrame, membership: DataFrame, strategy: str, recency_column: str | None = None) -> DataFrame:
    """``(group_id, _leader_id)``; ties go to the smallest row id.

    ``most_complete`` counts non-null fields; ``most_recent`` takes the latest parsed date and
    falls back to the first row where none parses.
    """
    names = data_columns(df)
    if strategy == "most_recent" and recency_column in df.columns:
        rank = text.to_time(col(recency_column), df.schema[recency_column].dataType).cast("double")
    elif strategy == "most_recent":
        rank = F.lit(0.0)
    else:
        rank = sum((col(c).isNotNull().cast("int") for c in names), F.lit(0)).cast("double")
    ranked = membership.select("group_id", ROW_ID).join(df.select(ROW_ID, rank.alias("rank")), ROW_ID)
    # Unparsed dates sort below every date.
    best = F.max(F.struct(F.coalesce("rank", F.lit(float("-inf"))).alias("rank"), (-F.col(ROW_ID)).alias("order")))
    return ranked.groupBy("group_id").agg((-best.getField("order")).alias(LEADER))


def golden_records(df: DataFrame, membership: DataFrame, strategy: str = "most_complete",
                   recency_column: str | None = None, priority: list[str] | None = None) -> DataFrame:
    """``(group_id, survivor_id, <columns>, provenance)``.

    ``provenance`` maps each column to (source_row_id, reason). ``field_level_merge`` takes the
    leader's value and, where that is missing, the first present value of the group.
    """
    names = data_columns(df)
    plain = strategy in ("most_complete", "most_recent")
    pick = strategy if plain else next((p for p in (priority or ["most_complete"]) if p in ("most_complete", "most_recent")), "first")
    if pick == "first":
        leaders = membership.groupBy("group_id").agg(F.min(ROW_ID).alias(LEADER))
    else:
        leaders = pick_leader(df, membership, pick, recency_column)
    chosen = leaders.join(df.withColumnRenamed(ROW_ID, LEADER), LEADER)
    if plain:
        origin = {c: F.struct(F.col(LEADER).cast("bigint").alias("source_row_id"), F.lit(strategy).alias("reason")) for c in names}
        return chosen.select("group_id", F.col(LEADER).alias("survivor_id"), *cols(names), _as_map(origin))
    filled = first_present(df, membership.select("group_id", ROW_ID))
    both = chosen.join(filled, "group_id")
    values, origin = [], {}
    for c in names:
        if families(df)[c] == "other":
            values.append(col(c))
            origin[c] = F.struct(F.col(LEADER).cast("bigint").alias("source_row_id"), F.lit("leader_non_null").alias("reason"))
            continue
        first = col(f"_first_{c}")
        values.append(F.coalesce(col(c), first.getField(c)).alias(c))
        source = F.when(col(c).isNotNull(), F.col(LEADER)).otherwise(first.getField(ROW_ID)).cast("bigint")
        reason = F.when(col(c).isNotNull(), "leader_non_null").when(first.isNull(), "all_null").otherwise("first_non_null_in_group")
        origin[c] = F.struct(source.alias("source_row_id"), reason.alias("reason"))
    return both.select("group_id", F.col(LEADER).alias("survivor_id"), *values, _as_map(origin))


def _as_map(origin: dict[str, Column]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in origin]), F.array(*origin.values())).alias("provenance")


def provenance_rows(golden: DataFrame) -> DataFrame:
    """Long form ``(group_id, column, source_row_id, reason)``."""
    return golden.select("group_id", F.explode("provenance").alias("column", "origin")).select(
        "group_id", "column", "origin.source_row_id", "origin.reason")


def apply_survivors(df: DataFrame, membership: DataFrame, golden: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """The table with each group replaced by its golden record, under the survivor's row id.

    ``overrides`` is ``(group_id, column, value)`` with values as text, set by a person.
    """
    names = data_columns(df)
    records = golden.select("group_id", F.col("survivor_id").alias(ROW_ID), *cols(names))
    if overrides is not None:
        wide = overrides.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("column", "value"))).alias("_set"))
        records = records.join(wide, "group_id", "left")
        for c in names:
            given = F.col("_set").getItem(c)
            records = records.withColumn(c, F.when(F.map_contains_key("_set", F.lit(c)), given.cast(df.schema[c].dataType)).otherwise(col(c))) \
                if families(df)[c] != "other" else records
    rest = df.join(membership.select(ROW_ID), ROW_ID, "left_anti")
    return rest.select(*cols(df.columns)).unionByName(records.select(*cols(df.columns)))
