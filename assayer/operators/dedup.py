"""Exact duplicates: groups, removal strategies, the key-set matrix.

Groups are found by aggregation and rows are removed by id, so a value that fills a third of
the table never gathers in one task.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import ROW_ID
from assayer.functions import text
from assayer.operators.digests import DIGEST, first_rows, with_digest
from assayer.operators.skew import attach, group_sizes, members_of_repeated
from assayer.schema import TEXT, as_text, col, cols, comparable, data_columns, families, quoted


def exact_groups(df: DataFrame, subset: list[str] | None = None, by_digest: bool | None = None) -> DataFrame:
    """``(group_id, keys..., rows)``: tuples held by two rows or more; all-null tuples are left out.

    The group id is the smallest row id of the group. Nulls equal each other. ``by_digest``, the
    choice for whole rows and for long texts, groups digests and fetches the values of repeated
    tuples from their first rows; otherwise the values themselves are grouped.
    """
    keys = subset or comparable(df)
    if by_digest or (by_digest is None and subset is None):
        repeated = first_rows(df, keys, "all").where("rows > 1").select(F.col("first").alias("group_id"), "rows")
        held = df.select(F.col(ROW_ID).alias("group_id"), *cols(keys))
        return held.join(repeated, "group_id").select(*cols(keys), "rows", "group_id")
    groups = group_sizes(df.na.drop("all", subset=[quoted(n) for n in keys]), keys, F.min(ROW_ID).alias("group_id"))
    return groups.where("rows > 1")


def groups_all_present(df: DataFrame, columns: list[str]) -> DataFrame:
    """As ``exact_groups`` but a row with any missing key belongs to no group."""
    return exact_groups(df.na.drop("any", subset=[quoted(n) for n in columns]), columns)


def members(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Long form ``(group_id, _row_id, is_leader, score)`` of exact groups; rows meet their group by digest where a key is text."""
    if any(families(df)[k] == TEXT for k in keys):
        rows = attach(with_digest(df, keys, ROW_ID), with_digest(groups, keys, "group_id", "rows"), DIGEST)
    else:
        rows = attach(df.select(ROW_ID, *cols(keys)), groups, keys)
    return rows.select("group_id", ROW_ID, (F.col(ROW_ID) == F.col("group_id")).alias("is_leader"), F.lit(100.0).alias("score"))


def leaders_first(groups: DataFrame) -> DataFrame:
    """Numbers clusters by size, largest first; ties by smallest row id (an order for display)."""
    return groups.orderBy(F.col("rows").desc(), "group_id")


def summaries(df: DataFrame, membership: DataFrame, keys: list[str], match_type: str) -> DataFrame:
    """One row per group: size, similarity, type, keys and a 50-character representative."""
    sizes = membership.groupBy("group_id").agg(F.count(F.lit(1)).alias("rows"), F.max("score").alias("similarity"))
    shown = F.concat_ws(" | ", *[as_text(df, k) for k in keys])
    leading = df.select(F.col(ROW_ID).alias("group_id"), shown.alias("shown"))
    return sizes.join(leading, "group_id").select(
        "group_id", "rows", "similarity", F.lit(match_type).alias("match_type"), F.lit(", ".join(keys)).alias("key_columns"),
        F.when(F.char_length("shown") > 50, F.concat(F.substring("shown", 1, 50), F.lit("..."))).otherwise(F.col("shown")).alias("representative"),
    )


def details(df: DataFrame, membership: DataFrame, most: int = 50) -> DataFrame:
    """First ``most`` rows of every group; a per-task limit runs before the shuffle."""
    order = Window.partitionBy("group_id").orderBy(ROW_ID)
    first = membership.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    return first.select("group_id", ROW_ID).join(df, ROW_ID)


def remove_exact(df: DataFrame, subset: list[str] | None = None, keep: str = "first") -> DataFrame:
    """Rows left after keeping the first, last or no copy of every tuple (nulls equal each other)."""
    keys = subset or comparable(df)
    chosen = {"first": "first", "last": "last", "none": "first"}[keep]
    kept = first_rows(df, keys)
    if keep == "none":
        kept = kept.where("rows = 1")
    return df.join(kept.select(F.col(chosen).alias(ROW_ID)), ROW_ID, "left_semi")


def remove_groups(df: DataFrame, membership: DataFrame, strategy: str = "keep_first",
                  selected: DataFrame | None = None) -> DataFrame:
    """Resolve groups by strategy; rows outside any group stay.

    ``membership`` has ``group_id, _row_id``. ``selected`` names the kept ``_row_id`` for
    ``keep_selected`` and ``keep_multiple``; a group without a selection keeps its first row.
    """
    ids = membership.select("group_id", ROW_ID)
    if strategy == "keep_last":
        kept = ids.groupBy("group_id").agg(F.max(ROW_ID).alias(ROW_ID))
    elif strategy in ("keep_selected", "keep_multiple") and selected is not None:
        marked = ids.join(selected.select(ROW_ID).distinct(), ROW_ID, "left_semi")
        named = marked.select("group_id").distinct()
        rest = ids.join(named, "group_id", "left_anti").groupBy("group_id").agg(F.min(ROW_ID).alias(ROW_ID))
        kept = marked.select("group_id", ROW_ID).unionByName(rest)
    else:
        kept = ids.groupBy("group_id").agg(F.min(ROW_ID).alias(ROW_ID))
    leaving = ids.join(kept.select(ROW_ID), ROW_ID, "left_anti").select(ROW_ID)
    remaining = df.join(leaving, ROW_ID, "left_anti")
    if strategy != "merge":
        return remaining.select(*cols(df.columns))
    filled = first_present(df, ids)
    merged = remaining.join(filled, remaining[ROW_ID] == filled["group_id"], "left")
    return merged.select(*[
        F.coalesce(remaining[c], filled[f"_first_{c}"].getField(c)).alias(c) if c in data_columns(df) and families(df)[c] != "other" else remaining[c]
        for c in df.columns
    ])


def first_present(df: DataFrame, ids: DataFrame, key: str = "group_id") -> DataFrame:
    """Per group, the first non-null value of every column with the row it comes from.

    ``_first_<column>`` is a struct (row id, value); ``min`` of that struct combines map-side.
    """
    names = [c for c in data_columns(df) if families(df)[c] != "other"]
    rows = ids.join(df, ROW_ID)
    return rows.groupBy(key).agg(*[
        F.min(F.when(col(c).isNotNull(), F.struct(F.col(ROW_ID), col(c)))).alias(f"_first_{c}") for c in names
    ])


def remove_chosen_groups(df: DataFrame, membership: DataFrame, chosen: DataFrame, strategy: str) -> DataFrame:
    """Bulk form of ``remove_groups`` for the group ids in ``chosen``."""
    return remove_groups(df, membership.join(chosen.select("group_id").distinct(), "group_id", "left_semi"), strategy)


# Name fragments that sort columns into categories.
IDENTIFIER_NAMES = ["_id", "id", "key", "uuid", "guid", "serial", "sequence"]
BUSINESS_NAMES = ["name", "number", "email", "phone", "mobile", "tax", "pan", "gstin", "account", "code",
                  "vendor", "supplier", "customer"]
METADATA_NAMES = ["batch", "import", "action", "status", "created", "updated", "modified", "date", "time", "user"]


def categorize(profiled: DataFrame) -> DataFrame:
    """``(column, position, category)`` from column names and the share of distinct values."""
    name = F.lower("column")
    holds = lambda words: name.rlike("|".join(words))
    return profiled.select(
        "column", "position",
        F.when(holds(IDENTIFIER_NAMES) & (F.col("distinct_percentage") > 95), "unique_identifiers")
        .when(holds(BUSINESS_NAMES), "critical_business").when(holds(METADATA_NAMES), "metadata")
        .otherwise("descriptive").alias("category"),
    )


def matrix_key_sets(categories: dict[str, str]) -> list[tuple[str, list[str]]]:
    """Key sets in matching order: single columns, pairs, triples, business keys, full row."""
    named = lambda kind: [c for c, k in categories.items() if k == kind]
    business = named("critical_business")
    important = business + named("descriptive")[:5]
    sets = [(f"Single: {c}", [c]) for c in important]
    sets += [(f"Pair: {a}+{b}", [a, b]) for a, b in combinations(important[:8], 2)]
    sets += [(f"Triple: {a}+{b}+{c}", [a, b, c]) for a, b, c in combinations(important[:6], 3)]
    if business:
        sets.append(("Business Keys", business))
    whole = [c for c in categories if categories[c] != "unique_identifiers"] or list(categories)
    return sets + [("Complete Match", whole)]


def duplicate_matrix(df: DataFrame, key_sets: list[tuple[str, list[str]]]) -> DataFrame:
    """``(_row_id, match_order, matched_by)``: each row under the first key set it repeats on.

    Rows holding a placeholder in a key column are no match for that set.
    """
    shown = lambda k: as_text(df, k)
    # Rows that repeat on a set repeat on all its subsets, so a set behind one of its subsets is nobody's first.
    kept = [(n, keys) for n, (_, keys) in enumerate(key_sets) if not any(set(before) <= set(keys) for _, before in key_sets[:n])]
    # A 128-bit digest of the length-prefixed values stands for the tuple, so one pass covers all sets.
    digest = lambda keys: F.unhex(F.md5(F.concat(*[F.concat(F.char_length(shown(k)).cast("string"), F.lit(":"), shown(k)) for k in keys])))
    present = {n: _all([text.meaningful(shown(k)) for k in keys]) for n, keys in kept}
    keyed = [F.when(present[n], F.struct(F.lit(n).alias("match_order"), digest(keys).alias("digest"))) for n, keys in kept]
    tuples = df.select(ROW_ID, F.explode(F.array_compact(F.array(*keyed))).alias("k")).select(ROW_ID, "k.match_order", "k.digest")
    # A row's sets without those on which it is alone: one row per row of the table meets another.
    single = group_sizes(tuples, ["match_order", "digest"], F.min(ROW_ID).alias(ROW_ID)).where("rows = 1")
    alone = single.groupBy(ROW_ID).agg(F.collect_list("match_order").alias("alone"))
    sets = df.select(ROW_ID, F.array_compact(F.array(*[F.when(present[n], F.lit(n)) for n, _ in kept])).alias("sets"))
    first = F.array_min(F.array_except("sets", F.coalesce("alone", F.array().cast("array<int>"))))
    label = F.element_at(F.array(*[F.lit(name) for name, _ in key_sets]), F.col("match_order") + 1)
    return sets.join(alone, ROW_ID, "left").select(ROW_ID, first.alias("match_order")).where("match_order IS NOT NULL").withColumn("matched_by", label)


def _all(flags: list[Column]) -> Column:
    out = flags[0]
    for flag in flags[1:]:
        out = out & flag
    return out
