"""Joining the tables of one entity, and references between tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from assayer.schema import col, cols


NULL_SPREAD = 1 << 20


@dataclass(frozen=True)
class EntityTable:
    name: str
    df: DataFrame
    role: str                   # primary, extension or lookup
    join_key: str | None = None


def working_view(tables: list[EntityTable]) -> DataFrame:
    """Primary table left-joined with every extension on its key, multiplicity kept.

    A clashing column gets ``__<table>``. Lookups, and extensions whose key is missing on
    either side, are skipped. A null key matches nothing and is dealt out at random instead of
    meeting in one task; other frequent keys are split by adaptive execution, which both plain
    sides of the join allow. A small extension is broadcast by its measured size only.
    """
    primary = next(t for t in tables if t.role == "primary")
    view = primary.df
    for table in tables:
        key = table.join_key
        if table.role != "extension" or not key or key not in view.columns or key not in table.df.columns:
            continue
        taken = set(view.columns) - {key}
        renamed = table.df.select(*[col(c).alias(f"{c}__{table.name}" if c in taken else c) for c in table.df.columns])
        order = view.columns + [c for c in renamed.columns if c != key]
        unused = "_no_key"
        while unused in order:
            unused += "_"
        # Rows without a key get one of many numbers beside it, which no extension row has.
        spread = F.when(col(key).isNull(), F.pmod(F.xxhash64(*cols(view.columns)), F.lit(NULL_SPREAD)) + 1).otherwise(0).cast("int")
        view = view.withColumn(unused, spread).join(renamed.where(col(key).isNotNull()).withColumn(unused, F.lit(0)), [key, unused], "left").select(*order)
    return view


def orphans(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Child rows whose non-null key has no parent."""
    known = parent.select(col(parent_key).alias(child_key)).distinct()
    return child.where(col(child_key).isNotNull()).join(known, child_key, "left_anti")
