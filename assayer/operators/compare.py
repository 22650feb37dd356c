"""Cell-by-cell comparison of two versions of a table, matched by row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from assayer import ROW_ID
from assayer.operators.order import numbered
from assayer.operators.values import union_all
from assayer.schema import as_text, col, data_columns, families
from assayer.session import cut

COLUMNS_PER_PASS = 24       # compared in one join and one aggregate


def common_columns(before: DataFrame, after: DataFrame) -> list[str]:
    """Shared columns that can be compared; a cell of a nested type is compared by its JSON text."""
    return sorted(set(data_columns(before)) & set(data_columns(after)))


def _side(df: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    fams = families(df)
    value = lambda c: F.to_json(F.struct(col(c))) if fams[c] == "other" else col(c)
    return df.select(ROW_ID, F.lit(True).alias(f"{prefix}_in"), *[value(c).alias(f"{prefix}_{c}") for c in columns])


def passes(names: list[str]) -> list[list[str]]:
    return [names[at:at + COLUMNS_PER_PASS] for at in range(0, len(names), COLUMNS_PER_PASS)]


def paired(before: DataFrame, after: DataFrame, how: str = "full_outer", columns: list[str] | None = None) -> DataFrame:
    """Rows of both versions side by side: ``b_<column>``, ``a_<column>``, ``b_in``, ``a_in``."""
    names = common_columns(before, after) if columns is None else columns
    return _side(before, "b", names).join(_side(after, "a", names), ROW_ID, how)


def _differs(column: str) -> Column:
    return ~col(f"b_{column}").eqNullSafe(col(f"a_{column}"))


def membership_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows in both versions, only in the first and only in the second."""
    joined = paired(before.select(ROW_ID), after.select(ROW_ID))
    return joined.agg(
        F.count_if(F.col("b_in") & F.col("a_in")).alias("matched"),
        F.count_if(F.col("a_in").isNull()).alias("only_before"), F.count_if(F.col("b_in").isNull()).alias("only_after"),
    )


def stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: sizes, column changes and modified cells of the rows present in both."""
    names = common_columns(before, after)
    old, new = data_columns(before), data_columns(after)
    both = F.col("b_in") & F.col("a_in")
    parts = None
    for part in passes(names) or [[]]:
        # Only the pass's columns are joined; rows are counted in the first pass.
        cells = sum((F.count_if(both & _differs(c)) for c in part), F.lit(0))
        rows = [F.count("b_in"), F.count("a_in")] if parts is None else [F.lit(0).cast("bigint")] * 2
        row = paired(before, after, columns=part).agg(rows[0].alias("original_rows"), rows[1].alias("modified_rows"), cells.cast("bigint").alias("modified_cells"))
        parts = row if parts is None else parts.unionByName(row)
    row = parts.agg(*[F.sum(c).alias(c) for c in ("original_rows", "modified_rows", "modified_cells")])
    return row.select(
        "original_rows", "modified_rows", (F.col("modified_rows") - F.col("original_rows")).alias("row_change"),
        F.lit(len(old)).alias("original_columns"), F.lit(len(new)).alias("modified_columns"),
        F.lit(len(new) - len(old)).alias("column_change"), "modified_cells",
        F.lit(",".join(names)).alias("common_columns"),
        F.lit(",".join(c for c in new if c not in old)).alias("columns_added"),
        F.lit(",".join(c for c in old if c not in new)).alias("columns_removed"),
    )


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per changed column: cells changed, cleared, filled, equal after case folding, and the type."""
    names = common_columns(before, after)
    rows = [_changes_of(before, after, part) for part in passes(names)]
    if not rows:
        return before.sparkSession.createDataFrame([], "column string, changed bigint, nulled bigint, filled bigint, standardised bigint, change_type string")
    rows = union_all(rows).where("changed > 0")
    n, std = F.col("changed"), F.col("standardised")
    kind = (
        F.when(F.col("nulled") == n, "Cleared").when(F.col("filled") == n, "Backfilled").when(std == n, "Standardised")
        .when(std > n / 2, "Standardised (mostly)").otherwise("Modified")
    )
    return rows.withColumn("change_type", kind).orderBy(n.desc(), "column")


def _changes_of(before: DataFrame, after: DataFrame, names: list[str]) -> DataFrame:
    joined = paired(before, after, "inner", names)
    aggregates = []
    for i, c in enumerate(names):
        b, a = col(f"b_{c}"), col(f"a_{c}")
        folded = F.lower(b.cast("string")) == F.lower(a.cast("string"))
        aggregates.append(F.struct(
            F.lit(c).alias("column"), F.count_if(_differs(c)).alias("changed"),
            F.count_if(b.isNotNull() & a.isNull()).alias("nulled"), F.count_if(b.isNull() & a.isNotNull()).alias("filled"),
            F.count_if(_differs(c) & F.coalesce(folded, F.lit(False))).alias("standardised"),
        ).alias(f"c{i}"))
    return joined.agg(*aggregates).select(F.inline(F.array(*[col(f"c{i}") for i in range(len(names))])))


def change_samples(before: DataFrame, after: DataFrame, k: int = 3) -> DataFrame:
    """First ``k`` changed cells of every column: ``(column, _row_id, before, after)``."""
    joined = paired(before, after, "inner")
    cell = lambda c: F.when(_differs(c), F.struct(F.lit(c).alias("column"), col(f"b_{c}").cast("string").alias("before"), col(f"a_{c}").cast("string").alias("after")))
    changed = joined.select(ROW_ID, F.explode(F.array_compact(F.array(*[cell(c) for c in common_columns(before, after)]))).alias("x"))
    # The limit per column also runs before the shuffle.
    order = Window.partitionBy("column").orderBy(ROW_ID)
    return changed.select("x.column", ROW_ID, "x.before", "x.after").withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def page_index(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(_row_id, _place)``: the row ids of both versions with their places, as a table sorted by place.

    Made once for any number of pages; a page then reads the row groups that hold its places.
    """
    ids = before.select(ROW_ID).unionByName(after.select(ROW_ID)).distinct()
    return cut(numbered(ids, [ROW_ID], "_place"))


def cell_diff(before: DataFrame, after: DataFrame, columns: list[str], start: int, rows: int, index: DataFrame | None = None) -> DataFrame:
    """A window of the union of row ids, one row per cell: row status and cell flag.

    ``index`` is the ``page_index`` of the two versions; without one it is made for this page.
    """
    old, new = data_columns(before), data_columns(after)
    names = [c for c in columns if c in old or c in new]
    places = index if index is not None else page_index(before, after)
    ids = places.where((F.col("_place") >= start) & (F.col("_place") < start + rows)).select(ROW_ID)   # at most ``rows`` ids
    side = lambda df, prefix, present: df.select(ROW_ID, F.lit(True).alias(f"{prefix}_in"), *[
        (as_text(df, c) if c in present else F.lit(None).cast("string")).alias(f"{prefix}_{c}") for c in names])
    window = F.broadcast(ids)
    joined = side(before, "b", old).join(window, ROW_ID, "left_semi").join(side(after, "a", new).join(window, ROW_ID, "left_semi"), ROW_ID, "full_outer")
    status = F.when(F.col("a_in").isNull(), "removed").when(F.col("b_in").isNull(), "added").otherwise("normal")
    flag = lambda c: F.when(status != "normal", status).when(_differs(c), "modified")
    return joined.select(ROW_ID, status.alias("row_status"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), col(f"b_{c}").alias("original"), col(f"a_{c}").alias("modified"), flag(c).alias("cell_flag")) for c in names
    ])))
