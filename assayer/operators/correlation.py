"""Correlation of numeric columns."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from assayer.operators.order import running_totals
from assayer.operators.skew import attach
from assayer.schema import NUMERIC, col, columns_of
from assayer.session import cut


def pearson(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_a, column_b, correlation, strong)`` over rows where both values are present.

    One scan. Each task adds up count, means and co-moments of all pairs as matrices over its
    batches; the tasks' sums are combined pair by pair, so no aggregate has a buffer per pair.
    """
    names = list(columns or columns_of(df, NUMERIC))
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double, strong boolean")
    numbers = df.select(*[col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    partial = numbers.mapInArrow(_moments(len(names)), "a int, b int, n double, x double, y double, xx double, yy double, xy double")
    # Sums of squares about a mean combine exactly once the common mean of a pair is known.
    means = partial.groupBy("a", "b").agg(F.sum("n").alias("total"), (F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("mx"), (F.sum(F.col("n") * F.col("y")) / F.sum("n")).alias("my"))
    dx, dy, n = F.col("x") - F.col("mx"), F.col("y") - F.col("my"), F.col("n")
    made = partial.join(means, ["a", "b"]).groupBy("a", "b").agg(
        F.sum(F.col("xx") + n * dx * dx).alias("xx"), F.sum(F.col("yy") + n * dy * dy).alias("yy"), F.sum(F.col("xy") + n * dx * dy).alias("xy"))
    named = F.broadcast(df.sparkSession.createDataFrame([(i, j, names[i], names[j]) for i, j in pairs], "a int, b int, column_a string, column_b string"))
    value = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return named.join(made, ["a", "b"], "left").select("column_a", "column_b", F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0)).alias("correlation")).withColumn(
        "strong", F.abs("correlation") >= 0.8)


def _moments(width: int):
    """Per task and pair: rows with both values, their means and the sums of squares and products about them."""
    def run(batches):
        shape = (width, width)
        n, x, y, xx, yy, xy = (np.zeros(shape) for _ in range(6))
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(width)], axis=1)
            there = ~np.isnan(values)
            present, filled = there.astype(float), np.where(there, values, 0.0)
            shift = filled.sum(axis=0) / np.maximum(present.sum(axis=0), 1)
            filled = np.where(there, values - shift, 0.0)
            m = present.T @ present
            some = np.maximum(m, 1)
            bx, by = filled.T @ present / some, present.T @ filled / some
            bxx, byy = (filled ** 2).T @ present - m * bx ** 2, present.T @ filled ** 2 - m * by ** 2
            bxy = filled.T @ filled - m * bx * by
            bx, by = bx + shift[:, None], by + shift[None, :]
            total = np.maximum(n + m, 1)
            dx, dy, both = bx - x, by - y, n * m / total
            xx, yy, xy = xx + bxx + both * dx * dx, yy + byy + both * dy * dy, xy + bxy + both * dx * dy
            x, y, n = x + dx * m / total, y + dy * m / total, n + m
        a, b = np.triu_indices(width, 1)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(v[a, b]) for v in (n, x, y, xx, yy, xy)]],
                                         names=["a", "b", "n", "x", "y", "xx", "yy", "xy"])
    return run


def spearman(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``(column_a, column_b, correlation, strong)`` of the ranks, average ranks for ties, over rows where both values are present.

    Every column is ranked once: its distinct values are put in order and counted up to each.
    Rows that a partner's nulls remove are counted in the same pass, by partner, so the rank among
    the rows of a pair is a subtraction. The ranks go back to their cells, and the moments of all
    pairs come from one scan of the rows.
    """
    names = list(columns or columns_of(df, NUMERIC))
    pairs = list(combinations(range(len(names)), 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double, strong boolean")
    # NaN is a missing value, and no second zero.
    number = lambda c: F.when(~F.isnan(col(c).cast("double")), col(c).cast("double") + F.lit(0.0))
    rows = cut(df.select(*[number(c).alias(f"c{i}") for i, c in enumerate(names)]).withColumn("row", F.monotonically_increasing_id()))
    there = rows.agg(*[F.count(f"c{i}").alias(f"c{i}") for i in range(len(names))], F.count(F.lit(1)).alias("rows")).first()
    holes = [i for i in range(len(names)) if there[f"c{i}"] < there["rows"]]
    missing = [f"m{j}" for j in holes]
    cell = lambda i: F.when(F.col(f"c{i}").isNotNull(), F.struct(F.lit(i).alias("i"), F.col(f"c{i}").alias("v")))
    cells = rows.select("row", *[F.col(f"c{j}").isNull().cast("bigint").alias(m) for j, m in zip(holes, missing)], F.explode(F.array_compact(F.array(*[cell(i) for i in range(len(names))]))).alias("x"))
    values = cells.groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in missing])
    weights = ["rows", *missing]
    # One order over all columns: what the columns before hold is taken off again.
    totals = running_totals(values, ["i", "v"], weights)
    offset = [0] * len(names)
    for i in range(1, len(names)):
        offset[i] = offset[i - 1] + there[f"c{i - 1}"]
    removed = rows.agg(*[F.sum((F.col(f"c{i}").isNotNull() & F.col(f"c{j}").isNull()).cast("bigint")).alias(f"r{i}_{j}") for i in range(len(names)) for j in holes]).first() if holes else None
    gone = {(i, j): removed[f"r{i}_{j}"] or 0 for i in range(len(names)) for j in holes}
    pick = lambda listed: F.element_at(F.array(*[F.lit(float(x)) for x in listed]), F.col("i") + 1)
    less = lambda w, listed: F.col(f"less_{w}").cast("double") - pick(listed)
    whole = less("rows", offset) + (F.col("rows") + 1) / 2
    ranks = [whole]
    for j, m in zip(holes, missing):
        before = [sum(gone[k, j] for k in range(i)) for i in range(len(names))]
        ranks.append(whole - less(m, before) - F.col(m) / 2)
    ranked = totals.select("i", "v", "rows", F.array(*ranks).alias("ranks"))
    placed = attach(cells.select("row", "x.i", "x.v"), ranked, ["i", "v"]).groupBy("row").agg(F.collect_list(F.struct("i", "ranks")).alias("cells"))   # at most one per column
    centre = [[(there[f"c{a}"] - (gone.get((a, b), 0)) + 1) / 2 for b in range(len(names))] for a in range(len(names))]
    partial = placed.mapInArrow(_rank_moments(len(names), holes, centre), "a int, b int, xx double, yy double, xy double")
    made = partial.groupBy("a", "b").agg(F.sum("xx").alias("xx"), F.sum("yy").alias("yy"), F.sum("xy").alias("xy"))
    named = F.broadcast(df.sparkSession.createDataFrame([(i, j, names[i], names[j]) for i, j in pairs], "a int, b int, column_a string, column_b string"))
    value = F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy")))
    return named.join(made, ["a", "b"], "left").select("column_a", "column_b", F.coalesce(value, F.lit(0.0)).alias("correlation")).withColumn("strong", F.abs("correlation") >= 0.8)


RANK_ROWS = 512             # rows whose ranks are compared at once


def _rank_moments(width: int, holes: list[int], centre: list[list[float]]):
    """Per task and pair: sums of squares and products of the ranks about the mean rank, which is known."""
    def run(batches):
        which = np.zeros(width, int)
        which[holes] = np.arange(1, len(holes) + 1)
        middle = np.array(centre)
        xx, yy, xy = (np.zeros((width, width)) for _ in range(3))
        for batch in batches:
            for at in range(0, batch.num_rows, RANK_ROWS):
                lists = batch.column("cells").slice(at, RANK_ROWS)
                flat = lists.flatten()
                row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
                number = flat.field("i").to_numpy(zero_copy_only=False)
                given = flat.field("ranks").flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
                ranks = np.full((len(lists), width, given.shape[1]), np.nan)
                ranks[row, number] = given
                mine = ranks[:, :, which] - middle                 # of column a among the rows of its pair with b
                theirs = mine.transpose(0, 2, 1)
                both = ~(np.isnan(mine) | np.isnan(theirs))
                x, y = np.where(both, mine, 0.0), np.where(both, theirs, 0.0)
                xx, yy, xy = xx + (x * x).sum(axis=0), yy + (y * y).sum(axis=0), xy + (x * y).sum(axis=0)
        a, b = np.triu_indices(width, 1)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(v[a, b]) for v in (xx, yy, xy)]], names=["a", "b", "xx", "yy", "xy"])
    return run
