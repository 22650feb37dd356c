"""Exact quantiles of many large columns without holding a column in one buffer.

Quantile sketches bracket every quantile, ``COLUMNS_PER_PASS`` columns a scan; they are a few
kilobytes each, merge over tasks and days, and may be given from a saved baseline. One more scan
counts the values below each bracket. The few values inside are read exactly: in one aggregate
while they are few, else put in order over all tasks.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from assayer.operators.order import running_totals
from assayer.schema import col

SKETCH = 4096            # size parameter of a sketch, for a rank error of about SLACK
LARGEST = 65_535         # that the sketches allow
SLACK = 0.003
COLUMNS_PER_PASS = 48
BUFFER_VALUES = 500_000  # values inside of all brackets that one aggregate may hold


def _passes(items: list, size: int = COLUMNS_PER_PASS) -> list[list]:
    return [items[at:at + size] for at in range(0, len(items), size)]


def _number(column: str):
    """The column as a double; NaN is a missing value."""
    value = col(column).cast("double")
    return F.when(~F.isnan(value), value)


def sketches(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, n, low, high, sketch)``: mergeable state of each numeric column; the sketch is null without values."""
    out = None
    for names in _passes(columns):
        row = df.agg(*[F.struct(F.lit(c).alias("column"), F.count(_number(c)).alias("n"), F.min(_number(c)).alias("low"), F.max(_number(c)).alias("high"),
                                F.kll_sketch_agg_double(_number(c), min(SKETCH, LARGEST)).alias("sketch")).alias(f"s{i}") for i, c in enumerate(names)])
        rows = row.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(names))]))).withColumn("sketch", F.when(F.col("n") > 0, F.col("sketch")))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else df.sparkSession.createDataFrame([], "column string, n bigint, low double, high double, sketch binary")


def brackets(state: DataFrame, probabilities: list[float]) -> dict[str, tuple[int, float, float, list[tuple[float, float]]]]:
    """Per column: values, smallest, largest and a bracket for each probability; one row a column reaches the driver."""
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(min(1.0, max(0.0, p))))
    ends = [F.struct(at(p - SLACK).alias("a"), at(p + SLACK).alias("b")) for p in probabilities]
    rows = state.where("n > 0").select("column", "n", "low", "high", F.array(*ends).alias("ends")).collect()
    return {r["column"]: (r["n"], r["low"], r["high"], [(e["a"], e["b"]) for e in r["ends"]]) for r in rows}


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], state: DataFrame | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of several numeric columns; nulls and NaN are left out.

    ``state`` are ``sketches`` of the same rows, made before; without them a scan makes them. Only
    rows of scalars, one per column, reach the driver.
    """
    result: dict[str, list[float | None]] = {c: [None] * len(probabilities) for c in columns}
    if not columns:
        return result
    known = brackets(sketches(df, columns) if state is None else state.where(F.col("column").isin(columns)), probabilities)
    jobs = {(c, k): ends[k] for c, (_, _, _, ends) in known.items() for k in range(len(probabilities))}
    sized = _sizes(df, jobs)
    # A sketch is right within its error with high probability only; else the bracket is the whole column.
    for (c, k), (below, inside) in list(sized.items()):
        position = (known[c][0] - 1) * probabilities[k]
        if below > math.floor(position) or below + inside <= math.ceil(position):
            jobs[c, k] = known[c][1:3]
            sized[c, k] = (0, known[c][0])
    ready = {job: (jobs[job], below, inside, (known[job[0]][0] - 1) * probabilities[job[1]]) for job, (below, inside) in sized.items()}
    few = {job: r for job, r in ready.items() if r[2] <= BUFFER_VALUES // 8}
    many = {job: r for job, r in ready.items() if job not in few}
    for job, value in (_aggregated(df, few) | _ordered(df, many)).items():
        result[job[0]][job[1]] = value
    return result


def _sizes(df: DataFrame, jobs: dict) -> dict[tuple[str, int], tuple[int, int]]:
    """Values below and inside of each bracket."""
    out = {}
    for part in _passes(list(jobs.items())):
        row = df.agg(*[e for n, ((c, _), (low, high)) in enumerate(part) for e in (
            F.count_if(_number(c) < low).alias(f"below{n}"), F.count_if(_number(c).between(low, high)).alias(f"inside{n}"))]).first()
        out |= {job: (row[f"below{n}"], row[f"inside{n}"]) for n, (job, _) in enumerate(part)}
    return out


def _aggregated(df: DataFrame, ready: dict) -> dict[tuple[str, int], float]:
    """Quantiles read inside of one aggregate per ``BUFFER_VALUES`` values."""
    out, parts, room = {}, [], 0
    for job, r in ready.items():
        if r[2] > room or len(parts[-1]) >= COLUMNS_PER_PASS:
            parts.append([])
            room = BUFFER_VALUES
        parts[-1].append((job, r))
        room -= r[2]
    for part in parts:
        # Most rows lie in no bracket; they are dropped before the slower aggregate.
        near = F.lit(False)
        for (c, _), ((low, high), *_rest) in part:
            near = near | _number(c).between(low, high)
        row = df.where(near).agg(*[
            F.percentile(F.when(_number(c).between(low, high), _number(c)), F.lit(0.0 if inside <= 1 else min(1.0, max(0.0, (position - below) / (inside - 1))))).alias(f"q{n}")
            for n, ((c, _), ((low, high), below, inside, position)) in enumerate(part)]).first()
        out |= {job: row[f"q{n}"] for n, (job, _) in enumerate(part)}
    return out


def _ordered(df: DataFrame, ready: dict) -> dict[tuple[str, int], float]:
    """Quantiles of large brackets: their distinct values are put in order over all tasks and counted up to each."""
    if not ready:
        return {}
    listed = list(ready.items())
    cell = lambda n, c, low, high: F.when(_number(c).between(low, high), F.struct(F.lit(n).alias("i"), _number(c).alias("v")))
    cells = df.select(F.explode(F.array_compact(F.array(*[cell(n, c, low, high) for n, ((c, _), ((low, high), *_rest)) in enumerate(listed)]))).alias("x"))
    values = cells.groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("rows"))
    # The order runs over all brackets, so the brackets before are taken off.
    before = [0]
    for _, (_, _, inside, _) in listed:
        before.append(before[-1] + inside)
    spots = [(n, before[n] + math.floor(position) - below, before[n] + math.ceil(position) - below) for n, (_, (_, below, _, position)) in enumerate(listed)]
    wanted = F.broadcast(df.sparkSession.createDataFrame(spots, "i int, lower bigint, upper bigint"))
    hit = lambda spot: (F.col("less_rows") <= F.col(spot)) & (F.col(spot) < F.col("less_rows") + F.col("rows"))
    found = running_totals(values, ["i", "v"], ["rows"]).join(wanted, "i").groupBy("i").agg(F.max(F.when(hit("lower"), F.col("v"))).alias("a"), F.max(F.when(hit("upper"), F.col("v"))).alias("b"))
    ends = {r["i"]: (r["a"], r["b"]) for r in found.collect()}
    out = {}
    for n, (job, (_, _, _, position)) in enumerate(listed):
        a, b = ends[n]
        out[job] = a + (b - a) * (position - math.floor(position)) if a != b else a
    return out
