"""Whitening of embeddings through the singular values of the centred rows, never through a product of them.

1. Every entry ``c`` becomes the whole number ``floor(64 c) + 1000000``. The distinct vectors are
   the fit list; their number and sums are exact, and so are the centred rows ``n x - S``.
2. Each task reduces its rows, block by block, to the triangular factor of a QR decomposition.
   The factors are stacked and reduced again, ``FAN`` at a time, until one is left.
3. Householder reflections turn the last factor into an upper bidiagonal matrix ``B``. It has as
   many rows as a vector has entries, whatever the number of vectors is.
4. The differential qd algorithm with shifts (dqds) finds the squares of the singular values of
   ``B`` to high relative accuracy.
5. For each wanted one a twisted factorisation of ``B'B`` less the square gives the vector; the
   reflections carry it back. These are the whitening directions.
6. Every row is projected on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from assayer.session import cut

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
BLOCK = 4096          # rows of one QR decomposition
FAN = 64              # factors that are stacked at once
EPS = float(np.finfo(float).eps)
TINY = float(np.finfo(float).tiny)


@dataclass
class Fit:
    n: int
    sums: np.ndarray         # exact sums of the fit list
    directions: np.ndarray   # one column per component
    variances: np.ndarray    # falling; 0 where the fit list has no extent
    trace: float


def entries(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector has no null and no entry that is null or not finite."""
    value = F.col(f"`{vector}`")
    whole = vectors.where(value.isNotNull() & F.forall(value, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf"))))
    return whole.select(F.col(f"`{key}`").alias("vec_id"), F.transform(value, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("bigint") + F.lit(SHIFT).cast("bigint")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def combined(rows: DataFrame, start: Callable, merge: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int, kind: str) -> np.ndarray | None:
    """One matrix from all ``rows``: ``start`` makes one of each batch, ``merge`` one of two; none for an empty table.

    Every task gives one matrix of ``width`` columns; they are merged ``FAN`` at a time, so that
    neither a task nor the driver ever holds more than ``FAN`` of them.
    """
    dtype = np.dtype(kind)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                made = start(_matrix(batch.column("x").slice(at, BLOCK)))
                state = made if state is None else merge(state, made)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.ascontiguousarray(state, dtype).tobytes()], pa.binary())], names=["block", "state"])

    def stack(frame: pd.DataFrame) -> pd.DataFrame:
        state = None
        for raw in frame.sort_values("block")["state"]:
            made = np.frombuffer(raw, dtype).reshape(-1, width)
            state = made if state is None else merge(state, made)
        return pd.DataFrame({"block": [int(frame["block"].iloc[0]) // FAN], "state": [np.ascontiguousarray(state, dtype).tobytes()]})
    parts = cut(rows.mapInArrow(first, "block bigint, state binary"))
    while True:
        last = parts.agg(F.max("block")).first()[0]
        if last is None:
            return None
        if last == 0:
            return np.frombuffer(parts.first()["state"], dtype).reshape(-1, width)
        parts = cut(parts.groupBy(F.floor(F.col("block") / FAN)).applyInPandas(stack, "block bigint, state binary"))


def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v`` and ``beta`` such that ``x - beta v (v'x)`` has zeros after its first entry."""
    v, norm = x.copy(), float(np.linalg.norm(x))
    if not np.any(x[1:]):
        return v, 0.0
    v[0] += math.copysign(norm, x[0])
    v /= np.abs(v).max()
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of ``U' r V``, and ``V``; ``r`` is square."""
    a, size = r.copy(), len(r)
    v = np.eye(size)
    for k in range(size):
        w, beta = _reflector(a[k:, k])
        if beta:
            a[k:, k:] -= beta * np.outer(w, w @ a[k:, k:])
        if k + 2 < size:
            w, beta = _reflector(a[k, k + 1:])
            if beta:
                a[k:, k + 1:] -= beta * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= beta * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], int]:
    """One dqds transform; the third value tells where it broke off with a negative entry, the length if it did not."""
    last = len(q) - 1
    new_q, new_e, d = [0.0] * len(q), [0.0] * last, q[0] - shift
    for k in range(last):
        if d < 0:
            return new_q, new_e, k
        total = d + e[k]
        new_q[k] = total
        ratio = q[k + 1] / total if total > TINY else 0.0
        new_e[k] = e[k] * ratio
        d = (d * ratio if total > TINY else q[k + 1]) - shift
    new_q[last] = d
    return new_q, new_e, last if d < 0 else last + 1


def squares(diagonal: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling, by dqds.

    The shift is the smaller eigenvalue of the last two rows. It never exceeds the smallest
    square by design of the retries: where the last entry turns negative, the shift less the
    overshoot is safe, elsewhere it is quartered, and without a shift no entry turns negative.
    """
    found, open_parts = [], [([float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in beside], 0.0)] if len(diagonal) else []
    small = EPS * EPS
    while open_parts:
        q, e, moved = open_parts.pop()
        while len(q) > 1:
            if e[-1] <= small * (moved + q[-1]) or e[-1] < TINY:
                found.append(moved + q.pop())
                e.pop()
                continue
            cuts = [k for k in range(len(e) - 1) if e[k] < TINY or e[k] <= small * min(moved + q[k], moved + q[k + 1])]
            if cuts:
                k = cuts[-1]
                open_parts.append((q[:k + 1], e[:k], moved))
                q, e = q[k + 1:], e[k + 1:]
                continue
            above = q[-2] + (e[-3 + 1] if len(e) > 1 else 0.0)
            below, product = q[-1] + e[-1], q[-2] * e[-1]
            half = (above - below) / 2
            shift = max(0.0, below - product / (abs(half) + math.sqrt(half * half + product)) if half >= 0 else above - product / (abs(half) + math.sqrt(half * half + product)))
            for _ in range(4):
                new_q, new_e, reached = _step(q, e, shift)
                if reached == len(q):
                    break
                shift = max(0.0, shift + new_q[-1]) if reached == len(q) - 1 and shift + new_q[-1] > 0 else shift / 4
            else:
                shift = 0.0
                new_q, new_e, _ = _step(q, e, 0.0)
            q, e, moved = new_q, new_e, moved + shift
        found.append(moved + q[0])
    return np.sort(np.maximum(found, 0.0))[::-1]


def _twisted(d: list[float], low: list[float], value: float) -> tuple[np.ndarray, float]:
    """A vector of ``L D L'`` near the eigenvalue ``value``, by the twisted factorisation with the smallest pivot, and its residual's share."""
    n = len(d)
    plus, minus, s, p = [0.0] * (n - 1), [0.0] * (n - 1), [0.0] * n, [0.0] * n
    guard = EPS * max(abs(value), TINY)
    s[0] = -value
    for k in range(n - 1):
        pivot = s[k] + d[k]
        pivot = pivot if abs(pivot) > guard * EPS else math.copysign(guard * EPS or TINY, pivot)
        plus[k] = d[k] * low[k] / pivot
        s[k + 1] = plus[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        pivot = d[k] * low[k] * low[k] + p[k + 1]
        pivot = pivot if abs(pivot) > guard * EPS else math.copysign(guard * EPS or TINY, pivot)
        ratio = d[k] / pivot
        minus[k] = low[k] * ratio
        p[k] = p[k + 1] * ratio - value
    gamma = [s[k] + p[k] + value for k in range(n)]
    twist = min(range(n), key=lambda k: abs(gamma[k]) if math.isfinite(gamma[k]) else math.inf)
    z = np.zeros(n)
    z[twist] = 1.0
    for k in range(twist - 1, -1, -1):
        z[k] = -plus[k] * z[k + 1]
    for k in range(twist, n - 1):
        z[k + 1] = -minus[k] * z[k]
    square = float(z @ z)
    return z / math.sqrt(square), gamma[twist] / square


def _solved(main: np.ndarray, off: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """Solution of the tridiagonal system less ``value``, with tiny pivots kept away from zero."""
    n, guard = len(main), EPS * float(np.abs(main).max())
    pivots, y = np.zeros(n), right.copy()
    for k in range(n):
        pivot = main[k] - value - (off[k - 1] ** 2 / pivots[k - 1] if k else 0.0)
        pivots[k] = pivot if abs(pivot) > guard else math.copysign(guard, pivot)
        if k:
            y[k] -= off[k - 1] / pivots[k - 1] * y[k - 1]
    y[-1] /= pivots[-1]
    for k in range(n - 2, -1, -1):
        y[k] = (y[k] - off[k] * y[k + 1]) / pivots[k]
    return y


def _apart(z: np.ndarray, others: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """``z`` made orthogonal to ``others`` at length one, and the share of its length that was left."""
    length = float(np.linalg.norm(z))
    for _ in range(2):
        for other in others:
            z = z - (other @ z) * other
    left = float(np.linalg.norm(z))
    return z / (left or 1.0), left / (length or 1.0)


def vectors_of(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of ``B'B`` for its largest eigenvalues ``values``, as columns.

    Eigenvalues within a thousandth of each other share a space; there each vector is kept
    orthogonal to those before it, by inverse iteration where nothing of it is left.
    """
    floor = EPS * EPS * float(np.abs(diagonal).max() or 1.0)
    a = np.where(np.abs(diagonal) > floor, diagonal, floor)
    d, low = (a * a).tolist(), (beside / a[:-1]).tolist()
    main, off = a * a + np.append(0.0, beside ** 2), a[:-1] * beside
    random, out = np.random.default_rng(11), []
    for k, value in enumerate(values.tolist()):
        z, shift = _twisted(d, low, value)
        if math.isfinite(shift) and abs(shift) < 1e-3 * value:
            z, _ = _twisted(d, low, value + shift)
        near = [out[j] for j in range(k) if values[j] - value <= 1e-3 * values[j]]
        if not np.isfinite(z).all():
            z = random.standard_normal(len(a))
        for _ in range(5 if near else 0):
            z, left = _apart(z, near)
            z = _solved(main, off, value, z if left > 1e-12 else _apart(random.standard_normal(len(a)), near)[0])
            z /= np.linalg.norm(z)
            rest, left = _apart(z, near)
            if left > 0.5:
                z = rest
                break
        else:
            z = _apart(z, near)[0]
        out.append(z)
    return np.array(out).T.reshape(len(a), len(values))


def whitening(factor: np.ndarray, n: int, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Directions, their variances and the trace of the covariance, from the triangular factor of the ``n`` centred rows."""
    size = factor.shape[1]
    square = np.zeros((size, size))
    square[:len(factor)] = factor[:size]
    scale = float(np.abs(square).max())
    if not scale:
        return np.eye(size)[:, :components], np.zeros(min(size, components)), 0.0
    a, b, v = bidiagonal(square / scale)
    values = squares(a, b)
    count = min(components, size)
    extent = values[:count] > (1e-12 ** 2) * values[0]
    directions = np.zeros((size, count))
    kept = int(extent.sum())
    directions[:, :kept] = v @ vectors_of(a, b, values[:kept])
    return directions, np.where(extent, values[:count], 0.0) * scale * scale / n, float(np.sum(values)) * scale * scale / n


def fit(distinct: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Sums and whitening directions of the fit list; none for an empty one."""
    sizes = distinct.agg(F.count("x"), F.min(F.size("x")), F.max(F.size("x"))).first()
    n, size = sizes[0], sizes[1]
    if not n or not sizes[2]:
        return None
    if size != sizes[2]:
        raise ValueError(f"vectors have between {size} and {sizes[2]} entries")
    sums = combined(distinct, lambda x: x.sum(axis=0, keepdims=True), lambda a, b: a + b, size, "<i8")[0]

    def reduced(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows, mode="r")
    factor = combined(distinct, lambda x: reduced((n * x - sums) / n), lambda a, b: reduced(np.vstack((a, b))), size, "<f8")
    return Fit(n, sums, *whitening(factor, n, components))


def _projected(x: np.ndarray, model: Fit) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(model.variances > 0, ((model.n * x - model.sums) / model.n) @ model.directions / np.sqrt(model.variances), 0.0)


def identity_error(distinct: DataFrame, model: Fit) -> float | None:
    """Largest entry of the whitened fit list's covariance less the identity, over the components with a variance.

    Rows of a state are: count, means, then the sums of products around the means.
    """
    kept = np.flatnonzero(model.variances > 0)
    if not len(kept):
        return None

    def start(x: np.ndarray) -> np.ndarray:
        w = _projected(x, model)[:, kept]
        mean = w.mean(axis=0)
        return np.vstack((np.full((1, len(kept)), float(len(w))), mean, (w - mean).T @ (w - mean)))

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        m, n = a[0, 0], b[0, 0]
        apart = b[1] - a[1]
        return np.vstack((np.full((1, len(kept)), m + n), a[1] + apart * (n / (m + n)), a[2:] + b[2:] + np.outer(apart, apart) * (m * n / (m + n))))
    state = combined(distinct, start, merge, len(kept), "<f8")
    return float(np.abs(state[2:] / state[0, 0] - np.eye(len(kept))).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row per row of ``vectors`` and component.

    Rows with a null vector or an entry that is null or not finite are left out; a null or
    repeated id is kept. ``deviation`` is exact, and null where it exceeds 64 bits. Where the fit
    list has no extent, ``whitened`` is null and ``explained`` 0 (null if it has none at all, as
    with a single vector). Vectors with fewer entries than ``components`` have as many
    components as entries; those of different lengths are an error. Other columns are not read;
    an empty table gives no rows.
    """
    rows = entries(vectors, key, vector)
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    distinct = cut(rows.select("x").distinct())
    model = fit(distinct, components)
    if model is None:
        return vectors.sparkSession.createDataFrame([], schema)
    error, count = identity_error(distinct, model), len(model.variances)
    flat = model.variances == 0
    shares = np.where(flat, 0.0, model.variances / model.trace) if model.trace else np.full(count, np.nan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = _matrix(batch.column("x"))
                apart = model.n * x - model.sums
                over = (apart.astype(float) ** 2).sum(axis=1) > 9.2e18
                m = len(x)
                repeated = np.repeat(np.arange(m), count)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(repeated)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)), pa.array(np.full(m * count, model.n)),
                    pa.array((apart * apart).sum(axis=1)[repeated], mask=over[repeated]), pa.array(_projected(x, model).ravel(), mask=np.tile(flat, m)),
                    pa.array(np.tile(shares, m), mask=np.isnan(np.tile(shares, m))), pa.array([error] * (m * count), pa.float64()),
                ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return rows.mapInArrow(run, schema)
