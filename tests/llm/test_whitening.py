"""Whitening against eigenvectors of the exact covariance."""

import math

import numpy as np
import pytest

from assayer.llm import whitening


def brute(rows, components):
    """Fit by exact sums and numpy's symmetric eigensolver; rows are (id, vector or None)."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[n * c - s for c, s in zip(x, sums)] for x in fit], float) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = float((centred ** 2).sum() / n)
    out = []
    for i, x in kept:
        apart = [n * c - s for c, s in zip(x, sums)]
        out.append((i, n, sum(a * a for a in apart), (np.array(apart, float) / n) @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / trace))
    return out


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(i, v, 1, 5) for i, v in rows], "vec_id long, embedding array<float>, label int, n int").repartition(partitions)


@pytest.mark.parametrize("size,count,partitions", [(24, 300, 3), (5, 200, 70), (40, 25, 2)])
def test_components_equal_those_of_the_covariance(spark, size, count, partitions):
    random = np.random.default_rng(size)
    mix = random.standard_normal((size, size)) * np.logspace(0, -1, size)
    rows = [(k, (random.standard_normal(size) @ mix).tolist()) for k in range(count)]
    rows += [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [None] + rows[0][1][1:]), (902, [float("nan")] + rows[0][1][1:]), (903, [float("-inf")] + rows[0][1][1:])]
    expected = brute(rows, min(size, 16))
    found = whitening.whiten(table(spark, rows, partitions)).collect()
    assert len(found) == len(expected) * min(size, 16)
    kept = min(16, size, count - 1)
    assert {x.n for x in found} == {count} and all(x.identity_error < 1e-9 for x in found)
    by = {}
    for x in found:
        by.setdefault(x.vec_id, {}).setdefault(x.component, x)
    signs = None
    for i, _, deviation, whitened, explained in expected:
        mine = [by[i][c + 1] for c in range(min(size, 16))]
        assert all(x.deviation == deviation for x in mine)
        np.testing.assert_allclose([x.explained for x in mine], explained, rtol=1e-9)
        values = np.array([x.whitened for x in mine])
        if signs is None:
            signs = np.sign(values * whitened)
        np.testing.assert_allclose(values[:kept], (signs * whitened)[:kept], atol=1e-8)


def test_few_and_equal_vectors(spark):
    rows = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(x.n, x.deviation, x.whitened, x.explained, x.identity_error) for x in rows} == {(1, 0, None, None, None)} and len(rows) == 4
    line = whitening.whiten(table(spark, [(1, [0.0, 1.0, 2.0]), (2, [1.0, 1.0, 2.0]), (3, [2.0, 1.0, 2.0])])).orderBy("vec_id", "component").collect()
    assert [(x.component, x.whitened is None, x.explained) for x in line[:3]] == [(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)]
    assert abs(abs(line[0].whitened) - math.sqrt(1.5)) < 1e-12
    empty = table(spark, [(1, None)])
    assert whitening.whiten(empty).count() == 0 and whitening.whiten(empty.limit(0)).columns == whitening.whiten(empty).columns
    assert whitening.whiten(table(spark, [(1, []), (2, [])])).count() == 0
    with pytest.raises(ValueError):
        whitening.whiten(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))
    big = whitening.whiten(table(spark, [(1, [1e8]), (2, [-1e8])])).collect()
    assert {x.deviation for x in big} == {None} and {round(abs(x.whitened), 12) for x in big} == {1.0}


@pytest.mark.parametrize("name", ["graded", "tied", "turned", "close", "hadamard"])
def test_solver_on_hard_spectra(name):
    random = np.random.default_rng(2)
    turned = np.linalg.qr(random.standard_normal((48, 48)))[0]
    hadamard = np.array([[1.0]])
    for _ in range(5):
        hadamard = np.block([[hadamard, hadamard], [hadamard, -hadamard]])
    half = {"graded": random.standard_normal((400, 48)) * np.logspace(-7, 0, 48), "tied": np.eye(48) * (1 + np.arange(48) // 8), "turned": turned, "hadamard": hadamard,
            "close": turned * (1 + 1e-10 * np.arange(48))[:, None]}[name]
    rows = np.vstack((half, -half))
    n = len(rows)
    directions, variances, trace = whitening.whitening(np.linalg.qr(rows, mode="r"), n, 16)
    exact = np.linalg.svd(rows, compute_uv=False) ** 2 / n
    np.testing.assert_allclose(variances, exact[:16], rtol=1e-12)
    assert abs(trace / exact.sum() - 1) < 1e-12
    white = rows @ directions / np.sqrt(variances)
    assert np.abs(white.T @ white / n - np.eye(16)).max() < 1e-12


def test_small_singular_values_are_relatively_accurate():
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([1e-2, 1e-5, 1e-8])
    from fractions import Fraction
    found = whitening.squares(a, b)
    product = np.prod([Fraction(x) ** 2 for x in a.tolist()])
    assert abs(float(np.prod([Fraction(x) for x in found.tolist()]) / product) - 1) < 1e-13   # the determinant, down to 1e-36
