import math

import numpy as np
import pytest

from logarc.llm.spectrum import eigenvalues_above, leading_eigenpairs
from logarc.llm.whitening import fit_whitening, whiten, whitened_rows

VECTORS = "vec_id long, embedding array<float>, label int, n long, at int, vector string, whitened double"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x", 0.5) for i, v in rows], VECTORS).repartition(parts)


def vectors(n, d, seed=0):
    draw = np.random.default_rng(seed)
    spread = draw.standard_normal((d, d)) * np.linspace(3, 0.2, d)
    return [(i, (draw.standard_normal(d) @ spread).astype(np.float32).tolist()) for i in range(n)]


def brute(rows, dimension, components):
    """x-vectors, deviations, whitened values and shares by numpy's own solver."""
    kept = [(i, v) for i, v in rows if v is not None and len(v) == dimension and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept])
    n, sums = len(x), x.sum(axis=0)
    y = x * n - sums
    centred = y / n
    covariance = centred.T @ centred / n
    values, columns = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:components]
    white = centred @ columns[:, order] / np.sqrt(values[order])
    return [i for i, _ in kept], n, (y.astype(object) ** 2).sum(axis=1), white, values[order] / np.trace(covariance)


def check(found, rows, dimension, components):
    ids, n, deviation, white, shares = brute(rows, dimension, components)
    assert len(found) == len(ids) * components
    # rows are told apart by id and deviation; equal rows have equal values
    place = {(i, d): k for k, (i, d) in enumerate(zip(ids, deviation, strict=True))}
    got = np.full(white.shape, np.nan)
    for r in found:
        assert r.n == n
        got[place[(r.vec_id, r.deviation)], r.component - 1] = r.whitened
        assert abs(r.explained / shares[r.component - 1] - 1) < 1e-9
        assert r.identity_error < 1e-9
    seen = ~np.isnan(got[:, 0])
    assert seen.sum() == len(place)
    signs = np.sign((got[seen] * white[seen]).sum(axis=0))
    assert np.abs(got[seen] * signs - white[seen]).max() < 1e-7


def test_values_are_those_of_a_plain_solver(spark):
    rows = vectors(300, 20)
    check(whitened_rows(frame(spark, rows), components=8).collect(), rows, 20, 8)


def test_awkward_rows(spark):
    good = vectors(80, 6, seed=2)
    rows = [*good, *good[:5], (None, good[3][1]), (3, None), (4, [])]
    rows += [(100, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (101, [float("nan")] * 6), (102, [float("inf")] + [0.0] * 5), (103, [1.0] * 5)]
    check(whitened_rows(frame(spark, rows), components=4).collect(), rows, 6, 4)


def test_fewer_dimensions_than_components_and_constant_ones(spark):
    rows = [(i, [*v, 0.25]) for i, v in vectors(50, 3, seed=4)]
    found = whitened_rows(frame(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2, 3}
    check(found, rows, 4, 3)


def test_tables_without_vectors(spark):
    for rows in ([], [(1, None), (2, [])]):
        found = whitened_rows(frame(spark, rows))
        assert found.collect() == []
        assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_equal_vectors_have_no_component(spark):
    assert whitened_rows(frame(spark, [(i, [0.5, 0.25]) for i in range(9)])).collect() == []


def test_sums_beyond_64_bits_stay_exact(spark):
    rows = [(0, [1e8, 0.0]), (1, [-1e8, 0.5]), (2, [3e8, 0.0])] * 40
    model = fit_whitening(frame(spark, rows))
    found = {r.vec_id: int(r.deviation) for r in whiten(frame(spark, rows), model).collect()}
    _, _, exact, _, _ = brute(rows, 2, 1)
    assert [found[i] for i in range(3)] == [int(v) for v in exact[:3]]
    assert max(found.values()) > 1 << 63
    assert {r.deviation for r in whitened_rows(frame(spark, rows)).filter("vec_id = 2").collect()} == {None}


@pytest.mark.parametrize("seed", range(6))
def test_counts_are_those_of_the_eigenvalues(seed):
    draw = np.random.default_rng(seed)
    a = draw.standard_normal((17, 17))
    a = a + a.T
    if seed % 2:
        np.fill_diagonal(a, 0.0)  # pivots of two rows
    values = np.linalg.eigvalsh(a)
    for shift in [*((values[1:] + values[:-1]) / 2), -99.0, 99.0, 0.0]:
        assert eigenvalues_above(a, float(shift)) == (values > shift).sum()


def test_close_and_equal_eigenvalues():
    q, _ = np.linalg.qr(np.random.default_rng(1).standard_normal((12, 12)))
    wanted = np.array([9.0, 9.0, 9.0 - 1e-9, 4.0, 4.0 - 1e-13, 1.0, 1.0, 0.5, 1e-3, 1e-9, 0.0, 0.0])
    a = (q * wanted) @ q.T
    values, columns = leading_eigenpairs((a + a.T) / 2, 12)
    assert len(values) >= 10
    assert np.abs(values - wanted[: len(values)]).max() < 1e-13
    assert np.abs(columns.T @ columns - np.eye(len(values))).max() < 1e-12
    assert np.abs(a @ columns - columns * values).max() < 1e-13
