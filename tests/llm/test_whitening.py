"""Whitening against numpy's eigenvectors and whole-number brute force."""

from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, w string, deviation string"


def brute(vectors):
    x = np.floor(64.0 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), [int(v) for v in x.sum(axis=0)]
    deviation = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(n * int(v) - t, n)) for v, t in zip(row, s)] for row in x])
    values, units = np.linalg.eigh(centred.T @ centred / n)
    return deviation, centred, values[::-1], units[:, ::-1]


def rows_of(found):
    out = {}
    for r in found.collect():
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_equals_brute_force(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    given = {r.vec_id: r.embedding for r in table.collect()}
    deviation, centred, values, units = brute(list(given.values()))
    found = rows_of(whitening.op12_whitening(spark, sf_small))
    assert found.keys() == given.keys() and all(sorted(r) == list(range(1, 33)) for r in found.values())
    ours = np.array([[found[i][c].whitened for c in range(1, 33)] for i in given])
    want = centred @ units[:, :32] / np.sqrt(values[:32])
    want *= np.sign((want * ours).sum(axis=0))
    assert np.abs(ours - want).max() < 1e-9
    assert [found[i][1].deviation for i in given] == deviation
    first = next(iter(found.values()))
    assert np.allclose([first[c].explained for c in range(1, 33)], values[:32] / values.sum(), rtol=1e-9)
    assert {r.identity_error for v in found.values() for r in v.values()} == {first[1].identity_error} and first[1].identity_error < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 2.0, 0.5]), (1, [1.0, 2.0, 0.5]), (None, [-3.0, 0.25, 7.0]), (4, [2.0, -1.0, 1.5]), (5, [9.0, 4.0, -6.0])]
    bad = [(6, None), (7, [1.0, None, 2.0]), (8, [nan, 1.0, 2.0]), (9, [1.0, -inf, 2.0]), (10, [1.0, 2.0]), (11, [])]
    frame = spark.createDataFrame([(i, v, None, "x", "y") for i, v in good + bad], SCHEMA).repartition(3)
    found = whitening.whitened(frame).collect()
    assert sorted((str(r.vec_id), r.component) for r in found) == sorted((str(i), c) for i, _ in good for c in (1, 2, 3))
    deviation, *_ = brute([v for _, v in good])
    assert sorted(r.deviation for r in found if r.component == 1) == sorted(deviation)
    assert {r.n for r in found} == {5} and found[0].identity_error < 1e-9


def test_no_rows_and_no_variance(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])]):
        frame = spark.createDataFrame([(i, v, 0, "", "") for i, v in rows], SCHEMA)
        out = whitening.whitened(frame)
        assert out.count() == 0 and out.columns[:3] == ["vec_id", "component", "n"]


def test_directions_without_variance_are_no_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(a), float(b), float(a + b), 1.0], 0, "", "") for i, (a, b) in enumerate(rng.integers(-50, 50, (40, 2)))]
    found = whitening.whitened(spark.createDataFrame(rows, SCHEMA))
    assert found.agg({"component": "max"}).first()[0] == 2 and found.first().identity_error < 1e-9


def test_products_are_exact():
    rng = np.random.default_rng(5)
    for top in (1 << 10, 1 << 30, 1 << 49):
        y = rng.integers(-top, top, (200, 3))
        assert (whitening.exact_products(y) == y.astype(object).T @ y.astype(object)).all()


def test_jacobi_on_the_pivoted_factor():
    rng = np.random.default_rng(6)
    m = rng.standard_normal((30, 12)) * 10.0 ** -np.arange(12)
    v = m.T @ m
    a = whitening.pivoted_cholesky(v)
    assert np.allclose(a @ a.T, v, rtol=1e-12, atol=1e-14 * v.max())
    values, units = whitening.one_sided_jacobi(a)
    assert np.allclose(values[:5], np.linalg.eigvalsh(v)[::-1][:5], rtol=1e-10) and np.abs(units.T @ units - np.eye(len(values))).max() < 1e-12


def test_partitioning_changes_nothing(spark, sf_small):
    table = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    one, many = (rows_of(whitening.whitened(table.repartition(p, "label") if p > 1 else table.coalesce(1))) for p in (1, 5))
    assert all(one[i][c].deviation == many[i][c].deviation and one[i][c].whitened == pytest.approx(many[i][c].whitened, abs=1e-12) for i in one for c in one[i])
