"""Whitening against a dense eigendecomposition, sums against whole numbers."""

import math

import numpy as np
import pytest

from tallgrass.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows, extra=""):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return df.selectExpr("*", *(f"'x' as {c}" for c in extra.split()))


def slow(rows, components=16):
    """Rows by vec_id and component from a covariance of whole numbers."""
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = [(i, tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)) for i, v in kept]
    fit = np.array(sorted({x for _, x in whole}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((fit * n - sums) / n).astype(float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in whole:
        away = np.array([n * a - s for a, s in zip(x, sums, strict=True)], dtype=object)
        y = (away / n).astype(float) @ vectors
        for k in range(min(components, len(values))):
            if values[k] > 1e-9 * values[0]:
                out.setdefault((i, k + 1), []).append(
                    (n, int((away**2).sum()), y[k] / math.sqrt(values[k]), values[k] / values.sum())
                )
    return out


def compare(got, expected):
    rows = {}
    for r in got:
        rows.setdefault((r.vec_id, r.component), []).append(r)
        assert r.identity_error < 1e-9
    assert rows.keys() == expected.keys()
    signs = {}
    for key, each in rows.items():
        wanted = expected[key]
        assert len(each) == len(wanted)
        for r, (n, deviation, y, explained) in zip(each, wanted, strict=True):
            assert (r.n, r.deviation) == (n, deviation)
            assert r.explained == pytest.approx(explained, rel=1e-9)
            assert abs(r.whitened) == pytest.approx(abs(y), abs=1e-7)
            if abs(y) > 1e-3:
                assert signs.setdefault(key[1], math.copysign(1, y * r.whitened)) == math.copysign(1, y * r.whitened)


def vectors(seed, n, dim):
    pick = np.random.default_rng(seed)
    mix = pick.normal(size=(dim, dim)) * np.linspace(0.2, 2, dim)
    return [(i, [float(c) for c in row]) for i, row in enumerate(pick.normal(size=(n, dim)) @ mix)]


@pytest.mark.parametrize(("n", "dim"), [(300, 20), (40, 5), (7, 12), (2, 3)])
def test_equals_a_dense_decomposition(spark, n, dim):
    rows = vectors(n, n, dim)
    compare(whitening.whitened(table(spark, rows)).collect(), slow(rows))


def test_copies_count_once_and_hard_rows(spark):
    rows = vectors(3, 60, 6)
    rows += [(1000 + k, rows[5][1]) for k in range(40)] + [rows[7], (None, rows[8][1])]
    bad = [(500, None), (501, [None] + [0.0] * 5), (502, [float("nan")] * 6), (503, [0.0] * 5 + [float("inf")])]
    odd = [(600, [1.0, 2.0]), (601, [])]
    got = whitening.whitened(table(spark, rows + bad + odd, "x n component whitened part")).collect()
    compare(got, slow(rows))


def test_no_spread_gives_no_rows(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whitening.whitened(table(spark, rows))
        assert got.columns == [c.split()[0] for c in whitening.OUTPUT_SCHEMA.split(", ")]
        assert got.collect() == []


def test_equal_columns_and_huge_entries(spark):
    rows = [(i, [a, a, b, 0.0]) for i, (_, (a, b)) in enumerate(vectors(5, 50, 2))]
    compare(whitening.whitened(table(spark, rows)).collect(), slow(rows))
    huge = whitening.whitened(table(spark, rows + [(99, [3e38, 0.0, 0.0, -3e38])])).collect()
    assert {r.vec_id for r in huge} == {*range(50), 99}


def test_rank_one_updates_and_merges_equal_numpy():
    pick = np.random.default_rng(1)
    for dim, rows in [(24, pick.normal(size=(200, 24))), (6, pick.integers(-2, 3, (80, 6)).astype(float))]:
        halves = [whitening.Spectrum(dim), whitening.Spectrum(dim)]
        for k, row in enumerate(rows):
            halves[k % 2].add(row)
        halves[0].merge(halves[1])
        scatter = np.cov(rows.T, bias=True) * len(rows)
        got = halves[0]
        assert np.allclose(got.values, np.linalg.eigvalsh(scatter), atol=1e-10 * scatter.max())
        assert np.allclose(got.vectors @ np.diag(got.values) @ got.vectors.T, scatter, atol=1e-10 * scatter.max())
        assert np.allclose(got.vectors.T @ got.vectors, np.eye(dim), atol=1e-12)


def test_secular_roots_with_close_poles():
    poles = np.array([0.0, 1.0, 1.0 + 1e-12, 2.0, 1e6])
    z = np.array([1e-8, 0.5, 0.5, 1.0, 1e-3])
    roots, _ = whitening.secular_roots(poles, z, 3.0)
    dense = np.linalg.eigvalsh(np.diag(poles) + 3.0 * np.outer(z, z))
    assert np.allclose(roots, dense, rtol=1e-9, atol=1e-9)
    assert (np.diff(roots) > 0).all()


def test_sums_do_not_wrap():
    x = np.full((5, 2), 2**62, dtype=np.int64)
    assert whitening._column_sums(x) == [5 * 2**62] * 2
    model = whitening.Whitening(3, [3 * 2**60, 0], np.ones(1), np.ones((2, 1)), 1.0)
    assert model.deviations(np.array([[2**60 + 1, 2], [0, 2**40]], dtype=np.int64)) == [9 + 36, None]
