"""Whitening against a dense eigendecomposition, exact integers, and odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearthline.llm import whitening

SHAPE = "vec_id long, embedding array<float>"


def plain(vectors, k=16):
    """(n, S, eigenvalues, vectors, trace) of the fit list, by the dense covariance."""
    x = np.array([[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors], object)
    fit = np.unique(x.astype(np.int64), axis=0)
    c = fit - fit.mean(0)
    v = c.T @ c / len(fit)
    e, u = np.linalg.eigh(v)
    return x, len(fit), fit.astype(object).sum(0), e[::-1][:k], u[:, ::-1][:, :k], np.trace(v)


def agrees(out, rows):
    """out against the dense answer for rows (id, vector), all of one length."""
    x, n, sums, e, u, trace = plain([v for _, v in rows])
    k = int((e > 1e-12 * e[0]).sum())
    by_row = {}
    for r in out:
        by_row.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    signs = None
    for (i, _), own in zip(rows, x, strict=True):
        found = by_row[i]
        assert sorted(found) == list(range(1, k + 1))
        want = ((own - sums / n).astype(float) @ u[:, :k]) / np.sqrt(e[:k])
        got = np.array([found[c][0].whitened for c in range(1, k + 1)])
        if signs is None and np.abs(want).min() > 1e-3:
            signs = np.sign(got * want)
        if signs is not None:
            assert np.allclose(got * signs, want, atol=1e-7)
        for c in range(1, k + 1):
            r = found[c][0]
            assert r.n == n and r.deviation == sum(int(d) ** 2 for d in n * own - sums) and r.identity_error < 1e-10
            assert abs(r.explained / (e[c - 1] / trace) - 1) < 1e-10
    assert signs is not None


@pytest.mark.parametrize(("d", "n", "spread"), [(64, 900, 0.0), (64, 700, 3.0), (100, 400, 0.3), (20, 300, 1.0), (3, 50, 0.0), (1, 9, 0.0), (60, 12, 0.5)])
def test_dense(spark, d, n, spread):
    rng = np.random.default_rng(d + n)
    v = (rng.standard_normal((n, d)) * np.exp(-spread * np.arange(d) / 10)).astype(np.float32)
    rows = [(k, [float(c) for c in x]) for k, x in enumerate(v)]
    agrees(whitening.whiten(spark.createDataFrame(rows, SHAPE).repartition(5)).collect(), rows)


def test_filter_against_dense():
    """The iteration alone, on spectra that are flat, steep, gapped, short of rank, or have a far outlier."""
    rng = np.random.default_rng(1)
    for values in (np.linspace(50, 70, 80), np.exp(-np.arange(80) / 4), np.r_[np.full(10, 9.0), np.linspace(1, 2, 70)], np.r_[np.linspace(1, 2, 20), np.zeros(60)], np.r_[1e6, np.linspace(1, 2, 79)], np.r_[np.zeros(1), np.linspace(50, 70, 79)]):
        basis = np.linalg.qr(rng.standard_normal((80, 80)))[0]
        v = (basis * values) @ basis.T
        passes = []
        got, u = whitening.eigenpairs(lambda q: passes.append(1) or v @ q, 80, 16)
        assert np.allclose(got, np.sort(values)[::-1][:16], rtol=1e-10, atol=1e-10 * values.max()) and np.allclose(u.T @ u, np.eye(16), atol=1e-12)
        assert np.linalg.norm(v @ u - u * got, axis=0).max() <= 1e-11 * values.max() and len(passes) < 400


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(c)) for c in rng.standard_normal(20)]) for k in range(60)]
    again = [(100 + k, rows[7][1]) for k in range(40)]
    odd = [(200, None), (201, []), (202, [None] + rows[0][1][1:]), (203, [float("nan")] * 20), (204, [float("inf")] + rows[0][1][1:]), (None, rows[3][1]), (205, [1.0, 2.0]), (206, [1.0, 3.0])]
    df = spark.createDataFrame(rows + again + odd, SHAPE).withColumns({c: F.lit("x") for c in ("x", "c", "n", "component", "deviation", "whitened")})
    out = whitening.whiten(df).collect()
    assert {r.vec_id for r in out} == {k for k, _ in rows + again} | {None, 205, 206}
    agrees([r for r in out if r.vec_id in {k for k, _ in rows + again}], rows + again)
    assert [(r.component, r.n, round(abs(r.whitened), 9), r.explained) for r in out if r.vec_id in (205, 206)] == [(1, 2, 1.0, 1.0)] * 2
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0])], SHAPE)).count() == 0


def test_large_entries(spark):
    """Sums and deviations stay exact where doubles would not; what a bigint can't hold is null."""
    rows = [(k, [float(k * 3 + 2**20), float(-k * k)]) for k in range(30)]
    agrees(whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows)
    wide = [(k, [2.0**50 * k, 1.0]) for k in range(5)]
    assert {r.deviation for r in whitening.whiten(spark.createDataFrame(wide, "vec_id long, embedding array<double>")).collect() if r.vec_id == 0} == {None}
