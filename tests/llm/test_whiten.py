"""Whitening against exact integer sums and a plain eigendecomposition, and its solver on clusters."""

import math

import numpy as np
import pytest

from pairmatch.llm.whiten import eigen, whiten

SCHEMA = "vec_id long, embedding array<float>, component string, x int"
NAN, INF = float("nan"), float("inf")


def rows(n=300, d=6, seed=0):
    rng = np.random.default_rng(seed)
    v = (rng.normal(size=(n, d)) * np.linspace(0.2, 3, d)).astype(np.float32)
    return [(i, [float(c) for c in x], "c", 1) for i, x in enumerate(v)]


def brute(vectors, k):
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for v in vectors], dtype=object)
    fit = np.array(sorted(set(map(tuple, x.tolist()))), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s).astype(np.float64) / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    deviation = [int(v) if v < 1 << 63 else None for v in np.square(n * x - s).sum(axis=1)]
    return n, deviation, ((n * x - s).astype(np.float64) / n) @ u / np.sqrt(e), e / np.trace(y.T @ y / n)


def check(spark, data, k=4):
    good = [r for r in data if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    out = whiten(spark.createDataFrame(data, SCHEMA), components=k).collect()
    n, deviation, whitened, explained = brute([r[1] for r in good], k)
    have = {}
    for r in out:
        have.setdefault((r.vec_id, r.deviation, r.component), []).append(r)
    assert len(out) == len(good) * len(explained)
    signs = {}
    for i, g in enumerate(good):
        for c in range(len(explained)):
            r = have[g[0], deviation[i], c + 1].pop()
            assert r.n == n and r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9
            if abs(whitened[i][c]) > 1e-6:
                signs.setdefault(c, set()).add(np.sign(r.whitened * whitened[i][c]))
            assert abs(r.whitened) == pytest.approx(abs(whitened[i][c]), abs=1e-8)
    assert all(len(v) == 1 for v in signs.values())          # one sign for all rows


def test_against_brute_force(spark):
    check(spark, rows())


def test_nulls_repeats_and_values_that_are_not_finite(spark):
    data = rows(60) + rows(60)[:25] + [(None, rows(60)[3][1], None, None), (900, None, "c", 1), (901, [1.0, None] + [0.0] * 4, "c", 1),
                                       (902, [NAN] + [0.0] * 5, "c", 1), (903, [0.0, -INF] + [0.0] * 4, "c", 1), (904, [INF] * 6, "c", 1)]
    check(spark, data)


def test_large_entries_are_exact(spark):
    check(spark, [(i, [c * 30000 for c in v], a, b) for i, v, a, b in rows(80, 3, seed=4)], k=3)


def test_other_lengths_are_dropped(spark):
    data = rows(40) + [(800, [1.0, 2.0], "c", 1), (801, [], "c", 1)]
    out = whiten(spark.createDataFrame(data, SCHEMA)).collect()
    assert {r.vec_id for r in out} == set(range(40))


def test_no_variance(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(1, None, "c", 1)], SCHEMA)).collect() == []
    assert whiten(spark.createDataFrame([(i, [1.0, 2.0], "c", 1) for i in range(5)], SCHEMA)).collect() == []
    flat = whiten(spark.createDataFrame([(i, [float(i), 2.0, float(i)], "c", 1) for i in range(5)], SCHEMA)).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


def test_clashing_names_are_refused(spark):
    df = spark.createDataFrame(rows(5), SCHEMA)
    with pytest.raises(ValueError):
        whiten(df, carry=("vec_id", "component"))
    assert whiten(df, carry=("vec_id", "x")).columns[:2] == ["vec_id", "x"]


def symmetric(values, seed=1):
    """A matrix of these eigenvalues, in extended precision."""
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(3):
        q = q + q @ (np.eye(d, dtype=np.longdouble) - q.T @ q) / 2
    a = (q * np.array(values, dtype=np.longdouble)) @ q.T
    return (a + a.T) / 2, q


@pytest.mark.parametrize("values", [
    np.linspace(100, 1, 40), np.concatenate([[1000, 1000 - 1e-7, 1000 - 2e-7, 999], np.linspace(50, 1, 30)]),
    np.concatenate([500 - 1e-9 * np.arange(10), np.linspace(50, 1, 20)]), np.array([7, 7, 7, 1, 1, 1, 1]), np.zeros(4),
    np.array([5, 4] + [0] * 8), np.array([1e12, 1e6, 1, 0.5, 0.4, 0.3]), np.sort(np.random.default_rng(0).normal(1000, 1e-3, 100))[::-1]])
def test_eigen(values):
    a, _ = symmetric(values)
    got, x = eigen(a)
    size = max(float(np.abs(a).max()), 1e-300)
    assert float(np.abs(a @ x - x * got).max()) < 1e-17 * size * len(values)
    assert float(np.abs(x.T @ x - np.eye(len(values))).max()) < 1e-14
    assert np.allclose(got.astype(float), values, rtol=0, atol=1e-15 * size * len(values))


def test_cluster_vectors_beat_double_precision():
    """Two eigenvalues 1e-7 apart at 1,000: a solver in doubles mixes their vectors, sub-solves do not."""
    values = np.concatenate([[1000, 1000 - 1e-7], np.linspace(50, 1, 20)])
    a, q = symmetric(values)
    off = lambda x: max(float(min(np.abs(x[:, i] - q[:, i]).max(), np.abs(x[:, i] + q[:, i]).max())) for i in (0, 1))
    assert off(eigen(a)[1]) < 1e-8 < off(np.linalg.eigh(a.astype(np.float64))[1][:, ::-1])
