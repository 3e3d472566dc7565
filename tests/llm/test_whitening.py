import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, id long, x string, component int, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 7, "x", 2, "n") for r in rows], SCHEMA)


def whole(rows):
    known = [
        (i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    dim = max((len(x) for _, x in known), default=0)
    return [(i, x + [100_000] * (dim - len(x))) for i, x in known]


def check(spark, rows, count=8):
    """Against numpy's eigenvectors; signs are free, deviations exact."""
    known = whole(rows)
    n = len(known)
    x = np.array([v for _, v in known], object)
    sums = x.sum(0)
    exact = [int(((n * v - sums) ** 2).sum()) for v in x]
    centred = np.array([[float(Fraction(int(n * c - s), n)) for c, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:count], vectors[:, ::-1][:, :count]
    k = int((values > 1e-13 * values[0]).sum())
    got = wh.whiten(frame(spark, rows), count=count).collect()
    assert len(got) == n * k
    found = {}
    for r in got:
        assert (r.n, 1 <= r.component <= k) == (n, True) and r.identity_error <= 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-10)
        found.setdefault((r.vec_id, int(r.deviation)), []).append((r.component, r.whitened))
    want = {}
    for (i, _), d, c in zip(known, exact, centred):
        want.setdefault((i, d), []).extend(enumerate((c @ vectors[:, :k]) / np.sqrt(values[:k]), 1))
    assert found.keys() == want.keys()
    for j in range(1, k + 1):
        a, b = ([v for key in want for c, v in sorted(x[key]) if c == j] for x in (found, want))
        sign = np.sign(np.dot(a, b))
        assert np.abs(np.array(a) - sign * np.array(b)).max() < 1e-7


def vectors(rng, n, dim, fall=1.0):
    return [(i, (rng.standard_normal(dim) * np.linspace(1, fall, dim) * 0.1).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim,fall", [(64, 1.0), (64, 0.1), (9, 0.5), (3, 0.5), (1, 1)])
def test_against_numpy(spark, dim, fall):
    check(spark, vectors(np.random.default_rng(dim), 700, dim, fall))


def test_other_count(spark):
    check(spark, vectors(np.random.default_rng(3), 300, 20, 0.3), count=3)


def test_few_vectors_have_few_components(spark):
    check(spark, vectors(np.random.default_rng(4), 5, 30, 0.4))


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    rows = vectors(rng, 200, 6, 0.4)
    rows += [(900, None), (901, [0.1, None, 0.2, 0.1, 0.1, 0.1]), (902, [float("nan")] * 6),
             (903, [float("-inf")] * 6), (904, []), (905, [0.3, -0.2]), (None, [0.1] * 6)]
    rows += rows[:9]  # twice
    check(spark, rows)


def test_large_mean_and_numbers(spark):
    rng = np.random.default_rng(7)
    check(spark, [(i, (rng.standard_normal(5) * [9, 5, 3, 2, 1] + 4000).tolist()) for i in range(300)])
    check(spark, [(i, (rng.standard_normal(4) * [9e5, 5e5, 3e5, 1e5]).tolist()) for i in range(300)])


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.1])], [(1, [0.5]), (2, [0.5])], [(1, None)], [(1, [])]])
def test_no_variance(spark, rows):
    got = wh.whiten(frame(spark, rows))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def matrix(rng, values):
    q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.r_[5, 5, 5, np.ones(60)],  # more than one vector a value
        np.r_[10, 9.9999999, 9.9999998, np.linspace(3, 2.9, 200)],  # close together
        10.0 ** -np.linspace(0, 12, 80),
        np.linspace(2, 1, 400),
        np.r_[1e8, np.linspace(1, 0, 99)],
        np.zeros(30),
    ],
)
def test_solver_reaches_double_precision(values):
    a = matrix(np.random.default_rng(8), np.array(values, float))
    a = (a + a.T) / 2
    got, vecs = wh.leading(lambda u: a @ u, len(a), 8)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:8]
    assert np.abs(got - want).max() <= 1e-13 * max(want[0], 1)
    assert np.abs(a @ vecs - vecs * got).max() <= 2e-13 * max(want[0], 1)
    assert np.abs(vecs.T @ vecs - np.eye(8)).max() < 1e-13


def test_passes_are_bounded(spark):
    rows = frame(spark, vectors(np.random.default_rng(9), 400, 64))
    model = wh.fit(wh.blocks(rows.select(wh.whole(F.col("embedding")).alias("x"))))
    assert model.passes < 80


def test_minres_solves_the_projected_equation(monkeypatch):
    rng = np.random.default_rng(10)
    a = matrix(rng, np.linspace(5, 1, 12))
    q = np.linalg.qr(rng.standard_normal((12, 2)))[0]
    u = wh.against(q, rng.standard_normal((12, 1)))
    u /= np.linalg.norm(u)
    theta = (u.T @ a @ u)[0]
    r = wh.against(np.c_[q, u], a @ u - u * theta)
    monkeypatch.setattr(wh, "INNER", 12)
    t = wh.corrections(lambda x: a @ x, q, theta, u, r)
    left = wh.against(np.c_[q, u], a @ t - theta * t) + r
    assert np.linalg.norm(left) < 1e-9 * np.linalg.norm(r)
