import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvia import config
from pluvia.functions import gamma
from pluvia.operators import correction, fitting, verification


def test_cdf_closed_forms():
    x = np.array([1e-6, 0.1, 1.0, 3.0, 10.0, 30.0, 150.0])
    one = np.ones_like(x)
    assert np.allclose(gamma.np_cdf(x, one, one), 1 - np.exp(-x), atol=1e-13)
    erf = [math.erf(math.sqrt(v)) for v in x]
    assert np.allclose(gamma.np_cdf(x, one / 2, one), erf, atol=1e-12)
    assert np.allclose(gamma.np_cdf(x, 2 * one, 3 * one), 1 - np.exp(-x / 3) * (1 + x / 3), atol=1e-13)
    assert gamma.np_cdf([3.0], [1.0], [1.0])[0] == pytest.approx(0.950212931632, abs=1e-12)
    assert list(gamma.np_cdf([0.0, -1.0, np.inf], [1, 1, 1], [1, 1, 1])) == [0.0, 0.0, 1.0]


def test_quantile_inverts_cdf():
    rng = np.random.default_rng(7)
    shape = np.exp(rng.uniform(np.log(0.05), np.log(80), 20_000))
    scale = np.exp(rng.uniform(-3, 3, 20_000))
    p = rng.uniform(0, 1, 20_000)
    x = gamma.np_quantile(p, shape, scale)
    back = gamma.np_cdf(x, shape, scale)
    assert np.max(np.abs(back - p)[x > 1e-300]) < 1e-11
    assert list(gamma.np_quantile([0, 1], [2, 2], [1, 1])) == [0.0, np.inf]


def test_map_is_identity_for_equal_fits_and_monotone():
    x = np.concatenate([[0.0], np.geomspace(1e-4, 2000, 4000)])
    one = np.ones_like(x)
    same = gamma.np_quantile_map(x, 0.8 * one, 9 * one, 0.8 * one, 9 * one)
    assert same[0] == 0 and np.allclose(same[1:], x[1:], rtol=1e-10)
    other = gamma.np_quantile_map(x, 0.8 * one, 9 * one, 2.5 * one, 4 * one)
    assert np.all(np.diff(other) > 0) and np.all(np.isfinite(other))


def test_map_without_fit_is_missing():
    got = gamma.np_quantile_map([1.0, np.nan, 0.0], [1, 1, np.nan], [1, 1, 1], [1, 1, 1], [1, 1, 1])
    assert got[0] == pytest.approx(1.0) and np.isnan(got[1:]).all()


@pytest.mark.parametrize("k", [0.01, 0.3, 1.0, 2.5, 40.0, 3000.0])
def test_special_functions(spark, k):
    df = spark.createDataFrame([(k,)], "k double")
    row = df.select(
        F.expr(gamma.log_gamma("k")).alias("lg"),
        F.expr(gamma.digamma("k")).alias("d"),
        F.expr(gamma.trigamma("k")).alias("t"),
        F.expr(gamma.digamma("(k + 1D)")).alias("d1"),
        F.expr(gamma.trigamma("(k + 1D)")).alias("t1"),
    ).first()
    assert row.lg == pytest.approx(math.lgamma(k), rel=1e-12, abs=1e-12)
    assert row.d1 - row.d == pytest.approx(1 / k, rel=1e-10)
    assert row.t - row.t1 == pytest.approx(1 / k**2, rel=1e-9)
    step = 1e-5 * k
    slope = (math.lgamma(k + step) - math.lgamma(k - step)) / (2 * step)
    assert row.d == pytest.approx(slope, rel=1e-5, abs=1e-5)


def samples(spark):
    rng = np.random.default_rng(11)
    rows = []
    for key in range(24):
        shape, scale = np.exp(rng.uniform(-1.5, 2.5)), np.exp(rng.uniform(-2, 2.5))
        rows += [(key, float(v)) for v in rng.gamma(shape, scale, 60) + 1e-9]
    return spark.createDataFrame(rows, "key int, mm double"), rows


def likelihood(x, shape, scale):
    n = len(x)
    return (
        (shape - 1) * np.log(x).sum() - x.sum() / scale
        - n * shape * np.log(scale) - n * math.lgamma(shape)
    )


@pytest.mark.parametrize("lower", [0.0, 0.1, 0.5, 2.0])
def test_no_grid_point_beats_the_fit(spark, lower):
    df, rows = samples(spark)
    fits = {r.key: r for r in fitting.gamma_fit(df, "key", lower=lower).collect()}
    on_face = 0
    for key, fit in fits.items():
        x = np.array([v for k, v in rows if k == key])
        best = likelihood(x, fit.shape, fit.scale)
        assert fit.n == 60 and fit.shape >= lower and fit.scale >= lower
        on_face += fit.shape == lower or fit.scale == lower
        low = max(lower, 1e-2)
        for shape in np.geomspace(max(low, fit.shape / 3), max(low, fit.shape) * 3, 41):
            for scale in np.geomspace(max(low, fit.scale / 3), max(low, fit.scale) * 3, 41):
                assert likelihood(x, shape, scale) <= best + 1e-7
    assert (on_face > 0) == (lower >= 0.5)


def test_degenerate_samples_have_no_fit(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0), (2, 3.0), (2, 3.0)], "key int, mm double")
    for lower in (0.0, 0.1):
        got = fitting.gamma_fit(df, "key", lower=lower).collect()
        assert {(r.key, r.n, r.shape, r.scale) for r in got} == {
            (1, 1, None, None), (2, 3, None, None)
        }


def test_fit_ignores_partitions(spark):
    df, _ = samples(spark)
    a, b = (
        {r.key: (r.shape, r.scale) for r in fitting.gamma_fit(d, "key").collect()}
        for d in (df.coalesce(1), df.repartition(9))
    )
    for key in a:
        assert a[key] == pytest.approx(b[key], rel=1e-9)


def test_sample_follows_its_fit_and_repeats(spark):
    params = spark.createDataFrame([(1, 2.0, 5.0)], "key int, shape double, scale double")
    draws = fitting.gamma_sample(params, "key", n=10_000, seed=3)
    row = draws.agg(F.avg("mm").alias("m"), F.var_samp("mm").alias("v"), F.count("*").alias("n"))
    row = row.first()
    assert row.n == 10_000
    assert row.m == pytest.approx(10, rel=0.03) and row.v == pytest.approx(50, rel=0.08)
    again = fitting.gamma_sample(params.repartition(3), "key", n=10_000, seed=3)
    assert draws.exceptAll(again).isEmpty()
    points = verification.ecdf(draws, "key")
    gap = F.max(F.abs(F.col("f") - gamma.gamma_cdf(F.col("mm"), F.lit(2.0), F.lit(5.0))))
    assert points.agg(gap.alias("gap")).first().gap < 0.02


def test_cdf_curve(spark):
    params = spark.createDataFrame(
        [(1, "Observado", 1.0, 1.0)], "key int, source string, shape double, scale double"
    )
    limits = spark.createDataFrame([(1, 0.3)], "key int, max_mm double")
    got = fitting.cdf_curve(params, limits, "key").orderBy("i").collect()
    assert [round(r.x, 9) for r in got] == [0.0, 0.1, 0.2, 0.3]
    assert [r.f for r in got] == pytest.approx([1 - math.exp(-x / 10) for x in range(4)])


def test_quantile_map_uses_the_months_fits(spark):
    import datetime as dt

    series = spark.createDataFrame(
        [("A", 5, dt.date(2024, 1, 31), 2.0), ("A", 5, dt.date(2024, 2, 1), 2.0),
         ("A", 5, dt.date(2024, 2, 2), 0.0), ("B", 5, dt.date(2024, 1, 31), 2.0)],
        "location string, cell_id int, valid_date date, mm double",
    )
    model = spark.createDataFrame(
        [(5, 1, 1.0, 1.0), (5, 2, 1.0, 1.0)], "cell_id int, month int, shape double, scale double"
    )
    observed = spark.createDataFrame(
        [("A", 1, 1.0, 3.0), ("A", 2, 1.0, 5.0)],
        "location string, month int, shape double, scale double",
    )

    def run(month):
        got = correction.quantile_map(series, model, observed, month).collect()
        return {(r.location, r.valid_date.day): r.mm_corrected for r in got}

    assert run(None) == {
        ("A", 31): pytest.approx(6.0), ("A", 1): pytest.approx(10.0), ("A", 2): 0.0,
        ("B", 31): None,
    }
    assert run(1)[("A", 1)] == pytest.approx(6.0)


def test_map_beyond_the_smallest_number():
    """Tails too small for a number still have a quantile, and it keeps rising."""
    x = np.array([700.0, 800.0, 5000.0, 1e5])
    one = np.ones(4)
    same = gamma.np_quantile_map(x, 0.8 * one, one, 0.8 * one, one)
    assert np.allclose(same, x, rtol=1e-9)
    other = gamma.np_quantile_map(x, 0.8 * one, one, 2.0 * one, 3.0 * one)
    assert np.isfinite(other).all() and (np.diff(other) > 0).all()


def test_nan_is_no_rain(spark):
    from pluvia.operators import climatology, consensus, observations, verification

    nan, day = float("nan"), dt.date(2024, 1, 5)
    issue = [dt.datetime(2024, 1, i) for i in (1, 2, 3)]
    rows = [("operational", t, 1, day, mm) for t, mm in zip(issue, (2.0, nan, 0.0))]
    daily = spark.createDataFrame(rows, "product string, issue_ts timestamp_ntz, cell_id int, valid_date date, mm double")
    r = consensus.vote(consensus.last_issues(daily, 12), config.OPERATIONAL).first()
    assert (r.mm, r.n_issues, r.n_wet) == (2.0, 2, 1)
    assert [x.mm for x in climatology.pool(daily).collect()] == [2.0]
    obs = spark.createDataFrame([("a", day, nan), ("a", dt.date(2024, 1, 6), 3.0)], "location string, obs_date date, mm double")
    assert observations.month_wet(obs).count() == 1
    assert observations.maximum(obs, "location").first().max_mm == 3.0
    forecast = obs.withColumnRenamed("obs_date", "valid_date")
    table = verification.contingency(verification.pairs(forecast, obs), "location").first()
    assert (table.n_hit, table.n_excluded) == (1, 1)


def test_merged_sums_fit_like_the_whole_sample(spark, tmp_path):
    rng = random.Random(31)
    rows = [("a" if i % 3 else "b", f"m{i % 7}", rng.gammavariate(0.8, 4.0)) for i in range(3000)]
    rows += [("one", "m1", 2.0), ("equal", "m1", 3.0), ("equal", "m2", 3.0)]
    df = spark.createDataFrame(rows, "key string, load string, mm double")
    path, load = str(tmp_path / "sums"), F.col("load")

    def fits(got):
        return {r.key: (r.n, r.shape, r.scale) for r in got.collect()}

    def same(got, want):
        assert got.keys() == want.keys()
        for k in want:  # no fit is None in both
            assert [x or -1.0 for x in got[k]] == pytest.approx([x or -1.0 for x in want[k]], rel=1e-9), k

    seen = df.limit(0)
    for loads in (["m0", "m1"], ["m2"], ["m3", "m4", "m5"], ["m2", "m0"], ["m6"]):  # some again
        part = df.filter(load.isin(loads))
        fitting.store_sums(part, load, path, "key")
        seen = seen.unionByName(part).distinct()
        for lower in (0.0, 0.9):
            same(fits(fitting.refit(spark, path, "key", lower=lower)),
                 fits(fitting.gamma_fit(seen, "key", lower=lower)))
    fitting.compact_sums(spark, path, str(tmp_path / "one"), "all", "key")
    assert fitting.stored_sums(spark, str(tmp_path / "one")).count() == 4
    same(fits(fitting.refit(spark, str(tmp_path / "one"), "key")), fits(fitting.gamma_fit(df, "key")))
    plan = fitting.refit(spark, path, "key")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "sums" in plan


def test_merged_sums_of_nothing(spark):
    none = spark.createDataFrame([], "key string, mm double")
    sums = fitting.batch_sums(none, F.lit("x"), "key")
    assert fitting.merged(sums, "key").count() == 0
