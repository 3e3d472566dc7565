"""The products end to end on written forecasts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pluvia import config, schemas
from pluvia.functions import gamma
from pluvia.operators import consensus as vote
from pluvia.operators import fitting, stations
from pluvia.plans import products
from pluvia.sources import readers, writers

D, T = dt.date, dt.datetime


def forecast(spark, product, issues, n_steps, seed):
    """Gridded forecasts: every cell, rain on some steps."""
    grid = [
        (la, lo, config.GRID_LAT[la - 1], config.GRID_LON360[lo - 1] - 360)
        for la in range(1, 6) for lo in range(1, 8)
    ]
    cells = spark.createDataFrame(grid, "lat_idx int, lon_idx int, lat double, lon double")
    times = spark.createDataFrame([(i,) for i in issues], "issue_ts timestamp_ntz")
    rain = F.greatest(F.rand(seed) * 40 - 28, F.lit(0.0)) / 21600
    return times.join(cells).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1)))).select(
        F.lit(product).alias("product"), F.lit("prate").alias("variable"), "issue_ts",
        F.concat(F.lit("hours since "), F.col("issue_ts").cast("string")).alias("units"),
        "lat_idx", "lon_idx", "lat", "lon", "step", rain.alias("prate"),
    )


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans"))
    hindcast = [T(2009, 6, 1) + dt.timedelta(days=5 * d, hours=6 * h) for d in range(6) for h in range(4)]
    current = [T(2017, 6, 1) + dt.timedelta(hours=6 * h) for h in range(16)]
    writers.forecast(
        forecast(spark, "reforecast", hindcast, 60, 1).unionByName(
            forecast(spark, "realtime", current, 80, 2)
        ),
        f"{path}/forecast",
    )
    rng = random.Random(3)
    names = ["QUINTA NORMAL", "EL YESO", "SAN ANTONIO"]
    obs = spark.createDataFrame(
        [(n, D(2000, 6, 1) + dt.timedelta(days=d), max(rng.gauss(2, 6), 0.0))
         for n in names for d in range(400)],
        schemas.OBS,
    )
    table = spark.createDataFrame(
        [("QUINTA NORMAL", -33.44, -70.68, 520.0, "a"), ("EL YESO", -33.68, -70.09, 2475.0, "b"),
         ("SAN ANTONIO", -33.58, -71.61, 10.0, "c")],
        schemas.STATION,
    )
    cells = spark.createDataFrame(
        [(la - 1 + 3 * (lo - 3), config.GRID_LAT[la - 1], config.GRID_LON360[lo - 1] - 360)
         for lo in (3, 4, 5) for la in (2, 3, 4)],
        schemas.CELL,
    )
    ring = [(-71.8, -34.2), (-69.8, -34.2), (-69.8, -32.9), (-71.0, -33.2)]
    basins = spark.createDataFrame([("MAIPO", [{"x": x, "y": y} for x, y in ring])], schemas.BASIN)
    return path, obs, table, cells, basins


def test_reforecast_then_realtime(spark, inputs):
    path, obs, table, cells, basins = inputs
    products.build_reforecast(spark, f"{path}/forecast", f"{path}/reforecast")
    daily = readers.stage(spark, f"{path}/reforecast/daily")
    assert {r.cell_id for r in daily.select("cell_id").distinct().collect()} == set(range(1, 10))
    pool = readers.stage(spark, f"{path}/reforecast/climatology")
    assert pool.filter("mm <= 0.5 or month <> 6").count() == 0 and pool.count() > 500
    series = readers.stage(spark, f"{path}/reforecast/consensus")
    days = (config.REFORECAST.end - config.REFORECAST.start).days + 1
    assert series.count() == 9 * days
    assert series.filter((F.col("mm") > 0) & (F.col("mm") <= 0.5)).count() == 0

    out, copy = f"{path}/realtime", f"{path}/copy"
    out = products.build_realtime(
        spark, f"{path}/forecast", f"{path}/reforecast", obs, table, cells, basins,
        D(2017, 6, 4), out, copy, first_issue=T(2017, 6, 1), n=2000,
    )
    corrected = readers.stage(spark, f"{out}/stations").collect()
    assert len(corrected) == 3 * 15
    assert all((r.mm == 0) == (r.mm_corrected == 0) for r in corrected)

    # one station by hand: cell, fits of June, map
    near = {r.location: r.cell_id for r in stations.nearest_cell(table, cells).collect()}
    fit = products.fit_all(pool, obs)
    cell = near["QUINTA NORMAL"]
    m = fit.model.filter((F.col("cell_id") == cell) & (F.col("month") == 6)).first()
    o = fit.observed.filter("location = 'QUINTA NORMAL' and month = 6").first()
    wet = [r for r in corrected if r.location == "QUINTA NORMAL" and r.mm > 0]
    hand = gamma.np_quantile_map(
        [r.mm for r in wet], [m.shape] * len(wet), [m.scale] * len(wet), [o.shape] * len(wet),
        [o.scale] * len(wet),
    )
    assert wet and [r.mm_corrected for r in wet] == pytest.approx(list(hand), rel=1e-9)

    for target in (f"{out}/export", copy):
        export = spark.read.csv(target, header=True)
        assert export.count() == 3
        assert export.columns[0] == "location" and export.columns[-3:] == ["lat", "lon", "alt"]
        assert export.columns[1] == "2017-06-01" and len(export.columns) == 19
    assert spark.read.csv(f"{out}/days", header=True).count() == 15

    grids = readers.stage(spark, f"{out}/grids")
    per_day = {r["count"] for r in grids.groupBy("valid_date").count().collect()}
    assert len(per_day) == 1 and grids.select("valid_date").distinct().count() == 15
    by_day = {}
    for r in corrected:
        by_day.setdefault(r.valid_date, []).append(r.mm_corrected)
    for r in grids.groupBy("valid_date").agg(F.min("mm"), F.max("mm")).collect():
        values = by_day[r.valid_date]
        assert min(values) - 1e-9 <= r[1] <= r[2] <= max(values) + 1e-9


def test_station_report_and_scores(spark, inputs):
    path, obs, table, cells, _ = inputs
    near = stations.nearest_cell(table, cells)
    series = vote.consensus(
        products.build_brick(
            spark, f"{path}/forecast", config.REALTIME, f"{path}/brick", first_issue=T(2017, 6, 2)
        ),
        config.REALTIME,
    )
    assert series.agg(F.min("valid_date")).first()[0] == D(2017, 6, 2)
    pool = series.filter("mm > 0.5").select("cell_id", F.month("valid_date").alias("month"), "mm")
    params, curve = products.station_report(pool, obs, near)
    labels = {(r.location, r.month, r.source) for r in params.collect()}
    assert ("EL YESO", 6, "Observado") in labels and ("EL YESO", 6, "Reforecast") in labels
    last = curve.filter("month = 6 and source = 'Observado'").groupBy("location").agg(
        F.max("f").alias("f"), F.min("f").alias("f0")
    )
    assert all(0.9 < r.f <= 1 and r.f0 == 0 for r in last.collect())

    fits = products.Fits(
        model=fitting.gamma_fit(pool, "cell_id", "month", lower=0.5),
        observed=products.fit_all(pool, obs, config.BOUNDS_DASHBOARD).observed,
    )
    corrected = products.station_forecast(table, cells, series, fits)
    truth = corrected.select("location", F.col("valid_date").alias("obs_date"), F.col("mm_corrected").alias("mm"))
    scores, skill, errors = products.station_scores(corrected, truth, D(2017, 6, 1), D(2017, 6, 30))
    for r in scores.collect():
        assert r.n_miss == 0 and r.n_fa == 0 and r.n_hit + r.n_cn > 0
    for r in skill.collect():
        assert r.accuracy == 1.0
    for r in errors.collect():
        assert r.rmse == 0.0


def test_each_run_has_its_own_issues(spark, inputs, tmp_path):
    """A table that accumulates: other months, another variable, and two runs into one folder."""
    path, obs, table, cells, basins = inputs
    march = [T(2017, 7, 3) + dt.timedelta(hours=6 * h) for h in range(4)]
    new = forecast(spark, "realtime", march, 80, 5)
    other = new.withColumns({"variable": F.lit("pmax"), "prate": F.col("prate") + 1.0})
    both = f"{tmp_path}/forecast"
    june = readers.forecast(spark, f"{path}/forecast", "realtime").drop("base_ts", "issue_month")
    writers.forecast(june.unionByName(new).unionByName(other), both)
    products.build_reforecast(spark, f"{path}/forecast", f"{tmp_path}/reforecast")
    runs = {}
    for as_of, first in ((D(2017, 6, 4), T(2017, 6, 1)), (D(2017, 7, 3), T(2017, 7, 3))):
        out = products.build_realtime(
            spark, both, f"{tmp_path}/reforecast", obs, table, cells, basins, as_of,
            f"{tmp_path}/out", first_issue=first, n=300,
        )
        runs[as_of.month] = out
    days = {m: readers.stage(spark, f"{o}/consensus").agg(F.min("valid_date"), F.max("valid_date")).first()
            for m, o in runs.items()}
    assert tuple(days[6]) == (D(2017, 6, 1), D(2017, 6, 15))
    assert tuple(days[7]) == (D(2017, 7, 3), D(2017, 7, 17))
    alone = f"{tmp_path}/alone"
    writers.forecast(new, alone)
    want = products.build_consensus(spark, alone, config.REALTIME, f"{tmp_path}/want")
    got = readers.stage(spark, f"{runs[7]}/consensus")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_run_reads_its_months_only(spark, inputs):
    path, *_ = inputs
    steps = readers.forecast(spark, f"{path}/forecast", "realtime", T(2017, 6, 2), T(2017, 6, 3))
    plan = steps._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :]
    assert "issue_month" in filters and "2017-06" in filters and "product" in filters


def test_verification_end_to_end(spark, inputs, tmp_path):
    path, obs, table, cells, _ = inputs
    products.build_reforecast(spark, f"{path}/forecast", f"{tmp_path}/reforecast")
    recent = obs.withColumn("obs_date", F.date_add("obs_date", 6200))
    found = products.build_verification(
        spark, f"{path}/forecast", f"{tmp_path}/reforecast", obs.unionByName(recent), table, cells,
        str(tmp_path), config.REALTIME, start=D(2017, 6, 1), end=D(2017, 6, 15),
    )
    assert {(r.location, r.month) for r in found.table.collect()} == {
        (s.location, 6) for s in table.collect()
    }
    counted = found.table.select(F.expr("n_hit + n_miss + n_fa + n_cn + n_excluded").alias("n")).collect()
    assert all(0 < r.n <= 15 for r in counted)
    assert found.skill.count() == found.errors.count() == 3
