import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pluvia import config, schemas
from pluvia.operators import climatology, consensus, daily, manifest
from pluvia.sources import readers, writers

D = dt.date
T = dt.datetime


def steps(spark, rows):
    """(issue, cell, step, mm of the step)"""
    df = spark.createDataFrame(
        [(T.fromisoformat(i), c, s, None if mm is None else mm / 21600) for i, c, s, mm in rows],
        "issue_ts timestamp_ntz, cell_id int, step int, prate double",
    )
    return df


def totals(spark, rows, product=config.OPERATIONAL, **options):
    got = daily.daily_totals(steps(spark, rows), product, **options).collect()
    return {(r.issue_ts, r.cell_id, r.valid_date): r.mm for r in got}


def test_days_are_sums_of_local_steps(spark):
    rows = [("2012-07-10 00:00:00", 1, s, 1.0) for s in range(10)]
    got = totals(spark, rows)
    issue = T(2012, 7, 10)
    # shift 18 h: steps 0-2 fall on the 9th, 3-6 on the 10th, 7-9 on the 11th
    assert {k[2].day: round(v, 9) for k, v in got.items()} == {9: 3.0, 10: 4.0, 11: 3.0}
    assert all(k[0] == issue for k in got)


def test_missing_step_makes_the_day_null(spark):
    rows = [("2012-07-10 00:00:00", 1, s, None if s == 1 else 1.0) for s in range(7)]
    got = {k[2].day: v for k, v in totals(spark, rows).items()}
    assert got[9] is None and round(got[10], 9) == 4.0


def test_placement_by_issue_hour(spark):
    rows = [(f"2000-01-10 {h}:00:00", 1, 0, 1.0) for h in ("00", "12", "18")]
    product = config.REFORECAST
    by_time = {k[0].hour: k[2].day for k in totals(spark, rows, product)}
    by_hour = {
        k[0].hour: k[2].day for k in totals(spark, rows, product, placement="issue_hour")
    }
    assert by_time == {0: 9, 12: 10, 18: 10}
    assert by_hour == {0: 9, 12: 9, 18: 10}
    with pytest.raises(ValueError):
        totals(spark, rows, product, placement="other")


def grid_rows(spark, issues=("2012-07-10 00:00:00",), n_steps=4, product="operational"):
    lon = [v - 360 for v in config.GRID_LON360]
    rows = [
        (product, "prate", T.fromisoformat(i), f"hours since {i}", la, lo, config.GRID_LAT[la - 1],
         lon[lo - 1], s, (10 * la + lo) / 21600)
        for i in issues for la in range(1, 6) for lo in range(1, 8) for s in range(n_steps)
    ]
    return spark.createDataFrame(rows, schemas.FORECAST_6H)


def test_inner_cells_of_the_file_grid(spark):
    inner = daily.subgrid(grid_rows(spark, n_steps=1)).collect()
    assert sorted(r.cell_id for r in inner) == list(range(1, 10))
    centre = next(r for r in inner if r.cell_id == 5)
    assert (centre.lat_idx, centre.lon_idx) == (3, 4)
    assert abs(centre.lat + 33.54318) < 1e-9 and abs(centre.lon + 71.096) < 1e-9


def test_crop_keeps_the_whole_axis(spark):
    df = grid_rows(spark, n_steps=1)
    assert daily.crop(df).count() == 35
    assert daily.crop(df, (-72.1, -70.0, -34.0, -32.0)).count() == 3 * 2


def test_scan_pushes_cell_and_folders(spark, tmp_path):
    path = str(tmp_path / "forecast")
    both = grid_rows(spark, ("2012-07-10 00:00:00", "2012-09-01 06:00:00")).unionByName(
        grid_rows(spark, ("2012-07-10 00:00:00",), product="realtime")
    )
    writers.forecast(both, path)
    df = readers.forecast(
        spark, path, "operational", T(2012, 8, 1), T(2012, 9, 30)
    )
    cell = daily.slice_cell(daily.of_variable(df, "prate"), 2, 4).select("step", "prate")
    assert cell.count() == 4
    assert daily.of_variable(df, "pmax").count() == 0
    plan = cell._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    for text in ("EqualTo(lat_idx,2)", "EqualTo(lon_idx,4)", "GreaterThanOrEqual(issue_ts"):
        assert text in scan
    partitions = scan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "product" in partitions and "issue_month" in partitions
    assert "units" not in scan.split("ReadSchema")[1]


def test_axes(spark):
    got = readers.axes(grid_rows(spark))
    assert got.count() == 35
    lat = {r.lat_idx: r.lat for r in got.collect()}
    assert tuple(lat[i] for i in range(1, 6)) == config.GRID_LAT


def test_lengths_and_axes(spark):
    rows = [("2012-07-10 00:00:00", c, s, 1.0) for c in (1, 2) for s in range(10)]
    rows += [("2012-07-10 06:00:00", 1, s, 1.0) for s in range(3)]
    df = daily.daily_totals(steps(spark, rows), config.OPERATIONAL)
    stats = daily.issue_length_stats(df).first()
    assert (stats.min_days, stats.max_days, stats.n_issues) == (2, 3, 2)
    axis = daily.day_axis(df).first()
    assert (axis.first_day, axis.last_day, axis.n_days) == (D(2012, 7, 9), D(2012, 7, 11), 3)
    spine = [r.valid_date for r in daily.day_spine(df).orderBy("valid_date").collect()]
    assert spine == [D(2012, 7, d) for d in (8, 9, 10, 11)]
    listed = daily.issue_span_axis(df.select("issue_ts")).first()
    assert (listed.first_day, listed.n_days) == (D(2012, 7, 9), 500)


def test_brick_wide(spark):
    rows = [("2012-07-10 00:00:00", 1, s, 1.0) for s in range(5)]
    rows += [("2012-07-10 18:00:00", 1, s, 2.0) for s in range(1)]
    df = daily.daily_totals(steps(spark, rows), config.OPERATIONAL)
    long = {(r.issue_column, r.day_index): round(r.mm, 9) for r in daily.brick(df).collect()}
    assert long == {("2012_07_1000", 1): 3.0, ("2012_07_1000", 2): 2.0, ("2012_07_1018", 2): 2.0}
    wide = daily.brick_wide(df, ["2012_07_1000", "2012_07_1018"]).orderBy("valid_date").collect()
    assert [r["2012_07_1018"] for r in wide] == [None, pytest.approx(2.0)]


def forecasts(spark, values, day=D(2012, 7, 20), product="operational"):
    """One daily value per issue, oldest first, six hours apart."""
    first = T(2012, 7, 1)
    rows = [
        (product, first + dt.timedelta(hours=6 * i), 1, day, v) for i, v in enumerate(values)
    ]
    return spark.createDataFrame(rows, schemas.FORECAST_DAILY)


@pytest.mark.parametrize(
    "product, values, expected, n, wet",
    [
        (config.OPERATIONAL, [1.0, 3.0, 0.0], 2.0, 3, 2),
        (config.OPERATIONAL, [0.0] * 8 + [4.0, 4.0], 4.0, 10, 2),
        (config.OPERATIONAL, [0.0] * 9 + [4.0, 4.0], 0.0, 11, 2),
        (config.REALTIME, [0.0] * 9 + [2.0] * 3, 0.0, 12, 3),
        (config.REALTIME, [0.0] * 8 + [2.0] * 4, 2.0, 12, 4),
        (config.REFORECAST, [9.0] + [0.0] * 12, 0.0, 12, 0),
        (config.REFORECAST, [0.0, 4.0], 4.0, 2, 1),
        (config.REFORECAST, [0.5, 0.5], 0.0, 2, 0),
        (config.REFORECAST, [7.0, None, None], 7.0, 1, 1),
    ],
)
def test_consensus_edges(spark, product, values, expected, n, wet):
    day = D(2012, 7, 20)
    row = consensus.consensus(
        forecasts(spark, values, product=product.name), product, day, day
    ).first()
    assert (row.mm, row.n_issues, row.n_wet) == (expected, n, wet)


def test_days_without_forecast_are_zero(spark):
    df = forecasts(spark, [5.0])
    got = consensus.consensus(df, config.OPERATIONAL, D(2012, 7, 19), D(2012, 7, 21))
    rows = {r.valid_date.day: (r.mm, r.n_issues) for r in got.collect()}
    assert rows == {19: (0.0, 0), 20: (5.0, 1), 21: (0.0, 0)}
    cells = spark.createDataFrame([(1,), (2,)], "cell_id int")
    got = consensus.consensus(
        df, config.OPERATIONAL, D(2012, 7, 20), D(2012, 7, 20), cells=cells
    )
    assert {r.cell_id: r.mm for r in got.collect()} == {1: 5.0, 2: 0.0}


def test_consensus_of_a_hot_cell_equals_brute_force(spark):
    rng = random.Random(8)
    first = T(2012, 7, 1)
    rows = []
    for i in range(60):
        for cell, days in ((1, 40), (2, 6), (3, 6), (4, 6)):  # most rows in one cell
            for d in range(days):
                mm = rng.choice([None, 0.0, 0.5, 0.6, rng.uniform(0, 20), rng.uniform(0, 2)])
                issue = first + dt.timedelta(hours=6 * i)
                rows.append(("realtime", issue, cell, issue.date() + dt.timedelta(days=d), mm))
    df = spark.createDataFrame(rows, schemas.FORECAST_DAILY).repartition(7)
    start, end = D(2012, 7, 1), D(2012, 9, 15)
    for product in (config.REFORECAST, config.OPERATIONAL, config.REALTIME):
        named = df.withColumn("product", F.lit(product.name))
        got = {
            (r.cell_id, r.valid_date): (r.mm, r.n_issues, r.n_wet)
            for r in consensus.consensus(named, product, start, end).collect()
        }
        assert len(got) == 4 * 77
        for (cell, day), (mm, n, n_wet) in got.items():
            values = [
                (r[1], r[4]) for r in rows if r[2] == cell and r[3] == day and r[4] is not None
            ]
            last = [v for _, v in sorted(values)[-12:]]
            wet = [v for v in last if v > 0.5]
            ratio = {"reforecast": 2, "operational": 5, "realtime": 3.33}[product.name]
            expected = sum(wet) / len(wet) if wet and len(wet) / len(last) >= 1 / ratio else 0.0
            assert (n, n_wet) == (len(last), len(wet)) and mm == pytest.approx(expected)


def test_realtime_range_starts_at_first_issue(spark):
    df = forecasts(spark, [5.0], day=D(2012, 7, 3), product="realtime")
    days = sorted(r.valid_date for r in consensus.consensus(df, config.REALTIME).collect())
    assert (days[0], days[-1], len(days)) == (D(2012, 7, 1), D(2012, 7, 15), 15)


def test_consensus_ignores_row_order_and_partitions(spark):
    values = [float(i % 5) for i in range(40)]
    df = forecasts(spark, values)
    day = D(2012, 7, 20)
    got = {
        tuple(consensus.consensus(d, config.OPERATIONAL, day, day).first())
        for d in (df, df.orderBy(F.rand(3)).repartition(7), df.coalesce(1))
    }
    assert len(got) == 1


def test_last_issues_are_cut_before_the_shuffle(spark):
    plan = consensus.last_issues(forecasts(spark, [1.0]), 12)
    text = plan._jdf.queryExecution().executedPlan().toString()
    final, partial = text.split("Exchange", 1)
    assert "WindowGroupLimit" in final and "WindowGroupLimit" in partial


def test_union_products(spark):
    day = D(2012, 7, 20)
    parts = [
        consensus.consensus(forecasts(spark, [3.0], product=p.name), p, day, day)
        for p in (config.REFORECAST, config.OPERATIONAL)
    ]
    got = consensus.union_products(*parts).collect()
    assert sorted(r.product for r in got) == ["operational", "reforecast"]


def test_climatology_pool(spark):
    rows = [
        ("reforecast", T(2000, 1, 30), 1, D(2000, 1, 31), 4.0),
        ("reforecast", T(2000, 1, 30), 1, D(2000, 2, 1), 4.0),  # other month
        ("reforecast", T(1999, 1, 5), 1, D(2000, 1, 2), 8.0),  # same month of another year
        ("reforecast", T(2000, 1, 30), 1, D(2000, 1, 30), 0.5),  # not wet
        ("reforecast", T(2000, 1, 30), 1, D(2000, 1, 29), None),
    ]
    df = spark.createDataFrame(rows, schemas.FORECAST_DAILY)
    got = sorted((r.cell_id, r.month, r.mm) for r in climatology.pool(df).collect())
    assert got == [(1, 1, 4.0), (1, 1, 8.0)]


def test_manifest(spark):
    ids = ["2012070100", "2012070106", "2012070300"]
    issues = spark.createDataFrame([(i,) for i in ids], "issue_id string").withColumn(
        "issue_ts", F.to_timestamp_ntz("issue_id", F.lit("yyyyMMddHH"))
    )
    found = spark.createDataFrame([(ids[1],)], "issue_id string")
    assert [r.issue_id for r in manifest.present(issues, found).collect()] == [ids[1]]
    assert {r.issue_id for r in manifest.missing(issues, found).collect()} == {ids[0], ids[2]}
    order = {r.issue_id: r.ordinal for r in manifest.issue_ordinal(issues).collect()}
    assert order == dict(zip(ids, (1, 2, 3)))
    gaps = manifest.gap_report(issues).orderBy("issue_date").collect()
    assert [(r.offset, r.n_issues, r.n_missing) for r in gaps] == [(0, 2, 2), (1, 0, 4), (2, 1, 3)]
    assert [r.issue_id for r in manifest.manifest_slice(issues, 2, 3).collect()] == ids[1:]
    offsets = issues.select(
        manifest.day_offset(F.col("issue_ts"), F.lit("2012-07-01").cast("timestamp_ntz")).alias("d")
    )
    assert sorted(r.d for r in offsets.collect()) == [0, 0, 2]


def test_index_page_to_urls(spark):
    html = '<a href="/parent/">..</a><a href="cfs.20170601/">a</a><a href="cfs.20170602/">b</a>'
    pages = spark.createDataFrame([(1, html)], "page int, html string")
    got = manifest.realtime_manifest(manifest.folder_links(pages, "page"), base="u/").collect()
    assert len(got) == 8
    assert "u/cfs.20170602/18/time_grib_01/prate.01.2017060218.daily.grb2" in {r.url for r in got}
