import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from pluvia import schemas
from pluvia.sources import readers, writers

D, T = dt.date, dt.datetime


def save(path, text):
    path.write_text(text)
    return str(path)


def test_issue_list(spark, tmp_path):
    url = "https://host/a/b/prate.01.2011040106.daily.grb2"
    path = save(tmp_path / "list.csv", f'"lista"\n2011033100\n"{url}"\n')
    rows = readers.issue_list(spark, path, "operational").orderBy("issue_id").collect()
    assert [r.issue_id for r in rows] == ["2011033100", "2011040106"]
    assert rows[1].issue_ts == T(2011, 4, 1, 6) and (rows[0].url, rows[1].url) == (None, url)


def test_listing(spark, tmp_path):
    for name in ("2017060100_cortado.nc", "2017060106_cortado.nc"):
        save(tmp_path / name, "x")
    got = readers.listed_issues(spark, str(tmp_path)).orderBy("issue_id").collect()
    assert [r.issue_id for r in got] == ["2017060100", "2017060106"]
    assert got[1].issue_ts == T(2017, 6, 1, 6)


def test_wide_history(spark, tmp_path):
    path = save(
        tmp_path / "h.csv",
        "DateTime,QUINTA.NORMAL,EL YESO\n1/2/1994,0.5,\n12/31/1994,3,4.5\n",
    )
    got = readers.observations_long(spark, path, ["QUINTA NORMAL", "EL YESO"])
    assert {tuple(r) for r in got.select("location", "obs_date", "mm").collect()} == {
        ("QUINTA NORMAL", D(1994, 1, 2), 0.5), ("EL YESO", D(1994, 1, 2), None),
        ("QUINTA NORMAL", D(1994, 12, 31), 3.0), ("EL YESO", D(1994, 12, 31), 4.5),
    }


def test_small_tables(spark, tmp_path):
    one = readers.single_station(
        spark, save(tmp_path / "q.csv", "DateTime,mm\n7/4/2000,1.5\n"), "QUINTA NORMAL"
    )
    assert tuple(one.first()) == ("QUINTA NORMAL", D(2000, 7, 4), 1.5)
    est = readers.stations(
        spark, save(tmp_path / "e.csv", "location,lat,lon,alt,full\nA B,-33.4,-70.7,520,1\n")
    )
    assert tuple(est.first()) == ("A B", -33.4, -70.7, 520.0, "1")
    pred = readers.cells(spark, save(tmp_path / "p.csv", "id,lat,lon\n5,-33.5,-71.1\n"))
    assert tuple(pred.first()) == (5, -33.5, -71.1) and pred.columns[0] == "cell_id"
    ring = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 0.0, "y": 1.0}]
    basin = readers.basins(spark, save(tmp_path / "b.json", json.dumps({"name": "M", "ring": ring})))
    assert basin.first().ring[1].x == 1.0
    page = readers.index_pages(spark, save(tmp_path / "i.html", '<a href="x">\n</a>'))
    assert page.first().html == '<a href="x">\n</a>'


def test_lists_are_written(spark, tmp_path):
    issues = spark.createDataFrame([("2011040106",), ("2011033100",)], "issue_id string")
    path = str(tmp_path / "out")
    writers.issue_list(issues, path)
    again = readers.issue_list(spark, path, "operational").collect()
    assert [r.issue_id for r in again] == ["2011033100", "2011040106"]
    urls = issues.select(F.concat(F.lit("u/"), "issue_id").alias("url"))
    writers.realtime_manifest(urls, path)
    assert {r.url for r in readers.issue_list(spark, path, "x").collect()} == {
        "u/2011040106", "u/2011033100"
    }
    days = spark.createDataFrame([(D(2024, 1, 2),), (D(2024, 1, 1),)], "valid_date date")
    writers.valid_days(days, path)
    assert [r[0] for r in spark.read.csv(path, header=True).collect()] == [
        "2024-01-01", "2024-01-02"
    ]


def test_grids_replace_only_their_days(spark, tmp_path):
    path = str(tmp_path / "grid")

    def grid(day, mm):
        return spark.createDataFrame([(day, 0.5, 0.5, mm)], schemas.IDW_GRID)

    writers.daily_grids(grid(D(2024, 1, 1), 1.0).union(grid(D(2024, 1, 2), 2.0)), path)
    writers.daily_grids(grid(D(2024, 1, 2), 9.0), path)
    got = {r.valid_date: r.mm for r in readers.stage(spark, path).collect()}
    assert got == {D(2024, 1, 1): 1.0, D(2024, 1, 2): 9.0}
    days = readers.grid_days(spark, path)
    assert [r[0] for r in days.collect()] == [D(2024, 1, 1), D(2024, 1, 2)]
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan  # listed, not opened
    assert sorted(d for d in os.listdir(path) if d.startswith("valid")) == [
        "valid_date=2024-01-01", "valid_date=2024-01-02"
    ]


def test_table_goes_to_each_destination(spark, tmp_path):
    wide = spark.createDataFrame([("B", 1.0), ("A", 2.0)], "location string, `2024-01-01` double")
    paths = [str(tmp_path / n) for n in ("a", "b")]
    writers.forecast_table(wide, *paths)
    for path in paths:
        got = spark.read.csv(path, header=True).collect()
        assert [tuple(r) for r in got] == [("A", "2.0"), ("B", "1.0")]


def test_partitioned_writes_are_rebalanced(spark):
    df = spark.range(10).withColumn("k", F.col("id") % 2).hint("rebalance", "k")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "k#" in plan.split("RebalancePartitions")[1]


@pytest.mark.parametrize("product", ["operational", "reforecast"])
def test_daily_stage_by_product_and_month(spark, tmp_path, product):
    path = str(tmp_path / "daily")
    rows = [(product, T(2012, m, 1), 1, D(2012, m, 2), 1.0) for m in (1, 2)]
    writers.daily(spark.createDataFrame(rows, schemas.FORECAST_DAILY), path)
    assert os.listdir(f"{path}/product={product}") and readers.stage(spark, path).count() == 2
    assert sorted(os.listdir(f"{path}/product={product}")) == [
        "issue_month=2012-01", "issue_month=2012-02"
    ]
    stored = f"{path}/product={product}/issue_month=2012-02"
    assert os.listdir(stored) == ["issue=2012020100"]


def test_other_issues_of_a_month_stay(spark, tmp_path):
    """Two issues of one day written one after the other, one of them again: the reader has both."""
    path = str(tmp_path / "daily")

    def rows(hour, mm):
        return spark.createDataFrame(
            [("realtime", T(2012, 1, 1, hour), 1, D(2012, 1, d), mm) for d in (2, 3)], schemas.FORECAST_DAILY
        )

    for hour, mm in ((0, 1.0), (6, 2.0), (0, 3.0)):
        writers.daily(rows(hour, mm), path)
    got = readers.daily_totals(spark, path, "realtime")
    assert sorted((r.issue_ts.hour, r.mm) for r in got.collect()) == [(0, 3.0), (0, 3.0), (6, 2.0), (6, 2.0)]
    assert readers.daily_totals(spark, path, "realtime", T(2012, 1, 1, 6)).count() == 2
    assert "issue" not in got.columns
    ids = [r.issue_id for r in readers.issue_folders(spark, path).orderBy("issue_id").collect()]
    assert ids == ["2012010100", "2012010106"]
    writers.daily(rows(18, 4.0), path, whole=True)
    assert readers.daily_totals(spark, path).count() == 2
