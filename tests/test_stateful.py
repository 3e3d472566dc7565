import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from pluvia.config import OPERATIONAL
from pluvia.operators import manifest
from pluvia.streaming import ingest, stateful
from tests.test_streaming import SCHEMA, batch_tables, issue_rows, land, rounded

UTC = dt.timezone.utc


def stream(spark, folder):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ingest.forecast_stream(spark, f"{folder}/in", schema, maxFilesPerTrigger=12)


def run_votes(spark, folder):
    places = f"{folder}/votes", f"{folder}/checkpoint"
    stateful.start_votes(stream(spark, folder), OPERATIONAL, *places).awaitTermination()
    return stateful.read_votes(spark, f"{folder}/votes")


def test_votes_equal_the_batch_in_any_order_and_after_a_restart(spark, tmp_path):
    issues = issue_rows(30, 40)
    for i in (3, 11, 27):  # steps without a number
        issues[i][5] = (*issues[i][5][:3], float("nan"))
    pieces = [p for i in issues for p in (i[: len(i) // 3], i[len(i) // 3 :])]
    random.Random(4).shuffle(pieces)
    for group in (pieces[:25], pieces[25:40], pieces[40:]):
        for k in range(0, len(group), 3):
            land(spark, [r for p in group[k : k + 3] for r in p], f"{tmp_path}/in")
        found = run_votes(spark, tmp_path)  # each run goes on from the checkpoint
    assert rounded(found) == rounded(batch_tables(spark, issues)[1])


def test_keep_needs_a_trigger_that_goes_on(spark, tmp_path):
    with pytest.raises(ValueError):
        stateful.start_votes(spark.range(1), OPERATIONAL, "x", "y", dt.timedelta(days=1))


def test_state_that_goes_after_a_time(spark, tmp_path):
    issues = issue_rows(3, 12)
    rows = [r for i in issues for r in i]
    land(spark, rows, f"{tmp_path}/in")
    query = stateful.start_votes(
        stream(spark, tmp_path), OPERATIONAL, f"{tmp_path}/votes", f"{tmp_path}/checkpoint",
        dt.timedelta(days=2), {"processingTime": "1 second"},
    )
    end = time.time() + 60
    while time.time() < end and sum(p["numInputRows"] for p in query.recentProgress) < len(rows):
        time.sleep(0.5)
    query.stop()
    assert rounded(stateful.read_votes(spark, f"{tmp_path}/votes")) == rounded(batch_tables(spark, issues)[1])


def test_gap_after_the_issue_was_counted(spark, tmp_path):
    """The newest issues lose their days by late gaps; older ones take their places, up to ``SPARE``."""
    issues = issue_rows(26, 6)
    for issue in issues:
        land(spark, issue, f"{tmp_path}/in")
    run_votes(spark, tmp_path)
    late = [[(i[0][0], 1, 3, None)] for i in issues[-stateful.SPARE :]]
    for gap in late:
        land(spark, gap, f"{tmp_path}/in")
    want = batch_tables(spark, issues + late)[1]
    assert rounded(run_votes(spark, tmp_path)) == rounded(want)


def test_day_that_has_only_gaps(spark, tmp_path):
    first = issue_rows(1, 1)[0]
    land(spark, first, f"{tmp_path}/in")
    assert run_votes(spark, tmp_path).count() == 2
    land(spark, [(*r[:3], None) for r in first], f"{tmp_path}/in")
    assert run_votes(spark, tmp_path).count() == 0


def test_state_store_setting_is_put_back(spark):
    before = spark.conf.get(stateful.STORE)
    with stateful.state_store(spark):
        assert spark.conf.get(stateful.STORE) == stateful.ROCKSDB
    assert spark.conf.get(stateful.STORE) == before


DAY = dt.datetime(2024, 3, 1)


def planned(n):
    return [(f"i{k:03d}", DAY + dt.timedelta(hours=6 * k)) for k in range(n)]


def land_arrivals(spark, rows, folder):
    frame = spark.createDataFrame(rows, "issue_id string, arrived timestamp")
    frame.coalesce(1).write.mode("append").parquet(f"{folder}/came")


def run_alarms(spark, folder, latency):
    expected = spark.readStream.schema("issue_id string, issue_ts timestamp_ntz").parquet(f"{folder}/plan")
    came = spark.readStream.schema("issue_id string, arrived timestamp").parquet(f"{folder}/came")
    stateful.start_alarms(
        expected, came, latency, f"{folder}/alarms", f"{folder}/checkpoint", keep=dt.timedelta(days=4)
    ).awaitTermination()
    return stateful.read_alarms(spark, f"{folder}/alarms")


def told(df):
    return sorted((r.issue_id, r.status, r.due, r.arrived) for r in df.collect())


def test_alarms_equal_the_batch_report(spark, tmp_path):
    rng = random.Random(5)
    latency = dt.timedelta(hours=4)
    plan = planned(40)
    spark.createDataFrame(plan + plan[:5], "issue_id string, issue_ts timestamp_ntz").write.parquet(
        f"{tmp_path}/plan"
    )
    came = []
    for k, (name, at) in enumerate(plan[:32]):
        if k % 7 == 3:
            continue  # never comes
        delay = dt.timedelta(hours=rng.choice([0, 1, 3, 4, 5, 30]))
        came += [(name, (at + delay + dt.timedelta(minutes=5 * i)).replace(tzinfo=UTC)) for i in range(3)]
    came.append(("unplanned", came[0][1]))
    came.sort(key=lambda r: r[1])
    seen = []
    for a in range(0, len(came), 20):  # a run for each, all with one checkpoint
        seen += came[a : a + 20]
        land_arrivals(spark, came[a : a + 20], tmp_path)
        found = told(run_alarms(spark, tmp_path, latency))
        arrivals = spark.createDataFrame(seen, "issue_id string, arrived timestamp")
        now = arrivals.agg(F.max("arrived")).first()[0].astimezone(UTC).replace(tzinfo=None)
        batch = manifest.overdue(
            spark.createDataFrame(plan, "issue_id string, issue_ts timestamp_ntz"),
            arrivals.withColumn("arrived", F.col("arrived").cast("timestamp_ntz")), latency, F.lit(now),
        )
        want = batch.withColumns({c: F.col(c).cast("timestamp") for c in ("due", "arrived")})
        assert sorted(found, key=str) == sorted(told(want), key=str)
    states = {r[1] for r in found}
    assert states == {"late", "missing"}


def test_missing_then_late(spark, tmp_path):
    plan = planned(12)
    spark.createDataFrame(plan, "issue_id string, issue_ts timestamp_ntz").write.parquet(f"{tmp_path}/plan")
    at = {n: t.replace(tzinfo=UTC) for n, t in plan}
    land_arrivals(spark, [("i000", at["i000"]), ("i004", at["i004"])], tmp_path)
    found = run_alarms(spark, tmp_path, dt.timedelta(hours=1))
    assert [(r[0], r[1]) for r in sorted(told(found), key=str)] == [(f"i00{k}", "missing") for k in (1, 2, 3)]
    land_arrivals(spark, [("i002", at["i005"]), ("i002", at["i006"])], tmp_path)
    found = run_alarms(spark, tmp_path, dt.timedelta(hours=1))
    states = {r.issue_id: r.status for r in found.collect()}
    assert states == {"i001": "missing", "i002": "late", "i003": "missing", "i005": "missing"}
    stored = spark.read.parquet(f"{tmp_path}/alarms").filter("issue_id = 'i002'")
    assert sorted(r.status for r in stored.collect()) == ["late", "missing"]  # both were said, once each
