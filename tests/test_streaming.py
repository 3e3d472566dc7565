import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pluvia import schemas
from pluvia.config import OPERATIONAL, REALTIME
from pluvia.operators import consensus as vote
from pluvia.operators.daily import daily_totals
from pluvia.streaming import ingest

SCHEMA = "issue_ts timestamp_ntz, cell_id int, step int, prate double"


def issue_rows(n_issues=20, n_steps=60):
    rng = random.Random(2)
    first = dt.datetime(2024, 1, 1)
    return [
        [(first + dt.timedelta(hours=6 * i), c, s, max(rng.gauss(0, 2), 0.0) / 21600)
         for c in (1, 2) for s in range(n_steps)]
        for i in range(n_issues)
    ]


def batch_tables(spark, issues):
    steps = spark.createDataFrame([r for i in issues for r in i], SCHEMA)
    daily = daily_totals(steps, OPERATIONAL)
    return daily, vote.vote(vote.last_issues(daily, OPERATIONAL.last_n), OPERATIONAL)


def stored_votes(spark, path, product=OPERATIONAL):
    return spark.read.schema(schemas.CONSENSUS).parquet(path).filter(F.col("product") == product.name)


def rounded(df):
    rows = df.select(*sorted(df.columns)).collect()
    plain = [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows]
    return sorted(plain, key=str)


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, landing, out, schema):
    steps = ingest.forecast_stream(spark, landing, schema, maxFilesPerTrigger=3)
    query = ingest.start_daily(
        steps, OPERATIONAL, f"{out}/daily", f"{out}/checkpoint", f"{out}/consensus"
    )
    query.awaitTermination()


@pytest.fixture
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_any_arrival_order_gives_the_batch_result(spark, tmp_path, schema):
    issues = issue_rows()
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    pieces = [p for i in issues for p in (i[: len(i) // 3], i[len(i) // 3 :])]  # issues in parts
    random.Random(1).shuffle(pieces)
    for piece in pieces[:25]:
        land(spark, piece, landing)
    run(spark, landing, out, schema)
    for piece in pieces[25:]:  # late issues and late parts
        land(spark, piece, landing)
    run(spark, landing, out, schema)
    daily, consensus = batch_tables(spark, issues)
    assert rounded(ingest.read_daily(spark, f"{out}/daily")) == rounded(daily)
    assert rounded(stored_votes(spark, f"{out}/consensus")) == rounded(consensus)
    parts = {p.name for p in (tmp_path / "out" / "daily").glob("valid_date=*/part=*")}
    assert len(parts) > 5


def test_filled_like_the_batch(spark, tmp_path, schema):
    issues = [issue_rows(1)[0], [(dt.datetime(2024, 2, 20), 3, 0, 1.0)]]
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for issue in issues:
        land(spark, issue, landing)
    run(spark, landing, out, schema)
    steps = spark.createDataFrame([r for i in issues for r in i], SCHEMA)
    ends = dt.date(2023, 12, 31), dt.date(2024, 2, 29)
    want = vote.consensus(daily_totals(steps, OPERATIONAL), OPERATIONAL, *ends)
    got = ingest.read_consensus(spark, f"{out}/consensus", OPERATIONAL, *ends)
    assert rounded(got) == rounded(want) and got.count() == 3 * 61


def test_new_checkpoint_and_other_product_add_to_the_tables(spark, tmp_path, schema):
    issues = issue_rows(6)
    out = str(tmp_path / "out")
    for i, some in enumerate((issues[:3], issues[3:])):
        for issue in some:
            land(spark, issue, f"{tmp_path}/in{i}")
        steps = ingest.forecast_stream(spark, f"{tmp_path}/in{i}", schema)
        ingest.start_daily(
            steps, OPERATIONAL, f"{out}/daily", f"{tmp_path}/checkpoint{i}", f"{out}/consensus"
        ).awaitTermination()
    steps = ingest.forecast_stream(spark, f"{tmp_path}/in0", schema)
    ingest.start_daily(
        steps, REALTIME, f"{out}/daily", f"{tmp_path}/checkpoint2", f"{out}/consensus"
    ).awaitTermination()
    daily, consensus = batch_tables(spark, issues)
    stored = ingest.read_daily(spark, f"{out}/daily")
    assert rounded(stored.filter("product = 'operational'")) == rounded(daily)
    assert rounded(stored_votes(spark, f"{out}/consensus")) == rounded(consensus)
    few = daily_totals(spark.createDataFrame([r for i in issues[:3] for r in i], SCHEMA), REALTIME)
    assert rounded(stored.filter("product = 'realtime'")) == rounded(few)


def test_batch_without_rows(spark, tmp_path, schema):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    land(spark, [], landing)
    run(spark, landing, out, schema)
    assert ingest.read_daily(spark, f"{out}/daily").count() == 0
    issues = issue_rows(2)
    land(spark, issues[0] + issues[1], landing)
    run(spark, landing, out, schema)
    assert rounded(ingest.read_daily(spark, f"{out}/daily")) == rounded(batch_tables(spark, issues)[0])


def test_compacted_parts_add_up_alike(spark, tmp_path, schema):
    issues = issue_rows(6)
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    for issue in issues:
        land(spark, issue, landing)
    run(spark, landing, out, schema)
    ingest.compact(spark, f"{out}/daily", f"{out}/compact")
    assert {p.name for p in (tmp_path / "out" / "compact").glob("*/part=*")} == {"part=compacted"}
    one, two = (ingest.read_daily(spark, f"{out}/{x}") for x in ("daily", "compact"))
    assert rounded(one) == rounded(two)


def test_repeated_batch_changes_nothing(spark, tmp_path):
    issues = issue_rows(4)
    daily_path, out = str(tmp_path / "daily"), str(tmp_path / "consensus")
    for _ in range(2):
        steps = spark.createDataFrame([r for i in issues for r in i], SCHEMA)
        ingest.write_partials(ingest.partials(steps, OPERATIONAL, "part-0"), daily_path)
        ingest.update_consensus(spark, OPERATIONAL, daily_path, out, "part-0")
    daily, consensus = batch_tables(spark, issues)
    assert rounded(ingest.read_daily(spark, daily_path)) == rounded(daily)
    assert rounded(stored_votes(spark, out)) == rounded(consensus)


def test_missing_step_in_one_part_makes_the_day_null(spark, tmp_path, schema):
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    issue = dt.datetime(2024, 1, 1)
    land(spark, [(issue, 1, 3, 1.0), (issue, 1, 4, None)], landing)
    land(spark, [(issue, 1, 5, 1.0), (issue, 1, 7, 1.0)], landing)
    run(spark, landing, out, schema)
    got = {r.valid_date.day: r.mm for r in ingest.read_daily(spark, f"{out}/daily").collect()}
    assert got == {1: None, 2: 21600.0}


def test_watermarked_totals_equal_batch_once_issues_are_closed(spark, tmp_path, schema):
    issues = issue_rows(12, 30)
    landing = str(tmp_path / "in")
    issues[3][7] = (*issues[3][7][:3], None)  # a missing step makes its day NULL
    for issue in issues:
        land(spark, issue, landing)
    far = dt.datetime(2024, 3, 1)  # an issue that closes all others
    land(spark, [(far, 1, 0, 0.0)], landing)
    steps = ingest.forecast_stream(spark, landing, schema, maxFilesPerTrigger=4)
    query = (
        ingest.daily_within(steps, OPERATIONAL, "20 days")
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "daily"))
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "daily")).filter(F.col("issue_ts") < F.lit(far))
    assert rounded(got) == rounded(batch_tables(spark, issues)[0])
