"""Real-time issues as a stream of files.

An issue may come late or in pieces and none may be dropped, so no watermark decides what
counts. Each micro-batch appends its partial daily totals; reading adds the parts of an issue
up. The consensus is then recomputed for the days a batch touched.

Partial totals lie in folders by day and part. A part is named after product, query and batch: the
query's id is new for each checkpoint, so another stream, or one that starts anew, adds to the table,
and a batch that runs again replaces its own part alone.
"""

from __future__ import annotations

import datetime as dt
from concurrent.futures import Future

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pluvia import schemas
from pluvia.config import Product
from pluvia.functions import dates, units
from pluvia.operators import consensus as vote
from pluvia.operators.daily import base_time, daily_totals, whole_sum
from pluvia.sources import writers


def forecast_stream(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """New forecast files of a folder (or glob) as they arrive."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def partials(steps: DataFrame, product: Product, part: str) -> DataFrame:
    """Daily totals of some steps, as stored under the name ``part``."""
    daily = daily_totals(steps, product)
    gap = F.col("mm").isNull()
    return daily.select(
        "product", "issue_ts", "cell_id", F.coalesce("mm", F.lit(0.0)).alias("mm"),
        gap.alias("has_gap"), "valid_date", F.lit(part).alias("part"),
    )


def write_partials(parts: DataFrame, daily_path: str) -> None:
    """Adds parts, or replaces those of the same name."""
    writers.stage(parts, daily_path, "valid_date", "part")


def read_partials(spark: SparkSession, daily_path: str) -> DataFrame:
    return spark.read.schema(schemas.DAILY_PARTS).parquet(daily_path)


def read_daily(spark: SparkSession, daily_path: str) -> DataFrame:
    """Daily totals added up over the parts; a day with a missing step is NULL."""
    return _added_up(read_partials(spark, daily_path))


def _sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy("product", "issue_ts", "cell_id", "valid_date").agg(
        F.sum("mm").alias("mm"), F.bool_or("has_gap").alias("has_gap")
    )


def _added_up(parts: DataFrame) -> DataFrame:
    return _sums(parts).withColumn("mm", F.when(~F.col("has_gap"), F.col("mm"))).drop("has_gap")


def compact(spark: SparkSession, daily_path: str, out: str, part: str = "compacted") -> None:
    """The stored parts as one part a day in another folder, from which a stream can go on."""
    writers.stage(
        _sums(read_partials(spark, daily_path)).withColumn("part", F.lit(part)),
        out, "valid_date", "part", whole=True,
    )


def start_daily(
    steps: DataFrame,
    product: Product,
    daily_path: str,
    checkpoint: str,
    consensus_path: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep the daily table, and the consensus table if a path is given, up to date.

    ``steps`` is a stream with the columns of ``daily_totals``. The default trigger works off
    what is there and stops. Both tables may be shared by several streams and products.
    """
    started: Future[str] = Future()

    def write(batch: DataFrame, batch_id: int) -> None:
        part = f"{product.name}-{started.result()}-{batch_id}"
        write_partials(partials(batch, product, part), daily_path)
        if consensus_path is not None:
            update_consensus(batch.sparkSession, product, daily_path, consensus_path, part)

    query = (
        steps.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    started.set_result(str(query.id))
    return query


def update_consensus(
    spark: SparkSession, product: Product, daily_path: str, consensus_path: str, part: str
) -> None:
    """Recompute the consensus of the days that a part touched, from all their issues.

    Both tables are in folders by day: the part's days prune the others while the query runs.
    """
    stored = read_partials(spark, daily_path).filter(F.col("product") == product.name)
    touched = read_partials(spark, daily_path).filter(F.col("part") == part)
    days = touched.select("valid_date").distinct()
    last = vote.last_issues(_added_up(stored.join(days, "valid_date")), product.last_n)
    writers.stage(vote.vote(last, product), consensus_path, "product", "valid_date")


def read_consensus(
    spark: SparkSession, consensus_path: str, product: Product,
    start: dt.date | None = None, end: dt.date | None = None,
) -> DataFrame:
    """The stored consensus of a product as ``consensus.consensus`` gives it: every cell and day of the
    range, 0 where nobody forecast. Without a range, that of the stored days."""
    stored = spark.read.schema(schemas.CONSENSUS).parquet(consensus_path)
    stored = stored.filter(F.col("product") == product.name)
    ends = stored.agg(F.min("valid_date").alias("first"), F.max("valid_date").alias("last"))
    start, end = start or product.start, end or product.end
    first = F.lit(start) if start else ends.select("first").scalar()
    last = F.lit(end) if end else ends.select("last").scalar()
    spine = dates.explode_days(stored.select("product", "cell_id").distinct(), first, last)
    return spine.join(stored, list(vote.KEYS), "left").na.fill(
        {"mm": 0.0, "n_issues": 0, "n_wet": 0}
    )


def daily_within(steps: DataFrame, product: Product, delay: str = "2 days") -> DataFrame:
    """Streaming daily totals with bounded state: an issue is final ``delay`` after newer ones.

    The watermark is on the issue time. One on the valid time would drop the near days of
    every later issue, as each issue reaches months ahead. Issues later than ``delay`` are
    dropped; use ``start_daily`` where they must count.
    """
    valid = dates.valid_date(base_time(steps), F.col("step"), product.shift_hours)
    # event time must be a zoned timestamp; the issue keeps its zone-free one beside it
    rows = steps.select(
        F.col("issue_ts").cast("timestamp").alias("issue_time"), "issue_ts", "cell_id",
        valid.alias("valid_date"), units.known(units.rate_to_mm(F.col("prate"))).alias("mm"),
    )
    totals = rows.withWatermark("issue_time", delay).groupBy(
        "issue_time", "issue_ts", "cell_id", "valid_date"
    )
    return totals.agg(whole_sum("mm").alias("mm")).select(
        F.lit(product.name).alias("product"), "issue_ts", "cell_id", "valid_date", "mm"
    )
