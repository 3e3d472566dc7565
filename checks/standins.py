"""The package's input tables, derived from the driver's tables (see FIXTURES.md for the roles).

Each function uses its whole source tables. ``checks.oracle`` states the same tables in SQL.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.config import GRID_LAT, GRID_LON360, INNER_LAT, INNER_LON, INNER_SIDE, VARIABLE
from pluvia.functions import dates, units

AS_OF = dt.date(2024, 1, 15)
RANGE = (dt.date(2023, 12, 31), dt.date(2024, 2, 29))
OBS_RANGE = (dt.date(1996, 1, 1), dt.date(1999, 12, 31))
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
RERUN = dt.datetime(2024, 1, 16)  # first issue of the second real-time run
LATENCY = dt.timedelta(minutes=3)  # after which an issue is late
STATION = "Supplier 000000007"
HOLE = 0.4  # size of a hole in a basin
DRY = 40.0  # event values up to this stand for a dry step
OBS_DRY = 45.0


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    """6-hourly forecasts: a row per event, the event's time floored to the issue hour."""
    quarter = F.floor(F.hour("ts") / 6) * 6
    issue = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=quarter)
    rows = events.select(
        issue.alias("issue_ts"),
        (F.col("user_id") % 9 + 1).cast("int").alias("cell_id"),
        (F.col("user_id") % 7 + 1).cast("int").alias("lon_idx"),
        (F.floor(F.col("user_id") / 7) % 5 + 1).cast("int").alias("lat_idx"),
        F.get_json_object("props", "$.k").cast("int").alias("step"),
        (F.greatest(F.col("value") - DRY, F.lit(0.0)) / 21600.0).alias("prate"),
    )
    lon = F.element_at(F.array(*[F.lit(v) for v in GRID_LON360]), F.col("lon_idx"))
    lat = F.element_at(F.array(*[F.lit(v) for v in GRID_LAT]), F.col("lat_idx"))
    stamp = F.col("issue_ts").cast("string")
    return (
        rows.withColumn("lon", units.signed_longitude(lon))
        .withColumn("lat", lat)
        .withColumn("units", F.concat(F.lit("hours since "), stamp))
    )


def arrivals(events: DataFrame) -> DataFrame:
    """When something of an issue came: each event's time."""
    quarter = F.floor(F.hour("ts") / 6) * 6
    at = F.to_date("ts").cast("timestamp_ntz") + F.make_dt_interval(hours=quarter)
    return events.select(dates.issue_id(at).alias("issue_id"), F.col("ts").cast("timestamp").alias("arrived"))


def forecast_6h(spark: SparkSession, sf: str) -> DataFrame:
    return from_events(table(spark, sf, "events"))


def issues(spark: SparkSession, sf: str) -> DataFrame:
    """The issues there are."""
    ts = forecast_6h(spark, sf).select("issue_ts").distinct()
    return ts.select(dates.issue_id(F.col("issue_ts")).alias("issue_id"), "issue_ts")


def expected_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Every issue hour from five days before the first event to five days after the last."""
    span = table(spark, sf, "events").agg(
        F.date_sub(F.to_date(F.min("ts")), 5).alias("s"),
        F.date_add(F.to_date(F.max("ts")), 5).alias("e"),
    )
    return dates.explode_issue_calendar(span, F.col("s"), F.col("e"), every_days=1)


def located(spark: SparkSession, sf: str, first: int) -> DataFrame:
    """The vectors as places, from two neighbouring components."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select(
        "vec_id", "label",
        (e[first].cast("double") * 9.0 - 71.0).alias("lon"),
        (e[first + 1].cast("double") * 6.0 - 33.5).alias("lat"),
    )


def stations(spark: SparkSession, sf: str) -> DataFrame:
    places = located(spark, sf, 0)
    supplier, nation = table(spark, sf, "supplier"), table(spark, sf, "nation")
    joined = supplier.join(places, F.col("s_suppkey") == F.col("vec_id")).join(
        nation, F.col("s_nationkey") == F.col("n_nationkey")
    )
    return joined.select(
        _location().alias("location"), "lat", "lon", F.col("s_acctbal").alias("alt"),
        F.col("n_name").alias("full"),
    )


def _location():
    return F.translate("s_name", "#", " ")


def cells(spark: SparkSession) -> DataFrame:
    """The inner 3 x 3 grid."""
    rows = [
        (la - INNER_LAT[0] + 1 + INNER_SIDE * (lo - INNER_LON[0]), GRID_LAT[la - 1],
         GRID_LON360[lo - 1] - 360.0)
        for lo in range(INNER_LON[0], INNER_LON[1] + 1)
        for la in range(INNER_LAT[0], INNER_LAT[1] + 1)
    ]
    return spark.createDataFrame(rows, "cell_id int, lat double, lon double")


def many_cells(spark: SparkSession, sf: str) -> DataFrame:
    """A cell per vector."""
    return located(spark, sf, 2).select((F.col("vec_id") + 1).alias("cell_id"), "lat", "lon")


def obs_hist(spark: SparkSession, sf: str) -> DataFrame:
    """Long station history: a supplier's shipped value per day."""
    lineitem, supplier = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    by_day = lineitem.groupBy("l_suppkey", F.to_date("l_shipdate").alias("obs_date")).agg(
        (F.sum("l_extendedprice") / 5000.0).alias("mm")
    )
    return by_day.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        _location().alias("location"), "obs_date", "mm"
    )


def obs_recent(spark: SparkSession, sf: str) -> DataFrame:
    """Observations on the forecasts' days, with dry days."""
    by_day = (
        table(spark, sf, "events")
        .groupBy(F.expr("user_id * 2 div 3").alias("key"), F.to_date("ts").alias("obs_date"))
        .agg(F.greatest(F.avg("value") - OBS_DRY, F.lit(0.0)).alias("mm"))
    )
    supplier = table(spark, sf, "supplier")
    return by_day.join(supplier, F.col("key") == F.col("s_suppkey")).select(
        _location().alias("location"), "obs_date", "mm"
    )


def obs_priority(spark: SparkSession, sf: str) -> DataFrame:
    """A few stations with long names: an order priority's value per day."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("location"),
                 F.to_date("o_orderdate").alias("obs_date"))
        .agg((F.sum("o_totalprice") / 10000.0).alias("mm"))
    )


def stored_forecast(spark: SparkSession, sf: str, product: str) -> DataFrame:
    """The forecasts as ``writers.forecast`` takes them."""
    steps = forecast_6h(spark, sf).drop("cell_id")
    return steps.select(F.lit(product).alias("product"), F.lit(VARIABLE).alias("variable"), "*")


def with_nan(steps: DataFrame) -> DataFrame:
    """Every step 7 is NaN and every step 11 NULL."""
    nan = F.when(F.col("step") == 7, F.lit(float("nan"))).otherwise(F.col("prate"))
    return steps.withColumn("prate", F.when(F.col("step") != 11, nan))


def basins(spark: SparkSession, sf: str, scale: float = 1.0) -> DataFrame:
    """A hexagon per label around the middle of its places."""
    box = located(spark, sf, 0).groupBy("label").agg(
        F.min("lon").alias("w"), F.max("lon").alias("e"),
        F.min("lat").alias("s"), F.max("lat").alias("n"),
    )
    cx, cy = (F.col("w") + F.col("e")) / 2.0, (F.col("s") + F.col("n")) / 2.0
    a = (F.col("e") - F.col("w")) * 0.3 * scale
    b = (F.col("n") - F.col("s")) * 0.2 * scale
    corners = [(-1.0, 0.0), (-0.5, 1.0), (0.5, 1.0), (1.0, 0.0), (0.5, -1.0), (-0.5, -1.0)]
    ring = F.array(
        *[F.struct((cx + a * p).alias("x"), (cy + b * q).alias("y")) for p, q in corners]
    )
    return box.select(F.col("label").cast("string").alias("name"), ring.alias("ring"))
