"""Input tables. Every reader has a fixed schema, so no file is read to infer one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pluvia import schemas
from pluvia.config import VARIABLE
from pluvia.functions import dates, text
from pluvia.operators import daily, observations


def issue_list(spark: SparkSession, path: str, product: str) -> DataFrame:
    """The issue list: a CSV column ``lista`` of issue ids or file addresses."""
    rows = spark.read.schema(schemas.ISSUE_LIST).csv(path, header=True)
    is_id = F.col("lista").rlike(r"^\d{10}$")
    issue = F.when(is_id, F.col("lista")).otherwise(text.issue_of_url(F.col("lista")))
    return rows.select(
        issue.alias("issue_id"),
        dates.parse_issue(issue).alias("issue_ts"),
        F.lit(product).alias("product"),
        F.when(~is_id, F.col("lista")).alias("url"),
    )


def listed_issues(spark: SparkSession, path: str) -> DataFrame:
    """Issue ids of the files in a folder: the first ten characters of each name.

    Only the listing is read, not the files.
    """
    files = spark.read.format("binaryFile").load(path).select("path")
    issue = text.basename(F.col("path")).substr(1, 10)
    return files.select(issue.alias("issue_id"), dates.parse_issue(issue).alias("issue_ts"))


def issue_folders(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the issues that ``writers.forecast`` or ``daily`` stored, from the folder names alone: no
    file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    issue = F.regexp_extract("path", r"/issue=(\d{10})/", 1)
    ids = files.select(issue.alias("issue_id")).filter("issue_id <> ''").distinct()
    return ids.select("issue_id", dates.parse_issue(F.col("issue_id")).alias("issue_ts"))


def forecast(
    spark: SparkSession,
    path: str,
    product: str | None = None,
    first_issue: dt.datetime | None = None,
    last_issue: dt.datetime | None = None,
    variable: str | None = VARIABLE,
) -> DataFrame:
    """6-hourly gridded forecasts of one variable, written by ``writers.forecast``.

    With a product or a range of issues only their folders are read. ``variable=None`` gives all.
    """
    df = spark.read.schema(schemas.FORECAST_STORED).parquet(path).drop("issue")
    if variable is not None:
        df = daily.of_variable(df, variable)
    if product is not None:
        df = df.filter(F.col("product") == product)
    return of_issues(df, first_issue, last_issue)


def daily_totals(
    spark: SparkSession,
    path: str,
    product: str | None = None,
    first_issue: dt.datetime | None = None,
    last_issue: dt.datetime | None = None,
) -> DataFrame:
    """Daily totals written by ``writers.daily``; with a product or a range of issues only their
    folders are read."""
    df = spark.read.schema(schemas.FORECAST_DAILY_STORED).parquet(path).drop("issue")
    if product is not None:
        df = df.filter(F.col("product") == product)
    return of_issues(df, first_issue, last_issue)


def of_issues(
    df: DataFrame, first_issue: dt.datetime | None = None, last_issue: dt.datetime | None = None
) -> DataFrame:
    """Rows of a range of issues; the table is in folders by ``issue_month``."""
    if first_issue is not None:
        df = df.filter(F.col("issue_ts") >= F.lit(first_issue).cast("timestamp_ntz"))
        df = df.filter(F.col("issue_month") >= first_issue.strftime("%Y-%m"))
    if last_issue is not None:
        df = df.filter(F.col("issue_ts") <= F.lit(last_issue).cast("timestamp_ntz"))
        df = df.filter(F.col("issue_month") <= last_issue.strftime("%Y-%m"))
    return df


def axes(forecast: DataFrame) -> DataFrame:
    """The grid's axis values by index, with the time unit of each issue."""
    return forecast.select(
        "issue_ts", "units", "lat_idx", "lat", "lon_idx", "lon"
    ).distinct()


def wide_observations(spark: SparkSession, path: str, stations: list[str]) -> DataFrame:
    """Station history with a column per station (given in file order) and m/d/y dates."""
    fields = [T.StructField("DateTime", T.StringType())]
    fields += [T.StructField(s.replace(" ", "."), T.DoubleType()) for s in stations]
    wide = spark.read.schema(T.StructType(fields)).csv(path, header=True, enforceSchema=True)
    return observations.parse_wide_dates(wide)


def observations_long(spark: SparkSession, path: str, stations: list[str]) -> DataFrame:
    return observations.unpivot(wide_observations(spark, path, stations))


def single_station(spark: SparkSession, path: str, location: str) -> DataFrame:
    """History of one station, columns ``DateTime`` (m/d/y) and ``mm``."""
    rows = spark.read.schema("DateTime string, mm double").csv(path, header=True)
    return rows.select(
        F.lit(location).alias("location"),
        dates.parse_mdy(F.col("DateTime")).alias("obs_date"),
        "mm",
    )


def stations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.STATION).csv(path, header=True)


def cells(spark: SparkSession, path: str) -> DataFrame:
    """Grid points ``id, lat, lon``; the id is the cell number."""
    rows = spark.read.schema("id int, lat double, lon double").csv(path, header=True)
    return rows.withColumnRenamed("id", "cell_id")


def basins(spark: SparkSession, path: str) -> DataFrame:
    """Basin outlines as JSON lines ``{"name": ..., "ring": [{"x": ..., "y": ...}, ...]}``."""
    return spark.read.schema(schemas.BASIN).json(path)


def geojson_basins(
    spark: SparkSession, path: str, name: str = "NOMBRE", lines: bool = False
) -> DataFrame:
    """Outlines from GeoJSON: ``name, ring``, a row for each ring of each polygon, holes too.

    A file is a FeatureCollection; with ``lines`` each line is a Feature. ``name`` is the property that
    names a polygon. The parts of a MultiPolygon share the name, as the rings of a polygon do. The point
    that closes a ring is left out. Features of other geometry types have no ring and give no row.
    """
    feature = "struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>"
    text = spark.read.text(path, wholetext=not lines)
    if lines:
        features = text.select(F.from_json("value", feature).alias("f"))
    else:
        collection = F.from_json("value", f"features array<{feature}>")
        features = text.select(F.explode(collection["features"]).alias("f"))
    shape, rings = "array<array<array<double>>>", F.col("f.geometry.coordinates")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(F.from_json(rings, shape))).when(
        F.col("f.geometry.type") == "MultiPolygon", F.from_json(rings, f"array<{shape}>")
    )
    found = features.select(
        F.col("f.properties")[name].alias("name"), F.explode(F.flatten(polygons)).alias("ring")
    )
    closed = F.element_at("ring", 1) == F.element_at("ring", -1)
    opened = F.when(closed, F.slice("ring", 1, F.size("ring") - 1)).otherwise(F.col("ring"))
    points = F.transform(opened, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    ring = points.cast(schemas.BASIN["ring"].dataType)
    return found.filter(F.size("ring") > 1).select("name", ring.alias("ring"))


def index_pages(spark: SparkSession, path: str) -> DataFrame:
    """Saved index pages, one whole file each."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("html")
    )


def grid_days(spark: SparkSession, path: str) -> DataFrame:
    """The days there is a grid for, from the folder names alone: no file is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    day = F.regexp_extract("path", r"/valid_date=(\d{4}-\d{2}-\d{2})/", 1)
    days = files.select(day.alias("valid_date")).filter("valid_date <> ''").distinct()
    return days.select(F.to_date("valid_date").alias("valid_date")).orderBy("valid_date")


def stage(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stage output written by ``writers.stage``; with its schema no file is opened to find it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)
