"""Output tables.

Partitioned writes are rebalanced first: AQE then joins small and splits large partitions,
so a folder gets few files and one large folder is still written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions import dates


def stage(
    df: DataFrame, path: str, *partition_by: str, mode: str = "overwrite", whole: bool = False
) -> None:
    """A stage output as Parquet; only the partitions present in ``df`` are replaced, or with
    ``whole`` the table."""
    writer = df.hint("rebalance", *partition_by) if partition_by else df
    writer = writer.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by).option(
            "partitionOverwriteMode", "static" if whole else "dynamic"
        )
    writer.parquet(path)


#: Folders of stored forecasts and daily totals: readers prune by product and month, and a write replaces
#: the issues that it brings and no others.
ISSUE_FOLDERS = ("product", "issue_month", "issue")


def _by_issue(df: DataFrame) -> DataFrame:
    ts = F.col("issue_ts")
    return df.withColumns({"issue_month": dates.month_label(ts), "issue": dates.issue_id(ts)})


def daily(df: DataFrame, path: str, whole: bool = False) -> None:
    """Daily totals in folders by product, issue month and issue.

    Each issue of ``df`` replaces what is stored of that issue; the other issues of its month stay. With
    ``whole`` the table is replaced.
    """
    stage(_by_issue(df), path, *ISSUE_FOLDERS, whole=whole)


def forecast(df: DataFrame, path: str) -> None:
    """6-hourly forecasts in folders by product, issue month and issue, ordered for cell slices.

    Each issue of ``df``, with all its variables, replaces what is stored of that issue; the other issues
    of its month stay. The base time is parsed from ``units`` here, so that no later pass over the steps
    does.
    """
    by_issue = _by_issue(df).withColumn("base_ts", dates.parse_units(F.col("units")))
    (
        by_issue.hint("rebalance", *ISSUE_FOLDERS)
        .sortWithinPartitions(*ISSUE_FOLDERS, "lat_idx", "lon_idx", "step")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*ISSUE_FOLDERS)
        .parquet(path)
    )


def issue_list(issues: DataFrame, path: str) -> None:
    rows = issues.select(F.col("issue_id").alias("lista")).orderBy("lista")
    rows.write.mode("overwrite").csv(path, header=True)


def realtime_manifest(manifest: DataFrame, path: str) -> None:
    rows = manifest.select(F.col("url").alias("lista")).orderBy("lista")
    rows.write.mode("overwrite").csv(path, header=True)


def forecast_table(wide: DataFrame, *paths: str) -> None:
    """The corrected forecast (a row per station) as CSV, to each destination. It is computed for the
    first one and copied from there."""
    for i, path in enumerate(paths):
        rows = wide
        if i:
            rows = wide.sparkSession.read.schema(wide.schema).csv(paths[0], header=True)
        rows.orderBy("location").write.mode("overwrite").csv(path, header=True)


def valid_days(days: DataFrame, path: str) -> None:
    days.orderBy("valid_date").write.mode("overwrite").csv(path, header=True)


def daily_grids(grid: DataFrame, path: str) -> None:
    """One folder per day; days already there are replaced, others stay."""
    stage(grid, path, "valid_date")


def series(df: DataFrame, path: str) -> None:
    """A station or cell series as Parquet in day order within files."""
    df.sortWithinPartitions("valid_date").write.mode("overwrite").parquet(path)


def geojson_basins(basins: DataFrame, path: str, name: str = "NOMBRE") -> None:
    """Outlines as GeoJSON, a Feature a line; the rings of one name become one Polygon, whose holes the
    even-odd rule finds whatever their order."""
    point = lambda p: F.array(p["x"], p["y"])
    ring = F.transform(F.concat("ring", F.slice("ring", 1, 1)), point)
    outlines = basins.filter(F.size("ring") > 0).groupBy("name").agg(F.collect_list(ring).alias("rings"))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.create_map(F.lit(name), F.col("name")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.col("rings").alias("coordinates")).alias("geometry"),
    )
    outlines.select(F.to_json(feature).alias("value")).write.mode("overwrite").text(path)
