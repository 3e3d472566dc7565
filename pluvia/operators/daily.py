"""From 6-hourly grid rows to daily totals per issue and cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.config import CROP_BOX, INNER_LAT, INNER_LON, INNER_SIDE, Product
from pluvia.functions import dates, units


def slice_cell(forecast: DataFrame, lat_idx: int, lon_idx: int) -> DataFrame:
    """The time series of one grid cell; both filters reach the Parquet scan."""
    return forecast.filter((F.col("lat_idx") == lat_idx) & (F.col("lon_idx") == lon_idx))


def crop(forecast: DataFrame, box: tuple[float, float, float, float] = CROP_BOX) -> DataFrame:
    """Rows inside a box given as (west, east, south, north); ``lon`` is signed."""
    west, east, south, north = box
    return forecast.filter(
        F.col("lon").between(west, east) & F.col("lat").between(south, north)
    )


def inner_cell_id(lat_idx: Column, lon_idx: Column) -> Column:
    """Number of an inner cell, counted along latitude first."""
    return lat_idx - INNER_LAT[0] + 1 + INNER_SIDE * (lon_idx - INNER_LON[0])


def subgrid(forecast: DataFrame) -> DataFrame:
    """The inner 3 x 3 cells, numbered."""
    inner = forecast.filter(
        F.col("lat_idx").between(*INNER_LAT) & F.col("lon_idx").between(*INNER_LON)
    )
    return inner.withColumn("cell_id", inner_cell_id(F.col("lat_idx"), F.col("lon_idx")))


def of_variable(forecast: DataFrame, variable: str) -> DataFrame:
    return forecast.filter(F.col("variable") == variable)


def base_time(steps: DataFrame) -> Column:
    """Time of step 0: stored, else from ``units``, else the issue time."""
    if "base_ts" in steps.columns:
        return F.col("base_ts")
    return dates.parse_units(F.col("units")) if "units" in steps.columns else F.col("issue_ts")


def whole_sum(column: str) -> Column:
    """Sum of a group; NULL if any of its values is."""
    return F.when(F.count(column) == F.count("*"), F.sum(column))


def daily_totals(
    steps: DataFrame, product: Product, placement: str = "valid_time"
) -> DataFrame:
    """Total mm per issue, cell and local day.

    Partly covered first and last days count as they are. A missing step, NULL or NaN, makes its
    day NULL.
    ``placement='issue_hour'`` starts an issue on the day its hour names instead of the day
    its times name.
    """
    base = base_time(steps)
    valid = dates.valid_date(base, F.col("step"), product.shift_hours)
    if placement == "issue_hour":
        valid = dates.issue_hour_date(F.col("issue_ts"), base, valid, product.shift_hours)
    elif placement != "valid_time":
        raise ValueError(f"unknown placement: {placement}")
    mm = units.known(units.rate_to_mm(F.col("prate")))
    rows = steps.select("issue_ts", "cell_id", valid.alias("valid_date"), mm.alias("mm"))
    totals = rows.groupBy("issue_ts", "cell_id", "valid_date").agg(whole_sum("mm").alias("mm"))
    return totals.select(
        F.lit(product.name).alias("product"), "issue_ts", "cell_id", "valid_date", "mm"
    )


def issue_lengths(daily: DataFrame) -> DataFrame:
    """Days per issue."""
    return daily.groupBy("product", "issue_ts").agg(F.countDistinct("valid_date").alias("n_days"))


def issue_length_stats(daily: DataFrame) -> DataFrame:
    """Shortest and longest issue in days, and the number of issues."""
    return issue_lengths(daily).groupBy("product").agg(
        F.min("n_days").alias("min_days"),
        F.max("n_days").alias("max_days"),
        F.count("*").alias("n_issues"),
    )


def day_axis(daily: DataFrame) -> DataFrame:
    """First and last valid day of each product and the number of days between, both included."""
    ends = daily.groupBy("product").agg(
        F.min("valid_date").alias("first_day"), F.max("valid_date").alias("last_day")
    )
    return ends.withColumn("n_days", F.datediff("last_day", "first_day") + 1)


def issue_span_axis(issues: DataFrame, margin_days: int = 500) -> DataFrame:
    """The axis sized from the issue list: from the day before the first issue, for the rounded
    span of issues plus a margin for the lead time."""
    ends = issues.agg(F.min("issue_ts").alias("first_ts"), F.max("issue_ts").alias("last_ts"))
    length = dates.days_between(F.col("first_ts"), F.col("last_ts")) + margin_days
    return ends.select(
        F.date_sub(F.to_date("first_ts"), 1).alias("first_day"), length.alias("n_days")
    )


def day_spine(daily: DataFrame) -> DataFrame:
    """Every day from the day before the first valid day to the last one, per product."""
    axis = day_axis(daily)
    spine = dates.explode_days(axis, F.date_sub("first_day", 1), F.col("last_day"))
    return spine.select("product", "valid_date")


def brick(daily: DataFrame) -> DataFrame:
    """One product's daily totals with the brick's column name and each day's row (from 1) on
    the common axis."""
    first_day = daily.agg(F.min("valid_date").alias("day")).scalar()
    parts = dates.issue_parts(dates.issue_id(F.col("issue_ts")))
    return daily.select(
        "product", "cell_id", parts["column_name"].alias("issue_column"), "valid_date",
        (F.datediff("valid_date", first_day) + 1).alias("day_index"), "mm",
    )


def brick_wide(daily: DataFrame, issue_columns: list[str]) -> DataFrame:
    """The brick as a table: a row per cell and day, a column per named issue."""
    named = daily.withColumn(
        "issue_column", dates.issue_parts(dates.issue_id(F.col("issue_ts")))["column_name"]
    )
    keys = ("product", "cell_id", "valid_date")
    return named.groupBy(*keys).pivot("issue_column", issue_columns).agg(F.first("mm"))
