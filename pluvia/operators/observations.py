"""Station observations: reshape, ranges and samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.functions import dates, text, units


def unpivot(wide: DataFrame, date_column: str = "DateTime") -> DataFrame:
    """Wide station table (a column per station, dots for spaces) to one row per station and day."""
    stations = [c for c in wide.columns if c != date_column]
    quoted = [F.col(f"`{c}`").alias(c.replace(".", " ")) for c in stations]
    renamed = wide.select(F.col(date_column).alias("obs_date"), *quoted)
    names = [c.replace(".", " ") for c in stations]
    long = renamed.unpivot("obs_date", names, "location", "mm")
    return long.withColumn("mm", units.known(F.col("mm")))


def parse_wide_dates(wide: DataFrame, date_column: str = "DateTime") -> DataFrame:
    return wide.withColumn(date_column, dates.parse_mdy(F.col(date_column)))


def pivot(obs: DataFrame, stations: list[str]) -> DataFrame:
    """One row per day, one column per named station (dots for spaces)."""
    named = obs.withColumn("location", text.dotted(F.col("location")))
    columns = [s.replace(" ", ".") for s in stations]
    return named.groupBy("obs_date").pivot("location", columns).agg(F.first("mm"))


def date_range(
    df: DataFrame, start: dt.date, end: dt.date, column: str = "obs_date"
) -> DataFrame:
    return df.filter(F.col(column).between(F.lit(start), F.lit(end)))


def month_wet(obs: DataFrame, month: int | None = None, tol: float = 0.0) -> DataFrame:
    """Wet observations with their month; of one month if given. All stations at once."""
    wet = obs.filter(units.known(F.col("mm")) > tol).withColumn("month", F.month("obs_date"))
    return wet if month is None else wet.filter(F.col("month") == month)


def of_station(df: DataFrame, location: str) -> DataFrame:
    """One station by its exact name."""
    return df.filter(F.col("location") == location)


def clamped(obs: DataFrame, tol: float) -> DataFrame:
    return obs.withColumn("mm", units.clamp(F.col("mm"), tol))


def maximum(obs: DataFrame, *keys: str) -> DataFrame:
    return obs.groupBy(*keys).agg(F.max(units.known(F.col("mm"))).alias("max_mm"))
