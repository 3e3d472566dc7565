"""Calendar columns. All times are zone-free (TIMESTAMP_NTZ), so the session zone plays no part."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia.config import CALENDAR_STEP_DAYS, ISSUE_HOURS, STEP_HOURS

ISSUE_FORMAT = "yyyyMMddHH"


def issue_id(ts: Column) -> Column:
    """``YYYYMMDDHH`` of a time. Cut from its text, as ``date_format`` would use the zone."""
    return F.translate(ts.cast("string"), "-: ", "").substr(1, 10)


def month_label(ts: Column) -> Column:
    """``YYYY-MM`` of a time."""
    return ts.cast("string").substr(1, 7)


def parse_issue(text: Column) -> Column:
    """``YYYYMMDDHH`` to a time."""
    return F.to_timestamp_ntz(text, F.lit(ISSUE_FORMAT))


def parse_day(text: Column) -> Column:
    """``YYYYMMDD`` to a date."""
    return F.to_date(text, "yyyyMMdd")


def parse_mdy(text: Column) -> Column:
    """``M/D/YYYY`` to a date."""
    return F.to_date(text, "M/d/yyyy")


def parse_units(units: Column) -> Column:
    """Base time of ``hours since DATE TIME``; the time may come as H:M or H:M:S."""
    four_words = F.substring_index(units, " ", 4)
    return F.substring_index(four_words, " ", -2).cast("timestamp_ntz")


def issue_parts(text: Column) -> dict[str, Column]:
    """Year, month and day+hour of an issue id, and the brick column name made of them."""
    year, month, day_hour = text.substr(1, 4), text.substr(5, 2), text.substr(7, 4)
    return {
        "year": year,
        "month": month,
        "day_hour": day_hour,
        "column_name": F.concat_ws("_", year, month, day_hour),
    }


def valid_ts(base: Column, step: Column, shift_hours: int) -> Column:
    """Time of 6-hourly step ``step`` (from 0), moved to the local day by a fixed shift."""
    return base + F.make_dt_interval(hours=step * STEP_HOURS - shift_hours)


def valid_date(base: Column, step: Column, shift_hours: int) -> Column:
    """Local day of a step: the date of ``valid_ts``, in whole hours as intervals cost more."""
    hours = F.hour(base) + step * STEP_HOURS - shift_hours
    return F.date_add(F.to_date(base), F.floor(hours / 24).cast("int"))


def issue_hour_start(issue_ts: Column) -> Column:
    """First day of an issue by its hour: 18Z starts on its own date, the others a day before."""
    day = F.to_date(issue_ts)
    return F.when(F.hour(issue_ts) == 18, day).otherwise(F.date_sub(day, 1))


def issue_hour_date(issue_ts: Column, base: Column, valid: Column, shift_hours: int) -> Column:
    """``valid`` moved so that the issue's first day falls on ``issue_hour_start``."""
    first = valid_date(base, F.lit(0), shift_hours)
    return F.date_add(issue_hour_start(issue_ts), F.datediff(valid, first))


def days_between(first: Column, last: Column) -> Column:
    """Span of two times (whole hours) in days, rounded."""
    days = F.datediff(F.to_date(last), F.to_date(first))
    return F.round(days + (F.hour(last) - F.hour(first)) / 24.0).cast("int")


def explode_issue_calendar(
    span: DataFrame,
    start: Column,
    end: Column,
    every_days: int = CALENDAR_STEP_DAYS,
    hours: tuple[str, ...] = ISSUE_HOURS,
) -> DataFrame:
    """Issue ids every ``every_days`` days at each hour, for each row's start and end date."""
    days = F.sequence(start, end, F.make_dt_interval(days=F.lit(every_days)))
    ids = span.select(F.explode(days).alias("issue_date")).select(
        "issue_date", F.explode(F.array(*[F.lit(h) for h in hours])).alias("hour")
    )
    ids = ids.select(F.concat(F.translate(F.col("issue_date").cast("string"), "-", ""), "hour").alias("issue_id"))
    return ids.select("issue_id", parse_issue(F.col("issue_id")).alias("issue_ts"))


def issue_calendar(spark: SparkSession, start: dt.date, end: dt.date, **options) -> DataFrame:
    span = spark.range(1).select(F.lit(start).alias("s"), F.lit(end).alias("e"))
    return explode_issue_calendar(span, F.col("s"), F.col("e"), **options)


def explode_days(df: DataFrame, start: Column, end: Column, name: str = "valid_date") -> DataFrame:
    """One row per day from ``start`` to ``end``, both included, for each row of ``df``."""
    return df.withColumn(name, F.explode(F.sequence(start, end)))
