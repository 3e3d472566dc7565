"""Lists of forecast issues: links, addresses, availability, order and gaps."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.config import ISSUE_HOURS, REALTIME_BASE_URL
from pluvia.functions import dates, text


def extract_links(pages: DataFrame, *keys: str) -> DataFrame:
    """One row per link target of each index page, with its position from 0."""
    return pages.select(*keys, F.posexplode(text.links(F.col("html"))).alias("pos", "link"))


def folder_links(pages: DataFrame, *keys: str) -> DataFrame:
    """The links without the first one of each page, which leads to the parent folder."""
    return extract_links(pages, *keys).filter(F.col("pos") > 0)


def realtime_manifest(
    links: DataFrame, hours: tuple[str, ...] = ISSUE_HOURS, base: str = REALTIME_BASE_URL
) -> DataFrame:
    """Every link times every issue hour, with the file address of each."""
    by_hour = links.withColumn("hour", F.explode(F.array(*[F.lit(h) for h in hours])))
    return by_hour.withColumn("url", text.realtime_url(F.col("link"), F.col("hour"), base))


def present(manifest: DataFrame, available: DataFrame, key: str = "issue_id") -> DataFrame:
    return manifest.join(available, key, "left_semi")


def missing(manifest: DataFrame, available: DataFrame, key: str = "issue_id") -> DataFrame:
    return manifest.join(available, key, "left_anti")


def manifest_slice(manifest: DataFrame, first: int, last: int) -> DataFrame:
    """Entries ``first`` to ``last`` (from 1) in issue order."""
    return manifest.orderBy("issue_id").offset(first - 1).limit(last - first + 1)


def overdue(
    expected: DataFrame, arrivals: DataFrame, latency: dt.timedelta, now: Column
) -> DataFrame:
    """Issues that were not there in time, as known at ``now``: ``issue_id, status, due, arrived``.

    ``expected`` (``issue_id, issue_ts``) are due ``latency`` after their time. ``arrivals``
    (``issue_id, arrived``) may have many rows an issue, of which the first counts. An issue is ``late``
    if that is after the due time, and ``missing`` if there is none and the due time is over.
    """
    first = arrivals.groupBy("issue_id").agg(F.min("arrived").alias("arrived"))
    due = F.col("issue_ts") + F.expr(f"INTERVAL {int(latency.total_seconds())} SECONDS")
    status = F.when(F.col("arrived") > F.col("due"), "late").when(
        F.col("arrived").isNull() & (F.col("due") < now), "missing"
    )
    known = expected.select("issue_id", due.alias("due")).distinct().join(first, "issue_id", "left")
    return known.select("issue_id", status.alias("status"), "due", "arrived").filter("status IS NOT NULL")


def issue_ordinal(issues: DataFrame) -> DataFrame:
    """Position (from 1) of each issue in time order.

    Issues are ranked within their day; a running count over days adds what lies before,
    so no task sorts the whole list.
    """
    issues = issues.select("issue_id", "issue_ts").withColumn("day", F.to_date("issue_ts"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = issues.groupBy("day").agg(F.count("*").alias("n"))
    days = days.select("day", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    within = F.row_number().over(Window.partitionBy("day").orderBy("issue_ts"))
    return (
        issues.withColumn("rank", within)
        .join(days, "day")
        .select("issue_id", "issue_ts", (F.col("earlier") + F.col("rank")).alias("ordinal"))
    )


def day_offset(issue_ts: Column, first_ts: Column) -> Column:
    """Days between an issue and the first one, by date."""
    return F.datediff(F.to_date(issue_ts), F.to_date(first_ts))


def gap_report(issues: DataFrame, per_day: int = len(ISSUE_HOURS)) -> DataFrame:
    """Every day of the list's span with its offset, number of issues and number missing."""
    by_day = issues.groupBy(F.to_date("issue_ts").alias("issue_date")).agg(
        F.countDistinct("issue_ts").alias("n_issues")
    )
    span = by_day.agg(F.min("issue_date").alias("first"), F.max("issue_date").alias("last"))
    axis = dates.explode_days(span, F.col("first"), F.col("last"), "issue_date")
    found = F.coalesce("n_issues", F.lit(0))
    return axis.join(by_day, "issue_date", "left").select(
        "issue_date",
        F.datediff("issue_date", "first").alias("offset"),
        found.alias("n_issues"),
        (F.lit(per_day) - found).alias("n_missing"),
    )
