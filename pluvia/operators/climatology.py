"""Wet forecast days by cell and calendar month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvia.config import REFORECAST
from pluvia.functions import units


def wet_days(daily: DataFrame, tol: float) -> DataFrame:
    return daily.filter(units.known(F.col("mm")) > tol)


def pool(daily: DataFrame, tol: float = REFORECAST.tol) -> DataFrame:
    """Wet days forecast by an issue of their own calendar month."""
    same_month = F.month("issue_ts") == F.month("valid_date")
    return wet_days(daily, tol).filter(same_month).select(
        "cell_id", F.month("valid_date").alias("month"), "mm"
    )


def stats(sample: DataFrame, *keys: str) -> DataFrame:
    """Size, mean, mean logarithm and maximum of a positive sample per key."""
    return sample.groupBy(*keys).agg(
        F.count("mm").alias("n"),
        F.avg("mm").alias("mean"),
        F.avg(F.ln("mm")).alias("mean_log"),
        F.max("mm").alias("max_mm"),
    )
