"""One value per cell and day from the last issues that forecast it."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvia.config import Product
from pluvia.functions import dates

KEYS = ("product", "cell_id", "valid_date")


def last_issues(daily: DataFrame, n: int) -> DataFrame:
    """The last ``n`` issues with a value for each cell and day; rank 1 is the newest.

    Spark cuts each map task to ``n`` rows per key before the shuffle (window group limit),
    so a key with very many issues costs no more than one with few.
    """
    newest = Window.partitionBy(*KEYS).orderBy(F.desc("issue_ts"))
    mm = F.col("mm")
    present = daily.filter(mm.isNotNull()).filter(~F.isnan(mm))  # the first reaches the scan
    ranked = present.withColumn("rank", F.row_number().over(newest))
    return ranked.filter(F.col("rank") <= n)


def vote(last: DataFrame, product: Product) -> DataFrame:
    """Mean of the wet values where the share of wet issues is high enough, else 0."""
    wet = F.col("mm") > product.tol
    counted = last.groupBy(*KEYS).agg(
        F.count("*").alias("n_issues"),
        F.count_if(wet).alias("n_wet"),
        F.avg(F.when(wet, F.col("mm"))).alias("wet_mean"),
    )
    p, q = product.wet_ratio
    enough = F.col("n_wet") * q >= F.col("n_issues") * p
    mm = F.when(enough, F.coalesce("wet_mean", F.lit(0.0))).otherwise(0.0)
    return counted.select(*KEYS, mm.alias("mm"), "n_issues", "n_wet")


def cell_days(
    daily: DataFrame,
    product: Product,
    start: dt.date | None = None,
    end: dt.date | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """Every cell times every day of the product's range.

    Without a fixed range it runs from the first issue's date over the horizon, or to the
    last valid day where the product has no horizon. A ``cells`` table (``cell_id``) saves
    the pass over the forecasts that finds their cells.
    """
    cells = (daily if cells is None else cells).select(
        F.lit(product.name).alias("product"), "cell_id"
    ).distinct()
    start, end = start or product.start, end or product.end
    if start and end:
        return dates.explode_days(cells, F.lit(start), F.lit(end))
    ends = daily.agg(
        F.to_date(F.min("issue_ts")).alias("first"), F.max("valid_date").alias("last")
    )
    first = F.lit(start) if start else ends.select("first").scalar()
    if end:
        last = F.lit(end)
    elif product.horizon_days:
        last = F.date_add(first, product.horizon_days - 1)
    else:
        last = ends.select("last").scalar()
    return dates.explode_days(cells, first, last)


def consensus(
    daily: DataFrame,
    product: Product,
    start: dt.date | None = None,
    end: dt.date | None = None,
    cells: DataFrame | None = None,
) -> DataFrame:
    """The vote for every cell and day of the range; a day nobody forecast is 0."""
    start, end = start or product.start, end or product.end
    spine = cell_days(daily, product, start, end, cells)
    if start:
        daily = daily.filter(F.col("valid_date") >= F.lit(start))
    if end:
        daily = daily.filter(F.col("valid_date") <= F.lit(end))
    voted = vote(last_issues(daily, product.last_n), product)
    return spine.join(voted, list(KEYS), "left").na.fill({"mm": 0.0, "n_issues": 0, "n_wet": 0})


def union_products(*series: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, series)
