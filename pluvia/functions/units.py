"""Rates, longitudes and value classes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pluvia.config import BIN_COUNT, BIN_DOMAIN, STEP_SECONDS


def known(value: Column) -> Column:
    """The value, NaN as NULL: Spark orders NaN above all numbers, so it would count as rain."""
    return F.when(~F.isnan(value), value)


def rate_to_mm(prate: Column) -> Column:
    """Precipitation rate per second to the total of one 6-hour step."""
    return prate * float(STEP_SECONDS)


def signed_longitude(lon: Column) -> Column:
    """Longitude in 0..360 to -180..180."""
    return F.when(lon > 180, lon - 360.0).otherwise(lon)


def clamp(mm: Column, tol: float) -> Column:
    """Values below ``tol`` become 0."""
    return F.when(mm < tol, F.lit(0.0)).otherwise(mm)


def round_step(low: float, high: float, bins: int) -> float:
    """Width of about ``bins`` classes between two values, rounded to 1, 2, 5 or 10 tens.

    A wider step is tried only after the narrower one was taken. It is taken if the raw width is
    nearer to it than to the step before, whose distance counts 1.5 times, for 5 tens 2.75 times.
    """
    raw = (high - low) / bins
    tens = 10.0 ** math.floor(math.log10(raw))
    step = tens
    for wider, weight in ((2.0, 1.5), (5.0, 2.75), (10.0, 1.5)):
        if wider * tens - raw >= weight * (raw - step):
            break
        step = wider * tens
    return step


def value_class(
    mm: Column, domain: tuple[float, float] = BIN_DOMAIN, bins: int = BIN_COUNT
) -> Column:
    """Class number from 1, lower edge included; NULL outside the domain."""
    step = round_step(*domain, bins)
    low, high = math.floor(domain[0] / step) * step, math.ceil(domain[1] / step) * step
    count = round((high - low) / step)
    inside = F.least(F.width_bucket(mm, F.lit(low), F.lit(high), F.lit(count)), F.lit(count))
    return F.when(mm.between(*domain), inside)
