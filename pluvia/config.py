"""Settings of the three forecast products and the constants they share."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass


@dataclass(frozen=True)
class Product:
    """One forecast product.

    ``wet_ratio`` is the smallest share of wet issues that makes a day wet,
    held as the integer pair (p, q): ``n_wet / n >= p / q``. ``start`` is None
    where the range follows the data (``horizon_days`` from the first issue).
    """

    name: str
    shift_hours: int
    wet_ratio: tuple[int, int]
    last_n: int = 12
    tol: float = 0.5
    start: dt.date | None = None
    end: dt.date | None = None
    horizon_days: int | None = None


# Day shift, wet share (1/2, 1/5, 1/3.33) and date range of each product.
REFORECAST = Product(
    "reforecast", 12, (1, 2), start=dt.date(1994, 1, 1), end=dt.date(2010, 12, 27)
)
OPERATIONAL = Product(
    "operational", 18, (1, 5), start=dt.date(2011, 3, 31), end=dt.date(2016, 12, 31)
)
REALTIME = Product("realtime", 6, (100, 333), horizon_days=15)

# Crop box in degrees (west, east, south, north).
CROP_BOX = (-74.5, -68.0, -35.433, -31.653)

# File axes of the cropped 7 x 5 grid, in file order.
GRID_LON360 = (286.090, 287.028, 287.966, 288.904, 289.842, 290.780, 291.718)
GRID_LAT = (-31.65342, -32.59830, -33.54318, -34.48805, -35.43293)

# The inner 3 x 3 grid in 1-based file indices, and its height.
INNER_LON = (3, 5)
INNER_LAT = (2, 4)
INNER_SIDE = 3

# Seconds in one 6-hourly step (rate per second -> mm).
STEP_HOURS = 6
STEP_SECONDS = 6 * 3600

# Issue hours of a day, and days between issues of the reforecast calendar.
ISSUE_HOURS = ("00", "06", "12", "18")
CALENDAR_STEP_DAYS = 5

# Public address and file name pattern of the real-time forecasts.
REALTIME_BASE_URL = "http://nomads.ncep.noaa.gov/pub/data/nccf/com/cfs/prod/cfs/"
VARIABLE = "prate"

# Thresholds of the contingency table and period of the verification.
WET_FORECAST = 0.5
WET_OBSERVED = 0.0
VERIFY_START = dt.date(2011, 3, 31)
VERIFY_END = dt.date(2016, 12, 31)

# Lower bounds of the gamma fits (observed, model) by use.
BOUNDS_REALTIME = (0.1, 0.5)
BOUNDS_DASHBOARD = (0.01, 0.5)
BOUNDS_DASHBOARD_REALTIME = (0.0, 0.0)

# Interpolation grid size and power, and the value classes of its map.
IDW_POINTS = 50_000
IDW_POWER = 2.0
BIN_DOMAIN = (2.0, 35.0)
BIN_COUNT = 25
