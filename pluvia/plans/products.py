"""The products end to end, from gridded forecasts to station forecasts and grids."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvia import schemas
from pluvia.config import (
    BOUNDS_DASHBOARD,
    BOUNDS_REALTIME,
    IDW_POINTS,
    OPERATIONAL,
    REALTIME,
    REFORECAST,
    VERIFY_END,
    VERIFY_START,
    Product,
)
from pluvia.operators import (
    climatology,
    correction,
    daily,
    fitting,
    interpolation,
    observations,
    verification,
)
from pluvia.operators import consensus as vote
from pluvia.operators import stations as st
from pluvia.sources import readers, writers


@dataclass(frozen=True)
class Fits:
    """Gamma parameters: ``model`` by (cell_id, month), ``observed`` by (location, month)."""

    model: DataFrame
    observed: DataFrame


def fit_all(
    pool: DataFrame, obs: DataFrame, bounds: tuple[float, float] = BOUNDS_REALTIME
) -> Fits:
    """Fits of every cell, station and month; ``bounds`` are (observed, model)."""
    wet = observations.month_wet(obs)
    return Fits(
        model=fitting.gamma_fit(pool, "cell_id", "month", lower=bounds[1]),
        observed=fitting.gamma_fit(wet, "location", "month", lower=bounds[0]),
    )


def stage_fits(spark: SparkSession, fits: Fits, out: str) -> Fits:
    """The fits, written and read back: Spark then knows how small they are and may broadcast
    them, where a plan over the samples would shuffle the forecasts to meet them."""
    writers.stage(fits.model, f"{out}/fits_model")
    writers.stage(fits.observed, f"{out}/fits_observed")
    return Fits(
        readers.stage(spark, f"{out}/fits_model"), readers.stage(spark, f"{out}/fits_observed")
    )


def station_forecast(
    stations: DataFrame, cells: DataFrame, consensus: DataFrame, fits: Fits,
    month: int | None = None,
) -> DataFrame:
    """Corrected series of every station. ``month`` fixes the fits' month (the month of issue)."""
    near = st.nearest_cell(stations, cells)
    series = st.station_series(near, consensus)
    return correction.quantile_map(series, fits.model, fits.observed, month)


def station_scores(
    corrected: DataFrame, obs: DataFrame,
    start: dt.date = VERIFY_START, end: dt.date = VERIFY_END,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Contingency table, skill scores and continuous scores by station and month."""
    forecast = corrected.select("location", "valid_date", F.col("mm_corrected").alias("mm"))
    paired = verification.pairs(forecast, observations.date_range(obs, start, end))
    paired = paired.withColumn("month", F.month("valid_date"))
    keys = ("location", "month")
    table = verification.contingency(paired, *keys)
    return (
        table,
        verification.skill_scores(table, *keys),
        verification.continuous_scores(paired, *keys),
    )


def station_report(
    pool: DataFrame, obs: DataFrame, near: DataFrame,
    bounds: tuple[float, float] = BOUNDS_DASHBOARD,
) -> tuple[DataFrame, DataFrame]:
    """Parameter table and distribution curves of every station and month.

    ``near`` gives each station's ``cell_id``.
    """
    fits = fit_all(pool, obs, bounds)
    model = near.select("location", "cell_id").join(fits.model, "cell_id").drop("cell_id")
    params = fitting.params_table(fits.observed, model)
    largest = observations.maximum(observations.month_wet(obs), "location", "month")
    return params, fitting.cdf_curve(params, largest, "location", "month")


def corrected_grids(
    corrected: DataFrame, stations: DataFrame, basins: DataFrame, n: int = IDW_POINTS
) -> DataFrame:
    """Corrected station forecasts on the basins' grid, a value per day and point inside."""
    grid = interpolation.Grid.over(interpolation.ring_box(basins), n)
    points = interpolation.basin_mask(basins, grid)
    located = corrected.join(stations.select("location", "lat", "lon"), "location").select(
        "location", "lon", "lat", "valid_date", F.col("mm_corrected").alias("mm")
    )
    return interpolation.idw(located, points, grid)


def build_brick(
    spark: SparkSession, forecast_path: str, product: Product, out: str,
    placement: str = "valid_time", first_issue: dt.datetime | None = None,
    last_issue: dt.datetime | None = None, whole: bool = False,
) -> DataFrame:
    """Daily totals of one product on the inner grid, written and read back.

    Only the given range of issues is read, and only that is returned: the folder may hold other
    issues from before. With ``whole`` they go.
    """
    issues = first_issue, last_issue
    steps = daily.subgrid(readers.forecast(spark, forecast_path, product.name, *issues))
    writers.daily(daily.daily_totals(steps, product, placement), out, whole)
    return readers.daily_totals(spark, out, product.name, *issues)


def build_reforecast(spark: SparkSession, forecast_path: str, out: str) -> None:
    """Brick, monthly pools and consensus of the reforecast."""
    brick = build_brick(spark, forecast_path, REFORECAST, f"{out}/daily")
    writers.stage(climatology.pool(brick), f"{out}/climatology", "month")
    writers.stage(vote.consensus(brick, REFORECAST), f"{out}/consensus")


def build_consensus(
    spark: SparkSession, forecast_path: str, product: Product, out: str,
    first_issue: dt.datetime | None = None, last_issue: dt.datetime | None = None,
    whole: bool = False,
) -> DataFrame:
    """Brick and consensus of one product from a range of issues."""
    brick = build_brick(
        spark, forecast_path, product, f"{out}/daily",
        first_issue=first_issue, last_issue=last_issue, whole=whole,
    )
    writers.stage(vote.consensus(brick, product), f"{out}/consensus")
    return readers.stage(spark, f"{out}/consensus", schemas.CONSENSUS)


@dataclass(frozen=True)
class Verification:
    """Contingency table, skill scores and continuous scores by station and month."""

    table: DataFrame
    skill: DataFrame
    errors: DataFrame


def build_verification(
    spark: SparkSession, forecast_path: str, reforecast: str, obs: DataFrame,
    stations: DataFrame, cells: DataFrame, out: str, product: Product = OPERATIONAL,
    bounds: tuple[float, float] = BOUNDS_DASHBOARD,
    start: dt.date = VERIFY_START, end: dt.date = VERIFY_END,
) -> Verification:
    """Consensus, fits and corrected series of a product, each stored once, and their scores.

    Each day is corrected with the fits of its own month and counts in that month's scores.
    ``reforecast`` is the output folder of ``build_reforecast``.
    """
    series = build_consensus(spark, forecast_path, product, out)
    pool = readers.stage(spark, f"{reforecast}/climatology", schemas.CLIMATOLOGY)
    fits = stage_fits(spark, fit_all(pool, obs, bounds), out)
    writers.series(station_forecast(stations, cells, series, fits), f"{out}/corrected")
    corrected = readers.stage(spark, f"{out}/corrected", schemas.CORRECTED)
    return Verification(*station_scores(corrected, obs, start, end))


def build_realtime(
    spark: SparkSession, forecast_path: str, reforecast: str, obs: DataFrame,
    stations: DataFrame, cells: DataFrame, basins: DataFrame, as_of: dt.date, out: str,
    *copies: str, first_issue: dt.datetime, last_issue: dt.datetime | None = None,
    n: int = IDW_POINTS, bounds: tuple[float, float] = BOUNDS_REALTIME,
) -> str:
    """Real-time consensus, corrected stations, export table, day list and daily grids of one run.

    The run has the issues from ``first_issue`` on, whatever else the forecast table holds, and its
    days start with that issue. ``reforecast`` is the output folder of ``build_reforecast``;
    ``as_of`` names the month whose fits correct all days: only that month is read and fitted. All
    goes to a folder of the run below ``out``, which is returned; a run that is repeated replaces it.
    """
    out = f"{out}/run={as_of:%Y%m%d}-{first_issue:%Y%m%d%H}"
    series = build_consensus(
        spark, forecast_path, REALTIME, out, first_issue, last_issue, whole=True
    )
    month = as_of.month
    pool = readers.stage(spark, f"{reforecast}/climatology", schemas.CLIMATOLOGY)
    pool = pool.filter(F.col("month") == month)
    of_month = obs.filter(F.month("obs_date") == month)
    fits = stage_fits(spark, fit_all(pool, of_month, bounds), out)
    corrected = station_forecast(stations, cells, series, fits, month=month)
    writers.series(corrected, f"{out}/stations")
    corrected = readers.stage(spark, f"{out}/stations", schemas.CORRECTED)
    first = corrected.agg(F.min("valid_date")).first()[0]
    days = [first + dt.timedelta(days=i) for i in range(REALTIME.horizon_days)]
    export = st.forecast_export(corrected, stations, days)
    writers.forecast_table(export, f"{out}/export", *copies)
    writers.valid_days(st.valid_days(corrected), f"{out}/days")
    grids = corrected_grids(corrected, stations, basins, n)
    writers.stage(grids, f"{out}/grids", "valid_date", whole=True)
    return out
