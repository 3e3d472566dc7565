"""One query per operator over the driver's tables.

``publish`` gives all results the same plain types: text for dates and times, BIGINT for
whole numbers, doubles rounded. ``checks.oracle`` holds the same queries in SQL.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import standins as v
from pluvia import schemas, session
from pluvia.config import (
    BOUNDS_DASHBOARD_REALTIME,
    BOUNDS_REALTIME,
    OPERATIONAL,
    REALTIME,
    REFORECAST,
    Product,
)
from pluvia.functions import dates, gamma, text, units
from pluvia.operators import (
    climatology,
    correction,
    daily,
    fitting,
    interpolation,
    manifest,
    observations,
    polygons,
    verification,
)
from pluvia.operators import consensus as vote
from pluvia.operators import stations as st
from pluvia.plans import products
from pluvia.sources import readers, writers
from pluvia.streaming import ingest, stateful

Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}

# Added before rounding: averages often end on a decimal tie, which engines round apart.
TIE_BREAK = 3e-8


def publish(df: DataFrame, digits: dict[str, int] | None = None) -> DataFrame:
    digits = digits or {}

    def plain(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            c = F.round(c + TIE_BREAK, digits.get(field.name, 6))
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(field.dataType, (T.DateType, T.TimestampNTZType)):
            c = c.cast("string")
        return c.alias(field.name)

    return df.select(*[plain(f) for f in df.schema.fields])


def query(fn: Callable | None = None, **digits: int):
    """Register a query under its function name; ``digits`` sets the decimals of a column."""

    def register(f: Query) -> Query:
        _REGISTRY[f.__name__] = lambda spark, sf: publish(f(spark, sf), digits)
        return f

    return register(fn) if fn else register


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---- shared steps ------------------------------------------------------------------------


def totals(spark, sf, product: Product, **options) -> DataFrame:
    return daily.daily_totals(v.forecast_6h(spark, sf).drop("units"), product, **options)


def series(spark, sf, product: Product) -> DataFrame:
    start, end = (None, None) if product.horizon_days else v.RANGE
    return vote.consensus(totals(spark, sf, product), product, start, end)


def monthly_pool(spark, sf) -> DataFrame:
    return climatology.pool(totals(spark, sf, REFORECAST))


def fits(spark, sf, bounds: tuple[float, float] = BOUNDS_REALTIME) -> products.Fits:
    return products.fit_all(monthly_pool(spark, sf), v.obs_hist(spark, sf), bounds)


def corrected(spark, sf, product: Product, month: int | None = v.AS_OF.month, **bounds) -> DataFrame:
    return products.station_forecast(
        v.stations(spark, sf), v.cells(spark), series(spark, sf, product),
        fits(spark, sf, **bounds), month=month,
    )


def scores(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each day corrected with its own month's fits, and scored in that month."""
    own_month = corrected(spark, sf, OPERATIONAL, month=None)
    return products.station_scores(own_month, v.obs_recent(spark, sf), *v.RANGE)


def grid_and_mask(spark, sf, holes: bool = False) -> tuple[interpolation.Grid, DataFrame]:
    basins = v.basins(spark, sf)
    grid = interpolation.Grid.over(interpolation.ring_box(basins))
    if holes:
        basins = basins.unionByName(v.basins(spark, sf, v.HOLE))
    return grid, interpolation.basin_mask(basins, grid)


def with_id(df: DataFrame) -> DataFrame:
    return df.withColumn("issue_id", dates.issue_id(F.col("issue_ts"))).drop("issue_ts")


# ---- issues and dates --------------------------------------------------------------------


@query
def issue_calendar(spark, sf):
    span = v.table(spark, sf, "lineitem").agg(
        F.to_date(F.min("l_shipdate")).alias("s"), F.to_date(F.max("l_shipdate")).alias("e")
    )
    return dates.explode_issue_calendar(span, F.col("s"), F.col("e"))


@query
def manifest_present(spark, sf):
    return manifest.present(v.expected_issues(spark, sf), v.issues(spark, sf)).select("issue_id")


@query
def manifest_missing(spark, sf):
    return manifest.missing(v.expected_issues(spark, sf), v.issues(spark, sf)).select("issue_id")


@query
def manifest_slice(spark, sf):
    return manifest.manifest_slice(v.expected_issues(spark, sf), 5, 60)


@query
def manifest_urls(spark, sf):
    links = manifest.folder_links(v.table(spark, sf, "pages"), "page_id")
    return manifest.realtime_manifest(links)


@query
def extract_links(spark, sf):
    return manifest.extract_links(v.table(spark, sf, "pages"), "page_id")


@query
def url_basename(spark, sf):
    pages = v.table(spark, sf, "pages")
    return pages.select("page_id", text.basename(F.col("url")).alias("base"))


@query
def issue_ordinal(spark, sf):
    return manifest.issue_ordinal(v.issues(spark, sf))


@query
def issue_gap_report(spark, sf):
    return manifest.gap_report(v.issues(spark, sf))


@query
def parse_issue(spark, sf):
    orders = v.table(spark, sf, "orders")
    day = F.col("o_orderdate")
    return orders.select(
        "o_orderkey",
        dates.parse_issue(F.date_format(day, "yyyyMMddHH")).alias("issue_ts"),
        dates.parse_day(F.date_format(day, "yyyyMMdd")).alias("from_ymd"),
        dates.parse_mdy(F.date_format(day, "M/d/yyyy")).alias("from_mdy"),
    )


@query
def issue_parts(spark, sf):
    ids = v.issues(spark, sf)
    parts = dates.issue_parts(F.col("issue_id"))
    return ids.select("issue_id", *[c.alias(name) for name, c in parts.items()])


@query
def parse_units(spark, sf):
    rows = v.forecast_6h(spark, sf).select("units").distinct()
    return rows.select("units", dates.parse_units(F.col("units")).alias("base_ts"))


@query
def valid_time(spark, sf):
    rows = v.forecast_6h(spark, sf).select("issue_ts", "step").distinct()
    base, step = F.col("issue_ts"), F.col("step")
    return with_id(
        rows.withColumn("valid_ts", dates.valid_ts(base, step, OPERATIONAL.shift_hours))
        .withColumn("valid_date", dates.valid_date(base, step, OPERATIONAL.shift_hours))
    )


@query
def placement_rule(spark, sf):
    return with_id(totals(spark, sf, REFORECAST, placement="issue_hour"))


@query
def day_axis(spark, sf):
    by_data = daily.day_axis(totals(spark, sf, OPERATIONAL))
    by_list = daily.issue_span_axis(v.issues(spark, sf)).select(
        F.lit("issue list").alias("product"), "first_day",
        F.date_add("first_day", F.col("n_days") - 1).alias("last_day"), "n_days",
    )
    return by_data.unionByName(by_list)


@query
def day_spine(spark, sf):
    return daily.day_spine(totals(spark, sf, OPERATIONAL))


@query
def name_norm(spark, sf):
    names = v.stations(spark, sf).select("location", text.dotted(F.col("location")).alias("dots"))
    return names.withColumn("back", text.spaced(F.col("dots")))


# ---- grid to days ------------------------------------------------------------------------


@query(prate=12)
def scan_forecast(spark, sf):
    cell = daily.slice_cell(v.forecast_6h(spark, sf), lat_idx=2, lon_idx=4)
    return with_id(cell.select("issue_ts", "step", "lat", "lon", "prate"))


@query
def bbox_crop(spark, sf):
    return daily.crop(v.located(spark, sf, 0)).select("vec_id", "lon", "lat")


@query
def subgrid(spark, sf):
    inner = daily.subgrid(v.forecast_6h(spark, sf).drop("cell_id"))
    return with_id(inner.select("issue_ts", "step", "cell_id", "lat", "lon"))


@query
def rate_to_mm(spark, sf):
    rows = v.forecast_6h(spark, sf)
    return with_id(rows.select("issue_ts", "cell_id", "step",
                               units.rate_to_mm(F.col("prate")).alias("mm")))


@query
def lon_signed(spark, sf):
    from360 = v.located(spark, sf, 0).select("vec_id", (F.col("lon") + 360.0).alias("lon360"))
    return from360.withColumn("lon", units.signed_longitude(F.col("lon360")))


@query
def daily_sum(spark, sf):
    return with_id(totals(spark, sf, OPERATIONAL))


@query
def brick_long(spark, sf):
    return daily.brick(totals(spark, sf, OPERATIONAL))


@query
def issue_length_stats(spark, sf):
    return daily.issue_length_stats(totals(spark, sf, OPERATIONAL))


@query
def wet_days(spark, sf):
    return with_id(climatology.wet_days(totals(spark, sf, OPERATIONAL), OPERATIONAL.tol))


@query
def climatology_pool(spark, sf):
    return monthly_pool(spark, sf)


@query
def climatology_stats(spark, sf):
    return climatology.stats(monthly_pool(spark, sf), "cell_id", "month")


# ---- consensus ---------------------------------------------------------------------------


@query
def last_n_issues(spark, sf):
    last = vote.last_issues(totals(spark, sf, OPERATIONAL), OPERATIONAL.last_n)
    return with_id(last)


@query
def consensus_reforecast(spark, sf):
    return series(spark, sf, REFORECAST)


@query
def consensus_operational(spark, sf):
    return series(spark, sf, OPERATIONAL)


@query
def consensus_realtime(spark, sf):
    return series(spark, sf, REALTIME)


@query
def realtime_rerun(spark, sf):
    """Two runs into one folder, of the issues before a time and from it on: the second one's."""
    out = session.shared_dir(spark, "rerun")
    writers.forecast(v.stored_forecast(spark, sf, REALTIME.name), f"{out}/forecast")
    before = v.RERUN - dt.timedelta(hours=6)
    products.build_consensus(spark, f"{out}/forecast", REALTIME, out, last_issue=before)
    return products.build_consensus(spark, f"{out}/forecast", REALTIME, out, first_issue=v.RERUN)


@query
def daily_with_nan(spark, sf):
    """Steps without a number make their day missing, for both NaN and NULL."""
    steps = v.with_nan(v.forecast_6h(spark, sf).drop("units"))
    return with_id(daily.daily_totals(steps, OPERATIONAL))


@query
def union_products(spark, sf):
    return vote.union_products(*[series(spark, sf, p) for p in (REFORECAST, OPERATIONAL, REALTIME)])


# ---- observations and stations -----------------------------------------------------------


@query
def obs_range(spark, sf):
    return observations.date_range(v.obs_hist(spark, sf), *v.OBS_RANGE)


@query
def obs_month_wet(spark, sf):
    return observations.month_wet(v.obs_recent(spark, sf))


@query
def clamp_obs(spark, sf):
    return observations.clamped(v.obs_hist(spark, sf), tol=10.0)


@query
def max_obs(spark, sf):
    wet = observations.month_wet(v.obs_hist(spark, sf))
    return observations.maximum(wet, "location", "month")


@query
def obs_pivot(spark, sf):
    wide = observations.pivot(v.obs_priority(spark, sf), v.PRIORITIES)
    return wide.toDF(*[c.replace(".", "_").replace("-", "_") for c in wide.columns])


@query
def obs_unpivot(spark, sf):
    wide = observations.pivot(v.obs_priority(spark, sf), v.PRIORITIES)
    return observations.unpivot(wide, "obs_date")


@query
def station_lookup(spark, sf):
    found = observations.of_station(v.stations(spark, sf), v.STATION)
    return found.select("location", "lat", "lon")


def _places(spark, sf) -> DataFrame:
    return v.located(spark, sf, 0).select(
        F.col("vec_id").cast("string").alias("location"), "lat", "lon"
    )


@query
def nearest_cell(spark, sf):
    return st.nearest_cell(_places(spark, sf), v.many_cells(spark, sf)).select(
        "location", "cell_id", "distance"
    )


@query
def nearest_cell_tree(spark, sf):
    found = st.nearest_cell(_places(spark, sf), v.many_cells(spark, sf), max_array_cells=0)
    return found.select("location", "cell_id", "distance")


@query
def station_forecast(spark, sf):
    near = st.nearest_cell(v.stations(spark, sf), v.cells(spark))
    return st.station_series(near, series(spark, sf, OPERATIONAL))


# ---- fits and correction -----------------------------------------------------------------


@query
def gamma_fit(spark, sf):
    wet = observations.month_wet(v.obs_hist(spark, sf))
    return fitting.gamma_fit(wet, "location", "month")


@query
def gamma_fit_bounded(spark, sf):
    wet = observations.month_wet(v.obs_hist(spark, sf))
    return fitting.gamma_fit(wet, "location", "month", lower=3.3)


@query
def gamma_fit_merged(spark, sf):
    """Bounded fits from stored sums of years that come in two runs, one year twice."""
    path = session.shared_dir(spark, "sums")
    wet = observations.month_wet(v.obs_hist(spark, sf))
    year = F.year("obs_date")
    for rows in (wet.filter(year % 2 == 0), wet.filter(year % 2 == 1), wet.filter(year == 1995)):
        fitting.store_sums(rows, F.year("obs_date"), path, "location", "month")
    return fitting.refit(spark, path, "location", "month", lower=3.3)


@query
def model_fit_merged(spark, sf):
    """The model's bounded fits from sums by day of issue, compacted before the last of them come."""
    out = session.shared_dir(spark, "pool")
    pool = climatology.wet_days(totals(spark, sf, REFORECAST), REFORECAST.tol).filter(
        F.month("issue_ts") == F.month("valid_date")
    ).withColumn("month", F.month("valid_date"))
    day, last = F.to_date("issue_ts"), F.dayofmonth("issue_ts") > 20
    fitting.store_sums(pool.filter(~last), day, f"{out}/days", "cell_id", "month")
    fitting.compact_sums(spark, f"{out}/days", f"{out}/all", "start", "cell_id", "month")
    fitting.store_sums(pool.filter(last), day, f"{out}/all", "cell_id", "month")
    return fitting.refit(spark, f"{out}/all", "cell_id", "month", lower=0.5)


@query
def params_table(spark, sf):
    near = st.nearest_cell(v.stations(spark, sf), v.cells(spark))
    params, _ = products.station_report(
        monthly_pool(spark, sf), v.obs_hist(spark, sf), near, BOUNDS_REALTIME
    )
    return params


@query
def cdf_curve(spark, sf):
    near = st.nearest_cell(v.stations(spark, sf), v.cells(spark))
    _, curve = products.station_report(
        monthly_pool(spark, sf), v.obs_hist(spark, sf), near, BOUNDS_REALTIME
    )
    return curve


@query
def gamma_cdf(spark, sf):
    wet = observations.month_wet(v.obs_hist(spark, sf))
    rows = wet.join(fitting.gamma_fit(wet, "location", "month"), ["location", "month"])
    f = gamma.gamma_cdf(F.col("mm"), F.col("shape"), F.col("scale"))
    return rows.select("location", "obs_date", "mm", f.alias("f"))


@query(mm=4)
def gamma_quantile(spark, sf):
    wet = observations.month_wet(v.obs_hist(spark, sf))
    params = fitting.gamma_fit(wet, "location", "month")
    rows = params.withColumn("p", F.explode(F.array(*[F.lit(p) for p in (0.1, 0.5, 0.9)])))
    mm = gamma.gamma_quantile(F.col("p"), F.col("shape"), F.col("scale"))
    return rows.select("location", "month", "p", mm.alias("mm"))


@query(mm=4)
def gamma_sample(spark, sf):
    wet = observations.month_wet(v.obs_recent(spark, sf))
    return fitting.gamma_sample(fitting.gamma_fit(wet, "month"), "month")


@query(mm_corrected=4)
def quantile_map(spark, sf):
    return corrected(spark, sf, REALTIME)


@query(mm_corrected=4)
def quantile_map_free(spark, sf):
    """The dashboard's correction: fits without bounds."""
    return corrected(spark, sf, REALTIME, bounds=BOUNDS_DASHBOARD_REALTIME)


@query
def valid_days(spark, sf):
    near = st.nearest_cell(v.stations(spark, sf), v.cells(spark))
    return st.valid_days(st.station_series(near, series(spark, sf, REALTIME)))


def export_days() -> list:
    first = v.AS_OF.replace(day=1)
    return [first.replace(day=1 + i) for i in range(REALTIME.horizon_days)]


@query(**{f"2024-01-{d:02d}": 4 for d in range(1, 16)})
def forecast_export(spark, sf):
    return st.forecast_export(
        corrected(spark, sf, REALTIME), v.stations(spark, sf), export_days()
    )


# ---- verification ------------------------------------------------------------------------


@query
def compare_outer(spark, sf):
    near = st.nearest_cell(v.stations(spark, sf), v.cells(spark))
    forecast = st.station_series(near, series(spark, sf, REALTIME))
    return verification.compare_outer(
        forecast, v.obs_recent(spark, sf), "location", "valid_date"
    )


@query(operational=4)
def verify_pairs(spark, sf):
    forecast = corrected(spark, sf, OPERATIONAL, month=None).select(
        "location", "valid_date", F.col("mm_corrected").alias("mm")
    )
    obs = observations.date_range(v.obs_recent(spark, sf), *v.RANGE)
    return verification.pairs(forecast, obs)


@query
def contingency(spark, sf):
    return scores(spark, sf)[0]


@query
def skill_scores(spark, sf):
    return scores(spark, sf)[1]


@query(me=4, rmse=4, mae=4, mpe=2, mape=2)
def continuous_scores(spark, sf):
    return scores(spark, sf)[2]


@query(mm=4)
def sample_ecdf(spark, sf):
    """Observed days and as many draws of their fits, as one labelled table."""
    wet = observations.month_wet(v.obs_recent(spark, sf))
    draws = fitting.gamma_sample(fitting.gamma_fit(wet, "month"), "month")
    return verification.labelled_ecdf({"observed": wet, "drawn": draws}, "month")


@query
def ecdf(spark, sf):
    return verification.ecdf(v.obs_hist(spark, sf), "location")


@query
def ecdf_sketch(spark, sf):
    """Deciles from stored sketches of years, beside the exact ranks of the values they give."""
    path = session.shared_dir(spark, "sketches")
    obs = v.obs_hist(spark, sf)
    year = F.year("obs_date")
    for rows in (obs.filter(year < 1996), obs.filter(year >= 1996), obs.filter(year == 1994)):
        writers.stage(verification.batch_sketches(rows, year, "location"), path, "batch")
    sketches = verification.merged_sketches(readers.stage(spark, path), "location")
    deciles = verification.sketch_quantiles(
        sketches, "location", shares=tuple(i / 10 for i in range(1, 10))
    )
    given, mm = F.col("given"), F.col("mm")
    exact = obs.join(deciles.withColumnRenamed("mm", "given"), "location").groupBy(
        "location", "share", "n"
    ).agg(F.avg((mm < given).cast("double")).alias("below"), F.avg((mm <= given).cast("double")).alias("upto"))
    off = F.greatest(F.col("below") - F.col("share"), F.col("share") - F.col("upto"))
    return exact.select(
        "location", "share", "n", (off <= 3 * verification.sketch_error()).alias("within")
    )


# ---- grid --------------------------------------------------------------------------------


@query
def regular_grid(spark, sf):
    grid = interpolation.Grid.over(interpolation.ring_box(v.basins(spark, sf)))
    return interpolation.regular_grid(spark, grid).select("ix", "iy", "x", "y")


@query
def basin_mask(spark, sf):
    return grid_and_mask(spark, sf)[1].select("ix", "iy")


@query
def basin_holes(spark, sf):
    return grid_and_mask(spark, sf, holes=True)[1].select("ix", "iy")


def outlines(spark, sf) -> DataFrame:
    """Basins with a hole each."""
    return v.basins(spark, sf).unionByName(v.basins(spark, sf, v.HOLE))


@query
def points_in_basins(spark, sf):
    """Every place with each basin it is in; holes are outside."""
    places = v.located(spark, sf, 0).select("vec_id", "lon", "lat")
    return polygons.points_in(places, outlines(spark, sf)).select("vec_id", "basin")


@query
def grid_in_basins(spark, sf):
    """The grid's points through the join for free points: the same points as in ``basin_holes``."""
    grid = interpolation.Grid.over(interpolation.ring_box(v.basins(spark, sf)))
    points = interpolation.regular_grid(spark, grid)
    return polygons.masked(points, outlines(spark, sf), "ix", "iy", x="x", y="y").select("ix", "iy")


@query
def stations_by_basin(spark, sf):
    """Stations and their observations in each basin, from outlines stored as GeoJSON."""
    path = session.shared_dir(spark, "basins")
    writers.geojson_basins(outlines(spark, sf), path)
    basins = readers.geojson_basins(spark, path, lines=True)
    inside = polygons.points_in(v.stations(spark, sf), basins)
    wet = observations.month_wet(v.obs_hist(spark, sf))
    return inside.join(wet, "location").groupBy("basin").agg(
        F.countDistinct("location").alias("n_stations"), F.count("*").alias("n_wet"),
        F.sum("mm").alias("mm"),
    )


@query
def idw_grid(spark, sf):
    grid, points = grid_and_mask(spark, sf)
    stations = v.stations(spark, sf)
    located = v.obs_recent(spark, sf).join(stations, "location").select(
        "location", "lon", "lat", F.col("obs_date").alias("valid_date"), "mm"
    )
    return interpolation.idw(located, points, grid)


@query
def value_bins(spark, sf):
    obs = v.obs_recent(spark, sf)
    return obs.withColumn("class", units.value_class(F.col("mm")))


# ---- files: written, then read ---------------------------------------------------------------


@query
def issue_list_file(spark, sf):
    path = session.shared_dir(spark, "issues")
    writers.issue_list(v.issues(spark, sf), path)
    return with_id(readers.issue_list(spark, path, OPERATIONAL.name).drop("issue_id"))


@query
def forecast_axes(spark, sf):
    path = session.shared_dir(spark, "forecast")
    writers.forecast(v.stored_forecast(spark, sf, OPERATIONAL.name), path)
    return with_id(readers.axes(readers.forecast(spark, path)))


@query(prate=12)
def forecast_variable(spark, sf):
    """A table of two variables, read for one."""
    path = session.shared_dir(spark, "forecast")
    steps = v.stored_forecast(spark, sf, OPERATIONAL.name)
    other = steps.withColumns({"variable": F.lit("pmax"), "prate": F.col("prate") + 1.0})
    writers.forecast(steps.unionByName(other), path)
    found = readers.forecast(spark, path, OPERATIONAL.name)
    return with_id(found.select("issue_ts", "lat_idx", "lon_idx", "step", "prate"))


@query
def wide_csv(spark, sf):
    path = session.shared_dir(spark, "wide")
    wide = observations.pivot(v.obs_priority(spark, sf), v.PRIORITIES)
    day = F.date_format("obs_date", "M/d/yyyy").alias("DateTime")
    wide.select(day, *[f"`{c}`" for c in wide.columns if c != "obs_date"]).write.csv(path, header=True)
    long = readers.observations_long(spark, path, v.PRIORITIES)
    return long.select("location", "obs_date", "mm")


@query
def station_csv(spark, sf):
    path = session.shared_dir(spark, "stations")
    v.stations(spark, sf).write.csv(path, header=True)
    return readers.stations(spark, path)


@query
def cell_csv(spark, sf):
    path = session.shared_dir(spark, "cells")
    v.many_cells(spark, sf).withColumnRenamed("cell_id", "id").write.csv(path, header=True)
    return readers.cells(spark, path).select("cell_id", "lat", "lon")


@query
def single_station_csv(spark, sf):
    path = session.shared_dir(spark, "station")
    one = observations.of_station(v.obs_hist(spark, sf), v.STATION)
    day = F.date_format("obs_date", "M/d/yyyy").alias("DateTime")
    one.select(day, "mm").write.csv(path, header=True)
    return readers.single_station(spark, path, v.STATION)


@query
def stage_replaced(spark, sf):
    """Two writes of the same days: the second replaces the first."""
    path = session.shared_dir(spark, "daily")
    rows = totals(spark, sf, OPERATIONAL)
    writers.daily(rows.withColumn("mm", F.col("mm") + 1.0), path)
    writers.daily(rows, path)
    return with_id(readers.daily_totals(spark, path).drop("issue_month"))


@query
def stage_added(spark, sf):
    """Daily totals written in two runs, the issues of odd and of even days: both stay."""
    path = session.shared_dir(spark, "daily")
    rows = totals(spark, sf, OPERATIONAL)
    for odd in (1, 0):
        writers.daily(rows.filter(F.dayofmonth("issue_ts") % 2 == odd), path)
    return with_id(readers.daily_totals(spark, path).drop("issue_month"))


@query(prate=12)
def forecast_added(spark, sf):
    """Forecasts written issue hour by issue hour, the last one twice."""
    path = session.shared_dir(spark, "forecast")
    steps = v.stored_forecast(spark, sf, OPERATIONAL.name)
    for hour in (0, 6, 12, 18, 18):
        writers.forecast(steps.filter(F.hour("issue_ts") == hour), path)
    found = readers.forecast(spark, path, OPERATIONAL.name)
    return with_id(found.select("issue_ts", "lat_idx", "lon_idx", "step", "prate"))


@query
def listed_issues(spark, sf):
    """Issues by the names of the files that hold them, a file an issue."""
    out = session.shared_dir(spark, "listing")
    steps = v.stored_forecast(spark, sf, OPERATIONAL.name)
    writers.forecast(steps, f"{out}/forecast")
    return readers.issue_folders(spark, f"{out}/forecast")


@query
def polygon_rings(spark, sf):
    """Rings written as GeoJSON and as rows, read from both."""
    out = session.shared_dir(spark, "rings")
    writers.geojson_basins(outlines(spark, sf), f"{out}/geojson")
    outlines(spark, sf).write.json(f"{out}/rows")
    both = readers.geojson_basins(spark, f"{out}/geojson", lines=True).withColumn(
        "source", F.lit("geojson")
    ).unionByName(readers.basins(spark, f"{out}/rows").withColumn("source", F.lit("rows")))
    corner = both.select("source", "name", F.posexplode("ring").alias("i", "p"))
    return corner.groupBy("source", "name", "i").agg(
        F.count("*").alias("n"), F.min("p.x").alias("west"), F.max("p.y").alias("north")
    )

@query
def daily_grid_files(spark, sf):
    """A grid a day, with the days taken from the folders."""
    path = session.shared_dir(spark, "grids")
    grid = v.obs_recent(spark, sf).join(v.stations(spark, sf), "location").select(
        F.col("obs_date").alias("valid_date"), F.col("lon").alias("x"), F.col("lat").alias("y"), "mm"
    )
    writers.daily_grids(grid, path)
    days = readers.grid_days(spark, path)
    stored = readers.stage(spark, path, schemas.IDW_GRID)
    return stored.join(days, "valid_date").select("valid_date", "x", "y", "mm")


# ---- streams -----------------------------------------------------------------------------


def _run_stream(spark, sf, with_consensus: bool) -> str:
    events = v.table(spark, sf, "events")
    stream = ingest.forecast_stream(spark, sf, events.schema, pathGlobFilter="events.parquet")
    out = session.shared_dir(spark, "stream")
    run = ingest.start_daily(
        v.from_events(stream).drop("units"), OPERATIONAL, f"{out}/daily", f"{out}/checkpoint",
        f"{out}/consensus" if with_consensus else None,
    )
    run.awaitTermination()
    return out


@query
def stream_daily(spark, sf):
    return with_id(ingest.read_daily(spark, _run_stream(spark, sf, False) + "/daily"))


@query
def stream_within(spark, sf):
    """The watermarked totals over a table, where no issue is late."""
    return with_id(ingest.daily_within(v.forecast_6h(spark, sf).drop("units"), OPERATIONAL))


@query
def stream_consensus(spark, sf):
    out = _run_stream(spark, sf, True)
    return ingest.read_consensus(spark, f"{out}/consensus", OPERATIONAL, *v.RANGE)


@query
def stream_votes(spark, sf):
    """The votes of keyed state, over the stream of events."""
    events = v.table(spark, sf, "events")
    stream = ingest.forecast_stream(spark, sf, events.schema, pathGlobFilter="events.parquet")
    out = session.shared_dir(spark, "votes")
    steps = v.from_events(stream).drop("units")
    stateful.start_votes(steps, OPERATIONAL, f"{out}/votes", f"{out}/checkpoint").awaitTermination()
    return stateful.read_votes(spark, f"{out}/votes")


def _alarm_columns(alarms: DataFrame) -> DataFrame:
    late = F.unix_seconds(F.col("arrived").cast("timestamp")) - F.unix_seconds(F.col("due").cast("timestamp"))
    return alarms.select(
        "issue_id", "status", F.col("due").cast("timestamp_ntz").alias("due"), late.alias("late_seconds")
    )


@query
def stream_alarms(spark, sf):
    """Issues that no event, or only a late one, belongs to, raised by timers while events come."""
    events = v.table(spark, sf, "events")
    out = session.shared_dir(spark, "alarms")
    writers.stage(v.expected_issues(spark, sf), f"{out}/expected")
    planned = spark.readStream.schema("issue_id string, issue_ts timestamp_ntz").parquet(f"{out}/expected")
    stream = ingest.forecast_stream(spark, sf, events.schema, pathGlobFilter="events.parquet")
    run = stateful.start_alarms(
        planned, v.arrivals(stream), v.LATENCY, f"{out}/alarms", f"{out}/checkpoint"
    )
    run.awaitTermination()
    return _alarm_columns(stateful.read_alarms(spark, f"{out}/alarms"))


@query
def overdue_issues(spark, sf):
    """The same alarms from the stored tables."""
    events = v.table(spark, sf, "events")
    now = events.agg(F.max("ts")).scalar()
    came = v.arrivals(events).withColumn("arrived", F.col("arrived").cast("timestamp_ntz"))
    return _alarm_columns(manifest.overdue(v.expected_issues(spark, sf), came, v.LATENCY, now))
