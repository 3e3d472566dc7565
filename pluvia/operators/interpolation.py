"""Station forecasts on a grid: regular points, basin mask, inverse-distance weighting."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvia.config import IDW_POINTS, IDW_POWER
from pluvia.functions import units
from pluvia.functions.spatial import np_distance, ring_edges

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_SIDE = 32  # grid points along one side of a tile
STATIONS_PER_BLOCK = 1024
DAYS_PER_BLOCK = 32
TILES_PER_GROUP = 4  # tiles of one task, at most 4,096 points


@dataclass(frozen=True)
class Grid:
    """Points at the centres of square cells that fill a box from its south-west corner."""

    west: float
    south: float
    step: float
    nx: int
    ny: int

    @classmethod
    def over(cls, box: tuple[float, float, float, float], n: int = IDW_POINTS) -> Grid:
        """About ``n`` points in a box given as (west, east, south, north)."""
        west, east, south, north = box
        step = math.sqrt((east - west) * (north - south) / n)
        return cls(
            west, south, step, int((east - west) / step + 1e-9), int((north - south) / step + 1e-9)
        )

    @property
    def tiles_across(self) -> int:
        return -(-self.nx // TILE_SIDE)

    @property
    def tiles(self) -> int:
        return self.tiles_across * -(-self.ny // TILE_SIDE)


def ring_box(basins: DataFrame) -> tuple[float, float, float, float]:
    """West, east, south and north end of all rings (one aggregated row)."""
    points = basins.select(F.explode("ring").alias("p")).select("p.x", "p.y")
    return tuple(points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first())


def _middle(grid: Grid) -> dict[str, Column]:
    """Place of a point from its column and row."""
    return {
        "x": F.lit(grid.west) + (F.col("ix") + 0.5) * grid.step,
        "y": F.lit(grid.south) + (F.col("iy") + 0.5) * grid.step,
    }


def _placed(points: DataFrame, grid: Grid) -> DataFrame:
    tile = F.floor(F.col("iy") / TILE_SIDE) * grid.tiles_across + F.floor(F.col("ix") / TILE_SIDE)
    return points.select(
        "ix", "iy", tile.alias("tile"), *[c.alias(n) for n, c in _middle(grid).items()]
    )


def regular_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """The grid's points with their column, row and tile."""
    ix, iy = F.col("id") % grid.nx, F.floor(F.col("id") / grid.nx)
    points = spark.range(grid.nx * grid.ny).select(ix.alias("ix"), iy.alias("iy"))
    return _placed(points, grid)


def _row_at(y: Column, grid: Grid) -> Column:
    return F.floor((y - grid.south) / grid.step - 0.5)


def inside_points(basins: DataFrame, grid: Grid) -> DataFrame:
    """Column and row of every grid point inside at least one basin."""
    return inside_cells(basins, grid).select("ix", "iy").distinct()


def inside_cells(basins: DataFrame, grid: Grid) -> DataFrame:
    """Column and row of every grid point inside a basin, for each basin.

    Each outline edge goes to the grid rows it spans and gives the place it crosses there.
    Between an odd crossing of a row and the next one the row is inside. The work follows
    the outlines and the points inside, not the points times the edges.

    The rings of one name are one outline: a ring inside another is a hole, one beside it a part.
    """
    edge = basins.select(
        F.coalesce("name", F.lit("")).alias("basin"), ring_edges(F.col("ring")).alias("edges")
    ).select("basin", F.explode("edges").alias("edge")).select("basin", "edge.*")
    last_row, last_column = F.lit(grid.ny - 1), F.lit(grid.nx - 1)
    first = F.greatest(_row_at(F.least("y1", "y2"), grid), F.lit(0))
    last = F.least(_row_at(F.greatest("y1", "y2"), grid) + 1, last_row)
    y = F.lit(grid.south) + (F.col("iy") + 0.5) * grid.step
    crossing = (F.col("x2") - F.col("x1")) * (y - F.col("y1")) / (
        F.col("y2") - F.col("y1")
    ) + F.col("x1")
    crossings = (
        edge.withColumns({"first": first, "last": last})
        .filter("first <= last")
        .withColumn("iy", F.explode(F.sequence("first", "last")))
        .filter((F.col("y1") > y) != (F.col("y2") > y))
        .select("basin", "iy", crossing.alias("from"))
    )
    along = Window.partitionBy("basin", "iy").orderBy("from")
    spans = (
        crossings.withColumn("to", F.lead("from").over(along))
        .withColumn("rank", F.row_number().over(along))
        .filter(F.col("rank") % 2 == 1)
    )

    def column_at(x: Column) -> Column:
        return F.floor((x - grid.west) / grid.step - 0.5)

    x = F.lit(grid.west) + (F.col("ix") + 0.5) * grid.step
    start = F.greatest(column_at(F.col("from")), F.lit(0))
    stop = F.least(column_at(F.col("to")) + 1, last_column)
    return (
        spans.withColumns({"start": start, "stop": stop})
        .filter("start <= stop")
        .withColumn("ix", F.explode(F.sequence("start", "stop")))
        .filter((x >= F.col("from")) & (x < F.col("to")))
        .select("basin", "ix", "iy")
    )


def basin_mask(basins: DataFrame, grid: Grid) -> DataFrame:
    """The grid points inside at least one basin, as ``regular_grid`` has them."""
    return _placed(inside_points(basins, grid), grid)


def _grid_sums(grid: Grid, power: float, metric: str):
    """Weighted means of the points of one group of tiles over all its stations, a block of days at a
    time. The points of a key come before its station blocks, which are added up as they pass."""

    def result(key, ix, iy, sums):
        first = key[1] * DAYS_PER_BLOCK
        num, den, hit_mm, hit_n = sums
        with np.errstate(divide="ignore", invalid="ignore"):
            mm = np.where(hit_n > 0, hit_mm / hit_n, num / den)
        point, day = np.nonzero(den + hit_n > 0)
        return pa.RecordBatch.from_arrays(
            [
                pa.array((first + day).astype(np.int32)), pa.array(ix[point]),
                pa.array(iy[point]), pa.array(mm[point, day]),
            ],
            ["day", "ix", "iy", "mm"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ix = iy = sums = None
        for batch in batches:
            heads = batch.select(["group", "day_block"]).to_pydict()
            for i, row in enumerate(zip(heads["group"], heads["day_block"])):
                if row != key:
                    if sums is not None:
                        yield result(key, ix, iy, sums)
                    key, ix, iy, sums = row, np.empty(0, np.int64), np.empty(0, np.int64), None
                if batch["points"][i].is_valid:
                    found = batch["points"][i].values
                    ix = np.concatenate([ix, found.field("ix").to_numpy()])
                    iy = np.concatenate([iy, found.field("iy").to_numpy()])
                    continue
                if not len(ix):
                    continue
                if sums is None:
                    sums = np.zeros((4, len(ix), DAYS_PER_BLOCK))
                block = batch["stations"][i].values
                px = grid.west + (ix + 0.5) * grid.step
                py = grid.south + (iy + 0.5) * grid.step
                place = np.stack([block.field(c).to_numpy() for c in ("lon", "lat")])
                day = block.field("day").to_numpy() - key[1] * DAYS_PER_BLOCK
                place, station = np.unique(place, axis=1, return_inverse=True)
                total = np.zeros((place.shape[1], DAYS_PER_BLOCK))
                count = np.zeros_like(total)
                total[station.ravel(), day] = block.field("mm").to_numpy()
                count[station.ravel(), day] = block.field("n").to_numpy()
                d = np_distance(px[:, None], py[:, None], place[0], place[1], metric)
                hit = (d == 0).astype(float)
                weight = np.where(d == 0, 0.0, 1.0 / np.where(d == 0, 1.0, d) ** power)
                sums += np.stack([weight @ total, weight @ count, hit @ total, hit @ count])
        if sums is not None:
            yield result(key, ix, iy, sums)

    return run


def idw(
    station_days: DataFrame,
    points: DataFrame,
    grid: Grid,
    power: float = IDW_POWER,
    metric: str = "ellipsoid",
    stations_per_block: int = STATIONS_PER_BLOCK,
    tiles_per_group: int = TILES_PER_GROUP,
) -> DataFrame:
    """Inverse-distance weighted mean of all stations with a value, per day and point.

    ``station_days`` has ``location, lon, lat, valid_date, mm``; missing and infinite values are left
    out. A task has the points of one group of tiles and 32 days, and adds up all stations, which
    pass it in blocks of about ``stations_per_block`` places: a block is sent once for each group
    and nothing is shuffled after. A point on a station takes that station's value.
    """
    known = station_days.filter(F.abs(units.known(F.col("mm"))) < float("inf"))
    # one row per place and day, which bounds a block's array
    place_days = known.groupBy("lon", "lat", F.unix_date("valid_date").alias("day")).agg(
        F.sum("mm").alias("mm"), F.count("mm").cast("double").alias("n")
    )
    places = place_days.agg(F.countDistinct("lon", "lat").alias("n"))
    blocks = places.select(F.greatest(F.ceil(F.col("n") / stations_per_block), F.lit(1))).scalar()
    day_block = F.floor(F.col("day") / DAYS_PER_BLOCK)
    stations = place_days.groupBy(
        day_block.alias("day_block"),
        F.pmod(F.xxhash64("lon", "lat"), blocks).alias("station_block"),
    ).agg(F.collect_list(F.struct("lon", "lat", "day", "mm", "n")).alias("stations"))
    group = F.floor(F.col("tile") / tiles_per_group)
    tiles = points.groupBy("tile").agg(F.collect_list(F.struct("ix", "iy")).alias("points"))
    tiles = tiles.withColumn("group", group)
    groups = F.array_sort(F.collect_set("group"))
    each_group = F.explode(tiles.agg(groups).scalar())
    each_day = F.explode(place_days.agg(F.array_sort(F.collect_set(day_block))).scalar())
    kinds = "array<struct<ix:bigint,iy:bigint>>", (
        "array<struct<lon:double,lat:double,day:int,mm:double,n:double>>"
    )
    work = stations.select(
        each_group.alias("group"), "day_block", F.lit(1).alias("turn"),
        F.lit(None).cast(kinds[0]).alias("points"), F.col("stations").cast(kinds[1]),
    ).unionByName(
        tiles.select(
            "group", each_day.alias("day_block"), F.lit(0).alias("turn"),
            F.col("points").cast(kinds[0]), F.lit(None).cast(kinds[1]).alias("stations"),
        )
    )
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = work.repartition(tasks, "group", "day_block").sortWithinPartitions(
        "group", "day_block", "turn"
    )
    sums = ordered.mapInArrow(
        _grid_sums(grid, power, metric), "day int, ix bigint, iy bigint, mm double"
    )
    return sums.select(
        F.date_from_unix_date("day").alias("valid_date"),
        *[c.alias(n) for n, c in _middle(grid).items()], "mm",
    )
