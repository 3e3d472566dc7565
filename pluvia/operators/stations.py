"""Stations and the grid cells that serve them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pluvia.functions.spatial import squared_degrees
from pluvia.session import shared_dir

CELLS_AS_ARRAY = 4096  # up to this many cells travel as one array
LEAF_BITS = 6  # a leaf of the tree has 2^6 cells
CHILD_BITS = 4  # and a node 2^4 children


def nearest_cell(
    stations: DataFrame, cells: DataFrame, max_array_cells: int = CELLS_AS_ARRAY
) -> DataFrame:
    """``cell_id`` of the nearest cell and its ``distance`` in planar degrees.

    The lowest id wins a tie. Stations and cells without coordinates are left out.

    A counted, small set of cells is searched as one array by batches of stations. A larger
    set is searched through a tree of boxes. Both are exact and neither pairs rows.
    """
    stations, cells = (df.dropna(subset=["lon", "lat"]) for df in (stations, cells))
    few = cells.select("cell_id", "lon", "lat").take(max_array_cells + 1)
    if len(few) <= max_array_cells:
        kind = cells.schema["cell_id"].dataType.simpleString()
        return _nearest_in_array(stations, sorted(few), kind)
    return _nearest_in_tree(stations, cells)


def _nearest_in_array(stations: DataFrame, rows: list, kind: str) -> DataFrame:
    """Batches of stations against all of the few cells, which travel with the function."""
    ids, lon, lat = (np.array(c) for c in zip(*rows)) if rows else (np.empty(0),) * 3

    @F.pandas_udf(f"cell_id {kind}, distance double")
    def search(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        found = np.empty(len(x), dtype=ids.dtype)
        distance = np.empty(len(x))
        for i in range(0, len(x), 512):
            dx = x.to_numpy()[i : i + 512, None] - lon
            dy = y.to_numpy()[i : i + 512, None] - lat
            d2 = dx * dx + dy * dy
            best = d2.argmin(axis=1)  # the first of equals has the lowest id
            found[i : i + 512] = ids[best]
            distance[i : i + 512] = np.sqrt(d2[np.arange(len(best)), best])
        return pd.DataFrame({"cell_id": found, "distance": distance})

    if not rows:
        return stations.limit(0).select("*", F.lit(None).cast(kind).alias("cell_id"),
                                        F.lit(None).cast("double").alias("distance"))
    search = search.asNondeterministic()  # else a filter on its result runs it again
    found = stations.withColumn("best", search("lon", "lat"))
    return found.select(stations["*"], "best.cell_id", "best.distance")


def _interleaved(x: Column, y: Column) -> Column:
    """One number from the bits of two 31-bit numbers in turn, so that near places sort near."""

    def spread(v: Column) -> Column:
        for shift, mask in (
            (16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F),
            (2, 0x3333333333333333), (1, 0x5555555555555555),
        ):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(x), 1).bitwiseOR(spread(y))


def _axis_step(value: str, low: float, high: float) -> Column:
    """Position between two ends as a 31-bit number."""
    if high == low:
        return F.lit(0).cast("bigint")
    return F.floor((F.col(value) - low) / (high - low) * float(2**31 - 1))


def _packed(cells: DataFrame) -> tuple[DataFrame, int]:
    """Cells with a ``node`` number along a space-filling order, and the largest number.

    Numbers follow the sorted rows and not the map, so 64 numbers in a row are 64 cells
    however dense a spot is. Cells at one place count once. The table is written, as a second
    evaluation could number the rows differently.
    """
    spark = cells.sparkSession
    low_x, high_x, low_y, high_y = cells.agg(
        F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")
    ).first()
    code = _interleaved(_axis_step("lon", low_x, high_x), _axis_step("lat", low_y, high_y))
    places = cells.groupBy("lon", "lat").agg(F.min("cell_id").alias("cell_id"))
    numbered = (
        places.withColumn("code", code)
        .repartitionByRange("code")
        .sortWithinPartitions("code")
        .withColumn("id", F.monotonically_increasing_id())
        .drop("code")
    )
    path = shared_dir(spark, "cells")
    numbered.write.parquet(path)
    numbered = spark.read.parquet(path)
    # an id is (partition, row in partition) with 33 bits for the row: close the gap between
    row, part = F.col("id").bitwiseAND(F.lit(2**33 - 1)), F.shiftright("id", 33)
    last_row, last_part = numbered.agg(F.max(row), F.max(part)).first()
    bits = last_row.bit_length()
    node = F.shiftleft(part, bits) + row
    return numbered.withColumn("node", node).drop("id"), (last_part << bits) + last_row


def _least_distance() -> Column:
    """Squared distance from a place to a box, 0 inside."""
    x = F.greatest(F.col("w") - F.col("lon"), F.col("lon") - F.col("e"), F.lit(0.0))
    y = F.greatest(F.col("s") - F.col("lat"), F.col("lat") - F.col("n"), F.lit(0.0))
    return x * x + y * y


def _sure_distance() -> Column:
    """Squared distance within which a tight box surely has a cell: each side touches one."""

    def sides(value: str, low: str, high: str) -> tuple[Column, Column]:
        ends = F.abs(F.col(value) - F.col(low)), F.abs(F.col(value) - F.col(high))
        return F.least(*ends), F.greatest(*ends)

    (near_x, far_x), (near_y, far_y) = sides("lon", "w", "e"), sides("lat", "s", "n")
    return F.least(near_x * near_x + far_y * far_y, far_x * far_x + near_y * near_y)


def _nearest_in_tree(stations: DataFrame, cells: DataFrame) -> DataFrame:
    """Descend a packed tree of boxes, keeping per place those that can hold its nearest cell.

    A leaf has at most 64 cells and a node at most 16 children, each stored as one array, so
    a place meets a node in one row. A box farther than the distance that is sure at some
    other box is dropped. Stations at one place are searched once.
    """
    packed, last = _packed(cells)
    boxes = packed.select(
        "node", F.col("lon").alias("w"), F.col("lon").alias("e"),
        F.col("lat").alias("s"), F.col("lat").alias("n"),
    )
    bounds = [F.min("w").alias("w"), F.max("e").alias("e"), F.min("s").alias("s"),
              F.max("n").alias("n")]
    children = F.collect_list(F.struct("node", "w", "e", "s", "n")).alias("boxes")
    families, shift = [], LEAF_BITS
    boxes = boxes.groupBy(F.shiftright("node", LEAF_BITS).alias("node")).agg(*bounds)
    while last >> shift >= 1 << CHILD_BITS:
        up = F.shiftright("node", CHILD_BITS)
        families.insert(0, boxes.groupBy(up.alias("parent")).agg(children))
        boxes = boxes.groupBy(up.alias("node")).agg(*bounds)
        shift += CHILD_BITS

    slack = 1.0 + 1e-12  # rounding must not drop a box that ties
    place = ["lon", "lat"]
    met = stations.select(*place).distinct().withColumn("boxes", boxes.agg(children).scalar())
    for family in [None, *families]:
        if family is not None:
            met = met.join(family, "parent")
        met = (
            met.select(*place, F.explode("boxes").alias("box"))
            .select(*place, "box.*")
            .withColumn("sure", F.min(_sure_distance()).over(Window.partitionBy(*place)))
            .filter(_least_distance() <= F.col("sure") * slack)
            .select(*place, F.col("node").alias("parent"))
        )
    leaves = packed.groupBy(F.shiftright("node", LEAF_BITS).alias("parent")).agg(
        F.collect_list(F.struct("cell_id", "lon", "lat")).alias("cells")
    )

    def candidate(cell: Column) -> Column:
        d2 = squared_degrees(F.col("lon"), F.col("lat"), cell["lon"], cell["lat"])
        return F.struct(d2.alias("d2"), cell["cell_id"].alias("cell_id"))

    best = F.array_min(F.transform("cells", candidate))
    found = (
        met.join(leaves, "parent")
        .select(*place, best.alias("best"))
        .groupBy(*place)
        .agg(F.min("best").alias("best"))
        .select(*place, "best.cell_id", F.sqrt("best.d2").alias("distance"))
    )
    return stations.join(found, place).select(stations["*"], "cell_id", "distance")


def station_series(stations: DataFrame, consensus: DataFrame) -> DataFrame:
    """The consensus series of each station's cell; ``stations`` carries ``cell_id``.

    Few cells may serve very many stations, so a cell's series is copied for as many salts as it
    takes to keep all tasks busy, and its stations are spread over them. A station whose cell has no
    series stays, with a NULL day.
    """
    tasks = int(stations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = stations.select("location", "cell_id")
    cells = near.agg(F.countDistinct("cell_id").alias("n"))
    salts = cells.select(F.ceil(F.lit(tasks) / F.greatest("n", F.lit(1))).cast("int")).scalar()
    spread = near.withColumn("salt", F.pmod(F.hash("location"), salts))
    copies = consensus.select("cell_id", "valid_date", "mm").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1))
    )
    return spread.join(copies, ["cell_id", "salt"], "left").drop("salt").select(
        "cell_id", "location", "valid_date", "mm"
    )


def forecast_export(corrected: DataFrame, stations: DataFrame, days: list) -> DataFrame:
    """One row per station, one column per named day, then lat, lon and alt."""
    columns = [str(d) for d in days]
    by_day = corrected.withColumn("day", F.col("valid_date").cast("string"))
    wide = by_day.groupBy("location").pivot("day", columns).agg(F.first("mm_corrected"))
    return wide.join(stations.select("location", "lat", "lon", "alt"), "location")


def valid_days(corrected: DataFrame) -> DataFrame:
    """The forecast's days in order."""
    return corrected.select("valid_date").distinct().orderBy("valid_date")
