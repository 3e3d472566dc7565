"""Points of any table in polygons.

A polygon is covered by square cells: those its outline touches are border cells, those wholly inside
are inner cells. A point finds its cell's rows by an equi-join on the cell; in an inner cell that settles
it, in a border cell the point is tested against the edges that cross the cell's row. The work thus
follows the points and the outlines, not their product.

The rings of one name are one outline: a ring inside another is a hole, one beside it a part. A point is
inside if a ray to the east crosses the outline an odd number of times; an edge counts for the
heights from its lower end (included) to its upper end (excluded).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvia.functions.spatial import ring_edges
from pluvia.operators.interpolation import Grid, inside_cells, ring_box

#: Cells along the longer side of the box around all polygons.
CELLS_ACROSS = 256


def cover_grid(basins: DataFrame, across: int = CELLS_ACROSS) -> Grid | None:
    """The cells that cover all rings; None where there is no ring with a point."""
    west, east, south, north = ring_box(basins)
    if west is None:
        return None
    side = max(east - west, north - south) / across or 1.0
    columns, rows = (int((b - a) / side) + 1 for a, b in ((west, east), (south, north)))
    return Grid(west, south, side, columns, rows)


def column_of(x: Column, grid: Grid) -> Column:
    return F.floor((x - grid.west) / grid.step)


def row_of(y: Column, grid: Grid) -> Column:
    return F.floor((y - grid.south) / grid.step)


def edges(basins: DataFrame) -> DataFrame:
    """One row an edge of an outline: ``basin, x1, y1, x2, y2``."""
    rings = basins.select(
        F.coalesce("name", F.lit("")).alias("basin"), ring_edges(F.col("ring")).alias("edges")
    )
    return rings.select("basin", F.explode("edges").alias("edge")).select("basin", "edge.*")


def row_edges(basins: DataFrame, grid: Grid) -> DataFrame:
    """The edges by the rows of cells they cross, with the columns they touch there.

    Both are widened by a millionth of a cell, so that rounding loses no border cell.
    """
    spread = edges(basins).withColumn(
        "iy",
        F.explode(
            F.sequence(row_of(F.least("y1", "y2"), grid), row_of(F.greatest("y1", "y2"), grid))
        ),
    )
    margin = grid.step * 1e-6
    low = F.lit(grid.south) + F.col("iy") * grid.step - margin
    high = F.lit(grid.south) + (F.col("iy") + 1) * grid.step + margin
    rise = F.col("y2") - F.col("y1")

    def x_at(y: Column) -> Column:
        inside = F.least(F.greatest(y, F.least("y1", "y2")), F.greatest("y1", "y2"))
        slope = (F.col("x2") - F.col("x1")) / F.when(rise != 0, rise)
        return F.col("x1") + (inside - F.col("y1")) * slope

    a, b = (F.when(rise == 0, F.col(f"x{i}")).otherwise(x_at(y)) for i, y in ((1, low), (2, high)))
    return spread.withColumns(
        {
            "first": column_of(F.least(a, b) - margin, grid),
            "last": column_of(F.greatest(a, b) + margin, grid),
        }
    )


def cover(basins: DataFrame, grid: Grid) -> DataFrame:
    """The cells of each polygon: ``basin, ix, iy, inner``. A polygon is not in its other cells."""
    border = row_edges(basins, grid).select(
        "basin", F.explode(F.sequence("first", "last")).alias("ix"), "iy"
    ).distinct()
    inner = inside_cells(basins, grid).join(border, ["basin", "ix", "iy"], "left_anti")
    return inner.withColumn("inner", F.lit(True)).unionByName(
        border.withColumn("inner", F.lit(False))
    )


def slabs(basins: DataFrame, grid: Grid) -> DataFrame:
    """The edges of each polygon that cross a row of cells, as one list: ``basin, iy, edges``."""
    return row_edges(basins, grid).filter("y1 <> y2").groupBy("basin", "iy").agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("edges")
    )


def crosses(edge: Column, x: Column, y: Column) -> Column:
    """Whether a ray from the point to the east crosses the edge."""
    at = (edge["x2"] - edge["x1"]) * (y - edge["y1"]) / (edge["y2"] - edge["y1"]) + edge["x1"]
    return ((edge["y1"] > y) != (edge["y2"] > y)) & (x < at)


def points_in(
    points: DataFrame, basins: DataFrame, x: str = "lon", y: str = "lat",
    basin: str = "basin", grid: Grid | None = None,
) -> DataFrame:
    """``points`` with the name of each polygon they are in, in the column ``basin``.

    A point in several polygons has a row for each, one in none has no row, nor has one without
    coordinates. Points that are there twice are found twice. ``basins`` are ``name, ring`` (see the
    module); a missing name counts as empty. The result has the points' columns and one more.

    A spot that holds a third of all points is one cell: AQE splits it, or sends the polygons' cells
    to the points where these are few.
    """
    if basin in points.columns:
        raise ValueError(f"the points already have a column {basin}")
    grid = grid or cover_grid(basins)
    if grid is None:
        return points.withColumn(basin, F.lit(None).cast("string")).limit(0)
    px, py = (F.col(f"`{c}`").cast("double") for c in (x, y))
    at = F.struct(px.alias("x"), py.alias("y"))
    rows = points.select(F.struct(*[F.col(f"`{c}`") for c in points.columns]).alias("point"), at.alias("at"))
    within = (
        F.col("at.x").between(grid.west - grid.step, grid.west + (grid.nx + 1) * grid.step)
        & F.col("at.y").between(grid.south - grid.step, grid.south + (grid.ny + 1) * grid.step)
    )
    cells = rows.filter(within).select(
        "point", "at", column_of(F.col("at.x"), grid).alias("ix"), row_of(F.col("at.y"), grid).alias("iy")
    )
    met = cells.join(cover(basins, grid), ["ix", "iy"])
    tested = met.filter("not inner").join(slabs(basins, grid), ["basin", "iy"])
    odd = F.size(F.filter("edges", lambda e: crosses(e, F.col("at.x"), F.col("at.y")))) % 2 == 1
    found = met.filter("inner").select("point", "basin").unionByName(
        tested.filter(odd).select("point", "basin")
    )
    return found.select("point.*", F.col("basin").alias(basin))


def masked(
    points: DataFrame, basins: DataFrame, *keys: str, x: str = "lon", y: str = "lat"
) -> DataFrame:
    """The points in at least one polygon, one row for each value of ``keys``."""
    return points_in(points, basins, x, y, "basin_").dropDuplicates(list(keys)).drop("basin_")
