import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pluvia import schemas
from pluvia.operators import polygons
from pluvia.operators.interpolation import Grid
from pluvia.sources import readers, writers


def inside(ring_list, px, py):
    odd = False
    for ring in ring_list:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                odd = not odd
    return odd


def star(rng, cx, cy, r, n):
    corners = []
    for i in range(n):
        a, d = 2 * math.pi * i / n, r * rng.uniform(0.3, 1)
        corners.append((cx + d * math.cos(a), cy + d * math.sin(a)))
    return corners


def basin_rows(rng):
    outlines = {
        "large": [star(rng, 0, 0, 10, 400)],
        "holed": [star(rng, 2, 1, 6, 60), star(rng, 2, 1, 1.5, 20), star(rng, -9, 9, 2, 9)],
        "square": [[(-3.0, -3.0), (-3.0, 3.0), (3.0, 3.0), (3.0, -3.0)]],
        "steps": [[(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (2.0, 1.0), (2.0, 2.0), (0.0, 2.0)]],
        "flat": [[(-8.0, 5.0), (8.0, 5.0 + 1e-12), (8.0, 5.5), (-8.0, 5.5)]],
        "line": [[(1.0, 1.0), (2.0, 2.0)]],
        "tiny": [[(7.0, 7.0), (7.001, 7.0), (7.0, 7.001)]],
    }
    return outlines, [(n, [{"x": x, "y": y} for x, y in r]) for n, rs in outlines.items() for r in rs]


def point_rows(rng, outlines):
    points = [(rng.uniform(-12, 12), rng.uniform(-12, 12)) for _ in range(1500)]
    points += [(float(rng.randint(-5, 5)), float(rng.randint(-5, 5))) for _ in range(300)]
    points += [p for rings in outlines.values() for r in rings for p in r]  # corners
    points += [(7.0002, 7.0002), (1e9, 0.0), (float("nan"), 0.0), (None, 1.0), (1.0, None)]
    points += [(0.5, 0.5)] * 50
    return [(i, x, y, "extra", i % 5) for i, (x, y) in enumerate(points)]


@pytest.mark.parametrize("across", [1, 7, 64, 1000])
def test_against_every_edge(spark, across):
    rng = random.Random(across)
    outlines, rows = basin_rows(rng)
    points = point_rows(rng, outlines)
    basins = spark.createDataFrame(rows, schemas.BASIN)
    frame = spark.createDataFrame(points, "id int, lon double, lat double, point string, iy int")
    got = polygons.points_in(frame, basins, grid=polygons.cover_grid(basins, across))
    assert got.columns == ["id", "lon", "lat", "point", "iy", "basin"]
    want = {
        (i, n) for i, x, y, *_ in points if None not in (x, y) for n, r in outlines.items() if inside(r, x, y)
    }
    found = [(r.id, r.basin) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    once = polygons.masked(frame, basins, "id")
    assert sorted(r.id for r in once.collect()) == sorted({i for i, _ in want})


def test_shares_of_the_cover(spark):
    """Inner cells need no test: most points of a large polygon are in one."""
    basins = spark.createDataFrame(basin_rows(random.Random(2))[1], schemas.BASIN).filter("name = 'square'")
    cover = polygons.cover(basins, polygons.cover_grid(basins, 256))
    counts = dict(cover.groupBy("inner").count().collect())
    assert counts[True] > 40 * counts[False]


def test_nothing_given(spark):
    points = spark.createDataFrame([(1, 0.5, 0.5)], "id int, lon double, lat double")
    none = spark.createDataFrame([], schemas.BASIN)
    assert polygons.points_in(points, none).columns == ["id", "lon", "lat", "basin"]
    assert polygons.points_in(points, none).count() == 0
    empty = spark.createDataFrame([("a", []), (None, [{"x": 0.0, "y": 0.0}])], schemas.BASIN)
    assert polygons.points_in(points, empty).count() == 0
    square = spark.createDataFrame(basin_rows(random.Random(1))[1], schemas.BASIN)
    assert polygons.points_in(points.limit(0), square).count() == 0
    with pytest.raises(ValueError):
        polygons.points_in(points.withColumn("basin", F.lit(1)), square)


def test_plan(spark):
    basins = spark.createDataFrame(basin_rows(random.Random(1))[1], schemas.BASIN)
    points = spark.range(1000).select((F.col("id") / 100).alias("lon"), F.lit(0.5).alias("lat"))
    plan = polygons.points_in(points, basins)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_grid_of_one_point(spark):
    basins = spark.createDataFrame([("a", [{"x": 1.0, "y": 2.0}])], schemas.BASIN)
    assert polygons.cover_grid(basins) == Grid(1.0, 2.0, 1.0, 1, 1)


GEOJSON = {
    "type": "FeatureCollection",
    "features": [
        {"type": "Feature", "properties": {"NOMBRE": "a", "area": 2.5, "ok": None}, "geometry": {
            "type": "Polygon", "coordinates": [
                [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"NOMBRE": "b"}, "geometry": {
            "type": "MultiPolygon", "coordinates": [
                [[[10, 0, 7.5], [12, 0, 7.5], [12, 2, 7.5], [10, 0, 7.5]]], [[[20, 0], [21, 0], [21, 1]]]]}},
        {"type": "Feature", "properties": {}, "geometry": {
            "type": "Polygon", "coordinates": [[[30, 0], [31, 0], [31, 1], [30, 0]]]}},
        {"type": "Feature", "properties": {"NOMBRE": "p"}, "geometry": {"type": "Point", "coordinates": [1, 2]}},
        {"type": "Feature", "properties": None, "geometry": None},
    ],
}
RINGS = {
    ("a", ((0, 0), (4, 0), (4, 4), (0, 4))), ("a", ((1, 1), (2, 1), (2, 2))),
    ("b", ((10, 0), (12, 0), (12, 2))), ("b", ((20, 0), (21, 0), (21, 1))),
    (None, ((30, 0), (31, 0), (31, 1))),
}


def rings(df):
    return {(r.name, tuple((p.x, p.y) for p in r.ring)) for r in df.collect()}


def test_geojson(spark, tmp_path):
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "basins.geojson").write_text(json.dumps(GEOJSON, indent=2))
    (tmp_path / "lines.geojsonl").write_text("\n".join(json.dumps(f) for f in GEOJSON["features"]) + "\n")
    assert rings(readers.geojson_basins(spark, str(tmp_path / "whole"))) == RINGS
    read = readers.geojson_basins(spark, str(tmp_path / "lines.geojsonl"), lines=True)
    assert rings(read) == RINGS and read.schema["ring"].dataType == schemas.BASIN["ring"].dataType
    found = polygons.points_in(
        spark.createDataFrame([(1, 3.0, 3.0), (2, 1.8, 1.2), (3, 11.5, 0.5)], "id int, lon double, lat double"),
        read,
    )
    assert sorted((r.id, r.basin) for r in found.collect()) == [(1, "a"), (3, "b")]


def test_geojson_round_trip(spark, tmp_path):
    rows = basin_rows(random.Random(3))[1]
    basins = spark.createDataFrame(rows, schemas.BASIN)
    writers.geojson_basins(basins, str(tmp_path / "out"))
    assert rings(readers.geojson_basins(spark, str(tmp_path / "out"), lines=True)) == rings(basins)
