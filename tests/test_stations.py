import datetime as dt

import numpy as np
import pytest

from pluvia.operators import observations, stations


def brute(places, cells):
    out = {}
    for name, lat, lon in places:
        out[name] = min(((lon - c[2]) ** 2 + (lat - c[1]) ** 2, c[0]) for c in cells)[1]
    return out


def frames(spark, places, cells):
    return (
        spark.createDataFrame(places, "location string, lat double, lon double"),
        spark.createDataFrame(cells, "cell_id int, lat double, lon double"),
    )


def found(df):
    return {r.location: r.cell_id for r in df.collect()}


@pytest.mark.parametrize("limit", [stations.CELLS_AS_ARRAY, 0])
def test_tie_goes_to_the_lower_id(spark, limit):
    s, c = frames(spark, [("A", 0.0, 0.0)], [(7, 0.0, 1.0), (3, 0.0, -1.0), (9, 0.0, -1.0)])
    assert found(stations.nearest_cell(s, c, limit)) == {"A": 3}


@pytest.mark.parametrize("limit", [stations.CELLS_AS_ARRAY, 0])
def test_single_cell_and_single_line(spark, limit):
    s, c = frames(spark, [("A", 3.0, 4.0), ("B", -1.0, 0.0)], [(1, 0.0, 0.0)])
    assert found(stations.nearest_cell(s, c, limit)) == {"A": 1, "B": 1}
    s, c = frames(spark, [("A", 3.0, 4.2)], [(i, 5.0, float(i)) for i in range(9)])
    assert found(stations.nearest_cell(s, c, limit)) == {"A": 4}


@pytest.mark.parametrize("seed", [1, 2])
def test_tree_is_exact_on_clusters_and_outliers(spark, seed):
    rng = np.random.default_rng(seed)
    # a third of the cells in one tiny spot, copies, a coarse lattice and far outliers
    spot = rng.normal([-33.5, -71.1], 1e-4, (1200, 2))
    spread = rng.uniform([-36, -75], [-31, -68], (2200, 2))
    lattice = [(la, lo) for la in range(-36, -30) for lo in range(-75, -67)]
    points = [tuple(map(float, p)) for p in [*spot, *spread, *lattice, (10.0, 40.0)]]
    points += points[:50]
    cells = [(i + 1, la, lo) for i, (la, lo) in enumerate(points)]
    near = rng.uniform([-37, -76], [-30, -67], (150, 2))
    close = rng.normal([-33.5, -71.1], 1e-3, (100, 2))
    places = [
        (str(i), float(la), float(lo))
        for i, (la, lo) in enumerate([*near, *close, (-33.5, -70.5), (80.0, -170.0), (12.0, 38.0)])
    ]
    s, c = frames(spark, places, cells)
    expected = brute(places, cells)
    assert found(stations.nearest_cell(s, c)) == expected
    assert found(stations.nearest_cell(s, c, max_array_cells=0)) == expected


@pytest.mark.parametrize("limit", [stations.CELLS_AS_ARRAY, 0])
def test_copies_and_missing_coordinates(spark, limit):
    s, c = frames(
        spark, [("A", 0.0, 0.2), ("A", 0.0, 4.8), ("B", 0.0, 0.2), ("C", None, 1.0)],
        [(i, 0.0, float(i)) for i in range(6)] + [(9, None, 0.0)],
    )
    got = stations.nearest_cell(s, c, limit)
    assert got.columns == ["location", "lat", "lon", "cell_id", "distance"]
    assert sorted((r.location, r.lon, r.cell_id, round(r.distance, 9)) for r in got.collect()) == [
        ("A", 0.2, 0, 0.2), ("A", 4.8, 5, 0.2), ("B", 0.2, 0, 0.2)
    ]


@pytest.mark.parametrize("limit", [stations.CELLS_AS_ARRAY, 0])
def test_no_cells(spark, limit):
    s, c = frames(spark, [("A", 0.0, 0.2)], [(1, None, 0.0)])
    assert stations.nearest_cell(s, c, limit).count() == 0


def test_export_layout(spark):
    D = dt.date
    corrected = spark.createDataFrame(
        [("A B", D(2024, 1, 1), 0.0, 1.5), ("A B", D(2024, 1, 2), 0.0, 2.5),
         ("C", D(2024, 1, 1), 0.0, 0.0)],
        "location string, valid_date date, mm double, mm_corrected double",
    )
    table = spark.createDataFrame(
        [("A B", -33.0, -70.0, 500.0), ("C", -34.0, -71.0, 20.0)],
        "location string, lat double, lon double, alt double",
    )
    wide = stations.forecast_export(corrected, table, [D(2024, 1, 1), D(2024, 1, 2)])
    assert wide.columns == ["location", "2024-01-01", "2024-01-02", "lat", "lon", "alt"]
    rows = {r.location: tuple(r)[1:] for r in wide.collect()}
    assert rows == {"A B": (1.5, 2.5, -33.0, -70.0, 500.0), "C": (0.0, None, -34.0, -71.0, 20.0)}
    days = [r.valid_date for r in stations.valid_days(corrected).collect()]
    assert days == [D(2024, 1, 1), D(2024, 1, 2)]


def test_observations(spark):
    D = dt.date
    rows = [("A B", D(2012, 7, d), float(d % 3)) for d in range(1, 7)] + [("A", D(2012, 8, 1), 9.0)]
    obs = spark.createDataFrame(rows, "location string, obs_date date, mm double")
    wide = observations.pivot(obs, ["A B", "A"])
    assert wide.columns == ["obs_date", "A.B", "A"]
    back = observations.unpivot(wide, "obs_date").filter("mm is not null")
    assert back.select("location", "obs_date", "mm").exceptAll(obs).isEmpty()
    assert back.count() == len(rows)
    # an exact name: "A" does not take in "A B"
    assert observations.of_station(obs, "A").count() == 1
    wet = observations.month_wet(obs, 7)
    assert {r.mm for r in wet.collect()} == {1.0, 2.0} and wet.count() == 4
    assert observations.date_range(obs, D(2012, 7, 2), D(2012, 7, 4)).count() == 3
    assert {r.mm for r in observations.clamped(obs, 2.0).collect()} == {0.0, 2.0, 9.0}
    assert {r.location: r.max_mm for r in observations.maximum(obs, "location").collect()} == {
        "A B": 2.0, "A": 9.0
    }
