"""Distances and polygons."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Equatorial radius (km) and flattening of WGS84, and the mean radius.
WGS84_RADIUS = 6378.137
WGS84_FLATTENING = 1.0 / 298.257223563
MEAN_RADIUS = 6371.0


def squared_degrees(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared planar distance, both axes in degrees."""
    dx, dy = x1 - x2, y1 - y2
    return dx * dx + dy * dy


def np_distance(x1, y1, x2, y2, metric: str) -> np.ndarray:
    """Distances between numpy arrays of points (degrees for euclidean, else km)."""
    if metric == "euclidean":
        return np.hypot(x1 - x2, y1 - y2)
    lon1, lat1, lon2, lat2 = (np.radians(v) for v in (x1, y1, x2, y2))
    if metric == "haversine":
        h = (
            np.sin((lat1 - lat2) / 2) ** 2
            + np.cos(lat1) * np.cos(lat2) * np.sin((lon1 - lon2) / 2) ** 2
        )
        return 2 * MEAN_RADIUS * np.arcsin(np.sqrt(np.minimum(h, 1.0)))
    if metric != "ellipsoid":
        raise ValueError(f"unknown metric: {metric}")
    # first-order flattening correction of the great circle
    cos_sum = np.cos(lat1) * np.cos(lat2) - np.sin(lat1) * np.sin(lat2)
    sin2_mid, cos2_mid = (1 - cos_sum) / 2, (1 + cos_sum) / 2
    sin2_half, sin2_turn = np.sin((lat1 - lat2) / 2) ** 2, np.sin((lon1 - lon2) / 2) ** 2
    cos2_half, cos2_turn = 1 - sin2_half, 1 - sin2_turn
    s = sin2_half * cos2_turn + cos2_mid * sin2_turn
    c = 1 - s
    with np.errstate(all="ignore"):
        w = np.arcsin(np.sqrt(s))
        r = np.sqrt(s * c) / w
        arc = 2 * w * WGS84_RADIUS
        bend = (3 * r - 1) / (2 * c) * sin2_mid * cos2_half - (3 * r + 1) / (
            2 * s
        ) * cos2_mid * sin2_half
        return np.where(s == 0, 0.0, arc * (1 + WGS84_FLATTENING * bend))


def ring_edges(ring: Column) -> Column:
    """Array of (x1, y1, x2, y2), the last point joined to the first."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(
        ring,
        following,
        lambda a, b: F.struct(
            a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")
        ),
    )
