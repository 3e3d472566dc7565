"""The queries of ``checks.queries`` as DuckDB SQL over the driver's tables.

Written from the operators' definitions and not from their Spark plans: sums over digamma
terms instead of recurrences, bisection instead of Newton steps, plain cross products
instead of tiles.
"""

from __future__ import annotations

import re

from pluvia.config import GRID_LAT, GRID_LON360

from checks import standins as v

_LON = ", ".join(map(str, GRID_LON360))
_LAT = ", ".join(map(str, GRID_LAT))
_START, _END = (f"DATE '{d}'" for d in v.RANGE)
_MONTH = str(v.AS_OF.month)


def _daily(shift: int) -> str:
    return f"""SELECT issue_ts, cell_id, CAST(issue_ts + to_hours(6 * step - {shift}) AS DATE)
      AS valid_date, sum(prate * 21600.0) AS mm FROM fc6h GROUP BY ALL"""


def _last(daily: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id, valid_date
      ORDER BY issue_ts DESC) AS rank FROM {daily}) WHERE rank <= 12"""


def _vote(last: str, p: int, q: int) -> str:
    return f"""SELECT cell_id, valid_date, n_issues, n_wet,
      CASE WHEN n_wet * {q} >= n_issues * {p} THEN coalesce(wet_mean, 0) ELSE 0 END AS mm
      FROM (SELECT cell_id, valid_date, count(*) AS n_issues,
        count(*) FILTER (mm > 0.5) AS n_wet, avg(mm) FILTER (mm > 0.5) AS wet_mean
        FROM {last} GROUP BY ALL)"""


def _filled(product: str, daily: str, voted: str, first: str, last: str) -> str:
    return f"""SELECT '{product}' AS product, c.cell_id, CAST(d.valid_date AS DATE) AS valid_date,
      coalesce(mm, 0) AS mm, coalesce(n_issues, 0) AS n_issues, coalesce(n_wet, 0) AS n_wet
      FROM (SELECT DISTINCT cell_id FROM {daily}) c
      CROSS JOIN (SELECT unnest(generate_series({first}, {last}, INTERVAL 1 DAY)) AS valid_date) d
      LEFT JOIN {voted} x ON x.cell_id = c.cell_id AND x.valid_date = d.valid_date"""


def _psi(k: str) -> str:
    z = f"({k} + 20.0)"
    return f"""(ln({z}) - 0.5 / {z} - 1.0 / (12 * {z}^2) + 1.0 / (120 * {z}^4)
      - 1.0 / (252 * {z}^6) - list_sum(list_transform(range(0, 20), lambda i: 1.0 / ({k} + i))))"""


def _psi1(k: str) -> str:
    z = f"({k} + 20.0)"
    return f"""(1.0 / {z} + 0.5 / {z}^2 + 1.0 / (6 * {z}^3) - 1.0 / (30 * {z}^5)
      + list_sum(list_transform(range(0, 20), lambda i: 1.0 / ({k} + i)^2)))"""


def _free_fit(stats: str, keys: str) -> str:
    """Newton's method from a rough start, a recursion step per iteration."""
    return f"""SELECT {keys}, n, mean, g, k AS shape, mean / k AS scale FROM (
      WITH RECURSIVE it AS (
        SELECT *, (1 + sqrt(1 + 4 * s / 3)) / (4 * s) AS k, 0 AS i
        FROM (SELECT *, ln(mean) - g AS s FROM {stats} WHERE n >= 2) WHERE s > 1e-12
        UNION ALL
        SELECT {keys}, n, mean, g, s,
          k - (ln(k) - {_psi('k')} - s) / (1.0 / k - {_psi1('k')}) AS k, i + 1
        FROM it WHERE i < 25)
      SELECT * FROM it WHERE i = 25)"""


def _bounded_fit(free: str, keys: str, b: float) -> str:
    def likelihood(k: str, t: str) -> str:
        return f"(({k} - 1) * g - mean / {t} - {k} * ln({t}) - lgamma({k}))"

    root = f"""SELECT {keys}, k FROM (
      WITH RECURSIVE it AS (
        SELECT {keys}, g - ln({b}) AS y, exp(g - ln({b})) + 0.5 AS k, 0 AS i FROM {free}
        UNION ALL
        SELECT {keys}, y, k - ({_psi('k')} - y) / {_psi1('k')} AS k, i + 1 FROM it WHERE i < 25)
      SELECT * FROM it WHERE i = 25)"""
    return f"""SELECT {keys}, n, CASE WHEN shape >= {b} AND scale >= {b} THEN shape
        WHEN first_wins THEN {b} ELSE k2 END AS shape,
      CASE WHEN shape >= {b} AND scale >= {b} THEN scale
        WHEN first_wins THEN t1 ELSE {b} END AS scale
      FROM (SELECT *, {likelihood(f'{b}', 't1')} >= {likelihood('k2', f'{b}')} AS first_wins
        FROM (SELECT f.*, greatest({b}, mean / {b}) AS t1, greatest({b}, r.k) AS k2
          FROM {free} f JOIN ({root}) r USING ({keys})))"""


def _cdf(x: str, a: str, scale: str) -> str:
    """The series of the lower incomplete gamma function."""
    z = f"({x} / {scale})"
    return f"""CASE WHEN {x} <= 0 THEN 0.0 ELSE list_sum(list_transform(range(0, 250),
      lambda j: exp(({a} + j) * ln({z}) - {z} - lgamma({a} + j + 1)))) END"""


def _quantile(source: str, keys: str, p: str) -> str:
    """Bisection on the logarithm of x; ``source`` has keys, shape, scale and ``p``."""
    return f"""SELECT {keys}, exp((lo + hi) / 2) * scale AS x FROM (
      WITH RECURSIVE it AS (
        SELECT {keys}, {p} AS p, shape, scale, -40.0::DOUBLE AS lo, 6.0::DOUBLE AS hi, 0 AS i
        FROM {source}
        UNION ALL
        SELECT {keys}, p, shape, scale, CASE WHEN f < p THEN mid ELSE lo END,
          CASE WHEN f < p THEN hi ELSE mid END, i + 1
        FROM (SELECT *, {_cdf('exp(mid)', 'shape', '1.0')} AS f
          FROM (SELECT *, (lo + hi) / 2 AS mid FROM it WHERE i < 56)))
      SELECT * FROM it WHERE i = 56)"""


_SCORE_TABLE = """SELECT location, month, count(*) FILTER (f > 0.5 AND o > 0) AS n_hit,
  count(*) FILTER (f < 0.5 AND o > 0) AS n_miss, count(*) FILTER (f > 0.5 AND o <= 0) AS n_fa,
  count(*) FILTER (f <= 0.5 AND o <= 0) AS n_cn,
  count(*) FILTER (f IS NULL OR o IS NULL) AS n_excluded
  FROM (SELECT location, month(valid_date) AS month, mm_corrected AS f, registro AS o
    FROM pairs) GROUP BY ALL"""


def _corrected(series: str, month: str, fit: str = "fit") -> str:
    """Distinct forecasts of a station and month are mapped once; dry days stay 0."""
    return f"""SELECT s.location, s.valid_date, s.mm,
      CASE WHEN s.mm <= 0 AND o.shape IS NOT NULL AND m.shape IS NOT NULL THEN 0.0
        ELSE q.x END AS mm_corrected
      FROM (SELECT *, {month} AS month FROM {series}) s
      LEFT JOIN obs_{fit} o ON o.location = s.location AND o.month = s.month
      LEFT JOIN model_{fit} m ON m.cell_id = s.cell_id AND m.month = s.month
      LEFT JOIN mapped_{series}_{fit} q
        ON q.location = s.location AND q.mm = s.mm AND q.month = s.month"""


def _mapped(series: str, month: str, fit: str = "fit") -> str:
    source = f"""(SELECT *, {_cdf('mm', 'mshape', 'mscale')} AS p0 FROM (
      SELECT DISTINCT s.location, s.month, s.mm, o.shape, o.scale, m.shape AS mshape,
        m.scale AS mscale
      FROM (SELECT *, {month} AS month FROM {series}) s
      JOIN obs_{fit} o ON o.location = s.location AND o.month = s.month
      JOIN model_{fit} m ON m.cell_id = s.cell_id AND m.month = s.month WHERE s.mm > 0))"""
    return _quantile(source, "location, month, mm", "p0")


def _located(first: int) -> str:
    return f"""SELECT vec_id, label, CAST(embedding[{first}] AS DOUBLE) * 9 - 71 AS lon,
      CAST(embedding[{first + 1}] AS DOUBLE) * 6 - 33.5 AS lat FROM embeddings"""


def _series(product: str) -> str:
    return f"""SELECT location, cell_id, valid_date, mm FROM near JOIN consensus_{product}
      USING (cell_id)"""


_HEXAGON = [(-1.0, 0.0), (-0.5, 1.0), (0.5, 1.0), (1.0, 0.0), (0.5, -1.0), (-0.5, -1.0)]


def _corners(scale: float) -> str:
    def corner(i: int) -> str:
        p, q = (scale * c for c in _HEXAGON[i % 6])
        return f"cx + a * ({p}) AS x{{0}}, cy + b * ({q}) AS y{{0}}"

    return " UNION ALL ".join(
        f"SELECT label, {i} AS i, {corner(i).format(1)}, {corner(i + 1).format(2)} FROM label_box"
        for i in range(6)
    )


def _inside(edges: str) -> str:
    return f"""SELECT DISTINCT ix, iy, x, y FROM (SELECT ix, iy, x, y, label
      FROM points CROSS JOIN {edges} WHERE (y1 > y) <> (y2 > y)
        AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
      GROUP BY ALL HAVING count(*) % 2 = 1)"""


def _in_basin(points: str, key: str) -> str:
    return f"""SELECT {key}, CAST(label AS VARCHAR) AS basin FROM (SELECT {key}, e.label
      FROM {points} CROSS JOIN holed_edges e WHERE (y1 > lat) <> (y2 > lat)
        AND lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1
      GROUP BY ALL HAVING count(*) % 2 = 1)"""


# distance on the ellipsoid, first order in the flattening
_ELLIPSOID = """SELECT ix, iy, location, CASE WHEN s = 0 THEN 0 ELSE 2 * w * 6378.137 * (1
  + 1 / 298.257223563 * ((3 * r - 1) / (2 * c) * sf * cg - (3 * r + 1) / (2 * s) * cf * sg)) END
  AS d FROM (SELECT *, sqrt(s * c) / w AS r FROM (SELECT *, atan2(sqrt(s), sqrt(c)) AS w FROM (
    SELECT *, sg * cl + cf * sl AS s, cg * cl + sf * sl AS c FROM (
      SELECT ix, iy, location, sin(f)^2 AS sf, cos(f)^2 AS cf, sin(g)^2 AS sg, cos(g)^2 AS cg,
        sin(l)^2 AS sl, cos(l)^2 AS cl FROM (
        SELECT ix, iy, location, radians(y + lat) / 2 AS f, radians(y - lat) / 2 AS g,
          radians(x - lon) / 2 AS l FROM inside CROSS JOIN stations
          WHERE location IN (SELECT location FROM obs_recent))))))"""

# Named steps; each may use any other and only the needed ones go into a statement.
_STEPS = {
    "fc6h": f"""SELECT date_trunc('day', ts) + to_hours(6 * (hour(ts) // 6)) AS issue_ts,
      CAST(user_id % 9 + 1 AS INTEGER) AS cell_id, CAST(user_id % 7 + 1 AS INTEGER) AS lon_idx,
      CAST((user_id // 7) % 5 + 1 AS INTEGER) AS lat_idx,
      CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS step,
      greatest(value - {v.DRY}, 0) / 21600.0 AS prate,
      ([{_LON}]::DOUBLE[])[user_id % 7 + 1] - 360 AS lon,
      ([{_LAT}]::DOUBLE[])[(user_id // 7) % 5 + 1] AS lat FROM events""",
    "issues": """SELECT DISTINCT issue_ts, strftime(issue_ts, '%Y%m%d%H') AS issue_id
      FROM fc6h""",
    "expected": """SELECT ts AS issue_ts, strftime(ts, '%Y%m%d%H') AS issue_id FROM (
      SELECT unnest(generate_series(CAST(CAST(min(ts) AS DATE) - 5 AS TIMESTAMP),
        CAST(CAST(max(ts) AS DATE) + 5 AS TIMESTAMP) + INTERVAL 18 HOUR, INTERVAL 6 HOUR))
      AS ts FROM events)""",
    "alarms": f"""SELECT issue_id, due, CASE WHEN a > due THEN 'late' WHEN a IS NULL
      AND due < (SELECT max(ts) FROM events) THEN 'missing' END AS status,
      CAST(floor(epoch(a)) - epoch(due) AS BIGINT) AS late_seconds
      FROM (SELECT issue_id, issue_ts, issue_ts + to_seconds({v.LATENCY.seconds}) AS due FROM expected)
      LEFT JOIN (SELECT date_trunc('day', ts) + to_hours(6 * (hour(ts) // 6)) AS issue_ts, min(ts) AS a
        FROM events GROUP BY 1) USING (issue_ts)""",
    "links": """SELECT page_id, unnest(l) AS link, generate_subscripts(l, 1) - 1 AS pos
      FROM (SELECT page_id, regexp_extract_all(html, '<a href="(.*?)"', 1) AS l FROM pages)""",
    "daily_reforecast": _daily(12),
    "daily_operational": _daily(18),
    "daily_realtime": _daily(6),
    "last_reforecast": _last("daily_reforecast"),
    "last_operational": _last("daily_operational"),
    "last_realtime": _last("daily_realtime"),
    "vote_reforecast": _vote("last_reforecast", 1, 2),
    "vote_operational": _vote("last_operational", 1, 5),
    "vote_realtime": _vote("last_realtime", 100, 333),
    "consensus_reforecast": _filled(
        "reforecast", "daily_reforecast", "vote_reforecast", _START, _END
    ),
    "consensus_operational": _filled(
        "operational", "daily_operational", "vote_operational", _START, _END
    ),
    "consensus_realtime": _filled(
        "realtime", "daily_realtime", "vote_realtime",
        "(SELECT CAST(min(issue_ts) AS DATE) FROM fc6h)",
        "(SELECT CAST(min(issue_ts) AS DATE) + 14 FROM fc6h)",
    ),
    "daily_rerun": f"""SELECT issue_ts, lat_idx - 1 + 3 * (lon_idx - 3) AS cell_id,
      CAST(issue_ts + to_hours(6 * step - 6) AS DATE) AS valid_date, sum(prate * 21600.0) AS mm
      FROM fc6h WHERE lat_idx BETWEEN 2 AND 4 AND lon_idx BETWEEN 3 AND 5
      AND issue_ts >= TIMESTAMP '{v.RERUN}' GROUP BY ALL""",
    "last_rerun": _last("daily_rerun"),
    "vote_rerun": _vote("last_rerun", 100, 333),
    "consensus_rerun": _filled(
        "realtime", "daily_rerun", "vote_rerun",
        "(SELECT CAST(min(issue_ts) AS DATE) FROM daily_rerun)",
        "(SELECT CAST(min(issue_ts) AS DATE) + 14 FROM daily_rerun)",
    ),
    "pool": """SELECT cell_id, month(valid_date) AS month, mm FROM daily_reforecast
      WHERE mm > 0.5 AND month(valid_date) = month(issue_ts)""",
    "pool_stats": """SELECT cell_id, month, count(*) AS n, avg(mm) AS mean, avg(ln(mm)) AS g,
      max(mm) AS max_mm FROM pool GROUP BY ALL""",
    "places": _located(1),
    "stations": """SELECT replace(s_name, '#', ' ') AS location, lat, lon, s_acctbal AS alt
      FROM supplier JOIN places ON s_suppkey = vec_id JOIN nation ON s_nationkey = n_nationkey""",
    "cells": f"""SELECT la - 1 + 3 * (lo - 3) AS cell_id, ([{_LAT}]::DOUBLE[])[la] AS lat,
      ([{_LON}]::DOUBLE[])[lo] - 360 AS lon FROM range(2, 5) a(la), range(3, 6) b(lo)""",
    "near": """SELECT location, cell_id FROM (SELECT s.location, c.cell_id, row_number() OVER (
      PARTITION BY s.location ORDER BY (s.lon - c.lon) * (s.lon - c.lon)
        + (s.lat - c.lat) * (s.lat - c.lat), c.cell_id) AS r
      FROM stations s CROSS JOIN cells c) WHERE r = 1""",
    "near_many": f"""SELECT location, cell_id, sqrt(d2) AS distance FROM (
      SELECT *, row_number() OVER (PARTITION BY location ORDER BY d2, cell_id) AS r FROM (
        SELECT CAST(s.vec_id AS VARCHAR) AS location, c.vec_id + 1 AS cell_id,
        (s.lon - c.lon) * (s.lon - c.lon) + (s.lat - c.lat) * (s.lat - c.lat) AS d2
        FROM places s CROSS JOIN ({_located(3)}) c)) WHERE r = 1""",
    "recent_stats": """SELECT month, count(*) AS n, avg(mm) AS mean, avg(ln(mm)) AS g FROM (
      SELECT month(obs_date) AS month, mm FROM obs_recent WHERE mm > 0) GROUP BY month""",
    "recent_fit": _free_fit("recent_stats", "month"),
    "draws": """SELECT month, draw, shape, scale, (CAST('0x' || substr(md5(
      '0|' || month || '|' || draw), 1, 13) AS BIGINT) + 0.5) / 4503599627370496 AS u
      FROM recent_fit, range(1, 10001) t(draw)""",
    "drawn": _quantile("draws", "month, draw", "u"),
    "obs_hist": """SELECT replace(s_name, '#', ' ') AS location, obs_date, mm FROM (
      SELECT l_suppkey, CAST(l_shipdate AS DATE) AS obs_date, sum(l_extendedprice) / 5000 AS mm
      FROM lineitem GROUP BY ALL) JOIN supplier ON l_suppkey = s_suppkey""",
    "obs_recent": f"""SELECT replace(s_name, '#', ' ') AS location, obs_date, mm FROM (
      SELECT user_id * 2 // 3 AS k, CAST(ts AS DATE) AS obs_date,
      greatest(avg(value) - {v.OBS_DRY}, 0) AS mm FROM events GROUP BY ALL)
      JOIN supplier ON k = s_suppkey""",
    "obs_priority": """SELECT o_orderpriority AS location, CAST(o_orderdate AS DATE) AS obs_date,
      sum(o_totalprice) / 10000 AS mm FROM orders GROUP BY ALL""",
    "wet": """SELECT *, month(obs_date) AS month FROM obs_hist WHERE mm > 0""",
    "obs_stats": """SELECT location, month, count(*) AS n, avg(mm) AS mean, avg(ln(mm)) AS g
      FROM wet GROUP BY ALL""",
    "obs_free": _free_fit("obs_stats", "location, month"),
    "obs_fit": _bounded_fit("obs_free", "location, month", 0.1),
    "model_free": _free_fit("pool_stats", "cell_id, month").replace("FROM pool_stats", """FROM
      (SELECT cell_id, month, n, mean, g FROM pool_stats)"""),
    "model_fit": _bounded_fit("model_free", "cell_id, month", 0.5),
    "both_fits": """SELECT location, month, 'Observado' AS source, n, shape, scale FROM obs_fit
      UNION ALL SELECT location, month, 'Reforecast', n, shape, scale
      FROM near JOIN model_fit USING (cell_id)""",
    "series_realtime": _series("realtime"),
    "series_operational": _series("operational"),
    "mapped_series_realtime_fit": _mapped("series_realtime", _MONTH),
    "mapped_series_realtime_free": _mapped("series_realtime", _MONTH, "free"),
    "mapped_series_operational_fit": _mapped("series_operational", "month(valid_date)"),
    "corrected_realtime": _corrected("series_realtime", _MONTH),
    "corrected_free": _corrected("series_realtime", _MONTH, "free"),
    "corrected_operational": _corrected("series_operational", "month(valid_date)"),
    "pairs": f"""SELECT c.location, c.valid_date, mm_corrected, o.mm AS registro
      FROM corrected_operational c JOIN obs_recent o
      ON c.location = o.location AND c.valid_date = o.obs_date
      WHERE o.obs_date BETWEEN {_START} AND {_END}""",
    "score_table": _SCORE_TABLE,
    "label_box": """SELECT label, (w + e) / 2 AS cx, (s + n) / 2 AS cy, (e - w) * 0.3 AS a,
      (n - s) * 0.2 AS b FROM (SELECT label, min(lon) AS w, max(lon) AS e, min(lat) AS s,
      max(lat) AS n FROM places GROUP BY label)""",
    "edges": _corners(1.0),
    "grid": """SELECT *, CAST(floor((e - w) / step + 1e-9) AS BIGINT) AS nx,
      CAST(floor((n - s) / step + 1e-9) AS BIGINT) AS ny FROM (
      SELECT *, sqrt((e - w) * (n - s) / 50000) AS step FROM (
        SELECT min(x1) AS w, max(x1) AS e, min(y1) AS s, max(y1) AS n FROM edges))""",
    "points": """SELECT ix, iy, w + (ix + 0.5) * step AS x, s + (iy + 0.5) * step AS y
      FROM grid, range(0, (SELECT nx FROM grid)) a(ix), range(0, (SELECT ny FROM grid)) b(iy)""",
    "holed_edges": f"SELECT * FROM edges UNION ALL {_corners(v.HOLE)}",
    "inside": _inside("edges"),
    "inside_holed": _inside("holed_edges"),
    "places_in": _in_basin("places", "vec_id"),
    "stations_in": _in_basin("stations", "location"),
    "distances": _ELLIPSOID,
    "interpolated": """SELECT obs_date AS valid_date, ix, iy,
      CASE WHEN count(*) FILTER (d = 0) > 0 THEN avg(mm) FILTER (d = 0)
      ELSE sum(mm / (d * d)) / sum(1 / (d * d)) END AS mm
      FROM distances JOIN obs_recent USING (location) GROUP BY ALL""",
}


def _needed(sql: str) -> list[str]:
    """Names of the steps a text uses, in the order they must be stated."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _STEPS:
            if name not in order and re.search(rf"\b(FROM|JOIN|IN)\b[\s(]*{name}\b|,\s*{name}\b",
                                               text):
                visit(_STEPS[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def _statement(columns: str, source: str) -> str:
    """``columns``: words ``name`` or ``name:kind`` with kind int, day, time, or decimals."""
    parts = []
    for word in columns.split():
        name, _, kind = word.partition(":")
        quoted = f'"{name}"'
        if kind == "int":
            expression = f"CAST({quoted} AS BIGINT)"
        elif kind == "day":
            expression = f"strftime({quoted}, '%Y-%m-%d')"
        elif kind == "time":
            expression = f"strftime({quoted}, '%Y-%m-%d %H:%M:%S')"
        elif kind:
            expression = f"round({quoted} + 3e-8, {kind})"
        else:
            expression = quoted
        parts.append(f"{expression} AS {quoted}")
    steps = ",\n".join(f"{n} AS MATERIALIZED ({_STEPS[n]})" for n in _needed(f"FROM {source}"))
    with_ = f"WITH {steps}\n" if steps else ""
    return f"{with_}SELECT {', '.join(parts)} FROM {source}"


_ID = "strftime(issue_ts, '%Y%m%d%H') AS issue_id"


def statements() -> dict[str, str]:
    s = _statement
    cons = "product cell_id:int valid_date:day mm:6 n_issues:int n_wet:int"
    export = [f"2024-01-{d:02d}" for d in range(1, 16)]
    wide = [p.replace(" ", "_").replace("-", "_") for p in v.PRIORITIES]
    return {
        # issues and dates
        "issue_calendar": s("issue_id issue_ts:time", """(SELECT strftime(ts, '%Y%m%d%H')
          AS issue_id, ts AS issue_ts FROM (SELECT d + to_hours(h) AS ts FROM (
            SELECT unnest(generate_series(min(l_shipdate), max(l_shipdate), INTERVAL 5 DAY)) AS d
            FROM lineitem), (VALUES (0), (6), (12), (18)) x(h)))"""),
        "manifest_present": s("issue_id", "expected WHERE issue_id IN (SELECT issue_id FROM issues)"),
        "manifest_missing": s(
            "issue_id", "expected WHERE issue_id NOT IN (SELECT issue_id FROM issues)"
        ),
        "manifest_slice": s("issue_id issue_ts:time", """(SELECT *, row_number() OVER (
          ORDER BY issue_id) AS r FROM expected) WHERE r BETWEEN 5 AND 60"""),
        "manifest_urls": s("page_id pos:int link hour url", """(SELECT *,
          'http://nomads.ncep.noaa.gov/pub/data/nccf/com/cfs/prod/cfs/' || substr(link, 1, 12)
          || '/' || hour || '/time_grib_01/prate.01.' || substr(link, 5, 8) || hour
          || '.daily.grb2' AS url
          FROM links, (VALUES ('00'), ('06'), ('12'), ('18')) x(hour) WHERE pos > 0)"""),
        "extract_links": s("page_id pos:int link", "links"),
        "url_basename": s("page_id base", """(SELECT page_id,
          regexp_extract(url, '([^/]*)$', 1) AS base FROM pages)"""),
        "issue_ordinal": s("issue_id issue_ts:time ordinal:int", """(SELECT *,
          row_number() OVER (ORDER BY issue_ts) AS ordinal FROM issues)"""),
        "issue_gap_report": s("issue_date:day offset:int n_issues:int n_missing:int", """(
          SELECT d AS issue_date, date_diff('day', (SELECT min(issue_ts) FROM issues), d) AS
          "offset", count(issue_ts) AS n_issues, 4 - count(issue_ts) AS n_missing
          FROM (SELECT unnest(generate_series(date_trunc('day', min(issue_ts)),
            date_trunc('day', max(issue_ts)), INTERVAL 1 DAY)) AS d FROM issues)
          LEFT JOIN issues ON date_trunc('day', issue_ts) = d GROUP BY d)"""),
        "parse_issue": s("o_orderkey issue_ts:time from_ymd:day from_mdy:day", """(
          SELECT o_orderkey, o_orderdate AS issue_ts, o_orderdate AS from_ymd,
          o_orderdate AS from_mdy FROM orders)"""),
        "issue_parts": s("issue_id year month day_hour column_name", """(SELECT issue_id,
          substr(issue_id, 1, 4) AS year, substr(issue_id, 5, 2) AS month,
          substr(issue_id, 7, 4) AS day_hour, strftime(issue_ts, '%Y_%m_%d%H') AS column_name
          FROM issues)"""),
        "parse_units": s("units base_ts:time", """(SELECT 'hours since '
          || strftime(issue_ts, '%Y-%m-%d %H:%M:%S') AS units, issue_ts AS base_ts FROM issues)"""),
        "valid_time": s("issue_id step:int valid_ts:time valid_date:day", f"""(SELECT {_ID}, step,
          ts AS valid_ts, ts AS valid_date FROM (SELECT DISTINCT issue_ts, step,
          issue_ts + to_hours(6 * step - 18) AS ts FROM fc6h))"""),
        "placement_rule": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'reforecast' AS product, {_ID}, cell_id, mm, valid_date
          + (CASE WHEN hour(issue_ts) = 18 THEN 0 ELSE -1 END)
          - CAST(date_diff('day', CAST(issue_ts AS DATE),
              CAST(issue_ts - INTERVAL 12 HOUR AS DATE)) AS INTEGER) AS valid_date
          FROM daily_reforecast)"""),
        "day_axis": s("product first_day:day last_day:day n_days:int", """(
          SELECT 'operational' AS product, min(valid_date) AS first_day,
          max(valid_date) AS last_day, max(valid_date) - min(valid_date) + 1 AS n_days
          FROM daily_operational
          UNION ALL SELECT 'issue list', f, f + n - 1, n FROM (
            SELECT CAST(min(issue_ts) AS DATE) - 1 AS f, CAST(round(
            date_diff('second', min(issue_ts), max(issue_ts)) / 86400) AS INTEGER) + 500 AS n
            FROM issues))"""),
        "day_spine": s("product valid_date:day", """(SELECT 'operational' AS product,
          unnest(generate_series(min(valid_date) - 1, max(valid_date), INTERVAL 1 DAY))
          AS valid_date FROM daily_operational)"""),
        "name_norm": s("location dots back", """(SELECT location,
          replace(location, ' ', '.') AS dots, location AS back FROM stations)"""),
        # grid to days
        "scan_forecast": s("issue_id step:int lat:6 lon:6 prate:12", f"""(SELECT {_ID}, * FROM fc6h
          WHERE lat_idx = 2 AND lon_idx = 4)"""),
        "bbox_crop": s("vec_id lon:6 lat:6", """places WHERE lon BETWEEN -74.5 AND -68
          AND lat BETWEEN -35.433 AND -31.653"""),
        "subgrid": s("issue_id step:int cell_id:int lat:6 lon:6", f"""(SELECT {_ID}, step, lat, lon,
          lat_idx - 1 + 3 * (lon_idx - 3) AS cell_id FROM fc6h
          WHERE lat_idx BETWEEN 2 AND 4 AND lon_idx BETWEEN 3 AND 5)"""),
        "rate_to_mm": s("issue_id cell_id:int step:int mm:6", f"""(SELECT {_ID}, *,
          prate * 6 * 3600 AS mm FROM fc6h)"""),
        "lon_signed": s("vec_id lon360:6 lon:6", """(SELECT vec_id, lon + 360 AS lon360, lon
          FROM places)"""),
        "daily_sum": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'operational' AS product, {_ID}, * FROM daily_operational)"""),
        "brick_long": s("product cell_id:int issue_column valid_date:day day_index:int mm:6", """(
          SELECT 'operational' AS product, *, strftime(issue_ts, '%Y_%m_%d%H') AS issue_column,
          valid_date - (SELECT min(valid_date) FROM daily_operational) + 1 AS day_index
          FROM daily_operational)"""),
        "issue_length_stats": s("product min_days:int max_days:int n_issues:int", """(
          SELECT 'operational' AS product, min(n) AS min_days, max(n) AS max_days,
          count(*) AS n_issues FROM (SELECT issue_ts, count(DISTINCT valid_date) AS n
          FROM daily_operational GROUP BY issue_ts))"""),
        "wet_days": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'operational' AS product, {_ID}, * FROM daily_operational WHERE mm > 0.5)"""),
        "climatology_pool": s("cell_id:int month:int mm:6", "pool"),
        "climatology_stats": s("cell_id:int month:int n:int mean:6 mean_log:6 max_mm:6", """(
          SELECT *, g AS mean_log FROM pool_stats)"""),
        # consensus
        "last_n_issues": s("product issue_id cell_id:int valid_date:day mm:6 rank:int", f"""(
          SELECT 'operational' AS product, {_ID}, * FROM last_operational)"""),
        "consensus_reforecast": s(cons, "consensus_reforecast"),
        "consensus_operational": s(cons, "consensus_operational"),
        "consensus_realtime": s(cons, "consensus_realtime"),
        "realtime_rerun": s(cons, "consensus_rerun"),
        "daily_with_nan": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'operational' AS product, {_ID}, cell_id, valid_date,
          CASE WHEN count(rate) = count(*) THEN sum(rate * 21600.0) END AS mm FROM (
            SELECT *, CAST(issue_ts + to_hours(6 * step - 18) AS DATE) AS valid_date,
            CASE WHEN step NOT IN (7, 11) THEN prate END AS rate FROM fc6h) GROUP BY ALL)"""),
        "union_products": s(cons, """(SELECT * FROM consensus_reforecast UNION ALL
          SELECT * FROM consensus_operational UNION ALL SELECT * FROM consensus_realtime)"""),
        # observations and stations
        "obs_range": s("location obs_date:day mm:6", f"""obs_hist
          WHERE obs_date BETWEEN DATE '{v.OBS_RANGE[0]}' AND DATE '{v.OBS_RANGE[1]}'"""),
        "obs_month_wet": s("location obs_date:day mm:6 month:int", """(SELECT *,
          month(obs_date) AS month FROM obs_recent WHERE mm > 0)"""),
        "clamp_obs": s("location obs_date:day mm:6", """(SELECT location, obs_date,
          CASE WHEN mm < 10 THEN 0 ELSE mm END AS mm FROM obs_hist)"""),
        "max_obs": s("location month:int max_mm:6", """(SELECT location, month, max(mm) AS max_mm
          FROM wet GROUP BY ALL)"""),
        "obs_pivot": s("obs_date:day " + " ".join(f"{c}:6" for c in wide), "(SELECT obs_date, "
          + ", ".join(f"max(mm) FILTER (location = '{p}') AS \"{c}\""
                      for p, c in zip(v.PRIORITIES, wide))
          + " FROM obs_priority GROUP BY obs_date)"),
        "obs_unpivot": s("obs_date:day location mm:6", """(SELECT d.obs_date, l.location, mm FROM
          (SELECT DISTINCT obs_date FROM obs_priority) d CROSS JOIN
          (SELECT DISTINCT location FROM obs_priority) l LEFT JOIN obs_priority o
          ON o.obs_date = d.obs_date AND o.location = l.location)"""),
        "station_lookup": s("location lat:6 lon:6",
                            "stations WHERE location = 'Supplier 000000007'"),
        "nearest_cell": s("location cell_id:int distance:6", "near_many"),
        "nearest_cell_tree": s("location cell_id:int distance:6", "near_many"),
        "station_forecast": s("location cell_id:int valid_date:day mm:6", "series_operational"),
        # fits and correction
        "gamma_fit": s("location month:int n:int shape:6 scale:6", "obs_free"),
        "gamma_fit_bounded": s("location month:int n:int shape:6 scale:6",
                               f"({_bounded_fit('obs_free', 'location, month', 3.3)})"),
        "gamma_fit_merged": s("location month:int n:int shape:6 scale:6",
                              f"({_bounded_fit('obs_free', 'location, month', 3.3)})"),
        "model_fit_merged": s("cell_id:int month:int n:int shape:6 scale:6", "model_fit"),
        "params_table": s("location month:int n:int shape:6 scale:6 source", "both_fits"),
        "cdf_curve": s("location month:int source i:int x:6 f:6", f"""(SELECT *,
          {_cdf('x', 'shape', 'scale')} AS f FROM (SELECT *, i * 0.1 AS x FROM (
            SELECT b.*, unnest(range(0, CAST(floor(max_mm / 0.1 + 1e-10) AS BIGINT) + 1)) AS i
            FROM both_fits b JOIN (SELECT location, month, max(mm) AS max_mm FROM wet
            GROUP BY ALL) USING (location, month))))"""),
        "gamma_cdf": s("location obs_date:day mm:6 f:6", f"""(SELECT *,
          {_cdf('mm', 'shape', 'scale')} AS f FROM wet JOIN obs_free USING (location, month))"""),
        "gamma_quantile": s("location month:int p:6 mm:4", "(SELECT *, p0 AS p, x AS mm FROM ("
          + _quantile("(SELECT * FROM obs_free, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), "
                      "(0.9::DOUBLE)) t(p0))", "location, month, p0", "p0") + "))"),
        "gamma_sample": s("month:int draw:int mm:4", "(SELECT month, draw, x AS mm FROM drawn)"),
        "quantile_map_free": s("location valid_date:day mm:6 mm_corrected:4", "corrected_free"),
        "quantile_map": s("location valid_date:day mm:6 mm_corrected:4", "corrected_realtime"),
        "valid_days": s("valid_date:day", "(SELECT DISTINCT valid_date FROM series_realtime)"),
        "forecast_export": s(
            "location " + " ".join(f"{d}:4" for d in export) + " lat:6 lon:6 alt:6",
            "(SELECT location, lat, lon, alt, " + ", ".join(
                f"max(mm_corrected) FILTER (valid_date = DATE '{d}') AS \"{d}\"" for d in export)
            + " FROM corrected_realtime JOIN stations USING (location) GROUP BY ALL)"),
        # verification
        "compare_outer": s("location valid_date:day forecast:6 observed:6", """(
          SELECT coalesce(f.location, o.location) AS location,
          coalesce(f.valid_date, o.obs_date) AS valid_date, f.mm AS forecast, o.mm AS observed
          FROM series_realtime f FULL JOIN obs_recent o
          ON f.location = o.location AND f.valid_date = o.obs_date)"""),
        "verify_pairs": s("location valid_date:day operational:4 registro:6",
                          "(SELECT *, mm_corrected AS operational FROM pairs)"),
        "contingency": s("location month:int n_hit:int n_miss:int n_fa:int n_cn:int n_excluded:int",
                         "score_table"),
        "skill_scores": s("location month:int accuracy:6 bias_score:6 hit_rate:6 fa_ratio:6 fa_rate:6 "
                          "success_ratio:6", """(SELECT location, month,
          (n_hit + n_cn) / nullif(n_hit + n_miss + n_fa + n_cn, 0) AS accuracy,
          (n_hit + n_fa) / nullif(n_hit + n_miss, 0) AS bias_score,
          n_hit / nullif(n_hit + n_miss, 0) AS hit_rate,
          n_fa / nullif(n_hit + n_fa, 0) AS fa_ratio,
          n_fa / nullif(n_cn + n_fa, 0) AS fa_rate,
          n_hit / nullif(n_hit + n_fa, 0) AS success_ratio FROM score_table)"""),
        "continuous_scores": s("location month:int me:4 rmse:4 mae:4 mpe:2 mape:2", """(SELECT
          location, month(valid_date) AS month,
          avg(e) AS me, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
          avg(100 * e / nullif(registro, 0)) AS mpe, avg(abs(100 * e / nullif(registro, 0))) AS mape
          FROM (SELECT *, registro - mm_corrected AS e FROM pairs) GROUP BY location, month)"""),
        "sample_ecdf": s("sample month:int mm:4 f:6", """(SELECT DISTINCT sample, month, mm,
          cume_dist() OVER (PARTITION BY sample, month ORDER BY mm) AS f FROM (
            SELECT 'observed' AS sample, month(obs_date) AS month, mm FROM obs_recent WHERE mm > 0
            UNION ALL SELECT 'drawn', month, x FROM drawn))"""),
        "ecdf": s("location mm:6 f:6", """(SELECT DISTINCT location, mm, cume_dist() OVER (
          PARTITION BY location ORDER BY mm) AS f FROM obs_hist)"""),
        # grid
        "ecdf_sketch": s("location share:6 n:int within", """(SELECT location, d / 10.0 AS share,
          count(*) AS n, true AS within FROM obs_hist, range(1, 10) t(d) GROUP BY location, d)"""),
        "regular_grid": s("ix:int iy:int x:6 y:6", "points"),
        "basin_mask": s("ix:int iy:int", "inside"),
        "basin_holes": s("ix:int iy:int", "inside_holed"),
        "points_in_basins": s("vec_id basin", "places_in"),
        "grid_in_basins": s("ix:int iy:int", "inside_holed"),
        "stations_by_basin": s("basin n_stations:int n_wet:int mm:6", """(SELECT basin,
          count(DISTINCT location) AS n_stations, count(*) AS n_wet, sum(mm) AS mm
          FROM stations_in JOIN wet USING (location) GROUP BY basin)"""),
        "idw_grid": s("valid_date:day x:6 y:6 mm:6",
                      "(SELECT * FROM interpolated JOIN points USING (ix, iy))"),
        "value_bins": s("location obs_date:day mm:6 class:int", """(SELECT *,
          CASE WHEN mm BETWEEN 2 AND 35 THEN least(floor(mm - 2) + 1, 33) END AS class
          FROM obs_recent)"""),
        # files
        "issue_list_file": s("issue_id product url", """(SELECT issue_id,
          'operational' AS product, CAST(NULL AS VARCHAR) AS url FROM issues)"""),
        "forecast_axes": s("issue_id units lat_idx:int lat:6 lon_idx:int lon:6", f"""(
          SELECT DISTINCT {_ID}, 'hours since ' || strftime(issue_ts, '%Y-%m-%d %H:%M:%S') AS units,
          lat_idx, lat, lon_idx, lon FROM fc6h)"""),
        "forecast_variable": s("issue_id lat_idx:int lon_idx:int step:int prate:12",
                               f"(SELECT {_ID}, lat_idx, lon_idx, step, prate FROM fc6h)"),
        "wide_csv": s("location obs_date:day mm:6", """(SELECT d.obs_date, l.location, mm FROM
          (SELECT DISTINCT obs_date FROM obs_priority) d CROSS JOIN
          (SELECT DISTINCT location FROM obs_priority) l LEFT JOIN obs_priority o
          ON o.obs_date = d.obs_date AND o.location = l.location)"""),
        "station_csv": s("location lat:6 lon:6 alt:6 full", """(SELECT replace(s_name, '#', ' ')
          AS location, lat, lon, s_acctbal AS alt, n_name AS "full" FROM supplier
          JOIN places ON s_suppkey = vec_id JOIN nation ON s_nationkey = n_nationkey)"""),
        "cell_csv": s("cell_id:int lat:6 lon:6",
                      f"(SELECT vec_id + 1 AS cell_id, lat, lon FROM ({_located(3)}))"),
        "single_station_csv": s("location obs_date:day mm:6",
                                f"obs_hist WHERE location = '{v.STATION}'"),
        "stage_replaced": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'operational' AS product, {_ID}, * FROM daily_operational)"""),
        "stage_added": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'operational' AS product, {_ID}, * FROM daily_operational)"""),
        "forecast_added": s("issue_id lat_idx:int lon_idx:int step:int prate:12",
                            f"(SELECT {_ID}, lat_idx, lon_idx, step, prate FROM fc6h)"),
        "listed_issues": s("issue_id issue_ts:time", "issues"),
        "polygon_rings": s("source name i:int n:int west:6 north:6", """(SELECT source,
          CAST(label AS VARCHAR) AS name, i, count(*) AS n, min(x1) AS west, max(y1) AS north
          FROM holed_edges, (VALUES ('geojson'), ('rows')) x(source) GROUP BY ALL)"""),
        "daily_grid_files": s("valid_date:day x:6 y:6 mm:6", """(SELECT obs_date AS valid_date,
          lon AS x, lat AS y, mm FROM obs_recent JOIN stations USING (location))"""),
        # streams
        "stream_within": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'operational' AS product, {_ID}, * FROM daily_operational)"""),
        "stream_daily": s("product issue_id cell_id:int valid_date:day mm:6", f"""(
          SELECT 'operational' AS product, {_ID}, * FROM daily_operational)"""),
        "stream_consensus": s(cons, "consensus_operational"),
        "stream_votes": s(cons, "(SELECT 'operational' AS product, * FROM vote_operational)"),
        "stream_alarms": s("issue_id status due:time late_seconds:int", "alarms WHERE status IS NOT NULL"),
        "overdue_issues": s("issue_id status due:time late_seconds:int", "alarms WHERE status IS NOT NULL"),
    }
