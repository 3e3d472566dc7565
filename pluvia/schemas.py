"""Schemas of the tables the operators read and write."""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_S, _D, _I, _L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
_DATE, _TS = T.DateType(), T.TimestampNTZType()

ISSUE_LIST = _schema(lista=_S)
MANIFEST = _schema(issue_id=_S, issue_ts=_TS, product=_S, url=_S)
INDEX_PAGE = _schema(url=_S, html=_S)
FORECAST_6H = _schema(
    product=_S, variable=_S, issue_ts=_TS, units=_S, lat_idx=_I, lon_idx=_I,
    lat=_D, lon=_D, step=_I, prate=_D,
)
# as stored by writers.forecast: the base time of ``units`` is parsed once, on the way in
FORECAST_STORED = T.StructType([*FORECAST_6H.fields, T.StructField("base_ts", _TS)])
FORECAST_DAILY = _schema(product=_S, issue_ts=_TS, cell_id=_I, valid_date=_DATE, mm=_D)
# as stored by writers.daily
FORECAST_DAILY_STORED = T.StructType([*FORECAST_DAILY.fields, T.StructField("issue_month", _S)])
# as stored by a stream: partial totals, in folders by day and by the part that brought them
DAILY_PARTS = _schema(
    product=_S, issue_ts=_TS, cell_id=_I, mm=_D, has_gap=T.BooleanType(), valid_date=_DATE, part=_S
)
CLIMATOLOGY = _schema(cell_id=_I, month=_I, mm=_D)
CONSENSUS = _schema(
    product=_S, cell_id=_I, valid_date=_DATE, mm=_D, n_issues=_L, n_wet=_L
)
STATION = _schema(location=_S, lat=_D, lon=_D, alt=_D, full=_S)
CELL = _schema(cell_id=_I, lat=_D, lon=_D)
OBS = _schema(location=_S, obs_date=_DATE, mm=_D)
GAMMA_PARAMS = _schema(
    location=_S, cell_id=_I, month=_I, source=_S, n=_L, shape=_D, scale=_D
)
CORRECTED = _schema(location=_S, valid_date=_DATE, mm=_D, mm_corrected=_D)
PAIRS = _schema(location=_S, valid_date=_DATE, operational=_D, registro=_D)
BASIN = T.StructType(
    [
        T.StructField("name", _S),  # rings of one name are its parts and holes
        T.StructField("ring", T.ArrayType(_schema(x=_D, y=_D))),
    ]
)
IDW_GRID = _schema(valid_date=_DATE, x=_D, y=_D, mm=_D)
