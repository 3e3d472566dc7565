import datetime as dt

from pyspark.sql import functions as F

from pluvia.functions import dates, text, units


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ts(text_):
    return F.lit(text_).cast("timestamp_ntz")


def test_shift_moves_the_first_steps_to_the_day_before(spark):
    base = ts("2012-07-10 00:00:00")
    row = one(
        spark,
        first=dates.valid_date(base, F.lit(0), 18),
        third=dates.valid_date(base, F.lit(3), 18),
        at=dates.valid_ts(base, F.lit(1), 18),
    )
    assert row.first == dt.date(2012, 7, 9)
    assert row.third == dt.date(2012, 7, 10)
    assert row.at == dt.datetime(2012, 7, 9, 12)


def test_session_zone_has_no_part(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
    try:
        base = dates.parse_units(F.lit("hours since 2012-09-02 00:00:00"))
        row = one(
            spark, base=base, day=dates.valid_date(base, F.lit(2), 12),
            id=dates.issue_id(base), back=dates.parse_issue(F.lit("2012090200")),
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.base == row.back == dt.datetime(2012, 9, 2)
    assert row.day == dt.date(2012, 9, 2)
    assert row.id == "2012090200"


def test_units_without_seconds(spark):
    row = one(spark, base=dates.parse_units(F.lit("hours since 1994-1-6 18:00")))
    assert row.base == dt.datetime(1994, 1, 6, 18)


def test_issue_parts(spark):
    row = one(spark, **dates.issue_parts(F.lit("2011040106")))
    assert tuple(row) == ("2011", "04", "0106", "2011_04_0106")


def test_issue_hour_placement(spark):
    for hour, start in (("00", 9), ("06", 9), ("12", 9), ("18", 10)):
        issue = ts(f"2000-01-10 {hour}:00:00")
        first = dates.valid_date(issue, F.lit(0), 12)
        row = one(
            spark,
            first=dates.issue_hour_date(issue, issue, first, 12),
            later=dates.issue_hour_date(issue, issue, F.date_add(first, 40), 12),
        )
        assert row.first == dt.date(2000, 1, start)
        assert row.later - row.first == dt.timedelta(days=40)


def test_calendar(spark):
    rows = dates.issue_calendar(spark, dt.date(1994, 1, 1), dt.date(1994, 1, 14)).collect()
    assert [r.issue_id for r in rows[:5]] == [
        "1994010100", "1994010106", "1994010112", "1994010118", "1994010600"
    ]
    assert len(rows) == 12 and rows[-1].issue_ts == dt.datetime(1994, 1, 11, 18)


def test_days_between_rounds(spark):
    row = one(spark, n=dates.days_between(ts("2000-01-01 00:00:00"), ts("2000-01-03 18:00:00")))
    assert row.n == 3


def test_text(spark):
    html = '<a href="../">Up</a> <a href="cfs.20170601/">x</a>'
    url = text.realtime_url(F.lit("cfs.20170601/"), F.lit("06"), base="http://host/")
    row = one(
        spark, links=text.links(F.lit(html)), url=url, base=text.basename(url),
        issue=text.issue_of_url(url), dots=text.dotted(F.lit("QUINTA NORMAL SANTIAGO")),
        back=text.spaced(F.lit("QUINTA.NORMAL")),
    )
    assert row.links == ["../", "cfs.20170601/"]
    assert row.url == (
        "http://host/cfs.20170601/06/time_grib_01/prate.01.2017060106.daily.grb2"
    )
    assert row.base == "prate.01.2017060106.daily.grb2" and row.issue == "2017060106"
    assert row.dots == "QUINTA.NORMAL.SANTIAGO" and row.back == "QUINTA NORMAL"


def test_units(spark):
    assert units.round_step(2, 35, 25) == 1.0
    assert units.round_step(0, 10, 5) == 2.0
    assert units.round_step(0, 1, 3) == 0.5
    values = [1.9, 2.0, 2.99, 3.0, 34.5, 35.0, 35.1, None]
    df = spark.createDataFrame([(v,) for v in values], "mm double")
    got = [r.c for r in df.select(units.value_class(F.col("mm")).alias("c")).collect()]
    assert got == [None, 1, 1, 2, 33, 33, None, None]
    row = one(
        spark, west=units.signed_longitude(F.lit(286.09)),
        east=units.signed_longitude(F.lit(12.0)), mm=units.rate_to_mm(F.lit(0.001)),
        low=units.clamp(F.lit(0.4), 0.5), same=units.clamp(F.lit(0.5), 0.5),
    )
    assert abs(row.west + 73.91) < 1e-9 and row.east == 12.0
    assert abs(row.mm - 21.6) < 1e-12 and (row.low, row.same) == (0.0, 0.5)
