import datetime as dt

from dealweave.operators.instants import to_instants

SOURCES = [("us", "America/New_York", False), ("uk", "Europe/London", True), ("none", None, True), ("bad", "Not/AZone", True), ("us", "America/New_York", False), (None, "UTC", True)]


def us(*a, off=0):
    return int((dt.datetime(*a) - dt.datetime(1970, 1, 1)) / dt.timedelta(microseconds=1)) - off * 3_600_000_000


CASES = [
    ("2021-03-14 02:30:00", "us", us(2021, 3, 14, 3, 30, off=-4)),  # skipped: an hour later
    ("2021-11-07T01:30", "us", us(2021, 11, 7, 1, 30, off=-4)),  # twice: the first
    ("2021-11-07 01:30 EST", "us", us(2021, 11, 7, 1, 30, off=-5)),
    ("03/04/2021 5:06 PM", "us", us(2021, 3, 4, 17, 6, off=-5)),
    ("03/04/2021 17:06", "uk", us(2021, 4, 3, 17, 6, off=1)),
    ("12:30 AM", "us", None),
    ("March 4, 2021 12:05 AM", "us", us(2021, 3, 4, 0, 5, off=-5)),
    ("4 Mar 2021, 09:00", "uk", us(2021, 3, 4, 9)),
    ("04-Mar-21 09:00", "uk", us(2021, 3, 4, 9)),
    ("4.3.2021, 09:00 Uhr", "uk", us(2021, 3, 4, 9)),
    ("2021-07-01", "uk", us(2021, 7, 1, off=1)),
    ("2021-07-01T10:00:00.1234567Z", "us", us(2021, 7, 1, 10) + 123456),
    ("2021-07-01 10:00:00[Europe/Berlin]", "us", us(2021, 7, 1, 10, off=2)),
    ("2021-07-01T10:00:00+0530", "us", us(2021, 7, 1, 10) - int(5.5 * 3_600_000_000)),
    ("Thu, 01 Jul 2021 10:00:00 GMT", "us", us(2021, 7, 1, 10)),
    ("20210701T100000Z", "us", us(2021, 7, 1, 10)),
    ("1625133600", "us", 1625133600_000_000),
    ("1625133600123", "us", 1625133600_123_000),
    ("  2021-07-01 10:00 ", "uk", us(2021, 7, 1, 10, off=1)),
    ("2021-02-30", "us", None),
    ("31/06/2021 10:00", "uk", None),
    ("2021-01-01 25:00", "us", None),
    ("2021-01-01 10:60", "us", None),
    ("13:00 PM", "us", None),
    ("01/02/2021 13:00 PM", "us", None),
    ("0000-00-00 00:00:00", "us", None),
    ("yesterday", "us", None),
    ("", "us", None),
    (None, "us", None),
    ("2021-01-01 10:00", "none", None),
    ("2021-01-01 10:00", "bad", None),
    ("2021-01-01 10:00", "unheard of", None),
    ("2021-01-01 10:00", None, None),
    ("2021-01-01 10:00Z", None, us(2021, 1, 1, 10)),
    ("2021-01-01 10:00 Europe/Nowhere", "us", None),
    ("x" * 50_000, "us", None),
]


def test_cases(spark):
    rows = spark.createDataFrame([(i, t, s, "k", 1) for i, (t, s, _) in enumerate(CASES)] + [(0, *CASES[0][:2], "k", 1)], "id long, t string, s string, epoch_us string, _x int")
    sources = spark.createDataFrame(SOURCES, "s string, home_zone string, day_first boolean")
    got = to_instants(rows, sources, row_id="id", text="t", source="s").collect()
    assert len(got) == len(CASES) + 1
    by = {r.id: r.epoch_us for r in got}
    assert {CASES[i][:2]: x for i, x in by.items()} == {(t, s): x for t, s, x in CASES}


def test_other_session_zone_empty_tables_and_kept_columns(spark):
    sources = spark.createDataFrame(SOURCES, "s string, home_zone string, day_first boolean")
    rows = spark.createDataFrame([(1, "2021-07-01 10:00", "us", 5)], "id long, t string, s string, k int")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        got = to_instants(rows, sources, row_id="id", text="t", source="s", keep=["k"]).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert [tuple(r) for r in got] == [(1, 5, "iso", us(2021, 7, 1, 10, off=-4))]
    assert to_instants(rows.limit(0), sources, row_id="id", text="t", source="s").collect() == []
    assert to_instants(rows, sources.limit(0), row_id="id", text="t", source="s").collect()[0].epoch_us is None
