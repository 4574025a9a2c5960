"""Timestamps against Python's own zone database."""

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from tradeloom.functions.clock import normalise_timestamps

ZONES = [("a", "UTC", "YMD"), ("b", "Europe/Berlin", "DMY"), ("c", "America/New_York", "MDY"), ("h", "Europe/London", "DMY")]


def us(*a, tz=timezone.utc):
    return (datetime(*a, tzinfo=tz) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


CASES = [
    ("a", "1641083933166", 1641083933166000), ("a", "1641083933", 1641083933000000), ("a", "1641083933.25", 1641083933250000), ("a", "1640997931783000", 1640997931783000),
    ("a", "1641239106000000999", 1641239106000000), ("a", "99999999999", None), ("c", "20220103010431", us(2022, 1, 3, 1, 4, 31, tz=ZoneInfo("America/New_York"))), ("a", "20220102T012739.5Z", us(2022, 1, 2, 1, 27, 39, 500000)),
    ("b", "2022-07-01 10:00:00,123456789", us(2022, 7, 1, 8, 0, 0, 123456)), ("b", "03/04/2024 05:06:07", us(2024, 4, 3, 3, 6, 7)), ("c", "03/14/2024 5:06:07.5 PM", us(2024, 3, 14, 21, 6, 7, 500000)),
    ("c", "12/01/2024 12:00:00 AM", us(2024, 12, 1, 5)), ("b", "14/03/2024 13:00:00 PM", None), ("b", "31.12.2024 23:59:59", us(2024, 12, 31, 22, 59, 59)), ("c", "14.03.2024 01:00:00", None),
    ("a", "Fri, 08 Sep 2023 20:48:51 +0000", us(2023, 9, 8, 20, 48, 51)), ("b", "01-Jan-2025 00:23:30.523 +05:45", us(2024, 12, 31, 18, 38, 30, 523000)), ("h", "Sun, 01 Dec 2024 09:12:19 GMT", us(2024, 12, 1, 9, 12, 19)),
    ("c", "2022-07-01 10:00:00 EDT", us(2022, 7, 1, 14)), ("c", "2022-11-06 01:30:00 EST", us(2022, 11, 6, 6, 30)), ("h", "2022-07-01 10:00:00 BST", us(2022, 7, 1, 9)), ("b", "2022-07-01 10:00:00 EDT", None),
    ("a", "2022-07-01T10:00:00 America/New_York", us(2022, 7, 1, 14)), ("a", "2022-07-01T10:00:00[Europe/Berlin]", us(2022, 7, 1, 8)), ("a", "2022-07-01T10:00:00 Nowhere/City", None), ("a", "2022-07-01T10:00:00-0330", us(2022, 7, 1, 13, 30)),
    ("c", "2022-11-06 01:30:00", None), ("c", "2022-03-13 02:30:00", None), ("b", "2022-10-30 02:30:00", None), ("b", "2022-10-30 03:30:00", us(2022, 10, 30, 2, 30)), ("a", "2022-02-30 00:00:00", None), ("a", "2022-13-01T00:00:00Z", None),
    ("a", "2022-01-01T25:00:00Z", None), ("a", "2022-01-01T10:61:00Z", None), ("a", "2022-01-03T12:", None), ("a", "2022-01-03", None), ("a", "12:30", None), ("a", "", None), ("a", None, None), ("a", "null", None), ("zz", "2022-01-01 00:00:00", None),
    ("zz", "2022-01-01 00:00:00Z", us(2022, 1, 1)), ("a", "0000-00-00 00:00:00", None), ("a", "9" * 5000, None), (None, "1641083933166", 1641083933166000),
]


def test_cases(spark):
    df = spark.createDataFrame([(i, f, t, 5) for i, (f, t, _) in enumerate(CASES)], "n int, feed string, trade_timestamp string, tz_name int")
    z = spark.createDataFrame(ZONES, "feed string, tz_name string, date_order string")
    got = {r["n"]: r["utc_us"] for r in normalise_timestamps(df, z).collect()}
    assert [(CASES[i], got[i]) for i in got if got[i] != CASES[i][2]] == []
    assert len(got) == len(CASES)


@pytest.mark.parametrize(("policy", "want"), [("earlier", us(2022, 11, 6, 5, 30)), ("later", us(2022, 11, 6, 6, 30))])
def test_policies(spark, policy, want):
    df = spark.createDataFrame([("c", "2022-11-06 01:30:00"), ("c", "2022-03-13 02:30:00")], "feed string, trade_timestamp string")
    z = spark.createDataFrame(ZONES, "feed string, tz_name string, date_order string")
    got = {r[1]: r[2] for r in normalise_timestamps(df, z, ambiguous=policy, nonexistent="shift").collect()}
    assert got == {"2022-11-06 01:30:00": want, "2022-03-13 02:30:00": us(2022, 3, 13, 7, 30)}


def test_no_rows_no_zones(spark):
    df = spark.createDataFrame([], "feed string, trade_timestamp string")
    z = spark.createDataFrame([], "feed string, tz_name string, date_order string")
    assert normalise_timestamps(df, z).count() == 0
