"""Timestamp resolution against hand-made cases and an independent brute force over all minutes."""

import datetime as dt
import zoneinfo

import pytest
from pyspark.sql import functions as F

from strandweave.operators.moments import minute_text, resolve_minutes

FEEDS = [("eu", "Europe/Berlin"), ("ny", "America/New_York"), ("utc", "UTC"), ("none", None), ("in", "Asia/Kolkata"), ("au", "Australia/Sydney"), ("br", "America/Sao_Paulo")]
CASES = [
    # date, timestamp, feed, expected
    ("202307010821", "2023-07-01 08:21", "br", "2023-07-01T11:21Z"),
    ("20230701", "2023/07/01 20:38", "eu", "2023-07-01T18:38Z"),
    (None, "1688260620342", "none", "2023-07-02T01:17Z"),
    (None, "1720088003", "eu", "2024-07-04T10:13Z"),
    (None, "1709816611413259", "ny", "2024-03-07T13:03Z"),
    ("2024-06-12T18:16:28Z", "12 June 2024, 20:16", "none", "2024-06-12T18:16Z"),
    (None, "Sun, 02 Jul 2023 01:38:32 -0400", "eu", "2023-07-02T05:38Z"),
    (None, "2023-07-02T13:27:20+09:00[Asia/Tokyo]", "ny", "2023-07-02T04:27Z"),
    (None, "2023-07-24 09:49:31 America/Sao_Paulo", "utc", "2023-07-24T12:49Z"),
    (None, "2023-07-02T08:47+00", "ny", "2023-07-02T08:47Z"),
    (None, "20240906T020943Z", "in", "2024-09-06T02:09Z"),
    (None, "2024年6月15日 12:49", "utc", "2024-06-15T12:49Z"),
    (None, "Apr 19, 2024 7:32 PM", "ny", "2024-04-19T23:32Z"),
    (None, "12.07.2023 09:16", "eu", "2023-07-12T07:16Z"),
    # repeated hour: open, unless something settles it
    ("202310290230", "2023-10-29 02:30", "eu", None),
    ("202310290230", "2023-10-29 02:30 CEST", "eu", "2023-10-29T00:30Z"),
    ("202310290230", "2023-10-29T02:30:00+01:00", "eu", "2023-10-29T01:30Z"),
    ("202311050130", None, "ny", None),
    ("202311050130", "1699165800", "ny", "2023-11-05T06:30Z"),
    # skipped hour: no moment
    ("202403310230", "2024-03-31 02:30", "eu", None),
    # day or month first: settled by the other field only
    (None, "06/04/2024 10:32", "br", None),
    ("20240406", "06/04/2024 10:32", "br", "2024-04-06T13:32Z"),
    ("202404061032", "06/04/2024 10:32", "br", "2024-04-06T13:32Z"),
    (None, "31/03/2024 13:04", "br", "2024-03-31T16:04Z"),
    (None, "05/05/2024 10:00", "br", "2024-05-05T13:00Z"),
    # no zone, no minute, nonsense, contradiction
    ("202307012154", "2023-07-01 21:54:10", "none", None),
    ("2023112604", "2023-11-26", "eu", None),
    ("20240101xx30", "pending", "eu", None),
    ("20241345", "0000-00-00 00:00:00", "eu", None),
    ("202402301200", None, "eu", None),
    (None, None, "eu", None),
    ("", "", "eu", None),
    (" 202402111738", "Sun, 11 Feb 2024 17:38:16 GMT", "utc", "2024-02-11T17:38Z"),
    ("202401010000", "2024-01-01 05:00", "eu", None),
    ("202401010000", None, "unheard of", None),
    (None, "2024-01-01 10:00 IST", "in", "2024-01-01T04:30Z"),
    (None, "2024-01-01 10:00 XYZ", "eu", None),
]


@pytest.fixture(scope="module")
def feeds(spark):
    return spark.createDataFrame(FEEDS, "feed string, home_zone string")


def test_cases(spark, feeds):
    rows = spark.createDataFrame([(i, d, t, f) for i, (d, t, f, _) in enumerate(CASES)], "id int, date string, timestamp string, feed string")
    got = {r["id"]: r["m"] for r in resolve_minutes(rows, feeds).select("id", F.when(F.col("utc_min").isNotNull(), minute_text(F.col("utc_min"))).alias("m")).collect()}
    assert {CASES[i][:3]: got[i] for i in got} == {c[:3]: c[3] for c in CASES}


def test_wall_clocks_around_changes_match_brute_force(spark, feeds):
    """Every half hour around two clock changes: the instants that show a wall clock, found by trying all."""
    rows, want = [], {}
    for feed, zone in FEEDS:
        if zone is None:
            continue
        z = zoneinfo.ZoneInfo(zone)
        for day in (dt.date(2024, 3, 10), dt.date(2024, 3, 31), dt.date(2024, 10, 6), dt.date(2024, 10, 27), dt.date(2024, 11, 3), dt.date(2024, 4, 7)):
            for half in range(0, 12):
                wall = dt.datetime(day.year, day.month, day.day) + dt.timedelta(minutes=30 * half)
                shown = []
                for m in range(-15 * 60, 15 * 60, 30):
                    u = (wall + dt.timedelta(minutes=m)).replace(tzinfo=dt.UTC)
                    if u.astimezone(z).replace(tzinfo=None) == wall:
                        shown.append(u)
                i = len(rows)
                rows.append((i, wall.strftime("%Y%m%d%H%M"), None, feed))
                want[i] = shown[0].strftime("%Y-%m-%dT%H:%MZ") if len(shown) == 1 else None
    df = spark.createDataFrame(rows, "id int, date string, timestamp string, feed string")
    got = {r["id"]: r["m"] for r in resolve_minutes(df, feeds).select("id", F.when(F.col("utc_min").isNotNull(), minute_text(F.col("utc_min"))).alias("m")).collect()}
    assert got == want


def test_empty_repeated_and_extra_columns(spark, feeds):
    empty = spark.createDataFrame([], "date string, timestamp string, feed string, utc int")
    assert resolve_minutes(empty, feeds).count() == 0
    twice = spark.createDataFrame([("202307010821", None, "br", "x", 1)] * 2, "date string, timestamp string, feed string, _home string, _p4t_k int")
    got = resolve_minutes(twice, feeds)
    assert got.columns == ["date", "timestamp", "feed", "_home", "_p4t_k", "utc_min"]
    assert resolve_minutes(got, feeds).columns == got.columns
    assert [r["utc_min"] for r in got.collect()] == [28136841] * 2
