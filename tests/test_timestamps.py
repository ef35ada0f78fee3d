from datetime import UTC, datetime, timedelta
from zoneinfo import ZoneInfo

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemospark.operators.timestamps import normalise_moments


def run(spark, rows):
    df = spark.createDataFrame([(i, v, z, "x", "y") for i, (v, z) in enumerate(rows)], "id int, v string, z string, moment string, spans string")
    out = normalise_moments(df, "v", "z", ["id"]).withColumn("us", F.unix_micros("moment")).orderBy("id").collect()
    return [(r["moment_status"], None if r["us"] is None else datetime(1970, 1, 1) + timedelta(microseconds=r["us"])) for r in out]


def test_forms(spark):
    d = datetime
    cases = [
        ("5:19 pm on 23 May, 2023", "UTC", d(2023, 5, 23, 17, 19)), ("12:05 AM on 1 January, 2021", "UTC", d(2021, 1, 1, 0, 5)), ("2021/07/25 (Sun) 12:17", "Asia/Tokyo", d(2021, 7, 25, 3, 17)),
        ("2024-01-18T16:23:58Z", None, d(2024, 1, 18, 16, 23, 58)), ("29. September 2021, 12:01 Uhr", "Europe/Berlin", d(2021, 9, 29, 10, 1)), ("14. März 2021, 05:40 Uhr", "Europe/Berlin", d(2021, 3, 14, 4, 40)),
        ("7:59 am (UTC+05:45) on 12 July, 2022", None, d(2022, 7, 12, 2, 14)), ("2021-08-05 02:56 JST", None, d(2021, 8, 4, 17, 56)), ("3/9/2021 0:01", "UTC", d(2021, 3, 9, 0, 1)), ("07.03.2022 03:57", "UTC", d(2022, 3, 7, 3, 57)),
        ("03/14/2021 05:09 PM", "UTC", d(2021, 3, 14, 17, 9)), ("Sat, 29 Jun 2024 21:51:32 +0200", None, d(2024, 6, 29, 19, 51, 32)), ("2024-04-30 13:23:23 America/New_York", "Asia/Tokyo", d(2024, 4, 30, 17, 23, 23)),
        ("April 29, 2022, 10:01:27\u202fPM", "UTC", d(2022, 4, 29, 22, 1, 27)), ("1648667883", None, d(2022, 3, 30, 19, 18, 3)), ("1613028998577", None, d(2021, 2, 11, 7, 36, 38, 577000)), ("1613540696776324", None, d(2021, 2, 17, 5, 44, 56, 776324)),
        ("20210327T233812Z", None, d(2021, 3, 27, 23, 38, 12)), ("2021-07-22T17:00:27.25+10:00[Australia/Sydney]", None, d(2021, 7, 22, 7, 0, 27, 250000)), ("\xa02023-12-24T12:13:07  \n", "UTC", d(2023, 12, 24, 12, 13, 7)),
    ]
    assert run(spark, [c[:2] for c in cases]) == [("moment", c[2]) for c in cases]


def test_no_moment(spark):
    cases = [
        (None, "UTC", "null"), ("", "UTC", "blank"), (" \xa0", "UTC", "blank"), ("2021-02-30 05:30", "UTC", "impossible"), ("2021-13-01 05:30", "UTC", "impossible"), ("2023-12-07 25:61", "UTC", "impossible"), ("0000-00-00 00:00:00", "UTC", "impossible"),
        ("13:05 pm on 1 May, 2021", "UTC", "impossible"), ("2022-12-13", "UTC", "day"), ("13 September, 2021", "UTC", "day"), ("09/18/2021", "UTC", "day"), ("2023-05-28 to 2023-07-03", "UTC", "text"), ("last year", "UTC", "text"), ("September 2021", "UTC", "text"),
        ("2021-03-28 02:30", "Europe/Berlin", "nonexistent"), ("2021-10-31 02:30", "Europe/Berlin", "ambiguous"), ("2021-06-01 02:30", None, "no_zone"), ("2021-06-01 02:30", "Mars/Base", "unknown_zone"), ("x" * 100_000, "UTC", "text"),
    ]
    assert run(spark, [c[:2] for c in cases]) == [(c[2], None) for c in cases]


def test_offset_settles(spark):
    rows = [("2021-10-31 02:30 CEST", "Europe/Berlin"), ("2021-10-31 02:30 CET", "Europe/Berlin"), ("2021-10-31T02:30:00+02:00", "Europe/Berlin")]
    assert [x for _, x in run(spark, rows)] == [datetime(2021, 10, 31, 0, 30), datetime(2021, 10, 31, 1, 30), datetime(2021, 10, 31, 0, 30)]


def test_empty_and_repeated(spark):
    assert run(spark, []) == []
    assert run(spark, [("2021-01-01T00:00:00Z", None)] * 3) == [("moment", datetime(2021, 1, 1))] * 3


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2**31 - 1), st.sampled_from(["Europe/Berlin", "America/New_York", "Australia/Lord_Howe", "Asia/Kathmandu", "Africa/Casablanca"])), min_size=30, max_size=60))
def test_against_zoneinfo(spark, moments):
    rows, expected = [], []
    for t, z in moments:
        local = datetime.fromtimestamp(t, UTC).astimezone(ZoneInfo(z)).replace(tzinfo=None)
        rows.append((local.strftime("%Y-%m-%dT%H:%M:%S"), z))
        both = {local.replace(tzinfo=ZoneInfo(z), fold=f).astimezone(UTC).replace(tzinfo=None) for f in (0, 1)}
        expected.append(("moment", both.pop()) if len(both) == 1 else ("ambiguous", None))
    assert run(spark, rows) == expected


def test_gaps_and_overlaps_against_zoneinfo(spark):
    zone, rows, expected = ZoneInfo("America/New_York"), [], []
    for m in range(0, 240, 7):
        for day in (datetime(2022, 3, 13), datetime(2022, 11, 6)):
            local = day + timedelta(minutes=m)
            rows.append((local.strftime("%Y-%m-%d %H:%M"), "America/New_York"))
            back = [x for x in {local.replace(tzinfo=zone, fold=f).astimezone(UTC) for f in (0, 1)} if x.astimezone(zone).replace(tzinfo=None) == local]
            expected.append(("moment", back[0].replace(tzinfo=None)) if len(back) == 1 else ("ambiguous" if back else "nonexistent", None))
    assert run(spark, rows) == expected
