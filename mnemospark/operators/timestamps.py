"""Mixed timestamp formats and zones to one moment in UTC.

A string without an offset is local time of a region. Which moment it denotes is looked up
as of the local time in intervals of constant offset: each region's intervals, written in
local time, overlap where clocks go back (two intervals match: ambiguous) and leave a gap
where they go forward (none matches: nonexistent). The intervals are exploded to one bucket
per region and calendar year, so the lookup is one equi-join and a test of a few intervals.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions.dates import parsed
from mnemospark.session import cut

#: Years for which intervals are made. Local times outside have status ``out_of_range``.
FIRST_YEAR, LAST_YEAR = 1900, 2100

_MADE: dict[str, DataFrame] = {}
_BUCKET = "zone string, year int, spans array<struct<from_us: bigint, to_us: bigint, offset_s: int>>"


def _zone_buckets(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(region) to (region, local year, intervals of constant offset that touch that year)."""
    from datetime import UTC, datetime
    from zoneinfo import ZoneInfo

    begin = int(datetime(FIRST_YEAR, 1, 1, tzinfo=UTC).timestamp()) - 2 * 86_400
    end = int(datetime(LAST_YEAR + 1, 1, 1, tzinfo=UTC).timestamp()) + 2 * 86_400
    years = [int(datetime(y, 1, 1, tzinfo=UTC).timestamp()) for y in range(FIRST_YEAR, LAST_YEAR + 2)]
    step = 10 * 86_400
    for frame in frames:
        rows = []
        for name in frame["zone"]:
            zone = ZoneInfo(name)

            def offset(t: int, zone: ZoneInfo = zone) -> int:
                return int(datetime.fromtimestamp(t, zone).utcoffset().total_seconds())

            spans, since, t, now = [], begin, begin, offset(begin)
            while t < end:
                ahead = min(t + step, end)
                then = offset(ahead)
                if then != now:
                    low, high = t, ahead
                    while high - low > 1:
                        mid = (low + high) // 2
                        low, high = (mid, high) if offset(mid) == now else (low, mid)
                    now = offset(high)
                    spans.append((since, high, offset(low)))
                    since, t = high, high
                else:
                    t = ahead
            spans.append((since, end, now))
            local = [(a + o, b + o, o) for a, b, o in spans]
            first = 0
            for year, (a, b) in zip(range(FIRST_YEAR, LAST_YEAR + 1), zip(years, years[1:], strict=False), strict=False):
                while first < len(local) - 1 and local[first][1] <= a - 86_400:
                    first += 1
                touched = []
                for x in local[first:]:
                    if x[0] >= b + 86_400:
                        break
                    if x[1] > a and x[0] < b:
                        touched.append({"from_us": x[0] * 1_000_000, "to_us": x[1] * 1_000_000, "offset_s": x[2]})
                rows.append((name, year, touched))
        yield pd.DataFrame(rows, columns=["zone", "year", "spans"])


def zone_intervals(spark: SparkSession) -> DataFrame:
    """``zone, year, spans``: at most (regions of the IANA database) x (201 years) rows.

    Offsets are in seconds, as old ones weren't whole minutes.
    """
    from zoneinfo import available_timezones

    names = sorted(x for x in available_timezones() if x != "localtime" and not x.startswith(("posix/", "right/")))
    app = spark.sparkContext.applicationId
    if app not in _MADE:  # once an application, then read from the checkpoint
        zones = spark.createDataFrame([(x,) for x in names], "zone string").repartition(spark.sparkContext.defaultParallelism)
        _MADE.clear()
        _MADE[app] = cut(zones.mapInPandas(_zone_buckets, _BUCKET))
    return _MADE[app]


def normalise_moments(df: DataFrame, value: str | Column, zone: str | Column, keep: Sequence[str | Column], zones: DataFrame | None = None) -> DataFrame:
    """The columns ``keep`` and, of each row's ``value``, its moment.

    Adds ``moment timestamp`` (UTC, microseconds) and ``moment_status string``:

    - ``moment``: the string denotes exactly one moment, which is in ``moment``; otherwise ``moment`` is null and the status is
    - ``ambiguous``: a local time that its zone repeats; ``nonexistent``: one that its zone skips
    - ``no_zone``: a local time, and neither the string nor ``zone`` names a zone
    - ``unknown_zone``: the zone named isn't a known region or abbreviation
    - ``out_of_range``: a local time before 1900 or after 2100
    - ``day``, ``impossible``, ``text`` (ranges, phrases, anything else), ``blank``, ``null``

    Every row stays, repeated rows too; columns of ``df`` that aren't in ``keep`` don't
    matter, whatever their names. An offset or abbreviation in the string wins over a
    region beside it, a region in the string over ``zone``.
    """
    spark = df.sparkSession
    value = F.col(value) if isinstance(value, str) else value
    zone = F.col(zone) if isinstance(zone, str) else zone
    kept = [F.col(x) if isinstance(x, str) else x for x in keep]
    rows = df.select(F.struct(*kept).alias("kept"), value.cast("string").alias("raw"), zone.cast("string").alias("home"))
    rows = rows.withColumn("p", parsed(F.col("raw")))
    local = (F.col("p.kind") == "time") & F.col("p.offset_min").isNull()
    rows = rows.select(
        "kept", "p",
        F.when(local, F.coalesce(F.col("p.zone"), F.nullif(F.trim("home"), F.lit("")))).alias("region"),
        F.when(local, F.col("p.year")).alias("region_year"),
    )
    # bounded by the IANA database, whatever the size of df: see zone_intervals
    buckets = F.broadcast((zones or zone_intervals(spark)).select(F.col("zone").alias("region"), F.col("year").alias("region_year"), "spans"))
    rows = rows.join(buckets, ["region", "region_year"], "left")
    hits = F.filter("spans", lambda s: (s["from_us"] <= F.col("p.local_us")) & (F.col("p.local_us") < s["to_us"]))
    rows = rows.withColumn("hits", hits)
    in_range = F.col("region_year").between(FIRST_YEAR, LAST_YEAR)
    status = (
        F.when(F.col("p.kind") == "epoch", "moment")
        .when(F.col("p.kind") != "time", F.col("p.kind"))
        .when(F.col("p.offset_min").isNotNull(), "moment")
        .when(F.col("region").isNull(), "no_zone")
        .when(~in_range, "out_of_range")
        .when(F.col("spans").isNull(), "unknown_zone")
        .when(F.size("hits") == 1, "moment")
        .when(F.size("hits") == 0, "nonexistent")
        .otherwise("ambiguous")
    )
    utc = F.col("p.local_us") - F.coalesce(F.col("p.offset_min").cast("bigint") * 60, F.get(F.col("hits"), F.lit(0))["offset_s"].cast("bigint")) * 1_000_000
    return rows.select("kept.*", F.when(status == "moment", F.timestamp_micros(utc)).alias("moment"), status.alias("moment_status"))
