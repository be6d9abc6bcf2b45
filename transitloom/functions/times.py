"""Dates, times and time zones on columns."""

from __future__ import annotations

from datetime import date, datetime
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock_seconds(c: Column) -> Column:
    """Seconds of `H:MM:SS`; hours may exceed 24; null where it isn't such a time."""
    p = F.split(F.trim(c), ":")
    h, m, s = (x.try_cast("int") for x in (p[0], F.try_element_at(p, F.lit(2)), F.try_element_at(p, F.lit(3))))
    return h * 3600 + m * 60 + s


def hhmm_minutes(c: Column) -> Column:
    """Minutes of an HHMM number."""
    return (F.floor(c / 100) * 60 + c % 100).cast("int")


def minutes_clock(c: Column) -> Column:
    """`HH:MM:00` of minutes; hours may exceed 24."""
    return F.format_string("%02d:%02d:00", F.floor(c / 60).cast("long"), F.pmod(c, F.lit(60)).cast("long"))


def code_date(c: Column) -> Column:
    """Date of a YYYYMMDD number or string; null if there is no such date."""
    return F.try_to_date(c.cast("string"), "yyyyMMdd")


def date_code(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd").cast("int")


def day_offset(c: Column, start: date) -> Column:
    return F.datediff(c, F.lit(start))


def monday_index(c: Column) -> Column:
    """Day of the week, Monday 0."""
    return F.weekday(c)


def zone_offset_minutes(zone: str, on: date) -> int | None:
    """Minutes that a zone is ahead of UTC at the beginning of a day; None for unknown zones."""
    try:
        ahead = datetime(on.year, on.month, on.day, tzinfo=ZoneInfo(zone)).utcoffset()
    except Exception:  # noqa: BLE001  an unknown or malformed key, whatever its error
        return None
    return int(ahead.total_seconds() // 60)


def zone_offsets(spark, zones, on: date):
    """(zone, offset) of some zone names: a small table for a lookup join."""
    return spark.createDataFrame([(z, zone_offset_minutes(z, on)) for z in zones], "zone string, offset int")


def to_gmt(c: Column, offset_minutes: Column) -> Column:
    return c - offset_minutes


def truncated_minutes(seconds: Column) -> Column:
    """Whole minutes, rounded towards zero."""
    return (seconds / 60).cast("int")
