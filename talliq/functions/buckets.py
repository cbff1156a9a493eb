"""Calendar buckets of UTC seconds in an explicit time zone.

Instants become wall-clock values without a zone, so a plan doesn't depend on the session's zone. A local day has 23 or
25 hours where clocks change. A midnight that doesn't exist is the first instant after the gap.
"""

from __future__ import annotations

import datetime
import re
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

PERIODS = {"day": ("DAY", "yyyy-MM-dd"), "week": ("WEEK", "yyyy-MM-dd"), "month": ("MONTH", "yyyy-MM")}
_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def wall_clock(ts: Column, zone: str) -> Column:
    """The local date and time of an instant."""
    utc = F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ts)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)


def instant(wall: Column, zone: str) -> Column:
    """UTC seconds of a local date and time; the earlier of two, and behind the gap of none."""
    return F.timestamp_diff("SECOND", F.expr(_EPOCH), F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))


def local_date(ts: Column, zone: str) -> Column:
    return wall_clock(ts, zone).cast("date")


def start(ts: Column, zone: str, period: str = "day") -> Column:
    """UTC seconds at which the local day, week (from Monday) or month of an instant begins."""
    return instant(F.date_trunc(PERIODS[period][0], wall_clock(ts, zone)).cast("timestamp_ntz"), zone)


def label(ts: Column, zone: str, period: str = "day") -> Column:
    """Day as yyyy-MM-dd, week as its Monday, month as yyyy-MM."""
    wall = wall_clock(ts, zone)
    if period == "month":
        return F.substring(wall.cast("string"), 1, 7)
    day = wall.cast("date")
    if period == "week":
        day = F.date_sub(day, F.weekday(day))
    elif period != "day":
        raise ValueError(f"no such period: {period}")
    return day.cast("string")


def parse_date(text: str, zone: str) -> int | None:
    """UTC seconds of the local midnight of a yyyy-mm-dd date; None if it isn't one."""
    text = text.strip()
    if not re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        return None
    try:
        day = datetime.date.fromisoformat(text)
    except ValueError:
        return None
    return start_of_day(day, zone)


def start_of_day(day: datetime.date, zone: str) -> int:
    """The first whole hour of the day that exists; of an hour that comes twice, the earlier."""
    here = ZoneInfo(zone)
    for hour in range(24):
        local = datetime.datetime.combine(day, datetime.time(hour), here)
        at = int(local.timestamp())
        if datetime.datetime.fromtimestamp(at, here).replace(tzinfo=None) == local.replace(tzinfo=None):
            return at
    return int(datetime.datetime.combine(day, datetime.time(), datetime.UTC).timestamp())


def rfc3339(ts: Column) -> Column:
    """UTC seconds as yyyy-MM-ddTHH:mm:ss+00:00."""
    text = (F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), ts)).cast("string")
    return F.concat(F.replace(text, F.lit(" "), F.lit("T")), F.lit("+00:00"))


def parse_rfc3339(text: Column) -> Column:
    """UTC seconds, rounded down, of a full timestamp with an offset; null otherwise."""
    full = text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$")
    plain = F.upper(F.regexp_replace(text, r"(\.\d{1,6})\d*", "$1"))
    return F.when(full, F.unix_seconds(F.try_to_timestamp(F.regexp_replace(plain, "^(.{10})T", "$1 "))))


def countdown(resets_at: Column, now: Column) -> Column:
    """Time left as 2d, 3h10m or 5m; null when there is none or it is over."""
    left = resets_at - now
    hours, minutes = F.floor(left / 3600).cast("string"), F.floor((left % 3600) / 60).cast("string")
    return (
        F.when(left >= 86400, F.concat(F.floor(left / 86400).cast("string"), F.lit("d")))
        .when(left >= 3600, F.concat(hours, F.lit("h"), minutes, F.lit("m")))
        .when(left > 0, F.concat(minutes, F.lit("m")))
    )
