"""Service-day time: seconds after midnight, time zones, calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def service_midnight(day) -> Column:
    """YYYYMMDD integer to a zone-less timestamp at midnight."""
    return F.to_timestamp_ntz(_col(day).cast("string"), F.lit("yyyyMMdd"))


def add_seconds(ts, seconds) -> Column:
    """Timestamp plus seconds; values past 86400 run into the next day."""
    zero = F.lit(0)
    return _col(ts) + F.make_dt_interval(zero, zero, zero, _col(seconds).cast("decimal(18,6)"))


def hour_floor(ts) -> Column:
    return F.date_trunc("hour", _col(ts))


def dow0(ts) -> Column:
    """Day of week with Sunday = 0."""
    return F.dayofweek(_col(ts)) - 1


def local_to_utc(ts, zone: str) -> Column:
    """Zone-less local time to zone-less UTC.

    A local time that occurs twice on the night the clocks go back is read as
    the later (standard time) one. ``convert_timezone`` alone reads it as the
    earlier one, so the result moves on an hour whenever that hour maps back to
    the same local time.
    """
    local = _col(ts)
    early = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    later = early + F.expr("INTERVAL 1 HOUR")
    same = F.convert_timezone(F.lit("UTC"), F.lit(zone), later) == local
    return F.when(same, later).otherwise(early)
