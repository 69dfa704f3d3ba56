"""Calendar expressions in the operating timezone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "America/New_York"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utc_ts(ms) -> Column:
    return F.timestamp_millis(_c(ms).cast("long"))


def local_ts(ms) -> Column:
    """Wall clock in the operating zone as a (UTC-session) timestamp."""
    return F.from_utc_timestamp(utc_ts(ms), ZONE)


def local_day(ms) -> Column:
    return F.to_date(local_ts(ms))


def local_hour(ms) -> Column:
    return F.hour(local_ts(ms))


def local_dow(ms) -> Column:
    """0 = Sunday."""
    return F.dayofweek(local_ts(ms)) - 1


def local_minute(ms) -> Column:
    t = local_ts(ms)
    return F.hour(t) * 60 + F.minute(t)


def day_start_ms(day) -> Column:
    """Epoch ms of local midnight; days of 23 and 25 hours come out right."""
    return F.unix_millis(F.to_utc_timestamp(_c(day).cast("timestamp"), ZONE))


def day_end_ms(day) -> Column:
    return day_start_ms(F.date_add(_c(day), 1))


def service_day(ms, starts_hour: int = 4) -> Column:
    """Local day that rolls over at ``starts_hour`` instead of midnight."""
    return F.to_date(local_ts(_c(ms)) - F.expr(f"INTERVAL {starts_hour} HOURS"))
