"""Small scalar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rider-facing surfaces, the official feed's surface and the trial arms.
SHOWN_SURFACES = ("trip", "ride", "card")
UPSTREAM = "upstream"
CENSUS = "census"
TRIAL_SURFACES = ("trip-k10", "ride-k10", "card-k10", "trip-usual", "ride-usual", "card-usual")

HORIZON_CAP_SEC = 1800


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_bus_name(c, all_hashes: bool = False) -> Column:
    c = F.trim(_c(c))
    return F.regexp_replace(c, "^#+" if all_hashes else "^#", "")


def round1(c) -> Column:
    """One decimal, halves toward +infinity."""
    return F.floor(_c(c) * 10 + 0.5) / 10


def pct1(num, den) -> Column:
    """Share in percent to one decimal, null over an empty base."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, F.floor(num / den * 1000 + 0.5) / 10)


def horizon(sec) -> Column:
    """Promise bucket; null past the cap and for NaN."""
    s = _c(sec)
    return (
        F.when(s.isNull() | F.isnan(s) | (s > HORIZON_CAP_SEC), F.lit(None).cast("string"))
        .when(s < 120, "0-2")
        .when(s < 300, "2-5")
        .when(s < 600, "5-10")
        .otherwise("10-30")
    )


# Bucket label, from second, to second, early tolerance, late tolerance.
V1_BUCKETS = (
    ("0-3m", 0, 180, 30.0, 90.0),
    ("3-6m", 180, 360, 60.0, 150.0),
    ("6-10m", 360, 600, 60.0, 210.0),
    ("10-15m", 600, 900, 90.0, 270.0),
)


def v1_bucket(sec) -> Column:
    s = _c(sec)
    out = F.lit(None).cast("struct<bucket:string,early_tol:double,late_tol:double>")
    for label, lo, hi, early, late in V1_BUCKETS:
        cell = F.struct(
            F.lit(label).alias("bucket"), F.lit(early).alias("early_tol"), F.lit(late).alias("late_tol")
        )
        out = F.when((s >= lo) & (s < hi), cell).otherwise(out)
    return out


def ahead_bucket(n, v2: bool = True) -> Column:
    n = _c(n)
    if v2:
        return F.when(n <= 0, "1").when(n >= 10, "10+").otherwise(n.cast("string"))
    return F.when(n > 10, "10+").when(n > 0, n.cast("string"))


def in_hour_window(hour, centre, k: int = 1) -> Column:
    d = F.pmod(_c(hour) - _c(centre) + 12, F.lit(24)) - 12
    return d.between(-k, k)


def circular_minutes(a, b) -> Column:
    d = F.abs(_c(a) - _c(b))
    return F.least(d, F.lit(1440) - d)


def same_period(a_dow, a_min, b_dow, b_min, minutes: int = 120) -> Column:
    """Same weekend class and close in time of day."""
    return (_c(a_dow).isin(0, 6) == _c(b_dow).isin(0, 6)) & (circular_minutes(a_min, b_min) <= minutes)


def is_rider_surface(c) -> Column:
    return ~_c(c).isin(UPSTREAM, *TRIAL_SURFACES)


ANON_ID = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def normalize_query(c, max_len: int | None = 60) -> Column:
    """Lower case, apostrophes dropped, other punctuation to single spaces; cut at ``max_len`` unless None."""
    x = F.regexp_replace(F.lower(_c(c)), "['’]", "")
    x = F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    return x if max_len is None else F.substring(x, 1, max_len)


def countdown_bucket(token) -> Column:
    """Displayed countdown text -> [lo, hi) seconds: 'now', '<1', 'N min'."""
    t = F.trim(F.lower(_c(token)))
    n = F.regexp_extract(t, "^(\\d+)", 1).cast("int")
    lo = F.when(t.startswith("now") | t.startswith("<1"), 0).when(n.isNotNull(), n * 60)
    hi = F.when(t.startswith("now") | t.startswith("<1"), 60).when(n.isNotNull(), n * 60 + 60)
    return F.when(lo.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi")))


def hinge_scale(eta, scale, floor_sec: float = 180.0) -> Column:
    """Scale only the part of an estimate above the floor."""
    e = _c(eta)
    return F.when(e <= floor_sec, e).otherwise(F.lit(floor_sec) + (e - floor_sec) * scale)


def widen(eta, low, high, k) -> tuple[Column, Column]:
    """Stretch an interval about its point by k."""
    e, lo, hi = _c(eta), _c(low), _c(high)
    return e - (e - lo) * k, e + (hi - e) * k
