"""Interval joins by time cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.functions.geo import metres
from fleetlens.operators import scan

MIN_MS = 60_000


def interval_join(iv: DataFrame, pts: DataFrame, keys: list[str], lo: str, hi: str, at: str, cell_ms: int,
                  lo_open: bool = False, how: str = "inner") -> DataFrame:
    """Points inside [lo, hi] of the same keys: intervals are copied to the cells they touch, points
    sit in one, so the join is an equi join on (keys, cell) whatever the size of a key.

    It is a sort-merge join: the planner's sizes do not count what generators multiply, so by them either side,
    however large, could be sent to the driver for a broadcast."""
    a = iv.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell_ms), F.floor(F.col(hi) / cell_ms))))
    b = pts.withColumn("_cell", F.floor(F.col(at) / cell_ms))
    inside = (F.col(at) > F.col(lo)) if lo_open else (F.col(at) >= F.col(lo))
    return a.join(b.hint("merge"), [*keys, "_cell"]).where(inside & (F.col(at) <= F.col(hi))).drop("_cell")


def positions_in_window(iv: DataFrame, pos: DataFrame, tail_ms: int = 120_000, cell_ms: int = 10 * MIN_MS) -> DataFrame:
    """Closest fix, covered count and largest hole between fixes of each interval.

    ``iv``: iv_id, bus_id, from_ms, to_ms, lat, lon (the stop). Fixes up to ``tail_ms`` after the
    interval count toward the closest distance only.
    """
    fixes = scan.shifted(pos.select("bus_id", "collected_at", "ingest_seq", F.col("lat").alias("_la"), F.col("lon").alias("_lo")),
                         ["bus_id"], ["collected_at", "ingest_seq"], {"_prev": "collected_at"})
    d = iv.withColumn("_end", F.col("to_ms") + tail_ms)
    j = interval_join(d, fixes, ["bus_id"], "from_ms", "_end", "collected_at", cell_ms)
    inside = F.col("collected_at") <= F.col("to_ms")
    gap = F.col("collected_at") - F.greatest(F.coalesce("_prev", "from_ms"), F.col("from_ms"))
    g = j.groupBy("iv_id").agg(
        F.min(metres("_la", "_lo", "lat", "lon")).alias("closest_fix_m"), F.sum(F.when(inside, 1).otherwise(0)).alias("covered"),
        F.max(F.when(inside, gap)).alias("_gap"), F.max(F.when(inside, F.col("collected_at"))).alias("_last"))
    out = iv.join(g, "iv_id", "left")
    tail_gap = F.col("to_ms") - F.coalesce("_last", "from_ms")
    return out.withColumn("max_gap_ms", F.greatest(F.coalesce("_gap", F.lit(0)), tail_gap)).withColumn(
        "covered", F.coalesce("covered", F.lit(0))).drop("_gap", "_last")


def hold_within(runs: DataFrame, legs: DataFrame, min_ms: int = 15_000, cell_ms: int = 30 * MIN_MS) -> DataFrame:
    """Seconds of resting runs of at least ``min_ms`` inside each [from_ms, to_ms]."""
    r = runs.where(F.col("run_to") - F.col("run_from") >= min_ms).select("bus_id", "run_from", "run_to")
    a = legs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("from_ms") / cell_ms), F.floor(F.col("to_ms") / cell_ms))))
    b = r.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("run_from") / cell_ms), F.floor(F.col("run_to") / cell_ms))))
    lo, hi = F.greatest("from_ms", "run_from"), F.least("to_ms", "run_to")
    j = a.join(b, ["bus_id", "_cell"]).where((hi > lo) & (F.col("_cell") == F.floor(lo / cell_ms)))
    g = j.groupBy("leg_id").agg(F.sum(hi - lo).alias("_ms"))
    return legs.join(g, "leg_id", "left").withColumn("hold_sec", F.coalesce(F.col("_ms") / 1000, F.lit(0.0))).drop("_ms")


def match_forecasts(visits: DataFrame, preds: DataFrame, eta_sec: float, window_ms: int = 45 * MIN_MS, settle_ms: int = 15_000) -> DataFrame:
    """For each served visit the reading nearest the promise, read after the previous departure.

    Ties take the latest reading. ``eta_sec`` is rounded to whole minutes and banded as a promise.
    """
    promised = round(eta_sec / 60) * 60
    ref = min(1800.0, max(30.0, promised))
    tol = max(60.0, ref * 0.25)
    low, high = max(30.0, ref - tol), min(1800.0, ref + tol)
    keys = ["bus_name", "route_id", "stop_id"]
    v = visits.where((F.col("outcome") == "stopped") & (F.col("closest_m") <= 75) & F.col("arrived_at").isNotNull())
    if "id" not in v.columns:
        raise ValueError("visits need an id")
    v = scan.shifted(v, keys, ["arrived_at", "id"], {"_pd": "departed_at", "_pa": "arrived_at"}, cell_ms=scan.DAY_MS)
    after = F.coalesce(F.coalesce("_pd", "_pa") + 1, F.lit(0))
    v = v.withColumn("_from", F.greatest(F.col("arrived_at") - window_ms, after)).withColumn("_to", F.col("arrived_at") - settle_ms)
    v = v.where(F.col("_from") <= F.col("_to")).select(*keys, F.col("id").alias("visit_id"), "bus_id", "arrived_at", "_from", "_to")
    p = preds.where(F.col("surface").isin("trip", "ride", "card") & F.col("predicted_sec").between(low, high)).select(
        F.col("bus_id"), "route_id", F.col("to_stop_id").alias("stop_id"), "predicted_at", "predicted_sec", F.col("id").alias("pred_id"))
    j = interval_join(v, p, ["bus_id", "route_id", "stop_id"], "_from", "_to", "predicted_at", window_ms)
    best = F.min_by(F.struct("predicted_at", "predicted_sec"), F.struct(F.abs(F.col("predicted_sec") - promised), -F.col("predicted_at"), "pred_id"))
    g = j.groupBy("visit_id").agg(F.first("arrived_at").alias("arrived_at"), best.alias("p"))
    return g.select("visit_id", "arrived_at", F.col("p.predicted_at").alias("predicted_at"), F.col("p.predicted_sec").alias("predicted_sec"),
                    ((F.col("arrived_at") - F.col("p.predicted_at")) / 1000).alias("actual_sec"))


def service_state(events: DataFrame, windows: DataFrame, grace_min: int = 90, at: str = "at_ms") -> DataFrame:
    """Where each instant sits in its route's weekly service windows.

    ``windows``: route_id, dow, start_min, end_min (past 1440 runs after midnight and belongs to the
    day it started). A route's windows are a short list carried to its events by one join.
    """
    w = windows.groupBy("route_id").agg(F.collect_list(F.struct("dow", "start_min", "end_min")).alias("wins"))
    e = events.withColumn("_dow", clock.local_dow(at)).withColumn("_min", clock.local_minute(at))
    e = e.join(w, "route_id", "left").withColumn("wins", F.coalesce("wins", F.array().cast("array<struct<dow:int,start_min:int,end_min:int>>")))
    prev = F.pmod(F.col("_dow") + 6, F.lit(7))
    today = F.filter("wins", lambda x: x["dow"] == F.col("_dow"))
    yest = F.filter("wins", lambda x: x["dow"] == prev)
    open_tail = F.transform(F.filter(yest, lambda x: (x["end_min"] > 1440) & (F.col("_min") < x["end_min"] - 1440)), lambda x: x["end_min"] - 1440)
    open_now = F.transform(F.filter(today, lambda x: (F.col("_min") >= x["start_min"]) & ((x["end_min"] > 1440) | (F.col("_min") < x["end_min"]))), lambda x: x["end_min"])
    closed_y = F.transform(F.filter(yest, lambda x: F.col("_min") - (x["end_min"] - 1440) <= grace_min), lambda x: x["end_min"] - 1440)
    closed_t = F.transform(F.filter(today, lambda x: F.col("_min") >= x["start_min"]), lambda x: x["end_min"])
    closes = F.concat(closed_y, closed_t)
    later = F.exists(today, lambda x: F.col("_min") < x["start_min"])
    opens = F.concat(open_tail, open_now)
    state = (F.when(F.size(opens) > 0, F.struct(F.lit("open").alias("state"), F.get(opens, F.lit(0)).alias("close_min")))
             .when(F.size(closes) > 0, F.struct(F.lit("after-close").alias("state"), F.array_max(closes).alias("close_min")))
             .when(later, F.struct(F.lit("before-open").alias("state"), F.lit(None).cast("int").alias("close_min")))
             .otherwise(F.struct(F.lit("off-day").alias("state"), F.lit(None).cast("int").alias("close_min"))))
    return e.withColumn("_s", state).drop("_dow", "_min", "wins").select("*", "_s.state", "_s.close_min").drop("_s")


def active_windows(windows: DataFrame, feed: DataFrame, share: float = 0.8, at: str = "collected_at") -> DataFrame:
    """Windows whose minutes are at least ``share`` covered by feed rows of the route.

    ``windows``: win_id, route_id, from_ms, to_ms. Feed rows shrink to distinct (route, minute) first.
    """
    mins = feed.select("route_id", F.floor(F.col(at) / MIN_MS).alias("m")).distinct()
    w = windows.withColumn("m", F.explode(F.sequence(F.floor(F.col("from_ms") / MIN_MS), F.floor((F.col("to_ms") - 1) / MIN_MS))))
    j = w.join(mins.withColumn("_hit", F.lit(1)), ["route_id", "m"], "left")
    g = j.groupBy("win_id", "route_id").agg(F.count(F.lit(1)).alias("minutes"), F.count("_hit").alias("active"))
    return g.where(F.col("active") >= F.col("minutes") * share)
