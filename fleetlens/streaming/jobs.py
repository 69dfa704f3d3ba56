"""Structured Streaming forms: keyed state folds and incremental scoring."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from itertools import groupby
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from fleetlens.functions import clock
from fleetlens.operators import events as EV
from fleetlens.operators import scoring as S
from fleetlens.operators.fold import apart, close_name, fold_poll
from fleetlens.sources.tables import overwrite_day

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SETTLE_MS = 47 * 60_000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _plain(v: Any) -> Any:
    """Arrays and numpy scalars as plain data, so that state is JSON."""
    return v.tolist() if hasattr(v, "tolist") else v


class KeyedFold(StatefulProcessor):
    """Fold rows of a key in time order; state is one JSON value, closed by an event-time timer.

    ``fold(state, row) -> (state, rows)`` and ``expire(state) -> rows`` are plain functions. With ``poll`` (a place
    in ``cols``) neighbouring rows that agree there are folded together, as a list.
    """

    def __init__(self, fold: Callable, order: list[str], cols: list[str], to_frame: Callable[[tuple, list], pd.DataFrame],
                 time: str, idle_ms: int | None = None, expire: Callable | None = None, poll: int | None = None) -> None:
        self.fold, self.order, self.cols, self.to_frame = fold, order, cols, to_frame
        self.time, self.idle_ms, self.expire, self.poll = time, idle_ms, expire, poll

    def init(self, handle: Any) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "value string")

    def _get(self):
        return json.loads(self.state.get()[0]) if self.state.exists() else None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows), ignore_index=True).sort_values(self.order)
        st, out = self._get(), []
        rows = (tuple(_plain(v) for v in r) for r in pdf[self.cols].itertuples(index=False, name=None))
        for r in rows if self.poll is None else (list(g) for _, g in groupby(rows, key=lambda r: r[self.poll])):
            st, got = self.fold(st, r)
            out += got
        if st is None:
            if self.state.exists():
                self.state.clear()
        else:
            self.state.update((json.dumps(st),))
            if self.idle_ms is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(int(pdf[self.time].max()) + self.idle_ms)
        yield self.to_frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        st = self._get()
        out = self.expire(st) if st is not None and self.expire else []
        if self.state.exists():
            self.state.clear()
        yield self.to_frame(key, out)

    def close(self) -> None:
        pass


def keyed(stream: DataFrame, keys: list[str], proc: KeyedFold, schema: str, mode: str = "append") -> DataFrame:
    use_rocksdb(stream.sparkSession)
    tm = "eventtime" if proc.idle_ms is not None else "none"
    return stream.groupBy(*keys).transformWithStateInPandas(statefulProcessor=proc, outputStructType=schema, outputMode=mode, timeMode=tm)


# --- T2 / T3 --------------------------------------------------------------------------------------


def _events_frame(key: tuple, rows: list[dict]) -> pd.DataFrame:
    return EV._frame(rows)


def detect_events_stream(pos: DataFrame, ring: DataFrame) -> DataFrame:
    """The event fold on a stream of fixes carrying ``event_time`` with a watermark.

    The state of a key holds all vehicles of one name, so two that share it keep their own tracks, and a reissued
    id takes its track over (T1). Rows of one poll are folded together. A name idle past the gap limit is closed
    by its timer, as a hole closes it in batch. Restarts resume from the checkpoint.
    """
    d = EV.with_distances(pos, ring).select(*EV.INPUT, "ingest_seq", "event_time")
    proc = KeyedFold(fold_poll, ["collected_at", "bus_id", "ingest_seq"], EV.INPUT, _events_frame, "collected_at", EV.GAP_MS, close_name, poll=EV.INPUT.index("collected_at"))
    return keyed(d, ["bus_name"], proc, EV.EVENT)


# --- T4, T5 ---------------------------------------------------------------------------------------

LAP_TTL_MS = 2 * 3_600_000


def _fold_lap(st: dict | None, row: tuple):
    rid, stop, arrived, departed = row
    st = {k: v for k, v in (st or {}).items() if arrived - v <= LAP_TTL_MS}
    last = st.get(str(stop))
    out = [(rid, stop, arrived, (arrived - last) / 1000 if last is not None else None)]
    if departed is not None and departed == departed:
        st[str(stop)] = int(departed)
    return st, out


def lap_clock(arrivals: DataFrame) -> DataFrame:
    """Seconds since each vehicle last left a stop, departures kept two hours (T4)."""
    cols = ["route_id", "stop_id", "arrived_at", "departed_at"]
    frame = lambda k, rows: pd.DataFrame([(k[0], *r) for r in rows], columns=["bus_name", "route_id", "stop_id", "arrived_at", "lap_sec"])
    proc = KeyedFold(_fold_lap, ["arrived_at"], cols, frame, "arrived_at")
    return keyed(arrivals, ["bus_name"], proc, "bus_name string, route_id long, stop_id long, arrived_at long, lap_sec double")


#: Continuity before a clock is trusted, age of an origin that still counts, and the hole that ends a clock.
TRUST_MS, STALE_MS, CLOCK_GAP_MS = 600_000, 45 * 60_000, 60_000


def _fold_checkpoint(source: int, wait: int, n: int, before_source_resets: bool):
    """The rows of one poll of a vehicle, as (stop_index, departed_at, seen_at, phase, at_index, began_at).

    state: first and last sighting, departure per place, the last departure from the waiting place, and the origin
    that is known to have been released."""
    ahead = lambda i: (i - source) % n
    known = lambda v: v is not None and v == v

    def fold(st: dict | None, rows: list[tuple]):
        seen = int(rows[0][2])
        if st is None or seen <= st["last"] or seen - st["last"] > CLOCK_GAP_MS:
            st = dict(first=seen, last=seen, left={}, release=None, released=None)
        st["last"] = seen
        for place, departed, *_ in rows:
            if known(departed) and st["first"] <= departed <= seen:
                st["left"][str(int(place))] = int(departed)
                if place == wait:
                    st["release"] = int(departed)
        out = []
        for _, _, _, phase, index, began in rows:
            if phase not in ("hold", "drive") or not known(index) or not 0 <= index < n:
                continue
            if before_source_resets and index < source:
                st["left"], st["release"] = {}, None  # a new lap does not inherit the last one's clock
            origin = st["left"].get(str(source))
            if origin is None or not known(began) or origin > began or seen - st["first"] < TRUST_MS or seen - origin > STALE_MS:
                continue
            gone = [st["released"] == origin,  # said once, it holds until the next origin
                    st["release"] is not None and origin < st["release"] <= began,
                    ahead(index) > ahead(wait),
                    index == wait and phase == "drive"]
            if any(gone):
                st["released"] = origin
            out.append((seen, origin, int(index), phase, any(gone)))
        return st, out

    return fold


def checkpoint_clock(polls: DataFrame, source: int, wait: int, n: int, before_source_resets: bool = False) -> DataFrame:
    """When each vehicle of a scoped route left its source, and whether it is past its waiting place (T5).

    ``polls``: route_id, bus_name, seen_at, and either what the vehicle does (phase 'hold' or 'drive', at_index: the place it
    holds at or drives from, began_at) or a finished departure (stop_index, departed_at); the rest null. One row out per poll
    that the clock can vouch for: ten minutes without a hole, an origin of at most 45 minutes. A sighting that repeats or comes late
    starts the clock anew, as a hole does.
    """
    cols = ["stop_index", "departed_at", "seen_at", "phase", "at_index", "began_at"]
    frame = lambda k, rows: pd.DataFrame([(*k, *r) for r in rows], columns=["route_id", "bus_name", "seen_at", "origin_at", "at_index", "phase", "released"])
    proc = KeyedFold(_fold_checkpoint(source, wait, n, before_source_resets), ["seen_at"], cols, frame, "seen_at", poll=cols.index("seen_at"))
    return keyed(polls, ["route_id", "bus_name"], proc, "route_id long, bus_name string, seen_at long, origin_at long, at_index long, phase string, released boolean")


# --- T7, T8 ---------------------------------------------------------------------------------------


SPEED_WINDOW_MS, SPEED_GAP_MS = 30_000, 20_000


def _trailing_speed(t: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> float | None:
    """Metres a second over the window that ends at the last fix; null for a short or a standing one.

    The way is a curve over time: its metres and its place at the window's start are read off by interpolation."""
    start = max(t[0], t[-1] - SPEED_WINDOW_MS)
    if t[-1] - start < 25_000:
        return None
    steps = np.hypot(np.diff(lat), np.diff(lon) * np.cos(np.radians((lat[1:] + lat[:-1]) / 2))) * 111_320.0
    way = np.concatenate([[0.0], np.cumsum(steps)])
    la, lo, before = (float(np.interp(start, t, v)) for v in (lat, lon, way))
    inside = t > start
    reach = np.hypot(lat[inside] - la, (lon[inside] - lo) * np.cos(np.radians((lat[inside] + la) / 2))) * 111_320.0
    return (float(way[-1]) - before) / ((t[-1] - start) / 1000) if reach.max() >= 15 else None


def _fold_speed(st: list | None, row: tuple):
    """State: the fixes that the next window may need. A late or repeated fix changes nothing."""
    t, lat, lon = row
    known = np.array(st or [], dtype=float).reshape(-1, 3)
    if len(known) and t <= known[-1, 0]:
        return st, [(t, None)]
    if len(known):
        gap = t - known[-1, 0]
        if gap > SPEED_GAP_MS or apart(known[-1, 1], known[-1, 2], lat, lon) > 50 * gap / 1000:
            known = known[:0]
    known = np.concatenate([known, [[t, lat, lon]]])
    # One fix at or before the window's start is enough.
    known = known[max(0, int(np.searchsorted(known[:, 0], t - SPEED_WINDOW_MS, side="right")) - 1) :]
    return [[int(a), b, c] for a, b, c in known.tolist()], [(t, _trailing_speed(*known.T))]


def speed_stream(pos: DataFrame) -> DataFrame:
    """Trailing 30 s speed; a hole or an impossible step resets it, an older fix is ignored."""
    frame = lambda k, rows: pd.DataFrame([(k[0], *r) for r in rows], columns=["bus_name", "collected_at", "speed_mps"])
    proc = KeyedFold(_fold_speed, ["collected_at"], ["collected_at", "lat", "lon"], frame, "collected_at")
    return keyed(pos, ["bus_name"], proc, "bus_name string, collected_at long, speed_mps double")


def _fold_roundtrip(jump_ms: float, back_ms: float, expire_ms: int):
    def fold(st: dict | None, row: tuple):
        t, sec, anchor = row
        inst, out = t + sec * 1000, []
        if st is None:
            return dict(t=t, inst=inst, anchor=anchor, open=None), out
        o = st["open"]
        if o and (t - o["at"] > expire_ms or anchor != o["anchor"]):
            o = None
        if o and abs(inst - o["base"]) <= back_ms:
            out.append((o["at"], t, (o["far"] - o["base"]) / 1000))
            o = None
        elif not o and anchor == st["anchor"] and t - st["t"] <= expire_ms and abs(inst - st["inst"]) >= jump_ms:
            o = dict(at=t, base=st["inst"], far=inst, anchor=anchor)
        return dict(t=t, inst=inst, anchor=anchor, open=o), out
    return fold


def roundtrip_stream(offers: DataFrame, jump_sec: float = 180, back_sec: float = 60, expire_ms: int = 600_000) -> DataFrame:
    """Large moves of a promise that come back while the anchor holds.

    ``offers``: offer_key, at_ms, sec, anchor, event_time. An open excursion ends when it expires.
    """
    frame = lambda k, rows: pd.DataFrame([(k[0], *r) for r in rows], columns=["offer_key", "open_at", "return_at", "excursion_sec"])
    proc = KeyedFold(_fold_roundtrip(jump_sec * 1000, back_sec * 1000, expire_ms), ["at_ms"], ["at_ms", "sec", "anchor"], frame, "at_ms", expire_ms)
    return keyed(offers, ["offer_key"], proc, "offer_key string, open_at long, return_at long, excursion_sec double")


# --- T9: settled scoring --------------------------------------------------------------------------


def score_days(preds: DataFrame, visits: DataFrame, through_ms: int, path: str, census: DataFrame | None = None) -> DataFrame:
    """Score the settled part of the given days and replace their partitions.

    A promise is final once ``SETTLE_MS`` old. Days are recomputed from the logs, so hour by hour
    equals one pass by construction.
    """
    upto = through_ms - SETTLE_MS
    p = preds.where(F.col("predicted_at") < upto)
    c = census.where(F.col("sampled_at") < upto) if census is not None else None
    cells = S.scorecard(p, visits, c)
    end = clock.day_end_ms("day")
    cells = cells.withColumn("scored_through", F.least(F.lit(upto), end)).withColumn(
        "final", F.lit(through_ms) >= end + int(3.5 * 3_600_000)).withColumn("arm_kind", F.lit("live"))
    overwrite_day(cells, path)
    return cells


def open_days(spark: SparkSession, path: str) -> list:
    """Days of the stored scorecard that are not final yet; none where nothing is stored."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # nothing stored, or empty passes only
            raise
        return []
    return [r[0] for r in stored.groupBy("day").agg(F.min("final").alias("final")).where("not final").select("day").collect()]


def settle(spark: SparkSession, days: list, now_ms: int, read_preds: Callable[[list], DataFrame], read_visits: Callable[[list], DataFrame], path: str,
           read_census: Callable[[list], DataFrame] | None = None) -> None:
    """One scoring pass at the clock ``now_ms`` over ``days`` and every stored day that is not final.

    Run it after the last reading too: at half past three the day before becomes final."""
    days = sorted({*days, *open_days(spark, path)})
    if not days:
        return
    p = read_preds(days).where(clock.local_day("predicted_at").isin(days))
    c = read_census(days).where(clock.local_day("sampled_at").isin(days)) if read_census else None
    score_days(p, read_visits(days), now_ms, path, c)


def score_stream(preds: DataFrame, read_preds: Callable[[list], DataFrame], read_visits: Callable[[list], DataFrame], path: str, checkpoint: str,
                 read_census: Callable[[list], DataFrame] | None = None, now_ms: Callable[[], int] = lambda: int(time.time() * 1000)):
    """Watch the prediction log and rescore the days that are not final.

    What is settled goes by the clock, never by the newest reading: a promise waits for the arrivals
    of its time. ``read_*(days)`` read the logs pruned to those days and neighbours; the census is
    scored with them, as a day's partition is replaced whole.
    """
    def batch(df: DataFrame, _: int) -> None:
        days = [r[0] for r in df.select(clock.local_day("predicted_at").alias("d")).distinct().collect()]
        settle(df.sparkSession, days, now_ms(), read_preds, read_visits, path, read_census)

    return preds.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- T10, T11, T12 --------------------------------------------------------------------------------


COOLDOWN_MS, MAX_PER_DAY, CLEAN_RUNS = 6 * 3_600_000, 6, 2


def _fold_line(st: dict | None, row: tuple):
    """A line's runs: what may alert, and the moment it has been clean often enough. Nothing else is sent on."""
    rid, received, ok, qualifies = row
    clean = (st or {"clean": 0})["clean"] + 1 if ok else 0
    said = [(rid, received, bool(qualifies), clean >= CLEAN_RUNS)] if qualifies or clean == CLEAN_RUNS else []
    return {"clean": min(clean, CLEAN_RUNS + 1)}, said


def _fold_alert(st: dict | None, row: tuple):
    """All lines' candidates: only an alert that is sent starts a cooldown, and the daily cap spans the lines."""
    rid, line, received, qualifies, clean, day = row
    st = st or dict(last={}, open={}, day="", n=0)
    if day != st["day"]:
        st["day"], st["n"] = day, 0
    out = []
    if qualifies:
        last = st["last"].get(line)
        if (last is None or received - last >= COOLDOWN_MS) and st["n"] < MAX_PER_DAY:
            st["last"][line], st["open"][line], st["n"] = int(received), int(received), st["n"] + 1
            out.append((line, "alert", rid, received))
    if clean and line in st["open"]:
        out.append((line, "recovered", rid, received))
        del st["open"][line]
    return st, out


def alert_stream(runs: DataFrame) -> DataFrame:
    """Alerts with the line cooldown, the daily cap and recovery after two clean runs.

    Two states in a row. The first, by line, follows clean runs and sends on only runs that may alert and the one run
    that completes a recovery. The second sees these candidates of all lines, as the daily cap spans them; whether an
    alert was sent is known there alone, so cooldowns are kept there too.
    ``runs``: id, line, received_at, started_at, ok, qualifies.
    """
    by_line = lambda k, rows: pd.DataFrame([(r[0], k[0], *r[1:]) for r in rows], columns=["id", "line", "received_at", "qualifies", "clean"])
    first = KeyedFold(_fold_line, ["received_at", "id"], ["id", "received_at", "ok", "qualifies"], by_line, "received_at")
    d = keyed(runs, ["line"], first, "id long, line string, received_at long, qualifies boolean, clean boolean")
    d = d.withColumn("_all", F.lit("all")).withColumn("day", clock.local_day("received_at").cast("string"))
    frame = lambda k, rows: pd.DataFrame(rows, columns=["line", "kind", "id", "at_ms"])
    proc = KeyedFold(_fold_alert, ["received_at", "id"], ["id", "line", "received_at", "qualifies", "clean", "day"], frame, "received_at")
    return keyed(d, ["_all"], proc, "line string, kind string, id long, at_ms long")


def _fold_curb(st: dict | None, row: tuple):
    kind, t, d, lat, lon, fid = row
    st = st or dict(pending=[], first=None, armed=True)
    out = []
    late = [f for f in st["pending"] if t - f[1] > SETTLE_MS]
    out += [(f[0], None, "unresolved") for f in late]
    st["pending"] = [f for f in st["pending"] if t - f[1] <= SETTLE_MS]
    if kind == "forecast":
        st["pending"].append([int(fid), int(t)])
        return st, out
    if d > EV.FAR_M:
        st["armed"], st["first"] = True, None
    elif d <= EV.PIN_M:
        f = st["first"]
        if f is None or f[1] != lat or f[2] != lon:
            st["first"] = [int(t), lat, lon]
        elif st["armed"] and t - f[0] >= 9_000:
            out += [(p[0], f[0], "resolved") for p in st["pending"] if p[1] <= f[0]]
            st["pending"] = [p for p in st["pending"] if p[1] > f[0]]
            st["armed"] = False
    else:
        st["first"] = None
    return st, out


def curb_stream(rows: DataFrame) -> DataFrame:
    """Curb arrivals settling pending forecasts.

    ``rows``: bus_name, stop_id, kind ('fix'/'forecast'), t_ms, dist_m, lat, lon, forecast_id, event_time.
    """
    frame = lambda k, rs: pd.DataFrame([(*k, *r) for r in rs], columns=["bus_name", "stop_id", "forecast_id", "curb_at", "state"]).astype({"curb_at": "Int64"})
    proc = KeyedFold(_fold_curb, ["t_ms", "kind"], ["kind", "t_ms", "dist_m", "lat", "lon", "forecast_id"], frame, "t_ms", SETTLE_MS,
                     lambda st: [(f[0], None, "unresolved") for f in st["pending"]])
    return keyed(rows, ["bus_name", "stop_id"], proc, "bus_name string, stop_id long, forecast_id long, curb_at long, state string")


def actives_stream(events: DataFrame) -> DataFrame:
    """Activity counters per (local day, id) in update mode (T12); merge with S8.

    ``events``: anon_id, kind ('poll'/'search'), at_ms, event_time with a watermark.
    """
    kind = F.col("kind")
    return events.groupBy(clock.local_day("at_ms").alias("day"), "anon_id").agg(
        F.min("at_ms").alias("first_seen_ms"), F.max("at_ms").alias("last_seen_ms"), F.sum(F.when(kind == "poll", 1).otherwise(0)).alias("polls"),
        F.sum(F.when(kind == "search", 1).otherwise(0)).alias("searches"))


def presence_stream(pos: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Presence runs as session windows (W11, stream form)."""
    return pos.groupBy("bus_name", "route_id", F.session_window("event_time", gap)).agg(F.count(F.lit(1)).alias("fixes"))


def dedupe_stream(preds: DataFrame, within: str = "10 minutes") -> DataFrame:
    """First writer wins on the log's unique key, state bounded by the watermark."""
    return preds.withWatermark("event_time", within).dropDuplicatesWithinWatermark(["bus_id", "to_stop_id", "predicted_at", "surface"])
