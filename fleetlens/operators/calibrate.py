"""Travel and stand-time tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import exprs as E
from fleetlens.functions.geo import metres
from fleetlens.functions.quantiles import TEN_KNOTS, grouped_quantiles
from fleetlens.operators.runs import map_runs
from fleetlens.session import materialize


DAY_MS = 86_400_000
MAX_MPS = 22.0
PIN_M = 75.0
SHRINK_K = 8
HOP = ["route_id", "from_stop_id", "to_stop_id"]
CELL = ["route_id", "stop_id"]


def with_chord(df: DataFrame, stops: DataFrame) -> DataFrame:
    """Straight metres between from_stop_id and to_stop_id; null where geometry is unknown."""
    a = stops.select(F.col("stop_id").alias("from_stop_id"), F.col("lat").alias("_la"), F.col("lon").alias("_oa"))
    b = stops.select(F.col("stop_id").alias("to_stop_id"), F.col("lat").alias("_lb"), F.col("lon").alias("_ob"))
    d = df.join(a, "from_stop_id", "left").join(b, "to_stop_id", "left")
    return d.withColumn("chord_m", metres("_la", "_oa", "_lb", "_ob")).drop("_la", "_oa", "_lb", "_ob")


def _possible(sec: Column, m: Column, max_mps: float) -> Column:
    return m.isNull() | ((sec > 0) & (m / sec <= max_mps))


def plausible_travel(df: DataFrame, stops: DataFrame, sec: str = "travel_sec", max_mps: float = MAX_MPS) -> DataFrame:
    """Drop travel times no vehicle can make."""
    return with_chord(df, stops).where(_possible(F.col(sec), F.col("chord_m"), max_mps))


def plausible_leg(df: DataFrame, stops: DataFrame, sec: str = "leg_sec", max_mps: float = MAX_MPS) -> DataFrame:
    """The same on stop-zone clocks: both ends may be a pin radius nearer (P5)."""
    d = with_chord(df, stops)
    return d.where(_possible(F.col(sec), F.greatest(F.col("chord_m") - 2 * PIN_M, F.lit(0.0)), max_mps))


def available_by(df: DataFrame, now_ms: int, kind: str) -> DataFrame:
    """Only what had completed by ``now_ms`` (P6), whatever its event time."""
    c = F.col
    done = {
        "segment": lambda: c("started_at") + F.greatest(F.lit(0.0), c("travel_sec")) * 1000,
        "arrival": lambda: F.greatest(F.coalesce("departed_at", "arrived_at"), c("arrived_at") + F.greatest(F.lit(0.0), c("dwell_sec")) * 1000),
        "visit": lambda: F.when(
            c("departed_at").isNull() & (c("outcome") == "passed"),
            F.greatest(c("anchored_at"), F.coalesce("first_moved_at", "anchored_at")),
        ).when(c("departed_at").isNotNull(), F.greatest(c("departed_at"), F.coalesce("first_moved_at", "departed_at")))
        + F.greatest(F.lit(0.0), F.coalesce("confirm_sec", F.lit(0.0))) * 1000,
        "leg": lambda: F.greatest(c("arrived_at"), F.coalesce("to_pinned_at", "arrived_at")),
    }[kind]()
    return df.where(done <= now_ms)


def _since(df: DataFrame, col: str, now_ms: int, days: int) -> DataFrame:
    return df.where(F.col(col).between(now_ms - days * DAY_MS, now_ms))


def segment_stats(segments: DataFrame, stops: DataFrame, now_ms: int, dow: int, hour: int, k: int = 1, days: int = 30) -> DataFrame:
    """Hop travel time: the (dow, hour +- k) slice shrunk toward the hop's own median (A1)."""
    s = plausible_travel(available_by(_since(segments, "started_at", now_ms, days), now_ms, "segment"), stops)
    return _segment_table(s, HOP, (F.col("dow") == dow) & E.in_hour_window("hour", F.lit(hour), k))


def _segment_table(s: DataFrame, keys: list[str], in_slice: Column) -> DataFrame:
    prior = grouped_quantiles(s, keys, "travel_sec", {"prior": (0.5, "linear")})
    x = F.when(in_slice, F.col("travel_sec"))
    st = s.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("_avg"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("_sd"))
    n = F.col("n")
    return st.join(prior.drop("_n"), keys).select(
        *keys,
        F.when(n == 0, F.col("prior")).otherwise((n * F.col("_avg") + SHRINK_K * F.col("prior")) / (n + SHRINK_K)).alias("mean"),
        F.greatest(F.col("_sd"), F.lit(5.0)).alias("stddev"), "n",
        F.when(n >= SHRINK_K, "specific").otherwise("route-segment").alias("source"),
    )


def dwell_stats(arrivals: DataFrame, now_ms: int, dow: int, hour: int, k: int = 1, days: int = 14) -> DataFrame:
    """Dwell per (route, stop): median and spread of the slice, else of all history (A2)."""
    a = available_by(_since(arrivals, "arrived_at", now_ms, days).where(F.col("dwell_sec").isNotNull()), now_ms, "arrival")
    return _dwell_table(a, CELL, (F.col("dow") == dow) & E.in_hour_window("hour", F.lit(hour), k))


def _dwell_table(a: DataFrame, keys: list[str], in_slice: Column) -> DataFrame:
    sc = a.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.when(in_slice, "window")))))
    q = grouped_quantiles(sc, [*keys, "scope"], "dwell_sec",
                          {"med": (0.5, "linear"), "p90": (0.9, "linear"), "p35": (0.35, "linear")})
    pick = lambda s, c: F.max(F.when(F.col("scope") == s, F.col(c)))
    w = q.groupBy(*keys).agg(
        pick("all", "_n").alias("na"), pick("all", "med").alias("ma"), pick("all", "p90").alias("pa"), pick("all", "p35").alias("low"),
        pick("window", "_n").alias("nw"), pick("window", "med").alias("mw"), pick("window", "p90").alias("pw"))
    med, p90 = F.coalesce("mw", "ma"), F.coalesce("pw", "pa")
    low = F.when(F.col("na") >= 5, F.least(F.col("low"), F.coalesce("mw", "low")))
    return w.select(*keys, med.alias("mean"), F.greatest(p90 - med, F.lit(5.0)).alias("stddev"),
                    F.coalesce("nw", F.lit(0)).cast("long").alias("n"), low.alias("low"))


def stand_samples(visits: DataFrame) -> DataFrame:
    """Standing seconds on the pin clock; a pinned pass-through stands 0 s."""
    passed = F.col("outcome") == "passed"
    stopped = (F.col("outcome") == "stopped") & (F.col("departed_at") >= F.col("pinned_at"))
    return visits.where(F.col("pinned_at").isNotNull() & (passed | stopped)).withColumn(
        "stand", F.when(passed, 0.0).otherwise((F.col("departed_at") - F.col("pinned_at")) / 1000))


def drive_samples(legs: DataFrame) -> DataFrame:
    """Departure to pin seconds."""
    end = F.coalesce("to_pinned_at", "arrived_at")
    return legs.where(end > F.col("departed_at")).withColumn("drive", (end - F.col("departed_at")) / 1000)


def _visits(visits: DataFrame, now_ms: int, days: int) -> DataFrame:
    v = _since(visits, "anchored_at", now_ms, days).where(F.col("outcome").isin("stopped", "passed"))
    return available_by(v, now_ms, "visit")


def stop_shares(visits: DataFrame, now_ms: int, by_pass: bool = False, days: int = 30) -> DataFrame:
    """P(stop): pooled counts before dividing (A5)."""
    keys = CELL + (["stop_index"] if by_pass else [])
    stopped = F.sum(F.when(F.col("outcome") == "stopped", 1).otherwise(0))
    return _visits(visits, now_ms, days).groupBy(*keys).agg((stopped / F.count(F.lit(1))).alias("p_stop"), F.count(F.lit(1)).alias("visits"))


def stand_tables(visits: DataFrame, now_ms: int, dwells: DataFrame | None = None, days: int = 30) -> DataFrame:
    """Ten-knot stand table per (route, stop) beside its dwell row; 15/10 s where none (A3)."""
    q = grouped_quantiles(stand_samples(_visits(visits, now_ms, days)), CELL, "stand", {"q": (TEN_KNOTS, "linear")})
    t = q.withColumnRenamed("_n", "qn").join(stop_shares(visits, now_ms, days=days), CELL, "left")
    if dwells is None:
        return t
    return dwells.join(t, CELL, "full").select(
        *CELL, F.coalesce("mean", F.lit(15.0)).alias("mean"), F.coalesce("stddev", F.lit(10.0)).alias("stddev"),
        F.coalesce("n", F.lit(0)).alias("n"), "low", "q", "qn", "p_stop")


def occurrence_stand_tables(visits: DataFrame, route_stops: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Stand table per pass of a stop its route lists more than once (A4)."""
    rep = route_stops.groupBy("route_id", "stop_id").agg(F.count(F.lit(1)).alias("k")).where("k >= 2")
    occ = route_stops.join(rep, CELL, "left_semi").select(*CELL, "stop_index")
    keys = [*CELL, "stop_index"]
    v = stand_samples(_visits(visits, now_ms, days)).join(occ, keys, "left_semi")
    q = grouped_quantiles(v, keys, "stand", {"med": (0.5, "linear"), "p90": (0.9, "linear"), "q": (TEN_KNOTS, "linear")})
    return q.join(stop_shares(visits, now_ms, True, days).drop("visits"), keys, "left").select(
        *keys, F.col("med").alias("mean"), F.greatest(F.col("p90") - F.col("med"), F.lit(5.0)).alias("stddev"),
        F.col("_n").alias("n"), "q", F.col("_n").alias("qn"), "p_stop")


def _legs(legs: DataFrame, now_ms: int, days: int) -> DataFrame:
    return available_by(_since(legs, "departed_at", now_ms, days).where("hops = 1"), now_ms, "leg")


def drive_stats(legs: DataFrame, seg: DataFrame, stops: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Median drive per hop that has a segment row."""
    d = plausible_leg(drive_samples(_legs(legs, now_ms, days)), stops, "drive").join(seg.select(*HOP), HOP, "left_semi")
    q = grouped_quantiles(d, HOP, "drive", {"drive": (0.5, "linear")})
    return q.withColumnRenamed("_n", "drive_n")


def leg_quantiles(legs: DataFrame, seg: DataFrame, stops: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """Ten knots of the whole hop."""
    d = plausible_leg(_legs(legs, now_ms, days).where("leg_sec > 0"), stops).join(seg.select(*HOP), HOP, "left_semi")
    return grouped_quantiles(d, HOP, "leg_sec", {"dq": (TEN_KNOTS, "linear")}).withColumnRenamed("_n", "dqn")


def pace(legs: DataFrame, stops: DataFrame, routes: DataFrame, now_ms: int, leg_metres: DataFrame | None = None, days: int = 30) -> DataFrame:
    """Seconds per road metre per route; routes without legs take the pooled row."""
    d = plausible_leg(_legs(legs, now_ms, days).where("leg_sec > 0"), stops).where("chord_m >= 30")
    road = F.col("chord_m")
    if leg_metres is not None:
        d = d.join(leg_metres.select(*HOP, "road_m"), HOP, "left")
        road = F.coalesce("road_m", "chord_m")
    d = d.withColumn("spm", F.col("leg_sec") / road).where("spm > 0")
    both = d.withColumn("route_id", F.explode(F.array(F.col("route_id"), F.lit(0).cast("long"))))
    q = grouped_quantiles(both, ["route_id"], "spm", {"spm": (TEN_KNOTS, "linear")}).withColumnRenamed("_n", "n")
    own = q.where("route_id <> 0").withColumn("pooled", F.lit(False))
    rest = routes.select("route_id").distinct().join(own, "route_id", "left_anti")
    pool = q.where("route_id = 0").select(F.struct("n", "spm").alias("p"))
    fill = rest.withColumn("p", pool.scalar()).where(F.col("p").isNotNull())
    return own.unionByName(fill.select("route_id", F.col("p.n").alias("n"), F.col("p.spm").alias("spm"), F.lit(True).alias("pooled")))


# --- older tables ---------------------------------------------------------------------------------

ALL_DAYS = -1
MIN_BUS = 5


def _by_day(df: DataFrame) -> DataFrame:
    """Each sample in its weekday and in the all-days row (-1)."""
    return df.withColumn("dow", F.explode(F.array(F.col("day_of_week").cast("int"), F.lit(ALL_DAYS))))


def _v1_segments(st: DataFrame, now_ms: int) -> DataFrame:
    return st.where((F.col("hops") == 1) & F.col("travel_seconds").between(15, 1200) & (F.col("recorded_at") > now_ms - 30 * DAY_MS))


def v1_segment_stats(st: DataFrame, now_ms: int, by_bus: bool = False) -> DataFrame:
    """Hop means by weekday and over all days, population sd."""
    keys = (["bus_name"] if by_bus else []) + HOP + ["dow"]
    x = F.col("travel_seconds")
    g = _by_day(_v1_segments(st, now_ms)).groupBy(*keys).agg(F.avg(x).alias("avg_sec"), F.avg(x * x).alias("_sq"), F.count(F.lit(1)).alias("n"))
    need = F.lit(MIN_BUS) if by_bus else F.when(F.col("dow") == ALL_DAYS, 1).otherwise(2)
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_sq") - F.col("avg_sec") * F.col("avg_sec")))
    return g.where(F.col("n") >= need).withColumn("sd_sec", sd).drop("_sq")


def v1_dwell_stats(d: DataFrame, now_ms: int, by_bus: bool = False) -> DataFrame:
    """Dwell medians by weekday and over all days (A10)."""
    keys = (["bus_name"] if by_bus else []) + CELL + ["dow"]
    s = _by_day(d.where(F.col("dwell_seconds").between(30, 1800) & (F.col("entered_at") > now_ms - 30 * DAY_MS)))
    q = grouped_quantiles(s, keys, "dwell_seconds", {"median_sec": (0.5, "linear")}).withColumnRenamed("_n", "n")
    sd = s.groupBy(*keys).agg(F.stddev_pop("dwell_seconds").alias("sd_sec"))
    return q.where(F.col("n") >= (MIN_BUS if by_bus else 3)).join(sd, keys)


def vehicle_profiles(st: DataFrame, arrivals: DataFrame, now_ms: int) -> DataFrame:
    """Mean leg minutes and mean dwell per (bus, route), 7 days."""
    keys = ["bus_name", "route_id"]
    s = st.where(F.col("recorded_at") > now_ms - 7 * DAY_MS).groupBy(*keys).agg(
        (F.avg("travel_seconds") / 60).alias("avg_loop_min"), F.count(F.lit(1)).alias("n")).where("n >= 3")
    w = arrivals.where((F.col("dwell_sec") > 0) & (F.col("dwell_sec") < 600)).groupBy(*keys).agg(F.avg("dwell_sec").alias("_d"))
    return s.join(w, keys, "left").withColumn("avg_dwell_sec", F.coalesce("_d", F.lit(0.0))).drop("_d")


def expected_segment(samples: DataFrame, history: DataFrame, now_ms: int, min_n: int = 3) -> DataFrame:
    """Expected hop time from the first of ten layers with enough samples, and its label.

    ``samples``: bus_name, HOP, dow, hour. The layers are small aggregates of one pre-aggregation.
    """
    h = _v1_segments(history, now_ms).withColumn("bus", E.norm_bus_name("bus_name", True))
    base = h.groupBy("bus", *HOP, F.col("day_of_week").cast("int").alias("dow"), F.col("hour").cast("int").alias("hour")).agg(
        F.sum("travel_seconds").alias("s"), F.count(F.lit(1)).alias("c"))

    def hours(keys: list[str]) -> DataFrame:
        e = base.groupBy(*keys, "dow", "hour").agg(F.sum("s").alias("s"), F.sum("c").alias("c")).withColumn(
            "o", F.explode(F.array(*[F.lit(i) for i in range(-2, 3)])))
        e = e.withColumn("hour", F.pmod(F.col("hour") + F.col("o"), F.lit(24)))
        return e.groupBy(*keys, "dow", "hour").agg(
            *[F.sum(F.when(F.abs("o") <= w, F.col(x))).alias(f"{x}{w}") for w in (0, 1, 2) for x in ("s", "c")])

    def flat(keys: list[str], need: int) -> DataFrame:
        return base.groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("c").alias("c")).where(F.col("c") >= need)

    out = samples.withColumn("bus", E.norm_bus_name("bus_name", True)).withColumn("dow", F.col("dow").cast("int")).withColumn("hour", F.col("hour").cast("int"))
    layers: list[tuple[Column, Column, str]] = []
    for who, keys in (("bus", ["bus", *HOP]), ("route", HOP)):
        hr = hours(keys).select(*keys, "dow", "hour", F.struct("s0", "c0", "s1", "c1", "s2", "c2").alias(f"{who}_h"))
        out = out.join(hr, [*keys, "dow", "hour"], "left")
        for w in (0, 1, 2):
            layers.append((F.col(f"{who}_h.s{w}"), F.col(f"{who}_h.c{w}"), f"{who}.dow.hr±{w}"))
        day = flat([*keys, "dow"], MIN_BUS if who == "bus" else 2).select(*keys, "dow", F.struct("s", "c").alias(f"{who}_d"))
        anyd = flat(keys, MIN_BUS if who == "bus" else 1).select(*keys, F.struct("s", "c").alias(f"{who}_a"))
        out = out.join(day, [*keys, "dow"], "left").join(anyd, keys, "left")
        layers.append((F.col(f"{who}_d.s"), F.col(f"{who}_d.c"), f"{who}.dow"))
        layers.append((F.col(f"{who}_a.s"), F.col(f"{who}_a.c"), f"{who}.any"))
    hit = F.coalesce(*[F.when(c >= min_n, F.struct((s / c).alias("expected_sec"), F.lit(lab).alias("layer"))) for s, c, lab in layers])
    out = out.withColumn("_hit", hit)
    return out.select(*samples.columns, F.col("_hit.expected_sec").alias("expected_sec"), F.coalesce("_hit.layer", F.lit("none")).alias("layer"))


def bus_pace(st: DataFrame, now_ms: int, dow: int, window_ms: int = 900_000) -> DataFrame:
    """Recent actual over expected per vehicle; the upper median decides."""
    recent = st.where((F.col("recorded_at") > now_ms - window_ms) & (F.col("hops") == 1) & F.col("travel_seconds").between(15, 1200))
    s = recent.select("bus_name", *HOP, "travel_seconds", F.lit(dow).alias("dow"), F.hour(F.timestamp_millis("recorded_at")).alias("hour"))
    e = expected_segment(s, st, now_ms).where("expected_sec > 0").withColumn("bus", E.norm_bus_name("bus_name", True))
    e = e.withColumn("ratio", F.col("travel_seconds") / F.col("expected_sec"))
    q = grouped_quantiles(e, ["bus"], "ratio", {"m": (0.5, "trunc")}).where("_n >= 2")
    lay = e.groupBy("bus", "layer").agg(F.count(F.lit(1)).alias("c")).groupBy("bus").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("layer", "c")))).alias("layers"))
    return q.join(lay, "bus").select("bus", (F.col("m") < 0.80).alias("fast"), (F.col("m") > 1.25).alias("slow"),
                                     F.round("m", 2).alias("ratio"), F.col("_n").alias("n"), "layers")


def recent_skips(st: DataFrame, now_ms: int, window_ms: int = 300_000) -> DataFrame:
    """Latest multi-hop transition per vehicle; equal ages take fewer hops."""
    r = st.where((F.col("recorded_at") > now_ms - window_ms) & (F.col("recorded_at") <= now_ms) & (F.col("hops") > 1))
    r = r.withColumn("ago", F.floor((now_ms - F.col("recorded_at")) / 1000))
    g = r.groupBy(E.norm_bus_name("bus_name", True).alias("bus")).agg(F.min(F.struct("ago", "hops")).alias("m"))
    return g.select("bus", (F.col("m.hops") - 1).alias("skipped"), F.col("m.ago").alias("ago_sec"))


def with_segment_default(edges: DataFrame, seg: DataFrame, stops: DataFrame) -> DataFrame:
    """Calibrated hop, else the distance prior max(20, m / 5.5) with half of it as sd."""
    e = with_chord(edges, stops).join(seg.select(*HOP, F.col("mean").alias("_m"), F.col("stddev").alias("_s"), F.col("n").alias("_n")), HOP, "left")
    prior = F.greatest(F.lit(20.0), F.col("chord_m") / 5.5)
    return e.withColumns({
        "sec": F.coalesce("_m", prior), "sd": F.coalesce(F.when(F.col("_m").isNotNull(), F.col("_s")), prior * 0.5),
        "calibrated": F.col("_m").isNotNull(),
    }).drop("_m", "_s", "_n", "chord_m")


def with_dwell_default(edges: DataFrame, dwell: DataFrame) -> DataFrame:
    d = dwell.select(*CELL, F.col("mean").alias("_m"), F.col("stddev").alias("_s"))
    return edges.join(d, CELL, "left").withColumns(
        {"dwell_sec": F.coalesce("_m", F.lit(15.0)), "dwell_sd": F.coalesce("_s", F.lit(10.0))}).drop("_m", "_s")


#: Steps whose running histogram one task reads off.
ASOF_CELL = 168


def _running_medians(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """The median of the values in force at every step of a cell, for whole (hop, cell) runs.

    Rows are changes of the count of a value: those at the cell's first step hold what is in force before it."""
    route, frm, to, cell, last = (pdf[c].to_numpy(dtype=np.int64) for c in (*HOP, "cell", "last"))
    step, value, w = pdf["step"].to_numpy(dtype=np.int64), pdf["travel_sec"].to_numpy(dtype=float), pdf["w"].to_numpy(dtype=np.int64)
    parts = []
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
        values, place = np.unique(value[a:b], return_inverse=True)
        first, end = cell[a] * ASOF_CELL, min((cell[a] + 1) * ASOF_CELL, last[a] + 1)
        at = np.append(np.flatnonzero(np.diff(step[a:b], prepend=-1)), b - a)
        histogram = np.zeros(len(values), dtype=np.int64)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            np.add.at(histogram, place[i:j], w[a + i : a + j])
            run = np.cumsum(histogram)
            n = int(run[-1])
            begin, stop = max(first, step[a + i]), step[a + j] if j < b - a else end
            if n and begin < stop:
                low, high = values[np.searchsorted(run, [(n - 1) // 2 + 1, n // 2 + 1])]
                s = np.arange(begin, stop)
                parts.append(pd.DataFrame({HOP[0]: route[a], HOP[1]: frm[a], HOP[2]: to[a], "step": s, "prior": (low + high) / 2}))
    return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: pd.Series(dtype="int64") for c in (*HOP, "step")}).assign(prior=pd.Series(dtype="float64"))


def calibrate_asof(segments: DataFrame, stops: DataFrame, step_ms: int = 3_600_000, days: int = 30, k: int = 1) -> DataFrame:
    """The hop table as it stood at every step (M6): only samples completed by then, and begun in the days before, count.

    A sample is two changes of a count: it comes in at one step and goes out at another; equal changes are added up
    first. The weekly slice of a step is read off running sums per (hop, weekday, hour); the median of all values
    off running histograms, which are cut into cells of a week of steps: what is in force at a cell's start is a
    running sum per (hop, value) over cells, so cells are read independently of each other.
    """
    s = plausible_travel(segments, stops).withColumn("done", F.col("started_at") + F.greatest(F.lit(0.0), F.col("travel_sec")) * 1000)
    last = segments.agg(F.max("started_at").alias("m")).select(F.ceil(F.col("m") / step_ms).cast("long")).scalar()
    s = s.withColumn("lo", F.ceil(F.col("done") / step_ms).cast("long")).withColumn("hi", F.least(F.floor((F.col("started_at") + days * DAY_MS) / step_ms).cast("long"), last))
    s = s.where("lo <= hi").withColumn("_e", F.explode(F.array(F.struct(F.col("lo").alias("step"), F.lit(1).alias("w")), F.struct((F.col("hi") + 1).alias("step"), F.lit(-1).alias("w")))))
    ev = materialize(s.groupBy(*HOP, "travel_sec", "dow", "hour", F.col("_e.step").alias("step")).agg(F.sum("_e.w").alias("w")).where("w <> 0"))

    # What is in force: changes by cell, and before each cell the sum of all earlier ones.
    by_value = ev.groupBy(*HOP, "travel_sec", "step").agg(F.sum("w").alias("w")).where("w <> 0").withColumn("cell", F.floor(F.col("step") / ASOF_CELL).cast("long"))
    run = Window.partitionBy(*HOP, "travel_sec").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    net = by_value.groupBy(*HOP, "travel_sec", "cell").agg(F.sum("w").alias("w")).withColumn("w", F.sum("w").over(run))
    until = F.lead("cell").over(Window.partitionBy(*HOP, "travel_sec").orderBy("cell"))
    base = net.withColumn("_to", F.coalesce(until, F.floor(last / ASOF_CELL).cast("long"))).where("w <> 0").withColumn("cell", F.explode(F.when(F.col("_to") > F.col("cell"), F.sequence(F.col("cell") + 1, F.col("_to")))))
    changes = by_value.unionByName(base.select(*HOP, "travel_sec", (F.col("cell") * ASOF_CELL).alias("step"), "w", "cell")).withColumn("last", last)
    medians = materialize(map_runs(changes, [*HOP, "cell"], ["step"], _running_medians, f"{', '.join(f'{c} long' for c in HOP)}, step long, prior double"))

    # The slice of a step: its weekday, its hour and the k hours around it.
    as_of = (F.col("step") * step_ms).cast("long")
    local = F.from_utc_timestamp(F.timestamp_millis(as_of), "America/New_York")
    wanted = medians.select(*HOP, "step", (F.dayofweek(local) - 1).cast("int").alias("dow"), F.explode(F.array(*[F.pmod(F.hour(local) + o, F.lit(24)).cast("int") for o in range(-k, k + 1)])).alias("hour"))
    x = F.col("travel_sec")
    sums = ev.groupBy(*HOP, F.col("dow").cast("int").alias("dow"), F.col("hour").cast("int").alias("hour"), "step").agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * x).alias("sx"), F.sum(F.col("w") * x * x).alias("sxx"))
    both = sums.withColumn("_q", F.lit(0)).unionByName(wanted.withColumn("_q", F.lit(1)), allowMissingColumns=True)
    so_far = Window.partitionBy(*HOP, "dow", "hour").orderBy("step", "_q").rowsBetween(Window.unboundedPreceding, 0)
    both = both.select(*HOP, "step", "_q", *[F.sum(c).over(so_far).alias(c) for c in ("n", "sx", "sxx")]).where("_q = 1")
    st = both.groupBy(*HOP, "step").agg(*[F.coalesce(F.sum(F.when(F.col("n") > 0, F.col(c))), F.lit(0)).alias(c) for c in ("n", "sx", "sxx")])
    n = F.col("n")
    var = F.when(n > 1, (F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1)).otherwise(0.0)
    return medians.join(st, [*HOP, "step"]).select(
        *HOP, as_of.alias("as_of"), F.when(n == 0, F.col("prior")).otherwise((F.col("sx") + SHRINK_K * F.col("prior")) / (n + SHRINK_K)).alias("mean"),
        F.greatest(F.sqrt(F.greatest(var, F.lit(0.0))), F.lit(5.0)).alias("stddev"), "n", "prior")
