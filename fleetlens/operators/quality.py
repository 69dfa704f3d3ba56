"""Studies of telemetry and feed quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import clock
from fleetlens.functions import exprs as E
from fleetlens.functions.geo import angle_between, bearing, metres, point_to_segment
from fleetlens.functions.quantiles import grouped_quantiles
from fleetlens.operators import scan
from fleetlens.operators.asof import asof_prev, truth_join
from fleetlens.operators.calibrate import HOP, plausible_travel
from fleetlens.operators.ranges import MIN_MS, interval_join
from fleetlens.operators.sequence import T_ORDER, TRACK, proximity_arrivals, still_runs
from fleetlens.operators.topology import ring_arrays
from fleetlens.session import materialize


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def _share(c: Column) -> Column:
    return F.avg(F.when(c, 1.0).otherwise(0.0))


def schemes() -> dict[str, Column]:
    """Ways to bin a departure; ``random`` is a control with as many bins as hours."""
    h, d = F.col("hour"), F.col("dow")
    return {
        "hour": h.cast("string"), "dow": d.cast("string"), "weekend": d.isin(0, 6).cast("string"),
        "peak": F.when(h.between(7, 9), "am").when(h.between(16, 18), "pm").otherwise("off"),
        "dow_hour": F.concat_ws("-", d.cast("string"), h.cast("string")), "random": F.pmod(F.xxhash64("id"), F.lit(24)).cast("string"),
    }


def variance_explained(segments: DataFrame, stops: DataFrame, min_n: int = 200, only: list[str] | None = None) -> DataFrame:
    """R2 and omega2 of travel time by each binning, pooled over well-sampled hops.

    One pass gives n, sum and sum of squares per (hop, scheme, bin); everything else is small.
    """
    sc = {k: v for k, v in schemes().items() if only is None or k in only}
    s = plausible_travel(segments, stops)
    x = s.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(k).alias("scheme"), v.alias("bin")) for k, v in sc.items()])))
    b = x.groupBy(*HOP, F.col("_x.scheme").alias("scheme"), F.col("_x.bin").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("travel_sec").alias("s"), F.sum(F.col("travel_sec") * F.col("travel_sec")).alias("ss"))
    h = b.groupBy(*HOP, "scheme").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("between"), F.count(F.lit(1)).alias("k"))
    h = h.where(F.col("n") >= min_n)
    corr = F.col("s") * F.col("s") / F.col("n")
    p = h.groupBy("scheme").agg(F.sum(F.col("ss") - corr).alias("tot"), F.sum(F.col("between") - corr).alias("bet"), F.sum(F.col("k") - 1).alias("dfb"), F.sum(F.col("n") - F.col("k")).alias("dfw"), F.count(F.lit(1)).alias("hops"))
    msw = (F.col("tot") - F.col("bet")) / F.col("dfw")
    return p.select("scheme", "hops", (F.col("bet") / F.col("tot")).alias("r2"), ((F.col("bet") - F.col("dfb") * msw) / (F.col("tot") + msw)).alias("omega2"))


def hop_anatomy(pos: DataFrame, segments: DataFrame, ring: DataFrame, zone_m: float = 75.0) -> DataFrame:
    """Seconds of each hop at a stop, held elsewhere, driving and unseen.

    A step between fixes belongs to the first fix's state; steps are short, so each meets its hop
    through time cells. Seconds no fix covers are unseen; under half unseen, the rest is scaled up.
    """
    st = still_runs(pos).join(ring_arrays(ring), "route_id")
    at = F.exists("ring", lambda s: metres(F.col("lat"), F.col("lon"), s["lat"], s["lon"]) <= zone_m)
    st = st.withColumn("state", F.when(F.col("still") & at, "dwell").when(F.col("still"), "hold").otherwise("drive")).drop("ring")
    st = scan.shifted_near(st, TRACK, T_ORDER, {"nt": "collected_at"}, 60_000, lead=True).where(F.col("nt") - F.col("collected_at") <= 60_000)
    s = segments.select(F.col("id").alias("seg_id"), "bus_name", *HOP, F.col("started_at").alias("lo"), (F.col("started_at") + F.col("travel_sec") * 1000).cast("long").alias("hi"), "travel_sec")
    cell = 30 * MIN_MS
    a = s.withColumn("_c", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    b = st.select("bus_name", "state", F.col("collected_at").alias("a"), F.col("nt").alias("b")).withColumn("_c", F.explode(F.array_distinct(F.array(F.floor(F.col("a") / cell), F.floor(F.col("b") / cell)))))
    lo, hi = F.greatest("lo", "a"), F.least("hi", "b")
    j = a.join(b, ["bus_name", "_c"]).where((hi > lo) & (F.floor(lo / cell) == F.col("_c"))).withColumn("sec", (hi - lo) / 1000)
    g = j.groupBy("seg_id").agg(*[F.coalesce(F.sum(F.when(F.col("state") == k, F.col("sec"))), F.lit(0.0)).alias(k) for k in ("dwell", "hold", "drive")])
    d = s.drop("lo", "hi").join(g, "seg_id", "left").fillna(0.0, ["dwell", "hold", "drive"])
    seen = F.col("dwell") + F.col("hold") + F.col("drive")
    d = d.withColumn("unknown", F.greatest(F.lit(0.0), F.col("travel_sec") - seen)).withColumn("_k", F.when((seen > 0) & (F.col("unknown") < 0.5 * F.col("travel_sec")), F.col("travel_sec") / seen).otherwise(1.0))
    return d.select("seg_id", *HOP, "travel_sec", *[(F.col(k) * F.col("_k")).alias(k) for k in ("dwell", "hold", "drive")], F.when(F.col("_k") == 1.0, F.col("unknown")).otherwise(0.0).alias("unknown"))


def time_budget(anatomy: DataFrame) -> DataFrame:
    """Share of total time and of its variance each part accounts for."""
    parts = ("dwell", "hold", "drive", "unknown")
    x = anatomy.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("sec")) for p in parts]))).select("travel_sec", "_x.*")
    return x.groupBy("part").agg((F.sum("sec") / F.sum("travel_sec")).alias("time_share"), (F.covar_samp("sec", "travel_sec") / F.var_samp("travel_sec")).alias("variance_share"), F.count(F.lit(1)).alias("hops"))


def hold_signal(chains: DataFrame, dwells: DataFrame, back: int = 3, fwd: int = 2) -> DataFrame:
    """Does running long at the last stops foretell the next ones (A34)?

    Ratios of actual to expected dwell over the previous ``back`` and next ``fwd`` stops of a chain,
    bucketed, with each next pair's own mean taken out. ``dwells``: route_id, stop_id, mean. A chain is
    one vehicle's hole-free forward run.
    """
    d = chains.join(dwells.select("route_id", "stop_id", F.col("mean").alias("exp")), ["route_id", "stop_id"]).where(F.col("dwell_sec").isNotNull() & (F.col("exp") > 0))
    w = Window.partitionBy("route_id", "bus_name", "stretch", "chain").orderBy("seq")
    s = lambda c, a, b: F.sum(c).over(w.rowsBetween(a, b))
    d = d.withColumn("pb", s("dwell_sec", -back, -1) / s("exp", -back, -1)).withColumn("nf", s("dwell_sec", 1, fwd) / s("exp", 1, fwd)).withColumn("kb", F.count(F.lit(1)).over(w.rowsBetween(-back, -1))).withColumn(
        "kf", F.count(F.lit(1)).over(w.rowsBetween(1, fwd)))
    d = d.where((F.col("kb") == back) & (F.col("kf") == fwd))
    m = d.groupBy("route_id", "stop_id").agg(F.avg("nf").alias("m"))
    d = d.join(m, ["route_id", "stop_id"]).withColumn("bucket", F.when(F.col("pb") < 0.5, "<0.5").when(F.col("pb") < 0.8, "0.5-0.8").when(F.col("pb") < 1.25, "0.8-1.25").when(F.col("pb") < 2, "1.25-2").otherwise(">=2"))
    return d.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("pb").alias("mean_prev"), F.avg("nf").alias("mean_next"), F.avg(F.col("nf") - F.col("m")).alias("next_demeaned"))


def emission_rates(pos: DataFrame, ring: DataFrame, zone_m: float = 75.0, gap_ms: int = 60_000) -> DataFrame:
    """How often the feed repeats a fix standing, moving and moving near a stop; hold hazards."""
    st = still_runs(pos).join(ring_arrays(ring), "route_id", "left")
    near = F.coalesce(F.exists("ring", lambda s: metres(F.col("lat"), F.col("lon"), s["lat"], s["lon"]) <= zone_m), F.lit(False))
    st = st.withColumn("zone", near).drop("ring")
    d = scan.shifted_near(st, TRACK, T_ORDER, {"nt": "collected_at", "nla": "lat", "nlo": "lon", "ns": "still"}, gap_ms, lead=True)
    d = d.where((F.col("nt") > F.col("collected_at")) & (F.col("nt") - F.col("collected_at") <= gap_ms))
    froz = (F.col("lat") == F.col("nla")) & (F.col("lon") == F.col("nlo"))
    s, sec = F.col("still"), (F.col("nt") - F.col("collected_at")) / 1000
    g = d.agg(_n(s).alias("sp"), _n(s & froz).alias("sf"), _n(~s).alias("mp"), _n(~s & froz).alias("mf"), _n(~s & F.col("zone")).alias("zp"), _n(~s & F.col("zone") & froz).alias("zf"),
              _n(~s & F.col("ns")).alias("to_stand"), _n(s & ~F.col("ns")).alias("to_move"), F.sum(F.when(~s, sec).otherwise(0.0)).alias("ms"), F.sum(F.when(s, sec).otherwise(0.0)).alias("ss"))
    r = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return g.select(r("sf", "sp").alias("p_repeat_stand"), r("mf", "mp").alias("p_repeat_move"), r("zf", "zp").alias("p_repeat_move_zone"), r("to_stand", "ms").alias("hold_enter_per_s"),
                    r("to_move", "ss").alias("hold_leave_per_s"), F.col("sp").alias("stand_pairs"), F.col("mp").alias("move_pairs"))


def visit_rates(visits: DataFrame) -> DataFrame:
    """Shuffles per poll at rest and the chance a fresh fix is a departure."""
    v = visits.where((F.col("outcome") == "stopped") & (F.col("rest_polls") > 0))
    g = v.agg(F.count(F.lit(1)).alias("stopped"), F.coalesce(F.sum("shuffles"), F.lit(0)).alias("sh"), F.coalesce(F.sum("rest_polls"), F.lit(0)).alias("rp"))
    return g.select("stopped", F.when(F.col("rp") > 0, F.col("sh") / F.col("rp")).alias("shuffle_per_poll"), F.when(F.col("stopped") + F.col("sh") > 0, F.col("stopped") / (F.col("stopped") + F.col("sh"))).alias("p_depart_on_fresh"))


def feed_priors(pos: DataFrame, ring: DataFrame) -> DataFrame:
    """Reported last stop against the nearest place, by fresh and frozen fix."""
    from fleetlens.operators.topology import nearest_stop

    n = nearest_stop(pos, ring)
    d = scan.shifted(n, TRACK, T_ORDER, {"pla": "lat", "plo": "lon", "pt": "collected_at"}, cell_ms=scan.HOUR_MS).where("pt IS NOT NULL")
    last = ring.groupBy("route_id", F.col("stop_id").alias("last_stop_id")).agg(F.min("stop_index").alias("li"), F.first("ring_size").alias("n"))
    d = d.join(last, ["route_id", "last_stop_id"], "left")
    off = F.pmod(F.col("near_index") - F.col("li"), F.col("n"))
    fresh = ~(F.col("lat").eqNullSafe(F.col("pla")) & F.col("lon").eqNullSafe(F.col("plo")))
    step = F.try_divide(metres("pla", "plo", "lat", "lon"), (F.col("collected_at") - F.col("pt")) / 1000)  # two fixes of one instant have no speed
    g = d.withColumn("fix", F.when(fresh, "fresh").otherwise("frozen")).withColumn("ahead", F.coalesce(off.cast("string"), F.lit("off-route")))
    return g.groupBy("fix", "ahead").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("collected_at") - F.col("pt") <= 60_000, step)).alias("mean_mps"))


def score_official(rows: DataFrame, visits: DataFrame, pos: DataFrame, seen_ms: int = 600_000) -> DataFrame:
    """Official promises by horizon and route: arrived, standing, missing, and missing because the
    vehicle left the feed (A47). ``rows``: id, bus, route_id, stop_id, at, sec."""
    from fleetlens.operators.scoring import truth_visits

    j = truth_join(rows, truth_visits(visits), ["bus", "route_id", "stop_id"], at="at", tie="visit_id").withColumn("horizon", E.horizon("sec")).where(F.col("horizon").isNotNull())
    last = asof_prev(j.where("truth = 'missing'").select("id", "bus", (F.col("at") + 45 * MIN_MS).alias("until")), pos.select(E.norm_bus_name("bus_name").alias("bus"), "collected_at"), ["bus"], "until", "collected_at",
                     seen_ms).select("id", F.col("prev").isNotNull().alias("_seen"))
    j = j.join(last, "id", "left").withColumn("err", F.when(F.col("truth") == "arrived", F.col("sec") - (F.col("actual_at") - F.col("at")) / 1000))
    j = j.withColumn("route_id", F.explode(F.array(F.col("route_id"), F.lit(0).cast("long")))).withColumn("horizon", F.explode(F.array("horizon", F.lit("all"))))
    k = ["route_id", "horizon"]
    g = j.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), _n(F.col("truth") == "standing").alias("standing"), _n(F.col("truth") == "missing").alias("missing"),
                          _n((F.col("truth") == "missing") & ~F.coalesce("_seen", F.lit(False))).alias("vanished"), F.count("err").alias("paired"), F.avg("err").alias("bias_sec"))
    q = grouped_quantiles(j.withColumn("a", F.abs("err")), k, "a", {"median_abs_sec": (0.5, "linear"), "p90_abs_sec": (0.9, "linear")}).drop("_n")
    return g.join(q, k, "left")


def summarise_waits(waits: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Outcome shares, first-sight miss, interval share and the shares of riders misled."""
    w = waits.withColumn("k", F.lit("all")) if not keys else waits
    ks = list(keys) or ["k"]
    g = w.groupBy(*ks).agg(F.count(F.lit(1)).alias("waits"), _share(F.col("outcome") == "boarded").alias("boarded"), _share(F.col("outcome") == "missed").alias("missed"),
                           _share(F.col("outcome") == "gave_up").alias("gave_up"), _share(F.col("interval_held")).alias("interval_held"), _share(F.col("jumped")).alias("jumped"),
                           _share(F.col("reversed")).alias("reversed"), _share(F.col("stranded")).alias("stranded"))
    x = w.withColumn("_x", F.explode(F.array(F.struct(F.lit("miss").alias("m"), F.abs("first_miss_sec").alias("v")), F.struct(F.lit("drift").alias("m"), F.col("worst_drift_sec").alias("v"))))).select(*ks, "_x.*")
    q = grouped_quantiles(x, [*ks, "m"], "v", {"p50": (0.5, "linear"), "p90": (0.9, "linear")}).groupBy(*ks).agg(
        F.max(F.when(F.col("m") == "miss", F.col("p50"))).alias("first_miss_p50"), F.max(F.when(F.col("m") == "miss", F.col("p90"))).alias("first_miss_p90"), F.max(F.when(F.col("m") == "drift", F.col("p90"))).alias("drift_p90"))
    return g.join(q, ks)


def band_coverage(pairs: DataFrame, truth: str = "det") -> DataFrame:
    """Share of truths inside the shown band and its width, by route and horizon."""
    p = pairs.where(F.col(truth).isNotNull()).withColumn("h", E.horizon("eta")).where(F.col("h").isNotNull())
    t = F.col(truth)
    b = p.groupBy("r", "h").agg(F.count(F.lit(1)).alias("n"), _n(t.between(F.col("low"), F.col("high"))).alias("i"), _n(t < F.col("low")).alias("b"), _n(t > F.col("high")).alias("a"), F.sum(F.col("high") - F.col("low")).alias("w"))
    x = b.withColumn("route", F.explode(F.array(F.col("r"), F.lit(0).cast("long")))).withColumn("horizon", F.explode(F.array("h", F.lit("all")))).groupBy("route", "horizon").agg(*[F.sum(c).alias(c) for c in "nibaw"])
    n = F.col("n")
    return x.select("route", "horizon", "n", (F.col("i") / n).alias("covered"), (F.col("b") / n).alias("early"), (F.col("a") / n).alias("late"), (F.col("w") / n).alias("width_sec"))


def baseline_stops(visits: DataFrame) -> DataFrame:
    """Per stop: visits, P(stop), mean stand and its correlation with the leader's headway."""
    v = scan.shifted(visits, ["route_id", "stop_id"], ["arrived_at", "id"], {"lead_at": "departed_at"})
    v = v.withColumn("headway", (F.col("arrived_at") - F.col("lead_at")) / 1000)
    st = F.when(F.col("outcome") == "stopped", F.col("stand_sec"))
    return v.groupBy("route_id", "stop_id").agg(F.count(F.lit(1)).alias("visits"), (_n(F.col("outcome") == "stopped") / F.greatest(F.lit(1), _n(F.col("outcome").isin("stopped", "passed")))).alias("p_stop"),
                                                F.avg(st).alias("mean_stand"), F.corr("headway", st).alias("headway_corr"))


def baseline_hops(legs: DataFrame) -> DataFrame:
    """Per hop: legs and mean split."""
    return legs.groupBy(*HOP).agg(F.count(F.lit(1)).alias("legs"), F.avg("leg_sec").alias("leg_sec"), F.avg("hold_sec").alias("hold_sec"), F.avg("drive_sec").alias("drive_sec"))


#: One moment of a vehicle per stride; rows of the feed's cycle around it; seconds beyond which the feed lists nothing.
STRIDE_MS, CYCLE_BACK_MS, CYCLE_AHEAD_MS, LISTED_SEC = 15_000, 37_500, 7_500, 1800.0


def leg_inference(pos: DataFrame, feed: DataFrame, ring: DataFrame, hops: DataFrame, near_m: float = 150.0) -> DataFrame:
    """Which of several legs near a fix does the feed's set of promises fit (A55)?

    ``feed``: bus, stop_id, at, sec. ``ring`` may carry ``focus`` (a stop polled every cycle). ``hops``: route_id,
    stop_index, sec (of the leg that begins there), stand (at that stop). A moment is ambiguous where two legs or more
    pass within ``near_m``. A leg prices every stop ahead from its middle; a promise costs what it differs, a focus stop
    that is not listed what is left of half an hour. Beside it: the leg nearest by its segment, and the one whose bearing agrees
    with the heading. Legs and their seconds to every stop ahead are tables of a route's size, made once and joined to the moments."""
    r = ring if "focus" in ring.columns else ring.withColumn("focus", F.lit(False))
    h = r.join(hops, ["route_id", "stop_index"]).groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "stop_id", "lat", "lon", "sec", "stand", "focus"))).alias("ring"))
    h = materialize(h.withColumn("n", F.size("ring")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))))
    at = lambda i: F.get("ring", F.pmod(i, F.col("n")).cast("int"))
    # Seconds from the middle of leg i to each stop ahead: tens of stops squared for a route.
    t = h.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    here, stop = at(F.col("i") + F.col("k") - 1), at(F.col("i") + F.col("k"))
    step = F.when(F.col("k") == 1, here["sec"] / 2).otherwise(here["stand"] + here["sec"])
    t = t.withColumn("t", F.sum(step).over(Window.partitionBy("route_id", "i").orderBy("k"))).withColumn("stop", stop)
    t = t.groupBy("route_id", "i").agg(F.array_sort(F.collect_list(F.struct("k", "stop.stop_id", "stop.focus", "t"))).alias("ahead"))
    t = materialize(t.groupBy("route_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "ahead"))).alias("times")))

    a, b = at(F.col("i")), at(F.col("i") + 1)
    ends = h.select("route_id", F.struct("i", a["lat"].alias("alat"), a["lon"].alias("alon"), b["lat"].alias("blat"), b["lon"].alias("blon"), bearing(a["lat"], a["lon"], b["lat"], b["lon"]).alias("way")).alias("e"))
    ends = materialize(ends.groupBy("route_id").agg(F.array_sort(F.collect_list("e")).alias("ends")))
    key = F.struct("collected_at", "ingest_seq")
    p = pos.withColumn("_s", F.floor(F.col("collected_at") / STRIDE_MS)).groupBy("bus_name", "route_id", "_s").agg(F.min_by(F.struct("ingest_seq", "collected_at", "lat", "lon", "heading"), key).alias("p"))
    p = p.select("bus_name", "route_id", "p.*").join(ends, "route_id").withColumn("_east", F.cos(F.radians("lat")) * 111_320.0)
    x = lambda lon: (lon - F.col("lon")) * F.col("_east")
    y = lambda lat: (lat - F.col("lat")) * 111_320.0
    # One step after the other over structs: a single expression repeats its parts until the JVM no longer compiles it.
    legs = F.transform("ends", lambda e: F.struct(e["i"].alias("i"), e["way"].alias("way"), x(e["alon"]).alias("ax"), y(e["alat"]).alias("ay"), x(e["blon"]).alias("bx"), y(e["blat"]).alias("by")))
    legs = F.transform(legs, lambda e: F.struct(e["i"].alias("i"), e["way"].alias("way"), e["ax"].alias("ax"), e["ay"].alias("ay"), e["bx"].alias("bx"), e["by"].alias("by"),
                                                point_to_segment(F.lit(0.0), F.lit(0.0), e["ax"], e["ay"], e["bx"], e["by"])[1].alias("t")))
    legs = F.transform(legs, lambda e: F.struct(e["i"].alias("i"), e["way"].alias("way"), (0.0 - (e["ax"] + e["t"] * (e["bx"] - e["ax"]))).alias("ex"), (0.0 - (e["ay"] + e["t"] * (e["by"] - e["ay"]))).alias("ey")))
    legs = F.transform(legs, lambda e: F.struct(e["i"].alias("i"), F.sqrt(e["ex"] * e["ex"] + e["ey"] * e["ey"]).alias("d"), angle_between(F.col("heading"), e["way"]).alias("turn")))
    # Through explode, as a filter on a plain column would compute its expression a second time.
    p = p.withColumn("legs", F.explode(F.array(F.filter(legs, lambda e: e["d"] <= near_m))))
    p = materialize(p.where(F.size("legs") >= 2).select("bus_name", "route_id", "ingest_seq", "collected_at", "legs"))
    iv = p.select(E.norm_bus_name("bus_name").alias("bus"), "ingest_seq", (F.col("collected_at") - CYCLE_BACK_MS).alias("lo"), (F.col("collected_at") + CYCLE_AHEAD_MS).alias("hi"))
    j = interval_join(iv, feed.select("bus", "stop_id", F.col("at").alias("row_at"), "sec"), ["bus"], "lo", "hi", "row_at", 60_000)
    seen = j.groupBy("ingest_seq", "stop_id").agg(F.max(F.struct("row_at", "sec")).alias("u")).groupBy("ingest_seq").agg(F.map_from_entries(F.collect_list(F.struct("stop_id", "u.sec"))).alias("seen"))

    def cost(i: Column) -> Column:
        def add(acc, x):
            told = F.try_element_at("seen", x["stop_id"])
            return acc + F.when(told.isNotNull(), F.abs(told - x["t"])).when(x["focus"], F.greatest(F.lit(0.0), LISTED_SEC - x["t"])).otherwise(0.0)

        return F.aggregate(F.try_element_at("times", i), F.lit(0.0), add)

    q = p.join(seen, "ingest_seq").join(t, "route_id")
    least = lambda f: F.array_min(F.transform("legs", lambda x: F.struct(F.round(f(x), 6).alias("v"), x["i"].alias("i"))))["i"]
    return q.select("bus_name", "route_id", "ingest_seq", "collected_at", F.transform("legs", lambda x: x["i"]).alias("legs"), least(lambda x: cost(x["i"])).alias("inferred"),
                    least(lambda x: x["d"]).alias("nearest"), least(lambda x: x["turn"]).alias("heading"))


def fold_leg_agreement(inferred: DataFrame, truth_legs: DataFrame) -> DataFrame:
    """How often each way names the leg that the vehicle was on (A55). ``truth_legs``: bus_name, from_index, lo, hi."""
    t = interval_join(truth_legs, inferred, ["bus_name"], "lo", "hi", "collected_at", 30 * MIN_MS).where(F.array_contains("legs", F.col("from_index").cast("int")))
    return t.agg(F.count(F.lit(1)).alias("moments"), *[F.coalesce(_n(F.col(c) == F.col("from_index")), F.lit(0)).alias(f"{c}_right") for c in ("inferred", "nearest", "heading")])


def heading_agreement(pos: DataFrame, min_m: float = 10.0) -> DataFrame:
    """Angle between the reported heading and the travel before and after, by fresh and frozen fix."""
    d = scan.shifted(pos, TRACK, T_ORDER, {"pla": "lat", "plo": "lon", "pt": "collected_at"}, cell_ms=scan.HOUR_MS)
    d = scan.shifted(d, TRACK, T_ORDER, {"nla": "lat", "nlo": "lon", "nt": "collected_at"}, cell_ms=scan.HOUR_MS, lead=True)
    okp = (F.col("collected_at") - F.col("pt") <= 60_000) & (metres("pla", "plo", "lat", "lon") >= min_m)
    okn = (F.col("nt") - F.col("collected_at") <= 60_000) & (metres("lat", "lon", "nla", "nlo") >= min_m)
    fresh = ~((F.col("lat") == F.col("pla")) & (F.col("lon") == F.col("plo")))
    x = d.withColumn("fix", F.when(F.coalesce(fresh, F.lit(True)), "fresh").otherwise("frozen")).withColumn("_x", F.explode(F.array(
        F.struct(F.lit("previous").alias("side"), F.when(okp, angle_between(F.col("heading"), bearing("pla", "plo", "lat", "lon"))).alias("deg")),
        F.struct(F.lit("next").alias("side"), F.when(okn, angle_between(F.col("heading"), bearing("lat", "lon", "nla", "nlo"))).alias("deg"))))).select("fix", "_x.*").where("deg IS NOT NULL")
    q = grouped_quantiles(x, ["fix", "side"], "deg", {"p50": (0.5, "linear"), "p90": (0.9, "linear")})
    s = x.groupBy("fix", "side").agg(_share(F.col("deg") <= 45).alias("within45"), _share(F.col("deg") >= 135).alias("against"))
    return q.withColumnRenamed("_n", "n").join(s, ["fix", "side"])


def fold_frames(pos: DataFrame, ring: DataFrame, near_m: float = 60.0) -> DataFrame:
    """Share of fixes near two places of the ring that are not neighbours."""
    j = pos.join(ring_arrays(ring), "route_id")
    n = F.size("ring")
    near = F.transform(F.filter("ring", lambda s: metres(F.col("lat"), F.col("lon"), s["lat"], s["lon"]) <= near_m), lambda s: s["stop_index"])
    # The near places are bound once: named inside, they would be sought again for each of them.
    fold = F.exists(F.array(near), lambda x: F.exists(x, lambda a: F.exists(x, lambda b: F.least(F.pmod(b - a, n), F.pmod(a - b, n)) >= 2)))
    return j.groupBy("route_id").agg(F.count(F.lit(1)).alias("fixes"), _n(fold).alias("fold_frames"))


def curb_vs_feed(pos: DataFrame, ring: DataFrame, window_ms: int = 120_000) -> DataFrame:
    """Curb visits the reported last stop does not confirm, and flips with no fix at the curb.

    A curb visit and a flip to its stop confirm each other if the flip is at most ``window_ms`` before it and five
    minutes after: both lie in one order of a (vehicle, stop, cell), where the nearest of the other kind tells."""
    curb = proximity_arrivals(pos, ring, enter_m=45.0).select("bus_name", "stop_id", F.col("entered_at").cast("long").alias("at"), F.lit(True).alias("curb"))
    flips = last_stop_flips(pos).select("bus_name", "stop_id", F.col("ft").alias("at"), F.lit(False).alias("curb"))
    # Seen from the middle of its interval, a visit reaches equally far both ways.
    reach = (300_000 + window_ms) // 2
    cell = 30 * MIN_MS
    d = curb.unionByName(flips).withColumn("at", F.col("at") + F.when(F.col("curb"), 300_000 - reach).otherwise(0))
    home = F.floor(F.col("at") / cell)
    d = d.withColumn("_cell", F.explode(F.array_distinct(F.array(*[F.floor((F.col("at") + o) / cell) for o in (-reach, reach)]))))
    w = Window.partitionBy("bus_name", "stop_id", "_cell").orderBy("at")
    def nearest(kind: Column) -> Column:
        """Whether one of ``kind`` is within reach; rows of one instant all count."""
        at = F.when(kind, F.col("at"))
        last, nxt = F.max(at).over(w.rangeBetween(Window.unboundedPreceding, 0)), F.min(at).over(w.rangeBetween(0, Window.unboundedFollowing))
        return F.coalesce(F.col("at") - last <= reach, F.lit(False)) | F.coalesce(nxt - F.col("at") <= reach, F.lit(False))

    d = d.withColumns({"_c": nearest(F.col("curb")), "_f": nearest(~F.col("curb"))}).where(F.col("_cell") == home)
    named = F.col("bus_name").isNotNull()  # a vehicle without a name meets none
    return d.groupBy("stop_id").agg(_n(F.col("curb")).alias("curb_visits"), _n(F.col("curb") & ~(F.col("_f") & named)).alias("unconfirmed"),
                                    _n(~F.col("curb")).alias("flips"), _n(~F.col("curb") & ~(F.col("_c") & named)).alias("no_fix"))


def last_stop_flips(pos: DataFrame) -> DataFrame:
    """(bus_name, stop_id, ft): fixes whose reported last stop is another than that of the fix before.

    Fixes move once, to their (vehicle, day); only a day's first and last meet those of other days."""
    d = scan.with_cell(pos.select("bus_name", "collected_at", "ingest_seq", "last_stop_id"), "collected_at", scan.DAY_MS)
    w = Window.partitionBy(*TRACK, scan.CELL).orderBy(*T_ORDER)
    d = d.withColumns({"_p": F.lag(F.struct("last_stop_id")).over(w), "_last": F.lead(F.lit(1)).over(w).isNull()})
    turn = lambda before: F.coalesce(before != F.col("last_stop_id"), F.lit(False))
    edge = F.col("_p").isNull() | F.col("_last")
    d = d.where(edge | turn(F.col("_p.last_stop_id"))).withColumn("_apart", F.when(~edge, F.col(scan.CELL)))
    d = d.withColumn("_e", F.lag("last_stop_id").over(Window.partitionBy(*TRACK, "_apart").orderBy(*T_ORDER)))
    before = F.when(F.col("_p").isNull(), F.col("_e")).otherwise(F.col("_p.last_stop_id"))
    return d.where(turn(before)).select("bus_name", F.col("last_stop_id").alias("stop_id"), F.col("collected_at").alias("ft"))


def service_days(pos: DataFrame) -> DataFrame:
    """Vehicles and fixes per 04:00 service day."""
    return pos.groupBy(clock.service_day("collected_at").alias("service_day")).agg(F.count_distinct("bus_name").alias("vehicles"), F.count(F.lit(1)).alias("fixes"))
