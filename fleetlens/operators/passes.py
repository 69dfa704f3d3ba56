"""Visit quality and skipped-stop evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.functions.geo import metres
from fleetlens.operators import scan
from fleetlens.operators.grain import top_n
from fleetlens.operators.ranges import MIN_MS, interval_join, positions_in_window
from fleetlens.operators.topology import next_stop
from fleetlens.session import materialize

SERVED_M = 75.0
SKIPPED_M = 150.0
HOP_MS = 20 * MIN_MS
LOOKBACK_MS = 120 * MIN_MS
BACK_MS = 60 * MIN_MS
FIX_GAP_MS = 60_000
RECENT = 3
MIN_SKIPPED = 2
ALT_M = 500.0


def usable_departure() -> Column:
    return (
        (F.col("outcome") == "stopped") & F.col("departed_at").isNotNull() & (F.col("departed_at") >= F.col("anchored_at"))
        & (F.coalesce("how", F.lit("")) != "gap") & F.coalesce(F.col("departed_at") >= F.col("pinned_at"), F.lit(True))
    )


def annotate_visits(visits: DataFrame) -> DataFrame:
    """Ordered reasons a visit is not a full standing sample, and whether its departure is usable."""
    c = F.col
    notes = [
        (c("outcome") == "passed", "pass-through"), (c("outcome") == "unresolved", "unresolved"), (c("pinned_at").isNull(), "no pin clock"),
        (c("departed_at").isNull(), "no departure"), (c("how") == "gap", "closed across a gap"),
        (c("departed_at") < c("pinned_at"), "departure before pin"), (c("stand_sec") < 0, "negative stand"),
    ]
    return visits.withColumn("quality_notes", F.array_compact(F.array(*[F.when(k, F.lit(t)) for k, t in notes]))).withColumn(
        "usable", F.coalesce(usable_departure(), F.lit(False)))


def with_loop(visits: DataFrame) -> DataFrame:
    """Previous usable departure at the same stop by the same vehicle, and the loop it closes."""
    keys = ["bus_name", "route_id", "stop_id", "stop_index"]
    v = annotate_visits(visits).withColumn("_d", F.when(F.col("usable"), F.col("departed_at")))
    v = scan.carried_last(v, keys, ["anchored_at", "id"], {"prev_departure_at": "_d"})
    prev = F.when(F.col("prev_departure_at") < F.col("anchored_at"), F.col("prev_departure_at"))
    v = v.withColumn("prev_departure_at", prev).drop("_d")
    loop = F.when(F.col("usable") & (F.col("departed_at") > F.col("prev_departure_at")), (F.col("departed_at") - F.col("prev_departure_at")) / 1000)
    return v.withColumn("loop_sec", loop)


def resolve_anchor_returns(visits: DataFrame, ring: DataFrame, stops: DataFrame, pos: DataFrame, hop_ms: int = HOP_MS, gap_ms: int = FIX_GAP_MS,
                           now_ms: int | None = None) -> DataFrame:
    """Visits without excursions of the anchor between two near ones.

    A *head* is a visit that is near, or off the ring, or of unknown distance; what follows up to the
    next head is its tail. Where two heads in a row are near visits one or two places apart, with the
    later place already in the tail, a route through the tail that is no plain approach but comes to
    the same advance, and fixes without a hole lead from the first to within reach of the second, the
    tail goes: all but, between places two apart, the closest visit of the place in between.
    """
    keys, order = ["bus_id", "route_id"], ["anchored_at", "id"]
    places = ring.groupBy("route_id").agg(F.count(F.lit(1)).cast("int").alias("n"), F.collect_set(F.struct("stop_index", "stop_id")).alias("at"))
    v = visits.select("id", "bus_id", "route_id", "stop_id", "stop_index", "anchored_at", "closest_m").join(places, "route_id")
    near = F.coalesce(F.col("closest_m") <= SERVED_M, F.lit(False))
    known = F.array_contains("at", F.struct("stop_index", "stop_id"))
    v = v.withColumn("near", near & known).withColumn("head", near | ~known | F.col("closest_m").isNull()).drop("at")
    v = scan.shifted(v, keys, order, {"after": "anchored_at"}, lead=True)
    v = scan.islands(v.withColumn("head_at", F.when(F.col("head"), F.col("anchored_at"))), keys, order, "head", "stretch")
    # Only what lies within a hop of its head can matter, so tails stay short.
    v = scan.carried_last(v, keys, order, {"since": "head_at"}, strict=False)
    v = materialize(v)
    tails = v.where(~F.col("head") & (F.col("anchored_at") - F.col("since") <= hop_ms)).groupBy(*keys, "stretch").agg(
        F.array_sort(F.collect_list(F.struct("anchored_at", "id", "stop_index", "closest_m"))).alias("tail"))
    heads = v.where("head and near").select(*keys, "stretch", "id", "stop_id", F.col("stop_index").alias("to"), F.col("anchored_at").alias("to_at"), "after", "n")
    firsts = v.where("head and near").select(*keys, (F.col("stretch") + 1).alias("stretch"), F.col("stop_index").alias("from"), F.col("anchored_at").alias("from_at"))
    pair = heads.join(firsts, [*keys, "stretch"]).join(tails.withColumn("stretch", F.col("stretch") + 1), [*keys, "stretch"])
    path = F.concat(F.array("from"), F.transform("tail", lambda t: t["stop_index"]), F.array("to"))
    pair = pair.withColumn("path", path)
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.pmod(F.get("path", i) - F.get("path", i - 1), F.col("n")))
    net = F.aggregate("steps", F.lit(0).cast("long"), lambda a, x: a + F.when(2 * x > F.col("n"), x - F.col("n")).otherwise(x))
    pair = pair.withColumn("steps", steps).withColumn("advance", F.pmod(F.col("to") - F.col("from"), F.col("n"))).where(
        (F.col("to_at") - F.col("from_at") <= hop_ms) & F.col("advance").between(1, 2) & (net == F.col("advance"))
        & F.exists("steps", lambda x: ~x.between(1, 2)) & F.exists("tail", lambda t: t["stop_index"] == F.col("to")))
    end = F.least(F.col("from_at") + hop_ms, F.col("after"), F.lit(now_ms).cast("long"))
    reach = interval_join(pair.join(stops.select("stop_id", "lat", "lon"), "stop_id").select("id", "bus_id", "to_at", end.alias("end"), "lat", "lon"),
                          pos.select("bus_id", "collected_at", F.col("lat").alias("fla"), F.col("lon").alias("flo")), ["bus_id"], "to_at", "end", "collected_at", 10 * 60_000)
    reached = reach.where(metres("fla", "flo", "lat", "lon") <= SERVED_M).groupBy("id").agg(F.min("collected_at").alias("reached_at"))
    pair = pair.join(reached, "id")
    seen = positions_in_window(pair.select(F.col("id").alias("iv_id"), "bus_id", F.col("from_at").alias("from_ms"), F.col("reached_at").alias("to_ms"),
                                           F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon")), pos, tail_ms=0)
    ok = seen.where((F.col("covered") >= 2) & (F.col("max_gap_ms") <= gap_ms)).select(F.col("iv_id").alias("id"))
    mid = F.filter("tail", lambda t: (F.col("advance") == 2) & (F.pmod(t["stop_index"] - F.col("from"), F.col("n")) == 1))
    kept = F.array_min(F.transform(mid, lambda t: F.struct(t["closest_m"], t["anchored_at"], t["id"].alias("id"))))["id"]
    gone = pair.join(ok, "id", "left_semi").withColumn("kept", kept).select("kept", F.explode("tail").alias("t")).where(
        F.col("kept").isNull() | (F.col("t.id") != F.col("kept"))).select(F.col("t.id").alias("id"))
    return visits.select("id", "bus_id", "route_id", "stop_id", "stop_index", "anchored_at", "closest_m").join(gone, "id", "left_anti")


def classify_passes(visits: DataFrame, ring: DataFrame, stops: DataFrame, pos: DataFrame, now_ms: int | None = None, hop_ms: int = HOP_MS,
                    back_ms: int = BACK_MS, fix_gap_ms: int = FIX_GAP_MS) -> DataFrame:
    """Served, skipped or unknown for every forward pass.

    A pass follows a visit one or two places before it. Near enough it is served at once; otherwise
    the next visit one or two places on and the raw fixes between decide. A skip stands only while
    the vehicle is still in service.
    """
    keys = ["bus_id", "route_id"]
    order = ["anchored_at", "id"]
    n = ring.groupBy("route_id").agg(F.count(F.lit(1)).alias("n"))
    v = visits.select("id", "bus_id", "route_id", "stop_id", "stop_index", "anchored_at", "closest_m")
    v = scan.shifted(v, keys, order, {"pi": "stop_index", "pt": "anchored_at"})
    v = materialize(scan.shifted(v, keys, order, {"qi": "stop_index", "qt": "anchored_at"}, lead=True))
    v = v.withColumn("_near_at", F.when(F.col("closest_m") <= SERVED_M, F.col("anchored_at")))
    v = scan.carried_first(v, keys, order, {"next_near": "_near_at"}).join(n, "route_id")
    v = v.join(ring.select("route_id", "stop_index", "stop_id"), ["route_id", "stop_index", "stop_id"], "left_semi")
    back = F.pmod(F.col("stop_index") - F.col("pi"), F.col("n"))
    fwd = F.pmod(F.col("qi") - F.col("stop_index"), F.col("n"))
    v = v.where(back.between(1, 2) & (F.col("anchored_at") - F.col("pt") <= hop_ms))
    served = v.where(F.col("closest_m") <= SERVED_M).select("id", "bus_id", "route_id", "stop_id", F.col("anchored_at").alias("at"), F.lit("served").alias("verdict"))
    rest = v.where((F.col("closest_m") > SERVED_M) & fwd.between(1, 2) & (F.col("qt") - F.col("anchored_at") <= hop_ms)).join(
        stops.select("stop_id", "lat", "lon"), "stop_id").withColumn("iv_id", F.col("id")).withColumn("from_ms", F.col("pt")).withColumn("to_ms", F.col("qt"))
    w = positions_in_window(rest.select("iv_id", "bus_id", "from_ms", "to_ms", "lat", "lon"), pos)
    j = rest.drop("from_ms", "to_ms", "lat", "lon", "bus_id").join(w, "iv_id")
    close = F.coalesce("closest_fix_m", F.lit(1e12))
    verdict = (F.when(close <= SERVED_M, "served").when((F.col("covered") < 2) | (F.col("max_gap_ms") > fix_gap_ms), "unknown")
               .when((F.col("closest_m") >= SKIPPED_M) & (close >= SKIPPED_M), "skipped").otherwise("unknown"))
    j = j.withColumn("verdict", verdict)
    alive = F.coalesce(F.col("next_near") - F.col("anchored_at") <= back_ms, F.lit(False))
    if now_ms is not None:
        last = pos.where(F.col("collected_at").between(now_ms - 120_000, now_ms)).select("bus_id").distinct().withColumn("_live", F.lit(True))
        j = j.join(last, "bus_id", "left")
        alive = alive | ((F.lit(now_ms) - F.col("anchored_at") <= back_ms) & F.coalesce("_live", F.lit(False)))
    j = j.where((F.col("verdict") != "skipped") | alive)
    return served.unionByName(j.select("id", "bus_id", "route_id", "stop_id", F.col("anchored_at").alias("at"), "verdict"))


def stop_skip_notices(passes: DataFrame, ring: DataFrame, stops: DataFrame, now_ms: int, lookback_ms: int = LOOKBACK_MS) -> DataFrame:
    """(Route, stop) pairs whose last three judged passes warn of skipping, with a stop to use instead."""
    p = passes.where((F.col("verdict") != "unknown") & F.col("at").between(now_ms - lookback_ms, now_ms))
    keys = ["route_id", "stop_id"]
    r = top_n(p, keys, [F.col("at").desc(), F.col("id").desc()], RECENT)
    skip = F.col("verdict") == "skipped"
    g = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("of"), F.sum(F.when(skip, 1).otherwise(0)).alias("skipped"), F.max(F.when(skip, F.col("at"))).alias("last_at"),
                             F.max(F.when(F.col("rank") == 1, F.col("verdict"))).alias("latest"))
    flagged = g.where((F.col("of") >= 2) & (F.col("latest") == "skipped") & (F.col("skipped") >= MIN_SKIPPED))
    prev = next_stop(ring).select("route_id", F.col("stop_id").alias("alt"), F.col("next_stop_id").alias("stop_id")).where("alt <> stop_id")
    a = stops.select("stop_id", F.col("lat").alias("la"), F.col("lon").alias("lo"))
    b = stops.select(F.col("stop_id").alias("alt"), F.col("lat").alias("lb"), F.col("lon").alias("lob"))
    ok = g.where("latest = 'served'").select("route_id", F.col("stop_id").alias("alt"))
    cand = flagged.select(*keys).join(prev, keys).join(ok, ["route_id", "alt"], "left_semi").join(a, "stop_id").join(b, "alt").withColumn("m", metres("la", "lo", "lb", "lob"))
    best = cand.where(F.col("m") <= ALT_M).groupBy(*keys).agg(F.min_by("alt", F.struct("m", "alt")).alias("alt"))
    return flagged.join(best, keys, "left").select(*keys, "skipped", "of", "last_at", "alt")


def visit_catalog(visits: DataFrame, ring: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    """Visits per local day and per stop occurrence, with the current-topology flag."""
    v = visits.where(F.col("anchored_at") <= now_ms).withColumn("day", clock.local_day("anchored_at")).where(
        F.col("day") > F.date_sub(clock.local_day(F.lit(now_ms)), days))
    per_day = v.groupBy("day").agg(F.count(F.lit(1)).alias("visits")).withColumn("grain", F.lit("day"))
    occ = v.groupBy("route_id", "stop_id", "stop_index").agg(F.count(F.lit(1)).alias("visits")).withColumn("grain", F.lit("occurrence"))
    cur = ring.select("route_id", "stop_id", "stop_index").withColumn("current", F.lit(True))
    occ = occ.join(cur, ["route_id", "stop_id", "stop_index"], "left").withColumn("current", F.coalesce("current", F.lit(False)))
    return per_day.unionByName(occ, allowMissingColumns=True)


def data_edges(visits: DataFrame, pos: DataFrame) -> DataFrame:
    """First and last instant held of visits and positions."""
    a = visits.agg(F.min("anchored_at").alias("lo"), F.max("anchored_at").alias("hi")).select(F.lit("visits").alias("table_name"), "lo", "hi")
    return a.unionByName(pos.agg(F.min("collected_at").alias("lo"), F.max("collected_at").alias("hi")).select(F.lit("positions").alias("table_name"), "lo", "hi"))
