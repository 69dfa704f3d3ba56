"""Chain arrival times, journeys and trip candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import exprs as E
from fleetlens.functions.geo import metres
from fleetlens.operators.calibrate import with_dwell_default, with_segment_default
from fleetlens.operators.topology import next_stop, stops_near

WALK_MPS = 1.1
Z90 = 1.645


def _saves(walk, direct):
    """A ride must spare enough walking to be worth offering."""
    return (direct > 0) & (direct - walk >= F.least(direct * 0.2, F.greatest(F.lit(120.0), direct * 0.1)))


def shown_minutes(sec):
    """What a countdown prints: now (0), under a minute (0.5), else whole minutes."""
    return F.when(sec < 10, 0.0).when(sec < 60, 0.5).otherwise(F.floor(sec / 60).cast("double"))


def ring_costs(ring: DataFrame, seg: DataFrame, dwell: DataFrame, stops: DataFrame) -> DataFrame:
    """Prefix sums of hop and intermediate dwell (mean, variance) along each doubled ring.

    ``cum_*`` at doubled index i is the cost from position 0 to i counting the dwell at every stop
    passed, the last one included.
    """
    n = next_stop(ring).withColumnRenamed("stop_id", "from_stop_id").withColumnRenamed("next_stop_id", "to_stop_id")
    e = with_segment_default(n, seg, stops).withColumn("stop_id", F.col("to_stop_id"))
    e = with_dwell_default(e, dwell).join(ring.select("route_id", "ring_size").distinct(), "route_id")
    two = e.withColumn("lap", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("stop_index") + F.col("lap") * F.col("ring_size") + 1)
    w = Window.partitionBy("route_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return two.select(
        "route_id", "at", F.col("to_stop_id").alias("stop_id"), "ring_size", "dwell_sec", "dwell_sd",
        F.sum(F.col("sec") + F.col("dwell_sec")).over(w).alias("cum_mean"),
        F.sum(F.col("sd") * F.col("sd") + F.col("dwell_sd") * F.col("dwell_sd")).over(w).alias("cum_var"))


def ring_pairs(costs: DataFrame) -> DataFrame:
    """Mean and sd from every ring position to every stop ahead within one lap.

    Ride time from i to j is hops plus the dwells strictly between. Rings are tens of stops, so this
    is a small table (ring size squared per route); it is what a trip lookup joins.
    """
    base = costs.select("route_id", F.col("at").alias("i"), F.col("stop_id").alias("from_stop_id"), F.col("cum_mean").alias("m0"), F.col("cum_var").alias("v0"), "ring_size")
    base = base.where(F.col("i") <= F.col("ring_size"))
    far = costs.select("route_id", F.col("at").alias("j"), F.col("stop_id").alias("to_stop_id"), "cum_mean", "cum_var", "dwell_sec", "dwell_sd")
    steps = base.withColumn("j", F.explode(F.sequence(F.col("i") + 1, F.col("i") + F.col("ring_size") - 1)))
    j = steps.join(far, ["route_id", "j"])
    mean = F.col("cum_mean") - F.col("m0") - F.col("dwell_sec")
    var = F.col("cum_var") - F.col("v0") - F.col("dwell_sd") * F.col("dwell_sd")
    p = j.select("route_id", F.pmod(F.col("i"), F.col("ring_size")).alias("from_index"), "from_stop_id", "to_stop_id",
                 (F.col("j") - F.col("i")).alias("hops"), mean.alias("mean_sec"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd_sec"))
    # A stop the ring repeats is reached at its nearest occurrence.
    return p.groupBy("route_id", "from_index", "from_stop_id", "to_stop_id").agg(
        F.min_by(F.struct("hops", "mean_sec", "sd_sec"), "hops").alias("x")).select("route_id", "from_index", "from_stop_id", "to_stop_id", "x.*")


def downstream_etas(anchors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Arrival times of each vehicle at every stop ahead of its anchor (M5)."""
    return anchors.join(pairs, ["route_id", "from_index"])


def v1_downstream(anchors: DataFrame, ring: DataFrame, by_bus: DataFrame, by_route: DataFrame, route_avg: DataFrame) -> DataFrame:
    """Older chain: per-vehicle hop time, else the route's for the hop, else the route average; +-1 sd (M5).

    ``by_bus``: bus_name, HOP, sec, sd; ``by_route``: HOP, sec, sd; ``route_avg``: route_id, avg_sec.
    """
    n = next_stop(ring).join(ring.select("route_id", "ring_size").distinct(), "route_id")
    a = anchors.join(n.select("route_id", "ring_size").distinct(), "route_id").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("ring_size") - 2)))
    a = a.withColumn("stop_index", F.pmod(F.col("from_index") + F.col("k"), F.col("ring_size"))).join(
        n.select("route_id", "stop_index", F.col("stop_id").alias("from_stop_id"), F.col("next_stop_id").alias("to_stop_id")), ["route_id", "stop_index"])
    hop = ["route_id", "from_stop_id", "to_stop_id"]
    a = a.join(by_bus.select("bus_name", *hop, F.col("sec").alias("_b"), F.col("sd").alias("_bs")), ["bus_name", *hop], "left")
    a = a.join(by_route.select(*hop, F.col("sec").alias("_r"), F.col("sd").alias("_rs")), hop, "left").join(route_avg, "route_id", "left")
    a = a.withColumn("sec", F.coalesce("_b", "_r", "avg_sec")).withColumn("sd", F.coalesce("_bs", "_rs", F.col("avg_sec") * 0.3))
    w = Window.partitionBy("bus_id", "route_id", "from_index").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return a.withColumn("eta_sec", F.sum("sec").over(w)).withColumn("sd_sec", F.sqrt(F.sum(F.col("sd") * F.col("sd")).over(w))).select(
        "bus_id", "route_id", "to_stop_id", (F.col("k") + 1).alias("stops_ahead"), "eta_sec",
        F.greatest(F.lit(0.0), F.col("eta_sec") - F.col("sd_sec")).alias("low_sec"), (F.col("eta_sec") + F.col("sd_sec")).alias("high_sec"))


def expected_wait(live: DataFrame, pairs: DataFrame, dwell: DataFrame, now_ms: int) -> DataFrame:
    """Soonest live vehicle per (route, board stop), less dwell already stood and staleness (M5).

    ``live``: bus_id, bus_name, route_id, anchor_index, anchor_stop_id, at_stop_since (null when
    moving), collected_at.
    """
    d = dwell.select("route_id", F.col("stop_id").alias("anchor_stop_id"), F.col("mean").alias("_dw"))
    l = live.join(d, ["route_id", "anchor_stop_id"], "left").withColumn("_dw", F.coalesce("_dw", F.lit(15.0)))
    here = l.select("*", F.col("anchor_stop_id").alias("to_stop_id"), F.lit(0.0).alias("mean_sec"), F.lit(0.0).alias("sd_sec"))
    far = l.join(pairs.select("route_id", F.col("from_index").alias("anchor_index"), "to_stop_id", "mean_sec", "sd_sec"), ["route_id", "anchor_index"])
    far = far.where(F.col("to_stop_id") != F.col("anchor_stop_id"))
    both = here.unionByName(far.select(*here.columns))
    stood = F.when(F.col("at_stop_since").isNotNull(), F.least(F.greatest(F.lit(0.0), (now_ms - F.col("at_stop_since")) / 1000), F.col("_dw"))).otherwise(0.0)
    m = F.greatest(F.lit(0.0), F.col("mean_sec") - stood)
    m = F.greatest(F.lit(0.0), m - F.greatest(F.lit(0.0), (now_ms - F.col("collected_at")) / 1000))
    return both.withColumn("wait_sec", m).groupBy("route_id", F.col("to_stop_id").alias("stop_id")).agg(
        F.min_by(F.struct("wait_sec", "sd_sec", "bus_name"), F.struct("wait_sec", "bus_id")).alias("x")).select("route_id", "stop_id", "x.*")


def od_candidates(requests: DataFrame, stops: DataFrame, ring: DataFrame, pairs: DataFrame, wait: DataFrame,
                  max_walk_m: float = 1500.0, top: int = 3, walk_max_sec: float = 3600.0) -> DataFrame:
    """Best rides of every request, plus walking all the way.

    ``requests``: request_id, from_lat, from_lon, to_lat, to_lon. Stops in reach are a short list at
    both ends; the ride table joins on (route, board, alight).
    """
    board = stops_near(requests.select("request_id", F.col("request_id").alias("point_id"), F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")), stops, max_walk_m)
    alight = stops_near(requests.select("request_id", F.col("request_id").alias("point_id"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")), stops, max_walk_m)
    first = ring.groupBy("route_id", "stop_id").agg(F.min("stop_index").alias("from_index"))
    b = board.select("request_id", "stop_id", (F.col("metres") / WALK_MPS).alias("walk1")).join(first, "stop_id").join(wait, ["route_id", "stop_id"])
    a = alight.select("request_id", F.col("stop_id").alias("to_stop_id"), (F.col("metres") / WALK_MPS).alias("walk2"))
    r = b.join(pairs.select("route_id", "from_index", "to_stop_id", "mean_sec", F.col("sd_sec").alias("ride_sd")), ["route_id", "from_index"]).join(a, ["request_id", "to_stop_id"])
    direct = requests.select("request_id", (metres("from_lat", "from_lon", "to_lat", "to_lon") / WALK_MPS).alias("direct"))
    r = r.join(direct, "request_id").where(_saves(F.col("walk1") + F.col("walk2"), F.col("direct")) & (F.col("stop_id") != F.col("to_stop_id")))
    half = F.sqrt(F.col("sd_sec") * F.col("sd_sec") + F.col("ride_sd") * F.col("ride_sd")) * Z90
    r = r.withColumn("total_sec", F.col("walk1") + F.col("wait_sec") + F.col("mean_sec") + F.col("walk2")).withColumn("_h", half)
    ride = r.select("request_id", F.lit("ride").alias("mode"), "route_id", F.col("stop_id").alias("board_stop_id"), F.col("to_stop_id").alias("alight_stop_id"),
                    "total_sec", F.greatest(F.lit(0.0), F.col("total_sec") - F.col("_h")).alias("low_sec"), (F.col("total_sec") + F.col("_h")).alias("high_sec"))
    w = Window.partitionBy("request_id").orderBy("total_sec", "route_id", "board_stop_id", "alight_stop_id")
    ride = ride.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")
    null = F.lit(None).cast("long")
    walk = direct.where(F.col("direct") <= walk_max_sec).select(
        "request_id", F.lit("walk").alias("mode"), null.alias("route_id"), null.alias("board_stop_id"), null.alias("alight_stop_id"),
        F.col("direct").alias("total_sec"), F.col("direct").alias("low_sec"), F.col("direct").alias("high_sec"))
    return ride.unionByName(walk)


def potential_routes(requests: DataFrame, stops: DataFrame, ring: DataFrame, live_routes: DataFrame, max_walk_m: float = 1500.0) -> DataFrame:
    """Routes that would serve a request but have no live vehicle, with the least walking."""
    idle = ring.join(live_routes.select("route_id").distinct(), "route_id", "left_anti").select("route_id", "stop_id").distinct()
    ends = []
    for pre in ("from", "to"):
        p = requests.select("request_id", F.col("request_id").alias("point_id"), F.col(f"{pre}_lat").alias("lat"), F.col(f"{pre}_lon").alias("lon"))
        n = stops_near(p, stops, max_walk_m).join(idle, "stop_id")
        # Nearest and second nearest stop suffice: board and alight must differ.
        w = Window.partitionBy("request_id", "route_id").orderBy("metres", "stop_id")
        n = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 2)
        ends.append(n.select("request_id", "route_id", F.col("stop_id").alias(f"{pre}_stop"), (F.col("metres") / WALK_MPS).alias(f"{pre}_walk")))
    j = ends[0].join(ends[1], ["request_id", "route_id"]).where("from_stop <> to_stop").withColumn("walk_sec", F.col("from_walk") + F.col("to_walk"))
    return j.groupBy("request_id", "route_id").agg(F.min_by(F.struct("from_stop", "to_stop", "walk_sec"), F.struct("walk_sec", "from_stop", "to_stop")).alias("x")).select(
        "request_id", "route_id", F.col("x.from_stop").alias("board_stop_id"), F.col("x.to_stop").alias("alight_stop_id"), F.col("x.walk_sec").alias("walk_sec"))


def journeys(visits: DataFrame, legs: DataFrame, route_id: int, frm: int, to: int, ring_size: int, elapsed_sec: float | None = None) -> DataFrame:
    """Observed trips from ring position ``frm`` to ``to`` by exact timestamp chaining.

    A leg continues a visit only when it starts at that visit's departure; a broken or ambiguous
    chain drops out. Each step is an equi join on (vehicle, position, instant); there are at most
    ``ring_size`` of them. With ``elapsed_sec`` only stands that had lasted that long count, timed
    from that moment.
    """
    v = visits.where(F.col("route_id") == route_id)
    src = v.where((F.col("stop_index") == frm) & (F.col("outcome") == "stopped") & (F.col("closest_m") <= 75) & F.col("departed_at").isNotNull()
                  & (F.coalesce("how", F.lit("")) != "gap"))
    start = F.col("departed_at") if elapsed_sec is None else F.col("pinned_at") + F.lit(int(elapsed_sec * 1000))
    src = src.withColumn("started_at", start).where(F.col("started_at").isNotNull() & (F.col("started_at") <= F.col("departed_at")))
    if elapsed_sec is not None:
        src = src.where((F.col("started_at") < F.col("departed_at")) & (F.col("started_at") >= F.col("arrived_at")))
    cur = src.select("bus_name", F.col("id").alias("source_id"), "started_at", F.col("departed_at").alias("first_departed"),
                     F.lit(frm).cast("long").alias("idx"), F.col("departed_at").alias("dep"))
    lg = legs.where((F.col("route_id") == route_id) & F.col("hops").between(1, ring_size)).select(
        "bus_name", F.col("from_index").alias("idx"), F.col("departed_at").alias("dep"), F.col("to_index").alias("nidx"), F.col("arrived_at").alias("arr"), "hops")
    lg = lg.groupBy("bus_name", "idx", "dep").agg(F.count(F.lit(1)).alias("_k"), F.first(F.struct("nidx", "arr", "hops")).alias("g")).where("_k = 1").select("bus_name", "idx", "dep", "g.*")
    arr_at = F.when(F.col("outcome") == "passed", F.coalesce("departed_at", "arrived_at")).otherwise(F.col("arrived_at"))
    av = v.select("bus_name", F.col("stop_index").alias("nidx"), F.explode(F.array_distinct(F.array(F.col("arrived_at"), arr_at))).alias("arr"),
                  "outcome", "closest_m", F.coalesce("how", F.lit("")).alias("how"), F.col("departed_at").alias("vdep"))
    av = av.where(F.col("arr").isNotNull()).groupBy("bus_name", "nidx", "arr").agg(F.count(F.lit(1)).alias("_k"), F.first(F.struct("outcome", "closest_m", "how", "vdep")).alias("x")).where("_k = 1").select("bus_name", "nidx", "arr", "x.*")
    done = []
    for _ in range(ring_size):
        remaining = F.pmod(F.lit(to) - F.col("idx"), F.lit(ring_size))
        s = cur.join(lg, ["bus_name", "idx", "dep"]).where((F.col("arr") > F.col("dep")) & (F.col("hops") <= remaining)).join(av, ["bus_name", "nidx", "arr"])
        done.append(s.where((F.col("nidx") == to) & (F.col("outcome") == "stopped") & (F.col("closest_m") <= 75)).select(
            "bus_name", "source_id", "started_at", F.col("first_departed").alias("departed_at"), F.col("arr").alias("arrived_at")))
        cur = s.where((F.col("nidx") != to) & (F.col("how") != "gap") & F.col("vdep").isNotNull() & (F.col("vdep") >= F.col("arr"))).select(
            "bus_name", "source_id", "started_at", "first_departed", F.col("nidx").alias("idx"), F.col("vdep").alias("dep"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumn("actual_sec", (F.col("arrived_at") - F.col("started_at")) / 1000)


def similar_journeys(trips: DataFrame, now_ms: int, limit: int = 24) -> DataFrame:
    """Trips at the same time of day and week class as now, newest first (a top-k report)."""
    from fleetlens.functions import clock

    n = F.lit(now_ms)
    same = E.same_period(clock.local_dow("started_at"), clock.local_minute("started_at"), clock.local_dow(n), clock.local_minute(n))
    return trips.where(same).orderBy(F.col("departed_at").desc(), F.col("source_id").desc()).limit(limit)


def arrival_board(etas: DataFrame) -> DataFrame:
    """Soonest and second vehicle per (route, stop) and whether they read as one.

    ``etas``: route_id, stop_id, bus_id, sec, low_sec, high_sec (band null when none).
    """
    from fleetlens.operators.grain import top_n

    r = top_n(etas, ["route_id", "stop_id"], [F.col("sec"), F.col("bus_id")], 2)
    x = F.struct("bus_id", "sec", "low_sec", "high_sec")
    g = r.groupBy("route_id", "stop_id").agg(F.max(F.when(F.col("rank") == 1, x)).alias("a"), F.max(F.when(F.col("rank") == 2, x)).alias("b"))
    mins = shown_minutes
    band = F.col("a.low_sec").isNotNull() & (mins(F.col("a.low_sec")) != mins(F.col("a.high_sec")))
    lo = mins(F.when(band, F.col("a.low_sec")).otherwise(F.col("a.sec")))
    hi = mins(F.when(band, F.col("a.high_sec")).otherwise(F.col("a.sec")))
    nx = mins(F.col("b.sec"))
    reason = (F.when(F.col("b").isNull(), F.lit(None).cast("string")).when(band & (nx <= hi), "inside-band").when(~band & (nx == lo), "same-minute")
              .when(F.col("b.low_sec").isNotNull() & (mins(F.col("b.low_sec")) <= hi), "next-band-overlap"))
    return g.select("route_id", "stop_id", F.col("a.bus_id").alias("lead_bus"), F.col("a.sec").alias("lead_sec"), F.col("b.bus_id").alias("next_bus"),
                    F.col("b.sec").alias("next_sec"), reason.isNotNull().alias("bunched"), reason.alias("reason"))
