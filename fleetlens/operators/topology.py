"""Rings of stops: nearest stop, radius search, successors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.geo import M_PER_DEG, degree_sq, metres, point_to_segment, project


def ring_arrays(ring: DataFrame) -> DataFrame:
    """One row per route with its ordered stops; a route is tens of stops."""
    return ring.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "stop_id", "lat", "lon"))).alias("ring"))


def nearest_stop(pos: DataFrame, ring: DataFrame, ahead: int | None = None, anchor: str | None = None, v1: bool = False) -> DataFrame:
    """Nearest stop of the route to each fix (J14); ties take the lowest index.

    The route's stops arrive as an array on the fix row, so there is no row per (fix, stop) and no
    shuffle of fixes. With ``ahead`` only the next stops after ``anchor`` (a ring index column) count.
    """
    j = pos.join(ring_arrays(ring), "route_id", "left")
    dist = degree_sq if v1 else metres
    stops = F.col("ring")
    if ahead is not None:
        n = F.size("ring")
        stops = F.filter(stops, lambda s: F.pmod(s["stop_index"] - F.col(anchor), n) <= ahead)
    grain = 1e12 if v1 else 1e6

    def near(s):
        d = dist(F.col("lat"), F.col("lon"), s["lat"], s["lon"])
        # Distances compare in whole micrometres, so that an exact tie is a tie.
        return F.struct(F.floor(d * grain + 0.5).alias("k"), s["stop_index"].alias("i"), s["stop_id"].alias("s"))

    best = F.array_min(F.transform(stops, near))
    out = j.withColumn("_b", best).drop("ring")
    return out.select("*", F.col("_b.s").alias("near_stop_id"), F.col("_b.i").alias("near_index"), (F.col("_b.k") / grain).alias("near_m")).drop("_b")


def _cells(lat, lon, size_m: float) -> tuple[Column, Column]:
    """Grid cell of about ``size_m``; longitude cells are sized for the widest latitude in use (60 deg)."""
    return F.floor(lat * F.lit(M_PER_DEG / size_m)).cast("long"), F.floor(lon * F.lit(M_PER_DEG * 0.5 / size_m)).cast("long")


def stops_near(points: DataFrame, stops: DataFrame, r: float) -> DataFrame:
    """Stops within ``r`` metres of each point (J15): one cell ring of candidates, then the distance.

    ``points``: point_id, lat, lon. Valid up to 60 degrees of latitude.
    """
    py, px = _cells(F.col("lat"), F.col("lon"), r)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = points.withColumn("_cy", F.explode(F.transform(near, lambda o: py + o))).withColumn("_cx", F.explode(F.transform(near, lambda o: px + o)))
    sy, sx = _cells(F.col("slat"), F.col("slon"), r)
    s = stops.select("stop_id", F.col("lat").alias("slat"), F.col("lon").alias("slon")).withColumn("_cy", sy).withColumn("_cx", sx)
    j = p.join(s, ["_cy", "_cx"]).withColumn("metres", metres("lat", "lon", "slat", "slon"))
    return j.where(F.col("metres") <= r).drop("_cy", "_cx", "slat", "slon")


def walk_transfers(stops: DataFrame, r: float = 400.0, k: int = 8) -> DataFrame:
    """The k nearest other stops within walking reach of each stop."""
    p = stops.select(F.col("stop_id").alias("from_stop_id"), F.col("stop_id").alias("point_id"), "lat", "lon")
    j = stops_near(p, stops, r).where(F.col("stop_id") != F.col("from_stop_id"))
    w = Window.partitionBy("from_stop_id").orderBy("metres", "stop_id")
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("from_stop_id", F.col("stop_id").alias("to_stop_id"), "metres", "rank")


def next_stop(ring: DataFrame) -> DataFrame:
    """Successor of every ring position."""
    w = Window.partitionBy("route_id").orderBy("stop_index")
    first = F.first(F.struct("stop_index", "stop_id")).over(w)
    nxt = F.coalesce(F.lead(F.struct("stop_index", "stop_id")).over(w), first)
    return ring.withColumn("_n", nxt).select("route_id", "stop_index", "stop_id", F.col("_n.stop_index").alias("next_index"), F.col("_n.stop_id").alias("next_stop_id"))


def hops_forward(pairs: DataFrame, ring: DataFrame) -> DataFrame:
    """Fewest forward hops over all occurrence pairs of (from, to) on the route."""
    arr = ring.groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "stop_id"))).alias("ring"))
    j = pairs.join(arr, "route_id", "left")
    at = lambda c: F.transform(F.filter("ring", lambda s: s["stop_id"] == F.col(c)), lambda s: s["stop_index"])
    n = F.size("ring")
    hops = F.array_min(F.flatten(F.transform(at("from_stop_id"), lambda i: F.transform(at("to_stop_id"), lambda k: F.pmod(k - i, n)))))
    return j.withColumn("hops", hops.cast("long")).drop("ring")


def leg_road_metres(ring: DataFrame, paths: DataFrame, off_m: float = 80.0) -> DataFrame:
    """Road metres of each hop along the route's published closed line.

    Each stop projects to its nearest point of the line; a hop's metres run forward from one to the
    next, once around the loop at most. Null where a stop lies further than ``off_m`` off the line.
    """
    v = paths.select("route_id", F.posexplode("path").alias("i", "a"))
    w = Window.partitionBy("route_id").orderBy("i")
    seg = v.withColumn("b", F.coalesce(F.lead("a").over(w), F.first("a").over(w))).withColumn(
        "m", metres("a.lat", "a.lon", "b.lat", "b.lon"))
    seg = seg.withColumn("start", F.sum("m").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).withColumn(
        "total", F.sum("m").over(Window.partitionBy("route_id")))
    s = ring.select("route_id", "stop_index", "stop_id", "lat", "lon").join(seg, "route_id")
    ax, ay = project("a.lat", "a.lon", "lat", "lon")
    bx, by = project("b.lat", "b.lon", "lat", "lon")
    d, t = point_to_segment(F.lit(0.0), F.lit(0.0), ax, ay, bx, by)
    best = s.withColumn("d", d).withColumn("along", F.col("start") + t * F.col("m")).groupBy("route_id", "stop_index", "stop_id").agg(
        F.min(F.struct("d", "along", "total")).alias("x"))
    o = Window.partitionBy("route_id").orderBy("stop_index")
    nx = F.coalesce(F.lead(F.struct("stop_id", "x")).over(o), F.first(F.struct("stop_id", "x")).over(o))
    h = best.withColumn("n", nx)
    run = F.pmod(F.col("n.x.along") - F.col("x.along"), F.col("x.total"))
    ok = (F.col("x.d") <= off_m) & (F.col("n.x.d") <= off_m) & (run > 0)
    return h.select("route_id", F.col("stop_id").alias("from_stop_id"), F.col("n.stop_id").alias("to_stop_id"), F.when(ok, run).alias("road_m"))


def leg_coverage(ring: DataFrame, leg_metres: DataFrame) -> DataFrame:
    """Share of a route's hops with road metres."""
    n = next_stop(ring).select("route_id", F.col("stop_id").alias("from_stop_id"), F.col("next_stop_id").alias("to_stop_id"))
    j = n.join(leg_metres, ["route_id", "from_stop_id", "to_stop_id"], "left")
    return j.groupBy("route_id").agg(F.count(F.lit(1)).alias("hops"), F.avg(F.when(F.col("road_m").isNotNull(), 1.0).otherwise(0.0)).alias("share"))


def path_quality(paths: DataFrame, ring: DataFrame) -> DataFrame:
    """Stop-to-line distances (median, p90, max) and the line's length."""
    from fleetlens.functions.geo import polyline_metres
    from fleetlens.functions.quantiles import grouped_quantiles

    v = paths.select("route_id", F.explode("path").alias("a"))
    d = ring.select("route_id", "stop_id", "lat", "lon").distinct().join(v, "route_id").groupBy("route_id", "stop_id").agg(
        F.min(metres("lat", "lon", "a.lat", "a.lon")).alias("m"))
    q = grouped_quantiles(d, ["route_id"], "m", {"median_m": (0.5, "linear"), "p90_m": (0.9, "trunc"), "max_m": (1.0, "trunc")})
    return q.withColumnRenamed("_n", "stop_count").join(paths.select("route_id", polyline_metres("path").alias("length_m")), "route_id")


def longest_excursion(paths: DataFrame, corridor: DataFrame, off_m: float = 120.0) -> DataFrame:
    """Longest stretch of a line further than ``off_m`` from every corridor point.

    ``corridor``: route_id, lat, lon (for instance thinned positions). A grid join finds vertices
    with a near point; the rest form runs.
    """
    v = paths.select("route_id", F.posexplode("path").alias("i", "a")).select("route_id", "i", F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"))
    vy, vx = _cells(F.col("lat"), F.col("lon"), off_m)
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = v.withColumn("_cy", F.explode(F.transform(near, lambda o: vy + o))).withColumn("_cx", F.explode(F.transform(near, lambda o: vx + o)))
    cy, cx = _cells(F.col("clat"), F.col("clon"), off_m)
    c = corridor.select("route_id", F.col("lat").alias("clat"), F.col("lon").alias("clon")).distinct().withColumn("_cy", cy).withColumn("_cx", cx)
    hit = p.join(c, ["route_id", "_cy", "_cx"]).where(metres("lat", "lon", "clat", "clon") <= off_m).select("route_id", "i").distinct().withColumn("on", F.lit(1))
    w = Window.partitionBy("route_id").orderBy("i")
    d = v.join(hit, ["route_id", "i"], "left").withColumn("g", F.sum(F.coalesce("on", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("step", F.coalesce(metres("lat", "lon", F.lag("lat").over(w), F.lag("lon").over(w)), F.lit(0.0)))
    runs = d.where(F.col("on").isNull()).groupBy("route_id", "g").agg(F.sum("step").alias("m"))
    return paths.select("route_id").join(runs.groupBy("route_id").agg(F.max("m").alias("excursion_m")), "route_id", "left").withColumn(
        "excursion_m", F.coalesce("excursion_m", F.lit(0.0)))


def choose_path(cand: DataFrame, cur: DataFrame, margin: float = 0.9) -> DataFrame:
    """Keep the incumbent unless the candidate's p90 is clearly smaller and serves as many stops."""
    a = cand.select("route_id", F.struct("p90_m", "stop_count", "length_m").alias("c"))
    b = cur.select("route_id", F.struct("p90_m", "stop_count", "length_m").alias("k"))
    j = a.join(b, "route_id", "full")
    take = F.col("k").isNull() | (F.col("c").isNotNull() & (F.col("c.stop_count") >= F.col("k.stop_count")) & (F.col("c.p90_m") < F.col("k.p90_m") * margin))
    return j.select("route_id", F.when(take, "candidate").otherwise("incumbent").alias("choice"))
