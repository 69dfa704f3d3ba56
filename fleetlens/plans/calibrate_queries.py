"""Registered calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import exprs as E
from fleetlens.operators import calibrate as C
from fleetlens.operators.grain import specific_else_general
from fleetlens.plans.reg import NOW, NOW_DOW, NOW_HOUR, Registry, knots, rounded

R = Registry()
QUERIES, ORACLE = R.queries, R.oracles
D = 86_400_000

_CH = "sqrt(power((b.lat-a.lat)*111320e0,2)+power((b.lon-a.lon)*111320e0*cos(radians((a.lat+b.lat)/2)),2))"
_SEG = f"""sg AS (SELECT s.*, s.dow = {NOW_DOW} AND s.hour IN ({NOW_HOUR-1},{NOW_HOUR},{NOW_HOUR+1}) w FROM segments s
  JOIN stops a ON a.stop_id=s.from_stop_id JOIN stops b ON b.stop_id=s.to_stop_id
  WHERE started_at BETWEEN {NOW-30*D} AND {NOW} AND started_at + GREATEST(0,travel_sec)*1000 <= {NOW} AND travel_sec > 0 AND {_CH}/travel_sec <= 22),
 seg AS (SELECT route_id, from_stop_id, to_stop_id, QUANTILE_CONT(travel_sec,0.5) prior, COUNT(*) FILTER (w) n, AVG(travel_sec) FILTER (w) av,
   COALESCE(STDDEV_SAMP(travel_sec) FILTER (w),0) sd FROM sg GROUP BY ALL)"""
_VIS = f"""vv AS (SELECT * FROM stop_visits WHERE anchored_at BETWEEN {NOW-30*D} AND {NOW} AND outcome IN ('stopped','passed')
   AND (CASE WHEN departed_at IS NULL AND outcome='passed' THEN GREATEST(anchored_at, COALESCE(first_moved_at, anchored_at))
        WHEN departed_at IS NOT NULL THEN GREATEST(departed_at, COALESCE(first_moved_at, departed_at)) END) + GREATEST(0, COALESCE(confirm_sec,0))*1000 <= {NOW}),
 st AS (SELECT *, CASE WHEN outcome='passed' THEN 0e0 ELSE (departed_at-pinned_at)/1000e0 END stand FROM vv
   WHERE pinned_at IS NOT NULL AND (outcome='passed' OR (outcome='stopped' AND departed_at >= pinned_at)))"""
_LEG = f"""lg AS (SELECT l.*, {_CH} chord FROM legs l JOIN stops a ON a.stop_id=l.from_stop_id JOIN stops b ON b.stop_id=l.to_stop_id
   WHERE departed_at BETWEEN {NOW-30*D} AND {NOW} AND GREATEST(arrived_at, COALESCE(to_pinned_at, arrived_at)) <= {NOW} AND hops = 1),
 dr AS (SELECT *, (COALESCE(to_pinned_at, arrived_at)-departed_at)/1000e0 drive FROM lg WHERE COALESCE(to_pinned_at, arrived_at) > departed_at),
 sem AS (SELECT DISTINCT route_id, from_stop_id, to_stop_id FROM sg)"""
_K = "[0.05,0.15,0.25,0.35,0.45,0.55,0.65,0.75,0.85,0.95]"


def _seg(segments, stops):
    return C.segment_stats(segments, stops, NOW, NOW_DOW, NOW_HOUR)


@R.q("a1_segment_stats", "segments stops", f"""WITH {_SEG} SELECT route_id, from_stop_id, to_stop_id,
  ROUND(CASE WHEN n=0 THEN prior ELSE (n*av+8*prior)/(n+8) END,7) mean, ROUND(GREATEST(sd,5),7) stddev, n,
  CASE WHEN n>=8 THEN 'specific' ELSE 'route-segment' END source FROM seg""")
def _a1(segments, stops):
    return rounded(_seg(segments, stops))


_DW = f"""dw AS (SELECT *, dow={NOW_DOW} AND hour IN ({NOW_HOUR-1},{NOW_HOUR},{NOW_HOUR+1}) w FROM arrivals
   WHERE arrived_at BETWEEN {NOW-14*D} AND {NOW} AND dwell_sec IS NOT NULL AND GREATEST(COALESCE(departed_at,arrived_at), arrived_at+GREATEST(0,dwell_sec)*1000) <= {NOW}),
 dg AS (SELECT route_id, stop_id, COUNT(*) na, QUANTILE_CONT(dwell_sec,0.5) ma, QUANTILE_CONT(dwell_sec,0.9) pa, QUANTILE_CONT(dwell_sec,0.35) la,
   COUNT(*) FILTER (w) nw, QUANTILE_CONT(dwell_sec,0.5) FILTER (w) mw, QUANTILE_CONT(dwell_sec,0.9) FILTER (w) pw FROM dw GROUP BY ALL),
 ds AS (SELECT route_id, stop_id, COALESCE(mw,ma) mean, GREATEST(COALESCE(pw,pa)-COALESCE(mw,ma),5) stddev, nw n,
   CASE WHEN na>=5 THEN LEAST(la, COALESCE(mw,la)) END low FROM dg)"""


@R.q("a2_dwell_stats", "arrivals", f"WITH {_DW} SELECT route_id, stop_id, ROUND(mean,7) mean, ROUND(stddev,7) stddev, n, ROUND(low,7) low FROM ds")
def _a2(arrivals):
    return rounded(C.dwell_stats(arrivals, NOW, NOW_DOW, NOW_HOUR))


@R.q("a3_stand_tables", "stop_visits arrivals", f"""WITH {_VIS}, {_DW}, q AS (SELECT route_id, stop_id, COUNT(*) qn, QUANTILE_CONT(stand,{_K}) q FROM st GROUP BY ALL),
  j AS (SELECT route_id, stop_id, COALESCE(mean,15) mean, COALESCE(stddev,10) stddev, qn, q FROM ds FULL JOIN q USING (route_id, stop_id))
  SELECT route_id, stop_id, ROUND(mean,7) mean, ROUND(stddev,7) stddev, qn, k AS knot, ROUND(q[k+1],7) v FROM (SELECT *, UNNEST(range(10))::INT k FROM j WHERE q IS NOT NULL)""")
def _a3(visits, arrivals):
    t = C.stand_tables(visits, NOW, C.dwell_stats(arrivals, NOW, NOW_DOW, NOW_HOUR))
    return rounded(knots(t, C.CELL, "q", ["mean", "stddev", "qn"]))


@R.q("a4_occurrence_stand_tables", "stop_visits route_stops", f"""WITH {_VIS} SELECT route_id, stop_id, stop_index, ROUND(QUANTILE_CONT(stand,0.5),7) mean,
  ROUND(GREATEST(QUANTILE_CONT(stand,0.9)-QUANTILE_CONT(stand,0.5),5),7) stddev, COUNT(*) n, ROUND(QUANTILE_CONT(stand,0.55),7) q6,
  ROUND((SELECT COUNT(*) FILTER (outcome='stopped')/COUNT(*) FROM vv WHERE vv.route_id=st.route_id AND vv.stop_id=st.stop_id AND vv.stop_index=st.stop_index),7) p_stop
  FROM st GROUP BY route_id, stop_id, stop_index""")
def _a4(visits, route_stops):
    # Every stop listed twice: an out-and-back ring over the same stops.
    folded = route_stops.unionByName(route_stops.withColumn("stop_index", F.col("stop_index") + 5))
    t = C.occurrence_stand_tables(visits, folded, NOW)
    return rounded(t.select("route_id", "stop_id", "stop_index", "mean", "stddev", "n", F.element_at("q", 6).alias("q6"), "p_stop"))


@R.q("a5_stop_shares", "stop_visits", f"WITH {_VIS} SELECT route_id, stop_id, ROUND(COUNT(*) FILTER (outcome='stopped')/COUNT(*),7) p_stop, COUNT(*) visits FROM vv GROUP BY ALL")
def _a5(visits):
    return rounded(C.stop_shares(visits, NOW))


@R.q("a6_drive_stats", "legs segments stops", f"""WITH {_SEG}, {_LEG} SELECT route_id, from_stop_id, to_stop_id, ROUND(QUANTILE_CONT(drive,0.5),7) drive, COUNT(*) drive_n
  FROM dr SEMI JOIN sem USING (route_id, from_stop_id, to_stop_id) WHERE GREATEST(chord-150,0)/drive <= 22 GROUP BY ALL""")
def _a6(legs, segments, stops):
    return rounded(C.drive_stats(legs, _seg(segments, stops), stops, NOW))


@R.q("a7_leg_quantiles", "legs segments stops", f"""WITH {_SEG}, {_LEG}, q AS (SELECT route_id, from_stop_id, to_stop_id, COUNT(*) dqn, QUANTILE_CONT(leg_sec,{_K}) q
  FROM lg SEMI JOIN sem USING (route_id, from_stop_id, to_stop_id) WHERE leg_sec > 0 AND GREATEST(chord-150,0)/leg_sec <= 22 GROUP BY ALL)
  SELECT route_id, from_stop_id, to_stop_id, dqn, k AS knot, ROUND(q[k+1],7) v FROM (SELECT *, UNNEST(range(10))::INT k FROM q)""")
def _a7(legs, segments, stops):
    return rounded(knots(C.leg_quantiles(legs, _seg(segments, stops), stops, NOW), C.HOP, "dq", ["dqn"]))


@R.q("a8_pace", "legs stops route_stops", f"""WITH {_LEG.split(' sem AS')[0].rstrip().rstrip(',')}, p AS (SELECT route_id, leg_sec/chord spm FROM lg WHERE leg_sec > 0 AND GREATEST(chord-150,0)/leg_sec <= 22 AND chord >= 30),
  q AS (SELECT route_id, COUNT(*) n, QUANTILE_CONT(spm,{_K}) q, FALSE pooled FROM p GROUP BY ALL UNION ALL SELECT 99, COUNT(*), QUANTILE_CONT(spm,{_K}), TRUE FROM p)
  SELECT CAST(route_id AS BIGINT) route_id, n, pooled, k AS knot, ROUND(q[k+1],9) v FROM (SELECT *, UNNEST(range(10))::INT k FROM q)""")
def _a8(legs, stops, route_stops):
    # A route without legs shows the pooled fallback.
    idle = route_stops.where("route_id = 5").withColumn("route_id", F.lit(99).cast("long"))
    t = C.pace(legs, stops, route_stops.unionByName(idle), NOW)
    return rounded(knots(t, ["route_id"], "spm", ["n", "pooled"]), 9)


_V1S = f"s AS (SELECT * FROM segment_times WHERE hops=1 AND travel_seconds BETWEEN 15 AND 1200 AND recorded_at > {NOW-30*D})"
_V1Q = """SELECT {b} route_id, from_stop_id, to_stop_id, CAST(d AS INT) dow, ROUND(AVG(travel_seconds),7) avg_sec,
  ROUND(SQRT(GREATEST(0,AVG(travel_seconds*travel_seconds)-AVG(travel_seconds)*AVG(travel_seconds))),4) sd_sec, COUNT(*) n
  FROM (SELECT *, UNNEST([day_of_week,-1]) d FROM s) GROUP BY {b} route_id, from_stop_id, to_stop_id, d HAVING COUNT(*) >= {m}"""


def _v1round(df):
    return rounded(df.withColumn("sd_sec", F.round("sd_sec", 4)))


@R.q("a9_v1_segment_stats", "segment_times", f"WITH {_V1S} " + _V1Q.format(b="", m="CASE WHEN d=-1 THEN 1 ELSE 2 END"))
def _a9(st):
    return _v1round(C.v1_segment_stats(st, NOW))


@R.q("a9_v1_segment_stats_by_bus", "segment_times", f"WITH {_V1S} " + _V1Q.format(b="bus_name,", m="5"))
def _a9b(st):
    return _v1round(C.v1_segment_stats(st, NOW, True))


_V1D = f"""SELECT {{b}} route_id, stop_id, CAST(d AS INT) dow, ROUND(QUANTILE_CONT(dwell_seconds,0.5),7) median_sec, ROUND(STDDEV_POP(dwell_seconds),4) sd_sec, COUNT(*) n
  FROM (SELECT *, UNNEST([day_of_week,-1]) d FROM gps_dwells WHERE dwell_seconds BETWEEN 30 AND 1800 AND entered_at > {NOW-30*D})
  GROUP BY {{b}} route_id, stop_id, d HAVING COUNT(*) >= {{m}}"""


@R.q("a10_v1_dwell_stats", "gps_dwells", _V1D.format(b="", m=3))
def _a10(d):
    return _v1round(C.v1_dwell_stats(d, NOW))


@R.q("a10_v1_dwell_stats_by_bus", "gps_dwells", _V1D.format(b="bus_name,", m=5))
def _a10b(d):
    return _v1round(C.v1_dwell_stats(d, NOW, True))


@R.q("a10_vehicle_profiles", "segment_times arrivals", f"""SELECT s.bus_name, s.route_id, ROUND(AVG(travel_seconds)/60,7) avg_loop_min, COUNT(*) n, ROUND(COALESCE(ANY_VALUE(d),0),7) avg_dwell_sec
  FROM segment_times s LEFT JOIN (SELECT bus_name, route_id, AVG(dwell_sec) d FROM arrivals WHERE dwell_sec > 0 AND dwell_sec < 600 GROUP BY ALL) w
    ON w.bus_name=s.bus_name AND w.route_id=s.route_id WHERE recorded_at > {NOW-7*D} GROUP BY s.bus_name, s.route_id HAVING COUNT(*) >= 3""")
def _a10p(st, arrivals):
    return rounded(C.vehicle_profiles(st, arrivals, NOW))


def _lay(alias: str) -> str:
    parts = []
    for who in ("bus", "route"):
        on = "h.route_id=x.route_id AND h.from_stop_id=x.from_stop_id AND h.to_stop_id=x.to_stop_id" + (" AND h.bus_name=x.bus_name" if who == "bus" else "")
        for w in (0, 1, 2):
            parts.append((f"{on} AND h.day_of_week=x.dow AND ((h.hour-x.hour+36)%24-12) BETWEEN -{w} AND {w}", 3, f"{who}.dow.hr±{w}"))
        parts.append((f"{on} AND h.day_of_week=x.dow", 5 if who == "bus" else 3, f"{who}.dow"))
        parts.append((on, 5 if who == "bus" else 3, f"{who}.any"))
    out = []
    for i, (on, need, lab) in enumerate(parts):
        out.append(f"l{i} AS (SELECT x.sid, AVG(h.travel_seconds) a, COUNT(*) n FROM {alias} x JOIN h ON {on} GROUP BY x.sid HAVING COUNT(*) >= {need})")
    pick_a = "COALESCE(" + ",".join(f"l{i}.a" for i in range(10)) + ")"
    pick_l = "CASE " + " ".join(f"WHEN l{i}.a IS NOT NULL THEN '{lab}'" for i, (_, _, lab) in enumerate(parts)) + " ELSE 'none' END"
    joins = " ".join(f"LEFT JOIN l{i} ON l{i}.sid=x.sid" for i in range(10))
    return f"h AS (SELECT * FROM segment_times WHERE hops=1 AND travel_seconds BETWEEN 15 AND 1200 AND recorded_at > {NOW-30*D}), " + ", ".join(out) + \
        f", lay AS (SELECT x.*, {pick_a} expected_sec, {pick_l} layer FROM {alias} x {joins})"


@R.q("j17_expected_segment", "segment_times", "WITH x AS (SELECT id sid, bus_name, route_id, from_stop_id, to_stop_id, day_of_week dow, hour FROM segment_times), " +
     _lay("x") + " SELECT sid, ROUND(expected_sec,7) expected_sec, layer FROM lay")
def _j17(st):
    s = st.select(F.col("id").alias("sid"), "bus_name", *C.HOP, F.col("day_of_week").alias("dow"), "hour")
    return rounded(C.expected_segment(s, st, NOW).select("sid", "expected_sec", "layer"))


@R.q("a11_bus_pace", "segment_times", f"WITH x AS (SELECT id sid, bus_name, route_id, from_stop_id, to_stop_id, travel_seconds, {NOW_DOW} dow, hour(make_timestamp(recorded_at*1000)) AS hour FROM segment_times WHERE recorded_at > {NOW-2*D} AND hops=1 AND travel_seconds BETWEEN 15 AND 1200), " +
     _lay("x") + """, g AS (SELECT LTRIM(bus_name,'#') bus, COUNT(*) n, LIST(travel_seconds/expected_sec ORDER BY travel_seconds/expected_sec) l FROM lay WHERE expected_sec > 0 GROUP BY ALL HAVING COUNT(*) >= 2)
  SELECT bus, l[n//2+1] < 0.8 fast, l[n//2+1] > 1.25 slow, ROUND(l[n//2+1],2) ratio, n FROM g""")
def _a11(st):
    return C.bus_pace(st, NOW, NOW_DOW, 2 * D).drop("layers")


@R.q("a12_recent_skips", "segment_times", f"""SELECT LTRIM(bus_name,'#') bus, hops-1 skipped, ago ago_sec FROM (SELECT *, ({NOW}-recorded_at)//1000 ago FROM segment_times
  WHERE recorded_at > {NOW-2*D} AND recorded_at <= {NOW} AND hops > 1) QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_name ORDER BY ago, hops) = 1""")
def _a12(st):
    return C.recent_skips(st, NOW, 2 * D)


@R.q("j5_specific_else_general", "segment_times", f"""WITH {_V1S}, g AS (SELECT route_id, from_stop_id, to_stop_id, d, AVG(travel_seconds) a FROM (SELECT *, UNNEST([day_of_week,-1]) d FROM s)
   GROUP BY ALL HAVING COUNT(*) >= CASE WHEN d=-1 THEN 1 ELSE 2 END)
  SELECT route_id, from_stop_id, to_stop_id, ROUND(a,7) avg_sec, 'specific' source FROM g WHERE d = {NOW_DOW}
  UNION ALL SELECT route_id, from_stop_id, to_stop_id, ROUND(a,7), 'general' FROM g WHERE d=-1 AND NOT EXISTS (SELECT 1 FROM g k WHERE k.d={NOW_DOW} AND k.route_id=g.route_id AND k.from_stop_id=g.from_stop_id AND k.to_stop_id=g.to_stop_id)""")
def _j5(st):
    t = C.v1_segment_stats(st, NOW).select(*C.HOP, "dow", "avg_sec")
    return rounded(specific_else_general(t.where(F.col("dow") == NOW_DOW).drop("dow"), t.where("dow = -1").drop("dow"), C.HOP))


@R.q("j18_segment_default", "ring segments stops", f"""WITH {_SEG}, e AS (SELECT r.route_id, r.stop_id from_stop_id, n.stop_id to_stop_id FROM ring r JOIN ring n ON n.route_id=r.route_id AND n.stop_index=(r.stop_index+1)%5
   UNION ALL SELECT r.route_id, r.stop_id, n.stop_id FROM ring r JOIN ring n ON n.route_id=r.route_id%5+1 AND n.stop_index=r.stop_index),
  p AS (SELECT e.*, GREATEST(20, {_CH}/5.5e0) pr FROM e JOIN stops a ON a.stop_id=e.from_stop_id JOIN stops b ON b.stop_id=e.to_stop_id)
  SELECT p.route_id, p.from_stop_id, p.to_stop_id, ROUND(COALESCE(CASE WHEN n=0 THEN prior ELSE (n*av+8*prior)/(n+8) END, pr),7) sec,
   ROUND(CASE WHEN prior IS NOT NULL THEN GREATEST(sd,5) ELSE pr*0.5e0 END,7) sd, prior IS NOT NULL calibrated FROM p LEFT JOIN seg USING (route_id, from_stop_id, to_stop_id)""")
def _j18(ring, segments, stops):
    n = ring.select("route_id", ((F.col("stop_index") + 4) % 5).alias("stop_index"), F.col("stop_id").alias("to_stop_id"))
    x = ring.select((F.pmod(F.col("route_id") - 2, F.lit(5)) + 1).alias("route_id"), "stop_index", F.col("stop_id").alias("to_stop_id"))
    r = ring.select("route_id", "stop_index", F.col("stop_id").alias("from_stop_id"))
    e = r.join(n, ["route_id", "stop_index"]).unionByName(r.join(x, ["route_id", "stop_index"])).drop("stop_index")
    return rounded(C.with_segment_default(e, _seg(segments, stops), stops).select(*C.HOP, "sec", "sd", "calibrated"))


def asof_ctes(step: int, days: int) -> str:
    """Every sample joined with every step that it serves: ``tab`` is the table of each step."""
    return f"""sg AS (SELECT s.* FROM segments s JOIN stops a ON a.stop_id=s.from_stop_id JOIN stops b ON b.stop_id=s.to_stop_id
   WHERE travel_sec > 0 AND {_CH}/travel_sec <= 22),
  d AS (SELECT UNNEST(range((SELECT MIN(started_at)//{step} FROM segments), (SELECT CAST(CEIL(MAX(started_at)/{float(step)}e0) AS BIGINT)+1 FROM segments)))*{step} as_of),
  dd AS (SELECT as_of, {{LDOW(as_of)}} adow, {{LHOUR(as_of)}} ahour FROM d),
  j AS (SELECT sg.*, as_of, sg.dow=adow AND ((sg.hour-ahour+36)%24-12) BETWEEN -1 AND 1 w FROM sg JOIN dd ON started_at+travel_sec*1000 <= as_of AND started_at >= as_of-{days * D}),
  g AS (SELECT route_id, from_stop_id, to_stop_id, as_of, QUANTILE_CONT(travel_sec,0.5) prior, COUNT(*) FILTER (w) n, SUM(travel_sec) FILTER (w) sx, COALESCE(STDDEV_SAMP(travel_sec) FILTER (w),0) sd FROM j GROUP BY ALL),
  tab AS (SELECT route_id, from_stop_id, to_stop_id, as_of, CASE WHEN n=0 THEN prior ELSE (sx+8*prior)/(n+8) END mean, GREATEST(sd,5) stddev, n, prior FROM g)"""


def _asof_sql(step: int, days: int) -> str:
    return f"WITH {asof_ctes(step, days)} SELECT route_id, from_stop_id, to_stop_id, as_of, ROUND(mean,5) mean, ROUND(stddev,4) stddev, n, ROUND(prior,5) prior FROM tab"


def _asof(segments, stops, step: int, days: int):
    t = C.calibrate_asof(segments, stops, step, days)
    return t.select(*C.HOP, "as_of", F.round("mean", 5).alias("mean"), F.round("stddev", 4).alias("stddev"), "n", F.round("prior", 5).alias("prior"))


@R.q("m6_calibrate_asof_daily", "segments stops", _asof_sql(D, 7))
def _m6(segments, stops):
    return _asof(segments, stops, D, 7)


@R.q("m6_calibrate_asof_hourly", "segments stops", _asof_sql(D // 24, 30))
def _m6h(segments, stops):
    return _asof(segments, stops, D // 24, 30)


@R.q("p6_available_by", "stop_visits", f"WITH {_VIS} SELECT COUNT(*) n, CAST(SUM(id) AS BIGINT) s FROM vv")
def _p6(visits):
    return C._visits(visits, NOW, 30).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s"))


@R.q("p7_stand_drive_samples", "stop_visits legs", """SELECT 'stand' kind, id, CASE WHEN outcome='passed' THEN 0e0 ELSE (departed_at-pinned_at)/1000e0 END sec FROM stop_visits
   WHERE pinned_at IS NOT NULL AND (outcome='passed' OR (outcome='stopped' AND departed_at >= pinned_at))
  UNION ALL SELECT 'drive', id, (COALESCE(to_pinned_at,arrived_at)-departed_at)/1000e0 FROM legs WHERE COALESCE(to_pinned_at,arrived_at) > departed_at""")
def _p7(visits, legs):
    a = C.stand_samples(visits).select(F.lit("stand").alias("kind"), "id", F.col("stand").alias("sec"))
    return a.unionByName(C.drive_samples(legs).select(F.lit("drive").alias("kind"), "id", F.col("drive").alias("sec")))


@R.q("p4_plausible_travel", "segments stops", f"SELECT s.id FROM segments s JOIN stops a ON a.stop_id=s.from_stop_id JOIN stops b ON b.stop_id=s.to_stop_id WHERE travel_sec > 0 AND {_CH}/travel_sec <= 22")
def _p4(segments, stops):
    return C.plausible_travel(segments, stops).select("id")


@R.q("p5_plausible_leg", "legs stops", f"SELECT l.id FROM legs l JOIN stops a ON a.stop_id=l.from_stop_id JOIN stops b ON b.stop_id=l.to_stop_id WHERE leg_sec > 0 AND GREATEST({_CH}-150,0)/leg_sec <= 22")
def _p5(legs, stops):
    return C.plausible_leg(legs, stops).select("id")


@R.q("p9_hour_window", "segments", f"SELECT id FROM segments WHERE hour IN (22,23,0,1,2)")
def _p9(segments):
    return segments.where(E.in_hour_window("hour", F.lit(0), 2)).select("id")
