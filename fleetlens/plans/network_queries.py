"""Registered as-of, range, topology and planning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.operators import asof, calibrate as C, planning as P, ranges as N, topology as T
from fleetlens.plans.reg import NOW, NOW_DOW, NOW_HOUR, Registry, rounded
from fleetlens.plans.calibrate_queries import _SEG, _DW
from fleetlens.session import materialize

R = Registry()
QUERIES, ORACLE = R.queries, R.oracles
D = 86_400_000
_M = "sqrt(power(({b}-{a})*111320e0,2)+power(({d}-{c})*111320e0*cos(radians(({a}+{b})/2)),2))"


def _m(a, c, b, d):
    return _M.format(a=a, b=b, c=c, d=d)


@R.q("j6_asof_next", "predictions arrivals", """SELECT p.id, CASE WHEN a.arrived_at - p.predicted_at <= 7200000 THEN a.arrived_at END next_at FROM predictions p ASOF LEFT JOIN arrivals a ON p.bus_id=a.bus_id AND p.to_stop_id=a.stop_id AND p.predicted_at <= a.arrived_at""")
def _j6(p, a):
    j = asof.asof_next(p.select("id", "bus_id", F.col("to_stop_id").alias("stop_id"), "predicted_at"), a, ["bus_id", "stop_id"], "predicted_at", "arrived_at", asof.MATCH_2H_MS)
    return j.select("id", F.col("next._rt").alias("next_at"))


@R.q("j8_v1_next_arrival", "looks arrivals", """SELECT p.id, a.arrived_at, (a.arrived_at-p.predicted_at)/1000e0 actual_sec FROM looks p ASOF JOIN arrivals a ON p.bus_id=a.bus_id AND p.to_stop_id=a.stop_id AND p.predicted_at < a.arrived_at
   WHERE (a.arrived_at-p.predicted_at)/1000e0 <= 900 AND (a.arrived_at-p.predicted_at)/1000e0 <= p.predicted_sec*3+60""")
def _j8(p, a):
    j = asof.v1_next_arrival(p.select("id", "bus_id", F.col("to_stop_id").alias("stop_id"), "predicted_at", "predicted_sec"), a, ["bus_id", "stop_id"])
    return j.select("id", "arrived_at", "actual_sec")


@R.q("j9_asof_prev", "arrivals", f"""SELECT a.id, CASE WHEN a.arrived_at-120000-d.departed_at <= {2*D} THEN d.departed_at END prev_departed FROM arrivals a ASOF LEFT JOIN (SELECT * FROM arrivals WHERE departed_at IS NOT NULL) d
   ON a.stop_id=d.stop_id AND a.arrived_at-120000 >= d.departed_at""")
def _j9(a):
    right = a.where("departed_at IS NOT NULL").select("stop_id", "departed_at")
    j = asof.asof_prev(a.select("id", "stop_id", "arrived_at"), right, ["stop_id"], "arrived_at", "departed_at", 2 * D, lag_ms=120_000)
    return j.select("id", F.col("prev._rt").alias("prev_departed"))


def _ivs(v, stops):
    return v.join(stops, "stop_id").select(F.col("id").alias("iv_id"), "bus_id", (F.col("arrived_at") - 60_000).alias("from_ms"), (F.col("arrived_at") + 20_000).alias("to_ms"), "lat", "lon")


@R.q("j10_positions_in_window", "arrivals stops positions", f"""WITH iv AS (SELECT a.id iv_id, bus_id, arrived_at-60000 lo, arrived_at+20000 hi, lat sla, lon slo FROM arrivals a JOIN stops USING (stop_id)),
  j AS (SELECT iv.*, p.collected_at t, {_m('p.lat','p.lon','sla','slo')} d, LAG(p.collected_at) OVER (PARTITION BY iv_id ORDER BY p.collected_at, p.ingest_seq) pt FROM iv LEFT JOIN positions p ON p.bus_id=iv.bus_id AND p.collected_at BETWEEN lo AND hi+120000)
  SELECT iv_id, ROUND(MIN(d),5) closest_fix_m, COUNT(*) FILTER (t <= hi) covered, GREATEST(COALESCE(MAX(t-GREATEST(COALESCE(pt,lo),lo)) FILTER (t <= hi),0), hi-COALESCE(MAX(t) FILTER (t<=hi),lo)) max_gap_ms FROM j GROUP BY iv_id, lo, hi""")
def _j10(a, stops, pos):
    return rounded(N.positions_in_window(_ivs(a, stops), pos).select("iv_id", "closest_fix_m", "covered", "max_gap_ms"), 5)


@R.q("j12_match_forecasts", "stop_visits looks", """WITH v AS (SELECT *, LAG(COALESCE(departed_at, arrived_at)) OVER (PARTITION BY bus_name, route_id, stop_id ORDER BY arrived_at, id) pe FROM stop_visits WHERE outcome='stopped' AND closest_m <= 75),
  j AS (SELECT v.id visit_id, v.arrived_at, p.predicted_at, p.predicted_sec, ROW_NUMBER() OVER (PARTITION BY v.id ORDER BY ABS(p.predicted_sec-240), p.predicted_at DESC, p.id) rn FROM v JOIN looks p ON p.bus_id=v.bus_id AND p.route_id=v.route_id AND p.to_stop_id=v.stop_id
   AND p.predicted_at BETWEEN GREATEST(v.arrived_at-2700000, COALESCE(pe+1,0)) AND v.arrived_at-15000 AND p.predicted_sec BETWEEN 180 AND 300)
  SELECT visit_id, arrived_at, predicted_at, predicted_sec, (arrived_at-predicted_at)/1000e0 actual_sec FROM j WHERE rn=1""")
def _j12(v, p):
    return N.match_forecasts(v, p, 240.0)


def _chains(idx):
    return f"""WITH RECURSIVE src AS (SELECT bus_name, id source_id, departed_at started_at, departed_at, {idx[0]} idx, departed_at dep FROM stop_visits WHERE route_id=2 AND stop_index={idx[0]} AND outcome='stopped' AND closest_m <= 75 AND departed_at IS NOT NULL AND COALESCE(how,'') <> 'gap'),
  lg AS (SELECT bus_name, from_index, departed_at, ANY_VALUE(to_index) nidx, ANY_VALUE(arrived_at) arr, ANY_VALUE(hops) hops FROM legs WHERE route_id=2 AND hops BETWEEN 1 AND 5 GROUP BY ALL HAVING COUNT(*)=1),
  vv AS (SELECT bus_name, stop_index, arrived_at arr, outcome, closest_m, departed_at, how FROM stop_visits WHERE route_id=2),
  c AS (SELECT bus_name, source_id, started_at, departed_at first_dep, CAST(idx AS BIGINT) idx, dep, FALSE fin, CAST(NULL AS BIGINT) arr FROM src
   UNION ALL SELECT c.bus_name, source_id, started_at, first_dep, nidx, v.departed_at, nidx={idx[1]}, lg.arr FROM c JOIN lg ON lg.bus_name=c.bus_name AND lg.from_index=c.idx AND lg.departed_at=c.dep JOIN vv v ON v.bus_name=c.bus_name AND v.stop_index=nidx AND v.arr=lg.arr
     WHERE NOT c.fin AND lg.arr > c.dep AND hops <= (({idx[1]}-c.idx+5)%5) AND ((nidx={idx[1]} AND v.outcome='stopped' AND v.closest_m<=75) OR (nidx<>{idx[1]} AND v.departed_at >= lg.arr AND COALESCE(v.how,'')<>'gap')))
  SELECT bus_name, source_id, started_at, first_dep departed_at, arr arrived_at, (arr-started_at)/1000e0 actual_sec FROM c WHERE fin"""


@R.q("j13_journeys", "stop_visits legs", _chains((0, 4))[len("WITH RECURSIVE"):].join(["WITH", ""]))
def _j13(v, legs):
    return P.journeys(v, legs, 2, 0, 4, 5)


ORACLE["j13_journeys"] = "WITH RECURSIVE" + ORACLE["j13_journeys"][4:]


@R.q("j14_nearest_stop", "positions ring", f"""SELECT ingest_seq, s.stop_id near_stop_id, s.stop_index near_index FROM positions p JOIN ring s ON s.route_id=p.route_id QUALIFY ROW_NUMBER() OVER (PARTITION BY ingest_seq ORDER BY ROUND({_m('p.lat','p.lon','s.lat','s.lon')},6), s.stop_index)=1""")
def _j14(pos, ring):
    return T.nearest_stop(pos, ring).select("ingest_seq", "near_stop_id", "near_index")


@R.q("j14_nearest_ahead", "positions ring", f"""SELECT ingest_seq, s.stop_id near_stop_id FROM (SELECT *, ingest_seq % 5 anc FROM positions) p JOIN ring s ON s.route_id=p.route_id AND (s.stop_index-anc+5)%5 <= 1 QUALIFY ROW_NUMBER() OVER (PARTITION BY ingest_seq ORDER BY ROUND({_m('p.lat','p.lon','s.lat','s.lon')},6), s.stop_index)=1""")
def _j14a(pos, ring):
    return T.nearest_stop(pos.withColumn("anc", F.col("ingest_seq") % 5), ring, ahead=1, anchor="anc").select("ingest_seq", "near_stop_id")


@R.q("j15_stops_near", "requests stops", f"SELECT request_id, stop_id, ROUND({_m('from_lat','from_lon','lat','lon')},5) metres FROM requests JOIN stops ON {_m('from_lat','from_lon','lat','lon')} <= 700")
def _j15(req, stops):
    p = req.select("request_id", F.col("request_id").alias("point_id"), F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon"))
    return rounded(T.stops_near(p, stops, 700.0).select("request_id", "stop_id", "metres"), 5)


@R.q("j15_walk_transfers", "stops customer", f"""WITH p AS (SELECT s.stop_id + 25*(c_custkey) stop_id, s.lat + (c_custkey%50)*1e-2 lat, s.lon + FLOOR(c_custkey/50)*0.1e0 lon FROM customer JOIN stops s ON s.stop_id=c_nationkey)
  SELECT a.stop_id from_stop_id, b.stop_id to_stop_id, ROUND({_m('a.lat','a.lon','b.lat','b.lon')},5) metres FROM p a JOIN p b ON a.stop_id<>b.stop_id AND ABS(a.lat-b.lat)<0.02 AND {_m('a.lat','a.lon','b.lat','b.lon')} <= 1300
  QUALIFY ROW_NUMBER() OVER (PARTITION BY a.stop_id ORDER BY {_m('a.lat','a.lon','b.lat','b.lon')}, b.stop_id) <= 8""")
def _j15w(stops, customer):
    # A town of stops: each customer is a stop near its nation's, shifted onto a wider grid.
    p = customer.join(stops, F.col("stop_id") == F.col("c_nationkey")).select(
        (F.col("stop_id") + 25 * F.col("c_custkey")).alias("stop_id"), (F.col("lat") + (F.col("c_custkey") % 50) * 1e-2).alias("lat"),
        (F.col("lon") + F.floor(F.col("c_custkey") / 50) * 0.1).alias("lon"))
    return rounded(T.walk_transfers(p, 1300.0).drop("rank"), 5)


@R.q("j16_next_stop", "ring", "SELECT r.route_id, r.stop_index, r.stop_id, n.stop_index next_index, n.stop_id next_stop_id FROM ring r JOIN ring n ON n.route_id=r.route_id AND n.stop_index=(r.stop_index+1)%5")
def _j16(ring):
    return T.next_stop(ring)


@R.q("j16_hops_forward", "segments route_stops", "SELECT s.id, MIN((b.stop_index-a.stop_index+5)%5) hops FROM segments s JOIN route_stops a ON a.route_id=s.route_id AND a.stop_id=s.from_stop_id JOIN route_stops b ON b.route_id=s.route_id AND b.stop_id=s.to_stop_id GROUP BY s.id")
def _j16h(s, rs):
    return T.hops_forward(s.select("id", "route_id", "from_stop_id", "to_stop_id"), rs).select("id", "hops")


_RC = f"""cost AS (SELECT r.route_id, r.stop_index, r.stop_id, n.stop_id nid, COALESCE(CASE WHEN g.n=0 THEN g.prior ELSE (g.n*g.av+8*g.prior)/(g.n+8) END, GREATEST(20, {_m('r.lat','r.lon','n.lat','n.lon')}/5.5e0)) sec,
   CASE WHEN g.prior IS NOT NULL THEN GREATEST(g.sd,5) ELSE GREATEST(20, {_m('r.lat','r.lon','n.lat','n.lon')}/5.5e0)*0.5e0 END sd, COALESCE(d.mean,15) dw, COALESCE(d.stddev,10) dsd
   FROM ring r JOIN ring n ON n.route_id=r.route_id AND n.stop_index=(r.stop_index+1)%5 LEFT JOIN seg g ON g.route_id=r.route_id AND g.from_stop_id=r.stop_id AND g.to_stop_id=n.stop_id LEFT JOIN ds d ON d.route_id=r.route_id AND d.stop_id=n.stop_id),
 pr AS (SELECT a.route_id, a.stop_index from_index, a.stop_id from_stop_id, k.h hops, MAX(CASE WHEN (c.stop_index-a.stop_index+5)%5=h-1 THEN c.nid END) to_stop_id, SUM(c.sec + CASE WHEN (c.stop_index-a.stop_index+5)%5 < h-1 THEN c.dw ELSE 0 END) mean_sec,
   SQRT(SUM(c.sd*c.sd + CASE WHEN (c.stop_index-a.stop_index+5)%5 < h-1 THEN c.dsd*c.dsd ELSE 0 END)) sd_sec
   FROM cost a JOIN (SELECT UNNEST(range(1,5)) h) k ON TRUE JOIN cost c ON c.route_id=a.route_id AND (c.stop_index-a.stop_index+5)%5 < k.h GROUP BY ALL)"""


def _pairs(ring, segments, arrivals, stops):
    # Calibration tables are stored outputs that planning reads many times.
    seg = materialize(C.segment_stats(segments, stops, NOW, NOW_DOW, NOW_HOUR))
    dw = materialize(C.dwell_stats(arrivals, NOW, NOW_DOW, NOW_HOUR))
    return materialize(P.ring_pairs(P.ring_costs(ring, seg, dw, stops))), dw


@R.q("m5_downstream_etas", "arrivals ring segments stops", f"""WITH {_SEG}, {_DW}, {_RC}, a AS (SELECT bus_id, route_id, stop_index FROM arrivals QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id ORDER BY arrived_at DESC)=1)
  SELECT bus_id, a.route_id, to_stop_id, hops, ROUND(mean_sec,4) mean_sec, ROUND(sd_sec,4) sd_sec FROM a JOIN pr ON pr.route_id=a.route_id AND pr.from_index=a.stop_index""")
def _m5(arrivals, ring, segments, stops):
    pairs, _ = _pairs(ring, segments, arrivals, stops)
    live = arrivals.groupBy("bus_id").agg(F.max_by(F.struct("route_id", "stop_index"), "arrived_at").alias("x")).select("bus_id", "x.route_id", F.col("x.stop_index").alias("from_index"))
    return rounded(P.downstream_etas(live, pairs).select("bus_id", "route_id", "to_stop_id", "hops", "mean_sec", "sd_sec"), 4)


_LIVE = f"""lv AS (SELECT bus_id, bus_name, route_id, stop_index ai, stop_id aid, CASE WHEN departed_at IS NULL THEN arrived_at END since, {NOW}-(bus_id%90)*1000 seen FROM arrivals QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id ORDER BY arrived_at DESC)=1),
 wx AS (SELECT lv.*, to_id, m, s FROM lv JOIN (SELECT route_id, from_index, to_stop_id to_id, mean_sec m, sd_sec s FROM pr UNION ALL SELECT route_id, stop_index, stop_id, 0, 0 FROM ring) t ON t.route_id=lv.route_id AND t.from_index=lv.ai),
 wt AS (SELECT route_id, to_id stop_id, GREATEST(0, GREATEST(0, m - CASE WHEN since IS NOT NULL THEN LEAST(GREATEST(0,({NOW}-since)/1000e0), COALESCE((SELECT mean FROM ds WHERE ds.route_id=wx.route_id AND ds.stop_id=wx.aid),15)) ELSE 0 END) - ({NOW}-seen)/1000e0) wait_sec, s sd_sec, bus_name, bus_id FROM wx),
 wait AS (SELECT * FROM wt QUALIFY ROW_NUMBER() OVER (PARTITION BY route_id, stop_id ORDER BY wait_sec, bus_id)=1)"""


def _live(arrivals):
    l = arrivals.groupBy("bus_id").agg(F.max_by(F.struct("bus_name", "route_id", "stop_index", "stop_id", "departed_at", "arrived_at"), "arrived_at").alias("x"))
    return l.select("bus_id", "x.bus_name", "x.route_id", F.col("x.stop_index").alias("anchor_index"), F.col("x.stop_id").alias("anchor_stop_id"),
                    F.when(F.col("x.departed_at").isNull(), F.col("x.arrived_at")).alias("at_stop_since"), (F.lit(NOW) - (F.col("bus_id") % 90) * 1000).alias("collected_at"))


@R.q("m5_expected_wait", "arrivals ring segments stops", f"WITH {_SEG}, {_DW}, {_RC}, {_LIVE} SELECT route_id, stop_id, ROUND(wait_sec,4) wait_sec, bus_name FROM wait")
def _m5w(arrivals, ring, segments, stops):
    pairs, dw = _pairs(ring, segments, arrivals, stops)
    return rounded(P.expected_wait(_live(arrivals), pairs, dw, NOW).select("route_id", "stop_id", "wait_sec", "bus_name"), 4)


_W = "/1.1e0"


@R.q("j19_od_candidates", "requests arrivals ring segments stops", f"""WITH {_SEG}, {_DW}, {_RC}, {_LIVE}, b AS (SELECT request_id, stop_id, {_m('from_lat','from_lon','lat','lon')}{_W} w FROM requests JOIN stops ON {_m('from_lat','from_lon','lat','lon')} <= 1500),
  a AS (SELECT request_id, stop_id, {_m('to_lat','to_lon','lat','lon')}{_W} w FROM requests JOIN stops ON {_m('to_lat','to_lon','lat','lon')} <= 1500),
  d AS (SELECT request_id, {_m('from_lat','from_lon','to_lat','to_lon')}{_W} dw FROM requests),
  r AS (SELECT b.request_id, wait.route_id, b.stop_id bs, a.stop_id als, b.w+wait_sec+mean_sec+a.w total FROM b JOIN wait ON wait.stop_id=b.stop_id JOIN pr ON pr.route_id=wait.route_id AND pr.from_stop_id=b.stop_id JOIN a ON a.request_id=b.request_id AND a.stop_id=pr.to_stop_id JOIN d ON d.request_id=b.request_id
   WHERE dw > 0 AND dw-(b.w+a.w) >= LEAST(dw*0.2e0, GREATEST(120, dw*0.1e0))),
  t AS (SELECT request_id, 'ride' AS mode, route_id, bs board_stop_id, als alight_stop_id, total FROM r QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY ROUND(total,4), route_id, bs, als) <= 3)
  SELECT request_id, mode, route_id, board_stop_id, alight_stop_id, ROUND(total,4) total_sec FROM t UNION ALL SELECT request_id, 'walk', NULL, NULL, NULL, ROUND(dw,4) FROM d WHERE dw <= 3600""")
def _j19(req, arrivals, ring, segments, stops):
    pairs, dw = _pairs(ring, segments, arrivals, stops)
    wait = P.expected_wait(_live(arrivals), pairs, dw, NOW)
    o = P.od_candidates(req, stops, ring, pairs, wait)
    return rounded(o.select("request_id", "mode", "route_id", "board_stop_id", "alight_stop_id", "total_sec"), 4)


@R.q("j19_potential_routes", "requests ring stops", f"""WITH b AS (SELECT request_id, stop_id, {_m('from_lat','from_lon','lat','lon')}{_W} w FROM requests JOIN stops ON {_m('from_lat','from_lon','lat','lon')} <= 1500), a AS (SELECT request_id, stop_id, {_m('to_lat','to_lon','lat','lon')}{_W} w FROM requests JOIN stops ON {_m('to_lat','to_lon','lat','lon')} <= 1500)
  SELECT b.request_id, r.route_id, ROUND(MIN(b.w+a.w),4) walk_sec FROM b JOIN a ON a.request_id=b.request_id AND a.stop_id<>b.stop_id JOIN ring r ON r.stop_id=b.stop_id JOIN ring q ON q.stop_id=a.stop_id AND q.route_id=r.route_id WHERE r.route_id > 3 GROUP BY ALL""")
def _j19p(req, ring, stops):
    return rounded(P.potential_routes(req, stops, ring, ring.where("route_id <= 3")).select("request_id", "route_id", "walk_sec"), 4)


_WIN = [(r, d, 420 + 60 * r, 1080 + 120 * r) for r in range(1, 5) for d in range(7) if (d + r) % 3]


@R.q("j20_service_state", "arrivals region", "WITH w AS (SELECT r.route_id, d.d dow, 420+60*r.route_id s, 1080+120*r.route_id e FROM (SELECT UNNEST([1,2,3,4]) route_id) r, LATERAL (SELECT UNNEST(range(7)) d) d WHERE (d.d+r.route_id)%3<>0), " +
     """x AS (SELECT id, route_id, {LDOW(arrived_at)} dw, {LMIN(arrived_at)} mi FROM arrivals),
  y AS (SELECT x.id, BOOL_OR((w.dow=(dw+6)%7 AND e>1440 AND mi<e-1440) OR (w.dow=dw AND mi>=s AND (e>1440 OR mi<e))) op, MAX(CASE WHEN w.dow=(dw+6)%7 AND mi-(e-1440)<=90 THEN e-1440 WHEN w.dow=dw AND mi>=s THEN e END) cl, BOOL_OR(w.dow=dw AND mi<s) la FROM x LEFT JOIN w ON w.route_id=x.route_id GROUP BY x.id)
  SELECT id, CASE WHEN op THEN 'open' WHEN cl IS NOT NULL THEN 'after-close' WHEN la THEN 'before-open' ELSE 'off-day' END state FROM y""")
def _j20(a, region):
    # Four routes with weekly windows, derived from the first four regions.
    w = region.where("r_regionkey < 4").select((F.col("r_regionkey") + 1).cast("long").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow"))
    w = w.where((F.col("dow") + F.col("route_id")) % 3 != 0).withColumn("start_min", (420 + 60 * F.col("route_id")).cast("int")).withColumn("end_min", (1080 + 120 * F.col("route_id")).cast("int"))
    return N.service_state(a.select("id", "route_id", F.col("arrived_at").alias("at_ms")), w).select("id", "state")


@R.q("j24_active_windows", "arrivals positions", """WITH w AS (SELECT id win_id, route_id, arrived_at//60000*60000-60000 lo, arrived_at//60000*60000+240000 hi FROM arrivals), m AS (SELECT DISTINCT route_id, collected_at//60000 m FROM positions),
  e AS (SELECT *, UNNEST(range(lo//60000, (hi-1)//60000+1)) m FROM w) SELECT win_id, e.route_id, COUNT(*) AS minutes, COUNT(m.m) active FROM e LEFT JOIN m ON m.route_id=e.route_id AND m.m=e.m GROUP BY ALL HAVING COUNT(m.m) >= COUNT(*)*0.8""")
def _j24(a, pos):
    lo = F.floor(F.col("arrived_at") / 60_000) * 60_000
    return N.active_windows(a.select(F.col("id").alias("win_id"), "route_id", (lo - 60_000).alias("from_ms"), (lo + 240_000).alias("to_ms")), pos)


@R.q("w20_hold_within", "arrivals", """WITH l AS (SELECT id leg_id, bus_id, arrived_at-3600000 lo, arrived_at+3600000 hi FROM arrivals), r AS (SELECT bus_id, arrived_at a, departed_at b FROM arrivals WHERE departed_at-arrived_at >= 15000)
  SELECT leg_id, COALESCE(SUM(CASE WHEN r.a IS NOT NULL THEN LEAST(hi,b)-GREATEST(lo,a) END),0)/1000e0 hold_sec FROM l LEFT JOIN r ON r.bus_id=l.bus_id AND LEAST(hi,b) > GREATEST(lo,a) GROUP BY leg_id""")
def _w20(a):
    runs = a.where("departed_at IS NOT NULL").select("bus_id", F.col("arrived_at").alias("run_from"), F.col("departed_at").alias("run_to"))
    legs = a.select(F.col("id").alias("leg_id"), "bus_id", (F.col("arrived_at") - 3_600_000).alias("from_ms"), (F.col("arrived_at") + 3_600_000).alias("to_ms"))
    return N.hold_within(runs, legs).select("leg_id", "hold_sec")


@R.q("a54_arrival_board", "predictions", """WITH r AS (SELECT route_id, to_stop_id stop_id, bus_id, predicted_sec sec, predicted_low_sec lo, predicted_high_sec hi, ROW_NUMBER() OVER (PARTITION BY route_id, to_stop_id ORDER BY predicted_sec, bus_id) rn
    FROM (SELECT * FROM predictions QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id, route_id, to_stop_id ORDER BY predicted_at DESC, id DESC)=1)),
  p AS (SELECT a.route_id, a.stop_id, a.bus_id lead_bus, a.sec lead_sec, b.bus_id next_bus, b.sec next_sec, {S}(a.lo) <> {S}(a.hi) band, CASE WHEN {S}(a.lo)<>{S}(a.hi) THEN {S}(a.lo) ELSE {S}(a.sec) END l, CASE WHEN {S}(a.lo)<>{S}(a.hi) THEN {S}(a.hi) ELSE {S}(a.sec) END h, {S}(b.sec) nx, {S}(b.lo) nl
    FROM r a LEFT JOIN r b ON b.route_id=a.route_id AND b.stop_id=a.stop_id AND b.rn=2 WHERE a.rn=1)
  SELECT route_id, stop_id, lead_bus, lead_sec, next_bus, next_sec, CASE WHEN band AND nx<=h THEN 'inside-band' WHEN NOT band AND nx=l THEN 'same-minute' WHEN nl <= h THEN 'next-band-overlap' END reason FROM p""")
def _a54(p):
    e = p.groupBy("bus_id", "route_id", "to_stop_id").agg(F.max_by(F.struct("predicted_sec", "predicted_low_sec", "predicted_high_sec"), F.struct("predicted_at", "id")).alias("x"))
    e = e.select("route_id", F.col("to_stop_id").alias("stop_id"), "bus_id", F.col("x.predicted_sec").alias("sec"), F.col("x.predicted_low_sec").alias("low_sec"), F.col("x.predicted_high_sec").alias("high_sec"))
    return P.arrival_board(e).drop("bunched")


import re as _re  # noqa: E402

ORACLE["a54_arrival_board"] = _re.sub(r"\{S\}\(([a-z.]+)\)", r"(CASE WHEN \1 < 10 THEN 0 WHEN \1 < 60 THEN 0.5 ELSE FLOOR(\1/60) END)", ORACLE["a54_arrival_board"])


def _paths(ring):
    """Each route's stops as its published line, with a mid vertex between neighbours."""
    n = T.next_stop(ring).join(ring.select("route_id", "stop_index", F.col("lat").alias("la"), F.col("lon").alias("lo")), ["route_id", "stop_index"])
    b = ring.select("route_id", F.col("stop_index").alias("next_index"), F.col("lat").alias("lb"), F.col("lon").alias("lob"))
    e = n.join(b, ["route_id", "next_index"])
    v = e.select("route_id", "stop_index", F.array(F.struct(F.col("la").alias("lat"), F.col("lo").alias("lon")),
                                                   F.struct((((F.col("la") + F.col("lb")) / 2) + 0.0003).alias("lat"), ((F.col("lo") + F.col("lob")) / 2).alias("lon"))).alias("p"))
    return v.groupBy("route_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("stop_index", "p"))), lambda x: x["p"])).alias("path"))


@R.q("f4_leg_road_metres", "ring", f"""SELECT a.route_id, a.stop_id from_stop_id, b.stop_id to_stop_id, ROUND({_m('a.lat','a.lon','((a.lat+b.lat)/2+0.0003e0)','((a.lon+b.lon)/2)')} + {_m('((a.lat+b.lat)/2+0.0003e0)','((a.lon+b.lon)/2)','b.lat','b.lon')},4) road_m
  FROM ring a JOIN ring b ON b.route_id=a.route_id AND b.stop_index=(a.stop_index+1)%5""")
def _f4(ring):
    return rounded(T.leg_road_metres(ring, _paths(ring)), 4)


@R.q("a57_leg_coverage", "ring", "SELECT route_id, COUNT(*) hops, 1e0 share FROM ring GROUP BY route_id")
def _a57(ring):
    return T.leg_coverage(ring, T.leg_road_metres(ring, _paths(ring)))


@R.q("w18_path_quality", "ring", f"""WITH v AS (SELECT a.route_id, a.stop_index*2 i, a.lat, a.lon FROM ring a UNION ALL SELECT a.route_id, a.stop_index*2+1, (a.lat+b.lat)/2+0.0003e0, (a.lon+b.lon)/2 FROM ring a JOIN ring b ON b.route_id=a.route_id AND b.stop_index=(a.stop_index+1)%5),
  l AS (SELECT *, LAG(lat) OVER w pla, LAG(lon) OVER w plo FROM v WINDOW w AS (PARTITION BY route_id ORDER BY i)) SELECT route_id, COUNT(*)//2 stop_count, 0e0 median_m, 0e0 p90_m, 0e0 max_m, ROUND(SUM({_m('pla','plo','lat','lon')}),4) length_m FROM l GROUP BY route_id""")
def _w18(ring):
    return rounded(T.path_quality(_paths(ring), ring), 4)


@R.q("w18_longest_excursion", "ring positions")
def _w18x(ring, pos):
    return T.longest_excursion(_paths(ring), pos, 60.0)
