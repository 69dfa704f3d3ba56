"""Registered run, island, pass and track queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import lines
from fleetlens.operators import passes as V
from fleetlens.operators import sequence as S
from fleetlens.operators.topology import ring_arrays
from fleetlens.plans.network_queries import _m
from fleetlens.plans.reg import NOW, Registry, rounded

R = Registry()
QUERIES, ORACLE = R.queries, R.oracles
D = 86_400_000
_TW = "OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq)"


@R.q("j2_w2_latest_with_older", "positions", f"""WITH l AS (SELECT * FROM positions WHERE collected_at > {NOW-2*D} AND collected_at <= {NOW} QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id ORDER BY collected_at DESC, ingest_seq DESC)=1),
  o AS (SELECT * FROM positions WHERE collected_at > {NOW-5*D} AND collected_at < {NOW-2*D} QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id ORDER BY collected_at, ingest_seq)=1)
  SELECT l.bus_id, l.collected_at, o.lat old_lat, COALESCE(SQRT(POWER((l.lat-o.lat)*111000,2)+POWER((l.lon-o.lon)*111000*0.75e0,2)) < 30, FALSE) stationary FROM l LEFT JOIN o ON o.bus_id=l.bus_id""")
def _j2(p):
    return S.stationary(S.latest_with_older(p, NOW, 2 * D, 5 * D)).select("bus_id", "collected_at", "old_lat", "stationary")


@R.q("w1_latest_by", "positions", "SELECT bus_name, ingest_seq, collected_at FROM positions QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_name ORDER BY collected_at DESC, ingest_seq DESC)=1")
def _w1(p):
    from fleetlens.operators.grain import latest_by
    return latest_by(p, ["bus_name"], "collected_at", "ingest_seq").select("bus_name", "ingest_seq", "collected_at")


# Whether each fix lies in a forward ball that lasts: every pair of fixes of a stretch.
STILL = """t AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq) rn, SUM(CASE WHEN pt IS NULL OR collected_at-pt > 60000 THEN 1 ELSE 0 END) OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq) se
    FROM (SELECT *, LAG(collected_at) OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq) pt FROM positions)),
  p AS (SELECT a.bus_name, a.se, a.rn i, b.rn j, b.collected_at-a.collected_at dt, 6371000*SQRT(POWER(RADIANS(b.lon-a.lon)*COS(RADIANS((a.lat+b.lat)/2)),2)+POWER(RADIANS(b.lat-a.lat),2)) <= 25 ok FROM t a JOIN t b ON a.bus_name=b.bus_name AND a.se=b.se AND b.rn >= a.rn),
  e AS (SELECT bus_name, i, MIN(CASE WHEN NOT ok THEN j END) brk FROM p GROUP BY ALL),
  r AS (SELECT p.bus_name, p.i, MAX(p.j) j, MAX(dt) dt FROM p JOIN e ON e.bus_name=p.bus_name AND e.i=p.i WHERE brk IS NULL OR p.j < brk GROUP BY ALL),
  still AS (SELECT t.ingest_seq, EXISTS (SELECT 1 FROM r WHERE r.bus_name=t.bus_name AND r.dt >= 15000 AND t.rn BETWEEN r.i AND r.j) still FROM t)"""


@R.q("w3_still_runs", "positions", f"WITH {STILL} SELECT ingest_seq, still FROM still")
def _w3(p):
    return S.still_runs(p).select("ingest_seq", "still")


@R.q("w4_frozen_runs", "positions", f"""WITH t AS (SELECT *, CASE WHEN lat IS DISTINCT FROM LAG(lat) {_TW} OR lon IS DISTINCT FROM LAG(lon) {_TW} THEN 1 ELSE 0 END n FROM positions),
  r AS (SELECT *, SUM(n) {_TW} g FROM t) SELECT bus_name, MIN(collected_at) run_from, MAX(collected_at) run_to, COUNT(*) fixes FROM r GROUP BY bus_name, g HAVING MAX(collected_at)-MIN(collected_at) >= 10000""")
def _w4(p):
    return S.frozen_runs(p).select("bus_name", "run_from", "run_to", "fixes")


@R.q("w5_lap_ages", "arrivals", """SELECT id, (arrived_at-LAG(departed_at) OVER w)/1000e0 lap_sec, (departed_at-LAG(departed_at) OVER w)/1000e0 loop_sec FROM arrivals WINDOW w AS (PARTITION BY bus_name, route_id, stop_id ORDER BY arrived_at, id)""")
def _w5(a):
    return S.lap_ages(a).select("id", "lap_sec", "loop_sec")


@R.q("w5_visit_loops", "stop_visits", """WITH u AS (SELECT *, COALESCE(outcome='stopped' AND departed_at IS NOT NULL AND departed_at >= anchored_at AND COALESCE(how,'')<>'gap' AND COALESCE(departed_at>=pinned_at,TRUE),FALSE) ok FROM stop_visits),
  l AS (SELECT *, LAST_VALUE(CASE WHEN ok THEN departed_at END IGNORE NULLS) OVER (PARTITION BY bus_name, route_id, stop_id, stop_index ORDER BY anchored_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) pd FROM u)
  SELECT id, CASE WHEN pd < anchored_at THEN pd END prev_departure_at, CASE WHEN ok AND pd < anchored_at AND departed_at > pd THEN (departed_at-pd)/1000e0 END loop_sec FROM l""")
def _w5v(v):
    return V.with_loop(v).select("id", "prev_departure_at", "loop_sec")


@R.q("w7_stop_chains", "arrivals ring")
def _w7(a, ring):
    return S.stop_chains(a, ring, gap_ms=D)


@R.q("w11_presence_runs", "positions", """WITH d AS (SELECT *, CAST(timezone('America/New_York', make_timestamptz(collected_at*1000)) - INTERVAL 4 HOURS AS DATE) sd FROM positions),
  t AS (SELECT *, CASE WHEN collected_at-LAG(collected_at) OVER w <= 600000 THEN 0 ELSE 1 END n FROM d WINDOW w AS (PARTITION BY bus_name, route_id, sd ORDER BY collected_at, ingest_seq)),
  r AS (SELECT *, SUM(n) OVER (PARTITION BY bus_name, route_id, sd ORDER BY collected_at, ingest_seq) g FROM t)
  SELECT bus_name, route_id, sd service_day, MIN(collected_at) from_ms, MAX(collected_at) to_ms, COUNT(*) fixes, (SELECT MAX(collected_at) FROM positions)-MAX(collected_at) <= 600000 censored FROM r GROUP BY bus_name, route_id, sd, g""")
def _w11(p):
    return S.presence_runs(p).drop("run")


@R.q("w12_merge_split_arrivals", "arrivals", f"""WITH a AS (SELECT id, bus_name, route_id, 1 stop_id, arrived_at, CASE WHEN id%2=0 THEN NULL ELSE departed_at END departed_at FROM arrivals),
  t AS (SELECT *, CASE WHEN LAG(route_id) OVER w=route_id AND LAG(departed_at) OVER w IS NULL AND arrived_at-LAG(arrived_at) OVER w <= {D} AND id%3=0 THEN 0 ELSE 1 END n FROM a WINDOW w AS (PARTITION BY bus_name ORDER BY arrived_at, id)),
  r AS (SELECT *, SUM(n) OVER (PARTITION BY bus_name ORDER BY arrived_at, id) g FROM t)
  SELECT bus_name, ARG_MIN(id, arrived_at) id, MIN(arrived_at) arrived_at, LAST(departed_at ORDER BY arrived_at, id) departed_at, COUNT(*) parts FROM r GROUP BY bus_name, g""")
def _w12(a):
    b = a.select("id", "bus_name", "route_id", F.lit(1).cast("long").alias("stop_id"), "arrived_at", F.when(F.col("id") % 2 == 1, F.col("departed_at")).alias("departed_at"))
    return S.merge_split_arrivals(b, b.where("id % 3 = 0").select("arrived_at", "bus_name", "id"), D).select("bus_name", "id", "arrived_at", "departed_at", "parts")


_JR = """j AS (SELECT *, predicted_at+predicted_sec*1000 inst, LAG(predicted_at+predicted_sec*1000) OVER w pi, LAG(predicted_at) OVER w pa, LAG(predicted_sec) OVER w ps FROM looks WINDOW w AS (PARTITION BY surface, bus_id, to_stop_id ORDER BY predicted_at, id)),
 r AS (SELECT *, (inst-pi)/1000 mv FROM j WHERE predicted_at-pa <= 300000)"""


@R.q("a49_jump_stats", "looks", f"""WITH {_JR} SELECT surface, COUNT(*) n, ROUND(QUANTILE_CONT(ABS(mv),0.5),6) p50, ROUND(QUANTILE_CONT(ABS(mv),0.9),6) p90, ROUND(QUANTILE_CONT(ABS(mv),0.99),6) p99, ROUND(QUANTILE_CONT(ABS(mv),0.999),6) p999,
  ROUND(AVG(CASE WHEN ABS(mv)>=300 THEN 1 ELSE 0 END),7) share_300, ROUND(AVG(CASE WHEN predicted_sec>ps THEN 1 ELSE 0 END),7) share_up FROM r GROUP BY surface""")
def _a49(p):
    return rounded(S.jump_stats(p))


@R.q("a49_board_jumps", "looks", """WITH b AS (SELECT surface, route_id, to_stop_id, predicted_at//60000 poll, MIN(predicted_at+predicted_sec*1000) inst FROM looks GROUP BY ALL), l AS (SELECT *, LAG(inst) OVER w pi, LAG(poll) OVER w pp FROM b WINDOW w AS (PARTITION BY surface, route_id, to_stop_id ORDER BY poll)),
  r AS (SELECT surface, (inst-pi)/1000 mv FROM l WHERE poll-pp=1) SELECT surface, COUNT(*) n, ROUND(QUANTILE_CONT(ABS(mv),0.5),6) p50, ROUND(QUANTILE_CONT(ABS(mv),0.9),6) p90, ROUND(QUANTILE_CONT(ABS(mv),0.99),6) p99, ROUND(QUANTILE_CONT(ABS(mv),0.999),6) p999,
  ROUND(AVG(CASE WHEN ABS(mv)>=300 THEN 1 ELSE 0 END),7) share_300, ROUND(AVG(CASE WHEN mv>0 THEN 1 ELSE 0 END),7) share_up FROM r GROUP BY surface""")
def _a49b(p):
    return rounded(S.board_jumps(p))


@R.q("w13_classify_jumps", "looks positions arrivals", f"""WITH {_JR}, k AS (SELECT id jump_id, bus_id, pa lo, predicted_at hi, mv FROM r WHERE ABS(mv) >= 180),
  a AS (SELECT jump_id FROM k ASOF JOIN (SELECT bus_id, arrived_at FROM arrivals) ar ON ar.bus_id=k.bus_id AND k.lo < ar.arrived_at WHERE ar.arrived_at <= hi),
  pp AS (SELECT bus_id, collected_at, ARG_MAX(lat, ingest_seq) lat, ARG_MAX(lon, ingest_seq) lon FROM positions GROUP BY ALL),
  px AS (SELECT jump_id, k.bus_id, lo, hi, p.lat xla, p.lon xlo FROM k ASOF JOIN pp p ON p.bus_id=k.bus_id AND p.collected_at <= k.lo WHERE p.collected_at >= lo-60000),
  m AS (SELECT jump_id, {_m('xla','xlo','p.lat','p.lon')} d FROM px ASOF JOIN pp p ON p.bus_id=px.bus_id AND p.collected_at <= px.hi)
  SELECT k.jump_id, ROUND(mv,6) move_sec, CASE WHEN a.jump_id IS NOT NULL THEN 'arrival' WHEN d IS NULL THEN 'no fix' WHEN d >= 100 THEN 'moved far' WHEN d > 0 THEN 'moved near' ELSE 'same fix' END cause FROM k LEFT JOIN a USING (jump_id) LEFT JOIN m USING (jump_id)""")
def _w13(p, pos, a):
    return rounded(S.classify_jumps(p, pos, a), 6)


@R.q("w19_recent_speed", "positions", f"""WITH o AS (SELECT bus_name, collected_at, MIN(ingest_seq) ingest_seq, ARG_MIN(lat, ingest_seq) lat, ARG_MIN(lon, ingest_seq) lon FROM positions GROUP BY bus_name, collected_at),
  t AS (SELECT *, LAG(collected_at) {_TW} pt, LAG(lat) {_TW} pla, LAG(lon) {_TW} plo FROM o),
  s AS (SELECT *, {_m('pla','plo','lat','lon')} st, CASE WHEN pt IS NULL OR collected_at-pt>20000 OR {_m('pla','plo','lat','lon')} > 50*(collected_at-pt)/1000 THEN 1 ELSE 0 END n FROM t), g AS (SELECT *, SUM(n) {_TW} gr FROM s),
  f AS (SELECT bus_name, gr, ingest_seq, collected_at ft, unnest([collected_at//30000, collected_at//30000-1]) c FROM g),
  x AS (SELECT bus_name, gr, collected_at b, pt, st, lat, lon, pla, plo, collected_at//30000 c FROM g WHERE n=0),
  j AS (SELECT f.ingest_seq, x.*, (b-GREATEST(pt,ft-30000)) ms, (b-GREATEST(pt,ft-30000))/(b-pt) fr FROM f JOIN x USING (bus_name, gr, c) WHERE b <= ft AND b > ft-30000),
  k AS (SELECT ingest_seq, SUM(st*fr) m, SUM(ms) ms, ARG_MIN({{'la': lat+(pla-lat)*fr, 'lo': lon+(plo-lon)*fr}}, b) o, LIST({{'la': lat, 'lo': lon}}) pts FROM j GROUP BY ingest_seq),
  e AS (SELECT *, list_max(list_transform(pts, lambda p: {_m('o.la','o.lo','p.la','p.lo')})) ext FROM k)
  SELECT p.ingest_seq, CASE WHEN ms >= 25000 AND ext >= 15 THEN ROUND(m/(ms/1000e0),5) END speed_mps FROM positions p LEFT JOIN e USING (ingest_seq)""")
def _w19(p):
    return rounded(S.recent_speed(p).select("ingest_seq", "speed_mps"), 5)


def near_ctes(enter_m: float, exit_m: float = 120.0) -> str:
    """``hit``: entries near a stop, by the nearest point of each step."""
    return f"""tw AS (SELECT *, LAG(collected_at) OVER w pt, LAG(lat) OVER w pla, LAG(lon) OVER w plo FROM positions WINDOW w AS (PARTITION BY bus_name ORDER BY collected_at, ingest_seq)),
  nx AS (SELECT tw.*, s.stop_id, (plo-s.lon)*111320*cos(radians(s.lat)) ax, (pla-s.lat)*111320 ay, (tw.lon-s.lon)*111320*cos(radians(s.lat)) bx, (tw.lat-s.lat)*111320 byy, COALESCE(collected_at-pt <= 60000, false) linked FROM tw JOIN ring s ON s.route_id=tw.route_id),
  nt AS (SELECT *, sqrt(bx*bx+byy*byy) far, CASE WHEN (bx-ax)*(bx-ax)+(byy-ay)*(byy-ay) > 0 THEN GREATEST(0, LEAST(1, ((0-ax)*(bx-ax)+(0-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)))) ELSE 0 END t FROM nx),
  nf AS (SELECT *, CASE WHEN CASE WHEN linked THEN sqrt((ax+t*(bx-ax))*(ax+t*(bx-ax))+(ay+t*(byy-ay))*(ay+t*(byy-ay))) ELSE far END <= {enter_m} THEN 1 WHEN far >= {exit_m} THEN 0 END flag FROM nt),
  nl AS (SELECT *, LAG(flag) OVER (PARTITION BY bus_name, stop_id ORDER BY collected_at, ingest_seq) pf FROM nf WHERE flag IS NOT NULL),
  hit AS (SELECT bus_name, bus_id, route_id, stop_id, CASE WHEN linked THEN pt+t*(collected_at-pt) ELSE collected_at END entered_at, ingest_seq FROM nl WHERE flag=1 AND COALESCE(pf=0, true))"""


@R.q("w21_proximity_arrivals", "positions ring", f"WITH {near_ctes(50)} SELECT bus_name, bus_id, route_id, stop_id, ROUND(entered_at, 3) entered_at, ingest_seq FROM hit")
def _w21(p, ring):
    return rounded(S.proximity_arrivals(p, ring), 3)


@R.q("w21_pair_proximity", "positions ring arrivals", f"""WITH {near_ctes(50)}, g AS (SELECT a.id, arg_min(h.entered_at, (ABS(h.entered_at-a.arrived_at), h.entered_at)) entered_at FROM arrivals a JOIN hit h ON h.bus_name=a.bus_name AND h.stop_id=a.stop_id
    AND h.entered_at BETWEEN a.arrived_at-90000 AND a.arrived_at+300000 GROUP BY a.id) SELECT a.id, a.arrived_at, ROUND(g.entered_at, 3) entered_at FROM arrivals a LEFT JOIN g USING (id)""")
def _w21p(p, ring, a):
    return rounded(S.pair_proximity(S.proximity_arrivals(p, ring), a), 3)


@R.q("w22_parked_episodes", "positions ring", f"""WITH n AS (SELECT p.*, s.stop_id ns, ROUND({_m('p.lat','p.lon','s.lat','s.lon')},6) d FROM positions p JOIN ring s ON s.route_id=p.route_id QUALIFY ROW_NUMBER() OVER (PARTITION BY ingest_seq ORDER BY ROUND({_m('p.lat','p.lon','s.lat','s.lon')},6), s.stop_index)=1),
  a AS (SELECT *, CASE WHEN d <= 75 THEN ns END ats FROM n), t AS (SELECT *, CASE WHEN LAG(collected_at) {_TW} IS NULL OR LAG(ats) {_TW} IS DISTINCT FROM ats OR (collected_at-LAG(collected_at) {_TW} > 60000 AND {_m(f'(LAG(lat) {_TW})', f'(LAG(lon) {_TW})','lat','lon')} >= 40) THEN 1 ELSE 0 END nw FROM a),
  r AS (SELECT *, SUM(nw) {_TW} ep FROM t) SELECT bus_name, MIN(ats) stop_id, MIN(collected_at) from_ms, MAX(collected_at) to_ms, COUNT(*) fixes, MAX(collected_at)-MIN(collected_at) >= 180000 layover FROM r WHERE ats IS NOT NULL GROUP BY bus_name, ep HAVING MAX(collected_at)-MIN(collected_at) >= 15000""")
def _w22(p, ring):
    return S.parked_episodes(p, ring, min_ms=15_000)


@R.q("w23_headways", "stop_visits", """WITH l AS (SELECT *, LEAD(arrived_at) OVER (PARTITION BY route_id, stop_index ORDER BY arrived_at, id) nx FROM stop_visits), h AS (SELECT route_id, (nx-departed_at)/1000e0 h FROM l WHERE nx >= departed_at)
  SELECT route_id, COUNT(*) n, ROUND(QUANTILE_CONT(h,0.1),6) p10, ROUND(QUANTILE_CONT(h,0.5),6) p50, ROUND(QUANTILE_CONT(h,0.9),6) p90 FROM h GROUP BY route_id""")
def _w23(v):
    return rounded(S.headways(v), 6)


@R.q("w24_label_approach", "positions ring", f"""WITH n AS (SELECT p.*, s.stop_id ns, ROUND({_m('p.lat','p.lon','s.lat','s.lon')},6) d FROM positions p JOIN ring s ON s.route_id=p.route_id QUALIFY ROW_NUMBER() OVER (PARTITION BY ingest_seq ORDER BY ROUND({_m('p.lat','p.lon','s.lat','s.lon')},6), s.stop_index)=1),
  t AS (SELECT *, CASE WHEN LAG(ns) {_TW} IS DISTINCT FROM ns OR collected_at-LAG(collected_at) {_TW} > 60000 THEN 1 ELSE 0 END nw FROM n), r AS (SELECT *, SUM(nw) {_TW} ep FROM t), b AS (SELECT *, MIN(d) OVER (PARTITION BY bus_name, ep) best FROM r),
  e AS (SELECT *, MIN(CASE WHEN d <= best+20 THEN collected_at END) OVER (PARTITION BY bus_name, ep) lo, MAX(CASE WHEN d <= best+20 THEN collected_at END) OVER (PARTITION BY bus_name, ep) hi FROM b),
  l AS (SELECT CASE WHEN collected_at < lo THEN 'approach' WHEN collected_at > hi THEN 'past' ELSE 'at' END label, last_stop_id=ns same FROM e) SELECT label, COUNT(*) fixes, COUNT(*) FILTER (same) last_stop_is_near FROM l GROUP BY label""")
def _w24(p, ring):
    fixes = p.select("bus_name", "route_id", "lat", "lon", "collected_at", "ingest_seq", "last_stop_id")
    return S.approach_scores(S.label_approach(fixes, ring))


@R.q("t2a_v1_transitions", "positions ring", """WITH n AS (SELECT p.*, s.stop_id ns, s.stop_index si FROM positions p JOIN ring s ON s.route_id=p.route_id QUALIFY ROW_NUMBER() OVER (PARTITION BY ingest_seq ORDER BY ROUND((p.lat-s.lat)*(p.lat-s.lat)+(p.lon-s.lon)*(p.lon-s.lon),12), s.stop_index)=1),
  t AS (SELECT *, CASE WHEN LAG(ns) OVER w IS DISTINCT FROM ns THEN 1 ELSE 0 END nw FROM n WINDOW w AS (PARTITION BY bus_id ORDER BY collected_at, ingest_seq)), r AS (SELECT *, SUM(nw) OVER (PARTITION BY bus_id ORDER BY collected_at, ingest_seq) ep FROM t),
  e AS (SELECT bus_id, ep, MIN(ns) stop_id, MIN(si) si, MIN(collected_at) arrived_at FROM r GROUP BY ALL), l AS (SELECT *, (LEAD(arrived_at) OVER w-arrived_at)/1000e0 dw, (si-LAG(si) OVER w+5)%5 h, LAG(stop_id) OVER w ps, (arrived_at-LAG(arrived_at) OVER w)/1000e0 tr FROM e WINDOW w AS (PARTITION BY bus_id ORDER BY arrived_at, ep))
  SELECT bus_id, stop_id, arrived_at, CASE WHEN dw BETWEEN 15 AND 3600 THEN dw END dwell_sec, CASE WHEN h BETWEEN 1 AND 5 THEN ps END from_stop_id, CASE WHEN h BETWEEN 1 AND 5 THEN tr END travel_sec FROM l""")
def _t2a(p, ring):
    return S.v1_transitions(p, ring).select("bus_id", "stop_id", "arrived_at", "dwell_sec", "from_stop_id", "travel_sec")


@R.q("t2b_v1_close_arrivals", "positions", """WITH c AS (SELECT * FROM positions QUALIFY LAG(last_stop_id) OVER (PARTITION BY bus_id ORDER BY collected_at, ingest_seq) IS DISTINCT FROM last_stop_id)
  SELECT bus_id, last_stop_id stop_id, collected_at arrived_at, LEAD(collected_at) OVER (PARTITION BY bus_id ORDER BY collected_at, ingest_seq) departed_at FROM c""")
def _t2b(p):
    return S.v1_close_arrivals(p).select("bus_id", "stop_id", "arrived_at", "departed_at")


@R.q("w17_derive_paths", "positions ring")
def _w17(p, ring):
    # Fixes that wander a few metres: drives in the rehearsal are straight lines, which thin to less than a lap's vertices.
    return S.derive_paths(p.withColumn("lat", F.col("lat") + F.pmod("ingest_seq", F.lit(3)) * 0.00004), ring)


_LINE = """WITH RECURSIVE x AS (SELECT bus_id, route_id, collected_at//10800000 part, lat, lon, ROW_NUMBER() OVER (PARTITION BY bus_id, route_id, collected_at//10800000 ORDER BY collected_at, ingest_seq) i,
    COUNT(*) OVER (PARTITION BY bus_id, route_id, collected_at//10800000) n FROM positions),
  w AS (SELECT x.*, s.stop_id, DEGDIST m FROM x JOIN ring s ON s.route_id=x.route_id),
  k AS (SELECT bus_id, route_id, part, arg_min(i, (m, i)) i FROM w GROUP BY bus_id, route_id, part, stop_id UNION SELECT bus_id, route_id, part, i FROM x WHERE i=1 OR i=n),
  c AS (SELECT *, LEAD(i) OVER (PARTITION BY bus_id, route_id, part ORDER BY i) j FROM k),
  r(bus_id, route_id, part, lo, hi) AS (SELECT bus_id, route_id, part, i, j FROM c WHERE j IS NOT NULL
    UNION ALL SELECT bus_id, route_id, part, UNNEST([lo, mid]), UNNEST([mid, hi]) FROM (
      SELECT r.bus_id, r.route_id, r.part, r.lo, r.hi, arg_max(p.i, (OFF, -p.i)) mid, MAX(OFF) most FROM r JOIN x a ON a.bus_id=r.bus_id AND a.route_id=r.route_id AND a.part=r.part AND a.i=r.lo
        JOIN x b ON b.bus_id=r.bus_id AND b.route_id=r.route_id AND b.part=r.part AND b.i=r.hi JOIN x p ON p.bus_id=r.bus_id AND p.route_id=r.route_id AND p.part=r.part AND p.i>r.lo AND p.i<r.hi GROUP BY ALL) WHERE most > 0.00002),
  v AS (SELECT bus_id, route_id, part, lo i FROM r UNION SELECT bus_id, route_id, part, hi FROM r UNION SELECT bus_id, route_id, part, i FROM k)
  SELECT bus_id, route_id, part, MAX(n) n_fixes, COUNT(*) n_vertices, SUM(v.i*v.i) where_kept, ROUND(SUM(lat),6) lat_sum, ROUND(SUM(lon),6) lon_sum FROM v JOIN x USING (bus_id, route_id, part, i) GROUP BY ALL""".replace(
    "DEGDIST", "sqrt((x.lat-s.lat)*(x.lat-s.lat)+(x.lon-s.lon)*cos(radians((x.lat+s.lat)/2))*((x.lon-s.lon)*cos(radians((x.lat+s.lat)/2))))").replace(
    "OFF", "CASE WHEN sqrt((b.lon-a.lon)*(b.lon-a.lon)+(b.lat-a.lat)*(b.lat-a.lat)) < 1e-12 THEN sqrt((p.lon-a.lon)*(p.lon-a.lon)+(p.lat-a.lat)*(p.lat-a.lat)) "
    "ELSE abs((p.lon-a.lon)*(b.lat-a.lat)-(p.lat-a.lat)*(b.lon-a.lon))/sqrt((b.lon-a.lon)*(b.lon-a.lon)+(b.lat-a.lat)*(b.lat-a.lat)) END")


@R.q("f13_simplified_tracks", "positions ring", _LINE)
def _f13(p, ring):
    keys = ["bus_id", "route_id", "part"]
    d = p.withColumn("part", F.floor(F.col("collected_at") / 10_800_000).cast("long"))
    g = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("collected_at", "ingest_seq", "lat", "lon"))).alias("path"))
    g = g.select(*keys, F.transform("path", lambda v: F.struct(v["lat"].alias("lat"), v["lon"].alias("lon"), v["ingest_seq"].alias("seq"))).alias("path"))
    g = g.withColumn("seqs", F.col("path.seq")).join(ring_arrays(ring), "route_id")
    v = lines.simplified(g).select(*keys, F.size("seqs").cast("long").alias("n_fixes"), "seqs", F.explode("path").alias("v"))
    v = v.withColumn("i", F.array_position("seqs", F.col("v.seq")))
    return v.groupBy(*keys).agg(F.max("n_fixes").alias("n_fixes"), F.count(F.lit(1)).alias("n_vertices"), F.sum(F.col("i") * F.col("i")).alias("where_kept"),
                                F.round(F.sum("v.lat"), 6).alias("lat_sum"), F.round(F.sum("v.lon"), 6).alias("lon_sum"))


_PASS = f"""v AS (SELECT id, bus_id, route_id, stop_id, stop_index, anchored_at, closest_m, LAG(stop_index) OVER w pi, LAG(anchored_at) OVER w pt, LEAD(stop_index) OVER w qi, LEAD(anchored_at) OVER w qt,
   FIRST_VALUE(CASE WHEN closest_m <= 75 THEN anchored_at END IGNORE NULLS) OVER (PARTITION BY bus_id, route_id ORDER BY anchored_at, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) nn FROM stop_visits WINDOW w AS (PARTITION BY bus_id, route_id ORDER BY anchored_at, id)),
 e AS (SELECT *, (stop_index-pi+5)%5 bk, (qi-stop_index+5)%5 fw FROM v WHERE (stop_index-pi+5)%5 BETWEEN 1 AND 2 AND anchored_at-pt <= {D}),
 c AS (SELECT e.*, s.lat sla, s.lon slo FROM e JOIN stops s USING (stop_id) WHERE closest_m > 75 AND fw BETWEEN 1 AND 2 AND qt-anchored_at <= {D}),
 f AS (SELECT c.id, c.pt, c.qt, p.collected_at t, {_m('p.lat','p.lon','sla','slo')} d, LAG(p.collected_at) OVER (PARTITION BY c.id ORDER BY p.collected_at, p.ingest_seq) lt FROM c LEFT JOIN positions p ON p.bus_id=c.bus_id AND p.collected_at BETWEEN c.pt AND c.qt+120000),
 g AS (SELECT id, MIN(d) cl, COUNT(*) FILTER (t<=qt) cov, GREATEST(COALESCE(MAX(t-GREATEST(COALESCE(lt,pt),pt)) FILTER (t<=qt),0), qt-COALESCE(MAX(t) FILTER (t<=qt),pt)) gap FROM f GROUP BY id, pt, qt),
 w AS (SELECT c.*, CASE WHEN cl <= 75 THEN 'served' WHEN cov < 2 OR gap > {D} THEN 'unknown' WHEN closest_m >= 150 AND COALESCE(cl,1e12) >= 150 THEN 'skipped' ELSE 'unknown' END verdict FROM c JOIN g USING (id)),
 ps AS (SELECT id, bus_id, route_id, stop_id, anchored_at AS "at", 'served' verdict FROM e WHERE closest_m <= 75 UNION ALL SELECT id, bus_id, route_id, stop_id, anchored_at, verdict FROM w WHERE verdict <> 'skipped' OR COALESCE(nn-anchored_at <= {D}, FALSE))"""


def _passes(v, ring, stops, pos):
    return V.classify_passes(v, ring, stops, pos, hop_ms=D, back_ms=D, fix_gap_ms=D)


@R.q("w8_classify_passes", "stop_visits ring stops positions", f'WITH {_PASS} SELECT id, bus_id, route_id, stop_id, "at", verdict FROM ps')
def _w8(v, ring, stops, pos):
    return _passes(v, ring, stops, pos)


@R.q("w9_resolve_anchor_returns", "stop_visits ring stops positions")
def _w9(v, ring, stops, pos):
    return V.resolve_anchor_returns(v, ring, stops, pos, hop_ms=D)


# Notices from judged passes ``ps``, with the served stop before to use instead.
_NOTICES = f"""p AS (SELECT * FROM ps WHERE verdict <> 'unknown' AND "at" BETWEEN {NOW-30*D} AND {NOW}), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY route_id, stop_id ORDER BY "at" DESC, id DESC) rn FROM p),
  gg AS (SELECT route_id, stop_id, COUNT(*) AS "of", COUNT(*) FILTER (verdict='skipped') skipped, MAX(CASE WHEN verdict='skipped' THEN "at" END) last_at, MAX(CASE WHEN rn=1 THEN verdict END) latest FROM r WHERE rn <= 3 GROUP BY ALL),
  fl AS (SELECT * FROM gg WHERE "of" >= 2 AND latest='skipped' AND skipped >= 2),
  al AS (SELECT fl.route_id, fl.stop_id, arg_min(z.stop_id, (ALTM, z.stop_id)) alt FROM fl JOIN ring a ON a.route_id=fl.route_id AND a.stop_id=fl.stop_id JOIN ring z ON z.route_id=a.route_id AND (z.stop_index+1)%a.ring_size=a.stop_index
    JOIN gg k ON k.route_id=z.route_id AND k.stop_id=z.stop_id AND k.latest='served' WHERE ALTM <= {V.ALT_M} GROUP BY ALL)
  SELECT fl.route_id, fl.stop_id, skipped, "of", last_at, alt FROM fl LEFT JOIN al USING (route_id, stop_id)""".replace("ALTM", _m("a.lat", "a.lon", "z.lat", "z.lon"))


@R.q("w10_stop_skip_notices", "stop_visits ring stops positions", f"WITH {_PASS}, {_NOTICES}")
def _w10(v, ring, stops, pos):
    return V.stop_skip_notices(_passes(v, ring, stops, pos), ring, stops, NOW, 30 * D)


# Passes judged by their ids, in which stretches of skips occur, so that notices with another stop are raised.
@R.q("w10_judged_notices", "arrivals ring stops", f"""WITH ps AS (SELECT id, route_id, stop_id, arrived_at AS "at", CASE WHEN id%7=0 THEN 'unknown' WHEN (id+stop_id)%5 < 2 + route_id%2 THEN 'skipped' ELSE 'served' END verdict FROM arrivals), {_NOTICES}""")
def _w10j(a, ring, stops):
    judged = F.when(F.col("id") % 7 == 0, "unknown").when((F.col("id") + F.col("stop_id")) % 5 < 2 + F.col("route_id") % 2, "skipped").otherwise("served")
    return V.stop_skip_notices(a.select("id", "route_id", "stop_id", F.col("arrived_at").alias("at"), judged.alias("verdict")), ring, stops, NOW, 30 * D)


@R.q("a30_visit_catalog", "stop_visits ring", f"""SELECT {{LDAY(anchored_at)}} AS day, NULL::BIGINT route_id, NULL::BIGINT stop_id, COUNT(*) visits, 'day' grain, NULL::BOOLEAN AS current FROM stop_visits GROUP BY ALL
  UNION ALL SELECT NULL, v.route_id, v.stop_id, COUNT(*), 'occurrence', BOOL_OR(r.stop_id IS NOT NULL) FROM stop_visits v LEFT JOIN ring r ON r.route_id=v.route_id AND r.stop_id=v.stop_id AND r.stop_index=v.stop_index GROUP BY v.route_id, v.stop_id, v.stop_index""")
def _a30(v, ring):
    return V.visit_catalog(v, ring, NOW).drop("stop_index")


@R.q("a30_data_edges", "stop_visits positions", "SELECT 'visits' table_name, MIN(anchored_at) lo, MAX(anchored_at) hi FROM stop_visits UNION ALL SELECT 'positions', MIN(collected_at), MAX(collected_at) FROM positions")
def _a30e(v, p):
    return V.data_edges(v, p)
