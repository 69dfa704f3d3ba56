"""Registered telemetry and feed-quality studies."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions.quantiles import grouped_quantiles
from fleetlens.operators import berths as B
from fleetlens.operators import calibrate as C
from fleetlens.operators import quality as Q
from fleetlens.operators import sequence as S
from fleetlens.operators import service_end as SE
from fleetlens.plans.calibrate_queries import _CH
from fleetlens.plans.model_queries import _FANR, _P
from fleetlens.plans.network_queries import _m, _paths
from fleetlens.plans.reg import NOW, NOW_DOW, NOW_HOUR, Registry, rounded
from fleetlens.plans.sequence_queries import STILL, near_ctes

R = Registry()
QUERIES, ORACLE = R.queries, R.oracles
D = 86_400_000
_TW = "OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq)"


@R.q("a32_variance_explained", "segments stops", f"""WITH s AS (SELECT s.* FROM segments s JOIN stops a ON a.stop_id=s.from_stop_id JOIN stops b ON b.stop_id=s.to_stop_id WHERE travel_sec>0 AND {_CH}/travel_sec<=22),
  x AS (SELECT route_id, from_stop_id, to_stop_id, travel_sec v, UNNEST(['hour','dow','weekend','peak']) scheme, UNNEST([CAST(hour AS VARCHAR), CAST(dow AS VARCHAR), CAST(dow IN (0,6) AS VARCHAR), CASE WHEN hour BETWEEN 7 AND 9 THEN 'am' WHEN hour BETWEEN 16 AND 18 THEN 'pm' ELSE 'off' END]) bin FROM s),
  b AS (SELECT route_id, from_stop_id, to_stop_id, scheme, bin, COUNT(*) n, SUM(v) s, SUM(v*v) ss FROM x GROUP BY ALL), h AS (SELECT route_id, from_stop_id, to_stop_id, scheme, SUM(n) n, SUM(s) s, SUM(ss) ss, SUM(s*s/n) bt, COUNT(*) k FROM b GROUP BY ALL HAVING SUM(n) >= 60),
  p AS (SELECT scheme, SUM(ss-s*s/n) tot, SUM(bt-s*s/n) bet, SUM(k-1) dfb, SUM(n-k) dfw, COUNT(*) hops FROM h GROUP BY scheme) SELECT scheme, hops, ROUND(bet/tot,6) r2, ROUND((bet-dfb*(tot-bet)/dfw)/(tot+(tot-bet)/dfw),6) omega2 FROM p""")
def _a32(s, stops):
    return rounded(Q.variance_explained(s, stops, min_n=60, only=["hour", "dow", "weekend", "peak"]), 6)


@R.q("a32_variance_with_control", "segments stops")
def _a32c(s, stops):
    return Q.variance_explained(s, stops, min_n=60)


@R.q("a33_hop_anatomy", "positions ring")
def _a33(pos, ring):
    seg = S.v1_transitions(pos, ring).where("from_stop_id IS NOT NULL").select(
        F.xxhash64("bus_id", "arrived_at").alias("id"), "bus_name", "route_id", "from_stop_id", F.col("stop_id").alias("to_stop_id"), (F.col("arrived_at") - F.col("travel_sec") * 1000).cast("long").alias("started_at"), "travel_sec")
    return Q.time_budget(Q.hop_anatomy(pos, seg, ring))


@R.q("a34_hold_signal", "arrivals ring")
def _a34(a, ring):
    ch = S.stop_chains(a, ring, gap_ms=3 * D)
    return Q.hold_signal(ch, C.dwell_stats(a, NOW, NOW_DOW, NOW_HOUR, days=40))


@R.q("a35_feed_priors", "positions ring")
def _a35(pos, ring):
    return Q.feed_priors(pos, ring)


@R.q("a36_emission_rates", "positions ring", f"""WITH {STILL}, d AS (SELECT p.*, s.still, EXISTS (SELECT 1 FROM ring r WHERE r.route_id=p.route_id AND {_m('p.lat','p.lon','r.lat','r.lon')} <= 75) zone FROM positions p JOIN still s USING (ingest_seq)),
  l AS (SELECT *, LEAD(collected_at) OVER w nt, LEAD(lat) OVER w nla, LEAD(lon) OVER w nlo, LEAD(still) OVER w ns FROM d WINDOW w AS (PARTITION BY bus_name ORDER BY collected_at, ingest_seq)),
  x AS (SELECT *, lat=nla AND lon=nlo froz, (nt-collected_at)/1000e0 sec FROM l WHERE nt > collected_at AND nt-collected_at <= 60000)
  SELECT ROUND(COUNT(*) FILTER (still AND froz)/COUNT(*) FILTER (still),7) p_repeat_stand, ROUND(COUNT(*) FILTER (NOT still AND froz)/COUNT(*) FILTER (NOT still),7) p_repeat_move,
    ROUND(COUNT(*) FILTER (NOT still AND zone AND froz)/COUNT(*) FILTER (NOT still AND zone),7) p_repeat_move_zone, ROUND(COUNT(*) FILTER (NOT still AND ns)/SUM(sec) FILTER (NOT still),7) hold_enter_per_s,
    ROUND(COUNT(*) FILTER (still AND NOT ns)/SUM(sec) FILTER (still),7) hold_leave_per_s, COUNT(*) FILTER (still) stand_pairs, COUNT(*) FILTER (NOT still) move_pairs FROM x""")
def _a36(pos, ring):
    return rounded(Q.emission_rates(pos, ring))


@R.q("a37_visit_rates", "stop_visits", """SELECT COUNT(*) stopped, ROUND(SUM(shuffles)/SUM(rest_polls),7) shuffle_per_poll, ROUND(COUNT(*)/(COUNT(*)+SUM(shuffles)),7) p_depart_on_fresh FROM stop_visits WHERE outcome='stopped' AND rest_polls>0""")
def _a37(v):
    return rounded(Q.visit_rates(v))


@R.q("a47_score_official", "census arrivals positions", f"""WITH r AS (SELECT id, LTRIM(bus_name,'#') bus, route_id, stop_id, COALESCE(calc_at,sampled_at) t, CAST(eta_sec AS DOUBLE) eta FROM census WHERE bus_name IS NOT NULL AND route_id IS NOT NULL AND eta_sec IS NOT NULL),
  v AS (SELECT LTRIM(bus_name,'#') bus, route_id, stop_id, arrived_at, departed_at FROM arrivals), j AS (SELECT r.*, p.arrived_at pt, p.departed_at pd, n.arrived_at nt FROM r ASOF LEFT JOIN v p ON p.bus=r.bus AND p.route_id=r.route_id AND p.stop_id=r.stop_id AND r.t > p.arrived_at ASOF LEFT JOIN v n ON n.bus=r.bus AND n.route_id=r.route_id AND n.stop_id=r.stop_id AND r.t <= n.arrived_at),
  k AS (SELECT *, CASE WHEN eta<120 THEN '0-2' WHEN eta<300 THEN '2-5' WHEN eta<600 THEN '5-10' ELSE '10-30' END h, CASE WHEN pt IS NOT NULL AND (pd IS NULL OR pd>=t) AND t-pt<=7200000 THEN 'standing' WHEN nt-t<=2700000 THEN 'arrived' ELSE 'missing' END kind FROM j WHERE eta<=1800),
  l AS (SELECT k.*, EXISTS (SELECT 1 FROM positions p WHERE LTRIM(p.bus_name,'#')=k.bus AND p.collected_at <= k.t+2700000 AND p.collected_at >= k.t+2700000-600000) seen, CASE WHEN kind='arrived' THEN eta-(nt-t)/1000e0 END err FROM k)
  SELECT CAST(route AS BIGINT) route_id, horizon, COUNT(*) n, COUNT(*) FILTER (kind='standing') standing, COUNT(*) FILTER (kind='missing') missing, COUNT(*) FILTER (kind='missing' AND NOT seen) vanished, COUNT(err) paired, ROUND(AVG(err),5) bias_sec, ROUND(QUANTILE_CONT(ABS(err),0.5),5) median_abs_sec, ROUND(QUANTILE_CONT(ABS(err),0.9),5) p90_abs_sec
  FROM l, LATERAL (SELECT UNNEST([route_id,0]) route) ra, LATERAL (SELECT UNNEST([h,'all']) horizon) ho GROUP BY ALL""")
def _a47(c, a, pos):
    from fleetlens.operators.scoring import scoreable
    rows = c.where("bus_name IS NOT NULL AND route_id IS NOT NULL AND eta_sec IS NOT NULL").select(
        "id", F.regexp_replace("bus_name", "^#", "").alias("bus"), "route_id", "stop_id", F.coalesce("calc_at", "sampled_at").alias("at"), F.col("eta_sec").cast("double").alias("sec"))
    return rounded(Q.score_official(rows, a, pos), 5)


# Stands moved off their stops by an amount that differs by stop and vehicle, so that berths of all kinds occur.
_MOVED = "((last_stop_id % 5) * 0.0001e0 + (bus_id % 7) * 0.00003e0 + CASE WHEN bus_id % 11 = 0 THEN 0.0005e0 ELSE 0e0 END)"
_XY = "6371000*pi()/180"
_A48 = f"""WITH kx AS (SELECT {_XY} my, {_XY}*cos(radians(41.31e0)) mx),
  vx AS (SELECT a.route_id, a.stop_index*2 i, a.lat, a.lon FROM ring a UNION ALL SELECT a.route_id, a.stop_index*2+1, (a.lat+b.lat)/2+0.0003e0, (a.lon+b.lon)/2 FROM ring a JOIN ring b ON b.route_id=a.route_id AND b.stop_index=(a.stop_index+1)%a.ring_size),
  sg AS (SELECT route_id, i, lon*mx ax, lat*my ay, LEAD(lon) OVER w*mx bx, LEAD(lat) OVER w*my byy FROM vx, kx WINDOW w AS (PARTITION BY route_id ORDER BY i)),
  sl AS (SELECT *, sqrt((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)) len FROM sg WHERE bx IS NOT NULL),
  ln AS (SELECT *, COALESCE(SUM(len) OVER (PARTITION BY route_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) s0, SUM(len) OVER (PARTITION BY route_id) total FROM sl),
  ps AS (SELECT bus_name, lat+{_MOVED} lat, lon, collected_at, ingest_seq FROM positions),
  rr AS (SELECT *, SUM(CASE WHEN lat=pl AND lon=po THEN 0 ELSE 1 END) OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq) run FROM (
    SELECT *, LAG(lat) OVER w pl, LAG(lon) OVER w po FROM ps WINDOW w AS (PARTITION BY bus_name ORDER BY collected_at, ingest_seq))),
  st AS (SELECT v.id, v.route_id, v.stop_id, run, MIN(p.collected_at) begun, MIN(p.lat) lat, MIN(p.lon) lon FROM stop_visits v JOIN rr p ON p.bus_name=v.bus_name AND p.collected_at BETWEEN v.pinned_at-90000 AND v.departed_at+120000
    WHERE outcome='stopped' AND pinned_at IS NOT NULL AND departed_at IS NOT NULL GROUP BY ALL HAVING MAX(p.collected_at)-MIN(p.collected_at) >= 10000),
  pt AS (SELECT DISTINCT route_id, lat, lon FROM st UNION SELECT r.route_id, s.lat, s.lon FROM (SELECT DISTINCT route_id FROM ring) r, stops s),
  pq AS (SELECT pt.*, ln.s0, ln.len, ln.total, ax, ay, bx, byy, lon*mx x, lat*my y, GREATEST(0, LEAST(1, CASE WHEN len>0 THEN ((lon*mx-ax)*(bx-ax)+(lat*my-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)) ELSE 0 END)) t FROM pt JOIN ln USING (route_id), kx),
  pr AS (SELECT route_id, lat, lon, MIN(total) total, MIN((sqrt((x-(ax+t*(bx-ax)))*(x-(ax+t*(bx-ax)))+(y-(ay+t*(byy-ay)))*(y-(ay+t*(byy-ay)))), s0+t*len)) z FROM pq GROUP BY ALL),
  of AS (SELECT st.*, p.z[1] d, h.z[1] hd, h.z[2] hs, p.z[2]-h.z[2] - floor((p.z[2]-h.z[2])/p.total+0.5)*p.total AS off_m, sqrt((st.lon-s.lon)*mx*((st.lon-s.lon)*mx)+(st.lat-s.lat)*my*((st.lat-s.lat)*my)) dd
    FROM st JOIN stops s USING (stop_id) JOIN pr p ON p.route_id=st.route_id AND p.lat=st.lat AND p.lon=st.lon JOIN pr h ON h.route_id=st.route_id AND h.lat=s.lat AND h.lon=s.lon, kx),
  la AS (SELECT id, route_id, stop_id, arg_max(off_m, begun) off_m, arg_max(hs, begun) hs, arg_max(hd, begun) hd FROM of WHERE d<=60 AND dd<=120 AND ABS(off_m)<=120 GROUP BY ALL),
  ob AS (SELECT * FROM la WHERE hd<=60 AND ABS(off_m)<250),
  dn AS (SELECT *, COUNT(*) OVER (PARTITION BY route_id, stop_id ORDER BY off_m RANGE BETWEEN CURRENT ROW AND 40e0 FOLLOWING) dens FROM ob),
  wn AS (SELECT route_id, stop_id, COUNT(*) n, arg_min(off_m, (-dens, off_m)) lo, MAX(dens) in_window, MIN(hs) hs FROM dn GROUP BY ALL HAVING COUNT(*) >= 10),
  sm AS (SELECT o.route_id, o.stop_id, MAX(off_m) FILTER (off_m>=lo AND off_m-lo<=40) hi, COUNT(*) FILTER (off_m<lo) behind, QUANTILE_CONT(off_m,0.9) FILTER (off_m>=lo AND off_m-lo<=40) berth_m, QUANTILE_CONT(off_m,0.9)-QUANTILE_CONT(off_m,0.1) span_m
    FROM ob o JOIN wn USING (route_id, stop_id) GROUP BY ALL),
  be AS (SELECT wn.*, sm.* EXCLUDE (route_id, stop_id), t.total, (hs+berth_m)-floor((hs+berth_m)/t.total)*t.total m FROM wn JOIN sm USING (route_id, stop_id) JOIN (SELECT DISTINCT route_id, total FROM ln) t USING (route_id)),
  bp AS (SELECT be.*, (ay+(m-s0)/len*(byy-ay))/my lat, (ax+(m-s0)/len*(bx-ax))/mx lon FROM be JOIN ln USING (route_id), kx WHERE s0+len >= m QUALIFY ROW_NUMBER() OVER (PARTITION BY route_id, stop_id ORDER BY s0)=1),
  rv AS (SELECT b.route_id, b.stop_id, MIN((sqrt((b.lon-s.lon)*mx*((b.lon-s.lon)*mx)+(b.lat-s.lat)*my*((b.lat-s.lat)*my)), s.stop_id)) z FROM bp b JOIN stops s ON s.stop_id<>b.stop_id, kx GROUP BY ALL),
  ou AS (SELECT bp.*, n-in_window-behind AS ahead, in_window/(n-behind) AS share, in_window/n plain_share, CASE WHEN z[1]<=400 THEN z[2] END rival_id, CASE WHEN z[1]<=400 THEN z[1] END rival_m FROM bp LEFT JOIN rv USING (route_id, stop_id))
  SELECT route_id, stop_id, n, CAST(in_window AS BIGINT) in_window, behind, CAST(ahead AS BIGINT) ahead, ROUND(lo,4) window_from_m, ROUND(hi,4) window_to_m, ROUND(share,6) share, ROUND(plain_share,6) plain_share, ROUND(berth_m,4) berth_m, ROUND(span_m,4) span_m, ROUND(lat,6) lat, ROUND(lon,6) lon,
    rival_id, ROUND(rival_m,3) rival_m, COALESCE(rival_m > ABS(berth_m)*1.5, true) clear_of_rivals, n>=20 AND in_window>=20 AND share>=0.75 AND plain_share>=0.5 AND ahead<=0.1*n AND ABS(berth_m)>=35 AND COALESCE(rival_m > ABS(berth_m)*1.5, true) qualifies FROM ou"""


@R.q("a48_berth_offsets", "stop_visits positions ring stops", _A48)
def _a48(v, pos, ring, stops):
    moved = pos.withColumn("lat", F.col("lat") + F.expr(_MOVED.replace("e0", "D")))
    b = B.berth_offsets(v, moved, stops, _paths(ring))
    return b.select(*B.K, "n", "in_window", "behind", "ahead", *[F.round(c, 4).alias(c) for c in ("window_from_m", "window_to_m")], F.round("share", 6).alias("share"), F.round("plain_share", 6).alias("plain_share"),
                    F.round("berth_m", 4).alias("berth_m"), F.round("span_m", 4).alias("span_m"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "rival_id", F.round("rival_m", 3).alias("rival_m"), "clear_of_rivals", "qualifies")


_SH = ", ".join(f"ROUND(AVG(CASE WHEN {c} THEN 1 ELSE 0 END),7) {n}" for n, c in [("boarded", "outcome='boarded'"), ("missed", "outcome='missed'"), ("gave_up", "outcome='gave_up'"), ("interval_held", "interval_held"), ("jumped", "jumped"), ("reversed", "reversed"), ("stranded", "stranded")])


@R.q("a50_summarise_waits", "waits", f"""SELECT line, COUNT(*) waits, {_SH}, QUANTILE_CONT(ABS(first_miss_sec),0.5) first_miss_p50, ROUND(QUANTILE_CONT(ABS(first_miss_sec),0.9),7) first_miss_p90, ROUND(QUANTILE_CONT(worst_drift_sec,0.9),7) drift_p90 FROM waits GROUP BY line""")
def _a50(w):
    return rounded(Q.summarise_waits(w, ["line"]))


@R.q("a51_band_coverage", "pairs", f"""WITH {_P} SELECT route, horizon, COUNT(*) n, ROUND(AVG(CASE WHEN det BETWEEN low AND high THEN 1 ELSE 0 END),7) covered, ROUND(AVG(CASE WHEN det<low THEN 1 ELSE 0 END),7) early, ROUND(AVG(CASE WHEN det>high THEN 1 ELSE 0 END),7) late, ROUND(AVG(high-low),5) width_sec
  FROM (SELECT * FROM p WHERE det IS NOT NULL AND h IS NOT NULL), {_FANR} GROUP BY ALL""")
def _a51(p):
    return rounded(Q.band_coverage(p).withColumn("width_sec", F.round("width_sec", 5)))


# Presence of up to an hour and a half from each event, a fix a minute, and a feed that names the vehicle in most minutes, less
# and less towards the end of some runs.
_PRES = "SELECT event_id*100+k ingest_seq, bus_name, route_id, at_ms+k*60000 collected_at, event_id, k FROM (SELECT e.*, {SEQ(90)} k FROM ev e) x WHERE k <= 10 + event_id % 75"
_EOS = f"""WITH pres AS ({_PRES}),
  fd AS (SELECT bus_name bus, collected_at+7000 AS "at", CAST((event_id*7+k*13)%1500 AS DOUBLE) sec FROM pres WHERE (event_id+k)%7 < 5 AND NOT (event_id%3=0 AND k >= event_id%75)),
  rn AS (SELECT *, SUM(CASE WHEN collected_at-pt <= 600000 THEN 0 ELSE 1 END) OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq) run FROM (SELECT *, LAG(collected_at) OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq) pt FROM pres)),
  ru AS (SELECT bus_name bus, run, MIN(collected_at) b, MAX(collected_at) e, arg_max(route_id, (collected_at, ingest_seq)) route_id FROM rn GROUP BY ALL),
  lm AS (SELECT MIN("at") f0, LEAST(MAX("at"), (SELECT MAX(collected_at) FROM pres)) f1 FROM fd),
  ls AS (SELECT bus, {{LDAY(e-14400000)}} AS day, arg_max(route_id, e) route_id, arg_max(b, e) b, MAX(e) e FROM ru GROUP BY ALL),
  mo AS (SELECT bus, route_id, 'eos' kind, e AS "at" FROM ls, lm WHERE f1-e >= 1200000 AND e-b >= 900000
    UNION ALL SELECT bus, route_id, 'control', b+900000+i*900000 FROM (SELECT *, UNNEST(range((e-1800000-b-900000)//900000+1)) i FROM ru WHERE e-1800000 >= b+900000)),
  ac AS (SELECT DISTINCT "at"//60000 m FROM fd),
  cv AS (SELECT bus, kind, "at" FROM (SELECT mo.*, UNNEST(range(("at"-900000)//60000, "at"//60000+1)) m FROM mo, lm WHERE "at"-900000 >= f0) LEFT JOIN ac USING (m) GROUP BY ALL HAVING COUNT(ac.m) >= 0.8*COUNT(*)),
  wi AS (SELECT mo.* FROM mo JOIN cv USING (bus, kind, "at")),
  ag AS (SELECT w.bus, w.kind, w."at", COUNT(*) FILTER (f."at" <= w."at") AS n_rows, MAX(sec) FILTER (f."at" <= w."at"-600000) early_sec, MAX(sec) FILTER (f."at" <= w."at" AND f."at" > w."at"-300000) late_sec,
    COUNT(*) FILTER (f."at" <= w."at" AND f."at"+sec*1000 > w."at"+60000) past_end, COUNT(*) FILTER (f."at" > w."at" AND kind='eos') after_end FROM wi w JOIN fd f ON f.bus=w.bus AND f."at" BETWEEN w."at"-900000 AND w."at"+1800000 GROUP BY ALL),
  gp AS (SELECT w.*, CASE WHEN w."at"-f."at" <= 86400000 THEN (w."at"-f."at")/60000e0 END gap_min FROM wi w ASOF LEFT JOIN fd f ON f.bus=w.bus AND f."at" <= w."at"),
  win AS (SELECT g.*, COALESCE(n_rows,0) AS n_rows, early_sec, late_sec, COALESCE(past_end,0) past_end, COALESCE(after_end,0) after_end FROM gp g LEFT JOIN ag USING (bus, kind, "at"))"""


def _eos(ev):
    p = ev.select("event_id", "bus_name", "route_id", "at_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(89).cast("long"))).alias("k")).where(F.col("k") <= 10 + F.col("event_id") % 75)
    p = p.withColumn("ingest_seq", F.col("event_id") * 100 + F.col("k")).withColumn("collected_at", F.col("at_ms") + F.col("k") * 60_000)
    kept = ((F.col("event_id") + F.col("k")) % 7 < 5) & ~((F.col("event_id") % 3 == 0) & (F.col("k") >= F.col("event_id") % 75))
    feed = p.where(kept).select(F.col("bus_name").alias("bus"), (F.col("collected_at") + 7000).alias("at"), ((F.col("event_id") * 7 + F.col("k") * 13) % 1500).cast("double").alias("sec"))
    return SE.eos_windows(p, feed)


@R.q("j24_eos_windows", "ev", _EOS + """ SELECT bus, route_id, kind, "at", ROUND(gap_min,6) gap_min, n_rows, early_sec, late_sec, past_end, after_end FROM win""")
def _j24(ev):
    return _eos(ev).select("bus", "route_id", "kind", "at", F.round("gap_min", 6).alias("gap_min"), F.col("rows").alias("n_rows"), "early_sec", "late_sec", "past_end", "after_end")


@R.q("a52_eos_flag_quality", "ev", _EOS + """, x AS (SELECT kind, k, gap_min IS NULL OR gap_min >= k f FROM win, (SELECT UNNEST([2,3,5,10]) k)),
  y AS (SELECT k, COUNT(*) FILTER (kind='eos') AS ends, COUNT(*) FILTER (kind='control') AS controls, COUNT(*) FILTER (kind='eos' AND f) AS hits, COUNT(*) FILTER (kind='control' AND f) false_flags FROM x GROUP BY k)
  SELECT *, ROUND(CASE WHEN hits+false_flags>0 THEN hits/(hits+false_flags) END,6) "precision", ROUND(CASE WHEN ends>0 THEN hits/ends END,6) recall FROM y""")
def _a52(ev):
    return rounded(SE.eos_flag_quality(_eos(ev)), 6)


@R.q("a52_eos_summary", "ev", _EOS + """, r AS (SELECT *, UNNEST([route_id, NULL]) route FROM win) SELECT route, kind, COUNT(*) windows, COUNT(*) FILTER (n_rows=0) silent, COUNT(*) FILTER (early_sec IS NOT NULL AND late_sec IS NULL) early_only,
  COUNT(*) FILTER (past_end>0) promising, CAST(SUM(past_end) AS BIGINT) rows_past_end, COUNT(*) FILTER (after_end>0) named_after, ROUND(QUANTILE_CONT(COALESCE(gap_min,999),0.25),6) gap_p25, ROUND(QUANTILE_CONT(COALESCE(gap_min,999),0.5),6) gap_p50,
  ROUND(QUANTILE_CONT(COALESCE(gap_min,999),0.75),6) gap_p75, ROUND(QUANTILE_CONT((early_sec-late_sec)/60,0.5),6) shrink_p50 FROM r GROUP BY ALL""")
def _a52s(ev):
    return rounded(SE.eos_summary(_eos(ev)), 6)


@R.q("a53_baseline_stops", "stop_visits", """SELECT route_id, stop_id, COUNT(*) visits, ROUND(COUNT(*) FILTER (outcome='stopped')/GREATEST(1,COUNT(*) FILTER (outcome IN ('stopped','passed'))),7) p_stop, ROUND(AVG(CASE WHEN outcome='stopped' THEN stand_sec END),6) mean_stand,
  ROUND(CORR(hw, CASE WHEN outcome='stopped' THEN stand_sec END),5) headway_corr FROM (SELECT *, (arrived_at-LAG(departed_at) OVER (PARTITION BY route_id, stop_id ORDER BY arrived_at, id))/1000e0 hw FROM stop_visits) GROUP BY ALL""")
def _a53(v):
    d = Q.baseline_stops(v)
    return d.select("route_id", "stop_id", "visits", F.round("p_stop", 7).alias("p_stop"), F.round("mean_stand", 6).alias("mean_stand"), F.round("headway_corr", 5).alias("headway_corr"))


@R.q("a53_baseline_hops", "legs", "SELECT route_id, from_stop_id, to_stop_id, COUNT(*) legs, ROUND(AVG(leg_sec),5) leg_sec, ROUND(AVG(hold_sec),5) hold_sec, ROUND(AVG(drive_sec),5) drive_sec FROM legs GROUP BY ALL")
def _a53h(l):
    return rounded(Q.baseline_hops(l), 5)


_A55 = f"""WITH hp AS (SELECT r.route_id, r.stop_index, COALESCE(l.sec,60e0) sec, COALESCE(v.stand,0e0) stand FROM ring r LEFT JOIN (SELECT route_id, from_index stop_index, QUANTILE_CONT(leg_sec,0.5) sec FROM legs WHERE hops=1 GROUP BY ALL) l USING (route_id, stop_index)
    LEFT JOIN (SELECT route_id, stop_index, QUANTILE_CONT(stand_sec,0.5) stand FROM stop_visits WHERE outcome='stopped' AND stand_sec IS NOT NULL GROUP BY ALL) v USING (route_id, stop_index)),
  tm AS (SELECT a.route_id, a.stop_index i, s.stop_id, s.stop_id%2=0 focus, SUM(CASE WHEN k=1 THEN h.sec/2 ELSE h.stand+h.sec END) OVER (PARTITION BY a.route_id, a.stop_index ORDER BY k) t FROM (SELECT *, UNNEST(range(1, ring_size+1)) k FROM ring) a
    JOIN ring s ON s.route_id=a.route_id AND s.stop_index=(a.stop_index+k)%a.ring_size JOIN hp h ON h.route_id=a.route_id AND h.stop_index=(a.stop_index+k-1)%a.ring_size),
  fx AS (SELECT bus_name, route_id, MIN((collected_at, ingest_seq)) z FROM positions GROUP BY bus_name, route_id, collected_at//15000),
  fp AS (SELECT p.* FROM positions p JOIN fx ON fx.z[2]=p.ingest_seq),
  lg AS (SELECT p.ingest_seq, p.bus_name, p.collected_at, p.route_id, a.stop_index i, (a.lon-p.lon)*cos(radians(p.lat))*111320 ax, (a.lat-p.lat)*111320 ay, (b.lon-p.lon)*cos(radians(p.lat))*111320 bx, (b.lat-p.lat)*111320 byy,
    LEAST(ABS(p.heading-(DEGREES(ATAN2((b.lon-a.lon)*COS(RADIANS((a.lat+b.lat)/2)), b.lat-a.lat))+720)%360)%360, 360-ABS(p.heading-(DEGREES(ATAN2((b.lon-a.lon)*COS(RADIANS((a.lat+b.lat)/2)), b.lat-a.lat))+720)%360)%360) turn FROM fp p JOIN ring a ON a.route_id=p.route_id JOIN ring b ON b.route_id=a.route_id AND b.stop_index=(a.stop_index+1)%a.ring_size),
  lt AS (SELECT *, GREATEST(0, LEAST(1, ((0-ax)*(bx-ax)+(0-ay)*(byy-ay))/((bx-ax)*(bx-ax)+(byy-ay)*(byy-ay)))) t FROM lg),
  ld AS (SELECT *, sqrt((ax+t*(bx-ax))*(ax+t*(bx-ax))+(ay+t*(byy-ay))*(ay+t*(byy-ay))) d FROM lt),
  cd AS (SELECT *, COUNT(*) OVER (PARTITION BY ingest_seq) legs FROM ld WHERE d <= 150),
  fd AS (SELECT LTRIM(bus_name,'#') bus, stop_id, arrived_at-20000+5000*(id%4) AS "at", CAST(20+id%90 AS DOUBLE) sec FROM arrivals),
  us AS (SELECT p.ingest_seq, f.stop_id, MAX((f."at", f.sec))[2] u FROM (SELECT DISTINCT ingest_seq, bus_name, collected_at FROM cd WHERE legs >= 2) p JOIN fd f ON f.bus=LTRIM(p.bus_name,'#') AND f."at" BETWEEN p.collected_at-37500 AND p.collected_at+7500 GROUP BY ALL),
  co AS (SELECT c.ingest_seq, c.bus_name, c.collected_at, c.i, c.d, c.turn, SUM(CASE WHEN us.u IS NOT NULL THEN ABS(us.u-tm.t) WHEN tm.focus THEN GREATEST(0, 1800-tm.t) ELSE 0 END) cost FROM cd c JOIN tm ON tm.route_id=c.route_id AND tm.i=c.i
    LEFT JOIN us ON us.ingest_seq=c.ingest_seq AND us.stop_id=tm.stop_id WHERE c.legs >= 2 AND c.ingest_seq IN (SELECT ingest_seq FROM us) GROUP BY ALL),
  mo AS (SELECT ingest_seq, bus_name, collected_at, LIST(i) legs, arg_min(i, (ROUND(cost,6), i)) inferred, arg_min(i, (ROUND(d,6), i)) nearest, arg_min(i, (ROUND(turn,6), i)) heading FROM co GROUP BY ALL),
  tr AS (SELECT bus_name, stop_index from_index, arrived_at-30000 lo, arrived_at+30000 hi FROM arrivals)
  SELECT COUNT(*) moments, COUNT(*) FILTER (inferred=from_index) inferred_right, COUNT(*) FILTER (nearest=from_index) nearest_right, COUNT(*) FILTER (heading=from_index) heading_right
  FROM mo JOIN tr ON tr.bus_name=mo.bus_name AND mo.collected_at BETWEEN lo AND hi WHERE list_contains(legs, from_index)"""


@R.q("a55_fold_leg_agreement", "positions arrivals ring legs stop_visits", _A55)
def _a55(pos, a, ring, legs, visits):
    place = ["route_id", "stop_index"]
    sec = grouped_quantiles(legs.where("hops = 1").withColumnRenamed("from_index", "stop_index"), place, "leg_sec", {"sec": (0.5, "linear")}).drop("_n")
    stand = grouped_quantiles(visits.where("outcome = 'stopped'"), place, "stand_sec", {"stand": (0.5, "linear")}).drop("_n")
    hops = ring.select(*place).join(sec, place, "left").join(stand, place, "left").fillna({"sec": 60.0, "stand": 0.0})
    feed = a.select(F.regexp_replace("bus_name", "^#", "").alias("bus"), "stop_id", (F.col("arrived_at") - 20_000 + 5000 * (F.col("id") % 4)).alias("at"), (20 + F.col("id") % 90).cast("double").alias("sec"))
    truth = a.select("bus_name", F.col("stop_index").alias("from_index"), (F.col("arrived_at") - 30_000).alias("lo"), (F.col("arrived_at") + 30_000).alias("hi"))
    return Q.fold_leg_agreement(Q.leg_inference(pos, feed, ring.withColumn("focus", F.col("stop_id") % 2 == 0), hops), truth)


_BR = "(DEGREES(ATAN2(({d}-{b})*COS(RADIANS(({a}+{c})/2)), {c}-{a}))+720)%360"


@R.q("a56_heading_agreement", "positions", f"""WITH t AS (SELECT *, LAG(lat) {_TW} pla, LAG(lon) {_TW} plo, LAG(collected_at) {_TW} pt, LEAD(lat) {_TW} nla, LEAD(lon) {_TW} nlo, LEAD(collected_at) {_TW} nt FROM positions),
  x AS (SELECT CASE WHEN lat=pla AND lon=plo THEN 'frozen' ELSE 'fresh' END fix, UNNEST(['previous','next']) side, UNNEST([CASE WHEN collected_at-pt<=60000 AND {_m('pla','plo','lat','lon')}>=10 THEN {_BR.format(a='pla',b='plo',c='lat',d='lon')} END, CASE WHEN nt-collected_at<=60000 AND {_m('lat','lon','nla','nlo')}>=10 THEN {_BR.format(a='lat',b='lon',c='nla',d='nlo')} END]) br, heading FROM t),
  y AS (SELECT fix, side, LEAST(ABS(heading-br)%360, 360-ABS(heading-br)%360) deg FROM x WHERE br IS NOT NULL)
  SELECT fix, side, COUNT(*) n, ROUND(QUANTILE_CONT(deg,0.5),4) p50, ROUND(QUANTILE_CONT(deg,0.9),4) p90, ROUND(AVG(CASE WHEN deg<=45 THEN 1 ELSE 0 END),4) within45, ROUND(AVG(CASE WHEN deg>=135 THEN 1 ELSE 0 END),4) against FROM y GROUP BY ALL""")
def _a56(pos):
    return rounded(Q.heading_agreement(pos), 4)


@R.q("a56_fold_frames", "positions ring", f"""WITH n AS (SELECT p.ingest_seq, p.route_id, LIST(s.stop_index) FILTER ({_m('p.lat','p.lon','s.lat','s.lon')} <= 500) l FROM positions p JOIN ring s ON s.route_id=p.route_id GROUP BY ALL)
  SELECT route_id, COUNT(*) fixes, COUNT(*) FILTER (len(list_filter(l, lambda a: len(list_filter(l, lambda b: LEAST((b-a+5)%5,(a-b+5)%5) >= 2))>0))>0) fold_frames FROM n GROUP BY route_id""")
def _a56f(pos, ring):
    return Q.fold_frames(pos, ring, near_m=500.0)


@R.q("a60_curb_vs_feed", "positions ring", f"""WITH {near_ctes(45)}, c AS (SELECT bus_name, stop_id, CAST(FLOOR(entered_at) AS BIGINT) t FROM hit),
  fl AS (SELECT bus_name, last_stop_id stop_id, collected_at ft FROM (SELECT *, LAG(last_stop_id) OVER (PARTITION BY bus_name ORDER BY collected_at, ingest_seq) ps FROM positions) WHERE ps <> last_stop_id),
  a AS (SELECT stop_id, COUNT(*) curb_visits, COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM fl WHERE fl.bus_name=c.bus_name AND fl.stop_id=c.stop_id AND ft BETWEEN t-120000 AND t+300000)) unconfirmed FROM c GROUP BY stop_id),
  b AS (SELECT stop_id, COUNT(*) flips, COUNT(*) FILTER (NOT EXISTS (SELECT 1 FROM c WHERE c.bus_name=fl.bus_name AND c.stop_id=fl.stop_id AND t BETWEEN ft-300000 AND ft+120000)) no_fix FROM fl GROUP BY stop_id)
  SELECT stop_id, COALESCE(curb_visits,0) curb_visits, COALESCE(unconfirmed,0) unconfirmed, COALESCE(flips,0) flips, COALESCE(no_fix,0) no_fix FROM a FULL JOIN b USING (stop_id)""")
def _a60(pos, ring):
    return Q.curb_vs_feed(pos, ring)
