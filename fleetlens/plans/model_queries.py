"""Registered model-fitting and comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import dist
from fleetlens.operators import calibrate as C
from fleetlens.operators import matching, models as M
from fleetlens.plans.calibrate_queries import asof_ctes
from fleetlens.plans.reg import NOW, Registry, knots, rounded

R = Registry()
QUERIES, ORACLE = R.queries, R.oracles
D = 86_400_000

_H = "CASE WHEN eta>1800 THEN NULL WHEN eta<120 THEN '0-2' WHEN eta<300 THEN '2-5' WHEN eta<600 THEN '5-10' ELSE '10-30' END"
_P = f"p AS (SELECT *, {_H} h FROM pairs)"
_R1 = "FLOOR(({x})*10+0.5)/10"


def _r1(x):
    return _R1.format(x=x)


_CF = f"""{_P}, w AS (SELECT h, CASE WHEN det>eta THEN CASE WHEN high>eta THEN (det-eta)/(high-eta) ELSE 1e12 END WHEN det<eta THEN CASE WHEN low<eta THEN (eta-det)/(eta-low) ELSE 1e12 END ELSE 0 END w FROM p WHERE det IS NOT NULL AND h IS NOT NULL),
 c AS (SELECT h, COUNT(*) n, COUNT(*) FILTER (w>=1e12) infinite, LIST(w ORDER BY w) l FROM w GROUP BY h),
 cf AS (SELECT h horizon, FLOOR(l[LEAST(n-1, CAST(CEIL((n+1)*0.8e0) AS BIGINT)-1)+1]*1000+0.5)/1000 w, n, infinite FROM c)"""


@R.q("a38_conformal", "pairs", f"WITH {_CF} SELECT * FROM cf")
def _a38(p):
    return M.conformal(p)


_T = {"0-2": 1.5, "2-5": 1.3, "5-10": 1.2, "10-30": 1.1}
_W = "CASE h WHEN '0-2' THEN 1.5e0 WHEN '2-5' THEN 1.3e0 WHEN '5-10' THEN 1.2e0 WHEN '10-30' THEN 1.1e0 ELSE 1e0 END"
_FANR = "LATERAL (SELECT UNNEST([r, 0]) route) ra, LATERAL (SELECT UNNEST(CASE WHEN h IS NULL THEN ['all'] ELSE [h,'all'] END) horizon) ho"


@R.q("a39_score_pairs", "pairs", f"""WITH {_P}, s AS (SELECT *, eta-(eta-low)*{_W} lo, eta+(high-eta)*{_W} hi, CASE WHEN h IS NOT NULL THEN eta-det END err FROM p),
  g AS (SELECT route, horizon, COUNT(*) n, COUNT(*) FILTER (h IS NULL) beyond, COUNT(*) FILTER (h IS NOT NULL AND err IS NULL) missing, LIST(ABS(err) ORDER BY ABS(err)) FILTER (err IS NOT NULL) l, COUNT(err) k,
    COUNT(*) FILTER (err IS NOT NULL AND hi>lo) iv, COUNT(*) FILTER (err IS NOT NULL AND hi>lo AND det BETWEEN lo AND hi) ins FROM s, {_FANR} GROUP BY ALL)
  SELECT route, horizon, n, beyond, missing, {_r1("l[GREATEST(0,CAST(CEIL(0.5e0*k) AS BIGINT)-1)+1]")} median_abs_sec, {_r1("l[GREATEST(0,CAST(CEIL(0.9e0*k) AS BIGINT)-1)+1]")} p90_abs_sec, iv interval_rows, CASE WHEN iv>0 THEN FLOOR(ins/iv*1000+0.5)/10 END coverage_pct FROM g""")
def _a39(p):
    return M.score_pairs(p, _T)


_RS = """sc AS (SELECT r, LIST(1+(prox-eta)/(eta-180) ORDER BY 1+(prox-eta)/(eta-180)) l, COUNT(*) n FROM pairs WHERE prox IS NOT NULL AND eta>180 AND prox>0 GROUP BY r),
 rs AS (SELECT r, n, LEAST(3,GREATEST(0.5,l[CAST(FLOOR(0.5e0*(n-1)) AS BIGINT)+1])) raw FROM sc), sv AS (SELECT r, FLOOR((1+(raw-1)*(n/(n+2000)))*1000+0.5)/1000 AS "value", FLOOR(raw*1000+0.5)/1000 raw, n FROM rs)"""


@R.q("a40_route_scale", "pairs", f"WITH {_RS} SELECT * FROM sv")
def _a40(p):
    return M.route_scale(p)


def _eff(cells: str, key: str) -> str:
    return f"""g AS (SELECT {key}, arm, COUNT(*) n, LIST(ABS(err) ORDER BY ABS(err)) a, LIST(err ORDER BY err) s, COUNT(*) FILTER (err>=120) pe, COUNT(*) FILTER (err<=-120) op FROM {cells} GROUP BY ALL),
  ef AS (SELECT {key}, arm, n, {_r1("a[LEAST(n-1,CAST(FLOOR(0.5e0*n) AS BIGINT))+1]")} median_abs_sec, {_r1("a[LEAST(n-1,CAST(FLOOR(0.9e0*n) AS BIGINT))+1]")} p90_abs_sec, {_r1("s[LEAST(n-1,CAST(FLOOR(0.5e0*n) AS BIGINT))+1]")} median_signed_sec,
   FLOOR(pe/n*1000+0.5)/10 pess120_pct, FLOOR(op/n*1000+0.5)/10 opt120_pct FROM g)"""


@R.q("a40_scale_effect", "pairs", f"""WITH {_RS}, x AS (SELECT p.r, UNNEST(['before','after']) arm, UNNEST([eta-prox, eta+GREATEST(0,eta-180)*(COALESCE("value",1)-1)-prox]) err FROM pairs p LEFT JOIN sv ON sv.r=p.r WHERE prox IS NOT NULL), {_eff('x','r')} SELECT * FROM ef""")
def _a40e(p):
    return M.scale_effect(p, M.route_scale(p))


_HB = f"""{_P}, hb AS (SELECT h, COUNT(*) n, LIST(prox-eta ORDER BY prox-eta) l, STDDEV_SAMP(prox-eta) sd FROM p WHERE prox IS NOT NULL AND h IS NOT NULL GROUP BY h),
 bb AS (SELECT h horizon, {_r1("l[LEAST(n-1,CAST(FLOOR(0.5e0*n) AS BIGINT))+1]")} b, n, {_r1("sd")} sd FROM hb)"""


@R.q("a41_horizon_bias", "pairs", f"WITH {_HB} SELECT * FROM bb")
def _a41(p):
    return M.horizon_bias(p)


@R.q("a41_bias_effect", "pairs")
def _a41e(p):
    return M.bias_effect(p, M.horizon_bias(p))


@R.q("a42_wis_cells", "pairs", f"""WITH {_P}, u AS (SELECT *, det IS NOT NULL AND det>=0 AND low<=eta AND eta<=high us, GREATEST(0,eta-(eta-low)*{_W}) lo, eta+(high-eta)*{_W} hi FROM p WHERE h IS NOT NULL AND eta>=0)
  SELECT route, horizon, COUNT(*) n, COUNT(*) FILTER (us) scored, COUNT(*) FILTER (us AND det BETWEEN lo AND hi) covered, COUNT(*) FILTER (us AND det>hi) late, COUNT(*) FILTER (us AND det<lo) early, ROUND(SUM(CASE WHEN us THEN ABS(det-eta) END),3) AS "abs",
   ROUND(SUM(CASE WHEN us THEN (0.5e0*ABS(det-eta)+0.1e0*(hi-lo+10*GREATEST(0,lo-det)+10*GREATEST(0,det-hi)))/1.5e0 END),3) wis, ROUND(SUM(CASE WHEN us THEN hi-lo END),3) width FROM u, {_FANR} GROUP BY ALL""")
def _a42(p):
    return rounded(M.wis_cells(p, _T), 3)


def _forecasts(p):
    """50-knot forecasts around each promise, some missing or malformed."""
    i = F.sequence(F.lit(0), F.lit(49))
    k = F.col("pair_id")
    good = lambda f: F.transform(i, lambda j: F.col("eta") * (F.lit(f) + j * 0.02))
    ch = F.when(k % 11 == 0, F.lit(None).cast("array<double>")).when(k % 13 == 0, F.transform(i, lambda j: -j.cast("double"))).otherwise(good(0.5))
    return p.select("r", F.lit(None).cast("string").alias("h"), "det", ch.alias("champion"), good(0.6).alias("challenger"), (k % 50).cast("double").alias("age_sec"))


@R.q("a43_pinball", "pairs", """WITH x AS (SELECT r, det, pair_id % 50 age, CASE WHEN pair_id%11=0 THEN 'm' WHEN pair_id%13=0 THEN 'i' WHEN pair_id%50>=45 THEN 'a' ELSE 'ok' END ca, CASE WHEN pair_id%50>=45 THEN 'a' ELSE 'ok' END cb,
    list_sum(list_transform(range(50), lambda i: ((i+0.5e0)/50 - CASE WHEN det < GREATEST(0, eta*(0.5e0+i*0.02e0)-pair_id%50) THEN 1 ELSE 0 END)*(det-GREATEST(0, eta*(0.5e0+i*0.02e0)-pair_id%50))))/50 la,
    list_sum(list_transform(range(50), lambda i: ((i+0.5e0)/50 - CASE WHEN det < GREATEST(0, eta*(0.6e0+i*0.02e0)-pair_id%50) THEN 1 ELSE 0 END)*(det-GREATEST(0, eta*(0.6e0+i*0.02e0)-pair_id%50))))/50 lb FROM pairs),
  y AS (SELECT *, det IS NOT NULL AND ca='ok' AND cb='ok' ok FROM x)
  SELECT route, 'all' horizon, COUNT(*) n, COUNT(*) FILTER (ok) paired, COUNT(*) FILTER (det IS NULL) missing_outcome, COUNT(*) FILTER (det IS NOT NULL AND ca<>'ok') champion_unavailable, COUNT(*) FILTER (det IS NOT NULL AND cb<>'ok') challenger_unavailable,
   ROUND(SUM(CASE WHEN ok THEN la END)/COUNT(*) FILTER (ok),5) champion_loss, ROUND(SUM(CASE WHEN ok THEN lb END)/COUNT(*) FILTER (ok),5) challenger_loss, ROUND((SUM(CASE WHEN ok THEN lb END)-SUM(CASE WHEN ok THEN la END))/COUNT(*) FILTER (ok),5) delta
  FROM y, LATERAL (SELECT UNNEST([r,0]) route) ra GROUP BY route""")
def _a43(p):
    return rounded(M.pinball(_forecasts(p)), 5)


@R.q("j22_identity_clusters", "arrivals", """WITH RECURSIVE e AS (SELECT DISTINCT CAST({LDAY(arrived_at)} AS VARCHAR) || '|i|' || CAST(bus_id AS VARCHAR) a, CAST({LDAY(arrived_at)} AS VARCHAR) || '|n|' || CAST(bus_id//(1+id%2) AS VARCHAR) b FROM arrivals),
  b AS (SELECT a x, b y FROM e UNION SELECT b, a FROM e), r AS (SELECT x, x y FROM b UNION SELECT r.x, b.y FROM r JOIN b ON b.x=r.y) SELECT x alias, MIN(y) AS cluster FROM r GROUP BY x""".replace("WITH RECURSIVE", "WITH"))
def _j22(a):
    from fleetlens.functions import clock
    d = a.select(clock.local_day("arrived_at").alias("day"), "bus_id", F.floor(F.col("bus_id") / (1 + F.col("id") % 2)).cast("string").alias("bus_name"))
    return M.identity_clusters(d)


ORACLE["j22_identity_clusters"] = "WITH RECURSIVE" + ORACLE["j22_identity_clusters"][4:]


@R.q("a44_clustered_bootstrap", "pairs")
def _a44(p):
    d = p.select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("pair_id") % 20).cast("int")).alias("day"), (F.col("r") * 10 + F.col("pair_id") % 7).alias("bus_id"),
        F.concat(F.lit("#"), (F.col("pair_id") % 7).cast("string")).alias("bus_name"), (F.abs(F.col("eta") * 0.98 - F.col("det")) - F.abs(F.col("eta") - F.col("det"))).alias("delta"))
    return M.clustered_bootstrap(d)


@R.q("a45_promotion", "pairs", f"""WITH {_P}, x AS (SELECT pair_id%12 dd, UNNEST(['champion','challenger']) arm, UNNEST([eta, eta*0.95e0]) e2, low, high, det, h FROM p), y AS (SELECT *, CASE WHEN e2>1800 THEN NULL ELSE 1 END k FROM x WHERE det IS NOT NULL),
  l AS (SELECT dd, arm, LIST(ABS(e2-det) ORDER BY ABS(e2-det)) a, COUNT(*) n, COUNT(*) FILTER (high>low) iv, COUNT(*) FILTER (high>low AND det BETWEEN low AND high) ins FROM y WHERE k=1 GROUP BY ALL),
  m AS (SELECT dd, arm, {_r1("a[CAST(CEIL(0.5e0*n) AS BIGINT)]")} med, FLOOR(ins/iv*1000+0.5)/10 cov FROM l),
  d AS (SELECT a.dd, a.med ma, b.med mb, a.cov ca, b.cov cb FROM m a JOIN m b ON b.dd=a.dd AND a.arm='champion' AND b.arm='challenger')
  SELECT ROUND(AVG(mb-ma),5) median_diff, ROUND(GREATEST(3,STDDEV_SAMP(ma)),5) median_bound, ROUND(GREATEST(2,STDDEV_SAMP(ca)),5) coverage_bound, ROUND(MAX(CASE WHEN dd=11 THEN cb-ca END),5) coverage_diff, COUNT(*) AS days,
   COUNT(*) > 0 AND AVG(mb-ma) <= GREATEST(3,STDDEV_SAMP(ma)) AND MAX(CASE WHEN dd=11 THEN cb-ca END) >= -GREATEST(2,STDDEV_SAMP(ca)) promote FROM d""")
def _a45(p):
    d = p.withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("pair_id") % 12).cast("int"))).withColumn("_x", F.explode(F.array(
        F.struct(F.lit("champion").alias("arm"), F.col("eta").alias("e2")), F.struct(F.lit("challenger").alias("arm"), (F.col("eta") * 0.95).alias("e2")))))
    d = d.select("day", F.col("_x.arm").alias("arm"), F.col("_x.e2").alias("eta"), "low", "high", "det")
    return rounded(M.promotion(d, "2024-01-12"), 5)


@R.q("a46_compare_sources", "pairs", f"""WITH {_P}, s AS (SELECT h bucket, det y, eta o, prox u FROM p WHERE det IS NOT NULL AND prox IS NOT NULL AND h IS NOT NULL), x AS (SELECT UNNEST([bucket,'all']) bucket, y, o, u FROM s),
  m AS (SELECT bucket, VAR_POP(o) oo, VAR_POP(u) uu, VAR_POP(y) yy, COVAR_POP(o,u) ou, COVAR_POP(o,y) oy, COVAR_POP(u,y) uy, AVG(o) mo, AVG(u) mu, AVG(y) my FROM x GROUP BY bucket),
  w AS (SELECT bucket, (oy*uu-uy*ou)/(oo*uu-ou*ou) b, (uy*oo-oy*ou)/(oo*uu-ou*ou) c, oo, yy, oy, uy, mo, mu, my FROM m),
  g AS (SELECT bucket, COUNT(*) n, ROUND(CORR(o-y,u-y),5) corr, ROUND(AVG(CASE WHEN ABS(u-y)<ABS(o-y) THEN 1 ELSE 0 END),6) official_closer, ROUND(QUANTILE_CONT(o-y,0.1),5) so_p10, ROUND(QUANTILE_CONT(ABS(u-y),0.9),5) au_p90 FROM x GROUP BY bucket HAVING COUNT(*) >= 50)
  SELECT g.*, ROUND(b,5) b_ours, ROUND(c,5) c_official, ROUND(my-b*mo-c*mu,4) a, ROUND(1-(yy-b*oy-c*uy)/(yy-oy*oy/oo),5) partial_r2 FROM g JOIN w USING (bucket)""")
def _a46(p):
    d = p.where("det IS NOT NULL AND prox IS NOT NULL AND eta <= 1800")
    from fleetlens.functions import exprs as E
    g = M.compare_sources(d.select(E.horizon("eta").alias("bucket"), F.col("det").alias("truth"), F.col("eta").alias("ours"), F.col("prox").alias("official")))
    return g.select("bucket", "n", F.round("corr", 5).alias("corr"), F.round("official_closer", 6).alias("official_closer"), F.round("so_p10", 5).alias("so_p10"), F.round("au_p90", 5).alias("au_p90"),
                    F.round("b_ours", 5).alias("b_ours"), F.round("c_official", 5).alias("c_official"), F.round("a", 4).alias("a"), F.round("partial_r2", 5).alias("partial_r2"))


@R.q("j21_compare_runs", "waits", """WITH a AS (SELECT rider_id, jumped, stranded, worst_drift_sec d FROM waits), b AS (SELECT rider_id, rider_id%5=0 jumped, rider_id%11=0 AND rider_id%2=0 stranded, worst_drift_sec*0.8e0 d FROM waits WHERE rider_id%4<>0),
  x AS (SELECT UNNEST(['jumped','stranded']) flag, UNNEST([a.jumped,a.stranded]) fa, UNNEST([b.jumped,b.stranded]) fb, b.d-a.d dd FROM a JOIN b USING (rider_id))
  SELECT flag, COUNT(*) n, COUNT(*) FILTER (fa AND fb) AS "both", COUNT(*) FILTER (fa AND NOT fb) only_a, COUNT(*) FILTER (NOT fa AND fb) only_b, COUNT(*) FILTER (NOT fa AND NOT fb) neither, ROUND(AVG(dd),6) mean_change FROM x GROUP BY flag""")
def _j21(w):
    b = w.where("rider_id % 4 <> 0").withColumns({"jumped": F.col("rider_id") % 5 == 0, "stranded": (F.col("rider_id") % 11 == 0) & (F.col("rider_id") % 2 == 0), "worst_drift_sec": F.col("worst_drift_sec") * 0.8})
    return rounded(M.compare_runs(w, b, ["jumped", "stranded"], "worst_drift_sec"), 6)


@R.q("a58_compare_models", "looks arrivals", """WITH f AS (SELECT l.id//6 v, l.predicted_at q, UNNEST(['a','b']) arm, UNNEST([l.predicted_at+predicted_sec*1000, l.predicted_at+predicted_sec*900]) p FROM looks l WHERE l.id%7<>0),
  e AS (SELECT f.*, (p-a.arrived_at)/1000 err FROM f JOIN arrivals a ON a.id=f.v WHERE a.id%10<>0), g AS (SELECT arm, v, ARG_MIN(err,q) fe, AVG(ABS(err)) mae FROM e GROUP BY ALL)
  SELECT arm, COUNT(*) visits, ROUND(AVG(ABS(fe)),5) first_mae, ROUND(AVG(fe),5) first_bias, COUNT(*) FILTER (ABS(fe)<=120) within_2min, COUNT(*) FILTER (fe>120) late_2min, COUNT(*) FILTER (fe<-120) early_2min, ROUND(AVG(mae),5) remaining_mae FROM g GROUP BY arm""")
def _a58(looks, a):
    v = a.select(F.col("id").alias("visit_id"), F.when(F.col("id") % 10 != 0, F.col("arrived_at")).alias("actual_at"))
    b = looks.select(F.floor(F.col("id") / 6).alias("visit_id"), F.col("predicted_at").alias("query_at"), "predicted_sec", "id")
    fa = b.where("id % 7 <> 0").select("visit_id", "query_at", F.lit("a").alias("arm"), (F.col("query_at") + F.col("predicted_sec") * 1000).alias("predicted_at"))
    fb = b.select("visit_id", "query_at", F.lit("b").alias("arm"), (F.col("query_at") + F.col("predicted_sec") * 900).alias("predicted_at"))
    return rounded(M.compare_models(v, fa.unionByName(fb), ["a", "b"]), 5)


@R.q("a59_recency_summary", "arrivals", f"""WITH t AS (SELECT stop_id, dwell_sec v, POWER(2e0,(arrived_at-{NOW})/{2*D}e0) w FROM arrivals WHERE dwell_sec > 0), s AS (SELECT stop_id, SUM(w) t, SUM(w*w) q, COUNT(*) n FROM t GROUP BY stop_id),
  d AS (SELECT stop_id, v, SUM(w) w FROM t GROUP BY ALL), c AS (SELECT *, SUM(w) OVER (PARTITION BY stop_id ORDER BY v) cum FROM d)
  SELECT s.stop_id, n, ROUND(t*t/q,5) effective_n, CASE WHEN t*t/q >= 5 THEN (SELECT MIN(v) FROM c WHERE c.stop_id=s.stop_id AND cum >= t/2-t*1e-12) END weighted_median FROM s""")
def _a59(a):
    t = a.select("stop_id", F.col("dwell_sec").alias("actual_sec"), "arrived_at")
    return M.recency_summary(t, ["stop_id"], NOW).withColumn("effective_n", F.round("effective_n", 5))


@R.q("m1_hour_stand_tables", "stop_visits", f"""WITH s AS (SELECT route_id, stop_id, CASE WHEN outcome='passed' THEN 0e0 ELSE (departed_at-pinned_at)/1000e0 END st, {{LMIN(pinned_at)}} tod FROM stop_visits WHERE pinned_at IS NOT NULL AND (outcome='passed' OR (outcome='stopped' AND departed_at>=pinned_at))),
  g AS (SELECT route_id, stop_id, QUANTILE_CONT(st,[0.05,0.15,0.25,0.35,0.45,0.55,0.65,0.75,0.85,0.95]) p, QUANTILE_CONT(st,[0.05,0.15,0.25,0.35,0.45,0.55,0.65,0.75,0.85,0.95]) FILTER (LEAST(ABS(tod-1140),1440-ABS(tod-1140))<=60) h, COUNT(*) FILTER (LEAST(ABS(tod-1140),1440-ABS(tod-1140))<=60) n FROM s GROUP BY ALL)
  SELECT route_id, stop_id, n, k AS knot, ROUND(CASE WHEN n=0 THEN p[k+1] ELSE n/(n+8)*h[k+1]+(1-n/(n+8))*p[k+1] END,4) v FROM (SELECT *, UNNEST(range(10))::INT k FROM g)""")
def _m1(v):
    return rounded(knots(M.hour_stand_tables(v, NOW), ["route_id", "stop_id"], "qh", ["n"]), 4)


@R.q("m1_hour_stand_gate", "stop_visits")
def _m1g(v):
    # Rehearsal stands last seconds, so the layover gate is opened.
    return M.hour_stand_gate(v, min_visits=40, min_med=1.0, min_days=5)


@R.q("m2_lap_fits", "arrivals")
def _m2(a):
    return M.lap_fits(a, period=(900.0, 30.0 * 86400), min_periods=20, min_n=30, min_med=1.0, min_days=5)


@R.q("m3_release_fit", "stop_visits arrivals")
def _m3(v, a):
    laps = M.scan.shifted(a, ["bus_name", "route_id", "stop_id"], ["arrived_at", "id"], {"_pd": "departed_at"}).select("id", (F.pmod((F.col("arrived_at") - F.col("_pd")) / 1000, F.lit(6000.0)) + 900).alias("lap"))
    return M.release_fits(v.join(laps, "id", "left"), NOW)


@R.q("m4_stop_models", "stop_visits")
def _m4(v):
    t = M.materialize(C.stand_tables(v, NOW))
    return knots(M.stop_models(t), ["route_id", "stop_id"], "stand", ["layover", "p_stop"])


@R.q("m4_hop_models", "legs segments stops route_stops")
def _m4h(legs, segments, stops, rs):
    from fleetlens.plans.reg import NOW_DOW, NOW_HOUR
    seg = C.segment_stats(segments, stops, NOW, NOW_DOW, NOW_HOUR)
    h = M.materialize(C.with_chord(C.leg_quantiles(legs, seg, stops, NOW), stops).withColumnRenamed("chord_m", "road_m"))
    return M.hop_models(h, M.materialize(C.pace(legs, stops, rs, NOW))).drop("drive")


@R.q("f10_dist_algebra", "stop_visits", """WITH s AS (SELECT route_id, stop_id, CASE WHEN outcome='passed' THEN 0e0 ELSE (departed_at-pinned_at)/1000e0 END st FROM stop_visits WHERE pinned_at IS NOT NULL AND (outcome='passed' OR (outcome='stopped' AND departed_at>=pinned_at))),
  g AS (SELECT route_id, stop_id, QUANTILE_CONT(st,0.45) a, QUANTILE_CONT(st,0.55) b FROM s GROUP BY ALL) SELECT route_id, stop_id, ROUND(a+(b-a)*LN(0.5e0/0.55e0)/LN(0.45e0/0.55e0),5) med FROM g WHERE b > a""")
def _f10(v):
    t = C.stand_tables(v, 4_000_000_000_000, days=40_000).where(F.element_at("q", 6) > F.element_at("q", 5))
    return t.select("route_id", "stop_id", F.round(dist.quantile("q", 0.5), 5).alias("med"))


_M7 = f"""WITH {asof_ctes(D // 24, 30)},
  h AS (SELECT a.id, a.bus_name, a.route_id, a.arrived_at t0, s, p.stop_id from_stop_id, q.stop_id to_stop_id FROM (SELECT a.*, z.n, UNNEST(range(LEAST(10, n-1))) s FROM arrivals a JOIN (SELECT route_id, MAX(ring_size) n FROM ring GROUP BY 1) z USING (route_id)) a
    JOIN ring p ON p.route_id=a.route_id AND p.stop_index=(a.stop_index+s)%n JOIN ring q ON q.route_id=a.route_id AND q.stop_index=(a.stop_index+s+1)%n),
  c AS (SELECT h.*, SUM(mean) OVER w shrunk, SUM(prior) OVER w median, COUNT(*) OVER w c FROM h JOIN tab ON tab.route_id=h.route_id AND tab.from_stop_id=h.from_stop_id AND tab.to_stop_id=h.to_stop_id AND as_of=t0//{D // 24}*{D // 24}
    WINDOW w AS (PARTITION BY h.id ORDER BY s)),
  x AS (SELECT c.*, (b.arrived_at-t0)/1000e0 act FROM c ASOF JOIN arrivals b ON b.bus_name=c.bus_name AND b.route_id=c.route_id AND b.stop_id=c.to_stop_id AND c.t0 < b.arrived_at WHERE c.c=s+1 AND b.arrived_at-t0 <= 7200000),
  e AS (SELECT 'shrunk' variant, s+1 ahead, shrunk-act err FROM x UNION ALL SELECT 'median', s+1, median-act FROM x),
  f AS (SELECT variant, CASE WHEN ahead=1 THEN '1' WHEN ahead<=5 THEN '2-5' ELSE '6-10' END band, err FROM e UNION ALL SELECT variant, 'all', err FROM e)
  SELECT variant, band, COUNT(*) n, ROUND(QUANTILE_CONT(ABS(err),0.5),5) median_abs_sec, ROUND(QUANTILE_CONT(ABS(err),0.9),5) p90_abs_sec, ROUND(AVG(err),5) bias_sec FROM f GROUP BY ALL"""


@R.q("m7_standing_backtest", "arrivals segments stops ring", _M7)
def _m7(a, segments, stops, ring):
    t = M.materialize(C.calibrate_asof(segments, stops))
    rival = t.select(*C.HOP, "as_of", F.col("prior").alias("mean"))
    return rounded(M.standing_backtest(a, ring, {"shrunk": t, "median": rival}, step_ms=D // 24), 5)


@R.q("m8_chronological_plan", "arrivals", "WITH d AS (SELECT DISTINCT {LDAY(arrived_at)} AS day FROM arrivals), r AS (SELECT day, ROW_NUMBER() OVER (ORDER BY day DESC) rn FROM d) SELECT day, CASE WHEN rn<=8 THEN 'test' ELSE 'train' END phase FROM r WHERE rn<=22")
def _m8(a):
    from fleetlens.functions import clock
    return M.chronological_plan(a.select(clock.local_day("arrived_at").alias("day")))


@R.q("m9_covariate_shares", "pairs", """WITH c AS (SELECT CORR(det,eta) ya, CORR(det,r) yc, CORR(eta,r) ac, COUNT(*) n FROM pairs WHERE det IS NOT NULL), f AS (SELECT *, (ya*ya+yc*yc-2*ya*yc*ac)/(1-ac*ac) r2 FROM c)
  SELECT 'promise' feature_group, ROUND((ya*ya+r2-yc*yc)/2,6) share, ROUND(r2,6) r2, n FROM f UNION ALL SELECT 'route', ROUND((yc*yc+r2-ya*ya)/2,6), ROUND(r2,6), n FROM f""")
def _m9s(p):
    d = p.where("det IS NOT NULL").select(F.col("det").alias("y"), F.col("eta").alias("a"), F.col("r").cast("double").alias("c"))
    return rounded(M.covariate_study(d, "y", {"promise": ["a"], "route": ["c"]}), 6)


_J23 = """WITH nm AS (SELECT DISTINCT p_name pn FROM part), nt AS (SELECT DISTINCT pn, len(list_distinct(string_split(lower(pn),' '))) m, UNNEST(list_distinct(string_split(lower(pn),' '))) w FROM nm),
  q AS (SELECT p_partkey qid, strip_accents(lower(CASE p_partkey%4 WHEN 0 THEN SUBSTR(p_name,1,LENGTH(p_name)-2) || SUBSTR(p_name,LENGTH(p_name),1) || SUBSTR(p_name,LENGTH(p_name)-1,1) WHEN 1 THEN SUBSTR(p_name,1,2) || SUBSTR(p_name,4)
    WHEN 2 THEN SUBSTR(p_name,1,2) || SUBSTR(p_name,4,LENGTH(p_name)-4) || 'xz' ELSE replace(p_name,'e','é') END)) q FROM part),
  qt AS (SELECT qid, len(list_distinct(string_split(q,' '))) n, UNNEST(list_distinct(string_split(q,' '))) t FROM q),
  tw AS (SELECT t, w, CASE WHEN t=w THEN 0 ELSE damerau_levenshtein(t,w) END e FROM (SELECT DISTINCT t FROM qt), (SELECT DISTINCT w FROM nt) WHERE t=w OR (LENGTH(t)>=4 AND LENGTH(w)>=4 AND damerau_levenshtein(t,w) <= CASE WHEN LENGTH(t)>=8 THEN 2 ELSE 1 END)),
  h AS (SELECT qid, n, pn, m, t, MIN(e) e FROM qt JOIN tw USING (t) JOIN nt USING (w) GROUP BY ALL),
  s AS (SELECT qid, pn, ROUND(COUNT(*)/n-0.1e0*SUM(e)-0.01e0*(m-LEAST(COUNT(*),m)),6) sc, SUM(e) e FROM h GROUP BY qid, n, pn, m),
  b AS (SELECT qid, pn, sc, e FROM s QUALIFY ROW_NUMBER() OVER (PARTITION BY qid ORDER BY sc DESC, pn)=1)
  SELECT q.qid query_id, b.pn AS name_id, b.sc AS score, CAST(b.e AS BIGINT) edits FROM q LEFT JOIN b ON b.qid=q.qid"""


@R.q("j23_resolve_queries", "part", _J23)
def _j23(part):
    # Searches are part names with slips of one and two edits and with accents; places are the distinct part names.
    names = part.select(F.col("p_name").alias("name_id"), F.col("p_name").alias("name")).distinct()
    n, p, kind = F.length("p_name"), F.col("p_name"), F.col("p_partkey") % 4
    at = lambda a, b: F.substring(p, F.lit(a) if isinstance(a, int) else a, F.lit(b) if isinstance(b, int) else b)
    slip = F.when(kind == 0, F.concat(at(1, n - 2), at(n, 1), at(n - 1, 1))).when(kind == 1, F.concat(at(1, 2), at(4, n))).when(
        kind == 2, F.concat(at(1, 2), at(4, n - 4), F.lit("xz"))).otherwise(F.replace(p, F.lit("e"), F.lit("é")))
    return matching.resolve_queries(part.select(F.col("p_partkey").alias("query_id"), slip.alias("q")), names)
