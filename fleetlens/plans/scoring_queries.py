"""Registered scoring queries and their SQL equivalents."""

from __future__ import annotations

from fleetlens.operators import scoring as S
from fleetlens.plans.rehearsal import frame, oracle
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _v(spark, d, *names):
    return [frame(spark, d, n) for n in names]


# SQL pieces -------------------------------------------------------------------------------------

ROWS_SQL = """
prows AS (
  SELECT {LDAY(predicted_at)} AS day, LTRIM(bus_name,'#') bus, route_id, to_stop_id stop_id, predicted_at at_ms, predicted_at ord, id ord_id,
         predicted_sec sec, predicted_low_sec low, predicted_high_sec high, surface, client_build build
  FROM %(preds)s WHERE surface IN ('trip','ride','card','upstream')
  UNION ALL
  SELECT {LDAY(sampled_at)} AS day, LTRIM(bus_name,'#'), route_id, stop_id, COALESCE(calc_at, sampled_at), sampled_at, id,
         CAST(eta_sec AS DOUBLE), CAST(eta_sec AS DOUBLE), CAST(eta_sec AS DOUBLE), 'census', NULL
  FROM census WHERE bus_name IS NOT NULL AND route_id IS NOT NULL AND eta_sec IS NOT NULL),
tv AS (SELECT LTRIM(bus_name,'#') bus, route_id, stop_id, arrived_at, departed_at FROM arrivals),
tj AS (
  SELECT p.*, v.arrived_at p_t, v.departed_at p_d, n.arrived_at n_t,
         CASE WHEN sec > 1800 THEN NULL WHEN sec < 120 THEN '0-2' WHEN sec < 300 THEN '2-5' WHEN sec < 600 THEN '5-10' ELSE '10-30' END horizon
  FROM prows p
  ASOF LEFT JOIN tv v ON p.bus = v.bus AND p.route_id = v.route_id AND p.stop_id = v.stop_id AND p.at_ms > v.arrived_at
  ASOF LEFT JOIN tv n ON p.bus = n.bus AND p.route_id = n.route_id AND p.stop_id = n.stop_id AND p.at_ms <= n.arrived_at),
sc AS (
  SELECT *, CASE WHEN kind = 'arrived' THEN n_t END actual_at,
         CASE WHEN kind = 'arrived' THEN sec - (n_t - at_ms)/1000e0 END err
  FROM (SELECT *, CASE WHEN horizon IS NULL THEN 'beyond'
          WHEN p_t IS NOT NULL AND (p_d IS NULL OR p_d >= at_ms) AND at_ms - p_t <= 7200000 THEN 'standing'
          WHEN n_t - at_ms <= 2700000 THEN 'arrived' ELSE 'missing' END kind FROM tj)),
sc2 AS (
  SELECT *, LAG(kind) OVER w pk, LAG(actual_at) OVER w pa, LAG(at_ms) OVER w pat, LAG(sec) OVER w psec,
         LEAD(kind) OVER w nk, LEAD(actual_at) OVER w na
  FROM sc WINDOW w AS (PARTITION BY day, surface, bus, stop_id ORDER BY ord, ord_id)),
flags AS (
  SELECT *, kind='arrived' AND high > low has_iv,
    kind='arrived' AND high > low AND (n_t-at_ms)/1000e0 BETWEEN low AND high covered,
    COALESCE(kind='arrived' AND pk='arrived' AND pa=actual_at AND at_ms-pat <= 300000, FALSE) jump_pair,
    COALESCE(kind='arrived' AND pk='arrived' AND pa=actual_at AND at_ms-pat <= 300000
             AND ABS((at_ms+sec*1000)-(pat+psec*1000))/1000 >= 180, FALSE) jump,
    COALESCE(kind='arrived' AND NOT COALESCE(nk='arrived' AND na=actual_at, FALSE) AND actual_at-at_ms <= 90000, FALSE) wait
  FROM sc2)
"""

_FAN = """, ex AS (SELECT f.*, r.rr, h.hh, s.ss FROM flags f,
  LATERAL (SELECT UNNEST([route_id, 0]) rr) r, LATERAL (SELECT UNNEST(CASE WHEN horizon IS NULL THEN ['all'] ELSE [horizon,'all'] END) hh) h,
  LATERAL (SELECT UNNEST(CASE WHEN surface IN ('trip','ride','card') THEN [surface,'ours'] ELSE [surface] END) ss) s)
"""

SCORECARD_SQL = "WITH " + ROWS_SQL.strip() + _FAN + """,
jx AS (SELECT f.day, r.rr, h.hh, s.ss, f.jump FROM (SELECT *, CASE WHEN psec > 1800 THEN NULL WHEN psec < 120 THEN '0-2' WHEN psec < 300 THEN '2-5'
         WHEN psec < 600 THEN '5-10' ELSE '10-30' END ph FROM flags WHERE jump_pair) f,
  LATERAL (SELECT UNNEST([route_id, 0]) rr) r, LATERAL (SELECT UNNEST([ph,'all']) hh) h,
  LATERAL (SELECT UNNEST(CASE WHEN surface IN ('trip','ride','card') THEN [surface,'ours'] ELSE [surface] END) ss) s),
js AS (SELECT day, rr, hh, ss, COUNT(*) jump_pairs, COUNT(*) FILTER (jump) jumps FROM jx GROUP BY ALL),
agg AS (SELECT day, rr, hh, ss, COUNT(*) n, COUNT(*) FILTER (kind='beyond') beyond, COUNT(*) FILTER (kind='standing') standing,
  COUNT(*) FILTER (kind='missing') missing, COUNT(*) FILTER (kind='arrived') paired,
  LIST(err ORDER BY err) FILTER (err IS NOT NULL) es, LIST(ABS(err) ORDER BY ABS(err)) FILTER (err IS NOT NULL) aes,
  COUNT(*) FILTER (ABS(err) <= 120) w120, COUNT(*) FILTER (err >= 120) pe, COUNT(*) FILTER (err <= -120) op,
  COUNT(*) FILTER (has_iv) interval_rows, COUNT(*) FILTER (covered) cov,
  COUNT(*) FILTER (wait AND hh='all') waits, COUNT(*) FILTER (wait AND hh='all' AND sec >= 180) strands
  FROM ex GROUP BY ALL)
SELECT a.day, a.rr route_id, a.hh horizon, a.ss surface, n, beyond, standing, missing, paired,
  FLOOR(es[CAST(FLOOR(0.5e0*(paired-1)) AS BIGINT)+1]*10+0.5)/10 median_signed_sec,
  FLOOR(aes[CAST(FLOOR(0.5e0*(paired-1)) AS BIGINT)+1]*10+0.5)/10 median_abs_sec,
  FLOOR(aes[CAST(FLOOR(0.9e0*(paired-1)) AS BIGINT)+1]*10+0.5)/10 p90_abs_sec,
  CASE WHEN paired>0 THEN FLOOR(w120/paired*1000+0.5)/10 END within120_pct, CASE WHEN paired>0 THEN FLOOR(pe/paired*1000+0.5)/10 END pess120_pct,
  CASE WHEN paired>0 THEN FLOOR(op/paired*1000+0.5)/10 END opt120_pct, interval_rows,
  CASE WHEN interval_rows>0 THEN FLOOR(cov/interval_rows*1000+0.5)/10 END interval_coverage_pct, waits, strands,
  COALESCE(jump_pairs,0) jump_pairs, COALESCE(jumps,0) jumps
FROM agg a LEFT JOIN js ON js.day=a.day AND js.rr=a.rr AND js.hh=a.hh AND js.ss=a.ss
"""


def _add(name, fn, names, sql):
    QUERIES[name] = fn
    if sql is not None:
        ORACLE[name] = oracle(names, sql)


def _scorecard(src):
    def run(spark, d):
        p, c, a = _v(spark, d, src, "census", "arrivals")
        return S.scorecard(p, a, c)
    return run


_add("a15_scorecard", _scorecard("predictions"), "predictions census arrivals", SCORECARD_SQL % {"preds": "predictions"})
_add("a16_scorecard_waits", _scorecard("looks"), "looks census arrivals", SCORECARD_SQL % {"preds": "looks"})


def _truth(spark, d):
    p, a = _v(spark, d, "predictions", "arrivals")
    return S.score_rows(S.scoreable(p), a).select("ord_id", "bus", "route_id", "stop_id", "horizon", "kind", "actual_at", "err")


_add("j7_truth_join", _truth, "predictions census arrivals", "WITH " + (ROWS_SQL.strip() % {"preds": "predictions"}) +
     " SELECT ord_id, bus, route_id, stop_id, horizon, kind, actual_at, err FROM sc WHERE surface <> 'census'")


def _islands(spark, d):
    p, a = _v(spark, d, "looks", "arrivals")
    return S.wait_islands(S.score_rows(S.scoreable(p), a)).select("ord_id", "kind", "jump_pair", "jump", "wait", "strand")


_add("w6_wait_islands", _islands, "looks census arrivals", "WITH " + (ROWS_SQL.strip() % {"preds": "looks"}) +
     " SELECT ord_id, kind, jump_pair, jump, wait, wait AND sec >= 180 strand FROM flags WHERE surface <> 'census'")

_add("a15_scorecard_builds", lambda s, d: S.scorecard_builds(frame(s, d, "predictions")), "predictions",
     """SELECT day, rr route_id, hh horizon, ss surface, client_build build, COUNT(*) n FROM (
  SELECT *, {LDAY(predicted_at)} AS day, CASE WHEN predicted_sec > 1800 THEN NULL WHEN predicted_sec < 120 THEN '0-2' WHEN predicted_sec < 300 THEN '2-5'
    WHEN predicted_sec < 600 THEN '5-10' ELSE '10-30' END horizon FROM predictions WHERE surface IN ('trip','ride','card') AND client_build IS NOT NULL) f,
  LATERAL (SELECT UNNEST([route_id, 0]) rr) r, LATERAL (SELECT UNNEST(CASE WHEN horizon IS NULL THEN ['all'] ELSE [horizon,'all'] END) hh) h,
  LATERAL (SELECT UNNEST([surface,'ours']) ss) s GROUP BY ALL""")

_add("a14_accuracy", lambda s, d: S.accuracy(*_v(s, d, "predictions", "arrivals")), "predictions arrivals", """
WITH e AS (SELECT CASE WHEN stops_ahead <= 0 THEN '1' WHEN stops_ahead >= 10 THEN '10+' ELSE CAST(stops_ahead AS VARCHAR) END bk,
    ABS((a.arrived_at - p.predicted_at)/1000e0 - p.predicted_sec) v
  FROM predictions p ASOF JOIN arrivals a ON p.bus_id=a.bus_id AND p.to_stop_id=a.stop_id AND p.predicted_at <= a.arrived_at
  WHERE p.surface NOT IN ('upstream') AND a.arrived_at - p.predicted_at <= 7200000)
SELECT bucket, COUNT(*) n, QUANTILE_CONT(v, 0.5) median_abs_sec, QUANTILE_CONT(v, 0.9) p90_abs_sec, QUANTILE_CONT(v, 0.95) p95_abs_sec
FROM (SELECT UNNEST([bk,'overall']) bucket, v FROM e) GROUP BY bucket""")

_PAIRED = """WITH j AS (SELECT p.*, a.arrived_at FROM predictions p ASOF LEFT JOIN arrivals a
   ON p.bus_name=a.bus_name AND p.route_id=a.route_id AND p.to_stop_id=a.stop_id AND p.predicted_at <= a.arrived_at WHERE p.surface <> 'upstream'),
 r AS (SELECT id, predicted_at, CASE WHEN arrived_at - predicted_at <= 7200000 THEN arrived_at END arrived_at,
   CASE WHEN arrived_at - predicted_at <= 7200000 THEN (arrived_at - predicted_at)/1000e0 - predicted_sec END error_sec FROM j)
"""
_add("a17_paired_rows", lambda s, d: S.paired_rows(*_v(s, d, "predictions", "arrivals")).select("id", "predicted_at", "arrived_at", "error_sec"),
     "predictions arrivals", _PAIRED + "SELECT id, predicted_at, arrived_at, error_sec FROM r")
_add("a17_paired_summary", lambda s, d: S.paired_summary(S.paired_rows(*_v(s, d, "predictions", "arrivals"))), "predictions arrivals",
     _PAIRED + """, l AS (SELECT COUNT(*) n, COUNT(error_sec) paired, LIST(ABS(error_sec) ORDER BY ABS(error_sec)) FILTER (error_sec IS NOT NULL) a,
      LIST(error_sec ORDER BY error_sec) FILTER (error_sec IS NOT NULL) s FROM r)
  SELECT n, paired, FLOOR(a[CAST(FLOOR(0.5e0*(paired-1)) AS BIGINT)+1]*10+0.5)/10 median_abs_sec,
   FLOOR(a[CAST(FLOOR(0.9e0*(paired-1)) AS BIGINT)+1]*10+0.5)/10 p90_abs_sec, FLOOR(s[CAST(FLOOR(0.5e0*(paired-1)) AS BIGINT)+1]*10+0.5)/10 median_signed_sec FROM l""")
_add("o2_paired_newest", lambda s, d: S.paired_newest(S.paired_rows(*_v(s, d, "predictions", "arrivals"))).select("id", "predicted_at", "arrived_at", "error_sec"),
     "predictions arrivals", _PAIRED + "SELECT * FROM r ORDER BY predicted_at DESC, id DESC LIMIT 200")

_ARMS = """WITH p AS (SELECT LTRIM(bus_name,'#') bus, route_id, to_stop_id stop_id, id, predicted_at at_ms, predicted_sec sec,
   CASE WHEN surface='upstream' THEN 'official' ELSE 'ours' END arm FROM %(src)s),
 t AS (SELECT p.*, v.arrived_at p_t, v.departed_at p_d, n.arrived_at n_t FROM p
   ASOF LEFT JOIN (SELECT LTRIM(bus_name,'#') bus, route_id, stop_id, arrived_at, departed_at FROM arrivals) v ON p.bus=v.bus AND p.route_id=v.route_id AND p.stop_id=v.stop_id AND p.at_ms > v.arrived_at
   ASOF LEFT JOIN (SELECT LTRIM(bus_name,'#') bus, route_id, stop_id, arrived_at FROM arrivals) n ON p.bus=n.bus AND p.route_id=n.route_id AND p.stop_id=n.stop_id AND p.at_ms <= n.arrived_at),
 k AS (SELECT *, CASE WHEN sec > 1800 THEN 'beyond' WHEN p_t IS NOT NULL AND (p_d IS NULL OR p_d >= at_ms) AND at_ms - p_t <= 7200000 THEN 'standing'
   WHEN n_t - at_ms <= 2700000 THEN 'arrived' ELSE 'missing' END kind FROM t),
 e AS (SELECT *, CASE WHEN kind='arrived' THEN (n_t - at_ms)/1000e0 - sec END err FROM k),
 m AS (SELECT bus, stop_id, at_ms//60000 mi, arm, n_t, err FROM e WHERE kind='arrived'
   QUALIFY ROW_NUMBER() OVER (PARTITION BY bus, stop_id, at_ms//60000, arm ORDER BY at_ms, id) = 1),
 sh AS (SELECT a.bus, a.stop_id, a.mi, a.err oe, b.err te FROM m a JOIN m b ON a.bus=b.bus AND a.stop_id=b.stop_id AND a.mi=b.mi AND a.n_t=b.n_t
   WHERE a.arm='ours' AND b.arm='official')
"""
# Readings of both arms at shared moments: every arrival looked at by ours and by the official feed.
_BOTH = "(SELECT id, bus_name, route_id, to_stop_id, predicted_at, predicted_sec, surface FROM looks UNION ALL SELECT id + 1000000000, bus_name, route_id, to_stop_id, predicted_at + 3000, predicted_sec + 30, 'upstream' FROM looks WHERE id % 3 = 0)"


def _both(s, d):
    p = frame(s, d, "looks").select("id", "bus_name", "route_id", "to_stop_id", "predicted_at", "predicted_sec", "surface")
    u = p.where("id % 3 = 0").withColumns({"id": F.col("id") + 1000000000, "predicted_at": F.col("predicted_at") + 3000,
                                           "predicted_sec": F.col("predicted_sec") + 30, "surface": F.lit("upstream")})
    return p.unionByName(u)


_add("j11_shared_moments", lambda s, d: S.shared_moments(S._arms(_both(s, d), frame(s, d, "arrivals"))), "looks arrivals",
     _ARMS % {"src": _BOTH} + "SELECT bus, stop_id, mi AS minute, oe ours_err, te official_err FROM sh")
_add("a18_official_comparison", lambda s, d: S.official_comparison(_both(s, d), frame(s, d, "arrivals")), "looks arrivals",
     _ARMS % {"src": _BOTH} + """, u AS (SELECT arm, kind, err FROM e UNION ALL SELECT 'shared_ours','arrived', oe FROM sh UNION ALL SELECT 'shared_official','arrived',te FROM sh),
  l AS (SELECT arm, COUNT(*) n, COUNT(*) FILTER (kind='beyond') beyond, COUNT(*) FILTER (kind='standing') standing, COUNT(err) paired,
    LIST(ABS(err) ORDER BY ABS(err)) FILTER (err IS NOT NULL) a, COUNT(*) FILTER (ABS(err)<=120) w FROM u GROUP BY arm)
  SELECT arm, n, beyond, standing, paired, CASE WHEN paired >= 50 THEN FLOOR(a[CAST(FLOOR(0.5e0*(paired-1)) AS BIGINT)+1]*10+0.5)/10 END median_abs_sec,
   CASE WHEN paired >= 50 THEN FLOOR(w/paired*1000+0.5)/10 END within120_pct FROM l
  WHERE (SELECT MIN(paired) >= 50 AND COUNT(*) = 2 FROM l WHERE arm IN ('ours','official'))""")


def _v1rows(s, d):
    p = frame(s, d, "looks").withColumn("from_stop_id", (F.col("to_stop_id") + 5 * (F.col("id") % 4)) % 25)
    return S.v1_accuracy_rows(p, frame(s, d, "arrivals"), frame(s, d, "ring"))


_V1 = """WITH p AS (SELECT *, (to_stop_id + 5*(id % 4)) % 25 from_stop_id FROM looks),
 j AS (SELECT p.*, (a.arrived_at - p.predicted_at)/1000e0 act FROM p ASOF JOIN arrivals a ON p.bus_id=a.bus_id AND p.to_stop_id=a.stop_id AND p.predicted_at < a.arrived_at),
 r AS (SELECT j.route_id, to_stop_id stop_id, predicted_sec - act err, b.bucket, (predicted_sec - act) BETWEEN -b.lt AND b.et in_range,
    ((t.stop_index - f.stop_index) % 5 + 5) % 5 ahead FROM j
   JOIN (VALUES ('0-3m',0,180,30,90),('3-6m',180,360,60,150),('6-10m',360,600,60,210),('10-15m',600,900,90,270)) b(bucket,lo,hi,et,lt) ON act >= lo AND act < hi
   LEFT JOIN route_stops f ON f.route_id=j.route_id AND f.stop_id=j.from_stop_id LEFT JOIN route_stops t ON t.route_id=j.route_id AND t.stop_id=j.to_stop_id
   WHERE act <= 900 AND act <= predicted_sec*3+60)
"""
_add("a13_v1_accuracy_buckets", lambda s, d: S.v1_accuracy_buckets(_v1rows(s, d)), "looks arrivals route_stops", _V1 + """
 SELECT bucket, COUNT(*) n, ROUND(100e0*COUNT(*) FILTER (in_range)/COUNT(*),1) in_range_pct, ROUND(AVG(ABS(err)),1) mae_sec, ROUND(AVG(err),1) bias_sec FROM r GROUP BY bucket""")
_add("a13_v1_accuracy_overall", lambda s, d: S.v1_accuracy_overall(_v1rows(s, d)), "looks arrivals route_stops", _V1 + """,
 b AS (SELECT bucket, COUNT(*) n, ROUND(100e0*COUNT(*) FILTER (in_range)/COUNT(*),1) ir, ROUND(AVG(ABS(err)),1) mae, ROUND(AVG(err),1) bi FROM r GROUP BY bucket)
 SELECT CAST(SUM(n) AS BIGINT) n, ROUND(ROUND(AVG(ir),6),1) in_range_pct, ROUND(ROUND(AVG(mae),6),1) mae_sec, ROUND(ROUND(AVG(bi),6),1) bias_sec,
  (SELECT ROUND(QUANTILE_CONT(ABS(err),0.9),1) FROM r) p90_sec, (SELECT ROUND(QUANTILE_CONT(ABS(err),0.95),1) FROM r) p95_sec FROM b""")
_add("a13_v1_accuracy_stops", lambda s, d: S.v1_accuracy_stops(_v1rows(s, d)), "looks arrivals route_stops", _V1 + """,
 b AS (SELECT stop_id, route_id, bucket, ROUND(100e0*COUNT(*) FILTER (in_range)/COUNT(*),1) ir, ROUND(AVG(ABS(err)),1) mae, ROUND(AVG(err),1) bi FROM r GROUP BY ALL),
 m AS (SELECT stop_id, route_id, ROUND(ROUND(AVG(ir),6),1) in_range_pct, ROUND(ROUND(AVG(mae),6),1) mae_sec, ROUND(ROUND(AVG(bi),6),1) bias_sec FROM b GROUP BY ALL)
 SELECT m.*, q.n, q.p50_sec, q.p90_sec, q.p95_sec FROM m JOIN (SELECT stop_id, route_id, COUNT(*) n, ROUND(QUANTILE_CONT(ABS(err),0.5),1) p50_sec,
   ROUND(QUANTILE_CONT(ABS(err),0.9),1) p90_sec, ROUND(QUANTILE_CONT(ABS(err),0.95),1) p95_sec FROM r GROUP BY ALL) q ON q.stop_id=m.stop_id AND q.route_id=m.route_id""")
_add("a13_v1_accuracy_distance", lambda s, d: S.v1_accuracy_stops(_v1rows(s, d), by_distance=True), "looks arrivals route_stops", _V1 + """
 SELECT stop_id, route_id, CAST(ahead AS VARCHAR) ahead, COUNT(*) n, ROUND(AVG(ABS(err)),1) mae_sec, ROUND(AVG(err),1) bias_sec, ROUND(QUANTILE_CONT(ABS(err),0.5),1) p50_sec,
   ROUND(QUANTILE_CONT(ABS(err),0.9),1) p90_sec, ROUND(QUANTILE_CONT(ABS(err),0.95),1) p95_sec FROM r WHERE ahead > 0 GROUP BY ALL""")
