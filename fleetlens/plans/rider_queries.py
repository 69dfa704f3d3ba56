"""Registered rider, search, monitor and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import exprs as E
from fleetlens.operators import monitor as M
from fleetlens.operators import riders as A
from fleetlens.plans.reg import NOW, Registry, rounded

R = Registry()
QUERIES, ORACLE = R.queries, R.oracles
H = 3_600_000
# Run data spans 1995-2001; the monitor report looks back from a moment inside it.
RUN_NOW = 946_684_800_000

_CT = "WITH ct AS (SELECT * FROM daily_actives WHERE anon_id NOT IN (SELECT anon_id FROM excluded_ids) AND day >= DATE '2024-01-02'), "
_T = "DATE '2024-01-30'"
_V = "daily_actives excluded_ids"


def _ct(actives, excluded):
    return A.countable(actives, excluded, "2024-01-02")


@R.q("p14_countable", _V, _CT.rstrip(", ") + " SELECT day, anon_id, polls FROM ct")
def _p14(a, x):
    return _ct(a, x).select("day", "anon_id", "polls")


@R.q("a19_active_counts", _V, _CT + f"""p AS (SELECT anon_id, MAX(day) l, MIN(day) f, MAX(CASE WHEN day={_T} THEN 1 ELSE 0 END) t FROM ct GROUP BY ALL)
  SELECT COUNT(*) FILTER (t=1) today, (SELECT COUNT(DISTINCT anon_id) FROM ct WHERE day >= {_T} - 6) last7, (SELECT COUNT(DISTINCT anon_id) FROM ct WHERE day >= {_T} - 29) last30,
  COUNT(*) ever, COUNT(*) FILTER (t=1 AND f < {_T}) returning_today, COUNT(*) FILTER (t=1 AND f={_T}) new_today FROM p""")
def _a19(a, x):
    return A.active_counts(_ct(a, x), NOW)


@R.q("x1_returning_today", _V, _CT.rstrip(", ") + f" SELECT anon_id FROM ct WHERE day={_T} INTERSECT SELECT anon_id FROM ct WHERE day < {_T}")
def _x1(a, x):
    return A.returning_ids(_ct(a, x), NOW)


@R.q("j1_with_first_day", _V, _CT.rstrip(", ") + " SELECT day, anon_id, MIN(day) OVER (PARTITION BY anon_id) first_day FROM ct")
def _j1(a, x):
    return A.with_first_day(_ct(a, x)).select("day", "anon_id", "first_day")


@R.q("a20_rider_history", _V, _CT + f"""f AS (SELECT anon_id, MIN(day) f FROM ct GROUP BY ALL),
  m AS (SELECT day, QUANTILE_CONT((last_seen_ms-first_seen_ms)/60000, 0.5) m FROM ct WHERE last_seen_ms > first_seen_ms GROUP BY day)
  SELECT ct.day, COUNT(*) riders, COUNT(*) FILTER (f=ct.day) new_riders, COUNT(*) FILTER (f<>ct.day) returning_riders, CAST(SUM(searches) AS BIGINT) searches,
  FLOOR(COALESCE(ANY_VALUE(m),0)*10+0.5)/10 median_minutes FROM ct JOIN f USING (anon_id) LEFT JOIN m ON m.day=ct.day WHERE ct.day >= {_T} - 20 GROUP BY ct.day""")
def _a20(a, x):
    return A.rider_history(_ct(a, x), 21, NOW)


@R.q("a21_repeat_rate", _V, _CT + "p AS (SELECT anon_id, COUNT(DISTINCT day) d FROM ct GROUP BY ALL) SELECT ROUND(COUNT(*) FILTER (d>=2)/COUNT(*),7) repeat_rate FROM p")
def _a21(a, x):
    return rounded(A.repeat_rate(_ct(a, x)))


@R.q("a22_week1_retention", _V, _CT + f"""f AS (SELECT anon_id, MIN(day) f FROM ct GROUP BY ALL HAVING MIN(day) <= {_T} - 7)
  SELECT COUNT(*) cohort, ROUND(COUNT(*) FILTER (EXISTS (SELECT 1 FROM ct WHERE ct.anon_id=f.anon_id AND day > f AND day <= f+7))/COUNT(*),7) retention FROM f""")
def _a22(a, x):
    return rounded(A.week1_retention(_ct(a, x), NOW))


@R.q("a23_engagement", _V, _CT + """p AS (SELECT anon_id, COUNT(DISTINCT day) d FROM ct GROUP BY ALL)
  SELECT (SELECT QUANTILE_CONT(d,0.5) FROM p) median_days, FLOOR((SELECT QUANTILE_CONT((last_seen_ms-first_seen_ms)/60000,0.5) FROM ct WHERE last_seen_ms>first_seen_ms)*10+0.5)/10 median_minutes""")
def _a23(a, x):
    return A.engagement(_ct(a, x))


@R.q("a24_hourly_presence", _V, _CT + f"""s AS (SELECT day, {{LHOUR(first_seen_ms)}} h0, {{LHOUR(last_seen_ms)}} h1 FROM ct WHERE day >= {_T} - 6)
  SELECT day, CAST(h AS INT) AS hour, COUNT(*) riders FROM (SELECT day, UNNEST(range(h0, CASE WHEN h1 >= h0 THEN h1 ELSE 23 END + 1)) h FROM s) GROUP BY ALL""")
def _a24(a, x):
    return A.hourly_presence(_ct(a, x), 7, NOW)


_ST = f"WITH t AS (SELECT q, CAST(SUM(n) AS BIGINT) n, CAST(SUM(zero) AS BIGINT) zero FROM search_terms WHERE day >= {_T} - 29 GROUP BY q), "


@R.q("a25_search_report", "search_terms", _ST + """k AS (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE LENGTH(o.q) > LENGTH(t.q) AND starts_with(o.q, t.q))),
  z AS (SELECT * FROM t WHERE zero >= n), kz AS (SELECT * FROM z WHERE NOT EXISTS (SELECT 1 FROM z o WHERE LENGTH(o.q) > LENGTH(z.q) AND starts_with(o.q, z.q)))
  (SELECT 'top' list, * FROM k ORDER BY n DESC, q LIMIT 25) UNION ALL (SELECT 'missing', * FROM kz ORDER BY n DESC, q LIMIT 25)""")
def _a25(t):
    return A.search_report(t, 30, 25, NOW)


@R.q("a25_search_totals", "search_terms", _ST.rstrip(", ") + " SELECT CAST(SUM(n) AS BIGINT) searches, CAST(SUM(zero) AS BIGINT) zero_searches, COUNT(*) distinct_terms FROM t")
def _a25t(t):
    return A.search_totals(t, 30, NOW)


@R.q("f8_normalize_query", "conversations", r"""SELECT conv_id, turn, SUBSTR(TRIM(regexp_replace(regexp_replace(lower(text), '[''’]', '', 'g'), '[^a-z0-9]+', ' ', 'g')),1,60) q FROM conversations""")
def _f8(c):
    return c.select("conv_id", "turn", E.normalize_query("text").alias("q"))


def _runs(r):
    jump = F.struct(F.col("started_at").alias("at_ms"), "from_sec", "drift_sec", F.lit(False).alias("announced"))
    return r.withColumn("jumps", F.array(jump)).withColumn("received_at", F.col("started_at"))


@R.q("a26_monitor_lines", "monitor_runs", f"""SELECT line, COUNT(*) FILTER (w) runs, COUNT(*) FILTER (w AND ok) passed, MAX(started_at) FILTER (w) last_at,
   ARG_MAX(ok, (started_at, id)) last_ok, BOOL_OR(alerted_at IS NOT NULL AND resolved_at IS NULL) alerting FROM (SELECT *, started_at >= {RUN_NOW-2000*H} w FROM monitor_runs) GROUP BY line HAVING COUNT(*) FILTER (w) > 0""")
def _a26(r):
    return M.monitor_lines(r, 2000, RUN_NOW)


@R.q("a26_monitor_findings", "monitor_runs", f"SELECT id, line, started_at FROM monitor_runs WHERE started_at >= {RUN_NOW-2000*H} AND NOT ok ORDER BY started_at DESC, id DESC LIMIT 12")
def _a26f(r):
    return M.monitor_findings(r, 2000, RUN_NOW).select("id", "line", "started_at")


@R.q("a26_monitor_totals", "monitor_runs", f"""SELECT COUNT(*) FILTER (w) runs, COUNT(*) FILTER (w AND ok) passed, MAX(started_at) FILTER (w) last_at, COUNT(*) FILTER (alerted_at IS NOT NULL AND resolved_at IS NULL) open_alerts
  FROM (SELECT *, started_at >= {RUN_NOW-2000*H} w FROM monitor_runs)""")
def _a26t(r):
    return M.monitor_totals(r, 2000, RUN_NOW)


@R.q("a27_qualifying_runs", "monitor_runs", "SELECT id, line, drift_sec FROM monitor_runs WHERE from_sec <= 120 AND drift_sec >= 180")
def _a27q(r):
    return M.qualifying_runs(_runs(r)).select("id", "line", F.col("worst.drift_sec").alias("drift_sec"))


@R.q("a27_emit_alerts", "monitor_runs", """WITH q AS (SELECT id, line, started_at t, {LDAY(started_at)} AS day, ROW_NUMBER() OVER (ORDER BY started_at, id) rn FROM monitor_runs WHERE from_sec <= 120 AND drift_sec >= 180),
  f AS (SELECT 0::BIGINT rn, NULL::DATE AS day, 0 sent, MAP{''::VARCHAR: 0::BIGINT} last, NULL::BIGINT hit
   UNION ALL SELECT q.rn, q.day, CASE WHEN q.day IS DISTINCT FROM f.day THEN 0 ELSE f.sent END + go, CASE WHEN go = 1 THEN map_concat(f.last, MAP{q.line: q.t}) ELSE f.last END, CASE WHEN go = 1 THEN q.id END
    FROM f JOIN q ON q.rn = f.rn + 1, LATERAL (SELECT CASE WHEN (q.day IS DISTINCT FROM f.day OR f.sent < 6) AND q.t - COALESCE(f.last[q.line], q.t - 21600000) >= 21600000 THEN 1 ELSE 0 END go) x)
  SELECT q.id, q.line, q.t received_at FROM f JOIN q ON q.id = f.hit""")
def _a27(r):
    return M.emit_alerts(_runs(r)).select("id", "line", "received_at")


ORACLE["a27_emit_alerts"] = "WITH RECURSIVE" + ORACLE["a27_emit_alerts"][4:]


@R.q("a28_resolve_alerts", "monitor_runs", """WITH r AS (SELECT line, ok FROM monitor_runs QUALIFY ROW_NUMBER() OVER (PARTITION BY line ORDER BY started_at DESC, id DESC) <= 2),
  c AS (SELECT line, COUNT(*) clean_runs FROM r GROUP BY line HAVING COUNT(*)=2 AND BOOL_AND(ok)), o AS (SELECT line, MAX(alerted_at) alerted_at FROM monitor_runs WHERE alerted_at IS NOT NULL AND resolved_at IS NULL GROUP BY line)
  SELECT line, alerted_at, clean_runs FROM o JOIN c USING (line)""")
def _a28(r):
    return M.resolve_alerts(r)


@R.q("p15_outside_reports", "reports operator_ids", "SELECT id, body FROM reports WHERE (anon_id IS NULL OR anon_id NOT IN (SELECT anon_id FROM operator_ids)) AND NOT starts_with(body,'[automated]') AND created_at >= 1704067200000")
def _p15(r, o):
    return M.outside_reports(r, o, 1_704_067_200_000).select("id", "body")


@R.q("a29_report_summary", "reports operator_ids", "SELECT COUNT(*) n, MAX(id) newest FROM reports WHERE (anon_id IS NULL OR anon_id NOT IN (SELECT anon_id FROM operator_ids)) AND NOT starts_with(body,'[automated]') AND created_at >= 1704067200000")
def _a29(r, o):
    return M.report_summary(r, o, 1_704_067_200_000)


@R.q("a29_triage_list", "reports", "SELECT id, priority, created_at FROM reports WHERE status='open' ORDER BY priority DESC, created_at DESC, id DESC")
def _a29t(r):
    return M.triage(r, "open").select("id", "priority", "created_at")


@R.q("p16_normalize_runs", "monitor_runs", """SELECT run_key, started_at, SUBSTR(line,1,120) line, ok, CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END nfail, from_sec, drift_sec FROM monitor_runs WHERE started_at > 0""")
def _p16(r):
    raw = _runs(r).withColumn("readings", F.lit(None).cast("long")).withColumn("failures", F.array(F.struct(
        F.when(F.col("id") % 3 != 0, "late").alias("kind"), F.lit("").alias("detail"))))
    n = M.normalize_runs(raw)
    return n.select("run_key", "started_at", "line", "ok", F.size("failures").alias("nfail"), F.col("jumps")[0]["from_sec"].alias("from_sec"), F.col("jumps")[0]["drift_sec"].alias("drift_sec"))


_DRIFT = """l AS (SELECT id, bus_id, to_stop_id, surface, predicted_at at_ms, FLOOR(predicted_sec/60)*60 lo, FLOOR(predicted_sec/60)*60+60 hi, predicted_sec FROM looks),
  p AS (SELECT *, LAG(at_ms) OVER w pa, LAG(lo) OVER w plo, LAG(hi) OVER w phi, LAG(at_ms + predicted_sec*1000) OVER w pinst FROM l WINDOW w AS (PARTITION BY bus_id, to_stop_id, surface ORDER BY at_ms, id))"""
_K3 = ["bus_id", "to_stop_id", "surface"]


@R.q("w14_conservative_drift", "looks", "WITH " + _DRIFT + """ SELECT id, CASE WHEN pa IS NULL THEN NULL WHEN lo > phi-(at_ms-pa)/1000e0 THEN lo-(phi-(at_ms-pa)/1000e0)
   WHEN hi < plo-(at_ms-pa)/1000e0 THEN hi-(plo-(at_ms-pa)/1000e0) ELSE 0 END drift_sec FROM p""")
def _w14(looks):
    d = looks.withColumn("at_ms", F.col("predicted_at")).withColumn("lo", F.floor(F.col("predicted_sec") / 60) * 60e0).withColumn("hi", F.col("lo") + 60)
    return M.conservative_drift(d, _K3).select("id", "drift_sec")


@R.q("w15_flap_runs", "looks", "WITH " + _DRIFT + """, m AS (SELECT *, (at_ms+predicted_sec*1000-pinst)/1000 mv FROM p WHERE pinst IS NOT NULL AND at_ms+predicted_sec*1000 <> pinst AND at_ms-pa <= 120000),
  q AS (SELECT *, LAG(at_ms) OVER w qa, LAG(mv) OVER w qm FROM m WINDOW w AS (PARTITION BY bus_id, to_stop_id, surface ORDER BY at_ms)),
  r AS (SELECT *, SUM(CASE WHEN qa IS NULL OR at_ms-qa > 120000 OR SIGN(mv)=SIGN(qm) THEN 1 ELSE 0 END) OVER (PARTITION BY bus_id, to_stop_id, surface ORDER BY at_ms) run FROM q)
  SELECT bus_id, to_stop_id, surface, MIN(at_ms) from_ms, MAX(at_ms) to_ms, COUNT(*) moves, MAX(ABS(mv)) worst_sec FROM r GROUP BY bus_id, to_stop_id, surface, run HAVING COUNT(*) >= 3""")
def _w15(looks):
    from fleetlens.operators import scan
    d = looks.withColumn("at_ms", F.col("predicted_at")).withColumn("inst", F.col("predicted_at") + F.col("predicted_sec") * 1000)
    d = scan.shifted(d, _K3, ["at_ms", "id"], {"pi": "inst", "pa": "at_ms"})
    d = d.where("pi IS NOT NULL AND at_ms - pa <= 120000").withColumn("move_sec", (F.col("inst") - F.col("pi")) / 1000).withColumn("eventful", F.lit(False))
    return M.flap_runs(d, _K3).drop("run")


@R.q("w16_roundtrips", "looks", "WITH " + _DRIFT + """, i AS (SELECT *, at_ms+predicted_sec*1000 inst FROM p), o AS (SELECT * FROM i WHERE ABS(inst-pinst) >= 180000 AND at_ms-pa <= 600000)
  SELECT o.bus_id, o.to_stop_id, o.surface, o.at_ms open_at, MIN(r.at_ms) return_at, ANY_VALUE((o.inst-o.pinst)/1000) excursion_sec FROM o JOIN i r ON r.bus_id=o.bus_id AND r.to_stop_id=o.to_stop_id AND r.surface=o.surface
   AND r.at_ms > o.at_ms AND r.at_ms - o.at_ms <= 600000 AND ABS(r.inst-o.pinst) <= 60000 GROUP BY ALL""")
def _w16(looks):
    d = looks.withColumn("at_ms", F.col("predicted_at")).withColumn("sec", F.col("predicted_sec")).withColumn("anchor", F.col("route_id"))
    return M.roundtrips(d, _K3)
