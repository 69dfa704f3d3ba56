"""Telemetry-shaped views over the star-schema tables, one SQL text for Spark and DuckDB.

Each view names the tables or views it reads. ``frame`` gives the Spark DataFrame; ``oracle``
prefixes a DuckDB query with the same views as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from fleetlens.session import prepare

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages "
        "benchmark labels conversations").split()

# Placeholders: {t.x} base table, {MS(expr)} epoch ms of a timestamp, {LDAY(ms)} {LHOUR(ms)} {LDOW(ms)}
# {LMIN(ms)} local calendar, {SEQ(n)} 0..n-1 unnested, {IDIV(a,b)} integer floor for non-negative a.
_SPARK = {
    "MS": r"unix_millis(CAST(\1 AS TIMESTAMP))",
    "LDAY": r"to_date(from_utc_timestamp(timestamp_millis(\1), 'America/New_York'))",
    "LHOUR": r"hour(from_utc_timestamp(timestamp_millis(\1), 'America/New_York'))",
    "LDOW": r"(dayofweek(from_utc_timestamp(timestamp_millis(\1), 'America/New_York'))-1)",
    "LMIN": r"(hour(from_utc_timestamp(timestamp_millis(\1), 'America/New_York'))*60 + minute(from_utc_timestamp(timestamp_millis(\1), 'America/New_York')))",
    "SEQ": r"explode(sequence(0, \1 - 1))",
    "INT": r"CAST(FLOOR(\1) AS BIGINT)",
    # Views that multiply their rows deal them out by a key first.
    "SPREAD": r"/*+ REPARTITION(\1) */",
}
_DUCK = {
    "MS": r"(epoch_us(\1)//1000)",
    "LDAY": r"CAST(timezone('America/New_York', make_timestamptz((\1)*1000)) AS DATE)",
    "LHOUR": r"hour(timezone('America/New_York', make_timestamptz((\1)*1000)))",
    "LDOW": r"dayofweek(timezone('America/New_York', make_timestamptz((\1)*1000)))",
    "LMIN": r"(hour(timezone('America/New_York', make_timestamptz((\1)*1000)))*60 + minute(timezone('America/New_York', make_timestamptz((\1)*1000))))",
    "SEQ": r"unnest(range(\1))",
    "INT": r"CAST(FLOOR(\1) AS BIGINT)",
    "SPREAD": "",
}


def _fill(sql: str, rules: dict[str, str], table) -> str:
    for name, rep in rules.items():
        sql = re.sub(r"\{" + name + r"\(([^{}]*)\)\}", rep, sql)
    return re.sub(r"\{t\.(\w+)\}", lambda m: table(m.group(1)), sql)


VIEWS: dict[str, tuple[list[str], str]] = {
    "stops": ([], """SELECT CAST(n_nationkey AS BIGINT) stop_id, n_name name,
        41.30e0 + (n_nationkey % 5)*0.004e0 lat, -72.95e0 + FLOOR(n_nationkey/5)*0.005e0 lon FROM {t.nation}"""),
    "route_stops": ([], """SELECT CAST(n_regionkey+1 AS BIGINT) route_id, CAST(n_nationkey AS BIGINT) stop_id,
        CAST(ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)-1 AS BIGINT) stop_index FROM {t.nation}"""),
    "ring": (["stops", "route_stops"], """SELECT r.route_id, r.stop_index, r.stop_id, s.lat, s.lon,
        CAST(COUNT(*) OVER (PARTITION BY r.route_id) AS BIGINT) ring_size FROM route_stops r JOIN stops s ON s.stop_id = r.stop_id"""),
    "ev": ([], """SELECT event_id, user_id bus_id, CONCAT('#', CAST(user_id AS STRING)) bus_name, user_id % 5 + 1 route_id,
        (event_id*7 + user_id) % 5 stop_index, {MS(ts)} at_ms, ts, event_type, value FROM {t.events}"""),
    "arrivals": (["ev", "route_stops"], """SELECT x.*, {LDOW(arrived_at)} dow, {LHOUR(arrived_at)} AS hour FROM (
        SELECT e.event_id id, e.bus_id, e.bus_name, e.route_id, r.stop_id, r.stop_index, e.at_ms arrived_at,
        CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE e.at_ms + {INT(LEAST(ABS(e.value),1800)*1000)} END departed_at,
        CASE WHEN e.event_id % 11 = 0 THEN NULL ELSE LEAST(ABS(e.value),1800) END dwell_sec
        FROM ev e JOIN route_stops r ON r.route_id = e.route_id AND r.stop_index = e.stop_index) x"""),
    "predictions": (["arrivals"], """SELECT id, bus_id, bus_name, route_id, stop_id to_stop_id, 1 + id % 12 stops_ahead,
        CAST((id*13 % 35)*60 AS DOUBLE) predicted_sec, CAST((id*13 % 35)*48 AS DOUBLE) predicted_low_sec,
        CAST((id*13 % 35)*75 AS DOUBLE) predicted_high_sec, arrived_at - (id % 50)*60000 predicted_at,
        CASE id % 4 WHEN 0 THEN 'trip' WHEN 1 THEN 'ride' WHEN 2 THEN 'card' ELSE 'upstream' END surface,
        CASE WHEN id % 6 = 0 THEN NULL ELSE CONCAT('b', CAST(id % 3 AS STRING)) END client_build FROM arrivals"""),
    # Repeated looks at one arrival: 6 readings a minute apart, the promise drifting.
    "looks": (["arrivals"], """SELECT id*6 + k id, bus_id, bus_name, route_id, stop_id to_stop_id,
        arrived_at - 20000 - (5-k)*60000 predicted_at,
        CAST(20 + (5-k)*60 + CASE WHEN (id + k) % 5 = 0 THEN 240 ELSE (id*k) % 90 END AS DOUBLE) predicted_sec,
        CAST((5-k)*40 AS DOUBLE) predicted_low_sec, CAST(120 + (5-k)*80 AS DOUBLE) predicted_high_sec,
        CASE id % 3 WHEN 0 THEN 'trip' WHEN 1 THEN 'ride' ELSE 'card' END surface,
        CAST(NULL AS STRING) client_build FROM (SELECT a.*, {SEQ(6)} k FROM (SELECT {SPREAD(id)} * FROM arrivals) a) x"""),
    "census": (["arrivals"], """SELECT id, arrived_at - 60000*(id % 40) sampled_at,
        CASE WHEN id % 5 = 0 THEN NULL ELSE arrived_at - 60000*(id % 40) - 7000 END calc_at, stop_id,
        CASE WHEN id % 17 = 0 THEN NULL ELSE route_id END route_id, CASE WHEN id % 13 = 0 THEN NULL ELSE bus_id END bus_id,
        CASE WHEN id % 13 = 0 THEN NULL ELSE bus_name END bus_name,
        CASE WHEN id % 13 = 0 THEN NULL ELSE CAST((id % 40)*60 AS BIGINT) END eta_sec FROM arrivals"""),
    "segments": (["arrivals"], """SELECT id, bus_id, bus_name, route_id, from_stop_id, stop_id to_stop_id,
        CAST(20 + id*37 % 900 AS DOUBLE) travel_sec, started_at, hops, {LDOW(started_at)} dow, {LHOUR(started_at)} AS hour
        FROM (SELECT a.*, LAG(stop_id) OVER w from_stop_id, LAG(arrived_at) OVER w started_at,
              (stop_index - LAG(stop_index) OVER w + 5) % 5 hops FROM arrivals a
              WINDOW w AS (PARTITION BY bus_id ORDER BY arrived_at, id)) x WHERE from_stop_id IS NOT NULL AND hops > 0"""),
    "stop_visits": (["arrivals"], """SELECT id, bus_id, bus_name, route_id, stop_id, stop_index, arrived_at-15000 anchored_at,
        CASE WHEN id % 7 = 0 THEN NULL ELSE arrived_at-5000 END pinned_at, arrived_at, departed_at,
        CASE WHEN id % 7 = 0 OR departed_at IS NULL THEN NULL ELSE (departed_at - arrived_at + 5000)/1000.0e0 END stand_sec,
        CASE id % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'unresolved' ELSE 'stopped' END outcome,
        CASE id % 3 WHEN 0 THEN 'far' WHEN 1 THEN 'next' ELSE NULL END how,
        CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(id % 30 AS DOUBLE) END confirm_sec,
        CASE WHEN id % 3 = 0 THEN NULL ELSE departed_at - 2000 END first_moved_at,
        CASE WHEN id % 9 = 0 THEN NULL ELSE arrived_at + 1000 END last_at_rest_at,
        id % 20 rest_polls, id % 4 shuffles, CAST(id*31 % 200 AS DOUBLE) closest_m, dow, hour FROM arrivals"""),
    "legs": (["stop_visits"], """SELECT id, bus_id, bus_name, route_id, from_stop_id, from_index, stop_id to_stop_id,
        stop_index to_index, (stop_index - from_index + 5) % 5 hops, departed_at, arrived_at, to_pinned_at,
        (arrived_at - departed_at)/1000.0e0 leg_sec, CAST(id % 60 AS DOUBLE) hold_sec,
        GREATEST((arrived_at - departed_at)/1000.0e0 - id % 60, 0) drive_sec, CAST(id % 4 AS BIGINT) holds
        FROM (SELECT v.id, v.bus_id, v.bus_name, v.route_id, v.stop_id, v.stop_index, v.arrived_at,
              LAG(stop_id) OVER w from_stop_id, LAG(stop_index) OVER w from_index, LAG(departed_at) OVER w departed_at,
              v.arrived_at - 5000 + 4000*(v.id % 3) to_pinned_at FROM stop_visits v
              WINDOW w AS (PARTITION BY bus_id ORDER BY arrived_at, id)) x
        WHERE departed_at IS NOT NULL AND arrived_at > departed_at AND (stop_index - from_index + 5) % 5 > 0"""),
    # Two-stop drives, 16 polls of 5 s: 4 at rest, 8 moving, 4 at rest at the next stop.
    "positions": (["ev", "ring"], """SELECT e.event_id*16 + e.k ingest_seq, e.bus_id, e.bus_name, e.route_id,
        CASE WHEN e.k < 4 THEN ala WHEN e.k < 12 THEN ala + (bla - ala)*(e.k-3)/9.0e0 ELSE bla END lat,
        CASE WHEN e.k < 4 THEN alo WHEN e.k < 12 THEN alo + (blo - alo)*(e.k-3)/9.0e0 ELSE blo END lon,
        CAST((e.event_id*47 + e.k*5) % 360 AS DOUBLE) heading,
        CASE WHEN e.k < 12 THEN aid ELSE bid END last_stop_id, e.at_ms - 30000 + e.k*5000 collected_at
        FROM (SELECT j.*, {SEQ(16)} k FROM (SELECT {SPREAD(event_id)} ev.*, a.lat ala, a.lon alo, a.stop_id aid, b.lat bla, b.lon blo, b.stop_id bid
            FROM ev JOIN ring a ON a.route_id = ev.route_id AND a.stop_index = ev.stop_index
            JOIN ring b ON b.route_id = ev.route_id AND b.stop_index = (ev.stop_index + 1) % 5) j) e"""),
    "daily_actives": (["ev"], """SELECT {LDAY(at_ms)} AS day, CONCAT('00000000-0000-4000-8000-', LPAD(CAST(bus_id AS STRING), 12, '0')) anon_id,
        MIN(at_ms) first_seen_ms, MAX(at_ms) last_seen_ms, COUNT(*) polls,
        CAST(SUM(CASE WHEN event_type='click' THEN 1 ELSE 0 END) AS BIGINT) searches FROM ev GROUP BY 1, 2"""),
    "excluded_ids": ([], """SELECT CONCAT('00000000-0000-4000-8000-', LPAD(CAST(s_suppkey AS STRING), 12, '0')) anon_id
        FROM {t.supplier} WHERE s_suppkey % 10 = 3"""),
    "search_terms": ([], """SELECT DATE '2024-01-01' + p_size % 30 AS day, q, CAST(SUM(p_size) AS BIGINT) n,
        CAST(SUM(CASE WHEN p_partkey % 3 = 0 OR q LIKE 'small%' THEN p_size ELSE 0 END) AS BIGINT) zero
        FROM (SELECT p.*, TRIM(CASE WHEN p_partkey % 4 = 0 THEN SUBSTR(LOWER(p_name), 1, CAST(4 + p_partkey % 7 AS INT))
              ELSE LOWER(p_name) END) q FROM {t.part} p) x GROUP BY 1, 2"""),
    "monitor_runs": ([], """SELECT o_orderkey id, CONCAT(CAST({MS(o_orderdate)} AS STRING), '-', CAST(o_orderkey AS STRING)) run_key,
        o_orderpriority line, {MS(o_orderdate)} + (o_orderkey*7919 % 86400)*1000 started_at, o_orderstatus <> 'F' ok,
        o_orderkey % 400 drift_sec, o_custkey % 240 from_sec, CAST(o_custkey % 45 AS DOUBLE) watched_min,
        CASE WHEN o_orderkey % 23 = 0 THEN {MS(o_orderdate)} + (o_orderkey*7919 % 86400)*1000 + 60000 END alerted_at,
        CASE WHEN o_orderkey % 46 = 0 THEN {MS(o_orderdate)} + 86400000 END resolved_at FROM {t.orders}"""),
    "reports": ([], """SELECT doc_id id, 1704067200000 + doc_id*600000 created_at, lang kind, doc_id % 5 + 1 route_id,
        CASE WHEN doc_id % 8 = 0 THEN CONCAT('[automated] ', text) ELSE text END body,
        CASE doc_id % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'triaged' ELSE 'closed' END status, doc_id % 4 priority,
        CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CONCAT('u', CAST(doc_id % 40 AS STRING)) END anon_id FROM {t.documents}"""),
    "operator_ids": ([], "SELECT CONCAT('u', CAST(s_suppkey AS STRING)) anon_id FROM {t.supplier} WHERE s_suppkey % 4 = 1"),
    "segment_times": (["segments"], """SELECT id, bus_id, bus_name, route_id, from_stop_id, to_stop_id,
        travel_sec travel_seconds, hops, dow day_of_week, hour, started_at + {INT(travel_sec*1000)} recorded_at FROM segments"""),
    "gps_dwells": (["arrivals"], """SELECT id, bus_id, bus_name, route_id, stop_id, dwell_sec dwell_seconds, arrived_at entered_at,
        departed_at left_at, dow day_of_week FROM arrivals WHERE dwell_sec IS NOT NULL"""),
    "pairs": ([], """SELECT l_orderkey*10 + l_linenumber pair_id, l_suppkey % 5 + 1 r, l_quantity*36 eta, l_quantity*27 low, l_quantity*45 high,
        CASE WHEN l_partkey % 19 = 0 THEN NULL ELSE ROUND(l_quantity*36*(0.7e0 + l_discount*6), 3) END det,
        CASE WHEN l_partkey % 23 = 0 THEN NULL ELSE ROUND(l_quantity*36*(0.7e0 + l_tax*7.5e0), 3) END prox,
        CAST(l_shipdate AS DATE) AS day, l_returnflag arm FROM {t.lineitem}"""),
    "waits": ([], """SELECT o_orderkey rider_id, CASE o_orderkey % 6 WHEN 0 THEN 'gave_up' WHEN 1 THEN 'missed' ELSE 'boarded' END outcome,
        CAST(o_custkey % 600 AS DOUBLE) - 200 first_miss_sec, o_orderkey % 3 = 0 interval_held, o_orderkey % 7 = 0 jumped,
        o_orderkey % 9 = 0 reversed, o_orderkey % 11 = 0 stranded, CAST(o_orderkey*17 % 900 AS DOUBLE) worst_drift_sec,
        o_orderpriority line FROM {t.orders}"""),
    "requests": ([], """SELECT c_custkey request_id, 41.30e0 + (c_nationkey % 5)*0.004e0 + (c_custkey % 7)*0.0006e0 from_lat,
        -72.95e0 + FLOOR(c_nationkey/5)*0.005e0 + (c_custkey % 11)*0.0004e0 from_lon,
        41.30e0 + ((c_nationkey*7 + c_custkey) % 5)*0.004e0 to_lat, -72.95e0 + ((c_nationkey*3 + c_custkey) % 5)*0.005e0 to_lon
        FROM {t.customer}"""),
}


def _needed(names: list[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str) -> None:
        for d in VIEWS[n][0]:
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def spark_sql(sf_dir: str, name: str) -> str:
    table = lambda t: f"parquet.`{sf_dir}/{t}.parquet`"
    order = _needed([name])
    ctes = ", ".join(f"{n} AS ({_fill(VIEWS[n][1], _SPARK, table)})" for n in order)
    return f"WITH {ctes} SELECT * FROM {name}"


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A rehearsal view, or a base table by its name."""
    prepare(spark)
    if name in VIEWS:
        return spark.sql(spark_sql(sf_dir, name))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [frame(spark, sf_dir, n) for n in names]


def oracle(names: str | list[str], body: str) -> str:
    """DuckDB text: the named views as CTEs, then ``body`` (which may start with more CTEs)."""
    names = names.split() if isinstance(names, str) else names
    views = [n for n in _needed([n for n in names if n in VIEWS])]
    ctes = ", ".join(f"{n} AS ({_fill(VIEWS[n][1], _DUCK, lambda t: t)})" for n in views)
    body = _fill(body.strip(), _DUCK, lambda t: t)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}" if ctes else body
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body
