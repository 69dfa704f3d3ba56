"""Registered source, sanitising and table-maintenance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import clock
from fleetlens.functions import exprs as E
from fleetlens.operators import grain as G
from fleetlens.operators import scoring as S
from fleetlens.plans.reg import NOW, Registry, rounded
from fleetlens.sources import feeds, tables as T

R = Registry()
QUERIES, ORACLE = R.queries, R.oracles
D = 86_400_000


def _dirty(p):
    """Positions with planted bad and repeated fixes."""
    bad = p.withColumn("lat", F.when(F.col("ingest_seq") % 97 == 0, F.lit(0.0)).when(F.col("ingest_seq") % 89 == 0, F.lit(95.0)).otherwise(F.col("lat"))) \
        .withColumn("lon", F.when(F.col("ingest_seq") % 97 == 0, F.lit(0.0)).otherwise(F.col("lon")))
    twice = p.where("ingest_seq % 5 = 0").withColumn("ingest_seq", F.col("ingest_seq") + 1_000_000_000).withColumn("heading", F.lit(None).cast("double"))
    return bad.unionByName(twice)


_DIRTY = """d AS (SELECT bus_id, collected_at, ingest_seq, CASE WHEN ingest_seq%97=0 THEN 0e0 WHEN ingest_seq%89=0 THEN 95e0 ELSE lat END lat, CASE WHEN ingest_seq%97=0 THEN 0e0 ELSE lon END lon, heading FROM positions
  UNION ALL SELECT bus_id, collected_at, ingest_seq+1000000000, lat, lon, NULL FROM positions WHERE ingest_seq%5=0)"""


@R.q("p1_sanitize_positions", "positions", f"WITH {_DIRTY} SELECT bus_id, collected_at, ingest_seq, COALESCE(heading,0) heading FROM d WHERE ABS(lat)<=90 AND NOT (lat=0 AND lon=0) QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id, collected_at ORDER BY ingest_seq DESC)=1")
def _p1(p):
    return feeds.sanitize_positions(_dirty(p)).select("bus_id", "collected_at", "ingest_seq", "heading")


@R.q("s1_coerce_wire", "positions", "SELECT bus_id, collected_at, CASE WHEN ingest_seq%7=0 THEN NULL ELSE lat END lat FROM positions")
def _s1(p):
    wire = p.select(*[F.col(c).cast("string").alias(c) for c in p.columns]).withColumn(
        "lat", F.when(F.col("ingest_seq").cast("long") % 7 == 0, F.lit("n/a")).otherwise(F.col("lat")))
    return feeds.coerce(wire, feeds.POSITION).select("bus_id", "collected_at", "lat")


@R.q("s2_route_stops", "route_stops stops", """SELECT route_id, stop_index, stop_id, COUNT(*) OVER (PARTITION BY route_id) ring_size, lat FROM route_stops JOIN stops USING (stop_id)""")
def _s2(rs, stops):
    j = rs.join(stops, "stop_id").groupBy("route_id").agg(F.array_sort(F.collect_list(F.struct("stop_index", "stop_id", "lat", "lon"))).alias("s"))
    raw = j.select(F.col("route_id").cast("string").alias("id"), F.lit("").alias("name"), F.lit("").alias("short_name"), F.lit("").alias("color"),
                   F.transform("s", lambda x: x["stop_id"].cast("string")).alias("stops"),
                   F.flatten(F.transform("s", lambda x: F.array(x["lat"], x["lon"]))).alias("path"), F.lit("0").alias("updated_at"))
    r = feeds.routes_from(raw)
    lat = r.select("route_id", F.posexplode("path").alias("stop_index", "p")).select("route_id", F.col("stop_index").cast("long").alias("stop_index"), F.col("p.lat").alias("lat"))
    return feeds.explode_route_stops(r).join(lat, ["route_id", "stop_index"])


@R.q("s3_explode_census", "census", "SELECT id sampled_at, stop_id, CASE WHEN id%13<>0 THEN route_id END route_id, CASE WHEN id%13<>0 THEN CAST(eta_sec AS INT) END eta_sec, CASE WHEN id%13<>0 THEN '{\"load\":\"' || CAST(id%3 AS VARCHAR) || '\"}' END raw FROM census")
def _s3(c):
    s = lambda x: F.col(x).cast("string")
    m = F.map_filter(F.create_map(F.lit("route_id"), s("route_id"), F.lit("bus_id"), s("bus_id"), F.lit("eta_sec"), s("eta_sec"),
                                  F.lit("load"), (F.col("id") % 3).cast("string")), lambda k, v: v.isNotNull())
    etas = F.when(F.col("id") % 13 == 0, F.array().cast("array<map<string,string>>")).otherwise(F.array(m))
    wire = c.select(F.col("id").alias("sampled_at"), "stop_id", F.lit(0).alias("probe"), etas.alias("etas"))
    return feeds.explode_census(wire).select("sampled_at", "stop_id", "route_id", "eta_sec", "raw")


@R.q("s5_merge_captures", "positions", """WITH a AS (SELECT bus_id, collected_at, lat, 0 src FROM positions WHERE ingest_seq%3<>0 UNION ALL SELECT bus_id, collected_at, lat+1, 1 FROM positions WHERE ingest_seq%2=0)
  SELECT bus_id, collected_at, lat FROM a WHERE {LDAY(collected_at)} = DATE '2024-01-10' QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id, collected_at ORDER BY src)=1""")
def _s5(p):
    a = p.where("ingest_seq % 3 <> 0")
    b = p.where("ingest_seq % 2 = 0").withColumn("lat", F.col("lat") + 1).drop("heading")
    return feeds.merge_captures(a, b, "2024-01-10").select("bus_id", "collected_at", "lat")


@R.q("s7_insert_ignore", "predictions", """WITH b AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY bus_id, to_stop_id, predicted_at//3600000, surface ORDER BY id) rn FROM predictions WHERE id%4<>0),
  n AS (SELECT id, bus_id, to_stop_id, predicted_at//3600000 h, surface FROM b WHERE rn=1) SELECT id FROM n WHERE NOT EXISTS (SELECT 1 FROM predictions e WHERE e.id%4=0 AND e.bus_id=n.bus_id AND e.to_stop_id=n.to_stop_id AND e.predicted_at//3600000=n.h AND e.surface=n.surface)""")
def _s7(p):
    p = p.withColumn("h", F.floor(F.col("predicted_at") / 3_600_000))
    return T.insert_ignore(p.where("id % 4 <> 0"), p.where("id % 4 = 0"), ["bus_id", "to_stop_id", "h", "surface"], [F.col("id")]).select("id")


@R.q("s7_insert_counts", "predictions", """WITH n AS (SELECT DISTINCT bus_id, to_stop_id FROM predictions WHERE id%4<>0), e AS (SELECT DISTINCT bus_id, to_stop_id FROM predictions WHERE id%4=0)
  , s AS (SELECT COUNT(*) stored FROM n ANTI JOIN e USING (bus_id, to_stop_id)) SELECT stored, (SELECT COUNT(*) FROM predictions WHERE id%4<>0)-stored duplicate FROM s""")
def _s7c(p):
    return T.insert_counts(p.where("id % 4 <> 0"), p.where("id % 4 = 0"), ["bus_id", "to_stop_id"])


@R.q("s8_merge_accumulate", "daily_actives", """SELECT day, anon_id, CAST(SUM(polls) AS BIGINT) polls, MIN(f) first_seen_ms, MAX(last_seen_ms) last_seen_ms FROM
  (SELECT *, first_seen_ms f FROM daily_actives UNION ALL SELECT *, NULL FROM daily_actives WHERE polls > 1) GROUP BY ALL""")
def _s8(a):
    d = a.where("polls > 1").withColumn("first_seen_ms", F.lit(None).cast("long"))
    return T.merge_accumulate(a, d, ["day", "anon_id"], ["polls"], ["first_seen_ms"], ["last_seen_ms"])


@R.q("s9_latest_rows", "arrivals", "SELECT bus_id, id, arrived_at FROM arrivals QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id ORDER BY arrived_at DESC)=1")
def _s9(a):
    return T.latest_rows(a, ["bus_id"], "arrived_at").select("bus_id", "id", "arrived_at")


@R.q("s11_trim_age", "arrivals", f"SELECT id FROM arrivals WHERE arrived_at >= {NOW-9*D}")
def _s11(a):
    return T.trim_age(a, "arrived_at", 9 * D, NOW).select("id")


@R.q("s12_trim_newest", "census", "SELECT id FROM census WHERE sampled_at >= (SELECT MIN(sampled_at) FROM (SELECT sampled_at FROM census ORDER BY sampled_at DESC LIMIT 700))")
def _s12(c):
    return T.trim_newest(c, "sampled_at", 700).select("id")


@R.q("s13_replacement_check", "arrivals", "SELECT id, CASE WHEN id%50=0 THEN 'lost' ELSE 'altered' END violation FROM arrivals WHERE id%50=0 OR (id%31=0 AND dwell_sec IS NOT NULL)")
def _s13(a):
    prior = a.select("id", "bus_id", "arrived_at", "dwell_sec")
    nxt = prior.where("id % 50 <> 0").withColumn("dwell_sec", F.when(F.col("id") % 31 == 0, F.col("dwell_sec") + 1).otherwise(F.col("dwell_sec")))
    return T.replacement_check(prior, nxt, ["id"])


@R.q("s14_assemble_replay", "arrivals", "SELECT bus_id, h, MIN(CASE WHEN id%3=0 THEN id END) base_id, COUNT(DISTINCT bus_id) k FROM (SELECT *, arrived_at//3600000 h FROM arrivals) GROUP BY bus_id, h")
def _s14(a):
    a = a.withColumn("h", F.floor(F.col("arrived_at") / 3_600_000))
    one = a.groupBy("bus_id", "h").agg(F.min(F.when(F.col("id") % 3 == 0, F.col("id"))).alias("base_id"))
    base = one.where("base_id IS NOT NULL")
    return feeds.assemble_replay(base, [one], ["bus_id", "h"]).withColumn("k", F.lit(1).cast("long"))


@R.q("s15_input_receipt", "arrivals segments legs", """SELECT 'arrivals' table_name, COUNT(*) AS rows, MAX(arrived_at) watermark FROM arrivals UNION ALL SELECT 'segments', COUNT(*), MAX(started_at) FROM segments UNION ALL SELECT 'legs', COUNT(*), MAX(departed_at) FROM legs""")
def _s15(a, s, l):
    return T.input_receipt({"arrivals": (a, "arrived_at"), "segments": (s, "started_at"), "legs": (l, "departed_at")})


@R.q("s16_export_day", "arrivals", "SELECT id, arrived_at FROM arrivals WHERE {LDAY(arrived_at)} = DATE '2024-01-12'")
def _s16(a):
    return T.export_day(a, "2024-01-12", "arrived_at", ["arrived_at", "id"]).select("id", "arrived_at")


@R.q("f5_local_days", "arrivals", """SELECT {LDAY(arrived_at)} AS day, COUNT(*) n, MIN({LHOUR(arrived_at)}) h, epoch_us(timezone('America/New_York', CAST({LDAY(arrived_at)} AS TIMESTAMP)))//1000 start_ms FROM arrivals GROUP BY ALL""")
def _f5(a):
    d = a.withColumn("day", clock.local_day("arrived_at")).groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min(clock.local_hour("arrived_at")).cast("long").alias("h"))
    return d.withColumn("start_ms", clock.day_start_ms("day"))


@R.q("p2_p11_p12_buckets", "looks", """SELECT id, LTRIM(bus_name,'#') bus, CASE WHEN predicted_sec>1800 THEN NULL WHEN predicted_sec<120 THEN '0-2' WHEN predicted_sec<300 THEN '2-5' WHEN predicted_sec<600 THEN '5-10' ELSE '10-30' END h,
   CASE WHEN predicted_sec<180 THEN '0-3m' WHEN predicted_sec<360 THEN '3-6m' WHEN predicted_sec<600 THEN '6-10m' WHEN predicted_sec<900 THEN '10-15m' END v1, CASE WHEN id%14=0 THEN '1' WHEN id%14>=10 THEN '10+' ELSE CAST(id%14 AS VARCHAR) END a2,
   CASE WHEN id%14>10 THEN '10+' WHEN id%14>0 THEN CAST(id%14 AS VARCHAR) END a1 FROM looks""")
def _p11(p):
    n = F.col("id") % 14
    return p.select("id", E.norm_bus_name("bus_name").alias("bus"), E.horizon("predicted_sec").alias("h"), E.v1_bucket("predicted_sec")["bucket"].alias("v1"),
                    E.ahead_bucket(n).alias("a2"), E.ahead_bucket(n, v2=False).alias("a1"))


@R.q("p3_admit_readings", "looks arrivals route_stops", """WITH f AS (SELECT LTRIM(bus_name,'#') b, bus_id, route_id FROM arrivals QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id ORDER BY arrived_at DESC)=1),
  r AS (SELECT id, LTRIM(bus_name,'#') b, to_stop_id stop_id, predicted_sec, predicted_low_sec lo, predicted_high_sec hi, id%210 sa, surface, (id%140)*1000 age, predicted_at + 5000 now_ms FROM looks)
  SELECT bus_id, stop_id to_stop_id, (now_ms-age)//15000*15000 predicted_at, surface, predicted_sec FROM r JOIN f USING (b) SEMI JOIN route_stops rs ON rs.route_id=f.route_id AND rs.stop_id=r.stop_id
  WHERE age <= 120000 AND predicted_sec BETWEEN 0 AND 7200 AND lo >= 0 AND hi >= lo AND hi <= 14400 AND sa BETWEEN 1 AND 200 QUALIFY ROW_NUMBER() OVER (PARTITION BY bus_id, stop_id, (now_ms-age)//15000, surface ORDER BY id)=1""")
def _p3(looks, a, rs):
    fleet = G.latest_by(a, ["bus_id"], "arrived_at").select("bus_id", "bus_name", "route_id", F.lit(None).cast("long").alias("last_stop_id"))
    r = looks.select("bus_name", F.col("to_stop_id").alias("stop_id"), F.col("predicted_sec").alias("eta_sec"), F.col("predicted_low_sec").alias("low_sec"),
                     F.col("predicted_high_sec").alias("high_sec"), (F.col("id") % 210).alias("stops_ahead"), "surface", ((F.col("id") % 140) * 1000).alias("age_ms"),
                     (F.col("predicted_at") + 5000).alias("now_ms"), F.col("id").alias("seq"), "client_build")
    return S.admit_readings(r, fleet, rs).select("bus_id", "to_stop_id", "predicted_at", "surface", "predicted_sec")


@R.q("p8_annotate_visits", "stop_visits", """SELECT id, CAST(outcome='passed' AS INT) + CAST(outcome='unresolved' AS INT) + CAST(pinned_at IS NULL AS INT) + CAST(departed_at IS NULL AS INT) + COALESCE(CAST(departed_at < pinned_at AS INT),0) + COALESCE(CAST(stand_sec<0 AS INT),0) notes,
   outcome='stopped' AND departed_at IS NOT NULL AND departed_at >= anchored_at AND COALESCE(how,'')<>'gap' AND COALESCE(departed_at >= pinned_at, TRUE) usable FROM stop_visits""")
def _p8(v):
    from fleetlens.operators.passes import annotate_visits
    return annotate_visits(v).select("id", F.size("quality_notes").alias("notes"), "usable")


@R.q("o1_top_n", "arrivals", "SELECT stop_id, id FROM arrivals QUALIFY ROW_NUMBER() OVER (PARTITION BY stop_id ORDER BY arrived_at DESC, id)<=3")
def _o1(a):
    return G.top_n(a, ["stop_id"], [F.col("arrived_at").desc(), F.col("id")], 3).select("stop_id", "id")


@R.q("x2_x3_union_distinct", "arrivals segments", "SELECT route_id, stop_id FROM arrivals UNION SELECT route_id, from_stop_id FROM segments")
def _x23(a, s):
    return G.union_all(a.select("route_id", "stop_id"), s.select("route_id", F.col("from_stop_id").alias("stop_id"))).distinct()


@R.q("a31_read_scorecard", "predictions arrivals", """WITH d AS (SELECT {LDAY(predicted_at)} AS day, route_id, CASE WHEN id%9=0 THEN NULL ELSE COUNT(*) OVER (PARTITION BY id) END n, id, predicted_at t FROM predictions)
  SELECT day, route_id, id horizon, MIN(t) OVER (PARTITION BY day) day_scored_through, CASE WHEN id%9=0 OR id%10=0 THEN 0::BIGINT ELSE 1::BIGINT END n FROM d WHERE day > DATE '2024-01-30' - 7""")
def _a31(p, a):
    m = F.when(F.col("id") % 9 == 0, F.lit(None).cast("string")).when(F.col("id") % 10 == 0, F.lit("{broken")).otherwise(F.lit('{"n":1,"paired":1,"median_abs_sec":2.5}'))
    d = p.select(clock.local_day("predicted_at").alias("day"), "route_id", F.col("id").alias("horizon"), "surface", m.alias("metrics"),
                 F.col("predicted_at").alias("scored_through"), F.lit(False).alias("final"))
    return S.read_scorecard(d, 7, "2024-01-30").select("day", "route_id", "horizon", "day_scored_through", "n")
