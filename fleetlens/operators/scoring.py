"""Prediction scoring: admission, truth, daily scorecard, paired and shared comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fleetlens.functions import clock
from fleetlens.functions import exprs as E
from fleetlens.functions.quantiles import grouped_quantiles
from fleetlens.operators.asof import MATCH_2H_MS, asof_next, truth_join, v1_next_arrival
from fleetlens.operators.grain import top_n
from fleetlens.session import materialize

BUCKET_MS = 15_000
MAX_AGE_MS = 120_000
MAX_ETA_SEC = 7200
JUMP_SEC = 180
JUMP_GAP_MS = 300_000
STRAND_SEC = 180
STRAND_WINDOW_MS = 90_000
MIN_COMPARE_PAIRS = 50


def admit_readings(readings: DataFrame, fleet: DataFrame, route_stops: DataFrame) -> DataFrame:
    """Reported readings that may be logged (P3), one row per (bus, stop, bucket, surface).

    ``readings``: bus_name, stop_id, eta_sec, low_sec, high_sec, stops_ahead, surface, age_ms, now_ms,
    seq, client_build. ``fleet``: bus_id, bus_name, route_id, last_stop_id. The first writer wins.
    """
    live = fleet.select(
        E.norm_bus_name("bus_name").alias("_bus"), "bus_id", F.col("bus_name").alias("fleet_name"), "route_id", "last_stop_id"
    )
    r = readings.where(
        F.col("age_ms").between(0, MAX_AGE_MS)
        & F.col("eta_sec").between(0, MAX_ETA_SEC) & ~F.isnan("eta_sec")
        & (F.col("low_sec") >= 0) & (F.col("high_sec") >= F.col("low_sec")) & (F.col("high_sec") <= MAX_ETA_SEC * 2)
        & F.col("stops_ahead").between(1, 200)
        & F.col("surface").isin(*E.SHOWN_SURFACES, *E.TRIAL_SURFACES)
    ).withColumn("_bus", E.norm_bus_name("bus_name"))
    on_route = route_stops.select("route_id", "stop_id").distinct()
    r = r.join(live, "_bus").join(on_route, ["route_id", "stop_id"], "left_semi")
    r = r.withColumn("predicted_at", F.floor((F.col("now_ms") - F.col("age_ms")) / BUCKET_MS) * BUCKET_MS)
    keys = ["bus_id", "stop_id", "predicted_at", "surface"]
    out = top_n(r, keys, [F.col("seq").asc()], 1).drop("rank", "_bus")
    return out.select(
        "bus_id", F.col("fleet_name").alias("bus_name"), "route_id",
        F.coalesce("last_stop_id", F.lit(-1)).alias("from_stop_id"), F.col("stop_id").alias("to_stop_id"), "stops_ahead",
        F.col("eta_sec").alias("predicted_sec"), F.col("low_sec").alias("predicted_low_sec"),
        F.col("high_sec").alias("predicted_high_sec"), "predicted_at", "client_build", "surface",
    )


def rider_rows(df: DataFrame) -> DataFrame:
    return df.where(E.is_rider_surface("surface"))


def scoreable(preds: DataFrame, census: DataFrame | None = None) -> DataFrame:
    """Logged and official promises in one shape, with the day and order they are scored in."""
    p = preds.where(F.col("surface").isin(*E.SHOWN_SURFACES, E.UPSTREAM)).select(
        clock.local_day("predicted_at").alias("day"), E.norm_bus_name("bus_name").alias("bus"), "route_id",
        F.col("to_stop_id").alias("stop_id"), F.col("predicted_at").alias("at"), F.col("predicted_at").alias("ord"),
        F.col("id").alias("ord_id"), F.col("predicted_sec").alias("sec"), F.col("predicted_low_sec").alias("low"),
        F.col("predicted_high_sec").alias("high"), "surface", F.col("client_build").alias("build"),
    )
    if census is None:
        return p
    sec = F.col("eta_sec").cast("double")
    c = census.where(F.col("bus_name").isNotNull() & F.col("route_id").isNotNull() & F.col("eta_sec").isNotNull()).select(
        clock.local_day("sampled_at").alias("day"), E.norm_bus_name("bus_name").alias("bus"), "route_id", "stop_id",
        F.coalesce("calc_at", "sampled_at").alias("at"), F.col("sampled_at").alias("ord"), F.col("id").alias("ord_id"),
        sec.alias("sec"), sec.alias("low"), sec.alias("high"), F.lit(E.CENSUS).alias("surface"),
        F.lit(None).cast("string").alias("build"),
    )
    return p.unionByName(c)


def truth_visits(visits: DataFrame) -> DataFrame:
    tie = F.col("id") if "id" in visits.columns else F.xxhash64("arrived_at", "departed_at")
    return visits.select(E.norm_bus_name("bus_name").alias("bus"), "route_id", "stop_id", "arrived_at", "departed_at", tie.cast("long").alias("visit_id"))


def score_rows(rows: DataFrame, visits: DataFrame) -> DataFrame:
    """Each promise with its horizon, truth kind, error (promise - actual) and interval flags."""
    j = truth_join(rows, truth_visits(visits), ["bus", "route_id", "stop_id"], at="at", tie="visit_id")
    h = E.horizon("sec")
    kind = F.when(h.isNull(), "beyond").otherwise(F.col("truth"))
    j = j.withColumn("horizon", h).withColumn("kind", kind).withColumn(
        "actual_at", F.when(F.col("kind") == "arrived", F.col("actual_at"))
    )
    actual = (F.col("actual_at") - F.col("at")) / 1000
    has_iv = (F.col("kind") == "arrived") & (F.col("high") > F.col("low"))
    return (
        j.withColumn("actual_sec", actual)
        .withColumn("err", F.col("sec") - F.col("actual_sec"))
        .withColumn("has_iv", has_iv)
        .withColumn("covered", has_iv & F.col("actual_sec").between(F.col("low"), F.col("high")))
        .drop("truth")
    )


def wait_islands(scored: DataFrame) -> DataFrame:
    """Mark jumps between consecutive looks and the look that closes each wait.

    A (day, surface, bus, stop) sequence holds at most one row per 15 s bucket, so its window is
    bounded by the length of a day.
    """
    w = Window.partitionBy("day", "surface", "bus", "stop_id").orderBy("ord", "ord_id")
    prev = F.lag(F.struct("kind", "actual_at", "at", "sec")).over(w)
    d = scored.withColumn("_p", prev)
    cont = (F.col("kind") == "arrived") & (F.col("_p.kind") == "arrived") & (F.col("_p.actual_at") == F.col("actual_at"))
    d = d.withColumn("_cont", F.coalesce(cont, F.lit(False))).withColumn("_next_cont", F.lead("_cont").over(w))
    pair = F.col("_cont") & (F.col("at") - F.col("_p.at") <= JUMP_GAP_MS)
    moved = F.abs((F.col("at") + F.col("sec") * 1000) - (F.col("_p.at") + F.col("_p.sec") * 1000)) / 1000
    closes = (F.col("kind") == "arrived") & ~F.coalesce("_next_cont", F.lit(False))
    wait = closes & (F.col("actual_at") - F.col("at") <= STRAND_WINDOW_MS)
    return (
        d.withColumn("jump_pair", pair)
        .withColumn("jump", pair & (moved >= JUMP_SEC))
        .withColumn("jump_horizon", F.when(pair, E.horizon(F.col("_p.sec"))))
        .withColumn("wait", wait)
        .withColumn("strand", wait & (F.col("sec") >= STRAND_SEC))
        .drop("_p", "_cont", "_next_cont")
    )


def _n(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0))


_COUNTS = ["n", "beyond", "standing", "missing", "paired", "within120", "pess120", "opt120",
           "interval_rows", "covered", "waits", "strands", "jump_pairs", "jumps"]


def _fan(df: DataFrame) -> DataFrame:
    """A base cell belongs to its route and all routes (0), its horizon and all, its surface and ours."""
    return (
        df.withColumn("route_id", F.explode(F.array(F.col("route_id"), F.lit(0).cast("long"))))
        .withColumn("horizon", F.explode(F.when(F.col("horizon").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.col("horizon"), F.lit("all")))))
        .withColumn(
            "surface",
            F.explode(
                F.when(F.col("surface").isin(*E.SHOWN_SURFACES), F.array(F.col("surface"), F.lit("ours")))
                .otherwise(F.array(F.col("surface")))
            ),
        )
    )


CELL = ["day", "route_id", "horizon", "surface"]


def scorecard(preds: DataFrame, visits: DataFrame, census: DataFrame | None = None) -> DataFrame:
    """Daily cells of counts, errors, interval coverage, waits and jumps."""
    return scorecard_from(wait_islands(score_rows(scoreable(preds, census), visits)))


def scorecard_from(s: DataFrame) -> DataFrame:
    arrived = F.col("kind") == "arrived"
    # One pass over the scored rows: every count per (cell, jump horizon, error value). Both the
    # counts and the order statistics below read this one table.
    f = materialize(s.groupBy("day", "route_id", "horizon", "jump_horizon", "surface", "err").agg(
        F.count(F.lit(1)).alias("n"), _n(F.col("kind") == "beyond").alias("beyond"),
        _n(F.col("kind") == "standing").alias("standing"), _n(F.col("kind") == "missing").alias("missing"),
        _n(arrived).alias("paired"), _n(arrived & (F.abs("err") <= 120)).alias("within120"),
        _n(arrived & (F.col("err") >= 120)).alias("pess120"), _n(arrived & (F.col("err") <= -120)).alias("opt120"),
        _n(F.col("has_iv")).alias("interval_rows"), _n(F.col("covered")).alias("covered"),
        _n(F.col("wait")).alias("waits"), _n(F.col("strand")).alias("strands"),
        _n(F.col("jump_pair")).alias("jump_pairs"), _n(F.col("jump")).alias("jumps"),
    ))
    cell = f.groupBy("day", "route_id", "horizon", "jump_horizon", "surface").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    # Waits count only in the pooled horizon, jumps in the horizon the rider was looking at.
    zero = F.lit(0).cast("long")
    wait_cols, jump_cols = ("waits", "strands"), ("jump_pairs", "jumps")
    parts = F.array(
        F.struct(F.col("horizon").alias("h"), *[(zero if c in wait_cols + jump_cols else F.col(c)).alias(c) for c in _COUNTS]),
        F.struct(F.lit(None).cast("string").alias("h"), *[(F.col(c) if c in wait_cols else zero).alias(c) for c in _COUNTS]),
        F.struct(F.col("jump_horizon").alias("h"), *[(F.col(c) if c in jump_cols else zero).alias(c) for c in _COUNTS]),
    )
    small = cell.withColumn("x", F.explode(parts)).select("day", "route_id", F.col("x.h").alias("horizon"), "surface",
                                                          *[F.col(f"x.{c}").alias(c) for c in _COUNTS])
    cells = _fan(small).groupBy(*CELL).agg(*[F.sum(c).alias(c) for c in _COUNTS]).where(F.col("n") > 0)
    errs = _fan(f.where(F.col("paired") > 0).select(*CELL, "err", F.col("n").alias("c"))).withColumn(
        "_m", F.explode(F.array(F.struct(F.lit("signed").alias("k"), F.col("err").alias("v")),
                                F.struct(F.lit("abs").alias("k"), F.abs("err").alias("v"))))
    ).select(*CELL, F.col("_m.k").alias("metric"), F.col("_m.v").alias("v"), "c")
    q = grouped_quantiles(errs, [*CELL, "metric"], "v", {"p50": (0.5, "floor"), "p90": (0.9, "floor")}, weight="c")
    q = q.groupBy(*CELL).agg(
        F.max(F.when(F.col("metric") == "signed", E.round1("p50"))).alias("median_signed_sec"),
        F.max(F.when(F.col("metric") == "abs", E.round1("p50"))).alias("median_abs_sec"),
        F.max(F.when(F.col("metric") == "abs", E.round1("p90"))).alias("p90_abs_sec"),
    )
    return cells.join(q, CELL, "left").select(
        *CELL, "n", "beyond", "standing", "missing", "paired", "median_signed_sec", "median_abs_sec", "p90_abs_sec",
        E.pct1("within120", "paired").alias("within120_pct"), E.pct1("pess120", "paired").alias("pess120_pct"),
        E.pct1("opt120", "paired").alias("opt120_pct"), "interval_rows",
        E.pct1("covered", "interval_rows").alias("interval_coverage_pct"), "waits", "strands", "jump_pairs", "jumps",
    )


def scorecard_builds(preds: DataFrame) -> DataFrame:
    """Readings per client build in each rider cell (the scorecard's builds map, in rows)."""
    r = scoreable(preds).where(F.col("build").isNotNull() & F.col("surface").isin(*E.SHOWN_SURFACES))
    r = r.withColumn("horizon", E.horizon("sec")).groupBy(*CELL, "build").agg(F.count(F.lit(1)).alias("c"))
    return _fan(r).groupBy(*CELL, "build").agg(F.sum("c").alias("n"))


def with_builds(cells: DataFrame, builds: DataFrame) -> DataFrame:
    """Attach builds as a map, most used first."""
    order = F.array_sort(
        F.collect_list(F.struct("n", "build")),
        lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["build"] < b["build"], -1).otherwise(1),
    )
    m = builds.groupBy(*CELL).agg(
        F.map_from_entries(F.transform(order, lambda e: F.struct(e["build"], e["n"]))).alias("builds")
    )
    return cells.join(m, CELL, "left")


METRICS_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n", "paired", "waits", "jumps")]
    + [T.StructField(c, T.DoubleType()) for c in ("median_abs_sec", "p90_abs_sec")]
)


def read_scorecard(days_df: DataFrame, days: int, today) -> DataFrame:
    """Stored cells of the last ``days`` days with per-day settled/final state."""
    d = days_df.where(F.col("day") > F.date_sub(F.lit(today).cast("date"), days))
    parsed = F.from_json("metrics", METRICS_SCHEMA, {"mode": "PERMISSIVE"})
    blank = F.struct(*[F.lit(0).cast("long").alias(c) for c in ("n", "paired", "waits", "jumps")],
                     *[F.lit(None).cast("double").alias(c) for c in ("median_abs_sec", "p90_abs_sec")])
    d = d.withColumn("m", F.coalesce(F.when(F.col("metrics").isNotNull() & parsed["n"].isNotNull(), parsed), blank))
    roll = d.groupBy("day").agg(F.min("scored_through").alias("day_scored_through"), F.min("final").alias("day_final"))
    return d.join(roll, "day").select("day", "route_id", "horizon", "surface", "day_scored_through", "day_final", "m.*")


def accuracy(preds: DataFrame, arrivals: DataFrame, now_ms: int | None = None, days: int = 7) -> DataFrame:
    """|actual - promise| overall and by stops ahead, on (bus_id, stop) within 2 h."""
    p = rider_rows(preds)
    if now_ms is not None:
        p = p.where(F.col("predicted_at") >= now_ms - days * 86_400_000)
    p = p.select("bus_id", F.col("to_stop_id").alias("stop_id"), "predicted_sec", "predicted_at", "stops_ahead")
    j = asof_next(p, arrivals.select("bus_id", "stop_id", "arrived_at"), ["bus_id", "stop_id"],
                  "predicted_at", "arrived_at", MATCH_2H_MS).where(F.col("next").isNotNull())
    err = F.abs((F.col("next._rt") - F.col("predicted_at")) / 1000 - F.col("predicted_sec"))
    e = j.select(F.explode(F.array(E.ahead_bucket("stops_ahead"), F.lit("overall"))).alias("bucket"), err.alias("abs_err"))
    q = grouped_quantiles(e, ["bucket"], "abs_err",
                          {"median_abs_sec": (0.5, "linear"), "p90_abs_sec": (0.9, "linear"), "p95_abs_sec": (0.95, "linear")})
    return q.withColumnRenamed("_n", "n")


def paired_rows(preds: DataFrame, arrivals: DataFrame, *, since_ms: int | None = None, surface: str | None = None,
                route_id: int | None = None, stop_id: int | None = None, bus_name: str | None = None,
                build: str | None = None) -> DataFrame:
    """Filtered log rows with the arrival within 2 h and the error actual - promise."""
    p = preds.where(F.col("surface") == surface) if surface else rider_rows(preds)
    for col, v in (("route_id", route_id), ("to_stop_id", stop_id), ("client_build", build)):
        if v is not None:
            p = p.where(F.col(col) == v)
    if since_ms is not None:
        p = p.where(F.col("predicted_at") >= since_ms)
    p = p.withColumn("bus", E.norm_bus_name("bus_name")).withColumn("stop_id", F.col("to_stop_id"))
    if bus_name is not None:
        p = p.where(F.col("bus") == bus_name.strip().lstrip("#"))
    a = arrivals.select(E.norm_bus_name("bus_name").alias("bus"), "route_id", "stop_id", "arrived_at")
    j = asof_next(p, a, ["bus", "route_id", "stop_id"], "predicted_at", "arrived_at", MATCH_2H_MS)
    return j.withColumn("arrived_at", F.col("next._rt")).withColumn(
        "error_sec", (F.col("arrived_at") - F.col("predicted_at")) / 1000 - F.col("predicted_sec")
    ).drop("next")


def paired_summary(rows: DataFrame) -> DataFrame:
    e = rows.select(F.lit(1).alias("k"), F.explode(F.array(
        F.struct(F.lit("abs").alias("m"), F.abs("error_sec").alias("v")),
        F.struct(F.lit("signed").alias("m"), F.col("error_sec").alias("v")))).alias("x")).select("k", "x.m", "x.v")
    q = grouped_quantiles(e, ["k", "m"], "v", {"p50": (0.5, "floor"), "p90": (0.9, "floor")}).groupBy("k").agg(
        F.max(F.when(F.col("m") == "abs", E.round1("p50"))).alias("median_abs_sec"),
        F.max(F.when(F.col("m") == "abs", E.round1("p90"))).alias("p90_abs_sec"),
        F.max(F.when(F.col("m") == "signed", E.round1("p50"))).alias("median_signed_sec"),
    )
    n = rows.groupBy(F.lit(1).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count("error_sec").alias("paired"))
    zero = F.lit(0.0)
    return n.join(q, "k", "left").select(
        "n", "paired", *[F.coalesce(c, zero).alias(c) for c in ("median_abs_sec", "p90_abs_sec", "median_signed_sec")]
    )


def paired_newest(rows: DataFrame, limit: int = 200) -> DataFrame:
    """Newest rows first (a top-k report)."""
    return rows.orderBy(F.col("predicted_at").desc(), F.col("id").desc()).limit(limit)


def _arms(preds: DataFrame, visits: DataFrame) -> DataFrame:
    p = preds.where((F.col("surface") == E.UPSTREAM) | E.is_rider_surface("surface"))
    p = p.select(
        E.norm_bus_name("bus_name").alias("bus"), "route_id", F.col("to_stop_id").alias("stop_id"), "id",
        F.col("predicted_at").alias("at"), F.col("predicted_sec").alias("sec"),
        F.when(F.col("surface") == E.UPSTREAM, "official").otherwise("ours").alias("arm"),
    )
    j = truth_join(p, truth_visits(visits), ["bus", "route_id", "stop_id"], at="at", tie="visit_id")
    kind = F.when(F.col("sec") > E.HORIZON_CAP_SEC, "beyond").otherwise(F.col("truth"))
    err = F.when(kind == "arrived", (F.col("actual_at") - F.col("at")) / 1000 - F.col("sec"))
    return j.withColumn("kind", kind).withColumn("err", err)


def shared_moments(arms: DataFrame) -> DataFrame:
    """First scored reading per (bus, stop, minute) of each arm, where both met the same arrival."""
    m = arms.where(F.col("kind") == "arrived").withColumn("minute", F.floor(F.col("at") / 60000))
    one = m.groupBy("bus", "stop_id", "minute", "arm").agg(
        F.min_by(F.struct("actual_at", "err"), F.struct("at", "id")).alias("x")
    )
    pair = one.groupBy("bus", "stop_id", "minute").agg(
        F.max(F.when(F.col("arm") == "ours", F.col("x"))).alias("o"), F.max(F.when(F.col("arm") == "official", F.col("x"))).alias("t")
    )
    return pair.where(F.col("o.actual_at") == F.col("t.actual_at")).select(
        "bus", "stop_id", "minute", F.col("o.err").alias("ours_err"), F.col("t.err").alias("official_err")
    )


def official_comparison(preds: DataFrame, visits: DataFrame, min_pairs: int = MIN_COMPARE_PAIRS) -> DataFrame:
    """Arm tallies and the shared-moment arms; null errors under ``min_pairs`` shared pairs.

    Empty when either arm has fewer than ``min_pairs`` pairs.
    """
    # The truth join is read for counts, moments and quantiles: once computed, a few numbers a promise.
    arms = materialize(_arms(preds, visits).select("bus", "stop_id", "at", "id", "arm", "kind", "actual_at", "err"))
    shared = shared_moments(arms).select(F.explode(F.array(
        F.struct(F.lit("shared_ours").alias("arm"), F.col("ours_err").alias("err")),
        F.struct(F.lit("shared_official").alias("arm"), F.col("official_err").alias("err")))).alias("x")).select("x.*")
    allrows = arms.select("arm", "kind", "err").unionByName(shared.withColumn("kind", F.lit("arrived")))
    n = allrows.groupBy("arm").agg(
        F.count(F.lit(1)).alias("n"), _n(F.col("kind") == "beyond").alias("beyond"), _n(F.col("kind") == "standing").alias("standing"),
        _n(F.col("kind") == "arrived").alias("paired"), _n((F.col("kind") == "arrived") & (F.abs("err") <= 120)).alias("_w"),
    )
    e = allrows.where(F.col("err").isNotNull()).select("arm", F.abs("err").alias("v"))
    q = grouped_quantiles(e, ["arm"], "v", {"p50": (0.5, "floor")})
    enough = (F.col("paired") >= min_pairs)
    out = n.join(q, "arm", "left").select(
        "arm", "n", "beyond", "standing", "paired",
        F.when(enough, E.round1("p50")).alias("median_abs_sec"), F.when(enough, E.pct1("_w", "paired")).alias("within120_pct"),
    )
    main = out.where(F.col("arm").isin("ours", "official")).agg(F.coalesce(F.min("paired"), F.lit(0)).alias("m"), F.count(F.lit(1)).alias("c"))
    ok = main.select((F.col("m") >= min_pairs) & (F.col("c") == 2)).scalar()
    return out.where(ok)


def v1_accuracy_rows(preds: DataFrame, arrivals: DataFrame, ring: DataFrame) -> DataFrame:
    """Older pairing with its bucket, tolerance verdict and stops ahead (A13 rows)."""
    p = preds.select("bus_id", F.col("to_stop_id").alias("stop_id"), "from_stop_id", "route_id", "predicted_at", "predicted_sec")
    j = v1_next_arrival(p, arrivals.select("bus_id", "stop_id", "arrived_at"), ["bus_id", "stop_id"])
    j = j.withColumn("b", E.v1_bucket("actual_sec")).where(F.col("b").isNotNull())
    err = F.col("predicted_sec") - F.col("actual_sec")
    first = ring.groupBy("route_id", "stop_id").agg(F.min("stop_index").alias("idx"), F.first("ring_size").alias("ring_size"))
    f = first.select("route_id", F.col("stop_id").alias("from_stop_id"), F.col("idx").alias("fi"))
    t = first.select("route_id", "stop_id", F.col("idx").alias("ti"), "ring_size")
    j = j.join(f, ["route_id", "from_stop_id"], "left").join(t, ["route_id", "stop_id"], "left")
    ahead = F.pmod(F.col("ti") - F.col("fi"), F.col("ring_size"))
    return j.select(
        "route_id", "stop_id", F.col("b.bucket").alias("bucket"), err.alias("err"),
        ((err >= -F.col("b.late_tol")) & (err <= F.col("b.early_tol"))).alias("in_range"),
        E.ahead_bucket(ahead, v2=False).alias("ahead"),
    )


def v1_accuracy_buckets(rows: DataFrame) -> DataFrame:
    return rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.round(100.0 * _n(F.col("in_range")) / F.count(F.lit(1)), 1).alias("in_range_pct"),
        F.round(F.avg(F.abs("err")), 1).alias("mae_sec"), F.round(F.avg("err"), 1).alias("bias_sec"),
    )


def v1_accuracy_overall(rows: DataFrame) -> DataFrame:
    """Headline: plain mean over buckets, with pooled p90/p95 of the absolute error."""
    b = v1_accuracy_buckets(rows).groupBy(F.lit(1).alias("k")).agg(
        F.sum("n").alias("n"), F.round(F.round(F.avg("in_range_pct"), 6), 1).alias("in_range_pct"),
        F.round(F.round(F.avg("mae_sec"), 6), 1).alias("mae_sec"), F.round(F.round(F.avg("bias_sec"), 6), 1).alias("bias_sec"))
    q = grouped_quantiles(rows.select(F.lit(1).alias("k"), F.abs("err").alias("v")), ["k"], "v",
                          {"p90": (0.9, "linear"), "p95": (0.95, "linear")})
    return b.join(q, "k").select("n", "in_range_pct", "mae_sec", "bias_sec", F.round("p90", 1).alias("p90_sec"), F.round("p95", 1).alias("p95_sec"))


def v1_accuracy_stops(rows: DataFrame, by_distance: bool = False) -> DataFrame:
    """Per (stop, route), or per (stop, route, stops ahead)."""
    keys = ["stop_id", "route_id"] + (["ahead"] if by_distance else [])
    r = rows.where(F.col("ahead").isNotNull()) if by_distance else rows
    q = grouped_quantiles(r.withColumn("v", F.abs("err")), keys, "v",
                          {"p50": (0.5, "linear"), "p90": (0.9, "linear"), "p95": (0.95, "linear")})
    if by_distance:
        m = r.groupBy(*keys).agg(F.round(F.avg(F.abs("err")), 1).alias("mae_sec"), F.round(F.avg("err"), 1).alias("bias_sec"))
    else:
        per = r.groupBy(*keys, "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.round(100.0 * _n(F.col("in_range")) / F.count(F.lit(1)), 1).alias("ir"),
            F.round(F.avg(F.abs("err")), 1).alias("mae"), F.round(F.avg("err"), 1).alias("bias"))
        m = per.groupBy(*keys).agg(F.round(F.round(F.avg("ir"), 6), 1).alias("in_range_pct"), F.round(F.round(F.avg("mae"), 6), 1).alias("mae_sec"),
                                   F.round(F.round(F.avg("bias"), 6), 1).alias("bias_sec"))
    return m.join(q, keys).withColumnRenamed("_n", "n").select(
        *keys, "n", *(["in_range_pct"] if not by_distance else []), "mae_sec", "bias_sec",
        F.round("p50", 1).alias("p50_sec"), F.round("p90", 1).alias("p90_sec"), F.round("p95", 1).alias("p95_sec"))
