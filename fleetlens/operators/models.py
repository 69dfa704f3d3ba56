"""Fitted tables and model comparison."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import clock, dist
from fleetlens.functions import exprs as E
from fleetlens.functions.quantiles import TEN_KNOTS, grouped_quantiles
from fleetlens.operators import scan
from fleetlens.operators.asof import MATCH_2H_MS, asof_next
from fleetlens.operators.graph import components
from fleetlens.operators.runs import map_runs
from fleetlens.operators.topology import next_stop
from fleetlens.session import materialize

HORIZONS = ("0-2", "2-5", "5-10", "10-30")
# Knot second of each promise bucket, shrink constants, hinge floor.
KNOT_SEC = {"0-2": 60.0, "2-5": 210.0, "5-10": 450.0, "10-30": 1200.0}
BIAS_K, SCALE_K, SCALE_FLOOR = 1390.0, 2000.0, 180.0
NEVER = 1e12
CELL = ["route_id", "stop_id"]


def _n(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0))


def conformal(pairs: DataFrame, target: float = 0.8) -> DataFrame:
    """Band widening each promise bucket needs to reach the target coverage."""
    p = pairs.where(F.col("det").isNotNull()).withColumn("h", E.horizon("eta")).where(F.col("h").isNotNull())
    up = F.when(F.col("high") > F.col("eta"), (F.col("det") - F.col("eta")) / (F.col("high") - F.col("eta"))).otherwise(NEVER)
    dn = F.when(F.col("low") < F.col("eta"), (F.col("eta") - F.col("det")) / (F.col("eta") - F.col("low"))).otherwise(NEVER)
    p = p.withColumn("w", F.when(F.col("det") > F.col("eta"), up).when(F.col("det") < F.col("eta"), dn).otherwise(0.0))
    q = grouped_quantiles(p, ["h"], "w", {"w": (target, "conformal")})
    inf = p.groupBy("h").agg(_n(F.col("w") >= NEVER).alias("infinite"))
    return q.join(inf, "h").select(F.col("h").alias("horizon"), F.when(F.col("w") < NEVER, F.floor(F.col("w") * 1000 + 0.5) / 1000).alias("w"), F.col("_n").alias("n"), "infinite")


def _factor(table: dict[str, float] | None) -> Column:
    h = E.horizon("eta")
    out = F.lit(1.0)
    for k, v in (table or {}).items():
        out = F.when(h == k, F.lit(float(v))).otherwise(out)
    return out


def _route_horizon(df: DataFrame, horizon: str = "h") -> DataFrame:
    return df.withColumn("route", F.explode(F.array(F.col("r"), F.lit(0).cast("long")))).withColumn("horizon", F.explode(F.array_compact(F.array(F.col(horizon), F.lit("all")))))


def score_pairs(pairs: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """Scorecard cells of replayed pairs with optional band widening."""
    lo, hi = E.widen("eta", "low", "high", _factor(table))
    p = pairs.withColumn("h", E.horizon("eta")).withColumn("lo2", lo).withColumn("hi2", hi)
    p = p.withColumn("err", F.when(F.col("h").isNotNull(), F.col("eta") - F.col("det")))
    iv = F.col("err").isNotNull() & (F.col("hi2") > F.col("lo2"))
    x = _route_horizon(p.groupBy("r", "h", "err").agg(F.count(F.lit(1)).alias("c"), _n(iv).alias("iv"), _n(iv & F.col("det").between(F.col("lo2"), F.col("hi2"))).alias("inside")))
    keys = ["route", "horizon"]
    g = x.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.when(F.col("h").isNull(), F.col("c")).otherwise(0)).alias("beyond"),
                             F.sum(F.when(F.col("h").isNotNull() & F.col("err").isNull(), F.col("c")).otherwise(0)).alias("missing"),
                             F.sum("iv").alias("interval_rows"), F.sum("inside").alias("inside"))
    e = x.withColumn("a", F.abs("err"))
    q = grouped_quantiles(e, keys, "a", {"p50": (0.5, "ceil"), "p90": (0.9, "ceil")}, weight="c")
    return g.join(q.drop("_n"), keys, "left").select(*keys, "n", "beyond", "missing", E.round1("p50").alias("median_abs_sec"), E.round1("p90").alias("p90_abs_sec"),
                                                     "interval_rows", E.pct1("inside", "interval_rows").alias("coverage_pct"))


def _truth(pairs: DataFrame) -> Column:
    return F.col("prox") if "prox" in pairs.columns else F.col("det")


def route_scale(pairs: DataFrame) -> DataFrame:
    """Factor on the part of a promise above the floor that zeroes the route's median error.

    An error changes sign at one factor per pair, so the factor sought is an order statistic of
    those; no search is needed.
    """
    t = _truth(pairs)
    p = pairs.where(t.isNotNull() & (F.col("eta") > SCALE_FLOOR) & (t > 0)).withColumn("s", 1 + (t - F.col("eta")) / (F.col("eta") - SCALE_FLOOR))
    q = grouped_quantiles(p, ["r"], "s", {"s": (0.5, "floor")})
    raw = F.least(F.lit(3.0), F.greatest(F.lit(0.5), F.col("s")))
    value = 1 + (raw - 1) * (F.col("_n") / (F.col("_n") + SCALE_K))
    r3 = lambda c: F.floor(c * 1000 + 0.5) / 1000
    return q.select("r", r3(value).alias("value"), r3(raw).alias("raw"), F.col("_n").alias("n"))


def _effect(d: DataFrame, keys: list[str], arms: dict[str, Column]) -> DataFrame:
    """Error summary before and after a correction."""
    x = d.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), v.alias("err")) for k, v in arms.items()]))).select(*keys, "_x.arm", "_x.err")
    k = [*keys, "arm"]
    c = x.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), _n(F.col("err") >= 120).alias("pess"), _n(F.col("err") <= -120).alias("opt"))
    m = x.withColumn("_m", F.explode(F.array(F.struct(F.lit("s").alias("k"), F.col("err").alias("v")), F.struct(F.lit("a").alias("k"), F.abs("err").alias("v"))))).select(*k, F.col("_m.k").alias("m"), F.col("_m.v").alias("v"))
    q = grouped_quantiles(m, [*k, "m"], "v", {"p50": (0.5, "trunc"), "p90": (0.9, "trunc")}).groupBy(*k).agg(
        E.round1(F.max(F.when(F.col("m") == "a", F.col("p50")))).alias("median_abs_sec"), E.round1(F.max(F.when(F.col("m") == "a", F.col("p90")))).alias("p90_abs_sec"),
        E.round1(F.max(F.when(F.col("m") == "s", F.col("p50")))).alias("median_signed_sec"))
    return c.join(q, k).select(*k, "n", "median_abs_sec", "p90_abs_sec", "median_signed_sec", E.pct1("pess", "n").alias("pess120_pct"), E.pct1("opt", "n").alias("opt120_pct"))


def scale_effect(pairs: DataFrame, scales: DataFrame) -> DataFrame:
    """Errors per route before and after the factors."""
    t = _truth(pairs)
    p = pairs.where(t.isNotNull()).join(scales.select("r", F.col("value").alias("_s")), "r", "left").withColumn("t", t)
    after = F.col("eta") + F.greatest(F.lit(0.0), F.col("eta") - SCALE_FLOOR) * (F.coalesce("_s", F.lit(1.0)) - 1)
    return _effect(p, ["r"], {"before": F.col("eta") - F.col("t"), "after": after - F.col("t")})


def horizon_bias(pairs: DataFrame) -> DataFrame:
    """Median of truth - promise per promise bucket, with n and sd."""
    p = pairs.withColumn("t", _truth(pairs)).where(F.col("t").isNotNull()).withColumn("h", E.horizon("eta")).where(F.col("h").isNotNull()).withColumn("d", F.col("t") - F.col("eta"))
    q = grouped_quantiles(p, ["h"], "d", {"b": (0.5, "trunc")})
    sd = p.groupBy("h").agg(F.stddev_samp("d").alias("sd"))
    return q.join(sd, "h").select(F.col("h").alias("horizon"), E.round1("b").alias("b"), F.col("_n").alias("n"), E.round1("sd").alias("sd"))


def bias_curve(bias: dict[str, tuple[float, int]]) -> list[tuple[float, float]]:
    """Monotone knots (promise, corrected promise) from the four bucket offsets."""
    pts = [(0.0, 0.0)]
    for h in HORIZONS:
        b, n = bias.get(h, (0.0, 0))
        pts.append((KNOT_SEC[h], max(KNOT_SEC[h] + b * n / (n + BIAS_K), pts[-1][1])))
    return pts


def apply_curve(sec: Column, pts: list[tuple[float, float]]) -> Column:
    x9, y9 = pts[-1]
    out = sec + (y9 - x9)
    for (xa, ya), (xb, yb) in reversed(list(zip(pts, pts[1:]))):
        out = F.when(sec <= xb, F.lit(ya) + (sec - xa) / (xb - xa) * (yb - ya)).otherwise(out)
    return F.when(sec > 0, F.greatest(F.lit(0.0), out)).otherwise(sec)


def bias_effect(pairs: DataFrame, bias: DataFrame) -> DataFrame:
    """Errors and band coverage per bucket before and after the offsets (A41). The offsets are four rows."""
    table = {r["horizon"]: (r["b"], r["n"]) for r in bias.collect()}
    pts = bias_curve(table)
    p = pairs.withColumn("t", _truth(pairs)).where(F.col("t").isNotNull()).withColumn("h", E.horizon("eta")).where(F.col("h").isNotNull())
    p = p.withColumn("horizon", F.explode(F.array("h", F.lit("all"))))
    e = _effect(p, ["horizon"], {"before": F.col("eta") - F.col("t"), "after": apply_curve(F.col("eta"), pts) - F.col("t")})
    band = F.col("low") < F.col("high")
    inb = band & F.col("t").between(F.col("low"), F.col("high"))
    ina = band & F.col("t").between(apply_curve(F.col("low"), pts), apply_curve(F.col("high"), pts))
    c = p.groupBy("horizon").agg(_n(band).alias("k"), _n(inb).alias("before"), _n(ina).alias("after"))
    c = c.withColumn("x", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), E.pct1(a, "k").alias("coverage_pct")) for a in ("before", "after")]))).select("horizon", "x.*")
    return e.join(c, ["horizon", "arm"])


def wis_rows(pairs: DataFrame, table: dict[str, float] | None = None) -> DataFrame:
    """Weighted interval score of each usable pair."""
    p = pairs.withColumn("h", E.horizon("eta")).where(F.col("h").isNotNull() & (F.col("eta") >= 0))
    usable = F.col("det").isNotNull() & F.col("low").isNotNull() & F.col("high").isNotNull() & (F.col("det") >= 0) & (F.col("low") <= F.col("eta")) & (F.col("eta") <= F.col("high"))
    lo, hi = E.widen("eta", "low", "high", _factor(table))
    p = p.withColumn("usable", F.coalesce(usable, F.lit(False))).withColumn("lo", F.greatest(F.lit(0.0), lo)).withColumn("hi", hi)
    a = F.abs(F.col("det") - F.col("eta"))
    score = F.col("hi") - F.col("lo") + 10 * F.greatest(F.lit(0.0), F.col("lo") - F.col("det")) + 10 * F.greatest(F.lit(0.0), F.col("det") - F.col("hi"))
    return p.withColumn("abs_err", F.when(F.col("usable"), a)).withColumn("wis", F.when(F.col("usable"), (0.5 * a + 0.1 * score) / 1.5))


def wis_cells(pairs: DataFrame, table: dict[str, float] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Sums per (route, horizon) cell: score, coverage, tails, width."""
    p = wis_rows(pairs, table)
    u = F.col("usable")
    aggs = [F.count(F.lit(1)).alias("n"), _n(u).alias("scored"), _n(u & F.col("det").between(F.col("lo"), F.col("hi"))).alias("covered"), _n(u & (F.col("det") > F.col("hi"))).alias("late"),
            _n(u & (F.col("det") < F.col("lo"))).alias("early"), F.sum("abs_err").alias("abs"), F.sum("wis").alias("wis"), F.sum(F.when(u, F.col("hi") - F.col("lo"))).alias("width")]
    base = p.groupBy(*keys, "r", "h").agg(*aggs)
    return _route_horizon(base).groupBy(*keys, "route", "horizon").agg(*[F.sum(c).alias(c) for c in ("n", "scored", "covered", "late", "early", "abs", "wis", "width")])


def pinball_loss(q: Column, outcome: Column, age: Column) -> Column:
    """Mean pinball loss of a quantile forecast aged by ``age`` seconds."""
    n = F.size(q)
    one = F.transform(q, lambda x, i: ((i + 0.5) / n - F.when(outcome < F.greatest(F.lit(0.0), x - age), 1).otherwise(0)) * (outcome - F.greatest(F.lit(0.0), x - age)))
    return F.aggregate(one, F.lit(0.0), lambda a, e: a + e) / n


def _dist_state(q: Column, age: Column) -> Column:
    bad = (F.size(q) != 50) | F.exists(q, lambda x: x.isNull() | F.isnan(x)) | ~F.forall(F.arrays_zip(F.slice(q, 1, 49).alias("a"), F.slice(q, 2, 49).alias("b")), lambda z: z["b"] >= z["a"])
    return F.when(q.isNull(), "missing-distribution").when(bad, "invalid-distribution").when((age < 0) | (age >= 45), "invalid-age").otherwise("ok")


def pinball(rows: DataFrame) -> DataFrame:
    """Paired mean pinball loss of two 50-knot forecasts, with what kept rows out.

    ``rows``: r, h, det, champion, challenger ARRAY<DOUBLE>, age_sec.
    """
    age = F.coalesce("age_sec", F.lit(0.0))
    d = rows.withColumn("ca", _dist_state(F.col("champion"), age)).withColumn("cb", _dist_state(F.col("challenger"), age))
    no = F.col("det").isNull() | (F.col("det") < 0)
    ok = ~no & (F.col("ca") == "ok") & (F.col("cb") == "ok")
    for a in ("champion", "challenger"):
        d = d.withColumn(f"l_{a}", F.when(ok, pinball_loss(F.col(a), F.col("det"), age)))
    x = d.groupBy("r", "h").agg(F.count(F.lit(1)).alias("n"), _n(ok).alias("paired"), _n(no).alias("missing_outcome"), _n(~no & (F.col("ca") != "ok")).alias("champion_unavailable"),
                                _n(~no & (F.col("cb") != "ok")).alias("challenger_unavailable"), F.sum("l_champion").alias("a"), F.sum("l_challenger").alias("b"))
    g = _route_horizon(x).groupBy("route", "horizon").agg(*[F.sum(c).alias(c) for c in ("n", "paired", "missing_outcome", "champion_unavailable", "challenger_unavailable", "a", "b")])
    k = F.col("paired")
    return g.select("route", "horizon", "n", "paired", "missing_outcome", "champion_unavailable", "challenger_unavailable", F.when(k > 0, F.col("a") / k).alias("champion_loss"),
                    F.when(k > 0, F.col("b") / k).alias("challenger_loss"), F.when(k > 0, (F.col("b") - F.col("a")) / k).alias("delta"))


def identity_clusters(df: DataFrame) -> DataFrame:
    """Cluster of every (day, id) and (day, name) alias by shared rows (J22): the least alias reached.

    Rows shrink to distinct edges between an id and a name of a day, which are then components."""
    day = F.col("day").cast("string")
    e = df.select(F.concat_ws("|", day, F.lit("i"), F.col("bus_id").cast("string")).alias("a"),
                  F.concat_ws("|", day, F.lit("n"), F.lower(E.norm_bus_name("bus_name"))).alias("b")).distinct()
    return components(e).select(F.col("node").alias("alias"), F.col("component").alias("cluster"))


def clustered_bootstrap(rows: DataFrame, draws: int = 2000, min_clusters: int = 30) -> DataFrame:
    """Upper bound of the mean score difference over day, then vehicle, resampling.

    ``rows``: day, bus_id, bus_name, delta (null when unscored). Clusters are summed first; a draw
    then picks days and, inside each, clusters, by hashing (draw, slot).
    """
    lab = identity_clusters(rows)
    al = F.concat_ws("|", F.col("day").cast("string"), F.lit("i"), F.col("bus_id").cast("string"))
    c = rows.where(F.col("delta").isNotNull()).withColumn("alias", al).join(lab, "alias").groupBy("day", "cluster").agg(F.sum("delta").alias("d"), F.count(F.lit(1)).alias("n"))
    c = materialize(c.withColumn("j", F.row_number().over(Window.partitionBy("day").orderBy("cluster")) - 1))
    days = c.groupBy("day").agg(F.count(F.lit(1)).cast("int").alias("size")).withColumn("i", F.row_number().over(Window.orderBy("day")) - 1)
    days = materialize(days)
    n_days = days.count()
    # One row per draw and day slot, then one per draw and cluster slot; each slot picks by its own hash.
    d = rows.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n_days))) if n_days else F.lit(0))
    d = d.withColumn("i", F.pmod(F.xxhash64("draw", "slot", F.lit(1729)), F.lit(max(n_days, 1))).cast("int")).join(days, "i")
    d = d.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size")))).withColumn("j", F.pmod(F.xxhash64("draw", "slot", "k"), F.col("size")).cast("int"))
    m = d.select("draw", "day", "j").join(c, ["day", "j"]).groupBy("draw").agg((F.sum("d") / F.sum("n")).alias("m"))
    q = grouped_quantiles(m.withColumn("k", F.lit(1)), ["k"], "m", {"upper95": (0.95, "trunc")})
    k = days.agg(F.sum("size").alias("clusters"), F.lit(1).alias("k"))
    return k.join(q, "k", "left").select("clusters", "upper95", ((F.col("clusters") >= min_clusters) & (F.col("upper95") < 0)).alias("pass"))


def promotion(pairs: DataFrame, held_out) -> DataFrame:
    """Champion against challenger over replayed days.

    ``pairs``: day, arm ('champion'/'challenger'), eta, low, high, det.
    """
    p = pairs.withColumn("h", E.horizon("eta")).where(F.col("h").isNotNull() & F.col("det").isNotNull()).withColumn("a", F.abs(F.col("eta") - F.col("det")))
    k = ["day", "arm"]
    q = grouped_quantiles(p, k, "a", {"med": (0.5, "ceil")})
    iv = F.col("high") > F.col("low")
    c = p.groupBy(*k).agg(E.pct1(_n(iv & F.col("det").between(F.col("low"), F.col("high"))), _n(iv)).alias("cov"))
    d = q.join(c, k).withColumn("med", E.round1("med")).groupBy("day").agg(
        *[F.max(F.when(F.col("arm") == arm, F.col(m))).alias(f"{m}_{arm[:5]}") for arm in ("champion", "challenger") for m in ("med", "cov")])
    d = d.withColumn("held", F.col("day") == F.lit(held_out).cast("date"))
    g = d.agg(F.avg(F.col("med_chall") - F.col("med_champ")).alias("median_diff"), F.greatest(F.lit(3.0), F.coalesce(F.stddev_samp("med_champ"), F.lit(0.0))).alias("median_bound"),
              F.greatest(F.lit(2.0), F.coalesce(F.stddev_samp("cov_champ"), F.lit(0.0))).alias("coverage_bound"),
              F.coalesce(F.max(F.when(F.col("held"), F.col("cov_chall") - F.col("cov_champ"))), F.max_by(F.col("cov_chall") - F.col("cov_champ"), "day"), F.lit(0.0)).alias("coverage_diff"), F.count(F.lit(1)).alias("days"))
    ok = (F.col("days") > 0) & (F.col("median_diff") <= F.col("median_bound")) & (F.col("coverage_diff") >= -F.col("coverage_bound"))
    return g.withColumn("promote", ok)


def _solve_ols(m: dict, xs: list[str]) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares of y ~ 1 + xs from moments."""
    names = ["1", *xs]
    key = lambda a, b: m[a + "*" + b] if a + "*" + b in m else m[b + "*" + a]
    a = np.array([[key(p, q) for q in names] for p in names], float)
    b = np.array([key(p, "y") for p in names], float)
    beta = np.linalg.lstsq(a, b, rcond=None)[0]
    return beta, float(m["y*y"] - beta @ b)


def moments(df: DataFrame, xs: list[str], y: str, keys: list[str] = ()) -> DataFrame:
    """Sums of products of (1, xs, y): all any subset regression needs, in one aggregate."""
    cols = {"1": F.lit(1.0), **{x: F.col(x) for x in xs}, "y": F.col(y)}
    names = list(cols)
    aggs = [F.sum(cols[a] * cols[b]).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]]
    return df.groupBy(*keys).agg(*aggs)


def compare_sources(pairs: DataFrame) -> DataFrame:
    """Two sources on the same moments: error quantiles, correlation, share closer, blend weights and
    the partial R2 of the second given the first (A46).

    ``pairs``: bucket, truth, ours, official. Buckets with under 50 pairs are left out.
    """
    p = pairs.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.lit("all")))).withColumn("eo", F.col("ours") - F.col("truth")).withColumn("eu", F.col("official") - F.col("truth"))
    x = p.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(k).alias("m"), v.alias("v")) for k, v in (("so", F.col("eo")), ("su", F.col("eu")), ("ao", F.abs("eo")), ("au", F.abs("eu")))]))).select("bucket", "_x.m", "_x.v")
    q = grouped_quantiles(x, ["bucket", "m"], "v", {"p10": (0.1, "linear"), "p50": (0.5, "linear"), "p90": (0.9, "linear")})
    pv = q.groupBy("bucket").agg(*[F.max(F.when(F.col("m") == m, F.col(c))).alias(f"{m}_{c}") for m, c in (("so", "p10"), ("so", "p50"), ("so", "p90"), ("su", "p50"), ("ao", "p50"), ("ao", "p90"), ("au", "p50"), ("au", "p90"))])
    n, so, su, y = F.count(F.lit(1)), F.sum("ours"), F.sum("official"), F.sum("truth")
    g = p.groupBy("bucket").agg(n.alias("n"), F.corr("eo", "eu").alias("corr"), F.avg(F.when(F.abs("eu") < F.abs("eo"), 1.0).otherwise(0.0)).alias("official_closer"),
                                F.var_pop("ours").alias("voo"), F.var_pop("official").alias("vuu"), F.var_pop("truth").alias("vyy"),
                                F.covar_pop("ours", "official").alias("vou"), F.covar_pop("ours", "truth").alias("voy"), F.covar_pop("official", "truth").alias("vuy"),
                                (so / n).alias("mo"), (su / n).alias("mu"), (y / n).alias("my")).where("n >= 50")
    det = F.col("voo") * F.col("vuu") - F.col("vou") * F.col("vou")
    b = (F.col("voy") * F.col("vuu") - F.col("vuy") * F.col("vou")) / det
    c = (F.col("vuy") * F.col("voo") - F.col("voy") * F.col("vou")) / det
    s1 = F.col("vyy") - F.col("voy") * F.col("voy") / F.col("voo")
    s2 = F.col("vyy") - b * F.col("voy") - c * F.col("vuy")
    g = g.select("bucket", "n", "corr", "official_closer", b.alias("b_ours"), c.alias("c_official"), (F.col("my") - b * F.col("mo") - c * F.col("mu")).alias("a"), (1 - s2 / s1).alias("partial_r2"))
    return g.join(pv, "bucket")


def compare_runs(a: DataFrame, b: DataFrame, flags: list[str], delta: str) -> DataFrame:
    """Two scored runs joined by rider: each flag in both, one or neither, and the paired change."""
    j = a.select("rider_id", *[F.col(f).alias(f"a_{f}") for f in flags], F.col(delta).alias("a_d")).join(
        b.select("rider_id", *[F.col(f).alias(f"b_{f}") for f in flags], F.col(delta).alias("b_d")), "rider_id")
    j = j.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f"a_{f}").alias("a"), F.col(f"b_{f}").alias("b")) for f in flags])))
    x, y = F.col("_x.a"), F.col("_x.b")
    return j.groupBy(F.col("_x.flag").alias("flag")).agg(F.count(F.lit(1)).alias("n"), _n(x & y).alias("both"), _n(x & ~y).alias("only_a"), _n(~x & y).alias("only_b"),
                                                         _n(~x & ~y).alias("neither"), F.avg(F.col("b_d") - F.col("a_d")).alias("mean_change"))


def compare_models(visits: DataFrame, forecasts: DataFrame, arms: list[str]) -> DataFrame:
    """Arms on the same (visit, query time): first-display and remaining errors, visits weighing equally.

    ``visits``: visit_id, actual_at (null when censored). ``forecasts``: visit_id, query_at, arm, predicted_at.
    Query times answered twice by an arm, or not by every arm, are left out.
    """
    f = forecasts.where(F.col("arm").isin(arms))
    ok = f.groupBy("visit_id", "query_at").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("arm").alias("k")).where((F.col("c") == len(arms)) & (F.col("k") == len(arms)))
    d = f.join(ok, ["visit_id", "query_at"], "left_semi").join(visits.where("actual_at IS NOT NULL"), "visit_id").withColumn("err", (F.col("predicted_at") - F.col("actual_at")) / 1000)
    v = d.groupBy("arm", "visit_id").agg(F.min_by("err", "query_at").alias("first_err"), F.avg(F.abs("err")).alias("mae"))
    e = F.col("first_err")
    return v.groupBy("arm").agg(F.count(F.lit(1)).alias("visits"), F.avg(F.abs(e)).alias("first_mae"), F.avg(e).alias("first_bias"), _n(F.abs(e) <= 120).alias("within_2min"),
                                _n(e > 120).alias("late_2min"), _n(e < -120).alias("early_2min"), F.avg("mae").alias("remaining_mae"))


def recency_summary(trips: DataFrame, keys: list[str], as_of_ms: int, half_life_ms: int = 2 * scan.DAY_MS, need: float = 5.0) -> DataFrame:
    """Weights halving every two days, effective count and weighted median.

    Values are summed per distinct (key, value) first and the cumulative weight runs over coarse value
    buckets and then inside the one holding the half, as for plain quantiles.
    """
    from fleetlens.functions.quantiles import _bucket

    t = trips.where((F.col("actual_sec") > 0) & (F.col("arrived_at") <= as_of_ms)).withColumn("w", F.pow(F.lit(2.0), (F.col("arrived_at") - as_of_ms) / half_life_ms))
    tot = t.groupBy(*keys).agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("w")).alias("sq"), F.count(F.lit(1)).alias("n"))
    v = t.groupBy(*keys, F.col("actual_sec").alias("v")).agg(F.sum("w").alias("w")).withColumn("_b", _bucket(F.col("v")))
    b = v.groupBy(*keys, "_b").agg(F.sum("w").alias("bw"), F.min("v").alias("bmin"))
    w = Window.partitionBy(*keys).orderBy("_b")
    b = b.withColumn("base", F.sum("bw").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bw")).withColumn("next_min", F.lead("bmin").over(w))
    v = v.join(b.select(*keys, "_b", "base", "next_min"), [*keys, "_b"]).join(tot, keys)
    inner = Window.partitionBy(*keys, "_b").orderBy("v")
    cum = F.col("base") + F.sum("w").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    v = v.withColumn("cum", cum).withColumn("nv", F.coalesce(F.lead("v").over(inner), F.col("next_min")))
    half = F.col("total") / 2
    hit = v.where(F.col("cum") >= half - F.col("total") * 1e-12).groupBy(*keys).agg(F.min(F.struct("v", "cum", "nv", "total")).alias("x"))
    mid = F.when((F.abs(F.col("x.cum") - F.col("x.total") / 2) <= F.col("x.total") * 1e-12) & F.col("x.nv").isNotNull(), (F.col("x.v") + F.col("x.nv")) / 2).otherwise(F.col("x.v"))
    eff = F.col("total") * F.col("total") / F.col("sq")
    return tot.join(hit.select(*keys, mid.alias("m")), keys).select(*keys, "n", eff.alias("effective_n"), F.when(eff + 1e-9 >= need, F.col("m")).alias("weighted_median"))


# --- stand tables by hour, lap and release fits ---------------------------------------------------

SHIPPED = math.log(0.55 / 0.5) / math.log(0.55 / 0.45)


def shipped_median(q: Column) -> Column:
    """Median of a ten-knot table with log-linear survival between knots."""
    a, b = F.element_at(q, 5), F.element_at(q, 6)
    return a + (b - a) * SHIPPED


def _stands(visits: DataFrame) -> DataFrame:
    from fleetlens.operators.calibrate import stand_samples

    return stand_samples(visits).select(*CELL, "stand", clock.local_minute("pinned_at").alias("tod"), clock.local_day("pinned_at").alias("day"))


def hour_stand_tables(visits: DataFrame, now_ms: int, half_min: int = 60, k: float = 8.0) -> DataFrame:
    """Stand table of the hour around now, shrunk toward the pooled one (M1)."""
    s = _stands(visits)
    centre = clock.local_minute(F.lit(now_ms))
    x = s.withColumn("scope", F.explode(F.array_compact(F.array(F.lit("all"), F.when(E.circular_minutes("tod", centre) <= half_min, "hour")))))
    q = grouped_quantiles(x, [*CELL, "scope"], "stand", {"q": (TEN_KNOTS, "linear")}).groupBy(*CELL).agg(
        F.max(F.when(F.col("scope") == "all", F.struct("q"))).alias("p"), F.max(F.when(F.col("scope") == "hour", F.struct("q", "_n"))).alias("h"))
    n = F.coalesce("h._n", F.lit(0))
    w = n / (n + k)
    blend = F.when(F.col("h").isNull(), F.col("p.q")).otherwise(F.zip_with("h.q", "p.q", lambda a, b: w * a + (1 - w) * b))
    return q.select(*CELL, n.alias("n"), w.alias("w"), blend.alias("qh"))


def _boot_upper(days: Column, seed: Column, draws: int = 400, q: float = 0.9) -> Column:
    """Upper quantile of the resampled mean of per-day (sum, n) pairs; a cell has tens of days."""
    size = F.size(days)
    one = lambda d: F.aggregate(F.transform(F.sequence(F.lit(1), size), lambda j: F.get(days, F.pmod(F.xxhash64(seed, d, j), size).cast("int"))),
                                F.struct(F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n")), lambda a, e: F.struct((a["s"] + e["s"]).alias("s"), (a["n"] + e["n"]).alias("n")))
    means = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)), lambda d: F.transform(F.array(one(d)), lambda r: r["s"] / r["n"])[0]))
    return F.get(means, F.lit(min(draws - 1, int(q * draws))))


def _folds(s: DataFrame, n_folds: int = 5) -> DataFrame:
    """Whole days to folds in day order."""
    w = Window.partitionBy(*CELL).orderBy("day")
    d = s.select(*CELL, "day").distinct().withColumn("fold", (F.row_number().over(w) - 1) % n_folds)
    return s.join(d, [*CELL, "day"])


def _around_the_clock(half_min: int):
    """Knots of the stands within ``half_min`` minutes of each asked minute, for whole cells.

    A histogram over the cell's values goes round the clock: a minute's rows come in and go out once, and the knots
    are read off its running sums. Rows: fold, tod, stand, w (how many), asked (whether the fold asks for this minute)."""
    span = 2 * half_min + 1

    def walk(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in (*CELL, "test", "centre", "_n", "hq")}
        fold, tod, stand, w = (pdf[c].to_numpy() for c in ("fold", "tod", "stand", "w"))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(pdf)], strict=True):
            values, place = np.unique(stand[a:b], return_inverse=True)
            for test in np.unique(fold[a:b]).tolist():
                mine = fold[a:b] == test
                asked = np.unique(tod[a:b][mine])
                train = np.flatnonzero(~mine)
                train = train[np.argsort(tod[a:b][train], kind="stable")]
                minute, at = tod[a:b][train], np.arange(1441)
                edge = np.searchsorted(minute, at)  # rows of minute m: edge[m] to edge[m + 1]
                histogram, low = np.zeros(len(values), dtype=np.int64), None
                for centre in asked.tolist():
                    # Minutes are counted on from the first window's start, so the way round midnight is as any other.
                    want = (centre - half_min, centre - half_min + span)
                    have = (low, low + span) if low is not None and low + span > want[0] else (want[0], want[0])
                    if have[0] == have[1]:
                        histogram[:] = 0
                    for (x, y), sign in (((have[1], want[1]), 1), ((have[0], want[0]), -1)):
                        for m in range(x, y):
                            rows = train[edge[m % 1440] : edge[m % 1440 + 1]]
                            np.add.at(histogram, place[rows], sign * w[a:b][rows])
                    low = want[0]
                    n = int(histogram.sum())
                    if n:
                        position = (n - 1) * np.array(TEN_KNOTS)
                        run = np.cumsum(histogram)
                        lo, hi = (values[np.searchsorted(run, k + 1)] for k in (np.floor(position).astype(int), np.ceil(position).astype(int)))
                        knots = lo + (position - np.floor(position)) * (hi - lo)
                        for c, v in zip(out, (*(int(pdf[c].iloc[a]) for c in CELL), int(test), int(centre), n, knots.tolist()), strict=True):
                            out[c].append(v)
        return pd.DataFrame(out)

    return walk


def hour_stand_gate(visits: DataFrame, min_visits: int = 60, min_med: float = 120.0, min_days: int = 8, half_min: int = 60, k: float = 8.0, draws: int = 400) -> DataFrame:
    """Whether the hourly table beats the pooled one on held-out days, per cell (M1).

    Equal (fold, minute, stand) of a cell are counted first, which bounds a cell's rows whatever its visits, and no
    row is multiplied by the minutes of its windows: a cell's windows are read off one histogram (``_around_the_clock``)."""
    s = _stands(visits)
    q = grouped_quantiles(s, CELL, "stand", {"q": (TEN_KNOTS, "linear")})
    g = s.groupBy(*CELL).agg(F.count(F.lit(1)).alias("visits"), F.count_distinct("day").alias("days"))
    cand = q.join(g, CELL).withColumn("med", shipped_median(F.col("q"))).where((F.col("visits") >= min_visits) & (F.col("med") >= min_med) & (F.col("days") >= min_days))
    s = materialize(_folds(s.join(cand.select(*CELL), CELL, "left_semi")))
    counted = s.groupBy(*CELL, F.col("fold").cast("int").alias("fold"), F.col("tod").cast("int").alias("tod"), "stand").agg(F.count(F.lit(1)).alias("w"))
    # A visit trains the four folds it is not in.
    tr = counted.withColumn("test", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda f: f != F.col("fold"))))
    pooled = grouped_quantiles(tr, [*CELL, "test"], "stand", {"pq": (TEN_KNOTS, "linear")}, weight="w").where("_n >= 30").drop("_n")
    hq = map_runs(counted, CELL, ["fold", "tod", "stand"], _around_the_clock(half_min), f"{', '.join(f'{c} long' for c in CELL)}, test int, centre int, _n long, hq array<double>")
    j = s.select(*CELL, "day", "stand", F.col("fold").cast("int").alias("test"), F.col("tod").cast("int").alias("centre")).join(pooled, [*CELL, "test"]).join(hq, [*CELL, "test", "centre"], "left")
    w = F.coalesce("_n", F.lit(0)) / (F.coalesce("_n", F.lit(0)) + k)
    pm = shipped_median(F.col("pq"))
    hm = F.when(F.col("hq").isNull(), pm).otherwise(w * shipped_median(F.col("hq")) + (1 - w) * pm)
    return _gate(j.withColumn("base_err", F.abs(pm - F.col("stand"))).withColumn("new_err", F.abs(hm - F.col("stand"))), min_days, draws)


def _gate(j: DataFrame, min_days: int, draws: int) -> DataFrame:
    d = j.groupBy(*CELL, "day").agg(F.sum(F.col("new_err") - F.col("base_err")).alias("s"), F.count(F.lit(1)).alias("n"), F.sum("base_err").alias("b"), F.sum("new_err").alias("h"))
    g = d.groupBy(*CELL).agg(F.array_sort(F.collect_list(F.struct("day", "s", "n"))).alias("ds"), F.sum("b").alias("b"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    g = g.where(F.size("ds") >= min_days).withColumn("upper", _boot_upper(F.col("ds"), F.xxhash64(*CELL), draws))
    return g.select(*CELL, F.size("ds").alias("days"), "n", (F.col("b") / F.col("n")).alias("base_mae"), (F.col("h") / F.col("n")).alias("new_mae"), "upper", (F.col("upper") < 0).alias("pass"))


def lap_samples(arrivals: DataFrame) -> DataFrame:
    """Stand against lap age per cell, inside the band about the cell's period (M2)."""
    a = arrivals.where(F.col("departed_at") > F.col("arrived_at"))
    d = scan.shifted(a, [*CELL, "bus_name"], ["arrived_at", "id"], {"_pd": "departed_at"}).where(F.col("_pd").isNotNull())
    d = d.select(*CELL, clock.local_day("arrived_at").alias("day"), ((F.col("departed_at") - F.col("arrived_at")) / 1000).alias("stand"),
                 ((F.col("arrived_at") - F.col("_pd")) / 1000).alias("lap"), ((F.col("departed_at") - F.col("_pd")) / 1000).alias("period"))
    return d


def lap_fits(arrivals: DataFrame, period: tuple[float, float] = (900.0, 7200.0), min_periods: int = 40, min_n: int = 60, min_med: float = 120.0, max_stand: float = 2400.0,
             min_cells: int = 5, min_days: int = 10, draws: int = 400, shrink_k: float = 19.0) -> DataFrame:
    """Slope of stand on lap age per cell, its day-clustered weight and held-out gate (M2)."""
    d = materialize(lap_samples(arrivals))
    per = grouped_quantiles(d.where((F.col("period") > period[0]) & (F.col("period") < period[1])), CELL, "period", {"P": (0.5, "linear")}).where(F.col("_n") >= min_periods).drop("_n")
    d = d.where(F.col("stand").between(0, max_stand)).join(per, CELL)
    med = grouped_quantiles(d, CELL, "stand", {"med": (0.5, "linear")}).drop("_n")
    s = d.where((F.col("lap") >= 0.65 * F.col("P")) & (F.col("lap") <= 1.65 * F.col("P"))).join(med, CELL).where(F.col("med") >= min_med)
    fit = s.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n"), F.avg("lap").alias("mx"), F.avg("stand").alias("my"), F.regr_slope("stand", "lap").alias("slope"),
                               F.var_pop("lap").alias("vx"), F.first("med").alias("med")).where((F.col("n") >= min_n) & (F.col("vx") > 0))
    lm = grouped_quantiles(s, CELL, "lap", {"lap_med": (0.5, "linear")}).drop("_n")
    fit = materialize(fit.join(lm, CELL))
    xt = F.col("lap") - F.col("mx")
    r = s.drop("med").join(fit, CELL)
    meat = r.groupBy(*CELL, "day").agg(F.sum(xt * (F.col("stand") - (F.col("my") + F.col("slope") * xt))).alias("v")).groupBy(*CELL).agg(F.sum(F.col("v") * F.col("v")).alias("m"), F.count(F.lit(1)).alias("g")).where("g >= 2")
    sxx = F.col("vx") * F.col("n")
    se = F.sqrt(F.col("m") / (sxx * sxx) * (F.col("g") / (F.col("g") - 1)))
    f = F.greatest(F.lit(1.0), F.col("med"))
    x = fit.join(meat, CELL).withColumn("beta", F.col("slope") * F.sqrt("vx") / f).withColumn("se2", F.pow(se * F.sqrt("vx") / f, F.lit(2.0)))
    pool = x.agg(F.count(F.lit(1)).alias("k"), F.avg("beta").alias("mb"), F.avg(F.col("beta") * F.col("beta")).alias("b2"), F.avg("se2").alias("ms"))
    t2 = pool.select(F.greatest(F.lit(1e-6), F.when(F.col("k") >= min_cells, F.col("b2") - F.col("mb") * F.col("mb") - F.col("ms")).otherwise(F.col("b2")))).scalar()
    x = materialize(x.withColumn("tau2", t2).withColumn("w", F.col("tau2") / (F.col("tau2") + F.col("se2"))))
    fs = _folds(s.join(x.select(*CELL, "w"), CELL)).select(*CELL, "day", "stand", "lap", "w", "fold")
    tr = fs.withColumn("test", F.explode(F.filter(F.sequence(F.lit(0), F.lit(4)), lambda k: k != F.col("fold"))))
    tk = [*CELL, "test"]
    sl = tr.groupBy(*tk).agg(F.regr_slope("stand", "lap").alias("sl"), F.count(F.lit(1)).alias("tn")).where(F.col("tn") >= min_n)
    mm = tr.withColumn("_x", F.explode(F.array(F.struct(F.lit("s").alias("m"), F.col("stand").alias("v")), F.struct(F.lit("l").alias("m"), F.col("lap").alias("v"))))).select(*tk, "_x.m", "_x.v")
    mm = grouped_quantiles(mm, [*tk, "m"], "v", {"q": (0.5, "linear")}).groupBy(*tk).agg(F.max(F.when(F.col("m") == "s", F.col("q"))).alias("M"), F.max(F.when(F.col("m") == "l", F.col("q"))).alias("L"))
    te = fs.withColumnRenamed("fold", "test").join(sl, tk).join(mm, tk)
    fac = F.least(F.lit(2.0), F.greatest(F.lit(0.35), 1 + F.col("w") * F.col("sl") / F.greatest(F.lit(1.0), F.col("M")) * (F.col("lap") - F.col("L"))))
    gate = _gate(te.withColumn("base_err", F.abs(F.col("M") - F.col("stand"))).withColumn("new_err", F.abs(F.col("M") * fac - F.col("stand"))), min_days, draws)
    n_eff = F.greatest(F.lit(min_n), F.round(shrink_k * F.col("w") / F.greatest(F.lit(1e-6), 1 - F.col("w")))).cast("long")
    return x.join(gate.select(*CELL, "upper", "pass", "base_mae", "new_mae"), CELL, "left").select(
        *CELL, "n", F.round(F.col("slope") / f, 7).alias("b"), F.round("lap_med").alias("m"), n_eff.alias("n_eff"), F.round("w", 6).alias("w"), "base_mae", "new_mae", F.coalesce("pass", F.lit(False)).alias("pass"))


def release_rows(obs: DataFrame, cap: float = 1800.0) -> DataFrame:
    """Visits as 15 s person-period rows with nine features (M3). ``obs``: stop_id, pinned_at, stand, lap, ref_lap."""
    ref = F.col("ref_lap")
    valid = F.coalesce(F.col("lap").between(0.65 * ref, 1.65 * ref), F.lit(False))
    bins = F.greatest(F.lit(1), F.ceil(F.least(F.col("stand"), F.lit(cap)) / 15)).cast("int")
    d = obs.withColumn("_v", valid).withColumn("bins", bins).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    t = (F.col("i") + 0.5) * 15
    ang = 2 * math.pi * (F.pmod(F.floor(F.col("pinned_at") / 1000), F.lit(900)) + t) / 900
    z = F.lit(0.0)
    x = [F.lit(1.0), F.log1p(t / 60), t / 600, F.greatest(t - 300, z) / 600, F.greatest(t - 600, z) / 600, F.when(F.col("_v"), (F.col("lap") - ref) / 600).otherwise(z),
         F.when(F.col("_v"), 0.0).otherwise(1.0), F.sin(ang), F.cos(ang)]
    y = F.when((F.col("i") == F.col("bins") - 1) & (F.col("stand") <= cap), 1.0).otherwise(0.0)
    return d.select("stop_id", *[c.alias(f"x{k}") for k, c in enumerate(x)], y.alias("y"))


def _newton_step(beta: np.ndarray, sums: list[float], l2: float) -> np.ndarray | None:
    """The step from the summed slopes and curvatures of one group; None where it has come to rest."""
    k = len(beta)
    g, h = np.array(sums[:k], float), np.zeros((k, k))
    h[np.triu_indices(k)] = sums[k:]
    h = h + np.triu(h, 1).T
    g[1:] += 2 * l2 * beta[1:]
    h[np.arange(1, k), np.arange(1, k)] += 2 * l2
    return None if np.abs(g).max() < 1e-7 else np.linalg.solve(h, g)


def fit_logistics(rows: DataFrame, key: str, l2: float = 2.0, rounds: int = 50, halvings: int = 24) -> dict[object, list[float]]:
    """Coefficients of one L2 logistic per ``key`` (columns x0.., y), for those that converge.

    All groups take their Newton step together: a round is one aggregate by key of slopes and curvatures and one
    that prices the halved steps. The driver holds a few dozen sums per group that is still moving."""
    k = len([c for c in rows.columns if c.startswith("x")])
    rows = materialize(rows.groupBy(key, *[f"x{i}" for i in range(k)], "y").agg(F.count(F.lit(1)).alias("w")))
    spark, xs = rows.sparkSession, [F.col(f"x{i}") for i in range(k)]
    kind = dict(rows.dtypes)[key]

    def lin(beta: str):
        return F.aggregate(F.zip_with(F.array(*xs), F.col(beta), lambda x, b: x * b), F.lit(0.0), lambda acc, v: acc + v)

    def with_betas(betas: dict, column: str, schema: str) -> DataFrame:
        table = spark.createDataFrame([(g, v) for g, v in betas.items()], f"{key} {kind}, {column} {schema}")
        return rows.join(table, key)

    def priced(trials: dict) -> dict:
        """Losses of each group's trial coefficients."""
        d = with_betas(trials, "b", "array<array<double>>").select(key, "y", "w", *xs, F.posexplode("b").alias("s", "one"))
        z = lin("one")
        got = d.groupBy(key, "s").agg(F.sum(F.col("w") * (F.greatest(F.lit(0.0), z) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z)).alias("v")).collect()
        out: dict = {}
        for r in got:
            b = trials[r[key]][r["s"]]
            out.setdefault(r[key], {})[r["s"]] = r["v"] + l2 * sum(v * v for v in b[1:])
        return out

    shares = {r[key]: r["p"] for r in rows.groupBy(key).agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("p")).collect()}
    moving = {g: np.array([math.log(p / (1 - p)), *[0.0] * (k - 1)]) for g, p in shares.items() if p is not None and 0 < p < 1}
    done: dict = {}
    cost = {g: v[0] for g, v in priced({g: [b.tolist()] for g, b in moving.items()}).items()} if moving else {}
    for _ in range(rounds):
        if not moving:
            break
        d = with_betas({g: b.tolist() for g, b in moving.items()}, "b", "array<double>")
        pr = 1 / (1 + F.exp(-lin("b")))
        e, w = (pr - F.col("y")) * F.col("w"), pr * (1 - pr) * F.col("w")
        got = {r[key]: list(r)[1:] for r in d.groupBy(key).agg(*[F.sum(e * c) for c in xs], *[F.sum(w * xs[i] * xs[j]) for i in range(k) for j in range(i, k)]).collect()}
        steps = {g: _newton_step(moving[g], got[g], l2) for g in list(moving)}
        done.update({g: moving.pop(g).tolist() for g, s in steps.items() if s is None})
        if not moving:
            break
        trials = {g: [(moving[g] - steps[g] / 2**i).tolist() for i in range(halvings)] for g in moving}
        losses = priced(trials)
        for g in list(moving):
            best = next((i for i in range(halvings) if losses[g][i] <= cost[g] + 1e-12 * abs(cost[g])), None)
            if best is None:
                moving.pop(g)  # no step helps: this group has no fit
                continue
            change = float(np.abs(np.array(trials[g][best]) - moving[g]).max())
            moving[g], cost[g] = np.array(trials[g][best]), losses[g][best]
            if change < 1e-8:
                done[g] = moving.pop(g).tolist()
    return done


def release_fits(visits: DataFrame, before_ms: int, min_n: int = 60, min_days: int = 3, min_laps: int = 40) -> DataFrame:
    """Hazard of leaving a stop by time stood, lap and quarter-hour phase (M3): one row per stop, none where it is
    thin (visits, days, usable laps) or the fit does not converge. All stops are fitted together.

    ``visits``: stop visits with ``loop`` material from ``lap_samples`` joined as lap (nullable).
    """
    ready = F.greatest(F.col("departed_at") + 120_000, F.coalesce("first_moved_at", "departed_at") + F.coalesce("confirm_sec", F.lit(0.0)) * 1000)
    v = visits.where((F.col("outcome") == "stopped") & (F.col("departed_at") >= F.col("pinned_at")) & (ready < before_ms))
    o = materialize(v.select("stop_id", "pinned_at", ((F.col("departed_at") - F.col("pinned_at")) / 1000).alias("stand"), "lap", clock.service_day("pinned_at").alias("day")))
    usable = (F.col("lap") > 900) & (F.col("lap") < 7200)
    g = o.groupBy("stop_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("day").alias("days"), _n(usable).alias("laps")).where(
        (F.col("n") >= min_n) & (F.col("days") >= min_days) & (F.col("laps") >= min_laps))
    lap = grouped_quantiles(o.where(usable), ["stop_id"], "lap", {"ref_lap": (0.5, "linear")}).drop("_n")
    g = materialize(g.join(lap, "stop_id"))
    fits = fit_logistics(release_rows(o.join(g.select("stop_id", "ref_lap"), "stop_id")), "stop_id")
    table = visits.sparkSession.createDataFrame([(s, b) for s, b in fits.items()], "stop_id long, coefficients array<double>")
    return g.join(table, "stop_id").select("stop_id", F.col("ref_lap").alias("reference_lap"), "coefficients", "n", "days")


def class_pools(tables: DataFrame, layover_sec: float = 120.0, min_n: int = 3) -> DataFrame:
    """Mixture of well-sampled stand tables per route and class, weighted by their counts (M4)."""
    t = tables.where(F.col("qn") >= min_n).withColumn("layover", dist.quantile("q", 0.5) >= layover_sec)
    return t.groupBy("route_id", "layover").agg(dist_mixture("q", "qn").alias("pool"), F.count(F.lit(1)).alias("cells"))


def dist_mixture(q: str, w: str) -> Column:
    return dist.mixture_knots(F.collect_list(F.struct(F.col(q).alias("q"), F.col(w).cast("double").alias("w"))), 10)


def stop_models(tables: DataFrame) -> DataFrame:
    """Stand table of each stop shrunk toward its class pool (M4). ``tables``: CELL, q, qn, p_stop."""
    pools = class_pools(tables)
    t = tables.withColumn("layover", (F.col("qn") >= 3) & (dist.quantile("q", 0.5) >= 120.0)).join(pools.select("route_id", "layover", "pool"), ["route_id", "layover"], "left")
    stand = dist.shrink_toward("q", F.coalesce("pool", "q"), "qn", 3.0)
    t = t.withColumn("stand", stand)
    return t.select(*CELL, "stand", (dist.quantile("stand", 0.5) >= 120.0).alias("layover"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("p_stop", dist.survival("stand", F.lit(0.0))))).alias("p_stop"))


def hop_models(hops: DataFrame, pace: DataFrame) -> DataFrame:
    """Hop time shrunk toward the route's pace over its metres (M4). ``hops``: HOP, dq, dqn, road_m; ``pace``: route_id, spm."""
    h = hops.join(pace.select("route_id", "spm"), "route_id", "left").withColumn("prior", dist.scale("spm", F.col("road_m")))
    drive = F.when(F.col("prior").isNull(), F.col("dq")).when(F.col("dq").isNull(), F.col("prior")).otherwise(dist.shrink_toward("dq", "prior", "dqn", 8.0))
    h = h.withColumn("drive", drive)
    return h.select("route_id", "from_stop_id", "to_stop_id", "drive", (F.col("road_m") / dist.quantile("drive", 0.5)).alias("speed_mps"),
                    F.greatest(F.lit(0.0), dist.quantile("drive", 0.5) - dist.quantile("prior", 0.5)).alias("hidden_rest_sec"))


# --- replay designs -------------------------------------------------------------------------------


def chronological_plan(days: DataFrame, train: int = 14, test: int = 8) -> DataFrame:
    """Last ``test`` days to evaluate, the ``train`` before them to fit (M8)."""
    d = days.select("day").distinct()
    w = Window.orderBy(F.col("day").desc())
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= train + test).select("day", F.when(F.col("_r") <= test, "test").otherwise("train").alias("phase"))


def standing_backtest(arrivals: DataFrame, ring: DataFrame, variants: dict[str, DataFrame], k: int = 10, step_ms: int = scan.DAY_MS, horizon_ms: int = MATCH_2H_MS) -> DataFrame:
    """From each arrival predict the next k places with the tables of its step, every variant on the same pairs (M7).

    ``variants``: name -> HOP, as_of, mean. A pair counts only where every variant has all its hops.
    """
    n = next_stop(ring).join(ring.groupBy("route_id").agg(F.count(F.lit(1)).alias("n")), "route_id").select("route_id", "stop_index", F.col("stop_id").alias("from_stop_id"), F.col("next_stop_id").alias("to_stop_id"), "n")
    a = arrivals.select(F.col("id").alias("origin_id"), "bus_name", "route_id", F.col("stop_index").alias("i0"), F.col("arrived_at").alias("t0"))
    a = a.join(n.select("route_id", "n").distinct(), "route_id").withColumn("as_of", F.floor(F.col("t0") / step_ms) * step_ms).withColumn("s", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.col("n") - 1).cast("int") - 1)))
    a = a.withColumn("stop_index", F.pmod(F.col("i0") + F.col("s"), F.col("n"))).join(n.drop("n"), ["route_id", "stop_index"])
    w = Window.partitionBy("origin_id").orderBy("s").rowsBetween(Window.unboundedPreceding, 0)
    hop = ["route_id", "from_stop_id", "to_stop_id", "as_of"]
    for v, t in variants.items():
        a = a.join(t.select(*hop, F.col("mean").alias(f"m_{v}")), hop)
    for v in variants:
        a = a.withColumn(f"p_{v}", F.sum(f"m_{v}").over(w))
    # Only unbroken chains: as many hops joined as steps taken.
    a = a.withColumn("c", F.count(F.lit(1)).over(w)).where(F.col("c") == F.col("s") + 1)
    j = asof_next(a.select("origin_id", "bus_name", "route_id", F.col("to_stop_id").alias("stop_id"), "t0", "s", *[f"p_{v}" for v in variants]),
                  arrivals.select("bus_name", "route_id", "stop_id", "arrived_at"), ["bus_name", "route_id", "stop_id"], "t0", "arrived_at", horizon_ms, strict=True).where("next IS NOT NULL")
    act = (F.col("next._rt") - F.col("t0")) / 1000
    e = j.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), (F.col(f"p_{v}") - act).alias("err")) for v in variants]))).select("route_id", (F.col("s") + 1).alias("ahead"), "_x.*")
    g = e.withColumn("band", F.explode(F.array(F.when(F.col("ahead") == 1, "1").when(F.col("ahead") <= 5, "2-5").otherwise("6-10"), F.lit("all")))).withColumn("a", F.abs("err"))
    q = grouped_quantiles(g, ["variant", "band"], "a", {"median_abs_sec": (0.5, "linear"), "p90_abs_sec": (0.9, "linear")})
    b = g.groupBy("variant", "band").agg(F.avg("err").alias("bias_sec"))
    return q.withColumnRenamed("_n", "n").join(b, ["variant", "band"])


def shapley_r2(m: dict, groups: dict[str, list[str]]) -> dict[str, float]:
    """Shapley shares of R2 over feature groups from one set of moments (M9)."""
    tss = m["y*y"] - m["1*y"] ** 2 / m["1*1"]
    names = list(groups)
    r2 = {}
    for k in range(len(names) + 1):
        for sub in combinations(names, k):
            r2[sub] = 1 - _solve_ols(m, [x for g in sub for x in groups[g]])[1] / tss
    out = {}
    for g in names:
        rest = [x for x in names if x != g]
        out[g] = sum(
            math.factorial(len(s)) * math.factorial(len(names) - len(s) - 1) / math.factorial(len(names)) * (r2[tuple(x for x in names if x in s or x == g)] - r2[tuple(x for x in names if x in s)])
            for k in range(len(rest) + 1) for s in combinations(rest, k))
    return out


def covariate_study(design: DataFrame, y: str, groups: dict[str, list[str]]) -> DataFrame:
    """Share of the variance each feature group explains (M9): one pass of moments, the rest is tiny."""
    xs = [x for g in groups.values() for x in g]
    m = moments(design, xs, y).first().asDict()
    sh = shapley_r2(m, groups)
    total = sum(sh.values())
    return design.sparkSession.createDataFrame([(g, float(v), float(total), int(m["1*1"])) for g, v in sh.items()], "feature_group string, share double, r2 double, n long")
