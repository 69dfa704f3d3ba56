"""Scalar and order-statistic edges."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions import clock, dist, exprs as E, geo
from fleetlens.functions.quantiles import TEN_KNOTS, grouped_quantiles


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_round_half_up_toward_plus_infinity(spark):
    assert one(spark, E.round1(F.lit(-0.25))) == -0.2
    assert one(spark, E.round1(F.lit(0.25))) == 0.3


def test_horizon_edges(spark):
    rows = spark.createDataFrame([(0.0,), (119.9,), (120.0,), (300.0,), (600.0,), (1800.0,), (1800.1,), (float("nan"),), (None,)], "s double")
    got = [r.h for r in rows.select(E.horizon("s").alias("h")).collect()]
    assert got == ["0-2", "0-2", "2-5", "5-10", "10-30", "10-30", None, None, None]


def test_hour_window_wraps_midnight(spark):
    hrs = spark.range(24).where(E.in_hour_window(F.col("id"), F.lit(0), 1)).collect()
    assert sorted(r.id for r in hrs) == [0, 1, 23]


def test_local_days_of_23_and_25_hours(spark):
    d = spark.createDataFrame([("2024-03-10",), ("2024-11-03",), ("2024-07-01",)], "d string").select(F.col("d").cast("date").alias("d"))
    got = [r.h for r in d.select(((clock.day_end_ms("d") - clock.day_start_ms("d")) / 3_600_000).alias("h")).collect()]
    assert got == [23.0, 25.0, 24.0]


def test_buckets_differ_by_version(spark):
    d = spark.createDataFrame([(0,), (1,), (10,), (11,)], "n int")
    rows = d.select(E.ahead_bucket("n").alias("a"), E.ahead_bucket("n", v2=False).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [("1", None), ("1", "1"), ("10+", "10"), ("10+", "10+")]


def test_normalize_and_names(spark):
    assert one(spark, E.normalize_query(F.lit("  Elena's   COFFEE—bar "))) == "elenas coffee bar"
    assert one(spark, E.norm_bus_name(F.lit(" ##12 "))) == "#12"
    assert one(spark, E.norm_bus_name(F.lit(" ##12 "), True)) == "12"
    assert tuple(one(spark, E.countdown_bucket(F.lit("4 min")))) == (240, 300)


def test_distances_agree(spark):
    a = [F.lit(x) for x in (41.31, -72.93, 41.31, -72.92)]
    m = [one(spark, f(*a)) for f in (geo.metres, geo.haversine, geo.arc_metres)]
    assert all(abs(x - m[0]) < 3 for x in m) and 820 < m[0] < 850


@pytest.mark.parametrize("seed", range(3))
def test_quantiles_match_sorting_with_a_hot_group(spark, seed):
    rnd = random.Random(seed)
    rows = [("hot", round(rnd.gauss(0, 500), 2)) for _ in range(3000)] + [(f"k{rnd.randrange(40)}", float(rnd.randrange(-5, 6))) for _ in range(1000)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(8)
    out = {"lin": (0.37, "linear"), "fl": (0.9, "floor"), "ce": (0.8, "ceil"), "tr": (0.5, "trunc"), "cf": (0.8, "conformal"), "ten": (TEN_KNOTS, "linear")}
    got = {r.k: r for r in grouped_quantiles(df, ["k"], "v", out).collect()}
    by = {}
    for k, v in rows:
        by.setdefault(k, []).append(v)
    assert set(got) == set(by)
    for k, vs in by.items():
        s, n, r = sorted(vs), len(vs), got[k]
        assert r._n == n
        assert r.lin == pytest.approx(np.quantile(s, 0.37))
        assert r.fl == s[math.floor(0.9 * (n - 1))]
        assert r.ce == s[math.ceil(0.8 * n) - 1]
        assert r.tr == s[min(n - 1, math.floor(0.5 * n))]
        assert r.cf == s[min(n - 1, math.ceil((n + 1) * 0.8) - 1)]
        assert r.ten == pytest.approx(list(np.quantile(s, TEN_KNOTS)))


def test_quantiles_of_empty_and_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", 3.0)], "k string, v double")
    r = grouped_quantiles(df, ["k"], "v", {"m": (0.5, "linear")}).collect()
    assert [(x.k, x._n, x.m) for x in r] == [("a", 1, 3.0)]
    assert grouped_quantiles(df.where("false"), ["k"], "v", {"m": (0.5, "linear")}).count() == 0


def test_distribution_round_trip(spark):
    q = F.array(*[F.lit(float(x)) for x in (10, 20, 30, 40, 60, 80, 100, 150, 200, 400)])
    for p in (0.1, 0.45, 0.5, 0.83, 0.99):
        x = one(spark, dist.quantile(q, p))
        assert one(spark, dist.cdf(q, F.lit(x))) == pytest.approx(p, abs=1e-6)
    assert one(spark, dist.survival(q, F.lit(5.0))) == 1.0
    assert one(spark, dist.residual_quantile(q, F.lit(60.0), 0.5)) > 0
