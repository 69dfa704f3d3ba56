"""Scorecard edges and incremental scoring."""

from pyspark.sql import functions as F

from fleetlens.operators import scoring as S
from fleetlens.plans.rehearsal import frame
from fleetlens.sources import tables as T
from fleetlens.streaming import jobs

SF = "/root/testdata/sf0.001"
P = "id long, bus_id long, bus_name string, route_id long, to_stop_id long, predicted_sec double, predicted_low_sec double, predicted_high_sec double, predicted_at long, client_build string, surface string"
A = "bus_name string, route_id long, stop_id long, arrived_at long, departed_at long"
T0 = 1_700_000_000_000


def pred(i, at, sec, surface="trip", stop=1, build=None):
    return (i, 7, "#7", 1, stop, float(sec), float(sec) * 0.8, float(sec) * 1.2, T0 + at * 1000, build, surface)


def cells(spark, preds, arr):
    a = spark.createDataFrame([("#7", 1, s, T0 + x * 1000, None if d is None else T0 + d * 1000) for s, x, d in arr], A)
    return {(r.route_id, r.horizon, r.surface): r for r in S.scorecard(spark.createDataFrame(preds, P), a).collect()}


def test_standing_is_not_a_forecast_and_beyond_only_pools(spark):
    c = cells(spark, [pred(1, 100, 60), pred(2, 100, 1900), pred(3, 5000, 60)], [(1, 50, 200)])
    allc = c[(1, "all", "trip")]
    assert (allc.n, allc.standing, allc.beyond, allc.missing, allc.paired) == (3, 1, 1, 1, 0)
    assert (1, "10-30", "trip") not in c and c[(0, "all", "ours")].n == 3


def test_arrival_at_the_promise_instant_counts(spark):
    c = cells(spark, [pred(1, 100, 30)], [(1, 100, 110)])
    assert c[(1, "all", "trip")].paired == 1 and c[(1, "all", "trip")].median_signed_sec == 30.0


def test_jump_and_strand(spark):
    # Promises 60 s, then 300 s a minute before the bus comes: a jump, and still minutes at the end.
    c = cells(spark, [pred(1, 0, 60), pred(2, 60, 300)], [(1, 120, 130)])
    a = c[(1, "all", "trip")]
    assert (a.jump_pairs, a.jumps, a.waits, a.strands) == (1, 1, 1, 1)
    assert c[(1, "0-2", "trip")].jumps == 1 and c[(1, "5-10", "trip")].jumps == 0 and c[(1, "5-10", "trip")].waits == 0


def test_a_standing_row_ends_a_wait(spark):
    c = cells(spark, [pred(1, 0, 60), pred(2, 90, 60), pred(3, 200, 60)], [(1, 80, 100), (1, 260, 300)])
    assert c[(1, "all", "trip")].waits == 2 and c[(1, "all", "trip")].jump_pairs == 0


def test_builds_map_most_used_first(spark):
    p = spark.createDataFrame([pred(1, 0, 60, build="x"), pred(2, 15, 60, build="y"), pred(3, 30, 60, build="y")], P)
    b = S.scorecard_builds(p)
    m = S.with_builds(b.select(*S.CELL).distinct(), b).where("horizon = 'all' AND route_id = 0 AND surface = 'ours'").select(F.map_entries("builds").alias("e")).first().e
    assert [tuple(x) for x in m] == [("y", 2), ("x", 1)]


def test_hour_by_hour_equals_one_pass(spark, tmp_path):
    preds = frame(spark, SF, "looks").where("predicted_at < 1704240000000").cache()
    vis = frame(spark, SF, "arrivals").where("arrived_at < 1704250000000").cache()
    end = 1_704_260_000_000
    once, inc = str(tmp_path / "once"), str(tmp_path / "inc")
    jobs.score_days(preds, vis, end, once)
    for t in range(end - 3 * 40_000_000, end + 1, 40_000_000):
        jobs.score_days(preds.where(F.col("predicted_at") < t), vis.where(F.col("arrived_at") < t), t, inc)
    a, b = spark.read.parquet(once), spark.read.parquet(inc)
    cols = sorted(set(a.columns) - {"scored_through", "final"})
    assert a.count() > 20
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0 and b.select(*cols).exceptAll(a.select(*cols)).count() == 0


def test_overwrite_day_leaves_other_arms(spark, tmp_path):
    path = str(tmp_path / "t")
    d = lambda day, arm, v: spark.createDataFrame([(day, arm, v)], "day string, arm_kind string, v int").withColumn("day", F.col("day").cast("date"))
    T.overwrite_day(d("2024-01-01", "live", 1).unionByName(d("2024-01-01", "replay", 2)).unionByName(d("2024-01-02", "live", 3)), path)
    T.overwrite_day(d("2024-01-01", "live", 9), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3, 9]


def test_shared_arms_are_withheld_when_thin(spark):
    p = spark.createDataFrame([pred(1, 0, 60), pred(2, 1, 60, "upstream")], P)
    a = spark.createDataFrame([("#7", 1, 1, T0 + 100_000, None)], A)
    assert S.official_comparison(p, a).count() == 0
    assert S.official_comparison(p, a, min_pairs=1).count() == 4
