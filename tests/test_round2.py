"""Cases where a cap, a tie or a missing rule once gave wrong answers."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import exprs as E
from fleetlens.operators import matching, models, monitor, passes
from fleetlens.operators.sequence import recent_speed
from fleetlens.streaming import jobs

T0 = 1_700_000_000_000
H = 3_600_000


def test_one_long_chain_is_one_cluster(spark):
    ids = list(range(1500))
    random.Random(4).shuffle(ids)
    rows = [("2024-01-01", ids[i + k], f"#{i}") for i in range(len(ids) - 1) for k in (0, 1)]
    got = models.identity_clusters(spark.createDataFrame(rows, "day string, bus_id long, bus_name string"))
    assert got.count() == 2 * len(ids) - 1 and got.select("cluster").distinct().count() == 1


def test_runs_under_the_daily_cap_start_no_silence(spark):
    """Six lines alert in the evening; the seventh is capped at 20:00 and may alert at 00:30."""
    seven = 1_700_006_400_000  # 2023-11-14 19:00 in New York
    runs = [(i, f"L{i}", seven + i * 1000) for i in range(6)] + [(6, "X", seven + H), (7, "X", seven + 5 * H + H // 2), (8, "L0", seven + 5 * H + H // 2), (9, "L0", seven + 7 * H)]
    d = spark.createDataFrame(runs, "id long, line string, received_at long").withColumn(
        "jumps", F.array(F.struct(F.lit(0).alias("at_ms"), F.lit(60).alias("from_sec"), F.lit(200).alias("drift_sec"), F.lit(False).alias("announced"))))
    sent = sorted(r.id for r in monitor.emit_alerts(d).collect())
    assert sent == [0, 1, 2, 3, 4, 5, 7, 9]
    st, folded = None, []
    for i, line, t in sorted(runs, key=lambda r: (r[2], r[0])):
        st, got = jobs._fold_alert(st, (i, line, t, True, False, "14" if t < seven + 5 * H else "15"))
        folded += [x[2] for x in got if x[1] == "alert"]
    assert sorted(folded) == sent


def _anchor_case(spark, fixes):
    ring = spark.createDataFrame([(1, i, 10 + i) for i in range(8)], "route_id long, stop_index long, stop_id long")
    stops = spark.createDataFrame([(10 + i, 41.0 + 0.01 * i, -72.9) for i in range(8)], "stop_id long, lat double, lon double")
    # Near at 2, then a far 3, a far 1 and a near 3: the far ones between are an excursion.
    rows = [(1, 12, 2, 0, 10.0), (2, 13, 3, 60, 400.0), (3, 11, 1, 120, 300.0), (4, 13, 3, 180, 20.0), (5, 14, 4, 400, 30.0)]
    v = spark.createDataFrame([(i, 7, 1, stop, idx, T0 + s * 1000, m) for i, stop, idx, s, m in rows],
                              "id long, bus_id long, route_id long, stop_id long, stop_index long, anchored_at long, closest_m double")
    pos = spark.createDataFrame([(7, T0 + s * 1000, k, la, -72.9) for k, (s, la) in enumerate(fixes)], "bus_id long, collected_at long, ingest_seq long, lat double, lon double")
    return sorted(r.id for r in passes.resolve_anchor_returns(v, ring, stops, pos).collect())


def test_anchor_returns_need_fixes_without_a_hole(spark):
    steady = [(s, 41.02 + 0.01 * min(s, 190) / 190) for s in range(0, 200, 20)] + [(200, 41.03)]
    assert _anchor_case(spark, steady) == [1, 4, 5]
    assert _anchor_case(spark, [f for f in steady if not 40 <= f[0] <= 120]) == [1, 2, 3, 4, 5]  # a hole before the return
    assert _anchor_case(spark, [(200, 41.03)]) == [1, 2, 3, 4, 5]


def test_speed_ignores_late_fixes_and_keeps_the_whole_window():
    st, out = None, []
    for k in range(160):  # four fixes a second
        st, got = jobs._fold_speed(st, (T0 + k * 250, 41.3 + k * 2.5e-6, -72.9))
        out += got
    assert out[-1][1] == pytest.approx(111_320 * 2.5e-6 * 4, rel=0.01)
    again, got = jobs._fold_speed(st, (T0 + 5_000, 41.0, -72.0))
    assert again == st and got == [(T0 + 5_000, None)]


def test_speed_extent_counts_from_the_start_of_the_window(spark):
    """Out and back within the window: the last fix lies where the first did, the extent does not."""
    pos = [("#1", T0 + i * 5000, 41.31 + 0.0001 * min(i, 6 - i), -72.93, i) for i in range(7)]
    got = {r.collected_at: r.speed_mps for r in recent_speed(spark.createDataFrame(pos + [("#1", T0 + 30_000, 0.0, 0.0, 99)], "bus_name string, collected_at long, lat double, lon double, ingest_seq long")).where("ingest_seq < 99").collect()}
    assert got[T0 + 30_000] == pytest.approx(111_320 * 0.0006 / 30, rel=0.01)


def test_more_than_two_edits_are_refused(spark):
    d = spark.createDataFrame([(1, "union station")], "query_id long, q string")
    with pytest.raises(ValueError):
        matching.resolve_queries(d, d.select(F.col("query_id").alias("name_id"), F.col("q").alias("name")), max_edits=3)


def test_open_days_are_scored_again_by_the_clock_with_their_census(spark, tmp_path):
    day, path = 1_700_020_800_000, str(tmp_path / "cells")  # around 23:00 local
    preds = spark.createDataFrame([(1, 5, "#5", 1, 10, 11, 1, 300.0, 200.0, 400.0, day, "b1", "trip")],
                                  "id long, bus_id long, bus_name string, route_id long, from_stop_id long, to_stop_id long, stops_ahead int, predicted_sec double, predicted_low_sec double, predicted_high_sec double, predicted_at long, client_build string, surface string")
    census = spark.createDataFrame([(1, day + 60_000, day + 50_000, 11, 1, 5, "#5", 240)], "id long, sampled_at long, calc_at long, stop_id long, route_id long, bus_id long, bus_name string, eta_sec long")
    none = spark.createDataFrame([], "id long, bus_name string, route_id long, stop_id long, arrived_at long, departed_at long")
    one = spark.createDataFrame([(1, "#5", 1, 11, day + 320_000, day + 330_000)], none.schema)
    days = [r[0] for r in preds.select(F.to_date(F.from_utc_timestamp(F.timestamp_millis("predicted_at"), "America/New_York"))).collect()]
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    args = dict(read_preds=lambda d: preds, path=path, read_census=lambda d: census)
    jobs.settle(spark, days, day + 10 * 60_000, read_visits=lambda d: none, **args)
    assert jobs.open_days(spark, path) == []  # nothing is settled yet
    jobs.settle(spark, days, day + 60 * 60_000, read_visits=lambda d: one, **args)
    surfaces = lambda: {r.surface for r in spark.read.parquet(path).select("surface").distinct().collect()}
    assert jobs.open_days(spark, path) == days and surfaces() >= {"trip", E.CENSUS}
    jobs.settle(spark, [], day + 30 * H, read_visits=lambda d: one, **args)
    assert jobs.open_days(spark, path) == [] and surfaces() >= {"trip", E.CENSUS}
