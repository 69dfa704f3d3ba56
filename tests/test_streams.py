"""Keyed streaming folds on small sources."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators.sequence import recent_speed
from fleetlens.sources import feeds
from fleetlens.streaming import jobs

T0 = 1_700_000_000_000


def run(spark, tmp, parts, schema, build, name):
    src = str(tmp / f"{name}_src")
    for p in parts:
        spark.createDataFrame(p, schema).coalesce(1).write.mode("append").parquet(src)
    st = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = build(st)
    q = out.writeStream.format("parquet").option("path", str(tmp / f"{name}_out")).option("checkpointLocation", str(tmp / f"{name}_ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(str(tmp / f"{name}_out")).collect()


def test_lap_clock_forgets_after_two_hours(spark, tmp_path):
    s = "bus_name string, route_id long, stop_id long, arrived_at long, departed_at long"
    h = 3_600_000
    parts = [[("#1", 1, 5, T0, T0 + 60_000), ("#1", 1, 6, T0 + h // 2, None)], [("#1", 1, 5, T0 + h, T0 + h + 1000)], [("#1", 1, 5, T0 + 4 * h, None)]]
    got = {(r.stop_id, r.arrived_at): r.lap_sec for r in run(spark, tmp_path, parts, s, jobs.lap_clock, "lap")}
    assert got == {(5, T0): None, (6, T0 + h // 2): None, (5, T0 + h): 3540.0, (5, T0 + 4 * h): None}


def test_alerts_cool_down_cap_and_recover(spark, tmp_path):
    s = "id long, line string, received_at long, started_at long, ok boolean, qualifies boolean"
    h = 3_600_000
    rows = [(1, "A", T0, T0, False, True), (2, "A", T0 + h, T0 + h, False, True), (3, "A", T0 + 2 * h, T0 + 2 * h, True, False), (4, "A", T0 + 3 * h, T0 + 3 * h, True, False), (5, "A", T0 + 7 * h, T0 + 7 * h, False, True)]
    got = run(spark, tmp_path, [rows[:2], rows[2:]], s, jobs.alert_stream, "alert")
    assert sorted((r.id, r.kind) for r in got) == [(1, "alert"), (4, "recovered"), (5, "alert")]


def test_roundtrip_stream(spark, tmp_path):
    s = "offer_key string, at_ms long, sec double, anchor long"
    rows = [("k", T0, 300.0, 1), ("k", T0 + 10_000, 900.0, 1), ("k", T0 + 20_000, 282.0, 1), ("k", T0 + 30_000, 900.0, 2)]
    got = run(spark, tmp_path, [rows[:2], rows[2:]], s, lambda d: jobs.roundtrip_stream(d.withColumn("event_time", F.timestamp_millis("at_ms")).withWatermark("event_time", "1 minute")), "rt")
    assert [(r.open_at, r.return_at) for r in got] == [(T0 + 10_000, T0 + 20_000)]


def test_speed_stream_equals_batch(spark, tmp_path):
    pos = [("#1", T0 + i * 5000, 41.31, -72.93 + 0.0005 * i + (0.0002 if i % 3 else 0.0), i) for i in range(20)]
    pos += [("#1", T0 + 200_000 + i * 5000, 41.31, -72.9, 100 + i) for i in range(10)]
    s = "bus_name string, collected_at long, lat double, lon double, ingest_seq long"
    got = {r.collected_at: r.speed_mps for r in run(spark, tmp_path, [pos[:7], pos[7:]], s, jobs.speed_stream, "sp")}
    want = {r.collected_at: r.speed_mps for r in recent_speed(spark.createDataFrame(pos, s)).collect()}
    assert set(got) == set(want) and any(v for v in want.values())
    for t, v in want.items():
        assert got[t] == (pytest.approx(v) if v is not None else None)


def test_curb_stream_settles_and_expires(spark, tmp_path):
    s = "bus_name string, stop_id long, kind string, t_ms long, dist_m double, lat double, lon double, forecast_id long"
    fix = lambda t, d, la: ("#1", 5, "fix", T0 + t, d, la, 0.0, None)
    fc = lambda t, i: ("#1", 5, "forecast", T0 + t, None, None, None, i)
    rows = [fc(0, 1), fix(60_000, 20.0, 1.0), fix(70_000, 20.0, 1.0), fc(80_000, 2), fix(90_000, 20.0, 1.0), fix(3_100_000, 500.0, 2.0)]
    got = run(spark, tmp_path, [rows[:3], rows[3:]], s, lambda d: jobs.curb_stream(d.withColumn("event_time", F.timestamp_millis("t_ms")).withWatermark("event_time", "1 minute")), "curb")
    assert sorted((r.forecast_id, r.curb_at, r.state) for r in got) == [(1, T0 + 60_000, "resolved"), (2, None, "unresolved")]


POLLS = "route_id long, bus_name string, seen_at long, stop_index long, departed_at long, phase string, at_index long, began_at long"


def clocked(spark, tmp_path, rows, name, **scope):
    """rows: (second, phase, index, began) or (second, 'left', stop index, departed)."""
    data = [(1, "#1", T0 + s * 1000, i, T0 + at * 1000, None, None, None) if phase == "left" else (1, "#1", T0 + s * 1000, None, None, phase, i, T0 + at * 1000) for s, phase, i, at in rows]
    half = [r for r in data if r[2] <= T0 + 400_000], [r for r in data if r[2] > T0 + 400_000]
    got = run(spark, tmp_path, [h for h in half if h], POLLS, lambda d: jobs.checkpoint_clock(d, **{"source": 2, "wait": 6, "n": 10, **scope}), name)
    return {(r.seen_at - T0) // 1000: ((r.origin_at - T0) // 1000, r.at_index, r.phase, r.released) for r in got}


def test_checkpoint_clock_trusts_after_ten_minutes(spark, tmp_path):
    rows = [(s, "drive", 3, 60) for s in range(0, 900, 30)] + [(60, "left", 2, 60)]
    got = clocked(spark, tmp_path, rows, "c1")
    assert min(got) == 600 and set(got.values()) == {(60, 3, "drive", False)} and len(got) == 10
    # A hole of more than a minute, or a sighting that comes again, starts anew.
    assert clocked(spark, tmp_path, [r for r in rows if not 500 < r[0] < 570], "c2") == {}
    # An origin is too old after 45 minutes.
    old = [(s, "drive", 3, 60) for s in range(0, 3000, 60)] + [(60, "left", 2, 60)]
    assert max(clocked(spark, tmp_path, old, "c3")) == 60 + 2700


def test_checkpoint_clock_knows_a_release(spark, tmp_path):
    to = [(s, "drive", 3, 60) for s in range(0, 660, 30)] + [(60, "left", 2, 60)]
    # Driving from the waiting place, past it, or its finished departure; and once released, holding before it changes nothing.
    way = [(660, "hold", 6, 650), (690, "drive", 6, 680), (720, "hold", 3, 700), (750, "hold", 8, 740)]
    got = clocked(spark, tmp_path, to + way, "c4")
    assert [got[s][3] for s in (630, 660, 690, 720, 750)] == [False, False, True, True, True]
    done = [(660, "hold", 6, 640), (690, "left", 6, 680), (690, "drive", 5, 685)]
    assert clocked(spark, tmp_path, to + done, "c5")[690] == (60, 5, "drive", True)
    # An origin later than what the vehicle does now says nothing; a new origin is not released.
    again = to + [(660, "drive", 7, 650), (690, "left", 2, 690), (690, "drive", 7, 650), (720, "drive", 2, 690)]
    got = clocked(spark, tmp_path, again, "c6")
    assert got[660][3] is True and 690 not in got and got[720] == (690, 2, "drive", False)
    lap = to + [(660, "drive", 1, 650), (690, "drive", 3, 60)]
    assert 690 in clocked(spark, tmp_path, lap, "c7") and 690 not in clocked(spark, tmp_path, lap, "c8", before_source_resets=True)


def test_position_feed_coerces_and_drops(spark, tmp_path):
    src = tmp_path / "json"
    src.mkdir()
    (src / "a.json").write_text('{"bus_id":"7","bus_name":"#7","route_id":"1","lat":"41.3","lon":"-72.9","heading":"x","collected_at":"1700000000000"}\n{"bus_id":"8","lat":"0","lon":"0","collected_at":"1700000000000"}\n{"bus_id":"9","lat":"bad","lon":"1","collected_at":"1"}\n')
    q = feeds.read_positions_stream(spark, str(src)).writeStream.format("memory").queryName("feed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.bus_id, r.lat, r.heading) for r in spark.table("feed").collect()] == [(7, 41.3, 0.0)]


def test_archive_reads_only_asked_days(spark, tmp_path):
    root = str(tmp_path / "arch")
    for d in ("2024-01-01", "2024-01-02"):
        spark.createDataFrame([(1, "#1", d)], "bus_id long, bus_name string, day string").write.mode("append").partitionBy("day").json(f"{root}/arrivals")
    df = feeds.read_archive(spark, root, "arrivals", ["2024-01-02"])
    assert df.count() == 1 and "PartitionFilters: [isnotnull" in df._jdf.queryExecution().executedPlan().toString().replace("\n", " ")
