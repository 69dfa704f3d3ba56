"""As-of, scan and range operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import asof, passes, planning, ranges, scan, sequence, topology

H = 3_600_000


def data(seed, n=400):
    rnd = random.Random(seed)
    key = lambda: "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(6)}"
    left = [(i, key(), rnd.randrange(0, 20 * H)) for i in range(n)]
    right = sorted({(key(), rnd.randrange(0, 20 * H)) for _ in range(n)})
    right = [(k, t, None if rnd.random() < 0.2 else t + rnd.randrange(0, H)) for k, t in right]
    left += [(n + i, k, t) for i, (k, t, _) in enumerate(right[:40])]
    return left, right


@pytest.mark.parametrize("seed", range(2))
def test_asof_and_truth_match_loops(spark, seed):
    left, right = data(seed)
    l = spark.createDataFrame(left, "id long, k string, at long")
    r = spark.createDataFrame(right, "k string, arrived_at long, departed_at long")
    nxt = {x.id: x.next._rt if x.next else None for x in asof.asof_next(l, r, ["k"], "at", "arrived_at", 2 * H).collect()}
    strict = {x.id: x.next._rt if x.next else None for x in asof.asof_next(l, r, ["k"], "at", "arrived_at", 2 * H, strict=True).collect()}
    prv = {x.id: x.prev._rt if x.prev else None for x in asof.asof_prev(l, r, ["k"], "at", "arrived_at", 2 * H, lag_ms=120_000).collect()}
    anyn = {x.id: x.next._rt if x.next else None for x in asof.asof_next_any(l, r.withColumn("rid", F.col("arrived_at")), ["k"], "at", "arrived_at", [], "rid", cell_ms=H).collect()}
    tr = {x.id: (x.truth, x.actual_at) for x in asof.truth_join(l, r, ["k"], "at").collect()}
    assert len(nxt) == len(left)
    for i, k, at in left:
        ts = sorted(t for kk, t, _ in right if kk == k)
        ok = [t for t in ts if at <= t <= at + 2 * H]
        assert nxt[i] == (ok[0] if ok else None)
        ok = [t for t in ts if at < t <= at + 2 * H]
        assert strict[i] == (ok[0] if ok else None)
        ok = [t for t in ts if at - 120_000 - 2 * H <= t <= at - 120_000]
        assert prv[i] == (ok[-1] if ok else None)
        ok = [t for t in ts if t >= at]
        assert anyn[i] == (ok[0] if ok else None)
        before = [(t, d) for kk, t, d in right if kk == k and t < at]
        want = ("missing", None)
        if before and (max(before)[1] is None or max(before)[1] >= at) and at - max(before)[0] <= 2 * H:
            want = ("standing", None)
        elif ok and ok[0] - at <= 45 * 60_000:
            want = ("arrived", ok[0])
        assert tr[i] == want


@pytest.mark.parametrize("cell", [1000, 50_000, 10**9])
def test_scans_do_not_depend_on_the_cells(spark, cell):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b"]), rnd.randrange(0, 300_000), rnd.choice([None, 1, 2, 3])) for i in range(300)]
    d = spark.createDataFrame(rows, "id long, k string, t long, v long")
    lag = {r.id: (r.p, r.pt) for r in scan.shifted(d, ["k"], ["t", "id"], {"p": "v", "pt": "t"}, cell_ms=cell).collect()}
    lead = {r.id: r.n for r in scan.shifted(d, ["k"], ["t", "id"], {"n": "t"}, cell_ms=cell, lead=True).collect()}
    last = {r.id: r.l for r in scan.carried_last(d, ["k"], ["t", "id"], {"l": "v"}, cell_ms=cell).collect()}
    first = {r.id: r.f for r in scan.carried_first(d, ["k"], ["t", "id"], {"f": "v"}, cell_ms=cell).collect()}
    run = {r.id: r.s for r in scan.running_sum(d.withColumn("one", F.lit(1)), ["k"], ["t", "id"], {"s": "one"}, cell_ms=cell).collect()}
    for k in "ab":
        seq = sorted([r for r in rows if r[1] == k], key=lambda r: (r[2], r[0]))
        for i, r in enumerate(seq):
            assert lag[r[0]] == ((seq[i - 1][3], seq[i - 1][2]) if i else (None, None))
            assert lead[r[0]] == (seq[i + 1][2] if i + 1 < len(seq) else None)
            assert run[r[0]] == i + 1
            seen = [x[3] for x in seq[:i] if x[3] is not None]
            assert last[r[0]] == (seen[-1] if seen else None)
            ahead = [x[3] for x in seq[i + 1:] if x[3] is not None]
            assert first[r[0]] == (ahead[0] if ahead else None)


def test_islands_number_runs(spark):
    d = spark.createDataFrame([(1, "a", 0, True), (2, "a", 10, False), (3, "a", 5000, True), (4, "a", 9000, False)], "id long, k string, t long, s boolean")
    got = {r.id: r.run for r in scan.islands(d, ["k"], ["t", "id"], "s", "run", cell_ms=1000).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2}


def test_interval_join_keeps_every_match_once(spark):
    iv = spark.createDataFrame([(1, "a", 0, 9_999), (2, "a", 5_000, 5_000), (3, "b", 0, 100)], "iv long, k string, lo long, hi long")
    pt = spark.createDataFrame([("a", 0), ("a", 5_000), ("a", 9_999), ("a", 10_000), ("b", 50)], "k string, at long")
    got = sorted((r.iv, r.at) for r in ranges.interval_join(iv, pt, ["k"], "lo", "hi", "at", 3_000).collect())
    assert got == [(1, 0), (1, 5_000), (1, 9_999), (2, 5_000), (3, 50)]


def ring3(spark, n=3):
    return spark.createDataFrame([(1, i, 10 + i, 41.31, -72.93 + 0.01 * i, n) for i in range(n)], "route_id long, stop_index long, stop_id long, lat double, lon double, ring_size long")


def test_ring_successor_and_hops(spark):
    r = ring3(spark)
    assert sorted((x.stop_id, x.next_stop_id) for x in topology.next_stop(r).collect()) == [(10, 11), (11, 12), (12, 10)]
    p = spark.createDataFrame([(1, 12, 11), (1, 10, 10), (1, 10, 99)], "route_id long, from_stop_id long, to_stop_id long")
    assert sorted(((x.from_stop_id, x.to_stop_id, x.hops) for x in topology.hops_forward(p, r).collect()), key=str) == sorted([(12, 11, 2), (10, 10, 0), (10, 99, None)], key=str)


def test_still_runs_match_a_plain_loop():
    import numpy as np
    rnd = random.Random(3)
    n = 300
    lat = np.cumsum([rnd.choice([0, 0, 0, 0.0001, 0.0004]) for _ in range(n)]) + 41.3
    lon = np.full(n, -72.9)
    t = np.cumsum([5000] * n)
    starts = np.array([0, 120, 121])
    got = sequence.still_mask(lat, lon, t, starts)
    want = np.zeros(n, bool)
    ends = [*starts[1:], n]
    for a, b in zip(starts, ends):
        for i in range(a, b):
            j = i
            while j + 1 < b and 6371000 * np.radians(abs(lat[j + 1] - lat[i])) <= 25:
                j += 1
            if t[j] - t[i] >= 15000:
                want[i:j + 1] = True
    assert (got == want).all()


def test_skip_notice_needs_two_of_three_and_a_skipped_latest(spark):
    s = "id long, route_id long, stop_id long, at long, verdict string"
    base = [(1, 1, 11, 100, "skipped"), (2, 1, 11, 200, "served"), (3, 1, 11, 300, "skipped"), (4, 1, 10, 250, "served"), (5, 1, 12, 100, "skipped"), (6, 1, 12, 200, "served")]
    stops = ring3(spark).select("stop_id", "lat", F.lit(-72.93).alias("lon"))
    got = passes.stop_skip_notices(spark.createDataFrame(base, s), ring3(spark), stops, 1000).collect()
    assert [(r.stop_id, r.skipped, r["of"], r.last_at, r.alt) for r in got] == [(11, 2, 3, 300, 10)]
    later = base + [(7, 1, 11, 400, "served")]
    assert passes.stop_skip_notices(spark.createDataFrame(later, s), ring3(spark), stops, 1000).count() == 0


def test_journey_chains_break_on_ambiguity(spark):
    v = "id long, bus_name string, route_id long, stop_index long, anchored_at long, pinned_at long, arrived_at long, departed_at long, outcome string, how string, closest_m double"
    visits = [(1, "b", 1, 0, 0, 0, 0, 100, "stopped", "far", 5.0), (2, "b", 1, 1, 200, 200, 200, 300, "passed", "far", 5.0), (3, "b", 1, 2, 500, 500, 500, 900, "stopped", "far", 5.0),
              (4, "c", 1, 0, 0, 0, 0, 100, "stopped", "far", 5.0), (5, "c", 1, 1, 200, 200, 200, 300, "stopped", "gap", 5.0), (6, "c", 1, 2, 500, 500, 500, 900, "stopped", "far", 5.0)]
    lg = "bus_name string, route_id long, from_index long, to_index long, hops long, departed_at long, arrived_at long"
    legs = [(b, 1, 0, 1, 1, 100, 200) for b in "bc"] + [(b, 1, 1, 2, 1, 300, 500) for b in "bc"]
    got = planning.journeys(spark.createDataFrame(visits, v), spark.createDataFrame(legs, lg), 1, 0, 2, 3).collect()
    assert [(r.bus_name, r.arrived_at, r.actual_sec) for r in got] == [("b", 500, 0.4)]
    stood = planning.journeys(spark.createDataFrame(visits, v), spark.createDataFrame(legs, lg), 1, 0, 2, 3, elapsed_sec=0.05).collect()
    assert [(r.started_at, r.actual_sec) for r in stood] == [(50, 0.45)]
