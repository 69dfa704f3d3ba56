"""Third review, second part: steps that grew faster than their input."""

from __future__ import annotations

import numpy as np

from fleetlens.operators import quality as Q
from fleetlens.operators import scan
from fleetlens.operators import sequence as S


def test_leg_inference_keeps_its_geometry_small(spark):
    """the legs' geometry was one expression, repeated by its filter, that the JVM ran uncompiled."""
    corners = [(41.300, -72.950), (41.302, -72.950), (41.302, -72.947), (41.300, -72.947)]
    ring = spark.createDataFrame([(1, i, 10 + i, la, lo) for i, (la, lo) in enumerate(corners)], "route_id long, stop_index long, stop_id long, lat double, lon double")
    hops = spark.createDataFrame([(1, i, 60.0, 0.0) for i in range(4)], "route_id long, stop_index long, sec double, stand double")
    pos = spark.createDataFrame([("#7", 1, 41.3001, -72.9499, 0.0, 100_000, 1), ("#7", 1, 41.301, -72.9485, 0.0, 400_000, 2)],
                                "bus_name string, route_id long, lat double, lon double, heading double, collected_at long, ingest_seq long")
    feed = spark.createDataFrame([("7", 11, 99_000, 30.0), ("7", 12, 99_000, 90.0)], "bus string, stop_id long, at long, sec double")
    got = Q.leg_inference(pos, feed, ring, hops)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000, len(plan)
    # Close to legs 0 and 3 (and no other); the promises to stops 11 and 12 fit leg 0; the second fix is far from all.
    assert [tuple(r) for r in got.collect()] == [("#7", 1, 1, 100_000, [0, 3], 0, 0, 0)]


def _tracks(spark, n=400):
    rows = [(f"#{b}", b, 1, 41.3 + (k // 7) * 0.0005, -72.95, 3_600_000 * 9 + k * 25_000 + (k // 40) * 90_000 + b, k * 10 + b) for b in (1, 2) for k in range(n)]
    return spark.createDataFrame(rows, "bus_name string, bus_id long, route_id long, lat double, lon double, collected_at long, ingest_seq long")


def test_still_runs_number_only_what_nears_an_hours_edge(spark, monkeypatch):
    """stretches inside an hour are settled in one exchange; those at its edges still come out whole."""
    seen = []
    islands = scan.islands
    monkeypatch.setattr(scan, "islands", lambda d, *a, **k: seen.append(d.count()) or islands(d, *a, **k))
    pos = _tracks(spark)
    got = {(r.bus_name, r.ingest_seq): r.still for r in S.still_runs(pos).collect()}
    assert len(got) == 800 and 0 < seen[0] < 800
    for b in (1, 2):
        p = pos.where(f"bus_id = {b}").orderBy("collected_at").toPandas()
        t = p.collected_at.to_numpy()
        starts = np.r_[0, np.flatnonzero(np.diff(t) > 60_000) + 1]
        assert [got[f"#{b}", s] for s in p.ingest_seq] == S.still_mask(p.lat.to_numpy(), p.lon.to_numpy(), t, starts).tolist()


def test_near_shifts_are_shifts(spark):
    """a neighbour within reach is found across the hour's edge, in one exchange and without a join."""
    pos = _tracks(spark)
    for lead in (False, True):
        near = scan.shifted_near(pos, S.TRACK, S.T_ORDER, {"o": "collected_at"}, 60_000, lead=lead)
        want = scan.shifted(pos, S.TRACK, S.T_ORDER, {"o": "collected_at"}, lead=lead)
        pick = lambda d: sorted(tuple(r) for r in d.where("abs(o - collected_at) <= 60000").select("ingest_seq", "o").collect())
        assert pick(near) == pick(want) and len(pick(near)) > 700
        assert near._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_fold_frames_seek_their_near_places_once(spark):
    """the places near a fix were sought again for every pair of them."""
    ring = spark.createDataFrame([(1, i, 10 + i, 41.3 + (i % 2) * 0.0001, -72.95) for i in range(5)], "route_id long, stop_index long, stop_id long, lat double, lon double")
    got = Q.fold_frames(spark.createDataFrame([(1, 41.3, -72.95), (1, 42.0, -72.95)], "route_id long, lat double, lon double"), ring)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("COS(") == 2  # one distance
    assert [tuple(r) for r in got.collect()] == [(1, 2, 1)]
