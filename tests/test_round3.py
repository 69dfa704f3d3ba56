"""Findings of the third review."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetlens.operators import events as EV
from fleetlens.operators import quality as Q
from fleetlens.operators import sequence as S
from fleetlens.operators import service_end as SE
from fleetlens.plans import catalog

T0 = 1_704_067_200_000


def test_end_of_service_windows_are_not_broadcast(spark):
    """rows that a generator multiplies look small to the planner; no join may take them to the driver."""
    minutes = spark.range(3).select(F.concat(F.lit("#"), F.col("id").cast("string")).alias("bus_name"), F.lit(1).cast("long").alias("route_id"), F.explode(F.sequence(F.lit(0), F.lit(89))).alias("k"))
    pos = minutes.select("bus_name", "route_id", (F.lit(T0) + F.col("k") * 60_000).alias("collected_at"), F.col("k").cast("long").alias("ingest_seq"))
    feed = pos.select(F.col("bus_name").alias("bus"), (F.col("collected_at") + 7000).alias("at"), F.lit(60.0).alias("sec"))
    w = SE.eos_windows(pos, feed)
    assert "BroadcastHashJoin" not in w._jdf.queryExecution().executedPlan().toString()
    assert w.where("kind = 'control'").count() == 6


def test_feed_priors_take_two_fixes_of_one_instant(spark):
    """no speed lies between two fixes of one instant; the others keep theirs."""
    ring = spark.createDataFrame([(1, i, 10 + i, 41.3 + i * 0.004, -72.95, 3) for i in range(3)], "route_id long, stop_index long, stop_id long, lat double, lon double, ring_size long")
    pos = spark.createDataFrame([(1, "#1", 1, 41.3, -72.95, 10, T0), (2, "#1", 1, 41.3001, -72.95, 10, T0), (3, "#1", 1, 41.3002, -72.95, 10, T0 + 5000)],
                                "ingest_seq long, bus_name string, route_id long, lat double, lon double, last_stop_id long, collected_at long")
    (r,) = Q.feed_priors(pos, ring).collect()
    assert (r.fix, r.ahead, r.n) == ("fresh", "0", 2) and abs(r.mean_mps - 11.132 / 5) < 1e-6


def test_a_restart_joins_only_its_own_rows(spark):
    """two vehicles arrive at one instant, and a restart re-issued the row of one of them."""
    a = spark.createDataFrame([(1, "#1", 1, 1, T0, None), (2, "#1", 1, 1, T0 + 60_000, T0 + 90_000), (3, "#2", 1, 1, T0, None), (4, "#2", 1, 1, T0 + 60_000, T0 + 90_000)],
                              "id long, bus_name string, route_id long, stop_id long, arrived_at long, departed_at long")
    own = S.merge_split_arrivals(a, a.where("id = 2").select("arrived_at", "bus_name", "id"))
    assert sorted((r.bus_name, r.id, r.parts) for r in own.collect()) == [("#1", 1, 2), ("#2", 3, 1), ("#2", 4, 1)]
    instants = S.merge_split_arrivals(a, a.where("id = 2").select("arrived_at"))
    assert sorted((r.bus_name, r.parts) for r in instants.collect()) == [("#1", 2), ("#2", 2)]


def test_skip_notices_classify_their_passes():
    """the notices read the passes of visits and fixes, not verdicts by id."""
    assert all(t in catalog.ORACLE["w10_stop_skip_notices"] for t in ("stop_visits", "positions"))


def test_a_batch_of_units_is_one_frame(monkeypatch):
    """Short units share a frame; a frame for each cost far more than its fold."""
    made = []
    frame = EV._frame
    monkeypatch.setattr(EV, "_frame", lambda rows: made.append(len(rows)) or frame(rows))
    fix = {"route_id": 1, "lat": 41.3, "lon": -72.95, "dists": [0.0, 500.0], "stops": [7, 8], "session": 0, "unit": 0, "state": None}
    pdf = pd.DataFrame([{**fix, "bus_id": u, "bus_name": f"#{u}", "collected_at": T0 + k * 5000} for u in range(20) for k in range(3)])
    out = EV._fold_units(pdf, np.arange(0, 60, 3))
    assert len(made) == 1 and len(out) == made[0]
    assert (out.kind == "state").sum() == 20 and set(out.bus_name) == {f"#{u}" for u in range(20)}


def test_trailing_speed_moves_its_fixes_once(spark):
    """one exchange, and an hour's edge changes no speed."""
    hour = T0 + 3_600_000
    rows = [(f"#{o}", k, hour + o + k * 5000, 41.3 + k * 0.0004, -72.95) for o in (-40_000, 600_000) for k in range(16)]
    d = S.recent_speed(spark.createDataFrame(rows, "bus_name string, ingest_seq long, collected_at long, lat double, lon double"))
    assert d._jdf.queryExecution().sparkPlan().toString().count("Window") and d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.bus_name, r.ingest_seq): r.speed_mps for r in d.collect()}
    assert all(got["#-40000", k] == got["#600000", k] for k in range(16)) and abs(got["#-40000", 10] - 0.0004 * 111_320 / 5) < 1e-6
