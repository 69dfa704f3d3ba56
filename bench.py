"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from fleetlens.plans import catalog
from fleetlens.session import get_session

HEADLINE = [
    "a15_scorecard", "a16_scorecard_waits", "j7_truth_join", "a1_segment_stats", "a2_dwell_stats", "a3_stand_tables",
    "j17_expected_segment", "a14_accuracy", "a17_paired_summary", "a18_official_comparison", "a20_rider_history", "a25_search_report",
    "j10_positions_in_window", "j14_nearest_stop", "w3_still_runs", "w4_frozen_runs", "w8_classify_passes", "t2a_v1_transitions",
    "a49_jump_stats", "p1_sanitize_positions", "w19_recent_speed", "a27_emit_alerts", "m6_calibrate_asof_hourly",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-")})
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the JVM's compilers and the Python workers.
    catalog.QUERIES["a17_paired_summary"](spark, sf_dir).collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        if name not in catalog.QUERIES:
            continue
        t = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
