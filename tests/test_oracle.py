"""Registered queries against their SQL in DuckDB on the smallest tables.

``ORACLE_ALL=1`` runs every query; by default a sample of each module.
"""

import datetime
import math
import os

import duckdb
import pytest

from fleetlens.plans import catalog, rehearsal

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SAMPLE = ["a15_scorecard", "a18_official_comparison", "a1_segment_stats", "a2_dwell_stats", "j17_expected_segment", "a20_rider_history", "a25_search_report", "s12_trim_newest", "p1_sanitize_positions",
          "j10_positions_in_window", "j13_journeys", "w3_still_runs", "w8_classify_passes", "a38_conformal", "a43_pinball", "a56_heading_agreement", "j22_identity_clusters"]
NAMES = sorted(catalog.ORACLE) if os.environ.get("ORACLE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in rehearsal.BASE:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.8g}") + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(catalog.ORACLE[name]).columns)
    got = sorted((tuple(norm(x) for x in r) for r in df.select(*cols).collect()), key=repr)
    quoted = ",".join(f'"{c}"' for c in cols)
    want = sorted((tuple(norm(x) for x in r) for r in duck.sql(f"select {quoted} from ({catalog.ORACLE[name]})").fetchall()), key=repr)
    assert got == want
