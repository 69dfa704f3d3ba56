"""All registered queries in one place."""

from __future__ import annotations

from fleetlens.plans import (
    calibrate_queries,
    event_queries,
    model_queries,
    network_queries,
    quality_queries,
    rider_queries,
    scoring_queries,
    sequence_queries,
    table_queries,
)

MODULES = [scoring_queries, calibrate_queries, rider_queries, table_queries, network_queries, sequence_queries,
           event_queries, model_queries, quality_queries]

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _m in MODULES:
    QUERIES.update(_m.QUERIES)
    ORACLE.update(_m.ORACLE)
