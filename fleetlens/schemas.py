"""Canonical table schemas. Clocks are epoch milliseconds (UTC)."""

from __future__ import annotations

from pyspark.sql import types as T

_L, _D, _S, _I, _B = T.LongType(), T.DoubleType(), T.StringType(), T.IntegerType(), T.BooleanType()


def _t(**cols) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in cols.items()])


POSITION = _t(bus_id=_L, bus_name=_S, route_id=_L, lat=_D, lon=_D, heading=_D, last_stop_id=_L, collected_at=_L, ingest_seq=_L)
STOP = _t(stop_id=_L, name=_S, lat=_D, lon=_D, updated_at=_L)
ROUTE = _t(route_id=_L, name=_S, short_name=_S, color=_S, stops=T.ArrayType(_L),
           path=T.ArrayType(_t(lat=_D, lon=_D)), updated_at=_L)
ARRIVAL = _t(id=_L, bus_id=_L, bus_name=_S, route_id=_L, stop_id=_L, arrived_at=_L, departed_at=_L, dwell_sec=_D, dow=_I, hour=_I)
SEGMENT = _t(id=_L, bus_id=_L, bus_name=_S, route_id=_L, from_stop_id=_L, to_stop_id=_L, travel_sec=_D, started_at=_L, dow=_I, hour=_I)
STOP_VISIT = _t(id=_L, bus_id=_L, bus_name=_S, anchor_bus_id=_L, route_id=_L, stop_id=_L, stop_index=_L, anchored_at=_L,
                pinned_at=_L, arrived_at=_L, departed_at=_L, stand_sec=_D, inside_sec=_D, outcome=_S, how=_S, confidence=_D,
                first_step_m=_D, steps=_I, far_m=_D, confirm_sec=_D, rest_polls=_I, shuffles=_I, first_moved_at=_L,
                last_at_rest_at=_L, closest_m=_D, dow=_I, hour=_I)
LEG = _t(id=_L, bus_id=_L, bus_name=_S, route_id=_L, from_stop_id=_L, from_index=_L, to_stop_id=_L, to_index=_L, hops=_I,
         departed_at=_L, arrived_at=_L, to_pinned_at=_L, leg_sec=_D, hold_sec=_D, drive_sec=_D, holds=_I, reached=_B, dow=_I, hour=_I)
PREDICTION = _t(id=_L, bus_id=_L, bus_name=_S, route_id=_L, from_stop_id=_L, to_stop_id=_L, stops_ahead=_I, predicted_sec=_D,
                predicted_low_sec=_D, predicted_high_sec=_D, predicted_at=_L, client_build=_S, surface=_S)
CENSUS = _t(id=_L, sampled_at=_L, calc_at=_L, stop_id=_L, route_id=_L, bus_id=_L, bus_name=_S, eta_min=_I, eta_sec=_I, probe=_I, raw=_S)
REPORT = _t(id=_L, created_at=_L, kind=_S, route_id=_L, body=_S, context=_S, status=_S, priority=_I, note=_S, anon_id=_S)

# Archived tables and the epoch column that dates each row.
ARCHIVED: dict[str, tuple[T.StructType, str]] = {
    "positions": (POSITION, "collected_at"),
    "arrivals": (ARRIVAL, "arrived_at"),
    "segments": (SEGMENT, "started_at"),
    "stop_visits": (STOP_VISIT, "anchored_at"),
    "legs": (LEG, "departed_at"),
    "predictions": (PREDICTION, "predicted_at"),
    "census": (CENSUS, "sampled_at"),
}
