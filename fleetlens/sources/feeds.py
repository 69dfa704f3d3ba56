"""Feed and archive readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.functions import clock
from fleetlens.operators.grain import latest_by, top_n
from fleetlens.schemas import ARCHIVED, POSITION

# The wire carries numbers as text; every field is read as a string and coerced per row.
POSITION_WIRE = T.StructType([T.StructField(f.name, T.StringType()) for f in POSITION.fields])


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per-row coercion of textual numbers; a value that does not parse becomes null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields
    ])


def read_positions_stream(spark: SparkSession, path: str, fmt: str = "json", late: str = "2 minutes", **opts) -> DataFrame:
    """Vehicle polls as an event-time stream (S1); any file or message source with these fields fits."""
    raw = spark.readStream.schema(POSITION_WIRE if fmt == "json" else POSITION).options(**opts).format(fmt).load(path)
    p = sanitize_fixes(coerce(raw, POSITION))
    return p.withColumn("event_time", F.timestamp_millis("collected_at")).withWatermark("event_time", late)


def sanitize_fixes(df: DataFrame) -> DataFrame:
    ok = (
        F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon")
        & (F.abs("lat") <= 90) & (F.abs("lon") <= 180) & ~((F.col("lat") == 0) & (F.col("lon") == 0))
        & F.col("bus_id").isNotNull()
    )
    return df.where(ok).withColumn("heading", F.coalesce(F.when(~F.isnan("heading"), F.col("heading")), F.lit(0.0)))


def sanitize_positions(df: DataFrame) -> DataFrame:
    """Finite fixes on the globe; the last row of a vehicle in a poll wins."""
    return latest_by(sanitize_fixes(df), ["bus_id", "collected_at"], "ingest_seq")


def read_routes(spark: SparkSession, path: str) -> DataFrame:
    """Topology JSON: stop list and a flat [lat, lon, ...] path."""
    wire = "id string, name string, short_name string, color string, stops array<string>, path array<double>, updated_at string"
    return routes_from(spark.read.schema(wire).json(path))


def routes_from(raw: DataFrame) -> DataFrame:
    p = F.col("path")
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / 2).cast("int") - 1),
                        lambda i: F.struct(F.get(p, i * 2).alias("lat"), F.get(p, i * 2 + 1).alias("lon")))
    return raw.select(
        F.col("id").try_cast("bigint").alias("route_id"), "name", "short_name", "color",
        F.transform("stops", lambda s: s.try_cast("bigint")).alias("stops"),
        F.when(F.size(p) >= 2, pairs).alias("path"), F.col("updated_at").try_cast("bigint").alias("updated_at"))


def explode_route_stops(routes: DataFrame) -> DataFrame:
    """Ring positions: one row per stop occurrence."""
    r = routes.select("route_id", F.size("stops").cast("long").alias("ring_size"), F.posexplode("stops").alias("stop_index", "stop_id"))
    return r.select("route_id", F.col("stop_index").cast("long").alias("stop_index"), "stop_id", "ring_size")


def explode_census(df: DataFrame, clip: int = 4000) -> DataFrame:
    """Official answers, one row per promised vehicle and a marker row when there is none (S3).

    ``df``: sampled_at, stop_id, probe, etas ARRAY<MAP<STRING,STRING>>, and where the feed gives them the
    answer's own ``calc_at``, ``probe_route_id`` and ``extra`` MAP<STRING,STRING>. Unknown fields stay as
    JSON; the answer's ride on its first row, or are the marker's. A marker keeps the answer's time and
    the probed route.
    """
    whole = lambda c, t: F.col(c) if c in df.columns else F.lit(None).cast(t)
    e = df.select("sampled_at", "stop_id", "probe", whole("calc_at", "bigint").alias("_calc"), whole("probe_route_id", "bigint").alias("_route"),
                  whole("extra", "map<string,string>").alias("_extra"), F.posexplode_outer("etas").alias("_i", "eta"))
    known = F.array(*[F.lit(k) for k in ("calc_at", "route_id", "bus_id", "bus_name", "eta_min", "eta_sec")])
    rest = F.map_filter("eta", lambda k, v: ~F.array_contains(known, k))
    own = F.when(F.size(rest) > 0, F.to_json(rest))
    envelope = F.when(F.size("_extra") > 0, F.to_json("_extra"))
    first = F.concat(F.coalesce(F.concat(F.expr("substring(_own, 1, length(_own) - 1)"), F.lit(",")), F.lit("{")), F.lit('"envelope":'), "_env", F.lit("}"))
    raw = F.when(F.col("eta").isNull(), F.col("_env")).when((F.col("_i") == 0) & F.col("_env").isNotNull(), first).otherwise(F.col("_own"))
    get = lambda k, t: F.try_element_at("eta", F.lit(k)).try_cast(t)
    e = e.withColumn("_own", own).withColumn("_env", envelope)
    return e.select("sampled_at", "stop_id", "probe", F.coalesce(get("calc_at", "bigint"), "_calc").alias("calc_at"),
                    F.when(F.col("eta").isNull(), F.col("_route")).otherwise(get("route_id", "bigint")).alias("route_id"), get("bus_id", "bigint").alias("bus_id"),
                    get("bus_name", "string").alias("bus_name"), get("eta_min", "int").alias("eta_min"), get("eta_sec", "int").alias("eta_sec"),
                    F.substring(raw, 1, clip).alias("raw"))


def read_archive(spark: SparkSession, root: str, table: str, days: list[str] | None = None, fmt: str = "json") -> DataFrame:
    """Day folders ``root/table/day=YYYY-MM-DD`` of an archived table (S4); other days are not listed."""
    schema, epoch = ARCHIVED[table]
    df = spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).format(fmt).load(f"{root}/{table}")
    return df.where(F.col("day").isin([F.lit(d).cast("date") for d in days])) if days else df


def merge_captures(a: DataFrame, b: DataFrame, day: str, keys: tuple[str, ...] = ("bus_id", "collected_at"), time: str = "collected_at") -> DataFrame:
    """Two captures of one local day on their shared columns; the first source wins a shared key, and inside
    one source a hash of the row (S5)."""
    cols = [c for c in a.columns if c in b.columns]
    both = a.select(*cols, F.lit(0).alias("_src")).unionByName(b.select(*cols, F.lit(1).alias("_src")))
    lo, hi = clock.day_start_ms(F.lit(day).cast("date")), clock.day_end_ms(F.lit(day).cast("date"))
    both = both.where((F.col(time) >= lo) & (F.col(time) < hi))
    return top_n(both, list(keys), [F.col("_src"), F.xxhash64(*cols)], 1).drop("_src", "rank")


def assemble_replay(base: DataFrame, days: list[DataFrame], keys: list[str]) -> DataFrame:
    """A replay set from a base and archived days, duplicates ignored in that order."""
    cols = base.columns
    out = base.select(*cols, F.lit(0).alias("_src"))
    for i, d in enumerate(days, 1):
        out = out.unionByName(d.select(*cols, F.lit(i).alias("_src")))
    return top_n(out, keys, [F.col("_src")], 1).drop("_src", "rank")
