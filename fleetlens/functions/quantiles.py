"""Exact grouped order statistics without gathering a group.

Rows are first counted per (group, value), so equal values collapse map-side and a hot group is
spread over its values. A coarse monotone bucket of the value then locates each wanted rank: the
bucket counts per group are a bounded list (a few thousand), and only the buckets that hold a
wanted rank are ordered by value. No task sees a whole group.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Rank conventions: linear interpolation on (n-1)p; floor(p(n-1)); ceil(pn)-1; floor(pn); ceil((n+1)p)-1. All clipped.
KINDS = ("linear", "floor", "ceil", "trunc", "conformal")
_STEPS = 192.0


def _bucket(v: Column) -> Column:
    """Monotone coarse bucket: dense near zero, log-spaced further out."""
    mag = F.log1p(F.abs(v)) * F.lit(_STEPS)
    return F.when(v >= 0, F.floor(mag)).otherwise(-F.floor(mag) - 1).cast("int")


def _rank(p: float, kind: str, n: Column) -> tuple[Column, Column, Column]:
    """(low rank, high rank, fraction) for one probability."""
    zero = F.lit(0).cast("long")
    if kind == "linear":
        pos = (n - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        return lo, hi, pos - lo
    if kind == "floor":
        k = F.floor((n - 1) * F.lit(float(p)))
    elif kind == "ceil":
        k = F.ceil(n * F.lit(float(p))) - 1
    elif kind == "conformal":
        k = F.ceil((n + 1) * F.lit(float(p))) - 1
    elif kind == "trunc":
        k = F.floor(n * F.lit(float(p)))
    else:
        raise ValueError(kind)
    k = F.greatest(zero, F.least(n - 1, k))
    return k, k, F.lit(0.0)


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, out: dict, weight: str | None = None) -> DataFrame:
    """One row per group with the asked quantiles and ``_n``.

    ``out`` maps a column name to ``(p, kind)`` or, for an array column, ``([p...], kind)``.
    ``weight`` names an integer multiplicity column when rows are already counted.
    """
    vals = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias("_v"), (F.col(weight) if weight else F.lit(1)).cast("long").alias("_w")
    )
    counts = vals.groupBy(*keys, "_v").agg(F.sum("_w").alias("_c")).withColumn("_b", _bucket(F.col("_v")))
    by_key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    run = by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        counts.groupBy(*keys, "_b")
        .agg(F.sum("_c").alias("_bc"))
        .withColumn("_end", F.sum("_bc").over(run))
        .withColumn("_n", F.sum("_bc").over(by_key))
        .withColumn("_base", F.col("_end") - F.col("_bc"))
    )
    n = F.col("_n")
    flat: list[tuple[str, float, str]] = []
    for name, (p, kind) in out.items():
        for q in p if isinstance(p, (list, tuple)) else [p]:
            flat.append((name, float(q), kind))
    ranks = F.array_distinct(F.array(*[r.cast("long") for _, p, k in flat for r in _rank(p, k, n)[:2]]))
    buckets = buckets.withColumn(
        "_want", F.filter(ranks, lambda r: (r >= F.col("_base")) & (r < F.col("_end")))
    ).where(F.size("_want") > 0)
    # Null-safe keys add no filter to one side only, so the counted exchange is built once and reused.
    names = [*keys, "_b"]
    want = buckets.select(*[F.col(k).alias(f"_j{i}") for i, k in enumerate(names)], "_base", "_n", "_want")
    on = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(names)])
    hit = counts.join(want, on).drop(*[f"_j{i}" for i in range(len(names))])
    inner = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = (
        hit.withColumn("_hi", F.col("_base") + F.sum("_c").over(inner))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
        .withColumn("_r", F.explode(F.filter("_want", lambda r: (r >= F.col("_lo")) & (r < F.col("_hi")))))
    )
    picked = hit.groupBy(*keys).agg(
        F.first("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_r", "_v"))).alias("_m")
    )
    exprs: dict[str, list[Column]] = {}
    for name, p, kind in flat:
        lo, hi, frac = _rank(p, kind, n)
        a, b = F.element_at("_m", lo.cast("long")), F.element_at("_m", hi.cast("long"))
        exprs.setdefault(name, []).append(F.when(lo == hi, a).otherwise(a + frac * (b - a)) if kind == "linear" else a)
    cols = []
    for name, (p, _) in out.items():
        cols.append((F.array(*exprs[name]) if isinstance(p, (list, tuple)) else exprs[name][0]).alias(name))
    return picked.select(*keys, "_n", *cols)


TEN_KNOTS = [(i + 0.5) / 10 for i in range(10)]


