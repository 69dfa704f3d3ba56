"""Row-choice and set helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per key. Spark pushes the rank limit below the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def pick(df: DataFrame, keys: list[str], order: Column, last: bool = True) -> DataFrame:
    """One row per key by greatest (or least) order value; a partial aggregate, no sort."""
    cols = [c for c in df.columns if c not in keys]
    f = F.max_by if last else F.min_by
    got = df.groupBy(*keys).agg(f(F.struct(*cols), order).alias("_row"))
    return got.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in cols])


def latest_by(df: DataFrame, keys: list[str], ts: str, tie: str | None = None) -> DataFrame:
    """Last row wins."""
    return pick(df, keys, F.struct(ts, tie) if tie else F.col(ts))


def specific_else_general(spec: DataFrame, gen: DataFrame, keys: list[str]) -> DataFrame:
    """Specific rows, and general rows for keys without one."""
    s = spec.withColumn("source", F.lit("specific"))
    g = gen.join(spec.select(*keys).distinct(), keys, "left_anti").withColumn("source", F.lit("general"))
    return s.unionByName(g, allowMissingColumns=True)


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)
