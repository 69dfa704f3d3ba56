"""Registration helper shared by the query modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.plans.rehearsal import frame, oracle

# The rehearsal data ends on 2024-01-30; reports look back from the midnight after (UTC).
NOW = 1_706_659_200_000
NOW_DOW, NOW_HOUR = 2, 19


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, fn, views: str = "", sql: str | None = None) -> None:
        assert name not in self.queries, name
        self.queries[name] = fn
        if sql is not None:
            self.oracles[name] = oracle(views, sql)

    def q(self, name: str, views: str, sql: str | None = None, extra: str = ""):
        """Decorator: the function gets the named views as DataFrames, in order."""
        def wrap(fn):
            def run(spark, sf_dir):
                return fn(*[frame(spark, sf_dir, v) for v in views.split()])
            self.add(name, run, f"{views} {extra}", sql)
            return fn
        return wrap


def rounded(df: DataFrame, digits: int = 7) -> DataFrame:
    """Round every double, so that two engines' summation orders agree."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def knots(df: DataFrame, keys: list[str], arr: str, extra: list[Column | str] = ()) -> DataFrame:
    """One row per knot of an array column."""
    return df.select(*keys, *extra, F.posexplode(arr).alias("knot", "v"))
