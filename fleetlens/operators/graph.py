"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); component is the least node reached.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until the edges are a star
    forest: rounds follow the logarithm of the longest path, and there is no cap on them. Minima are
    combined before each shuffle and hot centres are split by the skew join, so no component is ever
    gathered. Each round is written to the shared checkpoint folder."""
    cur = materialize(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    seen = None
    while True:
        both = cur.unionAll(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("u"), "v").where("u <> v").distinct()
        # Every edge now leads from a smaller node u to a larger one v.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("m").alias("u"), F.explode(F.array("u", "v")).alias("v")).where("u <> v").distinct()
        cur = materialize(small)
        # Both steps leave a star forest as it is.
        mark = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    return cur.select(F.col("v").alias("node"), F.col("u").alias("component")).unionAll(
        cur.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
