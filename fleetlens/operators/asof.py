"""As-of joins (J6-J9) with a bounded look-around.

Left and right rows are tagged, unioned and read with one ordered window. A match lies at most
``window`` away, so rows are cut into cells of that width and each right row is copied only into the
neighbouring cell that may need it: a key of any size spreads over its cells, and no pair is formed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.operators import scan

MIN_MS = 60_000
STANDING_LOOKBACK_MS = 120 * MIN_MS
MATCH_45_MS = 45 * MIN_MS
MATCH_2H_MS = 120 * MIN_MS


def _tagged(left: DataFrame, right: DataFrame, keys: list[str], lt: str, rt: str, payload: list[str],
            cell_ms: int, offsets: list[int], right_tag: int, tie: str | None):
    """Union of left rows (their own cell) and right rows (copied to cells c+offset)."""
    lcols = [c for c in left.columns if c not in keys]
    l = left.select(
        *keys,
        F.floor(F.col(lt) / F.lit(cell_ms)).cast("long").alias("_cell"),
        F.col(lt).cast("long").alias("_t"),
        F.lit(1 - right_tag).alias("_tag"),
        F.lit(None).cast("long").alias("_tie"),
        F.struct(*lcols).alias("_l"),
    )
    rs = F.struct(F.col(rt).cast("long").alias("_rt"), *payload)
    r = right.select(
        *keys,
        F.explode(
            F.transform(
                F.array(*[F.lit(o).cast("long") for o in offsets]),
                lambda o: F.floor(F.col(rt) / F.lit(cell_ms)).cast("long") + o,
            )
        ).alias("_cell"),
        F.col(rt).cast("long").alias("_t"),
        F.lit(right_tag).alias("_tag"),
        (F.col(tie).cast("long") if tie else F.lit(None).cast("long")).alias("_tie"),
        rs.alias("_r"),
    )
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_cell").orderBy("_t", "_tag", F.col("_tie").asc_nulls_first())
    return both, w, lcols


def asof_next(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
              window_ms: int, payload: list[str] = (), strict: bool = False, tie: str | None = None,
              out: str = "next") -> DataFrame:
    """First right row at (or strictly after) each left row within the window, as struct ``out``."""
    # Left sorts before an equal right when equality counts, after it when it does not.
    both, w, lcols = _tagged(left, right, keys, left_time, right_time, list(payload), window_ms, [0, -1],
                             0 if strict else 1, tie)
    nxt = F.first("_r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    res = both.withColumn("_n", nxt).where(F.col("_l").isNotNull())
    ok = F.col("_n._rt") - F.col("_t") <= window_ms
    return res.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in lcols], F.when(ok, F.col("_n")).alias(out))


def asof_prev(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
              window_ms: int, payload: list[str] = (), lag_ms: int = 0, strict: bool = False,
              tie: str | None = None, out: str = "prev") -> DataFrame:
    """Last right row at or before ``left_time - lag_ms`` (strictly before with ``strict``)."""
    lagged = left.withColumn("_at", F.col(left_time) - lag_ms)
    both, w, lcols = _tagged(lagged, right, keys, "_at", right_time, list(payload), window_ms, [0, 1],
                             1 if strict else 0, tie)
    prv = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    res = both.withColumn("_p", prv).where(F.col("_l").isNotNull())
    ok = F.col("_t") - F.col("_p._rt") <= window_ms
    keep = [c for c in lcols if c != "_at"]
    return res.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in keep], F.when(ok, F.col("_p")).alias(out))


def truth_join(preds: DataFrame, visits: DataFrame, keys: list[str], at: str = "predicted_at",
               match_ms: int = MATCH_45_MS, lookback_ms: int = STANDING_LOOKBACK_MS, tie: str | None = None) -> DataFrame:
    """What settled each prediction.

    *standing*: the visit strictly before is open or departs at/after the promise and began within
    the lookback; else *arrived* at the first visit at or after it within the match window; else
    *missing*. ``visits`` carries ``arrived_at`` and ``departed_at``.
    """
    cell = max(match_ms, lookback_ms)
    both, w, lcols = _tagged(preds, visits, keys, at, "arrived_at", ["departed_at"], cell, [-1, 0, 1], 1, tie)
    prv = F.last("_r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first("_r", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    res = both.withColumn("_p", prv).withColumn("_n", nxt).where(F.col("_l").isNotNull())
    standing = (
        F.col("_p").isNotNull()
        & (F.col("_p.departed_at").isNull() | (F.col("_p.departed_at") >= F.col("_t")))
        & (F.col("_t") - F.col("_p._rt") <= lookback_ms)
    )
    arrived = F.col("_n._rt") - F.col("_t") <= match_ms
    truth = F.when(standing, "standing").when(arrived, "arrived").otherwise("missing")
    return res.select(
        *keys, *[F.col(f"_l.{c}").alias(c) for c in lcols], truth.alias("truth"),
        F.when(truth == "arrived", F.col("_n._rt")).alias("actual_at"),
    )


def v1_next_arrival(preds: DataFrame, arrivals: DataFrame, keys: list[str], at: str = "predicted_at",
                    sec: str = "predicted_sec", max_sec: int = 900) -> DataFrame:
    """Older pairing (J8): next arrival strictly after, within the ceiling and 3x the promise + 60 s."""
    j = asof_next(preds, arrivals, keys, at, "arrived_at", max_sec * 1000, strict=True)
    actual = (F.col("next._rt") - F.col(at)) / 1000
    return (
        j.where(F.col("next").isNotNull())
        .withColumn("arrived_at", F.col("next._rt"))
        .withColumn("actual_sec", actual)
        .where((F.col("actual_sec") <= max_sec) & (F.col("actual_sec") <= F.col(sec) * 3 + 60))
        .drop("next")
    )


def asof_next_any(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str,
                  payload: list[str], tie: str, cell_ms: int = 24 * 60 * MIN_MS, out: str = "next") -> DataFrame:
    """First right row at or after each left row, however far: a carried scan over the tagged union."""
    lcols = [c for c in left.columns if c not in keys]
    l = left.select(*keys, F.col(left_time).cast("long").alias("_t"), F.lit(0).alias("_tag"), F.lit(0).cast("long").alias("_tie"), F.struct(*lcols).alias("_l"))
    r = right.select(*keys, F.col(right_time).cast("long").alias("_t"), F.lit(1).alias("_tag"), F.col(tie).cast("long").alias("_tie"),
                     F.struct(F.col(right_time).cast("long").alias("_rt"), *payload).alias("_r"))
    d = scan.carried_first(l.unionByName(r, allowMissingColumns=True), keys, ["_t", "_tag", "_tie"], {"_n": "_r"}, cell_ms)
    return d.where(F.col("_l").isNotNull()).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in lcols], F.col("_n").alias(out))
