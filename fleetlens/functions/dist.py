"""Distributions given by ascending quantile knots at levels (i + .5) / n.

Survival is log-linear between knots and decays at a bounded hazard past the last one. Each function
is a Column expression over ARRAY<DOUBLE>, so it stays in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_HAZARD, MAX_HAZARD, MAX_P = 1 / 1800, 1 / 5, 1 - 1e-6


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _knots(q) -> Column:
    """Distinct knots as (x, p): the last level of a repeated value stands."""
    q = _c(q)
    n = F.size(q)
    z = F.transform(q, lambda x, i: F.struct(x.alias("x"), F.least(F.lit(MAX_P), (i + 0.5) / n).alias("p")))
    return F.filter(z, lambda k, i: (i == n - 1) | (F.get(q, i + 1) > k["x"]))


def _hazard(k: Column) -> Column:
    n = F.size(k)
    a, b = F.get(k, n - 2), F.get(k, n - 1)
    h = F.when(n >= 2, F.log((1 - a["p"]) / (1 - b["p"])) / (b["x"] - a["x"])).otherwise(F.lit(MAX_HAZARD))
    return F.least(F.lit(MAX_HAZARD), F.greatest(F.lit(MIN_HAZARD), h))


def survival(q, x) -> Column:
    x, k = _c(x), _knots(q)
    n = F.size(k)
    below = F.size(F.filter(k, lambda e: e["x"] <= x))
    a, b = F.get(k, below - 1), F.get(k, F.least(below, n - 1))
    t = (x - a["x"]) / (b["x"] - a["x"])
    mid = F.exp(F.log(1 - a["p"]) * (1 - t) + F.log(1 - b["p"]) * t)
    last = F.get(k, n - 1)
    return F.when(below == 0, 1.0).when(below == n, (1 - last["p"]) * F.exp(-_hazard(k) * (x - last["x"]))).otherwise(mid)


def cdf(q, x) -> Column:
    return 1 - survival(q, x)


def quantile(q, p) -> Column:
    """Value at level p; below the first knot's level the first knot."""
    p = F.lit(p) if isinstance(p, float) else _c(p)
    k = _knots(q)
    n = F.size(k)
    below = F.size(F.filter(k, lambda e: e["p"] <= p))
    a, b = F.get(k, below - 1), F.get(k, F.least(below, n - 1))
    t = F.log((1 - p) / (1 - a["p"])) / F.log((1 - b["p"]) / (1 - a["p"]))
    last = F.get(k, n - 1)
    tail = last["x"] + F.log((1 - last["p"]) / (1 - p)) / _hazard(k)
    return F.when(below == 0, F.get(k, F.lit(0))["x"]).when(below == n, tail).otherwise(a["x"] + t * (b["x"] - a["x"]))


def residual_quantile(q, elapsed, p) -> Column:
    """Level p of the time left given it has lasted ``elapsed``."""
    e = _c(elapsed)
    s = survival(q, e)
    return F.greatest(F.lit(0.0), quantile(q, 1 - s * (1 - (F.lit(p) if isinstance(p, float) else _c(p)))) - e)


def hazard(q, x) -> Column:
    """Instantaneous hazard: the slope of -log survival over a second."""
    return F.log(survival(q, x) / survival(q, _c(x) + 1))


def scale(q, f) -> Column:
    return F.transform(_c(q), lambda x: x * f)


def shift(q, d) -> Column:
    return F.transform(_c(q), lambda x: F.greatest(F.lit(0.0), x + d))


def shrink_toward(q, prior, n, k: float) -> Column:
    """Mixture of the own table (weight n) and a prior (weight k), back on the own number of knots."""
    w = _c(n) / (_c(n) + k)
    return mixture_knots(F.array(F.struct(_c(q).alias("q"), w.alias("w")), F.struct(_c(prior).alias("q"), (1 - w).alias("w"))), 10)


def mixture_knots(members: Column, n: int) -> Column:
    """Quantile knots of a weighted mixture ARRAY<STRUCT<q, w>> by weighting every member's knots."""
    flat = F.flatten(F.transform(members, lambda m: F.transform(m["q"], lambda x: F.struct(x.alias("x"), (m["w"] / F.size(m["q"])).alias("w")))))
    s = F.array_sort(flat)
    total = F.aggregate(s, F.lit(0.0), lambda a, e: a + e["w"])
    levels = F.array(*[F.lit((i + 0.5) / n) for i in range(n)])
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("double").alias("x"))
    return F.transform(levels, lambda p: F.aggregate(
        s, start, lambda a, e: F.struct((a["c"] + e["w"]).alias("c"), F.when(a["x"].isNull() & (a["c"] + e["w"] >= p * total - 1e-12), e["x"]).otherwise(a["x"]).alias("x")))["x"])
