"""Rider activity and search demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import clock
from fleetlens.functions import exprs as E
from fleetlens.functions.quantiles import grouped_quantiles


def countable(df: DataFrame, excluded: DataFrame, since: str | None = None) -> DataFrame:
    """Well-formed ids off the exclusion list, from the statistics epoch on."""
    d = df.where(F.col("anon_id").rlike(E.ANON_ID))
    if since:
        d = d.where(F.col("day") >= F.lit(since).cast("date"))
    return d.join(excluded.select("anon_id").distinct(), "anon_id", "left_anti")


def _today(now_ms: int) -> Column:
    return clock.local_day(F.lit(now_ms))


def _first_days(a: DataFrame) -> DataFrame:
    return a.groupBy("anon_id").agg(F.min("day").alias("first_day"))


def with_first_day(actives: DataFrame) -> DataFrame:
    """Each activity row with the first day its id was seen (J1). One row per (id, day), so an id
    holds at most its days of retention."""
    return actives.withColumn("first_day", F.min("day").over(Window.partitionBy("anon_id")))


def active_counts(actives: DataFrame, now_ms: int) -> DataFrame:
    """Distinct riders today, over 7 and 30 days, and ever; returning and new today."""
    per = actives.groupBy("anon_id").agg(F.max("day").alias("last"), F.min("day").alias("first"),
                                         F.max(F.when(F.col("day") == _today(now_ms), 1).otherwise(0)).alias("today"))
    t = _today(now_ms)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return per.agg(
        n(F.col("today") == 1).alias("today"), n(F.col("last") >= F.date_sub(t, 6)).alias("last7"),
        n(F.col("last") >= F.date_sub(t, 29)).alias("last30"), F.count(F.lit(1)).alias("ever"),
        n((F.col("today") == 1) & (F.col("first") < t)).alias("returning_today"),
        n((F.col("today") == 1) & (F.col("first") == t)).alias("new_today"))


def returning_ids(actives: DataFrame, now_ms: int) -> DataFrame:
    """Today's ids that were seen before."""
    t = _today(now_ms)
    ids = actives.select("anon_id", "day")
    return ids.where(F.col("day") == t).select("anon_id").intersect(ids.where(F.col("day") < t).select("anon_id"))


def rider_history(actives: DataFrame, days: int, now_ms: int) -> DataFrame:
    """Per day: riders, new, returning, searches and the median session minutes."""
    d = with_first_day(actives).where(F.col("day") >= F.date_sub(_today(now_ms), days - 1))
    g = d.groupBy("day").agg(F.count(F.lit(1)).alias("riders"),
                             F.sum(F.when(F.col("first_day") == F.col("day"), 1).otherwise(0)).alias("new_riders"),
                             F.coalesce(F.sum("searches"), F.lit(0)).alias("searches"))
    s = d.where("last_seen_ms > first_seen_ms").withColumn("min", (F.col("last_seen_ms") - F.col("first_seen_ms")) / 60000)
    q = grouped_quantiles(s, ["day"], "min", {"m": (0.5, "linear")})
    return g.join(q, "day", "left").select(
        "day", "riders", "new_riders", (F.col("riders") - F.col("new_riders")).alias("returning_riders"), "searches",
        E.round1(F.coalesce("m", F.lit(0.0))).alias("median_minutes"))


def repeat_rate(actives: DataFrame) -> DataFrame:
    """Share of ids active on two or more days."""
    p = actives.select("anon_id", "day").distinct().groupBy("anon_id").agg(F.count(F.lit(1)).alias("d"))
    return p.agg((F.sum(F.when(F.col("d") >= 2, 1).otherwise(0)) / F.count(F.lit(1))).alias("repeat_rate"))


def week1_retention(actives: DataFrame, now_ms: int) -> DataFrame:
    """Of ids first seen a week ago or earlier, the share back within seven days."""
    w = with_first_day(actives).where(F.col("first_day") <= F.date_sub(_today(now_ms), 7))
    back = (F.col("day") > F.col("first_day")) & (F.col("day") <= F.date_add("first_day", 7))
    per = w.groupBy("anon_id").agg(F.bool_or(back).alias("back"))
    r = F.sum(F.when(F.col("back"), 1).otherwise(0))
    return per.agg(F.count(F.lit(1)).alias("cohort"), (r / F.count(F.lit(1))).alias("retention"))


def engagement(actives: DataFrame) -> DataFrame:
    """Median active days per id and median minutes per active day."""
    days = actives.select("anon_id", "day").distinct().groupBy("anon_id").agg(F.count(F.lit(1)).cast("double").alias("v")).select(F.lit("days").alias("k"), "v")
    mins = actives.where("last_seen_ms > first_seen_ms").select(F.lit("minutes").alias("k"), ((F.col("last_seen_ms") - F.col("first_seen_ms")) / 60000).alias("v"))
    q = grouped_quantiles(days.unionByName(mins), ["k"], "v", {"m": (0.5, "linear")})
    p = lambda k: F.coalesce(F.max(F.when(F.col("k") == k, F.col("m"))), F.lit(0.0))
    return q.agg(p("days").alias("median_days"), E.round1(p("minutes")).alias("median_minutes"))


def hourly_presence(actives: DataFrame, days: int, now_ms: int) -> DataFrame:
    """Ids present in each local hour, first to last sighting; past midnight stops at 23."""
    d = actives.where(F.col("first_seen_ms").isNotNull() & F.col("last_seen_ms").isNotNull() & (F.col("day") >= F.date_sub(_today(now_ms), days - 1)))
    h0, h1 = clock.local_hour("first_seen_ms"), clock.local_hour(F.greatest("first_seen_ms", "last_seen_ms"))
    last = F.when(h1 >= h0, h1).otherwise(23)
    return d.select("day", F.explode(F.sequence(h0, last)).alias("hour")).groupBy("day", "hour").agg(F.count(F.lit(1)).alias("riders"))


def hourly_array(presence: DataFrame) -> DataFrame:
    """The 24 hourly counts of a day as one array."""
    at = lambda h: F.coalesce(F.max(F.when(F.col("hour") == h, F.col("riders"))), F.lit(0))
    return presence.groupBy("day").agg(F.array(*[at(h) for h in range(24)]).alias("hours"))


def search_terms_in(terms: DataFrame, days: int, now_ms: int) -> DataFrame:
    d = terms.where(F.col("day") >= F.date_sub(_today(now_ms), days - 1))
    return d.groupBy("q").agg(F.sum("n").alias("n"), F.sum("zero").alias("zero"))


def collapse_prefixes(terms: DataFrame) -> DataFrame:
    """Drop a term that is a proper prefix of another one.

    Terms are at most 60 characters, so each yields a bounded list of proper prefixes; the distinct
    prefixes are one hash-partitioned anti join away, with no group of related terms to gather.
    """
    heads = terms.where(F.length("q") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("q") - 1), lambda k: F.substring(F.col("q"), F.lit(1), k))).alias("q")
    ).distinct()
    return terms.join(heads, "q", "left_anti")


def search_report(terms: DataFrame, days: int, limit: int, now_ms: int) -> DataFrame:
    """Top terms and terms that never found anything, prefixes collapsed."""
    t = search_terms_in(terms, days, now_ms)
    order = [F.col("n").desc(), F.col("q")]
    top = collapse_prefixes(t).orderBy(*order).limit(limit).withColumn("list", F.lit("top"))
    miss = collapse_prefixes(t.where("zero >= n")).orderBy(*order).limit(limit).withColumn("list", F.lit("missing"))
    return top.unionByName(miss).select("list", "q", "n", "zero")


def search_totals(terms: DataFrame, days: int, now_ms: int) -> DataFrame:
    return search_terms_in(terms, days, now_ms).agg(
        F.sum("n").alias("searches"), F.sum("zero").alias("zero_searches"), F.count(F.lit(1)).alias("distinct_terms"))
