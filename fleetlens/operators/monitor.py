"""Synthetic-watch runs, alerts and feedback reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions import clock
from fleetlens.operators import scan
from fleetlens.operators.runs import map_runs

IMMINENT_SEC = 120
CATASTROPHIC_SEC = 180
COOLDOWN_MS = 6 * 3_600_000
MAX_PER_DAY = 6
RECOVERY_RUNS = 2
KEEP_ITEMS = 8
AUTOMATED_PREFIX = "[automated]"


def normalize_runs(raw: DataFrame, text: int = 120) -> DataFrame:
    """Shipped runs made storable (P16): clipped lists and texts, defaults, unusable rows dropped."""
    clip = lambda c, n: F.substring(F.coalesce(F.col(c), F.lit("")), 1, n)
    blank = lambda c: F.when(F.length(c) > 0, c)
    nonneg = lambda c: F.greatest(F.lit(0).cast("long"), F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")))
    r = raw.where((F.col("started_at") > 0) & (F.length(F.coalesce("line", F.lit(""))) > 0))
    fails = F.filter(
        F.transform(F.slice(F.coalesce("failures", F.array()), 1, KEEP_ITEMS), lambda f: F.struct(
            F.coalesce(blank(F.substring(f["kind"], 1, 40)), F.lit("unknown")).alias("kind"),
            F.coalesce(F.substring(f["detail"], 1, 240), F.lit("")).alias("detail"))),
        lambda f: (F.length(f["detail"]) > 0) | (f["kind"] != "unknown"))
    jumps = F.transform(F.slice(F.coalesce("jumps", F.array()), 1, KEEP_ITEMS), lambda j: F.struct(
        F.coalesce(j["at_ms"], F.col("started_at")).alias("at_ms"),
        F.greatest(F.lit(0).cast("long"), F.coalesce(j["from_sec"], F.lit(2**53 - 1))).alias("from_sec"),
        F.coalesce(j["drift_sec"], F.lit(0)).cast("long").alias("drift_sec"), F.coalesce(j["announced"], F.lit(False)).alias("announced")))
    line = clip("line", text)
    return r.select(
        F.coalesce(blank(clip("run_key", text)), F.concat_ws("-", F.col("started_at").cast("string"), line)).alias("run_key"),
        "started_at", line.alias("line"), F.coalesce("ok", F.lit(False)).alias("ok"), "watched_min", nonneg("readings").alias("readings"),
        fails.alias("failures"), jumps.alias("jumps"))


def vanishing_jumps(jumps: Column) -> Column:
    """Jumps that promised a vehicle within two minutes and slipped three or more, worst first."""
    bad = F.filter(jumps, lambda j: (j["from_sec"] <= IMMINENT_SEC) & (j["drift_sec"] >= CATASTROPHIC_SEC))
    return F.array_sort(bad, lambda a, b: F.when(a["drift_sec"] > b["drift_sec"], -1).when(a["drift_sec"] < b["drift_sec"], 1).otherwise(0))


def qualifying_runs(runs: DataFrame) -> DataFrame:
    """Runs that would alert, each with its worst jump (A27 before the cooldown)."""
    return runs.withColumn("q", vanishing_jumps(F.col("jumps"))).where(F.size("q") > 0).withColumn("worst", F.element_at("q", 1)).drop("q")


def _sent(pdf: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
    """The alerts sent in whole segments, in order of arrival."""
    keep = []
    begins = set(starts.tolist())
    for i, (line, t, day) in enumerate(zip(pdf["line"], pdf["t"], pdf["day_no"], strict=True)):
        if i in begins:
            last, today, n = {}, None, 0
        if day != today:
            today, n = day, 0
        if n < MAX_PER_DAY and t - last.get(line, t - COOLDOWN_MS) >= COOLDOWN_MS:
            last[line], n = t, n + 1
            keep.append(i)
    return pdf.iloc[keep][["line", "id", "t"]]


def emit_alerts(runs: DataFrame, received: str = "received_at") -> DataFrame:
    """Apply the six-hour line cooldown and the daily cap, in arrival order.

    Only an alert that is sent starts a cooldown, and the cap counts all lines of a day, so a day's answer hangs on
    the days before it, but for one thing: where nothing qualifies for six hours across a change of day, no
    cooldown and no count reaches over. Runs are cut there, and a segment is short (service sleeps at night) and folded by itself.
    """
    q = qualifying_runs(runs).select("line", F.col("id"), F.col(received).cast("long").alias("t")).withColumn("day", clock.local_day("t"))
    d = scan.shifted(q.withColumn("_all", F.lit(0)), ["_all"], ["t", "id"], {"_pt": "t", "_pd": "day"})
    d = d.withColumn("_new", F.col("_pt").isNull() | ((F.col("t") - F.col("_pt") >= COOLDOWN_MS) & (F.col("day") != F.col("_pd"))))
    d = scan.islands(d, ["_all"], ["t", "id"], "_new", "segment").withColumn("day_no", F.datediff("day", F.lit("1970-01-01")))
    sent = map_runs(d.select("segment", "line", "id", "t", "day_no"), ["segment"], ["t", "id"], _sent, "line string, id long, t long")
    return sent.select("line", clock.local_day("t").alias("day"), "id", F.col("t").alias(received))


def resolve_alerts(runs: DataFrame) -> DataFrame:
    """Lines with an open alert whose last two runs were clean."""
    w = Window.partitionBy("line").orderBy(F.col("started_at").desc(), F.col("id").desc())
    recent = runs.select("line", "started_at", "id", "ok").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= RECOVERY_RUNS)
    clean = recent.groupBy("line").agg(F.count(F.lit(1)).alias("clean_runs"), F.min(F.col("ok").cast("int")).alias("_ok")).where(
        (F.col("clean_runs") == RECOVERY_RUNS) & (F.col("_ok") == 1))
    open_ = runs.where(F.col("alerted_at").isNotNull() & F.col("resolved_at").isNull()).groupBy("line").agg(F.max("alerted_at").alias("alerted_at"))
    return open_.join(clean.drop("_ok"), "line")


def monitor_lines(runs: DataFrame, hours: int, now_ms: int) -> DataFrame:
    """Per line: runs, passed, last run and its verdict, open alert."""
    r = runs.where(F.col("started_at") >= now_ms - hours * 3_600_000).groupBy("line").agg(
        F.count(F.lit(1)).alias("runs"), F.sum(F.col("ok").cast("long")).alias("passed"), F.max("started_at").alias("last_at"))
    allr = runs.groupBy("line").agg(F.max_by("ok", F.struct("started_at", "id")).alias("last_ok"),
                                    F.bool_or(F.col("alerted_at").isNotNull() & F.col("resolved_at").isNull()).alias("alerting"))
    return r.join(allr, "line")


def monitor_findings(runs: DataFrame, hours: int, now_ms: int, limit: int = 12) -> DataFrame:
    """Latest failed runs (A26; a top-k report)."""
    f = runs.where((F.col("started_at") >= now_ms - hours * 3_600_000) & ~F.col("ok"))
    return f.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(limit)


def monitor_totals(runs: DataFrame, hours: int, now_ms: int) -> DataFrame:
    inw = F.col("started_at") >= now_ms - hours * 3_600_000
    return runs.agg(
        F.sum(F.when(inw, 1).otherwise(0)).alias("runs"), F.sum(F.when(inw & F.col("ok"), 1).otherwise(0)).alias("passed"),
        F.max(F.when(inw, F.col("started_at"))).alias("last_at"),
        F.sum(F.when(F.col("alerted_at").isNotNull() & F.col("resolved_at").isNull(), 1).otherwise(0)).alias("open_alerts"))


def outside_reports(reports: DataFrame, operators: DataFrame, since_ms: int) -> DataFrame:
    """Reports by riders: no author or not an operator, not automated, after the epoch."""
    r = reports.where((F.col("created_at") >= since_ms) & ~F.col("body").startswith(AUTOMATED_PREFIX))
    # A null author matches nothing in an anti join, so anonymous reports stay.
    return r.join(operators.select("anon_id").distinct(), "anon_id", "left_anti")


def report_summary(reports: DataFrame, operators: DataFrame, since_ms: int) -> DataFrame:
    return outside_reports(reports, operators, since_ms).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("newest"))


def triage(reports: DataFrame, status: str) -> DataFrame:
    """Reports of one status, most urgent and newest first."""
    return reports.where(F.col("status") == status).orderBy(F.col("priority").desc(), F.col("created_at").desc(), F.col("id").desc())


# --- countdown stability --------------------------------------------------------------------------


def conservative_drift(looks: DataFrame, keys: list[str], at: str = "at_ms", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Smallest move of the promised instant consistent with two displayed intervals.

    The earlier interval shifts with the clock; overlapping intervals mean no provable move.
    """
    d = scan.shifted(looks, keys, [at], {"_pa": at, "_plo": lo, "_phi": hi})
    el = (F.col(at) - F.col("_pa")) / 1000
    plo, phi = F.col("_plo") - el, F.col("_phi") - el
    drift = F.when(F.col(lo) > phi, F.col(lo) - phi).when(F.col(hi) < plo, F.col(hi) - plo).otherwise(0.0)
    return d.withColumn("drift_sec", F.when(F.col("_pa").isNotNull(), drift)).drop("_pa", "_plo", "_phi")


def flap_runs(moves: DataFrame, keys: list[str], at: str = "at_ms", move: str = "move_sec", eventful: str = "eventful",
              gap_ms: int = 120_000, min_moves: int = 3) -> DataFrame:
    """Runs of alternating unexplained moves close in time."""
    m = moves.where(~F.col(eventful) & (F.col(move) != 0))
    d = scan.shifted(m, keys, [at], {"_pa": at, "_pm": move})
    start = F.col("_pa").isNull() | (F.col(at) - F.col("_pa") > gap_ms) | (F.signum(F.col(move)) == F.signum(F.col("_pm")))
    d = scan.islands(d.withColumn("_st", start), keys, [at], "_st", "run")
    return d.groupBy(*keys, "run").agg(F.min(at).alias("from_ms"), F.max(at).alias("to_ms"), F.count(F.lit(1)).alias("moves"),
                                       F.max(F.abs(move)).alias("worst_sec")).where(F.col("moves") >= min_moves)


def roundtrips(offers: DataFrame, keys: list[str], at: str = "at_ms", value: str = "sec", anchor: str = "anchor",
               jump_sec: float = 180.0, back_sec: float = 60.0, expire_ms: int = 600_000) -> DataFrame:
    """A large move that returns to the pre-move value while the anchor holds.

    Values are compared as promised instants. Each excursion looks ahead at most ``expire_ms``.
    """
    d = offers.withColumn("_inst", F.col(at) + F.col(value) * 1000)
    d = scan.shifted(d, keys, [at], {"_pi": "_inst", "_pa": at, "_panchor": anchor})
    opens = (F.abs(F.col("_inst") - F.col("_pi")) >= jump_sec * 1000) & F.col("_panchor").eqNullSafe(F.col(anchor)) & (F.col(at) - F.col("_pa") <= expire_ms)
    o = d.where(opens).select(*keys, F.col(anchor).alias("anchor"), F.col(at).alias("open_at"), F.col("_pi").alias("base"), F.col("_inst").alias("far"))
    o = o.withColumn("_c", F.explode(F.sequence(F.floor(F.col("open_at") / expire_ms), F.floor(F.col("open_at") / expire_ms) + 1)))
    r = d.select(*keys, F.col(anchor).alias("_ra"), F.col(at).alias("_rt"), F.col("_inst").alias("_ri"), F.floor(F.col(at) / expire_ms).alias("_c"))
    j = o.join(r, [*keys, "_c"]).where(
        (F.col("_rt") > F.col("open_at")) & (F.col("_rt") - F.col("open_at") <= expire_ms)
        & F.col("anchor").eqNullSafe(F.col("_ra")) & (F.abs(F.col("_ri") - F.col("base")) <= back_sec * 1000))
    return j.groupBy(*keys, "open_at").agg(F.min("_rt").alias("return_at"), F.first("base").alias("base"), F.first("far").alias("far")).select(
        *keys, "open_at", "return_at", ((F.col("far") - F.col("base")) / 1000).alias("excursion_sec"))
