"""Mixing sources to target weights by Pareto order sampling.

Every document has a number of expected copies that rises with its size, two at most, so that a source's
copies add up to its target in words. The whole part of that number is certain. For the rest, documents are
ranked by random odds over the odds of their fraction, and taken in that order up to the target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize

WEIGHTS = (5, 2, 1)
TOTAL_SHARE, CAP = 1.5, 2.0
#: Expected copies rise with this power of the size.
POWER = 0.125
#: A document of more than this share of its source's target is large: its fraction is rounded, not drawn, as one draw
#: more or less would miss the target. A source has at most 1 / (LARGE * rate) of them.
LARGE = 0.001
#: Slices of a source in rank order; only one slice of a source is ever ordered.
SLICES = 4096
DIGITS = 13  # hex digits of the digest that make the random number
#: Rows of a table of sources and size classes up to which it is broadcast; a larger one is joined by salted keys.
SMALL_TABLE, SALTS = 50_000, 32


def sizes(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: str = "") -> Column:
    """A number in (0, 1) from the md5 digest of the key's text; equal in any engine and any run."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)


def targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = TOTAL_SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) per source.

    Weights go round in code-point order, null last. The water level rises until nobody is above the
    cap: capped sources leave, the others share what is left by weight. The driver sees three sums."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int") + 1)
    t = materialize(per_source.select("source", "source_size", weight.alias("weight"), (cap * F.col("source_size")).alias("most")))
    whole = total * (t.agg(F.sum("source_size")).first()[0] or 0)
    level = -1.0
    while True:
        # Sources at or above their cap at the level so far; a level only rises as sources leave.
        full = F.col("weight") * F.lit(level) > F.col("most")
        done, open_weight = t.agg(F.sum(F.when(full, F.col("most"))), F.sum(F.when(~full, F.col("weight")))).first()
        rest = (whole - (done or 0.0)) / open_weight if open_weight else level
        if rest <= level:
            break
        level = rest
    return t.select("source", "source_size", "weight", F.least(F.col("most"), F.col("weight") * F.lit(max(level, 0.0))).alias("target"))


def size_class(size: Column) -> Column:
    """Eight classes to a doubling of the size, in whole numbers; 0 for no words."""
    bits = F.length(F.bin(size))
    eighth = F.when(bits > 4, F.expr("shiftright(size, length(bin(size)) - 4)")).otherwise(F.expr("shiftleft(size, 4 - length(bin(size)))"))
    return F.when(size > 0, bits * 8 + F.pmod(eighth, F.lit(8))).otherwise(0).cast("int")


def attach(d: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """``d`` with the columns of ``table`` (a row per ``on``, nulls match), without a shuffle of ``d`` by a hot key:
    a table of a checked size is broadcast, a larger one meets salted keys."""
    t = table.select(*[F.col(c).alias(f"t_{c}") for c in on], *[c for c in table.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in on]
    if table.count() <= SMALL_TABLE:
        return d.join(F.broadcast(t), same).drop(*[f"t_{c}" for c in on])
    t = t.withColumn("t_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = d.withColumn("salt", F.pmod(F.xxhash64("key", "tie"), F.lit(SALTS)).cast("int"))
    return d.join(t, [*same, F.col("salt") == F.col("t_salt")]).drop("salt", "t_salt", *[f"t_{c}" for c in on])


def expected(classes: DataFrame, goal: DataFrame) -> DataFrame:
    """(source, class, copies) from (source, class, words) and the targets: min(2, level * class weight), where the
    level fits the target. Classes leave from the top as they reach two copies; a source has a few hundred."""
    c = attach(classes.withColumn("key", F.lit(0)).withColumn("tie", F.lit(0)), goal, ["source"]).where("class > 0").withColumn("a", F.pow(F.lit(2.0), F.lit(POWER) * F.col("class") / 8))
    down = W.partitionBy("source").orderBy(F.col("class").desc())
    above = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("a") * F.col("words")).over(down.rowsBetween(0, W.unboundedFollowing))
    c = c.withColumn("level", (F.col("target") - CAP * above) / rest)
    level = F.first(F.when(F.col("level") * F.col("a") <= CAP, F.col("level")), ignorenulls=True).over(down.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return c.select("source", "class", F.greatest(F.lit(0.0), F.least(F.lit(CAP), F.coalesce(level * F.col("a"), F.lit(CAP)))).alias("expected"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "") -> DataFrame:
    """(key, size, source, source_size, target, copies, taken) of every row of ``docs``.

    ``floor(expected)`` copies are certain, the fraction p is the inclusion probability of one more. Large
    documents come first, by falling size: one more is taken where that brings the words so far nearer to what was
    expected. All others are ranked by u/(1-u) over p/(1-p), u from the key alone, and taken in that order up to
    what is left of the target; the one that crosses it is taken if that is nearer. So a source misses its target by half
    a thousandth, or half its smallest document where all are large.

    Null text has size 0 and takes nothing; null is a source of its own; rows with equal keys share
    their random number and are told apart by size and text. An empty table gives no rows."""
    d = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), sizes(F.col(text)).alias("size"),
                    uniform(F.col(key), seed).alias("u"), F.xxhash64(F.col(text)).alias("tie"))
    d = materialize(d.withColumn("class", size_class(F.col("size"))))
    classes = materialize(d.groupBy("source", "class").agg(F.sum("size").alias("words")))
    goal = materialize(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size"))).drop("weight"))
    share = materialize(expected(classes, goal))
    d = attach(attach(d, goal, ["source"]), _with_empty(share, goal), ["source", "class"])
    d = d.withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain")).withColumn("large", (F.col("p") > 0) & (F.col("size") > LARGE * F.col("target")))
    odds = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    d = d.withColumn("q", F.when((F.col("p") > 0) & ~F.col("large"), odds)).withColumn("place", F.when(F.col("q").isNotNull(), F.struct("q", "u", "key", "size", "tie")))
    d = d.withColumn("slice", F.least(F.lit(SLICES - 1), F.floor(SLICES * F.col("q") / (1 + F.col("q")))).cast("int"))

    # Large documents of a source, by falling size: words behind or ahead of what was expected decide on each.
    big = d.where("large").groupBy("source").agg(F.reverse(F.array_sort(F.collect_list(F.struct("size", "u", "key", "tie", "p")))).alias("docs"))
    step = lambda acc, x: let_more(acc, x)
    zero = F.struct(F.lit(0.0).alias("behind"), F.array().cast("array<int>").alias("more"))
    big = materialize(big.withColumn("r", F.aggregate("docs", zero, step)).select("source", "docs", F.col("r.more").alias("more"), F.col("r.behind").alias("behind")))
    picked = big.select("source", F.explode(F.arrays_zip("docs", "more")).alias("x")).groupBy("source", F.col("x.docs.key").alias("key"), F.col("x.docs.tie").alias("tie"), F.col("x.docs.size").alias("size")).agg(
        F.sum("x.more").alias("chosen"))

    # The others: what the certain copies and the large documents leave of the target, taken in rank order.
    slices = d.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.sum(F.when(~F.col("large") | F.col("large").isNull(), F.col("p") * F.col("size"))).alias("due"))
    owed = slices.groupBy("source").agg(F.sum("due").alias("due"))
    gap = owed.join(big.select(F.col("source").alias("b_source"), "behind"), F.col("source").eqNullSafe(F.col("b_source")), "left").select("source", (F.col("due") + F.coalesce("behind", F.lit(0.0))).alias("gap"))
    upto = F.sum("words").over(W.partitionBy("source").orderBy("slice"))
    ladder = attach(slices.where("slice is not null").select("source", "slice", "words", upto.alias("upto"), F.lit(0).alias("key"), F.lit(0).alias("tie")), materialize(gap), ["source"])
    edge = materialize(ladder.where("upto > gap").groupBy("source").agg(F.min("slice").alias("edge"), F.min_by(F.col("upto") - F.col("words"), "slice").alias("base"), F.first("gap").alias("gap")))
    edges = materialize(owed.join(edge.withColumnRenamed("source", "e_source"), F.col("source").eqNullSafe(F.col("e_source")), "left").select("source", F.coalesce("edge", F.lit(SLICES)).alias("edge"), "base", "gap"))
    d = attach(d, edges, ["source"])
    running = F.col("base") + F.sum("size").over(W.partitionBy("source").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    inside = d.where("slice = edge").select("source", "place", "size", "gap", running.alias("running"))
    # In, up to the target; the crossing one if at least half of it is.
    last = inside.where(F.col("running") - F.col("size") / 2 <= F.col("gap")).groupBy("source").agg(F.max("place").alias("last"))
    last = materialize(owed.select("source").join(last.withColumnRenamed("source", "l_source"), F.col("source").eqNullSafe(F.col("l_source")), "left").select("source", "last"))
    d = attach(d, last, ["source"])
    drawn = (F.col("slice") < F.col("edge")) | ((F.col("slice") == F.col("edge")) & (F.col("place") <= F.col("last")))
    d = d.withColumn("extra", F.coalesce(drawn, F.lit(False)).cast("int"))
    few = d.where("large").withColumn("own", F.row_number().over(W.partitionBy("source", "key", "tie", "size").orderBy("u")))
    few = few.join(picked.select(*[F.col(c).alias(f"p_{c}") for c in ("source", "key", "tie", "size")], "chosen"), F.col("source").eqNullSafe(F.col("p_source")) & F.col("key").eqNullSafe(F.col("p_key"))
                   & F.col("tie").eqNullSafe(F.col("p_tie")) & (F.col("size") == F.col("p_size")))
    few = few.withColumn("extra", (F.col("own") <= F.col("chosen")).cast("int")).select(*d.columns)
    out = d.where("not large or large is null").unionAll(few)
    return out.select(F.col("key").alias(key), "size", F.col("source"), "source_size", "target", "tie", (F.col("certain") + F.col("extra")).cast("long").alias("copies"),
                      (F.col("size") * (F.col("certain") + F.col("extra"))).cast("long").alias("taken"))


def let_more(acc: Column, x: Column) -> Column:
    """One large document: it is taken once more if the words behind, with its own share, reach half its size."""
    behind = acc["behind"] + x["p"] * x["size"]
    take = behind >= x["size"] / 2
    return F.struct((behind - F.when(take, x["size"]).otherwise(0)).cast("double").alias("behind"), F.concat(acc["more"], F.array(take.cast("int"))).alias("more"))


def _with_empty(share: DataFrame, goal: DataFrame) -> DataFrame:
    """Documents without words expect no copy."""
    return materialize(share.unionAll(goal.select("source", F.lit(0).alias("class"), F.lit(0.0).alias("expected"))))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "") -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns. Rows equal in key,
    text and source share their copies evenly."""
    ident = lambda k, s: F.xxhash64(k, s)
    plan = mix(docs, key, text, source, seed).groupBy(ident(F.col(key), F.col("source")).alias("__a"), F.col("tie").alias("__b")).agg(
        F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    tagged = docs.withColumns({"__a": ident(F.col(key), F.col(source).cast("string")), "__b": F.xxhash64(F.col(text))})
    own = F.row_number().over(W.partitionBy("__a", "__b").orderBy(F.lit(0)))
    share = F.floor(F.col("__copies") / F.col("__rows")) + F.when(own <= F.col("__copies") % F.col("__rows"), 1).otherwise(0)
    out = tagged.join(plan, ["__a", "__b"]).withColumn("__times", share.cast("int")).where("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
