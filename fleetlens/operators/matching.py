"""Search strings to place names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType

from fleetlens.functions.exprs import normalize_query
from fleetlens.session import materialize

#: Tokens shorter than the first are compared as they are; from the second on two edits are allowed, else one.
FUZZY_LENGTH, TWO_EDITS_LENGTH = 4, 8


@pandas_udf(StringType())
def _plain(text: pd.Series) -> pd.Series:
    """Accents and invisible formatting characters deleted; Spark has no function for either."""
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if unicodedata.category(c) not in ("Mn", "Cf")))


def comparable(text: Column | str) -> Column:
    """A name as it is compared: plain lower-case words, a number glued to a longer word set apart."""
    x = normalize_query(_plain(F.col(text) if isinstance(text, str) else text), None)
    x = F.regexp_replace(x, r"\b([0-9]{1,5})([a-z]{3,})\b", "$1 $2")
    return F.regexp_replace(x, r"\b([a-z]{3,})([0-9]{1,5})\b", "$1 $2")


def swaps_and_edits(a: str, b: str, limit: int) -> int:
    """Insertions, deletions, replacements and swaps of neighbours between two words; ``limit + 1`` stands for more."""
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j - 1] + (x != y), before[j] + 1, row[j - 1] + 1)
            if older and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return min(row[-1], limit + 1)


@pandas_udf(IntegerType())
def _edits(a: pd.Series, b: pd.Series, limit: pd.Series) -> pd.Series:
    return pd.Series([swaps_and_edits(x, y, int(k)) for x, y, k in zip(a, b, limit, strict=True)], dtype="int32")


def _deletions(x: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))


def signatures(word: Column, depth: Column) -> Column:
    """The word and what is left after one, or two, letters are deleted (``depth`` of them at most)."""
    once = F.when(depth >= 1, _deletions(word)).otherwise(F.array().cast("array<string>"))
    twice = F.when(depth >= 2, F.flatten(F.transform(_deletions(word), _deletions))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(word), once, twice))


def _allowed(word: Column, max_edits: int) -> Column:
    n = F.length(word)
    return F.least(F.lit(max_edits), F.when(n >= TWO_EDITS_LENGTH, 2).when(n >= FUZZY_LENGTH, 1).otherwise(0))


def token_pairs(query_tokens: DataFrame, name_tokens: DataFrame, max_edits: int = 2) -> DataFrame:
    """(t, nt, e): words of queries and names within the edits that the query's word allows.

    Two words within k edits share a word or what is left of both after at most k deletions, so they meet by such
    signatures and no word is compared with all others; the distance is then computed on what met."""
    q = query_tokens.select("t").distinct().withColumn("k", _allowed(F.col("t"), max_edits)).withColumn("s", F.explode(signatures(F.col("t"), F.col("k"))))
    # A name's word may be shorter than the query's by as many letters as there are edits.
    reach = F.least(F.lit(max_edits), F.when(F.length("nt") >= TWO_EDITS_LENGTH - 2, 2).when(F.length("nt") >= FUZZY_LENGTH, 1).otherwise(0))
    n = name_tokens.select("nt").distinct().withColumn("s", F.explode(signatures(F.col("nt"), reach)))
    met = q.join(n, "s").where((F.length("nt") >= FUZZY_LENGTH) | (F.col("t") == F.col("nt"))).select("t", "nt", "k").distinct()
    return met.withColumn("e", F.when(F.col("t") == F.col("nt"), 0).otherwise(_edits("t", "nt", "k"))).where(F.col("e") <= F.col("k")).select("t", "nt", "e")


def resolve_queries(queries: DataFrame, names: DataFrame, max_edits: int = 2) -> DataFrame:
    """Best place per search string.

    ``queries``: query_id, q. ``names``: name_id, name. A string repeats many times, so distinct strings are
    resolved once. A name scores the share of the string's words that it contains, exactly or within one edit (two from
    eight letters on; a swap of neighbours is one), less a tenth an edit and a hundredth a word of its own beside them.
    Ties go to the least name_id; a string without any such word finds nothing.

    Names are looked up by the string's rarest word first. A name without the r rarest words scores (n - r) / n at most,
    so a string whose best is above that is settled; only the others go on to the next word, and a word that many
    names hold is looked up for those strings alone that nothing rarer settles."""
    if not 0 <= max_edits <= 2:
        raise ValueError("max_edits is 0, 1 or 2")
    qs = materialize(queries.select("q", comparable("q").alias("norm")).distinct())
    words = lambda c: F.array_distinct(F.split(c, " "))
    qt = qs.select("norm").where(F.length("norm") > 0).distinct().withColumn("tokens", words("norm")).withColumn("n", F.size("tokens")).select("norm", "n", F.explode("tokens").alias("t"))
    nt = names.select("name_id", comparable("name").alias("norm")).where(F.length("norm") > 0).withColumn("tokens", words("norm"))
    nt = materialize(nt.withColumn("m", F.size("tokens")).select("name_id", "m", F.explode("tokens").alias("nt")))
    pair = materialize(token_pairs(qt, nt, max_edits))
    size = pair.join(nt.groupBy("nt").agg(F.count(F.lit(1)).alias("c")), "nt").groupBy("t").agg(F.sum("c").alias("c"))
    rarest = Window.partitionBy("norm").orderBy(F.coalesce("c", F.lit(0)), "t")
    qt = materialize(qt.join(size, "t", "left").withColumn("r", F.row_number().over(rarest)))
    found, open_ = None, qt.select("norm", "n").distinct()
    for r in range(1, (qt.agg(F.max("n")).first()[0] or 0) + 1):
        known = open_.join(qt.where(F.col("r") == r).select("norm", "t"), "norm").join(pair.select("t", "nt"), "t").join(nt.select("nt", "name_id", "m"), "nt").select("norm", "n", "name_id", "m").distinct()
        hit = known.join(qt.select("norm", "t"), "norm").join(pair, "t").join(nt.select("name_id", "nt"), ["name_id", "nt"]).groupBy("norm", "n", "name_id", "m", "t").agg(F.min("e").alias("e"))
        sc = hit.groupBy("norm", "n", "name_id", "m").agg(F.count(F.lit(1)).alias("k"), F.sum("e").alias("edits"))
        score = F.round(F.col("k") / F.col("n") - 0.1 * F.col("edits") - 0.01 * (F.col("m") - F.least("k", "m")), 6)
        rows = sc.select("norm", "name_id", score.alias("score"), "edits")
        rows = rows if found is None else rows.unionByName(found)
        found = materialize(rows.groupBy("norm").agg(F.min_by(F.struct("name_id", "score", "edits"), F.struct(-F.col("score"), F.col("name_id"))).alias("x")).select("norm", "x.*"))
        open_ = materialize(open_.where(F.col("n") > r).join(found.select("norm", "score"), "norm", "left").where(F.col("score").isNull() | (F.col("score") <= (F.col("n") - r) / F.col("n"))).select("norm", "n"))
        if open_.isEmpty():
            break
    best = found if found is not None else qs.select("norm", F.lit(None).alias("name_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("long").alias("edits")).limit(0)
    q = queries.join(qs.join(best, "norm", "left").withColumnRenamed("q", "_q"), F.col("q").eqNullSafe(F.col("_q")), "left")
    return q.select("query_id", "name_id", "score", "edits")
