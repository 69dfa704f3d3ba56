"""Language identification, words first: a known word votes with its per-language log frequency, an
unseen one with its longest known character n-grams."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, small_batches

#: Bound of the fit: about so many documents of each language, chosen by a hash of the key.
TRAIN_DOCS = 4_000
#: Bounds of the model: most frequent words of a language, and n-grams of a language and order.
WORDS, GRAMS, LONGEST = 30_000, 20_000, 5
UNKNOWN = "und"
_CACHE = 600_000
_PIECE = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """Votes are rows of one matrix, row 0 for no evidence; words and n-grams name their rows."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]  # by order, from 1
    votes: np.ndarray  # (rows, languages): log frequency
    _seen: dict[str, int] = field(default_factory=dict)
    _table: np.ndarray | None = None  # votes and number of pieces of each token seen; row 0 is empty
    _rows: int = 1

    def hits(self, p: str) -> list[int]:
        """The rows whose mean is the vote of one run of letters."""
        k = self.words.get(p)
        if k is not None:
            return [k]
        marked = f"^{p}$"
        size = len(marked)
        for n in range(min(LONGEST, size), 0, -1):
            known = self.grams[n - 1]
            if found := [known[g] for i in range(size - n + 1) if (g := marked[i : i + n]) in known]:
                return found
        return [0]

    def _learn(self, tokens: list[str]) -> None:
        """Keep the votes of tokens not seen yet, all at once; row 0 is for those without a letter."""
        flat: list[int] = []
        segments, pieces_of = [], []
        for token in tokens:
            if token in self._seen:
                continue
            pieces = [q for p in _PIECE.findall(token.lower()) if (q := p if p.isalpha() else "".join(filter(str.isalpha, p)))]
            if not pieces:
                self._seen[token] = 0
                continue
            for p in pieces:
                got = self.hits(p)
                flat += got
                segments.append(len(got))
            self._seen[token] = self._rows + len(pieces_of)
            pieces_of.append(len(pieces))
        if not pieces_of:
            return
        lengths, counts = np.array(segments), np.array(pieces_of)
        by_piece = np.add.reduceat(self.votes[np.array(flat)], np.cumsum(lengths) - lengths) / lengths[:, None]
        by_token = np.add.reduceat(by_piece, np.cumsum(counts) - counts)
        end = self._rows + len(counts)
        if end > len(self._table):
            self._table = np.concatenate([self._table, np.zeros((max(end, len(self._table)), self._table.shape[1]))])
        self._table[self._rows : end, :-1] = by_token
        self._table[self._rows : end, -1] = counts
        self._rows = end

    def predict(self, text: str | None) -> tuple[str, float]:
        tokens = (text or "").split()
        if not tokens or not self.langs:
            return UNKNOWN, 0.0
        if len(self._seen) > _CACHE or self._table is None:
            self._seen, self._table, self._rows = {}, np.zeros((1024, len(self.langs) + 1)), 1
        get = self._seen.get
        rows = [get(t) for t in tokens]
        if None in rows:
            self._learn([t for t, k in zip(tokens, rows, strict=True) if k is None])
            rows = [get(t) for t in tokens]
        total = self._table[np.array(rows, dtype=np.int64)].sum(axis=0)
        if total[-1] == 0:
            return UNKNOWN, 0.0
        votes = total[:-1] / math.sqrt(total[-1])
        best = int(np.argmax(votes))
        return self.langs[best], float(1 / np.exp(votes - votes.max()).sum())


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS) -> Model:
    """Fit on ``labelled`` (the caller leaves the held-out fold away). Null texts and languages are not used.

    Counting is Spark's; only the most frequent words and n-grams of each language reach the driver."""
    d = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    # One number per language: the model itself has a column for each.
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    langs = sorted(counts)
    share = F.element_at(F.create_map(*[F.lit(v) for k in langs for v in (k, train_docs / counts[k])]), F.col("lang")) if langs else F.lit(0.0)
    few = d.where(F.pmod(F.col("h"), F.lit(1 << 30)) / float(1 << 30) < share)
    words = few.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("w")).groupBy("lang", "w").agg(F.count("*").alias("n"))
    words = materialize(words)
    marked = F.concat(F.lit("^"), F.col("w"), F.lit("$"))
    starts = lambda n: F.sequence(F.lit(1), F.length("m") - (n - 1))
    grams = words.select("lang", "n", marked.alias("m")).select("lang", "n", F.explode(F.flatten(F.array(*[
        F.when(F.length("m") >= k, F.transform(starts(k), lambda i, k=k: F.substring(F.col("m"), i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
        for k in range(1, LONGEST + 1)]))).alias("g"))
    grams = grams.groupBy("lang", "g").agg(F.sum("n").alias("n")).withColumn("order", F.length("g"))

    def top(counts: DataFrame, by: list[str], what: str, most: int) -> list:
        rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col("n").desc(), F.col(what)))
        total = F.sum("n").over(W.partitionBy(*by))
        return counts.withColumn("rank", rank).withColumn("total", total).where(F.col("rank") <= most).collect()

    votes, size = [np.zeros((1, len(langs)))], 1

    def table(rows: list, what: str) -> dict[str, int]:
        nonlocal size
        index: dict[str, int] = {}
        for r in rows:
            index.setdefault(r[what], len(index))
        counts, totals = np.zeros((len(index), len(langs))), np.ones(len(langs))
        place = {x: i for i, x in enumerate(langs)}
        for r in rows:
            counts[index[r[what]], place[r.lang]] = r.n
            totals[place[r.lang]] = r.total
        votes.append(np.log((counts + 0.5) / (totals + 0.5 * max(1, len(index)))))
        first, size = size, size + len(index)
        return {k: first + i for k, i in index.items()}

    word_index = table(top(words, ["lang"], "w", WORDS), "w")
    gram_rows = top(grams, ["lang", "order"], "g", GRAMS)
    by_order = [table([r for r in gram_rows if r.order == k], "g") for k in range(1, LONGEST + 1)]
    return Model(langs, word_index, by_order, np.concatenate(votes))


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score) of every row, from its whole text alone.

    ``und`` with score 0 for null texts, texts without a letter, or an empty model. Letters that the
    model never saw carry no vote: the first language then wins with an even share. Repeated rows get
    equal rows; the score is the winner's share of votes, damped by the root of the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by WORDS and GRAMS per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            got = [m.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                                             names=["key", "lang_pred", "score"])

    d = small_batches(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")))
    return d.mapInArrow(run, "key long, lang_pred string, score double").withColumnRenamed("key", key)
