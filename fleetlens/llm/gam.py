"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature, round after round; what they add up to is one lookup table
per feature and per chosen pair. A document's score is the sum of its bins' entries."""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, small_batches

#: Bound of the fit: so many labelled rows at most, chosen by a hash of the key.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE, RIDGE = 32, 8, 6, 150, 0.1, 1.0
FEATURES = ("log_words", "word_bytes", "upper_share", "symbols_per_word", "shouts_per_word", "digit_share", "distinct_words", "distinct_triples",
            "echoes_per_word", "repeated_lines", "pipes_per_word", "stops_per_word", "commas_per_word", "words_per_line")
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


def features(text: bytes | None) -> tuple[float, ...]:
    """FEATURES of one UTF-8 text; a null text counts as empty. All are ratios or logarithms."""
    t = text or b""
    words = t.split()
    n, size = len(words), len(t)
    without = lambda chars: size - len(t.translate(None, chars))
    per = 1 / max(1, n)
    lines = [x for x in t.split(b"\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    return (np.log1p(n), sum(map(len, words)) * per, without(_UPPER) / max(1, without(_LETTERS)), without(b"#*$%&<>") * per, without(b"!?") * per,
            without(b"0123456789") / max(1, size), len(set(words)) * per / max(1e-9, n**-0.25 if n else 1.0), triples / max(1, n - 2),
            sum(map(operator.eq, words, words[1:])) * per, 1 - len(set(lines)) / max(1, len(lines)), without(b"|") * per, without(b".") * per, without(b",") * per,
            n / max(1, len(lines)))


def featurize(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, one double per feature) of every row, over its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, x.T.copy())], names=["key", *FEATURES])

    d = small_batches(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text")))
    return d.mapInArrow(run, "key long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Gam:
    """Bin edges and tables; ``score`` adds the bins' entries up."""

    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in {f for p in self.pairs for f in p}}
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """(gain, bins on the left) of the best cut of a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = _gain(cg, ch) + _gain(g.sum() - cg, h.sum() - ch) - _gain(g.sum(), h.sum())
    k = int(np.argmax(gain))
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values per bin of a tree over one feature's bins."""
    gain, k = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The same over a grid of two features: each cut takes the better axis."""
    best = max(((_split(g.sum(axis=1 - a), h.sum(axis=1 - a)), a) for a in (0, 1)), key=lambda x: x[0][0]) if depth else ((0.0, 0), 0)
    (gain, k), axis = best
    if gain <= 1e-9:
        return np.full(g.shape, g.sum() / (h.sum() + RIDGE))
    (g1, g2), (h1, h2) = (np.split(m, [k], axis=axis) for m in (g, h))
    return np.concatenate([_pair_tree(g1, h1, depth - 1), _pair_tree(g2, h2, depth - 1)], axis=axis)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS) -> Gam:
    """Boost main effects in cycles, then the PAIRS pairs whose grids explain most of what is left."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(rate / (1 - rate)))
    n_features = x.shape[1]
    cuts = lambda f, n: np.unique(np.quantile(x[:, f], np.linspace(0, 1, n + 1)[1:-1])) if len(x) else np.array([])
    edges = [cuts(f, BINS) for f in range(n_features)]
    pair_edges = [cuts(f, PAIR_BINS) for f in range(n_features)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    margin = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds if len(y) else 0):
        for f in range(n_features):
            g, h = slopes()
            m = len(tables[f])
            step = RATE * _tree(np.bincount(bins[f], g, m), np.bincount(bins[f], h, m))
            tables[f] += step
            margin += step[bins[f]]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    shape = lambda a, b: (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
    flat = lambda a, b: coarse[a] * shape(a, b)[1] + coarse[b]

    def grid(a: int, b: int, w: np.ndarray) -> np.ndarray:
        return np.bincount(flat(a, b), w, shape(a, b)[0] * shape(a, b)[1]).reshape(shape(a, b))

    g, h = slopes()
    worth = {(a, b): float(_gain(grid(a, b, g), grid(a, b, h)).sum()) for a, b in combinations(range(n_features), 2)} if len(y) else {}
    pairs = sorted(worth, key=lambda p: (-worth[p], p))[:PAIRS]
    pair_tables = [np.zeros(shape(a, b)) for a, b in pairs]
    for _ in range(rounds // 3):
        for k, (a, b) in enumerate(pairs):
            g, h = slopes()
            step = RATE * _pair_tree(grid(a, b, g), grid(a, b, h))
            pair_tables[k] += step
            margin += step.ravel()[flat(a, b)]
    return Gam(bias, edges, tables, pairs, pair_edges, pair_tables)


def score(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, score, predicted) of every row of ``docs``; the model is fitted on ``labelled`` (key, label).

    Features are computed once for all rows and stored, a few numbers each; at most about ``train_rows``
    labelled rows, chosen by a hash of their key, reach the driver. Null labels and keys are not learned
    from, a label above 0 counts as 1, repeated labels weigh as often as they come. Without any label
    every score is 0.5. Null and empty texts are scored by their features like any other."""
    x = materialize(featurize(docs, key, text))
    lab = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), (F.col(label) > 0).cast("double").alias("y"))
    share = train_rows / max(1, lab.count())
    lab = lab.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30) < share)
    rows = x.join(lab, "key").orderBy("key").toPandas()
    model = fit(rows[list(FEATURES)].to_numpy(dtype=float), rows["y"].to_numpy(dtype=float))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.column_stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["key", "score", "predicted"])

    return x.mapInArrow(run, "key long, score double, predicted int").withColumnRenamed("key", key)
