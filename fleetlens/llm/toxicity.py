"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character inputs.

A text is read in overlapping windows of words. A word's input is its own vector, if it is a learned word,
and the vectors of its character n-grams; both recurrences read the window, attention pools their states
into one number. A text's score weighs its strongest window, the mean of all and their count. Trained in numpy."""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize

#: Bounds of the fit: labelled rows of each class, chosen by a hash of the key, and windows of each, spread evenly over its text.
TRAIN_DOCS, TRAIN_WINDOWS = 2_000, 6
#: Words of a window, words between the starts of two, characters of a word (a longer one counts as several).
WINDOW, STRIDE, WORD_CHARS = 64, 32, 24
HIDDEN, INPUT, BUCKETS, GRAMS = 12, 12, 1 << 16, (3, 5)
EPOCHS, BATCH, SEED = 6, 256, 7
#: Word inputs that a worker keeps; windows that go through the network together.
CACHE_WORDS, LANES = 200_000, 1024
_WORD = re.compile(r"[^\W_]+")


def words_in(token: str) -> list[str]:
    """The words of a lower-cased token without white space: its runs of letters and digits."""
    return [run[i : i + WORD_CHARS] for run in _WORD.findall(token) for i in range(0, len(run), WORD_CHARS)]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of the character n-grams of all words, in order; how many each word has)."""
    marked = [f"^{w}$" for w in words]
    c = np.frombuffer("".join(marked).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    sizes = np.array([len(m) for m in marked], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(c))  # characters from here to the word's end
    owners, buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, dtype=np.uint64)
        for j in range(n):
            h = (h ^ c[at + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        owners.append(word[at])
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
    owners, buckets = np.concatenate(owners), np.concatenate(buckets)
    return buckets[np.argsort(owners, kind="stable")], np.bincount(owners, minlength=len(words))


def _sums(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, ``sizes`` of them each; none is zero."""
    out = np.zeros((len(sizes), rows.shape[1]), dtype=rows.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(rows, (np.cumsum(sizes) - sizes)[some])
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """All weights. Gates stand side by side: update, reset, candidate; then the same for the other direction."""

    words: dict[str, int]
    word_vectors: np.ndarray
    gram_vectors: np.ndarray
    into: np.ndarray  # (INPUT, 6 * HIDDEN)
    bias: np.ndarray  # (6 * HIDDEN)
    ahead: np.ndarray  # (HIDDEN, 3 * HIDDEN)
    back: np.ndarray
    attention: np.ndarray  # (2 * HIDDEN)
    out: np.ndarray  # (2 * HIDDEN)
    offset: np.ndarray  # (1)
    pooling: np.ndarray = field(default_factory=lambda: np.zeros(5))

    def inputs(self, words: list[str]) -> np.ndarray:
        """Gate inputs of words: (words, 6 * HIDDEN)."""
        buckets, sizes = grams(words)
        x = _sums(self.gram_vectors[buckets], sizes) / np.sqrt(np.maximum(1, sizes))[:, None]
        x += self.word_vectors[[self.words.get(w, 0) for w in words]]
        return (x @ self.into + self.bias).astype(np.float32)

    def logits(self, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """A number per window. ``rows`` (WINDOW, windows) names rows of ``table``; the last row of it is padding."""
        out = np.empty(rows.shape[1])
        for i in range(0, rows.shape[1], LANES):
            part = rows[:, i : i + LANES]
            out[i : i + LANES] = self._pooled(_states(table, part, self.ahead, self.back)[0], part == len(table) - 1)[0]
        return out

    def _pooled(self, h: np.ndarray, empty: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = h @ self.attention
        e[empty] = -1e9
        e = np.exp(e - e.max(axis=0))
        share = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", share, h)
        return pooled @ self.out + self.offset[0], share, pooled


def padding() -> np.ndarray:
    """Gate inputs that leave the state as it is."""
    row = np.zeros((1, 6 * HIDDEN), dtype=np.float32)
    row[0, :HIDDEN] = row[0, 3 * HIDDEN : 4 * HIDDEN] = 40
    return row


def _states(table: np.ndarray, rows: np.ndarray, ahead: np.ndarray, back: np.ndarray, keep: bool = False):
    """States of both recurrences at all words, (WINDOW, windows, 2 * HIDDEN); with ``keep`` what their slopes need."""
    n, lanes = rows.shape
    hs, kept = np.empty((n, lanes, 2 * HIDDEN), dtype=np.float32), []
    for first, weights, order in ((0, ahead, range(n)), (HIDDEN, back, range(n - 1, -1, -1))):
        weights = weights.astype(np.float32)
        mine = table[:, 3 * first : 3 * first + 3 * HIDDEN]
        h = np.zeros((lanes, HIDDEN), dtype=np.float32)
        for t in order:
            x, u = mine[rows[t]], h @ weights
            gates = x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :]
            np.tanh(c, out=c)
            if keep:
                kept.append((t, h, gates, c, u[:, 2 * HIDDEN :]))
            h = c + z * (h - c)
            hs[t, :, first : first + HIDDEN] = h
    return hs, kept


def starts(words: int) -> np.ndarray:
    """Where the windows of a text of so many words begin; every word is in one at least, a text without words has one too."""
    return np.arange(max(0, -(-(words - WINDOW) // STRIDE)) + 1) * STRIDE


def fit(windows: list[tuple[object, float, str]], epochs: int = EPOCHS) -> Network:
    """Learn from (text's key, its label, words of one of its windows joined by spaces).

    Windows start with the label of their text. From the third epoch on a window of a labelled text counts only
    if the network itself finds it toxic, or finds no other window of that text more so."""
    rng = np.random.default_rng(SEED)
    split = [w.split() for _, _, w in windows]
    y = np.array([float(label) for _, label, _ in windows])
    texts = {}
    text = np.array([texts.setdefault((k, label), len(texts)) for k, label, _ in windows], dtype=np.int64)
    vocabulary = list(dict.fromkeys(w for s in split for w in s))
    number = {w: i for i, w in enumerate(vocabulary)}
    spread = Counter(w for s in split for w in set(s))
    known = {w: 1 + i for i, w in enumerate(w for w in vocabulary if spread[w] >= 3)}
    rows = np.full((WINDOW, len(windows)), len(vocabulary), dtype=np.int64)
    for j, s in enumerate(split):
        rows[: len(s), j] = [number[w] for w in s]
    draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    net = Network(known, np.zeros((len(known) + 1, INPUT)), np.zeros((BUCKETS, INPUT)), draw(INPUT, 6 * HIDDEN), np.zeros(6 * HIDDEN), draw(HIDDEN, 3 * HIDDEN),
                  draw(HIDDEN, 3 * HIDDEN), 0.1 * draw(2 * HIDDEN), draw(2 * HIDDEN), np.zeros(1))
    if not len(y) or y.min() == y.max():
        net.out[:] = 0
        return net
    buckets, sizes = grams(vocabulary)
    at = np.cumsum(sizes) - sizes
    own = np.array([known.get(w, 0) for w in vocabulary], dtype=np.int64)
    dense = ("into", "bias", "ahead", "back", "attention", "out", "offset")
    moments = {k: [np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))] for k in dense}
    seen = {k: np.full_like(getattr(net, k), 1e-6) for k in ("word_vectors", "gram_vectors")}
    # Both classes weigh the same.
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    counts, step = np.ones(len(y), dtype=bool), 0
    for epoch in range(epochs):
        found = np.full(len(y), np.nan)
        order = rng.permutation(np.flatnonzero(counts))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            ids, place = np.unique(rows[:, pick], return_inverse=True)
            place = place.reshape(WINDOW, -1)
            if ids[-1] == len(vocabulary):
                ids = ids[:-1]
            entry = np.repeat(at[ids] - (np.cumsum(sizes[ids]) - sizes[ids]), sizes[ids]) + np.arange(sizes[ids].sum())
            norm = 1 / np.sqrt(np.maximum(1, sizes[ids]))[:, None]
            vectors = _sums(net.gram_vectors[buckets[entry]], sizes[ids]) * norm + net.word_vectors[own[ids]]
            dropped = rng.random(len(ids)) < 0.2  # some words must do by their characters
            vectors[dropped] -= net.word_vectors[own[ids[dropped]]]
            table = np.concatenate([(vectors @ net.into + net.bias).astype(np.float32), padding()])
            hs, kept = _states(table, place, net.ahead, net.back, keep=True)
            logit, share, pooled = net._pooled(hs, place == len(ids))
            p = _sigmoid(logit)
            found[pick] = p
            d = (p - y[pick]) * weight[pick] / len(pick)
            slopes = {"out": pooled.T @ d, "offset": np.array([d.sum()])}
            dpool = d[:, None] * net.out
            dshare = np.einsum("bh,tbh->tb", dpool, hs)
            de = share * (dshare - (share * dshare).sum(axis=0))
            slopes["attention"] = np.einsum("tb,tbh->h", de, hs)
            dh = share[:, :, None] * dpool + de[:, :, None] * net.attention
            dtable = np.zeros((len(ids) + 1, 6 * HIDDEN))
            for side, name in ((0, "ahead"), (1, "back")):
                u, du, carry = getattr(net, name), np.zeros((HIDDEN, 3 * HIDDEN)), np.zeros((len(pick), HIDDEN))
                gates_at = np.empty((WINDOW, len(pick), 3 * HIDDEN))
                for t, h, gates, c, uc in reversed(kept[side * WINDOW : (side + 1) * WINDOW]):
                    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
                    g = dh[t, :, side * HIDDEN : (side + 1) * HIDDEN] + carry
                    dc = g * (1 - z) * (1 - c * c)
                    dz, dr = g * (h - c) * z * (1 - z), dc * uc * r * (1 - r)
                    gates_at[t] = np.concatenate([dz, dr, dc], axis=1)
                    du_in = np.concatenate([dz, dr, dc * r], axis=1)
                    du += h.T @ du_in
                    carry = g * z + du_in @ u.T
                slopes[name] = du
                flat, cols = place.ravel(), gates_at.reshape(-1, 3 * HIDDEN)
                by = np.argsort(flat, kind="stable")
                dtable[:, 3 * side * HIDDEN : 3 * (side + 1) * HIDDEN] += _sums(cols[by], np.bincount(flat, minlength=len(ids) + 1))
            dtable = dtable[:-1]
            slopes["into"], slopes["bias"] = vectors.T @ dtable, dtable.sum(axis=0)
            dx = dtable @ net.into.T
            step += 1
            for k in dense:
                m, v = moments[k]
                m += 0.1 * (slopes[k] - m)
                v += 0.01 * (slopes[k] ** 2 - v)
                getattr(net, k)[...] -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            for k, index, g in (("gram_vectors", buckets[entry], np.repeat(dx * norm, sizes[ids], axis=0)), ("word_vectors", own[ids], np.where(dropped[:, None], 0, dx))):
                vectors_k, by = getattr(net, k), np.argsort(index, kind="stable")
                hit, n = np.unique(index, return_counts=True)
                total = _sums(g[by], n) + 1e-6 * vectors_k[hit]
                seen[k][hit] += total**2
                vectors_k[hit] -= 0.05 * total / np.sqrt(seen[k][hit])
            net.word_vectors[0] = 0
        if epoch >= 1:
            found = np.where(np.isnan(found), 0, found)
            top = np.zeros(len(texts))
            np.maximum.at(top, text, found)
            counts = (y == 0) | (found >= 0.5) | (found >= top[text])
    for k in ("word_vectors", "gram_vectors", "into", "bias", "ahead", "back", "attention", "out"):
        setattr(net, k, getattr(net, k).astype(np.float32))
    return net


class Reader:
    """The words of texts as rows of a table of gate inputs, kept for the worker's next texts within a bound."""

    def __init__(self, net: Network):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}  # a token's row; -1 for none; from -2 on down: several, kept apart
        self.rows: dict[str, int] = {}
        self.several: list[list[int]] = []
        self.table, self.size = np.empty((1024, 6 * HIDDEN), dtype=np.float32), 0

    def _learn(self, tokens: list[str]) -> None:
        split = [words_in(t) for t in tokens]
        new = [w for w in dict.fromkeys(w for s in split for w in s) if w not in self.rows]
        if new:
            end = self.size + len(new)
            if end > len(self.table):
                self.table = np.concatenate([self.table[: self.size], np.empty((max(end, 2 * self.size) - self.size, 6 * HIDDEN), dtype=np.float32)])
            self.table[self.size : end] = self.net.inputs(new)
            self.rows.update(zip(new, range(self.size, end), strict=True))
            self.size = end
        for t, s in zip(tokens, split, strict=True):
            if len(s) == 1:
                self.known[t] = self.rows[s[0]]
            elif not s:
                self.known[t] = -1
            else:
                self.known[t] = -2 - len(self.several)
                self.several.append([self.rows[w] for w in s])

    def windows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table, rows of all windows of all texts, windows of each text)."""
        if self.size > CACHE_WORDS or len(self.known) > 2 * CACHE_WORDS:
            self.clear()
        tokens = [(t or "").lower().split() for t in texts]
        known = self.known
        if new := list(dict.fromkeys(t for s in tokens for t in s if t not in known)):
            for i in range(0, len(new), 50_000):
                self._learn(new[i : i + 50_000])
        table = np.concatenate([self.table[: self.size], padding()])
        parts, counts = [], []
        for s in tokens:
            ids = np.fromiter(map(known.__getitem__, s), dtype=np.int64, count=len(s))
            if len(ids) and ids.min() < -1:
                ids = np.array([x for k in ids.tolist() for x in ([k] if k >= -1 else self.several[-2 - k])], dtype=np.int64)
            ids = ids[ids >= 0]
            begin = starts(len(ids))
            padded = np.append(ids, np.full(begin[-1] + WINDOW - len(ids), self.size))
            parts.append(np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[begin])
            counts.append(len(begin))
        return table, np.concatenate(parts).T, np.array(counts)


def _pool(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """What a text's score is read from: its strongest window, the mean of all, both together, and their number."""
    first = np.cumsum(counts) - counts
    top = np.clip(np.maximum.reduceat(logits, first), -12, 12)
    mean = np.add.reduceat(_sigmoid(logits), first) / counts
    return np.column_stack([np.ones(len(counts)), top / 4, mean, _sigmoid(top) * np.sqrt(mean), np.log(counts)])


def fit_pooling(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50 if len(y) else 0):
        p = _sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        move = np.linalg.solve(h, x.T @ (weight * (y - p)) - 0.05 * w)
        w += np.clip(move, -2, 2)
    return w


#: The reader of the network in use, by a name that each broadcast gets.
_readers: dict[str, Reader] = {}
#: Characters of texts that go through the network together.
_GROUP = 400_000


def _grouped(b: pa.RecordBatch) -> Iterator[tuple[int, int, list]]:
    texts, begin, chars = b.column(1).to_pylist(), 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "") + 200
        if chars > _GROUP or i == len(texts) - 1:
            yield begin, i + 1, texts[begin : i + 1]
            begin, chars = i + 1, 0


def _some_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys, labels, said = [], [], []
        for k, text, y in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            words = [w for t in (text or "").lower().split() for w in words_in(t)]
            at = starts(len(words))
            for i in at[np.unique(np.linspace(0, len(at) - 1, TRAIN_WINDOWS).round().astype(int))].tolist():
                keys.append(k)
                labels.append(y)
                said.append(" ".join(words[i : i + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(labels, pa.float64()), pa.array(said, pa.string())], names=["key", "y", "words"])


def learn(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_docs: int = TRAIN_DOCS) -> Network:
    """The network for ``labelled`` (key, label) rows of ``docs``, from ``train_docs`` of each class at most."""
    lab = labelled.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), (F.col(label) > 0).cast("double").alias("y")).distinct()
    lab = materialize(lab)
    shares = {r.y: r.n for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64(F.col("key"), F.lit(SEED)), "key")
    few = lab.where("y > 0").orderBy(*order).limit(train_docs).unionAll(lab.where("y = 0").orderBy(*order).limit(train_docs))
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sample = materialize(d.join(F.broadcast(few), "key"))  # 2 * train_docs rows at most
    got = sample.select("key", "text", "y").mapInArrow(_some_windows, "key long, y double, words string").toPandas()
    net = fit(sorted(zip(got["key"], got["y"], got["words"], strict=True)))
    shared, name = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _read(batches, name, shared):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *map(pa.array, x.T.copy())], names=["key", "y", *"abcde"])

    x = sample.select("key", "text", "y").mapInArrow(pooled, "key long, y double, a double, b double, c double, d double, e double").toPandas().sort_values(["key", "y", *"abcde"])
    y = x["y"].to_numpy()
    # Classes weigh as in all labelled rows, whatever the sample's shares.
    weight = np.array([shares[v] for v in (0.0, 1.0)])[y.astype(int)] / np.maximum(1, np.bincount(y.astype(int), minlength=2))[y.astype(int)] if len(y) and len(shares) == 2 else np.ones(len(y))
    net.pooling = fit_pooling(x[[*"abcde"]].to_numpy(), y, weight / max(1e-9, weight.mean() if len(y) else 1))
    return net


def _read(batches: Iterator[pa.RecordBatch], name: str, shared) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Each batch with the pooled numbers of its texts."""
    reader = _readers.get(name)
    if reader is None:
        _readers.clear()
        reader = _readers[name] = Reader(shared.value)
    for b in batches:
        out = [np.zeros((0, 5))]
        for _, _, texts in _grouped(b):
            table, rows, counts = reader.windows(texts)
            out.append(_pool(reader.net.logits(table, rows), counts))
        yield b, np.concatenate(out)


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """(key, score, predicted) of every row of ``docs``, from all windows of its whole text.

    Null and empty texts, and those without a letter or digit, are one empty window and get the same score.
    Repeated rows get equal rows. A network without examples of both classes scores everything by the share of
    toxic labels, 0.5 without any."""
    shared, name = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex  # BUCKETS and a bounded sample's words bound it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _read(batches, name, shared):
            s = _sigmoid(x @ net_pooling)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["key", "score", "predicted"])

    net_pooling = net.pooling
    d = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    return d.mapInArrow(run, "key long, score double, predicted int").withColumnRenamed("key", key)
