"""Exact top-k inner-product search by MaxScore.

A dimension is a term, its column in a shard a posting list. A query's terms are ordered by the most
they can add; the essential ones, without which no row can reach the current k-th score, are traversed
over the shard, and the others are probed only for rows that stay competitive. Shards are merged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize

#: Queries that one broadcast carries, rows of a shard that are searched at once, rows that give the first bound.
QUERY_BLOCK, SHARD_ROWS, SEED_ROWS = 8192, 32_768, 256
SCALE = 256.0
#: Non-essential terms probed between two looks at who is still competitive.
PROBE = 4
_EXACT = 2.0**53
#: The largest double below the end of a long.
_LONG = (1 << 63) - 1024


def vectors(ids: pa.Array, lists: pa.Array, scale: float = SCALE) -> tuple[np.ndarray, np.ndarray]:
    """(ids, whole numbers as a float matrix) of the usable rows: floor(scale * x), x as double.

    Null ids and vectors, and vectors with a null or non-finite component, are left out; shorter
    vectors miss the last terms, which then add nothing."""
    usable = np.asarray(ids.is_valid()) & np.asarray(lists.is_valid())
    ids, lists = ids.filter(pa.array(usable)), lists.filter(pa.array(usable))
    n = np.asarray(lists.value_lengths().fill_null(0), dtype=np.int64)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = int(n.max(initial=0))
    x = np.zeros((len(n), width))
    x[np.arange(width)[None, :] < n[:, None]] = flat
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(scale * x[good])
    return ids.to_numpy()[good], x


class Shard:
    """Posting lists of some rows, by dimension, with the least and largest weight of each."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, width: int):
        x = np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width] if x.shape[1] != width else x
        self.ids, self.columns = ids, np.ascontiguousarray(x.T)
        self.low, self.high = self.columns.min(axis=1, initial=0.0), self.columns.max(axis=1, initial=0.0)

    def search(self, own: int, q: np.ndarray, score: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best of (score, found) and this shard: score descending, then id ascending."""
        with np.errstate(over="ignore"):
            k, reach = len(score), np.maximum(np.maximum(q * self.low, q * self.high), 0)
            exact = float(np.abs(q) @ np.maximum(self.high, -self.low)) < _EXACT
        order = np.argsort(-reach, kind="stable")
        q, reach = q[order], reach[order]
        if not exact:
            return self._slow(own, q, order, score, found)
        left = np.append(np.cumsum(reach[::-1])[::-1], 0.0)  # what terms from here on can add at most
        for a, b in ((0, SEED_ROWS), (SEED_ROWS, len(self.ids))):
            if a >= len(self.ids):
                break
            floor = score[-1]
            # Essential: up to the first term from which on a row could not reach the k-th score by itself.
            essential = int(np.searchsorted(-left, -floor, side="right")) if np.isfinite(floor) else len(q)
            essential = min(max(essential, 1), len(q))
            part = q[:essential] @ self.columns[order[:essential], a:b]
            rows = np.flatnonzero(part + left[essential] >= floor)
            part, at = part[rows], essential
            while at < len(q) and len(rows):
                stop = min(at + PROBE, len(q))
                part = part + q[at:stop] @ self.columns[order[at:stop]][:, a + rows]
                stay = part + left[stop] >= floor
                rows, part, at = rows[stay], part[stay], stop
            score, found = best(k, np.append(score, part), np.append(found, self.ids[a + rows]), own)
        return score, found

    def _slow(self, own: int, q: np.ndarray, order: np.ndarray, score: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums too large for doubles, in whole numbers; they are given as the nearest double and stop at the ends of a long."""
        weights = [int(v) for v in q]
        sums = [sum(w * int(v) for w, v in zip(weights, col, strict=True)) for col in self.columns[order].T]
        old = [s if not np.isfinite(s) else int(s) for s in score.tolist()]
        pairs = sorted(((-max(-_LONG, min(_LONG, s)), int(i)) for s, i in zip(sums, self.ids.tolist(), strict=True) if i != own), key=lambda p: p)
        pairs = sorted([(-s, int(i)) for s, i in zip(old, found.tolist(), strict=True)] + pairs)
        seen: dict[int, float] = {}
        for s, i in pairs:
            seen.setdefault(i, -s)
            if len(seen) == len(score):
                break
        out = list(seen.items()) + [(-1, -np.inf)] * (len(score) - len(seen))
        return np.array([float(s) for _, s in out]), np.array([i for i, _ in out])


def best(k: int, score: np.ndarray, ids: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of distinct ids other than ``own``; repeated ids count once, with their best score."""
    keep = np.isfinite(score) & (ids != own)
    score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))
    score, ids = score[order], ids[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    pad = k - len(first)
    return np.append(score[first], np.full(pad, -np.inf)), np.append(ids[first], np.zeros(pad, dtype=np.int64))


def _search(shared, k: int):
    schema = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        score, found = np.full((len(own), k), -np.inf), np.zeros((len(own), k), dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def work() -> None:
            width = queries.shape[1]
            shard = Shard(np.concatenate([i for i, _ in held]), np.concatenate([np.pad(x, ((0, 0), (0, max(0, width - x.shape[1]))))[:, :width] for _, x in held]), width)
            for i in range(len(own)):
                score[i], found[i] = shard.search(own[i], queries[i], score[i], found[i])

        for b in batches:
            ids, x = vectors(b.column(0), b.column(1))
            if len(ids):
                held.append((ids, x))
                rows += len(ids)
            if rows >= SHARD_ROWS:
                work()
                held, rows = [], 0
        if held:
            work()
        q, j = np.nonzero(np.isfinite(score))
        cols = (own[q], found[q, j], score[q, j].clip(-_LONG, _LONG).astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema, strict=True)], names=[n for n, _ in schema])

    return run


def _blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries, a bounded block at a time."""
    rows: list = []
    for r in queries.toLocalIterator():
        rows.append(r)
        if len(rows) == size:
            yield vectors(pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.list_(pa.float64())))
            rows = []
    if rows:
        yield vectors(pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.list_(pa.float64())))


def top_k(table: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank from 1, key, score): each query's ``k`` rows of ``table`` with the largest whole
    inner products, ties to the smaller key, never a row with the query's own key.

    ``table`` is scanned once per block of queries; only a block, of bounded size, is broadcast, and a
    shard gives ``k`` rows per query. Unusable vectors (see ``vectors``) take no part. Of repeated keys
    the row with the larger score counts; of repeated queries the least vector. Fewer rows than ``k``
    give all. An empty side gives no rows. Scores are exact below 2**53; beyond that they are the nearest
    double, and stop at the ends of a long."""
    spark = table.sparkSession
    d = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    q = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null and v is not null").where(finite)
    q = materialize(q.groupBy("id").agg(F.min("v").alias("v")))
    parts = None
    for own, x in _blocks(q, block):
        shared = spark.sparkContext.broadcast((own, x))
        part = materialize(_merged(d.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long"), k))
        parts = part if parts is None else parts.unionAll(part)
    if parts is None:
        parts = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    return parts.select("query_id", "rank", F.col("vec_id").alias(key), "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
