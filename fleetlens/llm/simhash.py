"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a common variant within r bits of both. Every
distinct fingerprint emits all its variants, variants meet in a shuffle, and what collides is verified
and linked. To ship little, the shuffle carries a fingerprint once per *prefix* of its variants; the
rest of each variant is spelled out in the task that owns the prefix."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetlens.llm.common import components, materialize, small_batches

WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Variants behind one prefix: what prefixes are sized for on average, and from where a prefix is made longer.
AIM_VARIANTS, GROUP_VARIANTS = 16_000_000, 64_000_000
#: Variants that a task holds at a time; it spells out larger groups piece by piece.
HELD_VARIANTS = 4_000_000
#: Bits by which a heavy prefix grows, in the shuffle and inside a task.
STEP, HELD_STEP = 8, 4
_CHUNK = 65_536


def fingerprint(text: bytes | None, width: int = WORDS) -> int:
    """SimHash of the UTF-8 text: a bit is 1 if over half of the shingles' XXH64 have it."""
    import xxhash

    words = (text or b"").lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(width, len(words))
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(starts), _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=True)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = (2 * ones > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = np.array([fingerprint(t) for t in b.column(1).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["key", "fp"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp long) of every row; null and empty texts have fingerprint 0."""
    d = small_batches(docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").cast("binary").alias("text")))
    return d.mapInArrow(_fingerprints, "key long, fp long")


def _masks(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, bits set) of all masks of at most ``most`` of ``bits`` bits."""
    return [(sum(1 << i for i in c), k) for k in range(most + 1) for c in combinations(range(bits), k)]


def _lengthen(rows: DataFrame, bits: int, half: int) -> DataFrame:
    """Every row once per value that the next ``bits`` bits of its variants take."""
    spent = F.col("spent") + F.col("m.k")
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("mask"), F.lit(k).alias("k")) for m, k in _masks(bits, half)])
    nxt = F.call_function("shiftrightunsigned", F.col("fp"), (F.lit(BITS - bits) - F.col("depth")).cast("int")).bitwiseAND(F.lit((1 << bits) - 1))
    out = rows.withColumn("m", F.explode(F.filter(masks, lambda m: m["k"] + F.col("spent") <= half)))
    return out.select("fp", "rep", (F.shiftleft("prefix", bits).bitwiseOR(nxt.bitwiseXOR(F.col("m.mask")))).alias("prefix"),
                      (F.col("depth") + bits).cast("int").alias("depth"), spent.cast("int").alias("spent"))


def _weight(half: int) -> Column:
    """Variants that a row spells out behind its prefix."""
    left = (F.lit(BITS) - F.col("depth")).cast("double")
    total, term = F.lit(1.0), F.lit(1.0)
    for i in range(1, half + 1):
        term = term * (left - (i - 1)) / i
        total = total + F.when(F.col("spent") <= half - i, term).otherwise(0.0)
    return total


def _pieces(fp: np.ndarray, rows: np.ndarray, spent: np.ndarray, tail: int, half: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(variants, owners) of the last ``tail`` bits, in pieces that share the bits before."""
    reach = np.array([sum(comb(tail, i) for i in range(half - k + 1)) for k in range(half + 1)])
    if len(rows) < 2:
        return
    if reach[spent].sum() > HELD_VARIANTS and tail > HELD_STEP:
        nxt = (fp[rows] >> np.uint64(tail - HELD_STEP)) & np.uint64((1 << HELD_STEP) - 1)
        for value in range(1 << HELD_STEP):
            used = spent + np.bitwise_count(nxt ^ np.uint64(value))
            ok = used <= half
            yield from _pieces(fp, rows[ok], used[ok], tail - HELD_STEP, half)
        return
    variants, owners = [fp[rows]], [rows]
    for k in range(1, half + 1):
        who = rows[spent <= half - k]
        masks = np.array([sum(1 << i for i in c) for c in combinations(range(tail), k)], dtype=np.uint64)
        variants.append((fp[who][None, :] ^ masks[:, None]).ravel())
        owners.append(np.tile(who, len(masks)))
    yield np.concatenate(variants) & np.uint64((1 << tail) - 1), np.concatenate(owners)


def _collide(radius: int):
    half = radius // 2

    def run(table: pa.Table) -> pa.Table:
        # In the order of rep, so that a root is the least rep of its rows.
        table = table.sort_by("rep")
        fp, rep = table.column("fp").to_numpy().view(np.uint64), table.column("rep").to_numpy()
        n, tail = len(fp), BITS - table.column("depth")[0].as_py()
        root = np.arange(n)
        for v, o in _pieces(fp, np.arange(n, dtype=np.int32), table.column("spent").to_numpy().astype(np.int64), tail, half):
            order = np.argsort(v)
            v = v[order]
            same = np.flatnonzero(v[1:] == v[:-1])
            # Neighbours in a run chain all owners of a variant.
            a, b = o[order[same]].astype(np.int64), o[order[same + 1]].astype(np.int64)
            pairs = np.unique(np.minimum(a, b) * n + np.maximum(a, b))
            a, b = pairs // n, pairs % n
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
            a, b = a[near], b[near]
            while len(a):
                old, low = root.copy(), np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                root = root[root]
                if np.array_equal(root, old):
                    break
        # A forest of the links says as much as all of them.
        moved = np.flatnonzero(root != np.arange(n))
        return pa.table({"a": pa.array(rep[moved], pa.int64()), "b": pa.array(rep[root[moved]], pa.int64())})

    return run


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b: rep) that connect all of ``distinct`` (fp, rep) whose fp differ in at most ``radius`` bits.

    Owners of one variant are all within ``radius`` of each other, so a chain of them loses no link:
    a group of any size gives fewer links than it has members, never all pairs. Prefixes under which a
    group would spell out more than GROUP_VARIANTS are made longer, and so spread over more tasks."""
    half = radius // 2
    whole = distinct.count() * sum(comb(BITS, k) for k in range(half + 1))
    bits = max(1, int(np.ceil(np.log2(max(whole, 2) / AIM_VARIANTS))))
    start = distinct.select("fp", "rep", F.lit(0).cast("long").alias("prefix"), F.lit(0).alias("depth"), F.lit(0).alias("spent"))
    todo, ready = _lengthen(start, min(bits, 24), half), None
    while True:
        weights = todo.groupBy("prefix", "depth").agg(F.sum(_weight(half)).alias("w"), F.count("*").alias("n"))
        heavy = materialize(weights.where((F.col("w") > GROUP_VARIANTS) & (F.col("n") > 1) & (F.col("depth") <= BITS - STEP)).select("prefix", "depth"))
        if heavy.isEmpty():
            light = todo
        else:
            light = todo.join(heavy, ["prefix", "depth"], "left_anti")
        ready = light if ready is None else ready.unionByName(light)
        if heavy.isEmpty():
            break
        todo = materialize(_lengthen(todo.join(heavy, ["prefix", "depth"], "left_semi"), STEP, half))
    return ready.groupBy("depth", "prefix").applyInArrow(_collide(radius), "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(key, fingerprint of 16 hex digits, component_id: least key reachable over links).

    Equal fingerprints are one node, combined before the shuffle, so exact copies cost nothing more.
    Null texts count as empty, fingerprint zero, linked like any other; rows with a null key get the
    component of their fingerprint, null if no other row has one; repeated rows are repeated."""
    d = materialize(fingerprints(docs, key, text))
    nodes = materialize(d.groupBy("fp").agg(F.min("key").alias("rep")))
    found = components(links(nodes.where("rep is not null"), radius).select("a", "b"))
    named = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return d.join(named, "fp").select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One document of each component stays: the one with the least key (of repeated keys, one row).
    Rows without a key cannot be named as copies and stay."""
    drop = near_duplicates(docs, key, text, radius).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__drop")).distinct()
    kept = docs.join(drop, docs[key] == F.col("__drop"), "left_anti")
    again = F.row_number().over(W.partitionBy(key, F.when(F.col(key).isNull(), F.xxhash64(text))).orderBy(F.xxhash64(text)))
    return kept.withColumn("__again", again).where("__again = 1").select(*[F.col(f"`{c}`") for c in docs.columns])
