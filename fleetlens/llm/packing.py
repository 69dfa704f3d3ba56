"""Packing token streams into sequences of a fixed length: bounded-space online best fit.

Each partition of the scan tokenizes and packs its documents in one pass, with a fixed number of open
windows; only small rows about pieces leave it. What stays open at the end of a partition is merged in
a second, small step."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialize, small_batches

LENGTH, OPEN_WINDOWS, END_ID = 2048, 16, 1
#: Partitions whose leftovers one task merges: at most this many times OPEN_WINDOWS windows.
MERGED_PARTITIONS = 32
#: Words kept per generation of the cache, and characters of one call to the tokenizer.
CACHE_WORDS, CHUNK_CHARS = 400_000, 200_000
_PIECE = [("doc", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
          ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("group", pa.int64())]
_SCHEMA = pa.schema(_PIECE)
_DDL = "doc long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, group long"


class WordCoder:
    """Ids of whole texts from a tokenizer that never joins words across white space.

    Ids are found per space-separated word and kept in two generations of a bounded cache; words not
    yet known are encoded together and told apart by their offsets."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def _learn(self, words: list[str]) -> None:
        new = []
        for w in dict.fromkeys(words):
            if w not in self.young:
                if (kept := self.old.get(w)) is None:
                    new.append(w)
                else:
                    self.young[w] = kept
        at = 0
        while at < len(new):
            part, size = [], 0
            while at < len(new) and (size < CHUNK_CHARS or not part):
                part.append(new[at])
                size += len(new[at]) + 1
                at += 1
            enc = self.tok.encode(" ".join(part), add_special_tokens=False)
            ids = np.asarray(enc.ids, dtype="<u4")
            starts = np.cumsum([0] + [len(w) + 1 for w in part[:-1]])
            where = np.fromiter((o[0] for o in enc.offsets), dtype=np.int64, count=len(ids))
            ends = np.searchsorted(where, np.append(starts[1:], np.iinfo(np.int64).max), side="left") * 4
            raw, last = ids.tobytes(), 0
            for w, e in zip(part, ends.tolist(), strict=True):
                self.young[w] = raw[last:e]
                last = e

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = text.replace("\n", " ").split(" ")
        get = self.young.get
        try:
            return b"".join([get(w) for w in words])
        except TypeError:
            if len(self.young) > CACHE_WORDS:
                self.old, self.young = self.young, {"": b""}
            self._learn(words)
            young = self.young
            return b"".join([young[w] for w in words])


_coders: dict[str, WordCoder] = {}


class Windows:
    """Open windows of one partition. ``place`` gives the windows that it closed."""

    def __init__(self, length: int, count: int):
        self.length, self.count = length, count
        self.open: list[tuple[int, list]] = []  # (ids in it, pieces)

    def place(self, doc: int | None, ids: bytes, total: int, start: int = 0) -> Iterator[list]:
        n = self.length
        while True:
            size = len(ids) // 4
            if not size:
                return
            if size >= n:
                yield [(doc, start, n, ids[: 4 * n], total)]
                ids, start = ids[4 * n :], start + n
                continue
            fits = [(n - used - size, k) for k, (used, _) in enumerate(self.open) if used + size <= n]
            if fits:
                k = min(fits)[1]
                used, pieces = self.open[k]
                pieces.append((doc, start, size, ids, total))
                if used + size == n:
                    self.open.pop(k)
                    yield pieces
                else:
                    self.open[k] = (used + size, pieces)
                return
            if len(self.open) < self.count:
                self.open.append((size, [(doc, start, size, ids, total)]))
                return
            # None fits: the fullest window is topped up with the head of the document and leaves.
            k = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(k)
            room = n - used
            pieces.append((doc, start, room, ids[: 4 * room], total))
            yield pieces
            ids, start = ids[4 * room :], start + room


def _rows(out: list, pieces: list, sequence: int, keep_ids: bool, group: int) -> None:
    offset = 0
    for doc, start, size, ids, total in pieces:
        out.append((doc, start, size, zlib.crc32(ids), total, sequence, offset, ids if keep_ids else None, group))
        offset += size


def _batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[] for _ in _PIECE]
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(cols, _PIECE, strict=True)], schema=_SCHEMA)


def _pack_partition(path: str, length: int, count: int):
    end = END_ID.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coders.setdefault(path, None) or WordCoder(path)
        _coders[path] = coder
        part = TaskContext.get().partitionId()
        windows, serial = Windows(length, count), part << 32
        for batch in batches:
            rows: list = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = (coder.encode(text) if text else b"") + end
                for pieces in windows.place(doc, ids, len(ids) // 4):
                    _rows(rows, pieces, serial, False, -1)
                    serial += 1
            yield _batch(rows)
        rows = []
        for _, pieces in windows.open:
            _rows(rows, pieces, serial, True, part // MERGED_PARTITIONS)
            serial += 1
        yield _batch(rows)

    return run


def _merge(length: int):
    """Leftover windows of a few partitions, joined end to end and cut at full length; the last rest is
    cut into powers of two, which need no padding."""

    def run(table: pa.Table) -> pa.Table:
        rows: list = []
        group = table.column("group")[0].as_py()
        table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        total = sum(table.column("length").to_pylist())
        sizes = [length] * (total // length)
        sizes += [1 << b for b in range(length.bit_length(), -1, -1) if (total % length) >> b & 1]
        serial, pieces, room = (1 << 62) + (group << 32), [], 0
        left = iter(sizes)
        room = next(left)
        for doc, start, ids, doc_tokens in zip(*(table.column(c).to_pylist() for c in ("doc", "start", "ids", "doc_tokens")), strict=True):
            while ids:
                take = min(room, len(ids) // 4)
                pieces.append((doc, start, take, ids[: 4 * take], doc_tokens))
                ids, start, room = ids[4 * take :], start + take, room - take
                if not room:
                    _rows(rows, pieces, serial, False, group)
                    serial, pieces, room = serial + 1, [], next(left, 0)
        return pa.Table.from_batches([_batch(rows)])

    return run


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file, the same on all executors. Null and empty texts are
    the end id alone. Repeated rows are packed each for itself. A text of any length is cut into full
    sequences first. Every sequence is full but the last of a merge group, which is cut into powers of
    two. Sequence ids are unique, not dense. The packed partitions are stored once in the shared folder,
    so a lost executor never leaves two differing packings of a partition."""
    d = small_batches(docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text")))
    first = materialize(d.mapInArrow(_pack_partition(tokenizer, length, open_windows), _DDL))
    merged = first.where("group >= 0").groupBy("group").applyInArrow(_merge(length), _DDL)
    out = first.where("group < 0").unionAll(merged)
    return out.select(F.col("doc").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
