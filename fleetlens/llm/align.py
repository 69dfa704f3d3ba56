"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

The ends of both token sequences are merged along a merge path: binary searches on its diagonals cut the
merge into independent pieces of equal work, the pieces emit overlaps and cuts, and what spans a border of
pieces is stitched by a running count of cuts. How often two ids are linked is counted over the corpus."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

#: Steps of the merge in one piece; links that a group may spell out one by one (larger ones go by distinct ids).
WORK, SPELLED = 64, 4096
#: Characters of the texts of one block: its pairs are counted before they move. A longer text is a block of its own.
BLOCK_CHARS = 4_000_000
#: Characters of new chunks that go to the tokenizers at once.
SLICE_CHARS = 50_000
#: Chunks that a worker keeps; then it starts anew.
CACHE_CHUNKS = 250_000
#: Both tokenizers start a token at a space that no space precedes and no white space follows.
_CUT, _PLAIN = re.compile(r"(?<=[^ ]) (?=\S)"), re.compile(r"^ | \s| $")


def merge_path(ea: np.ndarray, eb: np.ndarray, work: int = WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, A and B token of each overlap) from the ascending ends
    of two token sequences over the same bytes. Groups count from 0 and close where both sequences end."""
    n, m = len(ea), len(eb)
    far = np.iinfo(np.int64).max
    ea, eb = np.append(ea.astype(np.int64), far), np.append(eb.astype(np.int64), far)
    d = np.minimum(np.arange(0, n + m + work, work), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (searching := low < high).any():
        middle = (low + high) >> 1
        a_first = ea[middle] <= eb[np.maximum(d - middle - 1, 0)]
        low, high = np.where(searching & a_first, middle + 1, low), np.where(searching & ~a_first, middle, high)
    i, j, end = low[:-1].copy(), (d - low)[:-1].copy(), d[1:]
    cuts = np.zeros(len(i), dtype=np.int64)
    a_group, b_group = np.empty(n, dtype=np.int64), np.empty(m, dtype=np.int64)
    over_a, over_b = [], []
    for _ in range(min(work, n + m)):
        live = i + j < end
        from_a = live & (ea[i] <= eb[j])
        from_b = live & ~from_a
        closing = from_b & (i > 0) & (ea[i - 1] == eb[j])
        a_group[i[from_a]] = cuts[from_a]
        b_group[j[from_b]] = cuts[from_b]
        overlap = from_a | (from_b & ~closing)
        over_a.append(i[overlap])
        over_b.append(j[overlap])
        cuts += closing
        i += from_a
        j += from_b
    before = np.cumsum(cuts) - cuts
    a_group += np.repeat(before, np.diff(low))
    b_group += np.repeat(before, np.diff(d - low))
    return a_group, b_group, np.concatenate([[], *over_a]).astype(np.int64), np.concatenate([[], *over_b]).astype(np.int64)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - _starts(sizes), sizes)


class Aligner:
    """Both tokenizers, and what is known about chunks of text. A chunk is a space and what follows it up to
    the next place where both tokenizers are sure to begin a token; a text is cut there only."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        # The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on, in order.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        vocabulary = Tokenizer.from_file(a_path).get_vocab(with_added_tokens=True)
        ranks = {bytes(letter[c] for c in t): k for t, k in vocabulary.items() if not t.startswith("<|") and all(c in letter for c in t)}
        # The file's merges are in the order of their ids, so ranks say the same; this coder makes no object per token.
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_bytes = [b""] * (max(ranks.values(), default=0) + 1)
        for t, k in ranks.items():
            self.a_bytes[k] = t
        self.b_bytes = [bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode()
                        for k in range(self.b.get_piece_size())]
        self.lengths = [np.array([len(t) for t in table], dtype=np.int64) for table in (self.a_bytes, self.b_bytes)]
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str | None] = []  # None: the tokens do not give the text back
        self.numbers = np.zeros((0, 4), dtype=np.int64)  # A tokens, B tokens, groups, links
        self.first, self.size = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pair, self.times = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @staticmethod
    def chunks(text: str) -> list[str]:
        return text.split(" ") if _PLAIN.search(text) is None else _CUT.split(text)

    def _tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of a space and the text by both tokenizers, or None if either does not give it back."""
        a, b, raw = self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1), b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != raw or b"".join(map(self.b_bytes.__getitem__, b)) != raw:
            return None
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    def _encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids, B ids, the numbers of them in each chunk, and which chunks come back whole."""
        ids, counts, good = ([], []), (np.zeros(len(new), dtype=np.int64), np.zeros(len(new), dtype=np.int64)), np.ones(len(new), dtype=bool)
        at = 0
        while at < len(new):
            end, chars = at, 0
            # Chunks that may meet their neighbours' spaces, or hold the piece mark, are encoded by themselves; the others at one go.
            while end < len(new) and chars < SLICE_CHARS and not ((c := new[end]) == "" or c[0].isspace() or c[-1] == " " or "▁" in c):
                chars += len(c) + 1
                end += 1
            end = max(end, at + 1)
            part = new[at:end]
            got = self._tokens(" ".join(part))
            parts = [(at, end, got)] if got or len(part) == 1 else [(k, k + 1, self._tokens(new[k])) for k in range(at, end)]
            for i, k, both in parts:
                good[i:k] = both is not None
                if both:
                    stops = np.cumsum([len(c.encode()) + 1 for c in new[i:k]])
                    for side in (0, 1):
                        ids[side].append(both[side])
                        counts[side][i:k] = np.diff(np.searchsorted(np.cumsum(self.lengths[side][both[side]]), stops, side="right"), prepend=0)
            at = end
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(ids[0] or none), np.concatenate(ids[1] or none), *counts, good

    def learn(self, new: list[str]) -> None:
        """Tokens, groups and links of chunks not known yet, all in one merge."""
        a, b, a_n, b_n, good = self._encoded(new)
        a_group, b_group, _, _ = merge_path(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        count = int(a_group[-1]) + 1 if len(a) else 0
        in_a, in_b = np.bincount(a_group, minlength=count), np.bincount(b_group, minlength=count)
        a_at, b_at = _starts(in_a), _starts(in_b)
        chunk = np.repeat(np.arange(len(new)), a_n)
        group_chunk = chunk[a_at]
        # Links as (chunk, pair, times): small groups spelled out, large ones by their distinct ids.
        few = in_a * in_b <= SPELLED
        tokens = np.flatnonzero(few[a_group])
        width = in_b[a_group[tokens]]
        where = [np.repeat(chunk[tokens], width)]
        pair = [np.repeat(a[tokens] << 32, width) | b[_spread(b_at[a_group[tokens]], width)]]
        times = [np.ones(len(pair[0]), dtype=np.int64)]
        for g in np.flatnonzero(~few).tolist():
            (xa, ca), (xb, cb) = (np.unique(ids[s : s + k], return_counts=True) for ids, s, k in ((a, a_at[g], in_a[g]), (b, b_at[g], in_b[g])))
            pair.append(((xa << 32)[:, None] | xb[None, :]).ravel())
            times.append(np.outer(ca, cb).ravel())
            where.append(np.full(len(pair[-1]), group_chunk[g]))
        where, pair, times = np.concatenate(where), np.concatenate(pair), np.concatenate(times)
        order = np.argsort(where, kind="stable")
        sizes = np.bincount(where, minlength=len(new))
        groups = np.bincount(group_chunk, minlength=len(new))
        links = np.zeros(len(new), dtype=np.int64)
        np.add.at(links, group_chunk, in_a * in_b)
        self.numbers = np.concatenate([self.numbers, np.column_stack([a_n, b_n, groups, links])])
        self.first, self.size = np.concatenate([self.first, len(self.pair) + _starts(sizes)]), np.concatenate([self.size, sizes])
        self.pair, self.times = np.concatenate([self.pair, pair[order]]), np.concatenate([self.times, times[order]])
        # The text of the groups: ids of a group by commas, A and B by a bar, groups by semicolons. Every id carries the mark before it.
        turn = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        mark = np.full(len(a) + len(b), ord(","), dtype=np.uint8)
        mark[len(a) + b_at] = ord("|")
        mark[a_at] = ord(";")
        marks = pa.StringArray.from_buffers(len(mark), pa.py_buffer(np.arange(len(mark) + 1, dtype=np.int32)), pa.py_buffer(mark[turn]))
        said = pc.binary_join_element_wise(marks, pc.cast(pa.array(np.concatenate([a, b])[turn]), pa.string()), "")
        stops = np.frombuffer(said.buffers()[1], dtype=np.int32)[np.concatenate([[0], np.cumsum(a_n + b_n)])]
        # A chunk's text is what lies between its first id's mark and the next chunk.
        whole = said.buffers()[2].to_pybytes().decode() if len(mark) else ""
        for c, ok, i, k in zip(new, good.tolist(), stops[:-1].tolist(), stops[1:].tolist(), strict=True):
            self.known[c] = len(self.groups)
            self.groups.append(whole[i + 1 : k] if ok else None)

    def numbered(self, texts: list[list[str]]) -> list[list[int]]:
        """The number of each chunk of each text of a block."""
        if len(self.known) > CACHE_CHUNKS:
            self.clear()
        known = self.known
        if new := list(dict.fromkeys(c for t in texts for c in t if c not in known)):
            self.learn(new)
        return [[known[c] for c in t] for t in texts]


_aligners: dict[tuple[str, str], Aligner] = {}

_LISTS = {"doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "sha": pa.string(), "n_pairs": pa.int64()}
_SCHEMA = pa.schema([("block", pa.int64()), ("at", pa.int32()), ("pair", pa.int64()), ("docs", pa.int32()),
                     *[(k, pa.list_(t)) for k, t in _LISTS.items()], ("pair_at", pa.binary()), ("times", pa.binary())])
_DDL = ("block long, at int, pair long, docs int, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
        "sha array<string>, n_pairs array<long>, pair_at binary, times binary")


def _block(al: Aligner, block: int, keys: list, texts: list[str | None]) -> pa.RecordBatch:
    """Rows of a block: one for each pair of ids linked in it, with its documents; then one for its documents,
    which names the pairs by their place among them."""
    chunks = al.numbered([al.chunks(t) if t else [] for t in texts])
    said = [[al.groups[k] for k in x] for x in chunks]
    chunks = [x if None not in s else [] for x, s in zip(chunks, said, strict=True)]
    sha = [hashlib.sha256(";".join(s).encode()).hexdigest() if x else "" for x, s in zip(chunks, said, strict=True)]
    sizes = np.array([len(x) for x in chunks], dtype=np.int64)
    flat = np.fromiter((k for x in chunks for k in x), dtype=np.int64, count=int(sizes.sum()))
    doc = np.repeat(np.arange(len(keys)), sizes)
    sums = np.concatenate([np.zeros((1, 4), dtype=np.int64), np.cumsum(al.numbers[flat], axis=0)])
    stops = np.cumsum(sizes)
    numbers = sums[stops] - sums[stops - sizes]
    used, local = np.unique(flat, return_inverse=True)
    # Pairs of the block, and where each chunk finds its own among them.
    pairs, places = np.unique(al.pair[_spread(al.first[used], al.size[used])], return_inverse=True)
    times, first, width = al.times[_spread(al.first[used], al.size[used])], _starts(al.size[used]), al.size[used]
    seen, often = np.unique(doc * max(1, len(used)) + local, return_counts=True)
    of, chunk = seen // max(1, len(used)), seen % max(1, len(used))
    entry = _spread(first[chunk], width[chunk])
    key = np.repeat(of * max(1, len(pairs)), width[chunk]) + places[entry]
    weight = times[entry] * np.repeat(often, width[chunk])
    order = np.argsort(key, kind="stable")
    key, weight = key[order], weight[order]
    heads = np.flatnonzero(np.diff(key, prepend=-1))
    linked = np.add.reduceat(weight, heads) if len(heads) else weight
    place = key[heads] % max(1, len(pairs))
    n = len(pairs)
    per_doc = np.bincount(key[heads] // max(1, n), minlength=len(keys))
    values = {"doc_id": keys, **{k: numbers[:, i].tolist() for i, k in enumerate(("n_a", "n_b", "n_groups", "n_links"))}, "sha": sha, "n_pairs": per_doc.tolist()}
    none = [None] * n
    cols = [pa.array(np.full(n + 1, block)), pa.array([*range(n), None], pa.int32()), pa.array([*pairs.tolist(), None], pa.int64()),
            pa.array([*np.bincount(place, minlength=n).tolist(), None], pa.int32()),
            *[pa.array([*none, values[k]], pa.list_(t)) for k, t in _LISTS.items()],
            pa.array([*none, place.astype("<i4").tobytes()], pa.binary()), pa.array([*none, linked.astype("<i8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, schema=_SCHEMA)


def _blocks(a_path: str, b_path: str, block_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = _aligners.get((a_path, b_path)) or _aligners.setdefault((a_path, b_path), Aligner(a_path, b_path))
        serial, keys, texts, chars = TaskContext.get().partitionId() << 32, [], [], 0
        for b in batches:
            for k, t in zip(b.column(0), b.column(1), strict=True):
                t = t.as_py()
                if keys and chars + len(t or "") > block_chars:
                    yield _block(al, serial, keys, texts)
                    serial, keys, texts, chars = serial + 1, [], [], 0
                keys.append(k.as_py())
                texts.append(t)
                chars += len(t or "") + 64
        if keys:
            yield _block(al, serial, keys, texts)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                  ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            counts = np.array(r["counts"] or [0], dtype=np.int64)  # twice the count, and one for a highest count
            place, times = np.frombuffer(r["pair_at"], "<i4"), np.frombuffer(r["times"], "<i8")
            stops = np.cumsum(r["n_pairs"])
            best, total = (np.concatenate([[0], np.cumsum(x)]) for x in (times * (counts[place] & 1), times * (counts[place] >> 1)))
            starts = stops - r["n_pairs"]
            yield pa.RecordBatch.from_arrays([pa.array(r["doc_id"], pa.int64()), *[pa.array(r[k], pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")],
                                              pa.array(best[stops] - best[starts]), pa.array(total[stops] - total[starts]), pa.array(r["sha"], pa.string())], schema=_OUT)


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per document: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    ``a_path`` is a byte-level tokenizer file, ``b_path`` a piece model, the same on all executors. Null and
    empty texts, and those that either tokenizer does not give back byte by byte, have no tokens: zeros and ''.
    Repeated rows are documents of their own, in the counts as well. Other columns are not read.

    Documents are taken by blocks of a partition; a block sends each pair of ids linked in it once, with its
    number of documents, so a pair that all documents hold moves once per block. The counts of its pairs come
    back to a block as one array. The highest count of an A id is one row per id of the vocabulary, at most
    65,536 rows: that table alone is broadcast. Blocks are stored once in the shared folder."""
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = stored(d.mapInArrow(_blocks(a_path, b_path, block_chars), _DDL))
    pairs = blocks.where(F.col("pair").isNotNull()).select("block", "at", "pair", "docs")
    total = pairs.groupBy("pair").agg(F.sum("docs").alias("n")).withColumn("a", F.shiftright("pair", 32))
    highest = total.groupBy("a").agg(F.max("n").alias("most"))
    said = total.join(F.broadcast(highest), "a").select("pair", (F.col("n") * 2 + (F.col("n") == F.col("most")).cast("long")).alias("count"))
    back = pairs.select("block", "at", "pair").join(said, "pair").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("at", "count"))).alias("c"))
    back = back.select("block", F.col("c.count").alias("counts"))
    whole = blocks.where(F.col("pair").isNull()).select("block", *_LISTS, "pair_at", "times").join(back, "block", "left").drop("block")
    return whole.mapInArrow(_settle, ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'long'}" for f in _OUT)).withColumnRenamed("doc_id", key)
