import re
import zlib
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from fleetlens.llm import mixing, packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def coded(texts):
    tok = Tokenizer.from_file(PATH)
    return [tok.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]


def check_packing(rows, pieces, length=2048):
    want = dict(zip([k for k, _ in rows], coded([t for _, t in rows]), strict=True))
    got, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        ids = want[p.doc_id][p.start : p.start + p.length]
        assert len(ids) == p.length > 0 and p.doc_tokens == len(want[p.doc_id])
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) == p.ids_crc32
        got[p.doc_id].append((p.start, p.length))
        seqs[p.sequence_id].append((p.offset, p.length))
    for k, ids in want.items():
        at = 0
        for start, n in sorted(got[k]):
            assert start == at
            at += n
        assert at == len(ids)
    padding = 0
    for s in seqs.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    assert padding == 0


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_packing([(r.doc_id, r.text) for r in docs.collect()], packing.pack(docs.repartition(5), PATH).collect())


def test_packing_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a<|endoftext|>b it's don't \x1cx é Σ ΑΣ."), (5, "Word " * 30_000), (6, "x\ty\x0bz\r\n" * 9), (7, "ﬁ ½ 漢字 🙂🙂")]
    d = spark.createDataFrame([(k, t, 0, "s") for k, t in rows], "doc_id long, text string, length int, ids string")
    check_packing(rows, packing.pack(d.coalesce(1), PATH).collect())
    assert packing.pack(d.limit(0), PATH).count() == 0
    twice = packing.pack(d.where("doc_id = 5").unionAll(d.where("doc_id = 5")), PATH).collect()
    assert sum(p.length for p in twice) == 2 * len(coded(["Word " * 30_000])[0])


def brute_mix(rows, seed=""):
    """(doc, taken) by the rule in plain loops; rows of (doc, source, size)."""
    import hashlib
    size = defaultdict(int)
    for _, s, n in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    full, target = set(), {}
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        open_ = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        above = {s for s in open_ if weight[s] * level > 2 * size[s]}
        if not above:
            break
        full |= above
    target = {s: 2.0 * size[s] if s in full else weight[s] * level for s in order}
    def klass(n):
        bits = n.bit_length()
        return 8 * bits + ((n >> bits - 4 if bits > 4 else n << 4 - bits) % 8) if n else 0

    out = {}
    for s in order:
        docs = [(k, n) for k, src, n in rows if src == s]
        out.update((k, 0) for k, _ in docs)
        docs = [(k, n) for k, n in docs if n]
        words = defaultdict(int)
        for _, n in docs:
            words[klass(n)] += n
        a = {c: 2.0 ** (0.125 * c / 8) for c in words}
        level, capped = None, 0
        for c in sorted(words, reverse=True):
            x = (target[s] - 2 * capped) / sum(a[b] * words[b] for b in words if b <= c)
            if x * a[c] <= 2:
                level = x
                break
            capped += words[c]
        expected = {c: 2.0 if level is None else max(0.0, min(2.0, level * a[c])) for c in words}
        gap, large, small = 0.0, [], []
        for k, n in docs:
            e = expected[klass(n)]
            out[k] = int(e) * n
            p = e - int(e)
            gap += p * n
            u = (int(hashlib.md5((seed + ("" if k is None else str(k))).encode()).hexdigest()[:13], 16) + 0.5) / 16**13
            if p > 0:
                (large if n > 0.001 * target[s] else small).append(((u / (1 - u)) / (p / (1 - p)), u, k, n, p))
        behind = 0.0
        for _, _, k, n, p in sorted(large, key=lambda x: (x[3], x[1]), reverse=True):
            behind += p * n
            gap -= p * n
            if behind >= n / 2:
                behind -= n
                out[k] += n
        gap += behind
        run = 0
        for _, _, k, n, _ in sorted(small):
            run += n
            if run - n / 2 <= gap:
                out[k] += n
            if run > gap:
                break
    return out, target


def test_mix_against_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text))) for r in docs.collect()]
    taken, target = brute_mix(rows)
    got = mixing.mix(docs).collect()
    assert {r.doc_id: r.taken for r in got} == taken
    by = defaultdict(int)
    for r in got:
        by[r.source] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(by[s] - target[s]) <= 0.005 * target[s] for s in by)
    whole = mixing.mixed(docs)
    assert whole.columns == docs.columns
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in whole.collect()) == sum(taken.values())


def test_draws_of_many_small_documents(spark):
    """Where no document is large: ranks decide, and over seeds a document comes as often as expected."""
    import random
    rng = random.Random(3)
    rows = [(k, "ab"[k % 3 == 0] if k % 50 else None, rng.choice([rng.randint(1, 60), rng.randint(1, 8)])) for k in range(6000)]
    d = spark.createDataFrame([(k, s, "w " * n) for k, s, n in rows], "doc_id long, source string, text string").repartition(7)
    taken, target = brute_mix(rows)
    got = mixing.mix(d).collect()
    assert {r.doc_id: r.taken for r in got} == taken
    by, often, seeds = defaultdict(int), defaultdict(float), 40
    for r in got:
        by[r.source] += r.taken
    assert all(abs(by[s] - target[s]) <= 0.0005 * target[s] + 1 for s in ("a", "b")) and abs(by[None] - target[None]) <= 31
    for seed in range(seeds):
        more, _ = brute_mix(rows, f"s{seed}")
        for k, s, n in rows:
            often[s, n.bit_length()] += more[k] / n / seeds
    # Mean copies rise with the size, whatever the source, and add up to the target.
    mean = {c: often[c] / sum((s, n.bit_length()) == c for _, s, n in rows) for c in often}
    for s in "ab":
        line = [mean[s, b] for b in range(1, 7)]
        assert all(x < y + 0.02 for x, y in zip(line, line[1:])) and line[5] > line[0] and max(line) <= 2
        assert abs(line[5] / line[0] - 2 ** (0.125 * 5)) < 0.15 or max(line) > 1.99


def test_tables_of_any_size_are_attached_alike(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL_TABLE", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "a", 1), (3, "one two three", None, 1), (4, "one two", "b", 1), (4, "one two", "b", 1), (None, "x y z", "b", 1), (5, " \n", "c", 1), (6, "w " * 5000, "b", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, u int")
    got = mixing.mix(d).collect()
    assert len(got) == 8 and {r.size for r in got if r.doc_id in (1, 2, 5)} == {0} and all(r.taken <= 2 * r.size for r in got)
    assert sorted(map(str, mixing.mix(d).collect())) == sorted(map(str, got))
    assert mixing.mix(d.limit(0)).count() == 0 and mixing.mixed(d.limit(0)).count() == 0
    assert mixing.mixed(d).columns == d.columns
