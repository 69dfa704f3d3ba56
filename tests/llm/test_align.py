import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers

from fleetlens.llm import align
from tokenizers import Tokenizer

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", None, " ", "  ", "a", "a  b\n\tc ", " lead", "x y 　 z", "it's we'll 'tis", "a▁b", "<|endoftext|> <s> <0x41>", "naïve café \U0001f600\U0001f600 ok", "\n\n a\n \n b\r\n",
       "日本語 テスト 漢字", "x" * 3000, "ab " * 2000, "\x1c \x85   q", "é é", "1234 5678,90 $$$ %%% a.b.c", "﻿ bom", "tail \n", "ß" * 700 + " ö"]


WHOLE = Tokenizer.from_file(A)
WHOLE.encode_special_tokens = True


def brute(rows):
    """Whole texts through both tokenizers, groups by sets of ends, links pair by pair."""
    al = align.Aligner(A, B)
    docs, per = [], Counter()
    for _, text in rows:
        a = WHOLE.encode(" " + text, add_special_tokens=False).ids if text else []
        b = al.b.encode(text) if text else []
        raw = b" " + text.encode() if text else b""
        if b"".join(al.a_bytes[k] for k in a) != raw or b"".join(al.b_bytes[k] for k in b) != raw or not text:
            docs.append(([], [], []))
            continue
        def ends(ids, table):
            at, out = 0, []
            for k in ids:
                at += len(table[k])
                out.append(at)
            return out
        common = sorted(set(ends(a, al.a_bytes)) & set(ends(b, al.b_bytes)))
        groups, i, j, ea, eb = [], 0, 0, ends(a, al.a_bytes), ends(b, al.b_bytes)
        for c in common:
            k, m = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        docs.append((a, b, groups))
        per.update({(x, y) for ga, gb in groups for x in ga for y in gb})
    top = defaultdict(int)
    for (x, _), n in per.items():
        top[x] = max(top[x], n)
    out = []
    for (key, _), (a, b, groups) in zip(rows, docs, strict=True):
        links = Counter()
        for ga, gb in groups:
            ca, cb = Counter(ga), Counter(gb)
            links.update({(x, y): ca[x] * cb[y] for x in ca for y in cb})
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((key, len(a), len(b), len(groups), sum(links.values()), sum(n for p, n in links.items() if per[p] == top[p[0]]),
                    sum(n * per[p] for p, n in links.items()), hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def test_merge_path_is_a_merge_for_any_piece_size():
    rng = random.Random(5)
    for _ in range(120):
        size = rng.randint(1, 60)
        ea, eb = (np.array(sorted({*rng.sample(range(1, size + 1), rng.randint(0, size)), size})) for _ in range(2))
        common = sorted(set(ea.tolist()) & set(eb.tolist()))
        number = lambda e: [sum(c < x for c in common) for x in e.tolist()]  # noqa: B023,E731
        spans = lambda e: list(zip([0, *e.tolist()[:-1]], e.tolist(), strict=True))
        both = sorted((i, j) for i, (s, t) in enumerate(spans(ea)) for j, (u, v) in enumerate(spans(eb)) if s < v and u < t)
        for work in (1, 2, 3, 7, 64):
            ga, gb, oa, ob = align.merge_path(ea, eb, work)
            assert ga.tolist() == number(ea) and gb.tolist() == number(eb)
            assert sorted(zip(oa.tolist(), ob.tolist(), strict=True)) == both


def test_chunks_give_the_tokens_of_whole_texts():
    """But for texts with the piece mark, which never come back byte by byte."""
    al, rng = align.Aligner(A, B), random.Random(2)
    odd = [" ", "  ", "\n", "\t", "a", "Bc", "é", "'s", ".", "12", "　", "\x85", "\x1c", "日", "\U0001f600", "-"]
    texts = [t for t in ODD if t and "▁" not in t] + ["".join(rng.choice(odd) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    for t in texts:
        parts = al.chunks(t)
        assert " ".join(parts) == t
        assert [k for p in parts for k in al.a.encode_ordinary(" " + p)] == WHOLE.encode(" " + t, add_special_tokens=False).ids
        assert [k for p in parts for k in al.b.encode(p)] == al.b.encode(t)


def test_alignment_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for block_chars in (20_000, align.BLOCK_CHARS):
        assert sorted(map(tuple, align.align(docs.repartition(5), A, B, block_chars=block_chars).collect()), key=str) == brute(rows)


def test_alignment_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(align, "SPELLED", 4)
    rows = [*enumerate(ODD), (3, ODD[4]), (3, ODD[4]), (None, "no key"), (77, "ab ab ab")]
    d = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id long, text string, n_a int, pair string")
    assert sorted(map(tuple, align.align(d, A, B).collect()), key=str) == brute(rows)
    assert align.align(d.limit(0), A, B).count() == 0
