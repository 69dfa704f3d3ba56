"""The pipeline on the smallest tables, every stage against a brute-force version of itself."""

import re
from collections import Counter

import corpus_pipeline
from test_linededup import BLANK, brute
from test_mixing_packing import brute_mix
from test_simhash import brute_components, brute_fp

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_every_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / name))
        tables.append(spark.read.parquet(str(tmp_path / name)))
    assert all(t.columns == columns for t in tables[:-1])
    raw, clean, lines, once, mixed = ({r.doc_id: r.text for r in t.collect()} for t in tables[:5])
    # Quality rules: documents only lose lines; what is kept passes the base.
    assert 0.8 * len(raw) < len(clean) < len(raw)
    for k, t in clean.items():
        assert len(words(raw[k])) >= 20 and not Counter(t.split("\n")) - Counter(raw[k].split("\n"))
    # Line dedup.
    want, missed = brute(sorted(clean.items())), 0
    for k, t in clean.items():
        unsure = any(len(heads) > 1 for _, _, heads, _ in want[k])
        gone = {p for p, x, heads, (key, at) in want[k] if not (x == heads[0] and (k, p) == (key, at))}
        left = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not unsure:
            missed += lines.get(k) != (left if left.strip(BLANK + "\n") else None)
    assert missed <= 1  # bands miss one pair in 200 at the threshold
    # SimHash: the least of each component.
    comp = brute_components({k: brute_fp(t) for k, t in lines.items()})
    assert once == {k: lines[k] for k in comp if comp[k] == k}
    # Mixing.
    source = {r.doc_id: r.source for r in tables[3].collect()}
    taken, _ = brute_mix([(k, source[k], len(words(t))) for k, t in once.items()])
    times = Counter(r.doc_id for r in tables[4].collect())
    assert {k: n * len(words(once[k])) for k, n in times.items()} == {k: v for k, v in taken.items() if v} and mixed.items() <= once.items()
    assert {r.n_chars == len(r.text) for r in tables[4].collect()} == {True}
    # Packing: every id of every copy once, no padding.
    pieces = tables[5].collect()
    singles = {k for k, n in times.items() if n == 1}
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
    totals = {p.doc_id: p.doc_tokens for p in pieces}
    assert {k: n * totals[k] for k, n in times.items()} == dict(got) and singles
    assert sum(1 for p in corpus_pipeline.run(spark, SF).select("length").collect()) == len(pieces)


def test_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() == 0
        docs = out if out.columns == docs.columns else docs
