import numpy as np
import pyarrow as pa
import xxhash

from fleetlens.llm import simhash

SCHEMA = "doc_id long, text string, fp int, rep string"


def brute_fp(text):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    sh = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """key -> least key reachable over pairs of at most four differing bits."""
    keys = sorted(fps)
    v = np.array([fps[k] for k in keys], dtype=np.uint64)
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= 4).tolist():
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {k: keys[find(i)] for i, k in enumerate(keys)}


def test_all_of_the_smallest_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    fps = {k: brute_fp(t) for k, t in texts.items()}
    assert {k: r.fingerprint for k, r in got.items()} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {k: r.component_id for k, r in got.items()} == brute_components(fps)


def test_links_of_planted_fingerprints(spark, monkeypatch):
    """Chains, dense balls and lone ones; small groups so that prefixes grow more than once."""
    for name, n in (("AIM_VARIANTS", 30_000), ("GROUP_VARIANTS", 60_000)):
        monkeypatch.setattr(simhash, name, n)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 40)]
    centre = int(rng.integers(0, 2**63))
    fps += [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (150, 2))]
    walk = int(rng.integers(0, 2**63))
    for _ in range(12):
        for b in rng.choice(64, 4, replace=False):
            walk ^= 1 << int(b)
        fps.append(walk)
    fps += [0, 2**64 - 1, 0b11111, 0b1]
    want = brute_components({i: f for i, f in enumerate(dict.fromkeys(fps))})
    rows = [(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(dict.fromkeys(fps))]
    d = spark.createDataFrame(rows, "fp long, rep long")
    from fleetlens.llm.common import components
    found = {r.node: r.component for r in components(simhash.links(d)).collect()}
    assert {i: found.get(i, i) for _, i in rows} == want


def test_odd_rows(spark):
    rows = [(5, None, 1, "x"), (3, "", 1, "x"), (4, " \n\t", 1, None), (None, "one two three four five", 0, None), (9, "one two three four five", 0, None),
            (9, "one two three four five", 0, None), (7, "ONE two", 0, None), (8, "one  two\n", 0, None), (10, "word " * 60_000, 0, None)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(d).collect())
    by = {k: (f, c) for k, f, c in got}
    assert by["5"] == by["3"] == by["4"] == ("0" * 16, 3) and by["7"] == by["8"] and by["7"][1] == 7
    assert by["None"] == by["9"] and by["9"][1] == 9 and len(got) == 9 and by["10"][1] == 10
    kept = simhash.deduplicated(d)
    assert kept.columns == d.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["10", "3", "7", "9", "None"]
    assert simhash.near_duplicates(d.limit(0)).count() == 0 and simhash.deduplicated(d.limit(0)).count() == 0


def test_groups_larger_than_a_task_holds(monkeypatch):
    monkeypatch.setattr(simhash, "HELD_VARIANTS", 3_000)
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 2**63))
    fps = [int(x) for x in rng.integers(0, 2**63, 30)] + [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))]
    fps = list(dict.fromkeys(fps))
    table = pa.table({"fp": pa.array(np.array(fps, dtype=np.uint64).view(np.int64)), "rep": range(len(fps)), "depth": [0] * len(fps), "spent": [0] * len(fps)})
    got = simhash._collide(4)(table).to_pydict()
    found = dict(zip(got["a"], got["b"], strict=True))
    assert {i: found.get(i, i) for i in range(len(fps))} == brute_components(dict(enumerate(fps)))
