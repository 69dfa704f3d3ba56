"""Search strings against names: every pair of words, every name."""

import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import matching


def plain_distance(a, b):
    d = [[max(i, j) if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def slip(rng, word):
    i = rng.randrange(len(word))
    return rng.choice([word[:i] + word[i + 1:], word[:i] + rng.choice("abcxyz") + word[i:], word[:i] + rng.choice("abcxyz") + word[i + 1:],
                       word[:i] + word[i + 1:i + 2] + word[i:i + 1] + word[i + 2:]])


def test_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 8))) for _ in range(2))
        for limit in (1, 2):
            assert matching.swaps_and_edits(a, b, limit) == min(plain_distance(a, b), limit + 1)


def test_words_within_two_edits_all_meet(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcdeno") for _ in range(rng.randint(2, 12))) for _ in range(150)]
    asked = [slip(rng, slip(rng, w)) for w in names for _ in range(3)] + names
    asked = sorted({w for w in asked if w})
    got = matching.token_pairs(spark.createDataFrame([(w,) for w in asked], "t string"), spark.createDataFrame([(w,) for w in names], "nt string")).collect()
    allowed = lambda w: 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0
    want = {(t, n, plain_distance(t, n)) for t in asked for n in set(names) if t == n or (len(n) >= 4 and plain_distance(t, n) <= allowed(t))}
    assert {tuple(r) for r in got} == want and len(got) == len(want) and any(e == 2 for _, _, e in want)


def test_best_name_against_all_names(spark):
    rng = random.Random(3)
    pool = ["street", "avenue", "college", "library", "station", "north", "hall", "hospital", "gym", "10", "union"]
    names = [(i, " ".join(rng.sample(pool, rng.randint(1, 4)))) for i in range(120)]
    asked = [(i, " ".join(slip(rng, w) if rng.random() < 0.3 and len(w) > 3 else w for w in rng.sample(pool, rng.randint(1, 4)))) for i in range(150)]
    got = {r.query_id: (r.name_id, r.score) for r in matching.resolve_queries(spark.createDataFrame(asked, "query_id long, q string"), spark.createDataFrame(names, "name_id long, name string")).collect()}
    allowed = lambda w: 2 if len(w) >= 8 else 1 if len(w) >= 4 else 0
    for i, q in asked:
        best = (None, None)
        t = list(dict.fromkeys(q.split()))
        for k, name in names:
            w = list(dict.fromkeys(name.split()))
            e = [min((plain_distance(x, y) for y in w if x == y or (len(x) > 3 and len(y) > 3 and plain_distance(x, y) <= allowed(x))), default=None) for x in t]
            hits = [x for x in e if x is not None]
            if hits:
                score = round(len(hits) / len(t) - 0.1 * sum(hits) - 0.01 * (len(w) - min(len(hits), len(w))), 6)
                if best[1] is None or score > best[1] + 1e-9:
                    best = (k, score)
        assert got[i][0] == best[0] and got[i][1] == (None if best[1] is None else pytest.approx(best[1], abs=1e-6))


def test_comparable_names(spark):
    rows = [("Café  Münster's", "cafe munsters"), ("u\u200bnion", "union"), ("333cedar", "333 cedar"), ("elm272", "elm 272"), ("4th M2", "4th m2"), (None, None), ("", "")]
    d = spark.createDataFrame(rows, "name string, want string").select("want", matching.comparable("name").alias("got"))
    assert all(r.want == r.got for r in d.collect())
    none = spark.createDataFrame([], "query_id long, q string")
    assert matching.resolve_queries(none, none.select(F.col("query_id").alias("name_id"), F.col("q").alias("name"))).count() == 0
