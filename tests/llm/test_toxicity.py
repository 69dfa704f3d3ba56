import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import toxicity as T
from fleetlens.llm.common import held_out


def small_net(seed=3):
    rng = np.random.default_rng(seed)
    n = lambda *s: rng.normal(0, 0.6, s)
    net = T.Network({"bad": 1, "good": 2}, n(3, T.INPUT), n(T.BUCKETS, T.INPUT), n(T.INPUT, 6 * T.HIDDEN), n(6 * T.HIDDEN), n(T.HIDDEN, 3 * T.HIDDEN), n(T.HIDDEN, 3 * T.HIDDEN),
                    n(2 * T.HIDDEN), n(2 * T.HIDDEN), n(1))
    net.word_vectors[0] = 0
    net.pooling = n(5)
    return net


def plain_score(net, text):
    """One word, one gate, one window after the other."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    words = [run[i : i + 24] for t in (text or "").lower().split() for run in re.findall(r"[^\W_]+", t) for i in range(0, len(run), 24)]
    gate_inputs = {}
    for w in set(words):
        marked, x, n = f"^{w}$", np.zeros(T.INPUT), 0
        for size in T.GRAMS:
            for i in range(len(marked) - size + 1):
                h = size
                for c in marked[i : i + size]:
                    h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % (1 << 64)
                    h ^= h >> 29
                x += net.gram_vectors[h % T.BUCKETS]
                n += 1
        x = x / math.sqrt(max(1, n)) + (net.word_vectors[net.words[w]] if w in net.words else 0)
        gate_inputs[w] = x @ net.into + net.bias
    begins = [0]
    while begins[-1] + T.WINDOW < len(words):
        begins.append(begins[-1] + T.STRIDE)
    logits = []
    for b in begins:
        window = words[b : b + T.WINDOW]
        states = [[None, None] for _ in window]
        for side, weights in ((0, net.ahead), (1, net.back)):
            h = np.zeros(T.HIDDEN)
            for t in (range(len(window)) if side == 0 else range(len(window) - 1, -1, -1)):
                x, u, new = gate_inputs[window[t]][3 * side * T.HIDDEN :], h @ weights, np.zeros(T.HIDDEN)
                for k in range(T.HIDDEN):
                    z, r = sig(x[k] + u[k]), sig(x[T.HIDDEN + k] + u[T.HIDDEN + k])
                    new[k] = z * h[k] + (1 - z) * math.tanh(x[2 * T.HIDDEN + k] + r * u[2 * T.HIDDEN + k])
                h = states[t][side] = new
        if not window:
            logits.append(float(net.offset[0]))
            continue
        both = [np.concatenate(s) for s in states]
        e = [math.exp(s @ net.attention) for s in both]
        logits.append(float(sum(a * s for a, s in zip(e, both, strict=True)) / sum(e) @ net.out + net.offset[0]))
    top, mean = min(12, max(-12, max(logits))), sum(map(sig, logits)) / len(logits)
    x = [1, top / 4, mean, sig(top) * math.sqrt(mean), math.log(len(logits))]
    return sig(float(np.dot(x, net.pooling)))


def test_windows_against_plain_loops(spark):
    rng = random.Random(1)
    net = small_net()
    texts = [None, "", " ... ", "Bad", "good, BAD!! ###", "a_b c-d x" * 3, "é" * 100, *[" ".join(rng.choice(["bad", "good", "Réeux", "naïve.", "the", "x1|y2", "日本"]) for _ in range(n)) for n in (5, 63, 64, 65, 96, 97, 300)]]
    rows = [*enumerate(texts), (3, "Bad"), (None, "no key")]
    d = spark.createDataFrame([(k, t, "x", 1.0) for k, t in rows], "doc_id long, text string, predicted string, y double")
    got = T.score(d, net).collect()
    want = sorted((str(k), plain_score(net, t)) for k, t in rows)
    have = sorted((str(r.doc_id), r.score) for r in got)
    assert [k for k, _ in have] == [k for k, _ in want] and np.allclose([s for _, s in have], [s for _, s in want], atol=1e-4)
    assert all(r.predicted == (r.score >= 0.7) for r in got) and T.score(d.limit(0), net).count() == 0


def test_slopes_go_downhill():
    """Loss falls on a signal that only the order of words tells, so the recurrences must learn."""
    rng = random.Random(2)
    rows = []
    for i in range(600):
        words = [rng.choice("lorem ipsum dolor sit amet elit".split()) for _ in range(12)]
        at = rng.randrange(11)
        words[at : at + 2] = ["big", "fool"] if i % 2 else ["fool", "big"]
        rows.append((i, float(i % 2), " ".join(words)))
    net = T.fit(rows[:500], epochs=40)
    table, ids, counts = T.Reader(net).windows([w for _, _, w in rows[500:]])
    assert np.mean((net.logits(table, ids) > 0) == np.array([y > 0 for _, y, _ in rows[500:]])) > 0.9 and counts.tolist() == [1] * 100


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    net = T.learn(docs, labels.where(~held_out(F.col("doc_id"))))
    got = T.score(docs, net).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    bad, fine = [r.score for r in got if r.toxic == 1], [r.score for r in got if r.toxic == 0]
    assert np.mean([(b > f) + 0.5 * (b == f) for b in bad for f in fine]) > 0.96
    assert np.mean([b >= 0.7 for b in bad]) > 0.88 and np.mean([f >= 0.7 for f in fine]) < 0.02


def test_learning_from_odd_labels(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (3, "vile words here"), (4, "kind words"), (4, "kind words"), (None, "x")], "doc_id long, text string")
    lab = spark.createDataFrame([(1, 0), (3, 1), (4, 0), (5, None), (None, 1), (77, 0), (4, 0), (3, 0)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in T.score(d, T.learn(d, lab)).collect())
    for some in (lab.limit(0), lab.where("toxic = 0")):
        scores = {r.score for r in T.score(d, T.learn(d, some)).collect()}
        assert len(scores) == 1 and max(scores) <= 0.5
    assert {r.score for r in T.score(d, T.learn(d, lab.limit(0))).collect()} == {0.5} and T.score(d, T.learn(d.limit(0), lab)).count() == 6
