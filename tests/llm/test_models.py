import numpy as np

from fleetlens.llm import gam, langid
from fleetlens.llm.common import held_out
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.where(~held_out(F.col("doc_id"))))
    got = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert len(got) > 250 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)


def test_words_before_grams():
    m = langid.Model(["x", "y"], {"the": 1}, [{"q": 2}, {}, {"^qu": 3}, {}, {}], np.log(np.array([[1, 1], [0.9, 0.1], [0.2, 0.8], [0.6, 0.4]])))
    assert m.hits("the") == [1] and m.hits("quo") == [3] and m.hits("aqa") == [2] and m.hits("zzz") == [0]
    assert m.predict("The 1 THE!")[0] == "x" and m.predict("aqa")[0] == "y"
    assert m.predict("zzz") == ("x", 0.5)


def test_language_of_odd_rows(spark):
    rows = [(1, None, "en", 1), (2, "", "en", 1), (3, "12 _ 3!", "en", 1), (4, "the cat and the dog", "en", 1), (5, "le chat et le chien", "fr", 1), (6, "the " * 40_000, None, 1),
            (7, "жук", "en", 1), (7, "жук", "en", 1), (None, "le chien", "fr", 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.fit(d)
    got = {r.doc_id: r for r in langid.identify(d, model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, 4, 5, 6)] == ["und", "und", "und", "en", "fr", "en"] and got[1].score == 0 and got[None].lang_pred == "fr"
    nothing = langid.fit(d.limit(0))
    assert {r.lang_pred for r in langid.identify(d, nothing).collect()} == {"und"} and langid.identify(d.limit(0), model).count() == 0


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = gam.score(docs, labels.where(~held_out(F.col("doc_id")))).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean([r.predicted == r.quality for r in got]) > 0.95


def test_gam_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    m = gam.fit(x, y, rounds=120)
    assert m.pairs[0] == (0, 1) and np.mean((m.score(x) >= 0.5) == y) > 0.9
    # A score is the sum of its bins' entries.
    total = m.bias + sum(t[np.searchsorted(e, x[:5, f], side="right")] for f, (e, t) in enumerate(zip(m.edges, m.tables, strict=True)))
    for (a, b), t in zip(m.pairs, m.pair_tables, strict=True):
        total = total + t[np.searchsorted(m.pair_edges[a], x[:5, a], side="right"), np.searchsorted(m.pair_edges[b], x[:5, b], side="right")]
    assert np.allclose(m.score(x[:5]), 1 / (1 + np.exp(-total)))


def test_quality_of_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "a word. " * 30_000, 1), (4, "a word. " * 30_000, 1), (None, "x", 1), (5, "UP!! UP!! " * 9, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, log_words int")
    lab = spark.createDataFrame([(1, 0), (4, 1), (5, None), (None, 1), (77, 0), (4, 1)], "doc_id long, quality int")
    got = gam.score(d, lab).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert {r.score for r in gam.score(d, lab.limit(0)).collect()} == {0.5} and gam.score(d.limit(0), lab).count() == 0
