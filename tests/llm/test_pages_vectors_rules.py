import io

import numpy as np
import pytest

from fleetlens.llm import maxscore, quality_rules, warc
from fleetlens.llm.extract import Tree, extract, main_text


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "x" * 200_000, 0), (2, "http://b\n c", None, 0), (3, None, "", 0), (4, "u", "é\r\n\r\nWARC/1.1", 0), (5, "u", "same", 0), (9, "u", "same", 0), (9, "u", "same", 0), (None, "u", "same", 0),
            (None, "u", "alone", 0)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = warc.round_trip(d, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.page_id, []).append(r)
    assert by[1][0].payload_bytes == 200_000 and bytes(by[1][0].payload).decode() == "x" * 200_000 and bytes(by[4][0].payload).decode() == rows[3][2]
    assert by[2][0].record_type == "revisit" and by[2][0].refers_to == 3 and by[3][0].record_type == "response"
    assert by[5][0].record_type == "revisit" and by[5][0].refers_to == 9 and by[5][0].payload_bytes == 4 and by[5][0].payload is None
    assert [r.record_type for r in by[9]] == ["response", "response"] and sorted(r.record_type for r in by[None]) == ["response", "revisit"]
    assert warc.round_trip(d.limit(0)).count() == 0
    big = warc.write(d, str(tmp_path), min_bytes=5)
    assert big.agg({"records": "sum"}).first()[0] == len(rows)


def test_reader_is_incremental_and_strict():
    data = warc.record(7, "http://x", b"payload " * 50_000, False, None) + warc.record(8, "http://y", b"", True, 7)
    rows = [warc.parsed(h, b) for h, b in warc.records(io.BytesIO(data))]
    assert [(r[0], r[2], r[3], r[5]) for r in rows] == [(7, "response", 400_000, None), (8, "revisit", 0, 7)]
    assert rows[0][4] == warc.digest(b"payload " * 50_000)
    import zlib
    plain = zlib.decompressobj(31).decompress(data)
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    spoiled = z.compress(plain.replace(b"payload payload", b"payloaD payload", 1)) + z.flush()
    for bad in (spoiled, data[:-9], data[:200]):
        with pytest.raises(warc.CorruptRecord):
            [warc.parsed(h, b) for h, b in warc.records(io.BytesIO(bad))]


def brute_top(rows, k):
    used = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            used.setdefault(i, []).append([int(np.floor(256.0 * x)) for x in v])
    out = {}
    for q in used:
        if q % 50 == 0:
            scored = [(-max(sum(a * b for a, b in zip(min(used[q]), c)) for c in used[i]), i) for i in used if i != q]
            out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


def test_search_against_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=8), 1)]) for i in range(400)]
    rows += [(i, [0.5] * 8) for i in range(400, 700)] + [(700, None), (701, [0.1, None]), (702, [float("nan")] * 8), (750, []), (800, [1.0, 2.0]), (850, [0.0] * 8), (None, [1.0] * 8)]
    d = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    got = {}
    for r in maxscore.top_k(d, d.where("vec_id % 50 = 0"), k=5, block=4).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == brute_top(rows, 5)
    few = d.where("vec_id in (0, 1, 2)")
    assert maxscore.top_k(few.unionAll(few), few.where("vec_id = 0")).count() == 2
    assert maxscore.top_k(d.limit(0), d).count() == 0 and maxscore.top_k(d, d.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in maxscore.top_k(huge, huge.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 2**63 - 1024), (2, -(2**63 - 1024))]


PAGE = """<html><head><title>T</title><style>p{a>b}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies, really, a lot, of them, everywhere on this site.</p></div><nav><a href=/>Home</a></nav>
<div class="wrap"><div class="content"><h1>Title</h1><p>First &amp; para, with commas, and some length to it, you know.<p>Second&nbsp;one is <a href="x>y">linked</a>, and
 ok<br>next. <script>var p = "</p><p>no</p>";</script><!-- <p>no</p> --><ul><li>item one of the list</li><li>item two</ul></div>
<div class="sidebar"><p>Related stuff, with commas, a, b, c, d, e, f, and so on and on.</p></div></div>
<div id="comments"><p>Nice post, really, yes, long comment text here, wow, I say.</p></div><form><p>Your mail, please, here, now.</p></form><footer>&copy; x</footer>"""


def test_main_text():
    assert main_text(PAGE) == "Title\nFirst & para, with commas, and some length to it, you know.\nSecond one is linked, and ok next.\nitem one of the list\nitem two"
    assert main_text("") == main_text(None) == main_text("<nav><p>menu, menu, menu</p></nav>") == main_text("<!-- x") == ""
    assert main_text("plain words only, no tags") == "plain words only, no tags"
    assert main_text("<p>a < b and <3 &lt;tag&gt; &#233;</p>") == "a < b and <3 <tag> é"
    assert len(main_text("<div>" * 20_000 + "<p>deep, down here, in it all, it is.</p>")) == 34
    long = "word, " * 100_000
    assert main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_extract_odd_rows(spark):
    d = spark.createDataFrame([(1, "u", None, 1), (1, "u", None, 1), (None, None, "<p>Some text, here it is, long enough.</p>", 1)], "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in extract(d).collect())
    assert got == [("1", "", 0), ("1", "", 0), ("None", "Some text, here it is, long enough.", 35)] and extract(d.limit(0)).count() == 0


def test_rules_of_odd_rows(spark):
    good = "This is a sentence of quite some words that nobody would ever want to lose from a corpus. "
    other = "Another one tells a wholly different story about rivers and mountains in that far country."
    rows = [(1, None), (2, ""), (3, " \n\t\n"), (4, good * 3), (5, good + "\n" + other + "\nHome | News | About | Contact\nshort scrap"), (6, "a b c d e f g h " * 30),
            (7, "Home | News | About | Contact\n" * 30), (8, "\n".join(f"WORD{i} SHOUTED{i} LOUDLY{i}!!" for i in range(30))), (None, good * 2), (4, good * 3), (9, "x" * 300_000)]
    d = spark.createDataFrame([(k, t, 1, "r") for k, t in rows], "doc_id long, text string, n_words int, rules string")
    got = {r.doc_id: r.rules for r in quality_rules.judge(d.drop("rules")).collect()}
    assert [got[k].kept for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)] == [False, False, False, False, True, False, False, False, False]
    assert got[4].n_repeat_words == 54 and got[6].n_repeat_words == 240 and got[7].n_dup_lines == 29 and got[None].n_words == 36
    assert got[5].clean_text == good + "\n" + other
    kept = quality_rules.clean(d)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [5]
    assert quality_rules.clean(d.limit(0)).count() == 0


def test_text_deep_in_a_link():
    def linked(page):
        return {text for _, _, text, link in Tree(page).runs if link}

    assert linked('<a href="/x"><div><div><div><div><span>deep</span></div></div></div></div></a><p>after</p>') == {"deep"}
    # An anchor that stays open is no link, and another one ends a link that was left open.
    assert linked("<a name=top><div><div><div><div><p>text</p></div></div></div></div>") == set()
    assert linked('<a href=x><div><div><div><div><a name=y></a><p>text</p></div></div></div></div>') == set()
