"""Quality rules, line first: each line is judged alone, failing lines go, and a document that loses
too much of its text goes with them. DataFrame functions only; one pass, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import let, spaced, words_of

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Fixed patterns, valid in Java's and RE2's dialects alike.
ENDING = r"[.!?:;…。！？\"'”’»)\]]$"
BOILERPLATE = (r"(?i)cookie|javascript|lorem ipsum|privacy policy|terms of (use|service)|all rights reserved|©|copyright"
               r"|click here|sign up|log in|subscribe|read more|share this|licen[sc]ed under|released under the .{0,40}licen[sc]e"
               r"|general public licen[sc]e|spdx-licen[sc]e")
MARK_RUNS = r"[!?]{2,}"
#: A boilerplate sentence is short; a paragraph that mentions one of the words is not boilerplate.
BOILERPLATE_CHARS = 200
#: A line without a closing mark passes as running text from this many words on.
OPEN_LINE_WORDS = 8
#: A menu line holds at least this many separators, one for at most four words.
MENU_SEPARATORS = 3
#: Shares of a line's words.
SYMBOL_SHARE, MARK_SHARE = 0.2, 0.2
#: A document that loses more than this share of its words' characters is rejected.
LOST_SHARE = 0.5
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8


def _symbols(text: Column) -> Column:
    return sum((F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words inside windows of eight words that occur twice or more; a window is told by its 64-bit hash."""
    def covered(h: Column) -> Column:
        def positions(s: Column) -> Column:
            same = lambda e, i: F.coalesce(e["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(e["h"] == F.get(s, i + 1)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        width = lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(by_hash, lambda s: let(positions(s), lambda p: F.aggregate(width(p), F.lit(0), lambda a, x: a + x))))

    hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(hashes, covered))


def line_fails(line: Column) -> Column:
    """The verdict on one line that has a word: mark-less scraps, menus, shouting, symbol noise, boilerplate."""
    def rules(x: Column) -> Column:
        t, n = x["t"], x["n"]
        separators = F.length(t) - F.length(F.translate(t, "|»›·", ""))
        return ((~t.rlike(ENDING) & (n < OPEN_LINE_WORDS))
                | ((separators >= MENU_SEPARATORS) & (separators * 4 >= n))
                | (_symbols(t) > SYMBOL_SHARE * n)
                | (~t.rlike(r"\p{Ll}") & t.rlike(r"\p{Lu}") & (n >= 3))
                | (t.contains("!!") & (F.regexp_count(t, F.lit(MARK_RUNS)) > MARK_SHARE * n))
                | ((F.length(t) <= BOILERPLATE_CHARS) & t.rlike(BOILERPLATE)))
    trimmed = F.btrim(line, F.lit(" \t\x0b\x0c\r"))
    return let(F.struct(trimmed.alias("t"), F.size(words_of(line)).alias("n")), rules)


def judge(docs: DataFrame, text: str = "text", lost_share: float = LOST_SHARE) -> DataFrame:
    """``docs`` with one struct column ``rules``: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, lines (array of line and failed), lost_chars, kept, clean_text.

    A null or empty text has no word, fails the base and is not kept. Lines are split at \\n; a line
    without a word neither fails nor counts. clean_text joins the lines that did not fail. Repeated
    rows get equal verdicts; other columns pass through untouched (an own column ``rules`` is replaced)."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.lit(" \t\x0b\x0c\r")
    lines = F.transform(F.split(t, "\n"), lambda x: F.struct(x.alias("line"), (F.btrim(x, blank) != "").alias("worded")))
    judged = F.transform(lines, lambda x: F.struct(x["line"].alias("line"), x["worded"].alias("worded"), (x["worded"] & line_fails(x["line"])).alias("failed")))
    char_count = lambda s: F.length(F.replace(s, F.lit(" "), F.lit("")))

    def stats(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    def verdict(ls: Column) -> Column:
        worded = F.transform(F.filter(ls, lambda x: x["worded"]), lambda x: x["line"])
        lost = F.aggregate(F.filter(ls, lambda x: x["failed"]), F.lit(0), lambda a, x: a + char_count(spaced(x["line"])))
        return F.struct(ls.alias("lines"), (F.size(worded) - F.size(F.array_distinct(worded))).cast("long").alias("n_dup_lines"),
                        lost.cast("long").alias("lost_chars"),
                        F.array_join(F.transform(F.filter(ls, lambda x: ~x["failed"]), lambda x: x["line"]), "\n").alias("clean_text"))

    def whole(s: Column, v: Column) -> Column:
        chars = char_count(spaced(t)).cast("long")
        failed = (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])
        return F.struct(s["n_words"].alias("n_words"), chars.alias("word_chars"), _symbols(t).cast("long").alias("n_symbols"), v["n_dup_lines"].alias("n_dup_lines"),
                        s["n_repeat_words"].alias("n_repeat_words"), failed.alias("base_failed"), v["lines"].alias("lines"), v["lost_chars"].alias("lost_chars"),
                        (~failed & (v["lost_chars"] <= lost_share * chars)).alias("kept"), v["clean_text"].alias("clean_text"))

    return docs.withColumn("rules", let(let(words_of(t), stats), lambda s: let(let(judged, verdict), lambda v: whole(s, v))))


def clean(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that pass, without their failing lines; ``n_chars`` follows where the column exists."""
    keep = docs.columns
    out = judge(docs, text).where("rules.kept")
    out = out.withColumn(text, F.col("rules.clean_text"))
    if n_chars in keep:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*keep)
