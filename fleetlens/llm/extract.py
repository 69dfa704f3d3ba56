"""Main text of web pages by tree scoring.

The page becomes a tree; what its tags and names mark as furniture goes; paragraphs pass points for
length and commas to the elements around them; the element with most points, less its share of link
text, is the article, and siblings that look like it stay."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import small_batches

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?:script|style)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?:script|style)\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[/a-zA-Z][^>]*>|<[!?][^>]*(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_SPACE, _NAME = re.compile(r"\s+"), re.compile(r"[a-z]+|\d+")
#: Fixed lists of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input label map menu nav noscript object option "
                    "script select style svg template textarea title video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends open elements of these names, up to the nearest container that holds them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class or id that mark furniture, and roles that do.
FURNITURE = frozenset("ad ads advert adverts advertisement adsense adslot banner breadcrumb breadcrumbs byline captcha comment comments consent cookie cookies "
                      "disqus disclaimer footer gdpr hidden masthead menu menubar modal nav navbar navigation navlinks newsletter notice notices notification overlay pager "
                      "pagination paywall popup promo promoted promotion reactions recommended related replies reply respond share sharing sidebar sidebars signup "
                      "skip social sponsor sponsored subscribe subscription tagcloud toc toolbar topbar widget widgets".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search searchbox toolbar".split())
SAFE = frozenset("html body main article".split())
_COMMAS = re.compile("[,،、，;]")
SHORT = 25


class Tree:
    """Elements in page order, each with its parent's place, and runs of text with their block."""

    def __init__(self, page: str):
        self.tag, self.parent, self.gone, self.names = ["#"], [-1], [False], [frozenset()]
        self.runs: list[tuple[int, int, str, bool]] = []  # element, block, text, in a link
        self._stack, self._block = [0], 0
        self._link = 0  # the open a with a href, until it closes or another a opens
        at = 0
        for m in _MARKUP.finditer(page):
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            if m[2]:
                (self._close if m[1] else self._open)(m[2].lower(), m[3])
        self._text(page[at:])

    def _text(self, raw: str) -> None:
        if raw:
            here = self._stack[-1]
            self.runs.append((here, self._block, html.unescape(raw) if "&" in raw else raw, self._link > 0 or any(self.tag[i] == "a" for i in self._stack[-4:])))

    def _pop_to(self, depth: int) -> None:
        if any(self.tag[i] in BLOCKS for i in self._stack[depth:]):
            self._block += 1
        if self._link and self._link in self._stack[depth:]:
            self._link = 0
        del self._stack[depth:]

    def _end(self, names: set[str], within: set[str]) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            t = self.tag[self._stack[depth]]
            if t in names:
                self._pop_to(depth)
                return
            if t in within:
                return

    def _open(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            if tag not in ("html", "body", "head"):
                self._end({"p"}, {"table", "td", "th", "li", "blockquote", "button", "article", "section", "div"})
            self._block += 1
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag == "br":
            self.runs.append((self._stack[-1], self._block, " ", False))
        if tag in VOID:
            return
        up = self._stack[-1]
        names: frozenset[str] = frozenset()
        gone = tag in DROPPED
        link = False
        if "=" in attributes or "hidden" in attributes:
            a = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
            link = "href" in a
            names = frozenset(_NAME.findall(f"{a.get('class', '')} {a.get('id', '')}"))
            gone = gone or (tag not in SAFE and bool(names & FURNITURE)) or a.get("role") in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or (
                "display:none" in a.get("style", "").replace(" ", ""))
            if tag == "article" and names & {"comment", "comments", "reply", "related", "teaser", "promo", "ad"}:
                gone = True
        if tag == "header" or (names & {"header"} and tag not in SAFE):
            gone = gone or not any(self.tag[i] in ("article", "main") for i in self._stack)
        self.tag.append(tag)
        self.parent.append(up)
        self.gone.append(gone or self.gone[up])
        self.names.append(names)
        if not attributes.endswith("/") or tag in BLOCKS or tag == "a":
            self._stack.append(len(self.tag) - 1)
            if tag == "a":
                self._link = len(self.tag) - 1 if link else 0

    def _close(self, tag: str, _: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            if self.tag[self._stack[depth]] == tag:
                self._pop_to(depth)
                return
        if tag in BLOCKS:
            self._block += 1


def main_text(page: str | None) -> str:
    """The article's blocks, one per line; empty if the page has none."""
    tree = Tree(page or "")
    n = len(tree.tag)
    blocks: dict[int, list] = {}  # block -> [element, texts, link characters]
    for el, block, text, link in tree.runs:
        if not tree.gone[el]:
            b = blocks.setdefault(block, [el, [], 0])
            b[1].append(text)
            if link:
                b[2] += len(text)
    found = []
    for b in sorted(blocks):
        el, texts, linked = blocks[b]
        if text := _SPACE.sub(" ", "".join(texts)).strip():
            while tree.tag[el] not in BLOCKS and el:
                el = tree.parent[el]
            found.append((el, text, min(linked, len(text))))
    if not found:
        return ""
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for el, text, linked in found:
        chars[el] += len(text)
        links[el] += linked
        if tree.tag[el] in HEADINGS:
            continue
        worth = (1 + len(_COMMAS.findall(text)) + min(len(text) / 100, 3)) if len(text) >= SHORT else 0.2
        worth *= 1 - linked / len(text)
        up, share = (tree.parent[el] if tree.tag[el] in ("p", "pre", "blockquote", "li", "td", "dd", "dt", "figcaption") else el), 1.0
        for level in range(3):
            if up < 0:
                break
            points[up] += worth * share
            share = 0.5 if level == 0 else share / 3
            up = tree.parent[up]
    for el in range(n - 1, 0, -1):
        chars[tree.parent[el]] += chars[el]
        links[tree.parent[el]] += links[el]
    final = [p * (1 - k / c) if c else 0.0 for p, k, c in zip(points, links, chars, strict=True)]
    top = max(range(n), key=lambda el: (final[el], -el))
    around = top
    while around > 0:
        if tree.tag[around] == "article":
            top = around
            break
        around = tree.parent[around]
    keep = [False] * n
    keep[top] = True
    limit = max(2.0, 0.2 * final[top])
    for el in range(1, n):
        if tree.parent[el] == tree.parent[top] and el != top and chars[el] and not tree.gone[el]:
            density = links[el] / chars[el]
            alike = final[el] + (0.2 * final[top] if tree.names[top] and tree.names[el] == tree.names[top] else 0.0) >= limit
            plain = tree.tag[el] in ("p", "blockquote", "pre", "h1", "h2", "h3") and density < 0.25
            keep[el] = (alike and density < 0.5) or plain
        elif tree.parent[el] > 0 and keep[tree.parent[el]]:
            keep[el] = True
    for el in range(1, n):
        keep[el] = keep[el] or keep[tree.parent[el]]
    return "\n".join(text for el, text, _ in found if keep[el])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(key, url, text, n_chars) of every row, from its whole html. Null and empty html, and pages without
    text outside their furniture, give an empty text. Unclosed and stray tags are taken as browsers do in
    the plain cases; a br is white space. Rows are independent of each other; repeated rows are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                             names=["key", "url", "text", "n_chars"])

    d = small_batches(pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html")))
    return d.mapInArrow(run, "key long, url string, text string, n_chars long").withColumnRenamed("key", key)
