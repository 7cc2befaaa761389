"""Main text of web pages by a site style tree.

The pages of one host are merged into one tree of element paths (tag, class and
id, digits levelled). For each path the tree holds on how many pages it occurs,
how those pages lay out what is below it (its presentation styles), and on how
many pages each text stands directly in it (its content features). From these:

* presentation importance: the entropy of the styles over the pages, to the base
  of the number of pages; a layout that never varies has none;
* content importance: one minus the mean entropy of the path's texts over the
  pages; a text that every page repeats has none, one of a single page has 1.

Then each page is parsed again. A branch's importance mixes its own presentation
importance with that of its children and texts; markup that names its purpose
sets it: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments have 0. Branches below the threshold are removed. Where
a page marks its article, the article is what is kept, and its mark counts as much
as MARK pages on which each block in it has importance 1, each outside 0: blocks
that many pages of a host repeat in their articles go, unless nothing would stay.
An article with less than half the text that the tree keeps outside it is no
article: the tree alone decides there.

The statistics cover all pages and are summed before they are shuffled, so a
host with a third of all pages is no heavy task. Pages without a host, and paths
on one page only, count as important unless markup says otherwise. A null html
is an empty one. Repeated rows are extracted each. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.llm._common import claim, sent, stored

_NAME = r"[a-zA-Z][^\s/>]*+"
_MARK = re.compile(
    rf"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)({_NAME})((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)({_NAME})([^>]*+)(?:>|\Z)|</[^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_DIGITS = re.compile(r"\d+")
_TOKEN = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html caption dd dt li option tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
FENCE = frozenset("ul ol dl table td th select article section div body html menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NOISE_TAGS = frozenset("head nav footer aside form script style noscript template button select option textarea input iframe svg canvas object menu dialog title noembed noframes xmp search map audio video".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar aside widget notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login comment comments disqus "
    "respond share sharing social related recommended pagination pager toolbar alert masthead".split()
)
#: Words that say where a thing stands or how it is wrapped, and nothing of its purpose.
PLACE_WORDS = frozenset(
    "area bar block body bottom box button center col column container content fixed float global header holder inner item items layout left link links list lower main "
    "module outer page panel primary region right row secondary section site small sticky sub top unit upper wide wrap wrapper zone".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Pages that a marked article counts as.
MARK = 2
HEADERS = frozenset("header site-header page-header main-header top-header global-header topbar top-bar".split())


def names_noise(names: str) -> bool:
    """Whether a class or id names a purpose that is no text: all of its parts do, or say
    a place only. ``ad-box`` does; ``ad-hoc``, ``related-work`` and ``notice-board`` don't."""
    for name in names.split():
        parts = _TOKEN.findall(name)
        if any(p in NOISE_WORDS for p in parts) and all(p in NOISE_WORDS or p in PLACE_WORDS for p in parts):
            return True
    return False


class Page:
    """A page as arrays of nodes in document order, and its stream of texts."""

    __slots__ = ("noise", "parent", "path", "signs", "stream", "tags")

    def __init__(self, html: str) -> None:
        self.parent, self.tags, self.path, self.noise = [-1], [""], [0], [False]
        self.signs: list[list[int]] = [[]]  # what stands below a node, repeats in a row once
        self.stream: list[tuple[int, str | None]] = []  # (node, text), or (node, None) at the edge of a block
        stack, at, end = [0], 0, len(html)
        find, stream = _MARK.search, self.stream
        while at < end:
            m = find(html, at)
            if m is None:
                stream.append((stack[-1], html[at:]))
                break
            if m.start() > at:
                stream.append((stack[-1], html[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, rest = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                self._close(stack, tag)
                continue
            self._open(stack, tag, rest)
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = stop.end() if stop else end
                self._close(stack, tag)

    def _open(self, stack: list[int], tag: str, rest: str) -> None:
        tags = self.tags
        closes = CLOSED_BY.get(tag)
        if closes or tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                t = tags[stack[k]]
                if (closes and t in closes) or (t == "p" and tag in CLOSES_P):
                    self._edge(stack[k])
                    del stack[k:]
                    if not closes:
                        break
                elif t in FENCE and not (closes and t in ("td", "th")):
                    break
        top = stack[-1]
        sign, noise = tag, tag in NOISE_TAGS
        if rest and ("=" in rest):
            marks = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(rest)}
            if marks:
                names = " ".join(marks.get(k, "") for k in ("class", "id"))
                sign = _DIGITS.sub("0", f"{tag} {names}")
                if tag not in HEADINGS and tag not in ("html", "body", "article", "main"):
                    noise = noise or marks.get("role") in NOISE_ROLES or names_noise(names) or not HEADERS.isdisjoint(names.split())
                elif tag == "article" and not {"comment", "comments"}.isdisjoint(_TOKEN.findall(names)) and names_noise(names):
                    noise = True
                if marks.get("role") == "main":
                    tag = "main"
        if tag == "header":
            noise = noise or not any(tags[k] == "article" for k in stack)
        path = xxhash.xxh64_intdigest(sign, self.path[top] & 0x7FFFFFFFFFFFFFFF)
        here = self.signs[top]
        if not here or here[-1] != path:
            here.append(path)
        if tag in VOID:
            stream = self.stream
            if tag == "br":
                stream.append((top, " "))
            elif tag == "hr":
                stream.append((top, None))
            return
        self.parent.append(top)
        tags.append(tag)
        self.path.append(path)
        self.noise.append(noise or self.noise[top] or (tags[top] == "header" and tag not in HEADINGS))
        self.signs.append([])
        stack.append(len(tags) - 1)
        self._edge(stack[-1])

    def _edge(self, node: int) -> None:
        if self.tags[node] in BLOCK or self.tags[node] == "main":
            self.stream.append((node, None))

    def _close(self, stack: list[int], tag: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            t = self.tags[stack[k]]
            if t == tag or (t == "main" and tag == "div"):
                for node in stack[k:]:
                    self._edge(node)
                del stack[k:]
                return
            if t in ("article", "body") and tag not in ("html", "body", "article", "main"):
                return  # a stray end tag does not leave the article

    def texts(self) -> dict[int, str]:
        """Text that stands directly in each node."""
        out: dict[int, list[str]] = {}
        for node, t in self.stream:
            if t and not t.isspace():
                out.setdefault(node, []).append(t)
        return {k: " ".join(" ".join(v).split()) for k, v in out.items()}


def page_features(html: str | None) -> list[tuple[int, int, int, int]]:
    """(path, kind, feature, times) of one page; kind 0: a layout, 1: a text."""
    page, count = Page(html or ""), {}
    for node in range(1, len(page.tags)):
        if not page.noise[node]:
            key = page.path[node], 0, xxhash.xxh64_intdigest(str(page.signs[node]))
            count[key] = count.get(key, 0) + 1
    for node, text in page.texts().items():
        if not page.noise[node]:
            key = page.path[node], 1, xxhash.xxh64_intdigest(text)
            count[key] = count.get(key, 0) + 1
    return [(*k, n) for k, n in count.items()]


def _judged(page: Page, texts: dict[int, str], marked: list[bool], tree: dict[int, tuple[float, float, int]], threshold: float, gamma: float) -> tuple[list[bool], list[bool], float]:
    """Which nodes go, which are in a marked node, and how much text outside of these the tree keeps."""
    size, one = len(page.tags), (1.0, 1.0, 0)
    inside, above = marked[:], marked[:]
    for node in range(1, size):
        inside[node] = inside[node] or inside[page.parent[node]]
    for node in range(size - 1, 0, -1):
        above[page.parent[node]] = above[page.parent[node]] or above[node]
    total, parts = [0.0] * size, [0] * size
    for node in texts:
        total[node] += tree.get(page.path[node], one)[1]
        parts[node] += 1
    low, known = [False] * size, [False] * size
    for node in range(size - 1, 0, -1):
        own, _, pages = tree.get(page.path[node], one)
        below = gamma ** max(1, len(page.signs[node]))
        value = 0.0 if page.noise[node] else (1 - below) * own + below * (total[node] / parts[node] if parts[node] else own)
        known[node] = value * pages >= threshold * (MARK + pages)
        if inside[node] and not page.noise[node]:
            value = (MARK + value * pages) / (MARK + pages)
        # in an article, words within a block stay or go with it
        low[node] = value < threshold and not above[node] and (not inside[node] or page.tags[node] in BLOCK)
        if not page.noise[node]:
            total[page.parent[node]] += value
            parts[page.parent[node]] += 1
    gone, noise = page.noise[:], page.noise
    for node in range(1, size):
        gone[node] = gone[node] or gone[page.parent[node]] or low[node]
    if any(marked) and not any(inside[node] and not gone[node] for node in texts):
        for node in range(1, size):  # all of the article repeats: nothing tells its text
            gone[node] = noise[node] or gone[page.parent[node]] or (low[node] and not inside[node])
    return gone, inside, sum(len(t) for node, t in texts.items() if known[node] and not gone[node] and not inside[node])


def main_text(html: str | None, tree: dict[int, tuple[float, float, int]], threshold: float, gamma: float = 0.9) -> str:
    """tree: path -> (presentation importance, content importance, pages) of the page's host."""
    page = Page(html or "")
    marked = [t == "article" and not n for t, n in zip(page.tags, page.noise, strict=True)]
    if not any(marked):
        marked = [t == "main" and not n for t, n in zip(page.tags, page.noise, strict=True)]
    has_article, texts = any(marked), page.texts()
    gone, inside, outside = _judged(page, texts, marked, tree, threshold, gamma)
    if has_article and 2 * sum(len(t) for node, t in texts.items() if inside[node] and not gone[node]) < outside:
        has_article = False
        gone, inside, _ = _judged(page, texts, [False] * len(marked), tree, threshold, gamma)
    blocks: list[str] = []
    now: list[str] = []
    for node, t in [*page.stream, (0, None)]:
        if t is None:
            if now:
                text = " ".join(unescape("".join(now)).split())
                if text:
                    blocks.append(text)
                now = []
        elif not gone[node] and (inside[node] or not has_article):
            now.append(t)
    return "\n\n".join(blocks)


def _host():
    """Host of the url as a number; null where there is none."""
    name = F.lower(F.regexp_extract(F.col("url"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(name) > 0, F.xxhash64(name))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, node_importance, content_importance, pages of paths on two pages or more."""
    schema = "host long, path long, kind int, feature long, n long, nlogn double, pages long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        claim("html")
        for pdf in batches:
            rows: dict[tuple, list] = {}
            for host, html in zip(pdf["host"].tolist(), pdf["html"], strict=True):
                layouts: dict[int, list] = {}
                for path, kind, feature, n in page_features(html):
                    if kind == 0:
                        layouts.setdefault(path, []).append((n, feature))
                        continue
                    r = rows.setdefault((host, path, 1, feature), [0, 0.0, 0])
                    r[0], r[1], r[2] = r[0] + n, r[1] + n * math.log(n), r[2] + 1
                for path, found in layouts.items():  # a page's commonest layout of the path
                    r = rows.setdefault((host, path, 0, max(found)[1]), [0, 0.0, 0])
                    r[0], r[2] = r[0] + 1, r[2] + 1
            signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
            yield pd.DataFrame([(h, signed(p), k, signed(f), *r) for (h, p, k, f), r in rows.items()], columns=["host", "path", "kind", "feature", "n", "nlogn", "pages"])

    rows = pages.select(_host().alias("host"), "html").where("host is not null").mapInPandas(run, schema)
    by_feature = rows.groupBy("host", "path", "kind", "feature").agg(*[F.sum(c).alias(c) for c in ("n", "nlogn", "pages")])
    layout = F.when(F.col("kind") == 0, F.col("pages"))
    text = F.when(F.col("kind") == 1, F.log("n") - F.col("nlogn") / F.col("n"))
    by_path = by_feature.groupBy("host", "path").agg(
        F.sum(layout).alias("m"), F.sum(layout * F.log(layout)).alias("plogp"), F.sum(text).alias("h"), F.count(text).alias("texts")
    )
    base = F.log(F.col("m").cast("double"))
    return by_path.where("m >= 2").select(
        "host",
        "path",
        F.greatest(F.lit(0.0), (base - F.col("plogp") / F.col("m")) / base).alias("node_importance"),
        F.when(F.col("texts") > 0, F.greatest(F.lit(0.0), 1 - F.col("h") / base / F.col("texts"))).otherwise(1.0).alias("content_importance"),
        F.col("m").alias("pages"),
    )


def main_texts(pages: DataFrame, threshold: float = 0.25, most_broadcast: int = 200_000) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A tree of at most most_broadcast paths is sent to every executor; a larger
    one is joined to the pages by host.
    """
    spark = pages.sparkSession
    tree = stored(style_tree(pages), "tree")
    schema = T.StructType([pages.schema["page_id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType())])
    base = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", F.coalesce(_host(), F.lit(0)).alias("host"))
    small = tree.count() <= most_broadcast
    known: dict[int, dict[int, tuple[float, float, int]]] = {}
    if small:
        for r in tree.collect():
            known.setdefault(r["host"], {})[r["path"] & 0xFFFFFFFFFFFFFFFF] = (r["node_importance"], r["content_importance"], r["pages"])
    else:
        lists = tree.groupBy("host").agg(F.collect_list(F.struct("path", "node_importance", "content_importance", "pages")).alias("tree"))
        base = base.join(lists, "host", "left")
    shared = sent(spark, known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if small:
                trees = [shared.value.get(h, {}) for h in pdf["host"].tolist()]
            else:
                trees = [{r["path"] & 0xFFFFFFFFFFFFFFFF: (r["node_importance"], r["content_importance"], r["pages"]) for r in x} if x is not None else {} for x in pdf["tree"]]
            text = [main_text(h, t, threshold) for h, t in zip(pdf["html"], trees, strict=True)]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text})

    return base.mapInPandas(run, schema).withColumn("n_chars", F.length("text").cast("long"))
