"""HTML extraction by line-block distribution."""

from __future__ import annotations

import html
import re
from collections import Counter
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a sliding window.
WINDOW = 3
#: Letters in a window that make a surge, where the page has windows as long.
SURGE = 80
#: Share of the page's text that its articles must hold for lines outside them to weigh less, and what those then weigh.
ARTICLE_SHARE, OUTSIDE = 1 / 3, 0.1
#: What a line weighs in a block whose class or id has an unwanted word among others.
DOUBTFUL = 0.1

# Elements of HTML by their role here.
RAW = {"script", "style", "template", "noscript", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIPPED = {"head", "nav", "aside", "footer", "form", "menu", "select", "button", "dialog", "svg", "math", "object", "canvas", "audio", "video", "datalist", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "nobr"}
SECTIONS = {"article", "main", "section", "div", "nav", "aside", "header", "footer", "form", "table", "ul", "ol", "dl"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "table", "ul"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NEUTRAL_WORDS = {"area", "article", "bar", "block", "blog", "body", "bottom", "box", "center", "col", "container", "content", "entry", "global", "inner", "item", "left", "list", "main", "outer", "page", "panel", "post", "primary", "reader", "right", "row", "secondary", "section", "site", "thread", "top", "user", "wrap", "wrapper"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
UNWANTED_WORDS = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "adbox", "adslot", "sponsor", "sponsored", "promo", "promotion", "banner", "banners", "cookie", "cookies", "consent", "gdpr", "notice", "notices",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "paywall", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "pagination", "pager",
    "sidebar", "side", "aside", "rail", "footer", "foot", "masthead", "topbar", "toolbar", "comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "share", "sharing", "social",
    "related", "recommended", "recommendations", "widget", "widgets", "skip", "copyright", "legal", "disclaimer", "hidden", "search", "header", "tags", "toc",
}
UNWANTED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}

_TAG = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-zA-Z][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z))?+)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"[\s\x00]+")


class Line(NamedTuple):
    """A block's text; an empty one is the edge of a section."""

    text: str
    weight: float = 0.0  # characters outside links, less in doubtful blocks, 0 in unwanted ones
    article: bool = False
    heading: bool = False
    unwanted: bool = False


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw)} if raw else {}


def _weight(name: str, attributes: dict[str, str], in_article: bool) -> float:
    """What the text of an element weighs by its role: 0 is unwanted, DOUBTFUL has an unwanted word in its name, 1 is text."""
    if name in SKIPPED or name == "header" and not in_article:
        return 0.0
    if not attributes or name in ("html", "body", "main"):
        return 1.0
    if attributes.get("role", "").lower() in UNWANTED_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return 0.0
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
        return 0.0
    unwanted = UNWANTED_WORDS
    names = [{w.lower() for w in _NAME_PART.findall(x)} for k in ("class", "id") for x in attributes.get(k, "").split()]
    if name in HEADINGS or name == "header" or name == "article" and not any(x & {"comment", "comments", "reply", "ad", "advert", "sponsored", "promo"} for x in names):
        unwanted = {"ad", "ads", "advert", "comment", "comments", "cookie", "hidden"}
    found = [x for x in names if x & unwanted]
    if any(x <= unwanted | NEUTRAL_WORDS for x in found):
        return 0.0
    return DOUBTFUL if found else 1.0


class _Page:
    """The open elements of a page while it is read, and its lines so far."""

    def __init__(self) -> None:
        self.lines: list[Line] = []
        self.stack: list[tuple[str, float, bool]] = []  # name, weight, article
        self.open: Counter[str] = Counter()
        self.blocks: list[int] = []  # places in the stack that are not inline
        self.weights = [1.0]  # the least weight down to each place in the stack
        self.parts: list[str] = []
        self.linked = self.articles = self.headings = 0

    def end_block(self, edge: bool = False, unwanted: bool = False) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            weight = self.weights[-1]
            linked = 0 if self.headings and self.articles else self.linked
            self.lines.append(Line(text, weight * max(0, len(text) - linked), self.articles > 0, self.headings > 0, not weight))
        if edge:
            self.lines.append(Line("", article=self.articles > 0, unwanted=unwanted or not self.weights[-1]))
        self.parts.clear()
        self.linked = 0

    def add(self, raw: str) -> None:
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.open["a"]:
                self.linked += len(text.strip())

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            name, weight, article = self.stack[-1]
            if name not in INLINE:
                self.end_block(name in SECTIONS)
                self.blocks.pop()
            elif weight < self.weights[-2]:
                self.end_block()
            self.stack.pop()
            self.weights.pop()
            self.open[name] -= 1
            self.headings -= name in HEADINGS
            if article:
                self.articles -= 1
                self.lines += [Line("")] * WINDOW

    def close(self, name: str) -> None:
        if self.open[name]:
            self.pop_to(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name))
        elif name == "p":
            self.end_block()

    def enter(self, name: str, raw: str) -> None:
        """A start tag that is no raw text."""
        if name in CLOSES_P and self.blocks and self.stack[self.blocks[-1]][0] == "p":
            self.pop_to(self.blocks[-1])
        if name in CLOSED_BY and any(self.open[x] for x in CLOSED_BY[name]):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in ("ul", "ol", "dl", "table", "select", "article", "div"):
                    break
                if self.stack[i][0] in CLOSED_BY[name]:
                    self.pop_to(i)
                    break
        if name == "br" or name in VOID and name not in INLINE:
            self.end_block()
        if name in VOID:
            return
        attributes = _attributes(raw)
        weight = _weight(name, attributes, self.articles > 0)
        article = weight > 0 and (name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody")
        if name not in INLINE:
            self.end_block(name in SECTIONS, not weight)
            self.blocks.append(len(self.stack))
        elif weight < self.weights[-1]:
            self.end_block()
        if article:
            self.lines += [Line("")] * WINDOW
        self.stack.append((name, weight, article))
        self.weights.append(min(weight, self.weights[-1]))
        self.open[name] += 1
        self.headings += name in HEADINGS
        self.articles += article


def page_lines(source: str) -> list[Line]:
    """The blocks of a page in page order, markup stripped. Tags are told apart as browsers do: a quote opens only after an equals sign.

    An article is parted from the rest by as many edges as a window has lines.
    Work is linear in the page's length, however deep it is nested.
    """
    page, at = _Page(), 0
    while True:
        start = source.find("<", at)
        found = _TAG.match(source, start) if start >= 0 else None
        if start < 0:
            page.add(source[at:])
            break
        if not found:
            page.add(source[at : start + 1])
            at = start + 1
            continue
        page.add(source[at:start])
        at = found.end()
        if found[1]:
            page.add(found[1].replace("&", "&amp;"))
        if not found[3]:
            continue
        name = found[3].lower()
        if found[2]:
            page.close(name)
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
        else:
            page.enter(name, found[4])
    page.pop_to(0)
    page.end_block()
    return page.lines


def window_sums(lines: list[Line]) -> list[float]:
    """The weight of WINDOW lines from each line on; a run of unwanted lines counts as one line, one within an article as none."""
    kept = [i for i, x in enumerate(lines) if not (x.unwanted and (x.article or i and lines[i - 1].unwanted))]
    ahead = [0.0, *accumulate(lines[i].weight for i in kept)]
    sums, j = [0.0] * len(lines), len(kept)
    for i in range(len(lines) - 1, -1, -1):
        j -= j > 0 and kept[j - 1] == i
        sums[i] = ahead[min(len(kept), j + WINDOW)] - ahead[j]
    return sums


def main_blocks(lines: list[Line]) -> list[str]:
    """The blocks between surge and dive points of the distribution of text lengths over windows of lines.

    A line weighs its text outside links; roles and tags only lower that (see
    _weight), and so does lying outside the articles of a page whose articles
    hold ARTICLE_SHARE of its text. A region starts at a surge: a window of
    SURGE, or half the page's heaviest window if that is less; in such an
    article, any text. From there it reaches back to the edge of its section,
    and to a heading of the section before that is among the WINDOW lines
    above. It ends at the dive, where a window weighs nothing. All between is
    kept but for unwanted lines.
    """
    whole = sum(x.weight for x in lines)
    in_article = sum(x.weight for x in lines if x.article) >= ARTICLE_SHARE * whole > 0
    lines = [x._replace(article=x.article and in_article, weight=x.weight if x.article or not in_article else OUTSIDE * x.weight) for x in lines]
    sums = window_sums(lines)
    least = SURGE if in_article else min(SURGE, max(sums, default=0) / 2)
    kept: list[str] = []
    i = done = 0
    while i < len(lines):
        line = lines[i]
        if not line.weight or sums[i] < (0 if line.article else least):
            i += 1
            continue
        start = i
        while start > done and lines[start - 1].article == line.article and (lines[start - 1].unwanted or lines[start - 1].text and lines[start - 1].weight):
            start -= 1
        for back in range(1, WINDOW + 1):
            if start - back >= done and lines[start - back].heading and lines[start - back].weight:
                start -= back
                break
        while i < len(lines) and sums[i]:
            i += 1
        kept += [x.text for x in lines[start:i] if x.text and not x.unwanted]
        done = i
    return kept


def main_text(source: str | None) -> str:
    return " ".join(main_blocks(page_lines(source))) if source else ""


def _texts(batches):
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page: its main text by line-block distribution.

    Markup is stripped to one line a block; scripts, styles and other raw text
    go with it; character references are decoded; white space becomes one
    space. Menus, headers, footers, sidebars, notices, adverts, forms, hidden
    parts and comments weigh nothing, told by their tags, roles and whole class
    names. The lines between surge and dive points (see main_blocks) are joined
    by one space. n_chars counts code points. Null or empty html gives an empty
    text; html without markup is one block. Very long and deeply nested pages
    are read whole, in time linear in their length. Nulls in page_id and url
    stay. Repeated rows give a row each; other columns are ignored; an empty
    table gives none.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
