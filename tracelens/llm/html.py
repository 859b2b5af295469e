"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one a block element.  A line's length counts only
if it can be content: lines inside menus, headers, footers, sidebars, notices,
adverts, forms and comment threads are left out, and linked text counts nothing.
The lengths are summed over sliding windows of ``WINDOW`` lines.  Where the sums
surge above ``THRESHOLD`` characters content begins, where they dive back to
nothing it ends, and the lines between those points are the text, from the first to
the last that counts; all such regions are kept.

A page may mark its article itself (``article``, ``main``).  That is a prior: if the
marked lines hold most of the text, only they count, linked text of theirs counts too,
and each has ``THRESHOLD`` characters more, so that short paragraphs surge as well.
Otherwise (say, a teaser card in an ``article``) the mark means nothing.

Names of classes are compared as a whole; of compounds, those count that end or begin
with a word that says nothing but noise (``cookie-banner``), unless they speak of
something else (``has-sidebar``, ``article-header``, ``ad-hoc``).  An element around an
article is no noise by its class, and a page that is noise all over is read without classes.

Defined results: null and empty pages give an empty text; a page without any window
above the threshold keeps all lines that count; unclosed elements end where HTML ends
them or with the page; repeated pages give the same text; a page of any length is read
whole, in one pass; extraction is a column function, so no column of the table clashes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import table

WINDOW = 3
THRESHOLD = 80

# Element names of HTML by their role here.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
SKIP = {"head", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "dialog", "svg", "math", "canvas", "object", "audio", "video", "fieldset", "datalist", "map"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure",
    "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
#: Elements that the next start tag of their own kind, or of a kind listed here, closes.
CLOSED_BY = {"li": {"li"}, "p": BLOCK, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}}
NOISE_WORDS = {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr",
    "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "sidebar", "menu", "nav", "navbar", "navigation", "breadcrumb",
    "breadcrumbs", "pagination", "pager", "comment", "comments", "commentlist", "disqus", "replies", "respond", "related", "recommended", "recirc", "footer", "header", "masthead", "widget", "widgets", "toolbar", "copyright",
}
#: Of these the compounds are as often something else.
WHOLE_ONLY = {"ad", "ads", "header", "footer", "menu", "banner", "notice", "share", "social", "respond", "widget", "overlay", "related"}
#: The other half of a compound with one of those that makes it noise all the same.
PLACES = {"site", "page", "global", "main", "top", "bottom", "left", "right", "container", "wrapper", "box", "slot", "unit", "bar", "links", "buttons", "list", "icons", "posts", "articles", "media", "nav", "mobile", "area", "space", "cookie", "sticky"}
#: First words of compounds that tell of a layout and are no noise.
ABOUT = {"has", "no", "with", "without", "is", "not", "non"}
#: Inside an article these are parts of it.
PARTS = {"header", "masthead", "banner", "notice", "copyright"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "menu", "menubar", "toolbar", "alert"}

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORD = re.compile(r"[a-z]+")
_CASE = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_END = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


def _noise_class(token: str, in_article: bool) -> bool:
    """Whether a class or id names something set apart."""
    parts = _WORD.findall(_CASE.sub("-", token).lower())
    if not parts or parts[0] in ABOUT:
        return False
    if len(parts) == 1:
        return parts[0] in NOISE_WORDS and not (in_article and parts[0] in PARTS)
    for i in (0, -1):
        if parts[i] in NOISE_WORDS - WHOLE_ONLY or parts[i] in WHOLE_ONLY and all(p in PLACES or p in NOISE_WORDS for p in parts):
            return not (in_article and parts[i] in PARTS)
    return False


def _noisy(name: str, attrs: str, in_article: bool, classes: bool) -> tuple[bool, bool]:
    """Whether an element is set apart from the article, and whether only a class or id says so."""
    if name in SKIP:
        return True, False
    if not attrs or name in ("html", "body", "article", "main"):
        return False, False
    by_class = False
    for key, a, b, c in _ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in NOISE_ROLES or key == "aria-hidden" and value.lower() == "true":
            return True, False
        by_class |= classes and key in ("class", "id") and any(_noise_class(t, in_article) for t in value.split())
    return (True, False) if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) else (by_class, by_class)


def lines(page: str, classes: bool = True) -> list[tuple[str, int, int, bool]]:
    """(text, characters, linked characters, inside an article) of each block in order; noise is left out, by class only if ``classes``."""
    out: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # open elements, whether each begins a part set apart, and by its class only
    noise = articles = anchors = at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            line = " ".join("".join(text).split())
            if line:
                out.append((line, len(line), min(linked, len(line)), articles > 0))
            text.clear()
        linked = 0

    def take(raw: str) -> None:
        nonlocal linked
        if raw and not noise:
            piece = html.unescape(raw)
            text.append(piece)
            if anchors:
                linked += len(piece.strip())

    def close(upto: int) -> None:
        nonlocal noise, articles, anchors
        while len(stack) > upto:
            name, apart, _ = stack.pop()
            noise -= apart
            articles -= name in ("article", "main")
            anchors -= name == "a"

    while m := _TOKEN.search(page, at):
        take(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if name == "br":
            take(" ")
        elif name in BLOCK:
            flush()
        if m[1]:
            # an end tag without its start tag closes nothing; inline elements end with the block around them
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/") or name in ("script", "style", "textarea", "title"):
                end = _END[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        # implied end tags: inline elements opened within the closed one (such as an unclosed b) end too
        for i in range(len(stack) - 1, -1, -1):
            top = stack[i][0]
            if name in CLOSED_BY.get(top, ()):
                close(i)
                break
            if top in BLOCK:
                break
        if name in ("article", "main") and noise:
            # what holds an article is no noise, whatever its class
            for i, (other, apart, by_class) in enumerate(stack):
                if by_class:
                    noise -= apart
                    stack[i] = (other, False, False)
        apart, by_class = _noisy(name, m[3], articles > 0, classes)
        if m[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        stack.append((name, apart, by_class))
        noise += apart
        articles += name in ("article", "main")
        anchors += name == "a"
    rest = page[at:]
    cut = re.search(r"<[a-zA-Z/!]", rest)  # a tag that the end of the page cuts off
    take(rest[: cut.start()] if cut else rest)
    flush()
    return out


def regions(weight: np.ndarray, window: int, threshold: int) -> list[tuple[int, int]]:
    """(first, last + 1) of the lines between each surge of the block sums above the threshold and the dive that ends it."""
    block = np.convolve(weight, np.ones(window, dtype=np.int64))[window - 1 :]  # sum of each line and the window - 1 after it
    limit = threshold if (block > threshold).any() else 0
    out, i = [], 0
    while i < len(block):
        if block[i] <= limit:
            i += 1
            continue
        surge = i
        while i < len(block) and block[i] > 0:
            i += 1
        heavy = surge + np.flatnonzero(weight[surge:i])
        out.append((int(heavy[0]), int(heavy[-1]) + 1))
    return out


def extract(page: str | None, window: int = WINDOW, threshold: int = THRESHOLD) -> str:
    if not page:
        return ""
    rows = lines(page) or lines(page, classes=False)
    inside = np.array([r[3] for r in rows], dtype=bool)
    length, linked = (np.array([r[k] for r in rows], dtype=np.int64) for k in (1, 2))
    own = length - linked
    marked = bool(inside.any()) and int(length[inside].sum()) > int(own[~inside].sum())
    weight = np.where(inside, length + threshold, 0) if marked else own
    kept = [i for a, b in regions(weight, window, threshold) for i in range(a, b) if inside[i] or not marked]
    return "\n".join(rows[i][0] for i in kept)


@F.pandas_udf(StringType())
def main_text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in pages:
        yield pd.Series([extract(p) if isinstance(p, str) else "" for p in batch], dtype=object)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", main_text("html").alias("text"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
