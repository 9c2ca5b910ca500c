"""Main text of HTML pages by line-block distribution.

1. *Strip the markup.* Scripts, styles, comments and tags go; every block-level
   tag ends a line. Elements that are not content by their name, role, class or id
   (menus, headers, footers, sidebars, notices, adverts, forms, reader comments)
   leave ``WINDOW`` empty lines instead of their text; a line of links only, or a
   copyright line, counts as empty on pages that mark no article.
2. *Sum.* The distribution is the text length over a sliding window of ``WINDOW``
   lines.
3. *Surge and dive.* A stretch begins where the sum rises from nothing and ends
   where it falls back to nothing; it counts when it peaks at ``SURGE`` or more
   characters, and the text between is kept. Where a page marks its article
   (``article`` or ``main``), lines outside it are empty and any rise counts.
   Where nothing peaks, the stretch with the highest peak is kept.

Character references are decoded in text, white space inside a block becomes one
space, blocks are joined by one newline.

Defined results: a null or empty page, or one without text, has the text ``''``;
an element that is never closed ends with the page, unless the article follows
it: then it ends there; repeated pages are extracted alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

WINDOW = 3
SURGE = 80
LINKS = 0.8  # a line with at least this share of link text is a menu line

# fixed values: HTML's block-level and non-content elements
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option "
    "p pre section select summary table tbody td tfoot th thead title tr ul".split())
NOT_CONTENT = frozenset("nav header footer aside form menu dialog button select fieldset datalist head title noscript "
                        "template svg math iframe object audio video canvas map".split())
RAW = frozenset("script style textarea noframes noembed xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
# fixed values: what a class or id calls a part that is not content
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay nav navbar navigation menu submenu breadcrumb breadcrumbs "
    "pagination pager sidebar aside rail widget widgets header masthead topbar footer bottom copyright legal disclaimer "
    "comment comments commentlist disqus reply replies respond discussion social share sharing related recommended "
    "recommendations newsletter subscribe subscription signup login search toolbar skip".split())
NEVER = frozenset("html body main".split())  # whatever their class
ARTICLES = frozenset("article main".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(
    r"<!--(?:.*?-->|.*\Z)"
    r"|<(?P<raw>script|style|textarea|noframes|noembed|xmp)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|<[!?][^>]*>", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_COPYRIGHT = re.compile(r"(?:©|\(c\)|copyright\b).{0,160}\Z", re.I)
_TOKEN = re.compile(r"[a-z0-9]+")


def _is_boilerplate(name: str, attrs: str) -> bool:
    if name in NEVER:
        return False
    if name in NOT_CONTENT:
        return True
    if not attrs or "=" not in attrs:
        return False
    for key, value in _ATTR.findall(attrs):
        value = value.strip("\"'").lower()
        if key.lower() == "role":
            if value.strip() in ROLES:
                return True
        elif not MARKS.isdisjoint(_TOKEN.findall(value)):
            return True
    return False


class _Page:
    """The lines of a page: text, link characters, whether inside an article; None is an empty line."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, int, bool] | None] = []
        self.parts: list[str] = []
        self.links = 0
        tags = list(_TAG.finditer(page))
        self.has_article = False
        article, link, last, i = 0, 0, 0, 0
        while i < len(tags):
            tag = tags[i]
            self._text(page[last:tag.start()], link)
            last = tag.end()
            name = (tag["name"] or "").lower()
            i += 1
            if not name:
                continue  # comment, script, style, declaration
            if tag["close"]:
                if name in BLOCKS:
                    self._end(article)
                if name == "a":
                    link = max(0, link - 1)
                elif name in ARTICLES:
                    article = max(0, article - 1)
                continue
            if name in VOID:
                if name == "hr":
                    self._end(article)
                else:
                    self.parts.append(" " if name == "br" else "")
                continue
            if _is_boilerplate(name, tag["attrs"]):
                end, holds = self._element(tags, i, name)
                if not holds or name not in ("div", "section"):
                    self._end(article)
                    self.lines += [None] * WINDOW
                    last = tags[end - 1].end() if end > i else last
                    i = max(end, i)
                    if end == len(tags) and not self.closed:
                        last = len(page)
                    continue
            if name in BLOCKS:
                self._end(article)
            if name == "a":
                link += 1
            elif name in ARTICLES:
                article += 1
                self.has_article = True
        self._text(page[last:], link)
        self._end(article)

    def _element(self, tags: list, at: int, name: str) -> tuple[int, bool]:
        """Where the element opened just before tag ``at`` ends, and whether it holds an article."""
        depth, holds, first = 1, False, None
        self.closed = True
        for k in range(at, len(tags)):
            other = (tags[k]["name"] or "").lower()
            if other == name:
                depth += -1 if tags[k]["close"] else 1
                if not depth:
                    return k + 1, holds
            elif other in ARTICLES and not tags[k]["close"] and not _is_boilerplate(other, tags[k]["attrs"]):
                holds = True
                first = k if first is None else first
        self.closed = False
        return (len(tags) if first is None else first), False  # never closed

    def _text(self, text: str, link: int) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            self.parts.append(text)
            if link:
                self.links += len("".join(text.split()))

    def _end(self, article: int) -> None:
        line = " ".join("".join(self.parts).split())
        if line:
            self.lines.append((line, self.links, article > 0))
        self.parts, self.links = [], 0


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    parsed = _Page(page)
    sizes, texts = [], []
    for line in parsed.lines:
        if line is None:
            sizes.append(0)
            texts.append("")
            continue
        text, links, inside = line
        size = len(text)
        if parsed.has_article:
            size = size if inside else 0
        elif links >= LINKS * len("".join(text.split())) or _COPYRIGHT.match(text):
            size = 0
        sizes.append(size)
        texts.append(text)
    sums, run = [], sum(sizes[:WINDOW])
    for i in range(len(sizes)):
        sums.append(run)
        run += (sizes[i + WINDOW] if i + WINDOW < len(sizes) else 0) - sizes[i]
    stretches, start, peak = [], None, 0
    for i, s in enumerate([*sums, 0]):
        if s and start is None:
            start, peak = i, 0
        if start is not None:
            if not s:
                stretches.append((peak, start, i))
                start = None
            else:
                peak = max(peak, s)
    surge = 1 if parsed.has_article else SURGE
    kept = [x for x in stretches if x[0] >= surge] or sorted(stretches, key=lambda x: (-x[0], x[1]))[:1]
    out = []
    for _, a, b in kept:
        out += [t for t, n in zip(texts[a:b], sizes[a:b]) if n]
    return "\n".join(out)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: the id, the url, ``text`` and ``n_chars`` (code points)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def turn(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(p) for p in batch.column("page").to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("link"), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], names=["id", "link", "text", "n_chars"])

        return turn

    thin = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("link"), F.col(html_col).cast("string").alias("page"))
    kinds = {f.name: f.dataType.simpleString() for f in thin.schema}
    out = map_batches(thin, make, f"id {kinds['id']}, link {kinds['link']}, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("link").alias(url_col), "text", "n_chars")
