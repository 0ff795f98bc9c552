"""Main text of web pages by tree scoring.

A page becomes a tree of block elements with blocks of text. Each block gives points for its length and commas, less by the share of
its characters inside links, to its container (whole), that one's parent (half) and those above (a third by level). The container with
most points is kept with those siblings that look like it; menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments go by their element, role or name before anything is scored, and lists of links inside what is kept go after it.

Blocks stay whole and in page order: character references are decoded, white space becomes one space, `<br>` is white space.

Bounds: each page is read by itself, in time in proportion to its length, and in batches of
few pages; nothing is shuffled. Defined cases: a null or empty page, or one without text outside what goes, gives an empty text; very long
pages are read whole; unclosed elements end with the next block that can't stand in them, or with the page; containers of equal points:
the first one; repeated rows give the same text each; an empty table gives an empty result; further columns are passed through, but for
`text` and `n_chars`, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import python_ready

# Fixed values of HTML and of common page templates.
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | set("p pre li dt dd td th figcaption caption summary address".split())
BLOCKS = PARAGRAPHS | set("article blockquote body center details div dl fieldset figure hgroup hr html main ol section table tbody tfoot thead tr ul".split())
GONE = set("aside button canvas datalist dialog footer form head menu nav object select svg template label audio video search".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER_OPEN = set("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes, and the elements beyond which it doesn't look.
CLOSES = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"})}
ROLES = set("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
NAMES = set(
    "ad ads adbox adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies gdpr footer login menu modal nav navbar navigation newsletter notice notices notification "
    "outbrain overlay pager pagination popup promo promoted promotion recommended recommendations related share sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser teasers toast toolbar topbar widget".split()
)
COMMENTS = set("comment comments commentlist disqus respond replies".split())
#: Names that go unless a name of the article stands beside them, as in entry-header.
HEADS = set("header masthead".split())
ARTICLE_NAMES = set("article content entry post story".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)""", re.S)
_UNCLOSED = re.compile(r"<[!?/a-zA-Z]")  # after the last > nothing but text can come
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_COMMA = re.compile("[,،，、﹐]")


def unwanted(tag: str, attributes: str, in_article: bool) -> str:
    """Why an element goes by itself: "" (it doesn't), "name", or "comments"."""
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = {p.lower() for x in ("class", "id") for p in _PART.findall(found.get(x, ""))}
    if names & COMMENTS:
        return "" if tag == "body" else "comments"
    if tag in ("body", "html"):
        return ""
    if "hidden" in found or found.get("aria-hidden") == "true" or _HIDDEN.search(found.get("style", "")):
        return "name"
    if tag in GONE or names & NAMES or found.get("role", "").lower() in ROLES:
        return "name"
    head = tag == "header" and not in_article or bool(names & HEADS)
    return "name" if head and not names & ARTICLE_NAMES else ""


class Page:
    """Nodes in page order (a parent comes before its children) and blocks of text."""

    def __init__(self, html: str):
        self.tag, self.up, self.why, self.look = ["html"], [-1], [""], [""]
        self.blocks: list[tuple[int, str, int]] = []  # node, text, characters inside links
        self.open, self.run, self.linked, self.in_link = [0], [], 0, False
        self._read(html)

    def _read(self, html: str) -> None:
        at, last = 0, html.rfind(">")
        while at <= last and (m := _TOKEN.search(html, at)):
            self._say(html[at : m.start()])
            at = m.end()
            end, tag, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if end:
                self._end(tag)
            elif tag in RAW:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            else:
                self._start(tag, rest)
        self._say(_UNCLOSED.split(html[at:], maxsplit=1)[0])
        self._flush()

    def _say(self, text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            self.run.append(text)
            if self.in_link:
                self.linked += len(text)

    def _flush(self) -> None:
        if self.run:
            if text := " ".join("".join(self.run).split()):
                self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
            self.run, self.linked = [], 0

    def _start(self, tag: str, rest: str) -> None:
        if tag == "a":
            self.in_link = True
        elif tag == "br":
            self._say(" ")
        elif tag in BLOCKS or tag in GONE or tag == "header":
            self._flush()
            if tag == "hr" or tag == "html":
                return
            if self.tag[self.open[-1]] in HEADINGS or self.tag[self.open[-1]] == "p":
                self.open.pop()
            if tag in CLOSES:
                same, beyond = CLOSES[tag]
                for k in range(len(self.open) - 1, 0, -1):
                    if (t := self.tag[self.open[k]]) in same:
                        del self.open[k:]
                    if t in same or t in beyond:
                        break
            elif "head" in (self.tag[x] for x in self.open[:3]) and tag in BLOCKS:
                del self.open[next(k for k, x in enumerate(self.open) if self.tag[x] == "head") :]
            if not rest.endswith("/") or tag not in GONE:
                self.tag.append(tag)
                self.up.append(self.open[-1])
                self.look.append(rest)
                self.why.append(unwanted(tag, rest, tag == "header" and any(self.tag[x] == "article" for x in self.open)))
                self.open.append(len(self.tag) - 1)
        elif tag not in NEVER_OPEN and rest and unwanted(tag, rest, True) and tag not in ("b", "i", "em", "strong", "u", "font", "small"):
            self.tag.append(tag)  # an inline element that goes, such as <span class="ad">
            self._flush()
            self.up.append(self.open[-1])
            self.look.append(rest)
            self.why.append("name")
            self.open.append(len(self.tag) - 1)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag == "br":
            self._say(" ")
        else:
            for k in range(len(self.open) - 1, 0, -1):
                if self.tag[self.open[k]] == tag:
                    self._flush()
                    del self.open[k:]
                    break
                if self.tag[self.open[k]] == "table" and tag != "table" and tag in BLOCKS and any(self.tag[x] in ("td", "th") for x in self.open[k + 1 :]):
                    break  # a cell's stray end tag doesn't close what the table stands in


def points(text: str, linked: int) -> float:
    return (1 + len(_COMMA.findall(text)) + len(text) / 100) * (1 - linked / len(text))


def goes(page: Page) -> list[bool]:
    """Whether each node goes. An unwanted element stays if most of the page's points and an article or main element are in it."""
    n = len(page.tag)
    value, holds = [0.0] * n, [False] * n
    for node, text, linked in page.blocks:
        value[node] += points(text, linked)
    for k in range(n - 1, 0, -1):
        inside = holds[k] or page.tag[k] in ("article", "main") and not page.why[k]
        if page.why[k] != "comments":
            holds[page.up[k]] |= inside
        if not page.why[k] or inside and page.why[k] != "comments":
            value[page.up[k]] += value[k]
    gone = [False] * n
    for k in range(1, n):
        rescued = page.why[k] == "name" and holds[k] and 2 * value[k] >= value[0]
        gone[k] = gone[page.up[k]] or bool(page.why[k]) and not rescued
    return gone


def main_text(html: str | None) -> str:
    page = Page(html) if html else None
    if page is None or not page.blocks:
        return ""
    n, up, tag = len(page.tag), page.up, page.tag
    gone = goes(page)
    blocks = [b for b in page.blocks if not gone[b[0]]]
    score, total, chars, linked = [0.0] * n, [0.0] * n, [0] * n, [0] * n
    for node, text, link in blocks:
        got, to, level = points(text, link), up[node] if tag[node] in PARAGRAPHS else node, 1
        total[node] += got
        chars[node] += len(text)
        linked[node] += link
        while to >= 0:
            score[to] += got / (level if level < 3 else 3 * (level - 1))
            to, level = up[to], level + 1
            if level > 6:
                break
    for k in range(n - 1, 0, -1):
        total[up[k]] += total[k]
        chars[up[k]] += chars[k]
        linked[up[k]] += linked[k]
    best = max((k for k in range(n) if not gone[k] and tag[k] not in PARAGRAPHS), key=lambda k: (score[k], -k), default=0)
    if score[best] <= 0:
        return ""
    above = best
    while above > 0 and tag[above] != "article":
        above = up[above]
    best = above if above > 0 else best
    below: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        below[up[k]].append(k)
    kept, least, at = {best}, max(score[best] / 5, 3), best
    for _ in range(3):  # siblings of the best, and of what holds it where those are elements of the same look
        if at == 0:
            break
        for k in below[up[at]]:
            alike = tag[k] == tag[at] and page.look[k] == page.look[at]
            if k == at or gone[k] or not chars[k] or linked[k] > 0.3 * chars[k] or at != best and not alike:
                continue
            long = chars[k] > 80 or chars[k] > 0 and tag[k] == "p" and total[k] >= 1.2
            if tag[k] in HEADINGS and k < best and tag[k] in ("h1", "h2") or tag[k] in PARAGRAPHS - HEADINGS and long or tag[k] not in PARAGRAPHS and max(score[k], total[k] if alike else 0) >= least:
                kept.add(k)
        at = up[at]
    stays = [False] * n
    for k in range(n):
        links = tag[k] in ("ul", "ol", "dl", "div", "section", "table", "p", "center") and k not in kept and linked[k] > 0.6 * chars[k]
        stays[k] = (k in kept or k > 0 and stays[up[k]]) and not gone[k] and not (links and len(below[k]) != 0)
    return "\n\n".join(text for node, text, _ in blocks if stays[node])


def extracted(pages: DataFrame) -> DataFrame:
    """pages (html) with text and n_chars."""
    python_ready(pages.sparkSession, rows=128)

    @F.pandas_udf("string")
    def text_of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(bytes(x).decode("utf-8", "replace") if x is not None else None) for x in part], dtype=object)

    rest = [c for c in pages.columns if c not in ("text", "n_chars")]
    out = pages.select(*rest, text_of(F.col("html").cast("binary")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
