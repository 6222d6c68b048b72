"""Main text of web pages by line-block distribution.

A page is read once, tag by tag, and every block becomes a line. The length of a line is that of its text
outside links (headings count whole); lines of menus, headers, footers, sidebars, notices, adverts, forms and
reader comments have length 0, as elements (nav, footer, aside, ...) or by a class, id or role that says nothing
else. Lengths are summed over windows of WINDOW lines. Text surges where a sum rises from nothing and dives where
it falls back to nothing; the lines between are a stretch, which is kept if one of its sums reaches a level that
comes from the page's own lines (LEVEL of their median, LEAST characters at most). So lists of links and stray
scraps go, in a marked article as well, and a short paragraph between two others stays.

Marks count as lengths too: where article (or main) elements hold at least MARKED of a page's text, lines outside
them have length 0. An article inside a dropped element is none. A form that holds at least half of the page's
text is a frame of the page and not dropped, but its controls are. Leaving a dropped element between marked or
unmarked text is no dive: only lines make one.

Defined cases: a null or empty page has empty text and n_chars 0; a page without block tags is one block;
elements that are never closed end with their parent; a stray < is text; stretches with equal sums are all kept;
repeated rows give equal rows; an empty table gives an empty result; other columns are ignored. Pages are read
whole, very long ones too.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from quernel.runtime import ship_package

WINDOW = 3
#: A stretch of text needs a window sum of LEVEL times the median line, but no more than LEAST characters.
LEVEL, LEAST = 0.25, 40
#: Share of the text that marked articles must hold to be the article; share of it at which a form is a frame.
MARKED, FRAME = 0.25, 0.5

# HTML element names by their role.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "object", "canvas", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = {"head", "nav", "header", "footer", "aside", "menu", "dialog", "button", "select", "datalist", "search"}
#: Words that name what isn't the article, and words that say nothing more about it. A class, id or role drops its
#: element if it has one of the first and none but these: "comment-list" does, "share-price" doesn't.
NAMED = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "sidebar", "widget", "widgets", "related", "recommended", "teaser", "share", "sharing", "social", "breadcrumb", "breadcrumbs", "menu", "navbar", "nav", "navigation", "header", "masthead", "topbar", "footer", "comment", "comments", "reply", "replies", "respond", "disqus", "pagination", "pager", "search", "login", "complementary", "contentinfo"}
FILLER = {"site", "page", "global", "main", "primary", "secondary", "top", "bottom", "left", "right", "side", "area", "container", "wrapper", "wrap", "inner", "outer", "box", "block", "section", "bar", "panel", "list", "item", "items", "links", "posts", "buttons", "form", "thread", "policy", "slot", "unit", "col", "column", "row", "message", "user", "reader", "mobile", "desktop"}

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES_P = BLOCK - {"br", "html", "head", "body"}


class Line(NamedTuple):
    """A block of a page. length: characters outside links; main, article, form: which mark or form holds it, 0 for none."""

    text: str
    length: int
    dropped: bool
    main: int
    article: int
    form: int


def _named(attributes: str) -> tuple[bool, bool]:
    """Whether attributes say that an element isn't the article, or that it is."""
    if not attributes.strip():
        return False, False
    gone = main = False
    for name, value in _ATTR.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                words = {w for w in _WORD.findall(_CAMEL.sub(" ", token).lower()) if len(w) > 1}
                gone |= bool(words & NAMED) and words <= NAMED | FILLER
            main |= name.lower() == "role" and value.strip("\"'").lower() == "main"
    return gone, main


class _Open(NamedTuple):
    tag: str
    dropped: bool
    main: int
    article: int
    form: int
    link: bool
    heading: bool


def lines(page: str) -> list[Line]:
    """The blocks of a page that have text, in their order."""
    out: list[Line] = []
    held: list[str] = []
    plain = 0  # characters of held outside links
    stack = [_Open("", False, 0, 0, 0, False, False)]
    made, at, n = 0, 0, len(page)

    def close() -> None:
        nonlocal plain
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                now = stack[-1]
                out.append(Line(text, len(text) if now.heading else min(plain, len(text)), now.dropped, now.main, now.article, now.form))
        plain = 0

    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text = html.unescape(page[at:stop])
            held.append(text)
            if not stack[-1].link:
                plain += len(" ".join(text.split()))
        if not m:
            break
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if tag in BLOCK:
            close()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if any(x.dropped != stack[k - 1].dropped for x in stack[k:]):
                        close()
                    del stack[k:]
                    break
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag == "body":  # ends a head that was left open
            del stack[1:]
        elif tag in _CLOSES_P and stack[-1].tag == "p" or tag in ("li", "option", "dd", "dt", "tr", "td", "th") and stack[-1].tag == tag:
            stack.pop()
        above = stack[-1]
        gone, main = _named(m[3])
        gone = (tag in DROPPED or gone) and tag not in ("body", "html", "main") and not main
        if gone and not above.dropped:
            close()
        made += 1
        marked = not (gone or above.dropped)
        stack.append(
            _Open(
                tag,
                above.dropped or gone,
                above.main or (made if marked and (tag == "main" or main) else 0),
                above.article or (made if marked and tag == "article" else 0),
                above.form or (made if tag == "form" else 0),
                above.link or tag == "a",
                above.heading or tag in HEADING,
            )
        )
    close()
    return out


def lengths(found: list[Line]) -> list[int]:
    """Length of each line: 0 where it is known not to be the article."""
    size = [0 if x.dropped else x.length for x in found]
    whole = sum(size)
    in_form: dict[int, int] = {}
    for x, n in zip(found, size):
        in_form[x.form] = in_form.get(x.form, 0) + n
    size = [n if not x.form or in_form[x.form] >= FRAME * whole else 0 for x, n in zip(found, size)]
    whole = sum(size)
    for mark in ("article", "main"):
        inside = sum(n for x, n in zip(found, size) if getattr(x, mark))
        beside = sum(n for x, n in zip(found, size) if x.main)
        if inside and inside >= MARKED * whole and (mark == "main" or inside >= FRAME * beside):
            return [n if getattr(x, mark) else 0 for x, n in zip(found, size)]
    return size


def between(found: list[Line]) -> list[str]:
    """Text of the lines between surges and dives."""
    size = lengths(found)
    some = sorted(n for n in size if n)
    if not some:
        return []
    level = min(LEAST, LEVEL * some[len(some) // 2])
    # the sum of a window that ends at a line; a stretch runs from the first line of a window with text to its last
    text = [i for i, n in enumerate(size) if n]
    kept: list[str] = []
    first = 0
    for k in range(1, len(text) + 1):
        if k < len(text) and text[k] - text[k - 1] <= WINDOW:  # fewer than WINDOW lines without text: no window sum is 0
            continue
        stretch = text[first:k]
        first = k
        inside = range(stretch[0], stretch[-1] + 1)
        if max(sum(size[max(stretch[0], i - WINDOW + 1) : i + 1]) for i in inside) >= level:
            before, after = _links(found, stretch[0], -1), _links(found, stretch[-1], 1)
            kept += [found[i].text for i in range(inside[0] - before, inside[-1] + after + 1) if size[i] or _beside(found[i], found[stretch[0]])]
    return kept


def _beside(line: Line, other: Line) -> bool:
    """Whether a line of nothing but links stands in the same place as another one."""
    return not line.dropped and line.length == 0 and (line.main, line.article, line.form) == (other.main, other.article, other.form)


def _links(found: list[Line], i: int, step: int) -> int:
    """How many lines of links from line i on belong to the marked article that ends there: fewer than WINDOW, as more are a dive."""
    if not (found[i].article or found[i].main):
        return 0
    n = 0
    while 0 <= i + step * (n + 1) < len(found) and _beside(found[i + step * (n + 1)], found[i]):
        n += 1
    return n if n < WINDOW else 0


def main_text(page: str | None) -> str:
    return "\n".join(between(lines(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    ship_package(pages.sparkSession)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars bigint")
