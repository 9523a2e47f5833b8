"""Main text of web pages by the distribution of text over sliding line windows."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines of a window.
WINDOW = 3
#: A window surges where its text reaches this share of the page's fullest window, or so many characters.
SURGE_SHARE, SURGE_CHARS = 0.2, 300
#: Of several stretches of text, those of at least this share of the longest stay.
STRETCH_SHARE = 1 / 3

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINER = frozenset("article aside body center details dialog div fieldset footer form header html main nav section".split())
BLOCK = CONTAINER | frozenset("address blockquote caption dd dir dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr legend li menu ol option p pre search summary table tbody td tfoot th thead tr ul".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no part of an article, with all they hold.
STRIPPED = frozenset("aside audio button canvas datalist dialog footer form head header iframe input label menu nav noscript object script search select style svg template textarea title video".split())
#: An element that opens ends the nearest open one of these, unless one of the second set lies between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Words in class, id or role that name menus, headers, footers, sidebars, notices, adverts, forms and comments.
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adsense|adslot|adv|advert\w*|alert|alertdialog|banner|breadcrumbs?|byline|captcha|comments?|commentlist|commentform|complementary|consent|contentinfo|cookies?|cookiebar|copyright|disclaimer|disqus|footer|form|gdpr|header|legal|login|masthead|menu|menubar"
    r"|modal|nav|navbar|navigation|newsletter|notices?|notification|overlay|pager|pagination|popup|promo|promoted|promotion|recommendations?|recommended|related|replies|respond|responses|search|sharing|share|sidebar|sidenav|signup|skip|social|sponsor\w*|subscribe|subscription|tagcloud"
    r"|teasers?|toolbar|topbar|widgets?)(?=$|[\s_\d-])"
)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_REST = r"""((?:=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|[^>])*)>?"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|iframe|xmp|noembed|noframes)(?=[\s/>]){_REST}.*?(?:</\1[^>]*>?|\Z)|<(/?)([a-z][^\s/>]*){_REST}|<[!?/][^>]*>?", re.S | re.I)


class Line(NamedTuple):
    """Text of one block; its characters outside links (headings: all); the containers it stands in, as numbers."""

    text: str
    weight: int
    within: tuple[int, ...]
    heading: bool
    article: bool


class _Open(NamedTuple):
    tag: str
    number: int
    stripped: bool
    header: bool
    link: bool
    heading: bool
    article: bool


def _boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether the attributes hide the element or name it as no part of an article; whether as a header."""
    if not attributes.strip():
        return False, False
    a = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        a.setdefault(name.lower(), "".join(values))
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True, False
    if tag in ("html", "body", "main"):
        return False, False
    named = _CAMEL.sub("-", " ".join(a.get(k, "") for k in ("class", "id", "role"))).lower()
    found = {m[0].strip(" _-\t\n") for m in _NAMED.finditer(re.sub(r"(?:^|(?<=[\s_-]))(?:has|no|with|without)[_-]\w+", " ", named))}
    return bool(found), found == {"header"}


def lines(page: str) -> list[Line]:
    """The page without markup: one line a block, in page order, what is stripped left out.

    Unclosed and stray tags are met as browsers do: a block ends an open paragraph, list items and cells end each
    other, end tags without a start are passed over. Headings of an article's own header stay.
    """
    out: list[Line] = []
    stack = [_Open("", 0, False, False, False, False, False)]
    text: list[str] = []
    weight, number, at = 0, 0, 0

    def flush() -> None:
        nonlocal weight
        t = " ".join(entities.unescape("".join(text)).split())
        if t:
            own = next((x for x in reversed(stack) if x.tag in BLOCK), stack[0])
            heading = any(x.heading for x in stack[-8:])
            out.append(Line(t, len(t) if heading else min(weight, len(t)), tuple(x.number for x in stack if x.tag in CONTAINER and x is not own) + ((-own.number,) if own.tag in CONTAINER else ()), heading, own.article))
        text.clear()
        weight = 0

    def add(raw: str) -> None:
        nonlocal weight
        top = stack[-1]
        if raw and not (top.stripped or top.header and not top.heading):
            text.append(raw)
            weight += 0 if top.link else len("".join(entities.unescape(raw).split()))

    def close(tags: set[str] | frozenset[str], until: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                if any(x.tag in BLOCK for x in stack[i:]):
                    flush()
                del stack[i:]
                return
            if stack[i].tag in until:
                return

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        if not m[4]:
            continue
        tag = m[4].lower()
        if m[3]:
            close({tag}, frozenset() if tag in BLOCK else BLOCK)
        elif tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                add(" ")
        else:
            if tag in BLOCK:
                close({"p"}, BLOCK)
                flush()
            if tag in ENDS:
                close(*ENDS[tag])
            number += 1
            top, (named, as_header) = stack[-1], _boilerplate(tag, m[5])
            header = top.article and (tag == "header" or as_header)
            stack.append(_Open(
                tag, number, top.stripped or not header and (named or tag in STRIPPED), top.header or header,
                top.link or tag == "a", top.heading and tag not in BLOCK or tag in HEADING, top.article or tag in ("article", "main"),
            ))
    add(page[at:])
    flush()
    used = {n for x in out for n in x.within}
    return [x._replace(within=tuple(abs(n) for n in x.within if n > 0 or -n in used)) for x in out]


def main_lines(found: list[Line], window: int = WINDOW) -> list[int]:
    """Numbers of the lines between the surge and dive points of the page's windows.

    Each container that ends or begins between two lines counts as a blank line. Windows that hold no text part the
    page into stretches. In a stretch the text surges at the first block of lines, without a blank between, one of
    whose windows reaches the page's limit, and dives after the last such block; all between is kept.
    """
    if not found:
        return []
    blanks = [0] * len(found)
    for i in range(1, len(found)):
        a, b = found[i - 1].within, found[i].within
        common = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        blanks[i] = 0 if found[i - 1].heading else len(a) + len(b) - 2 * common
    block = np.cumsum(np.minimum(blanks, 1))
    where = np.arange(len(found)) + np.cumsum(blanks)
    spread = np.zeros(int(where[-1]) + 1, np.int64)
    spread[where] = [x.weight for x in found]
    # Sums of windows over the lines with their blanks; a stretch ends where one is empty.
    sums = np.convolve(spread, np.ones(window, np.int64))
    empty = np.flatnonzero(sums[: len(spread)] == 0)
    stretch = np.searchsorted(empty, where, side="right")
    # The fullest window of each block of lines.
    weight = spread[where]
    own = weight.copy()
    for k in range(1, window):
        same = np.zeros(len(found), bool)
        same[k:] = block[k:] == block[:-k]
        own[same] += weight[np.flatnonzero(same) - k]
    peak = np.zeros(int(block[-1]) + 1, np.int64)
    np.maximum.at(peak, block, own)
    hot = (weight > 0) & (peak[block] >= max(1, min(SURGE_CHARS, SURGE_SHARE * int(peak.max()))))
    runs: list[tuple[int, int]] = []
    for s in np.unique(stretch[hot]):
        blocks = block[hot & (stretch == s)]
        inside = np.flatnonzero((stretch == s) & (block >= blocks.min()) & (block <= blocks.max()) & ((weight > 0) | np.array([x.heading for x in found])))
        runs.append((int(inside[0]), int(inside[-1]) + 1))
    if any(found[i].article for a, b in runs for i in range(a, b)):
        runs = [(a, b) for a, b in runs if any(x.article for x in found[a:b])]
    most = max((int(weight[a:b].sum()) for a, b in runs), default=0)
    kept = [i for a, b in runs if weight[a:b].sum() >= STRETCH_SHARE * most for i in range(a, b)]
    while kept and found[kept[-1]].heading and not all(found[i].heading for i in kept):
        kept.pop()  # the title of something that was stripped
    return kept


def main_text(page: str | None) -> str:
    found = lines(page or "")
    return " ".join(found[i].text for i in main_lines(found))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text``, the page's main text, and ``n_chars``, its code points.

    Markup is stripped to lines of blocks; elements that HTML or their names mark as menus, headers, footers,
    sidebars, notices, adverts, forms or comments go with it. Line windows then decide (``main_lines``). A page is
    worked on as a whole in one row, without a shuffle. Null and empty pages, and pages without text, give an empty
    text; pages without markup are one block. Repeated rows stay; null ids are kept as they are; other columns,
    whatever their names, are not read.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = [main_text(x) for x in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(t, pa.string()), pa.array(map(len, t), pa.int64())], names=[*keep, "text", "n_chars"])

    schema = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)
    return pages.select(*keep, pages[html].cast("string")).mapInArrow(texts, f"{schema}, text string, n_chars long")
