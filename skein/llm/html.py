"""Main-text extraction from HTML pages.

The standard library's streaming parser gives events; they make lines (the text of one block) with a text-to-tag ratio:
characters outside links per tag of the line. Lines in menus, forms, adverts and the like (by element, role, class or
id) have ratio zero, unless what is so named holds most of the page's text; a heading or paragraph with such a name has a weaker one. The ratios are smoothed by a Gaussian
over the lines, and two-means clustering of the smoothed values sets the threshold above which lines form regions.
The regions select: the block that holds most of their text is the article (with the <article> or <main> around it, if
there is one) and stays whole; other lines stay only if they are dense themselves or lie beside a region's lines. Where
only the page itself holds the regions, the smoothed ratio decides on each line. The time is linear
in the page's length, however deep its elements are nested.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements by kind.
DROPPED = frozenset("script style noscript template svg math head title iframe object embed canvas audio video select textarea button nav footer aside form dialog menu".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav noscript ol option p pre section select summary table tbody tfoot thead title tr ul".split()
)
CELLS = frozenset("td th br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Roles and words of class and id names that mark what is not the article.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar status".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies disclaimer discussion disqus feedback footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar warning widget widgets".split()
)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
SIGMA = 1.5
#: Share of the regions' text that an element must hold for its other lines to stay too.
HELD = 0.7
#: Share of the page's text above which an element's kind or name may be no sign of boilerplate.
MOST = 0.5
#: Characters outside links, for each one inside, that a list of links may hold.
LABELS = 0.1
#: What the ratio of a heading or paragraph with a word of MARKS is multiplied by.
WEAK = 0.5
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are boilerplate by their kind, unless they hold the article.
SOFT = frozenset("nav footer aside form dialog menu header".split())
#: Elements that begin an article, and those that they end where these hold links only.
BEGINS = frozenset("article main h1".split())
TEXTS = HEADINGS | frozenset("p li dt dd pre blockquote figcaption".split())
#: Elements that close one of their kind before them, and those whose names say nothing.
CLOSED = frozenset("p li dt dd tr option".split())
WHOLE = ("", "html", "body", "table", "tbody", "tr")  # where no smaller block holds the regions, lines must be dense or lie among dense ones
NEVER_MARKED = frozenset("html body main article".split())


def _named(attrs: list[tuple[str, str | None]]) -> int:
    """0 without a word of MARKS in the class or id, 1 if other words stand beside it, 2 if not."""
    words = {w.lower() for name, value in attrs if name == "class" or name == "id" for w in _NAME.findall(value or "")}
    return 0 if not words & MARKS else 1 if words - MARKS else 2


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    for name, value in attrs:
        value = value or ""
        if name == "role":
            if value.strip().lower() in ROLES:
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDDEN.search(value.lower()):
            return True
    return False


class _Page(HTMLParser):
    """Collects the blocks of a page as a tree (each knows its parent only) and its lines, the text of one block each, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        # blocks in the order of their start tags; block 0 stands for the page
        self.tag, self.parent, self.bad, self.soft, self.mark = [""], [0], [False], [False], [0]
        self.began = [(0, 0)]  # characters outside and inside links before each block
        self.chars = self.chars_linked = 0
        self.stack = [0]
        self.open: Counter[str] = Counter()
        self.line_text: list[str] = []
        self.line_tags: list[int] = []
        self.line_linked: list[int] = []
        self.line_block: list[int] = []
        self.text: list[str] = []
        self.tags = self.linked = self.links = 0

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.line_text.append(text)
            self.line_tags.append(self.tags)
            self.line_linked.append(self.linked)
            self.line_block.append(self.stack[-1])
        self.text.clear()
        self.tags = self.linked = 0

    def _pop(self) -> str:
        tag = self.tag[self.stack.pop()]
        self.open[tag] -= 1
        return tag

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        block = tag in BLOCKS
        soft = tag in SOFT
        bad = tag in DROPPED and not soft or bool(attrs) and _hidden(attrs)
        mark = _named(attrs) if attrs and tag not in NEVER_MARKED else 0
        if block or bad or mark:
            self._flush()
        self.tags += 1
        if tag in CELLS:
            self.text.append(" ")
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        if tag in BEGINS:
            self._end_menus()
        if tag in CLOSED or block:
            # what an opening block closes by itself
            while (last := self.tag[self.stack[-1]]) == "p" or last == tag and tag in CLOSED:
                self._pop()
        if block or bad or mark:
            soft = soft and not (tag == "header" and (self.open["article"] or self.open["main"]))
            above = self.stack[-1]
            self.tag.append(tag)
            self.parent.append(above)
            self.bad.append(bad or self.bad[above])
            self.soft.append(soft)
            self.mark.append(mark)
            self.began.append((self.chars, self.chars_linked))
            self.open[tag] += 1
            self.stack.append(len(self.tag) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if self.open[tag] > 0:
            self._flush()
            while self._pop() != tag:
                pass
        elif tag in BLOCKS:
            self._flush()

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data)
            self.chars_linked += len(data)
        else:
            self.chars += len(data.strip())

    def parse_html_declaration(self, i: int) -> int:
        """Marked sections (<![...) are no part of HTML: as browsers do, they are skipped up to the next ">"; one without an end is text."""
        if not self.rawdata.startswith("<![", i):
            return super().parse_html_declaration(i)
        end = self.rawdata.find(">", i)
        if end < 0:
            self.handle_data("<![")
            return i + 3
        return end + 1

    def _end_menus(self) -> None:
        """Ends the outermost open element of SOFT that has held nothing but links so far: its end tag was left out."""
        for at, k in enumerate(self.stack):
            plain, linked = self.chars - self.began[k][0], self.chars_linked - self.began[k][1]
            if self.soft[k] and linked > 0 and plain <= LABELS * linked:
                self._flush()
                while len(self.stack) > at:
                    self._pop()
                self.links = 0
                return

    def within(self, values: np.ndarray) -> np.ndarray:
        """Of each block: the sum of the lines' values in it and in the blocks inside it."""
        out = np.bincount(self.line_block, weights=values, minlength=len(self.tag)).tolist()
        for k in range(len(out) - 1, 0, -1):  # a block comes after its parent
            out[self.parent[k]] += out[k]
        return np.array(out)

    def inherited(self, own: list[bool]) -> list[bool]:
        """Of each block: whether it or a block around it is so."""
        out = list(own)
        for k in range(1, len(out)):
            out[k] = out[k] or out[self.parent[k]]
        return out


def _threshold(values: np.ndarray) -> float:
    """The border of two clusters (two-means) of the logarithms."""
    x = np.log1p(values)
    low, high = float(x.min()), float(x.max())
    if high - low < 0.7:  # one cluster
        return -1.0
    for _ in range(20):
        upper = x > (low + high) / 2
        if upper.all() or not upper.any():
            break
        low, high = float(x[~upper].mean()), float(x[upper].mean())
    return float(np.expm1((low + high) / 2))


def _boilerplate(page: _Page, chars: np.ndarray) -> tuple[list[bool], list[bool]]:
    """Of each block: whether its kind, class or id makes it boilerplate, and whether a class or id only weakens it (a heading or paragraph).

    Names don't decide against the text: a block that holds most of the page's, with no article beside it, is none. For a
    form, or a class with other words too, that is enough; other elements of SOFT, and blocks whose class says nothing
    else, must also hold the article or the page's heading.
    """
    many = len(page.tag)
    weak = [False] * many
    article = [t in ("article", "main") for t in page.tag]
    headed = [t in BEGINS for t in page.tag]
    for k in range(many - 1, 0, -1):
        headed[page.parent[k]] |= headed[k]

    def decided(chosen: list[int], strict: Callable[[int], bool]) -> list[bool]:
        sure = [False] * many
        if chosen:
            held = page.within(chars)
            full = [a and held[k] > 0 for k, a in enumerate(article)]
            inside, around = list(map(int, full)), list(map(int, full))
            for k in range(many - 1, 0, -1):
                inside[page.parent[k]] += inside[k]
            for k in range(1, many):
                around[k] += around[page.parent[k]]
            for k in chosen:
                beside = inside[0] - inside[k] - (around[k] - full[k])
                sure[k] = held[k] <= MOST * held[0] or beside > 0 or strict(k) and not headed[k]
        return page.inherited(sure)

    by_kind = decided([k for k in range(many) if page.soft[k]], lambda k: page.tag[k] != "form")
    chars = np.where(np.array(by_kind)[page.line_block], 0, chars)
    by_name = []
    for k in (k for k in range(many) if page.mark[k] and not by_kind[k]):
        if page.tag[k] in HEADINGS or page.tag[k] == "p":
            weak[k] = True
        else:
            by_name.append(k)
    named = decided(by_name, lambda k: page.mark[k] == 2)
    return [a or b for a, b in zip(by_kind, named, strict=True)], page.inherited(weak)


def smoothed(ratio: np.ndarray) -> np.ndarray:
    reach = np.arange(-4, 5)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    return np.convolve(np.pad(ratio, 4), kernel / kernel.sum(), "valid")


def main_blocks(html: str) -> list[str]:
    """The article's blocks in page order."""
    page = _Page()
    page.feed(html)
    page.close()
    page._flush()
    if not page.line_text:
        return []
    block, texts = page.line_block, page.line_text
    size, linked = np.array([len(t) for t in texts]), np.array(page.line_linked)
    bad = np.array(page.bad)[block]
    chars = np.where(bad, 0, np.maximum(0, size - linked)).astype(float)
    by_name, by_weak = _boilerplate(page, chars)
    bad |= np.array(by_name)[block]
    weak = np.array(by_weak)[block]
    chars[bad] = 0
    ratio = chars / np.maximum(1, page.line_tags)
    own = ratio.copy()
    ratio[weak] *= WEAK
    smooth = smoothed(ratio)
    least = _threshold(smooth[~bad]) if not bad.all() else -1.0
    near = smooth > least
    region = near & (chars > 0)
    if not region.any():
        region = chars > 0
    # the block around the regions: the innermost with enough of their text, and the articles that this one is in
    in_region = page.within(np.where(region, chars, 0))
    enough = [k for k in range(len(page.tag)) if in_region[k] >= HELD * in_region[0] and page.tag[k] not in TEXTS]
    bound = max(enough)
    up = bound
    while up:
        up = page.parent[up]
        if page.tag[up] in ("article", "main"):
            bound = up
    inside = page.inherited([k == bound for k in range(len(page.tag))])
    # short texts whose block lies beside a region's lines stay with them
    beside = {page.parent[block[k]] for k in np.flatnonzero(region & ~np.array(inside)[block])}
    dense = np.flatnonzero(own > least)
    after, before = np.searchsorted(dense, np.arange(len(texts))), np.searchsorted(dense, np.arange(len(texts)), side="right")
    between = (before > 0) & (after < len(dense))  # dense itself, or with dense lines on both sides
    out = []
    for k, text in enumerate(texts):
        at = block[k]
        if bad[k] or weak[k] and not (near[k] and (page.tag[at] in HEADINGS or own[k] > least)):
            continue
        held = inside[at] and (page.tag[bound] not in WHOLE or near[k] and (between[k] or page.tag[at] in HEADINGS)) or page.tag[at] in TEXTS and at and page.parent[at] in beside
        if not held and not (region[k] and ratio[k] > least >= 0):
            continue  # outside, a line must be dense by itself
        if not region[k] and linked[k] > 0.5 * size[k] and not (near[k] or page.tag[at] in HEADINGS):
            continue
        out.append(text)
    return out


def main_text(html: Column) -> Column:
    """The article of a column of pages: blocks joined by line ends, white space inside a block made one space.

    A null or empty page, and one without text, gives an empty string. Pages are independent rows, so repeated rows
    and other columns change nothing; markup that is cut off or wrongly nested is read as far as it goes.
    """

    def extracted(pages: pa.Array) -> pa.Array:
        return pa.array(["\n".join(main_blocks(x)) if x else "" for x in pages.to_pylist()], pa.string())

    return F.arrow_udf(extracted, "string")(html)
