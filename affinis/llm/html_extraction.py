"""Main text of web pages by scoring the element tree.

A page is read into its elements and its blocks: runs of text between the
boundaries of block elements, white space collapsed. Elements that cannot hold
article text are left out with all below them: scripts and forms by their tag,
menus, sidebars, notices, adverts and comments by their tag, role or class
name. Every other block passes points, for itself, its commas and its length,
to the element around it, half of them to the next one up, and ever smaller
shares above. Points are discounted by link density, the share of link
characters. The best element is the container of the article; siblings that
score well beside it, or read as prose, are kept with it. Lists and divisions
inside that are mostly links are menus and go.

Pages are independent: no shuffle, and a task holds a bounded slice of pages,
or one longer page, at a time. The tree is at most ``DEPTH`` levels deep, as in
browsers; deeper elements count as part of the level above and lose no text.

Defined cases: null and empty html give an empty text, as do pages without
article text; html without tags is one block; a page that ends inside a tag, a
comment or a script ends there; equal rows give equal rows; an input column
named like an output column is replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from affinis.llm.frames import without_clashes
from affinis.llm.text import bounded

DEPTH = 512

# HTML's elements by what they do to text.
BLOCKS = frozenset(
    "html head body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
#: What never shows as article text, whatever stands around it.
UNSEEN = frozenset("head script style title textarea xmp iframe noembed noframes noscript template svg math object audio video canvas select datalist button dialog".split())
#: Block elements with a place of their own beside the article.
ASIDE = frozenset("nav aside footer form menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip".split())
#: Class and id words of such places.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification"
    " popup modal overlay newsletter subscribe subscription signup login sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs pagination"
    " pager toolbar footer masthead comment comments disqus reply replies respond share sharing social related recommended recommendations widget search skip".split()
)
#: Words that say something about a page or its topics, not about the element's place.
ABOUT = frozenset("has no with without is not category tag topic format single".split())
STATES = frozenset("open closed enabled disabled on off count".split())
GOOD = frozenset("article content post entry story main body text".split())

# Elements closed by a start tag, and those that shield others from it.
CLOSES_P = BLOCKS - {"html", "head", "body", "caption", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"}
SCOPE = frozenset("table td th caption html template object".split())
CLOSED_BY = (
    {tag: (frozenset({"p"}), SCOPE | {"button"}) for tag in CLOSES_P}
    | {"dd": (frozenset({"dd", "dt", "p"}), SCOPE | {"dl"}), "dt": (frozenset({"dd", "dt", "p"}), SCOPE | {"dl"})}
    | {"li": (frozenset({"li", "p"}), SCOPE | {"ul", "ol", "menu", "dir"})}
    | {tag: (frozenset({"td", "th"}), frozenset({"table", "tr"})) for tag in ("td", "th")}
    | {tag: (frozenset({"td", "th", "tr"}), frozenset({"table"})) for tag in ("tr", "tbody", "thead", "tfoot")}
    | {"option": (frozenset({"option"}), frozenset({"select"})), "a": (frozenset({"a"}), SCOPE)}
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TOKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
MARKUP = re.compile(r"<!--(?:-?>|.*?--!?>)|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"([^\s=>/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TOLD = frozenset(("class", "id", "role", "hidden", "aria-hidden", "style", "itemprop"))

# Weights of the score.
BLOCK_POINTS, LEAST_LENGTH, LENGTH_UNIT, MOST_LENGTH_POINTS = 1.0, 25, 100.0, 3.0
ARTICLE_POINTS, NAME_POINTS, LIST_POINTS = 25.0, 25.0, -3.0
SIBLING_SHARE, SIBLING_LEAST = 0.2, 10.0
PROSE_LENGTH, PROSE_LINKS, MENU_LINKS = 80, 0.25, 0.5


class Element:
    __slots__ = ("parent", "tag", "block", "gone", "unseen", "good", "in_article", "points", "chars", "links", "prose")

    def __init__(self, tag: str, parent: Element | None, attributes: dict[str, str]):
        self.tag, self.parent = tag, parent
        self.block = self if parent is None or tag in BLOCKS else parent.block
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))
        self.gone, self.good = _place(tag, attributes, self.in_article) if attributes else (tag in ASIDE or tag == "header" and not self.in_article, False)
        self.unseen = tag in UNSEEN or parent is not None and parent.unseen or self.gone and tag not in BLOCKS
        self.points, self.chars, self.links, self.prose = 0.0, 0, 0, False


def _attributes(source: str) -> dict[str, str]:
    """The attributes that tell an element's place; of repeated ones the first."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        if (name := name.lower()) in TOLD:
            found.setdefault(name, html.unescape(values[0] or values[1] or values[2]))
    return found


def _place(tag: str, attributes: dict[str, str], in_article: bool) -> tuple[bool, bool]:
    """(stands beside the article, is named like an article) of an element with attributes."""
    if tag in ("html", "body"):
        return False, False
    role = attributes.get("role", "").strip().lower()
    aside = tag in ASIDE or tag == "header" and not in_article or role in ROLES
    aside |= "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attributes.get("style", "")))
    article = tag in ("article", "main")
    good = article or role == "main" or "articlebody" in attributes.get("itemprop", "").lower()
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [word.lower() for word in WORD.findall(name)]
        if not words or words[0] in ABOUT or words[-1] in STATES:
            continue
        named = words[0] in NAMES or words[-1] in NAMES
        if words[-1] == "header" and not in_article and not GOOD.intersection(words):
            named = True
        # An article is left out only for what its name says as a whole, or as a comment or advert.
        aside |= named and (not article or len(words) == 1 or words[0] in ("comment", "ad", "related", "sponsored"))
        good |= not named and (words[0] in GOOD or words[-1] in GOOD)
    return aside, good and not aside


class Page:
    """Elements in page order, and blocks as (element, text, link characters)."""

    def __init__(self, source: str):
        self.root = Element("html", None, {})
        self.elements, self.blocks = [self.root], []
        self._stack, self._run, self._link = [self.root], [], 0
        self._open: dict[str, int] = {"html": 1}
        self._read(source)
        self._end_block()

    def _end_block(self) -> None:
        if not self._run:
            return
        text = " ".join("".join(self._run).split())
        if text:
            self.blocks.append((self._stack[-1].block, text, min(self._link, len(text))))
        self._run, self._link = [], 0

    def _text(self, text: str) -> None:
        if not text or self._stack[-1].unseen:
            return
        text = html.unescape(text) if "&" in text else text
        self._run.append(text)
        if self._open.get("a"):
            self._link += len(" ".join(text.split()))

    def _pop(self) -> None:
        gone = self._stack.pop()
        self._open[gone.tag] -= 1

    def _close(self, tags: frozenset[str], barrier: frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` that no barrier shields, and all inside it."""
        if not any(self._open.get(tag) for tag in tags):
            return
        found = None
        for at in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[at].tag
            if tag in tags:
                found = at
            elif tag in barrier:
                break
        while found is not None and len(self._stack) > found:
            self._pop()

    def _start(self, tag: str, source: str) -> None:
        if tag in BLOCKS:
            self._end_block()
        if tag in CLOSED_BY:
            self._close(*CLOSED_BY[tag])
        if tag in HEADINGS and self._stack[-1].tag in HEADINGS:
            self._pop()
        if tag == "br":
            self._text(" ")
        if tag in VOID or tag in ("html", "body") and self._open.get(tag):
            return
        attributes = _attributes(source) if "=" in source or "hidden" in source else {}
        element = Element(tag, self._stack[-1], attributes)
        if len(self._stack) < DEPTH:
            self.elements.append(element)
            self._stack.append(element)
            self._open[tag] = self._open.get(tag, 0) + 1

    def _finish(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
        block = tag in BLOCKS
        if block or tag in ("html", "body"):
            self._end_block()
        if tag in ("html", "body") or not self._open.get(tag):
            return
        shield = frozenset({"table"}) if tag in SCOPE or tag in ("tr", "tbody", "thead", "tfoot") else SCOPE
        crossed = False
        for at in range(len(self._stack) - 1, 0, -1):
            own = self._stack[at].tag
            if own == tag:
                if crossed and not block:
                    # A misplaced end tag ends its inline element, not the blocks opened inside it.
                    del self._stack[at]
                    self._open[tag] -= 1
                else:
                    while len(self._stack) > at:
                        self._pop()
                return
            if own in shield:
                return
            crossed |= own in BLOCKS

    def _read(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            mark = source.find("<", at)
            if mark < 0:
                self._text(source[at:])
                return
            if mark > at:
                self._text(source[at:mark])
            token = TOKEN.match(source, mark)
            if token is None:
                following = source[mark + 1 : mark + 2]
                if not (following in ("!", "?", "/") or following.isascii() and following.isalpha()):
                    self._text("<")
                    at = mark + 1
                    continue
                token = MARKUP.match(source, mark)
                if token is None:
                    return
                at = token.end()
                continue
            at, tag = token.end(), token[2].lower()
            if token[1]:
                self._finish(tag)
                continue
            self._start(tag, token[3])
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                at = close.end() if close else end
                if self._stack[-1].tag == tag:
                    self._pop()


def _density(element: Element) -> float:
    return element.links / element.chars if element.chars else 0.0


def _within(element: Element | None, tops: set[int]) -> bool:
    while element is not None:
        if id(element) in tops:
            return True
        element = element.parent
    return False


def main_text(source: str | None) -> str:
    """The article of one page, a block a line."""
    if not source:
        return ""
    page = Page(source)
    # A form around an article is the page's frame, not a form to fill in.
    framing = {id(up) for element in page.elements if element.tag in ("article", "main") for up in _ancestors(element) if up.tag == "form"}
    for element in page.elements[1:]:
        if id(element) in framing:
            element.gone = False
        element.gone |= element.parent.gone
    blocks = [block for block in page.blocks if not block[0].gone]
    if not blocks:
        return ""

    scored: list[Element] = []
    for element, text, links in blocks:
        element.prose |= element.tag == "p"
        points = min(len(text) / LENGTH_UNIT, MOST_LENGTH_POINTS)
        if len(text) >= LEAST_LENGTH:
            points += BLOCK_POINTS + text.count(",") + text.count("、") + text.count("，")
        points = 0.0 if element.tag in HEADINGS else points
        # Text that stands in a division beside other elements counts as a paragraph of it.
        level, up = 0, element.parent if element.tag in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt") or element.tag in HEADINGS else element
        above = element
        while above is not None:
            above.chars += len(text)
            above.links += links
            above = above.parent
        while up is not None:
            if up.block is up:
                if up.points == 0.0:
                    scored.append(up)
                    up.points = _base(up)
                up.points += points / (1, 2)[level] if level < 2 else points / (3 * level)
                level += 1
            up = up.parent

    def score(element: Element) -> float:
        return element.points * (1.0 - _density(element))

    # Of equal scores the first in page order, which is the outer one.
    order = {id(element): at for at, element in enumerate(page.elements)}
    best = max(scored, key=lambda element: (score(element), -order[id(element)]))
    for up in [best, *_ancestors(best)]:
        if up.tag == "article" or up.tag == "main" and best.tag != "article":
            best = up
    whole = best.tag in ("article", "main")
    tops, least = {id(best)}, max(SIBLING_LEAST, SIBLING_SHARE * score(best))
    lengths = {}
    for element, text, _ in blocks:
        lengths[id(element)] = text
    for element in page.elements:
        if best.parent is None or element.parent is not best.parent or element is best or element.gone or element.unseen or not element.chars:
            continue
        text, density = lengths.get(id(element), ""), _density(element)
        prose = element.prose and (len(text) > PROSE_LENGTH and density < PROSE_LINKS or density == 0.0 and text.endswith((".", "!", "?", "…")))
        heading = element.tag in ("h1", "h2") and density == 0.0 and order[id(element)] < order[id(best)]
        if score(element) >= least or not whole and (prose or heading):
            tops.add(id(element))
    menus = {id(element) for element in page.elements if element.tag in ("ul", "ol", "dl", "table", "div", "section") and element is not best and element.chars and _density(element) > MENU_LINKS}
    return "\n".join(text for element, text, _ in blocks if _within(element, tops) and not _within(element, menus))


def _ancestors(element: Element) -> Iterator[Element]:
    while element.parent is not None:
        element = element.parent
        yield element


def _base(element: Element) -> float:
    points = ARTICLE_POINTS if element.tag in ("article", "main") else LIST_POINTS if element.tag in ("ul", "ol", "dl", "table", "address") else 0.0
    return points + (NAME_POINTS if element.good else 0.0) + 1e-9


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (html, any other columns) with ``text`` and ``n_chars``, its code points, in place of html."""
    rows = without_clashes(pages, ("html",), ("text", "n_chars"))
    kept = [name for name in rows.columns if name != "html"]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, 0):
            texts = [main_text(source) for source in batch.column(0).to_pylist()]
            made = [pa.array(texts, pa.string()), pa.array([len(text) for text in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *made], names=[*kept, "text", "n_chars"])

    fields = [rows.schema[name] for name in kept]
    return rows.mapInArrow(extract, StructType([*fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
