"""Main text of web pages by tag-path ratios.

A page is scanned into blocks: runs of text between block-level tags, each with its root-to-leaf path of block-level
tags. Text length (a linked letter counts a tenth) and punctuation are summed per path and divided by the path's blocks;
the two ratios are smoothed over neighbouring blocks, fused by product, weighted by what the path's tags and names say
(an article four times, a menu not at all), and thresholded. Every block of a selected path is content, wherever it
stands. The element that holds most of the selected text, and articles or main elements with selected text, hand their
score on to the other blocks in them, weighted the same way and less for links, so short paragraphs stay.

A page is read once from front to back, whatever its tags; paths are numbers and elements hold their parents, so time
and memory grow in proportion to the page.

Defined results: a null or empty page, or one without content, has an empty text; an unclosed tag, comment or
script runs to the end of the page; boilerplate inside a line of text goes, and the line stays one block; repeated rows
get equal results; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow

#: HTML's void elements, those whose text is never shown, and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template textarea title svg math iframe object canvas audio video select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
BOILERPLATE_TAGS = frozenset("aside button dialog fieldset footer form head header label legend menu nav search".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog navigation search".split())
#: Words in a class or id that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer form masthead menu nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion replies responses share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: ``related`` names boilerplate alone or before one of these; ``related-work`` is a section like any other.
RELATED = frozenset("articles box content items links list news pages posts products reading stories topics videos".split())
#: What opening a tag closes: the open element and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements that are too small to hold a page's main text.
SMALL = frozenset("p li td th tr h1 h2 h3 h4 h5 h6 blockquote pre".split())
PUNCTUATION = re.compile(r"[.,;:!?。、，！？]")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A tag's inside up to its end. Quotes count after an equals sign only; nothing is tried twice, so a page is read once.
NAME = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*+)")
INSIDE = re.compile(r"(?:[^<>\"'=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?|[\"'])*+")
SILENT_INSIDE = re.compile(r"(?:[^>\"'=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?|[\"'])*+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*+>?", re.I) for tag in SILENT}
ATTRIBUTE = re.compile(r"(class|id|role|style|aria-hidden|hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+(?=[\s/]|\Z)", re.I)
HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SMOOTH = (0.25, 0.5, 0.25)
#: Share of a linked letter against a plain one; what an article's, another and a boilerplate element's ratio counts for.
LINKED = 0.1
CONTENT, PLAIN, BOILERPLATE = 4.0, 1.0, 0.0
THRESHOLD = 0.2
#: Share of the selected text that the element which holds the main text has in it.
HOLDS = 0.75


@dataclass(slots=True)
class Element:
    tag: str
    path: int
    number: int
    parent: Element | None
    weight: float
    article: Element | None  # the nearest article or main element around
    inline: bool = False  # boilerplate inside a line of text: its own text goes, the line stays one block


@dataclass(slots=True)
class Block:
    element: Element
    text: str
    linked: int


def _named(rest: str) -> tuple[bool, bool]:
    """Whether the attributes name boilerplate, and whether they hide the element."""
    bad = hidden = False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        value, name = (a or b or c), name.lower()
        if name in ("class", "id"):
            for token in value.split():
                words = [w.lower() for w in WORDS.findall(token)]
                bad |= any(w in NAMES for w in words) or words[:1] == ["related"] and (len(words) == 1 or words[1] in RELATED)
        elif name == "role":
            bad |= value.lower() in ROLES
        elif name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        else:
            hidden |= HIDES.search(value) is not None
    return bad, hidden


class _Page:
    """Scans one page, front to back, into elements and blocks."""

    def __init__(self, page: str):
        root = Element("", 0, 0, None, PLAIN, None)
        self.elements, self.open, self.blocks = [root], [root], []
        self.at: dict[str, list[int]] = defaultdict(list)  # places of each tag among the open elements
        self.paths: dict[tuple[int, str], int] = {}
        self.pieces: list[str] = []
        self.linked, self.link, self.muted = 0, False, 0
        self._scan(page)
        self._end()

    def _end(self) -> None:
        text = " ".join("".join(self.pieces).split())
        if text:
            owner = self.open[-1]
            while owner.inline:
                owner = owner.parent
            self.blocks.append(Block(owner, text, self.linked))
        self.pieces.clear()
        self.linked = 0

    def _say(self, raw: str) -> None:
        if raw and not self.muted:
            text = entities.unescape(raw)
            self.pieces.append(text)
            if self.link:
                self.linked += len(text)

    def _open(self, tag: str, weight: float, inline: bool = False) -> None:
        above = self.open[-1]
        path = self.paths.setdefault((above.path, tag), len(self.paths) + 1)
        made = Element(tag, path, len(self.elements), above, min(weight, above.weight) if above.weight == BOILERPLATE or weight == BOILERPLATE else weight, above.article, inline)
        if tag in ("article", "main"):
            made.article = made
        if made.article is not None and made.weight != BOILERPLATE:
            made.weight = CONTENT
        self.elements.append(made)
        self.at[tag].append(len(self.open))
        self.open.append(made)
        self.muted += inline

    def _close(self, place: int) -> None:
        """Closes the open elements from a place on."""
        while len(self.open) > place:
            gone = self.open.pop()
            self.at[gone.tag].pop()
            self.muted -= gone.inline

    def _scan(self, page: str) -> None:
        at, n = 0, len(page)
        while at < n:
            sign = page.find("<", at)
            if sign < 0:
                self._say(page[at:])
                return
            name = NAME.match(page, sign)
            if name is None:
                if page.startswith("<!--", sign):
                    self._say(page[at:sign])
                    end = page.find("-->", sign + 4)
                    at = n if end < 0 else end + 3
                elif page[sign + 1 : sign + 2] in ("!", "?", "/"):
                    self._say(page[at:sign])
                    end = page.find(">", sign)
                    at = n if end < 0 else end + 1
                else:
                    self._say(page[at : sign + 1])
                    at = sign + 1
                continue
            self._say(page[at:sign])
            tag, closing = name[1].lower(), page[sign + 1] == "/"
            silent = tag in SILENT and not closing
            end = (SILENT_INSIDE if silent else INSIDE).match(page, name.end()).end()
            if end >= n:  # the tag never ends
                return
            if page[end] == "<":  # no tag after all
                self._say(page[sign:end])
                at = end
                continue
            at = end + 1
            rest = page[name.end() : end]
            if silent:
                if not rest.endswith("/") or tag not in ("svg", "math"):
                    over = ENDS[tag].search(page, at)
                    at = n if over is None else over.end()
            elif closing:
                self._closing(tag)
            else:
                self._opening(tag, rest)

    def _closing(self, tag: str) -> None:
        if tag == "a":
            self.link = False
            return
        places = self.at.get(tag)
        if tag in BLOCK:
            self._end()
            self.link = False
        if places:
            self._close(places[-1])

    def _opening(self, tag: str, rest: str) -> None:
        if tag == "br":
            self._say(" ")
            return
        if tag == "a":
            self.link = True
            return
        named, hidden = _named(rest) if rest else (False, False)
        if tag not in BLOCK:
            if tag not in VOID and (named or hidden or tag in BOILERPLATE_TAGS) and not rest.endswith("/"):
                self._open(tag, BOILERPLATE, inline=True)
            elif self.muted and tag not in VOID and self.at.get(tag):
                self._open(tag, BOILERPLATE, inline=True)  # so that its end isn't taken for the outer one's
            return
        self._end()
        self.link = False
        if tag in VOID:
            return
        if self.open[-1].tag == "p":
            self._close(len(self.open) - 1)
        shut, stop = CLOSES.get(tag, ((), ()))
        last = max((self.at[t][-1] for t in shut if self.at.get(t)), default=0)
        if last and last > max((self.at[t][-1] for t in stop if self.at.get(t)), default=0):
            # the outermost of those that the stop leaves open
            wall = max((self.at[t][-1] for t in stop if self.at.get(t)), default=0)
            self._close(min(p for t in shut for p in self.at.get(t, ())[-2:] if p > wall))
        above = self.open[-1]
        bad = tag in BOILERPLATE_TAGS and not (tag == "header" and above.article is not None) or named and tag not in ("html", "body", "article", "main") or hidden
        bad |= named and tag == "article" and above.article is not None and above.article.tag == "article"  # a comment or teaser inside an article
        self._open(tag, BOILERPLATE if bad else PLAIN)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order."""
    return _Page(page).blocks


def scores(found: list[Block]) -> dict[int, float]:
    """Smoothed and fused ratio of each path, weighted by what its elements are."""
    length, marks, count, weight = defaultdict(float), defaultdict(float), defaultdict(int), defaultdict(float)
    for b in found:
        path = b.element.path
        count[path] += 1
        weight[path] = max(weight[path], b.element.weight)
        if b.element.weight:
            length[path] += len(b.text) - (1 - LINKED) * min(b.linked, len(b.text))
            marks[path] += len(PUNCTUATION.findall(b.text))
    ratios = [(length[b.element.path] / count[b.element.path], marks[b.element.path] / count[b.element.path]) for b in found]
    smooth: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0])
    last = len(found) - 1
    for i, b in enumerate(found):
        for k in (0, 1):
            near = SMOOTH[0] * ratios[max(i - 1, 0)][k] + SMOOTH[1] * ratios[i][k] + SMOOTH[2] * ratios[min(i + 1, last)][k]
            smooth[b.element.path][k] += near / count[b.element.path]
    return {p: weight[p] * math.sqrt(t * (1 + m)) for p, (t, m) in smooth.items()}


def main_text(page: str | None) -> str:
    """The main text of one page: its content blocks, joined by empty lines."""
    read = _Page(page or "")
    found, elements = read.blocks, read.elements
    score = scores(found)
    top = max(score.values(), default=0.0)
    if not top:
        return ""
    least = THRESHOLD * top
    chosen = [bool(b.element.weight) and score[b.element.path] >= least for b in found]
    # elements are numbered in page order, parents first: sums go up in reverse order, what is held goes down in order
    held = [0] * len(elements)
    for b, picked in zip(found, chosen, strict=True):
        held[b.element.number] += len(b.text) if picked else 0
    total = sum(held)
    for e in reversed(elements[1:]):
        held[e.parent.number] += held[e.number]
    holder = max(e.number for e in elements if held[e.number] >= HOLDS * total and e.tag not in SMALL)
    holders = {holder, *(e.article.number for e in (elements[holder], *(b.element for b, picked in zip(found, chosen, strict=True) if picked)) if e.article is not None)}
    inside = [False] * len(elements)
    for e in elements:
        inside[e.number] = e.number in holders or e.parent is not None and inside[e.parent.number]
    kept = []
    for b, picked in zip(found, chosen, strict=True):
        # a block in what holds the main text shares the holder's score, less for links
        share = inside[b.element.number] * b.element.weight * (1 if b.element.article is not None else 1 - b.linked / len(b.text))
        if picked or share >= 2 * THRESHOLD:
            kept.append(b.text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page id, url, text and n_chars of every page."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    found = map_arrow(pages.select(f"`{id_col}`", f"`{url_col}`", f"`{html_col}`"), run, f"id {kind}, url string, text string, n_chars long")
    return found.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
