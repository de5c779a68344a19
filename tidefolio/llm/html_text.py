"""HTML extraction: the main text of a page by two-pass block rules.

A scan over the markup cuts a page into blocks: text between block-level tags, with white space turned into one space and
character references decoded. Per block it notes the number of letters-only words, how many of them are stop words, how
many characters stand inside links, and where the block stands: in boilerplate (menus, headers and footers of the page,
sidebars, notices, adverts, forms, reader comments, by element name, role, or class and id words), inside the article
(``article`` or a body named as one; else ``main``), or elsewhere.

First pass. Boilerplate is dropped, and so is what lies outside the article where a page has one. Of the rest a block is
bad if most of it is links, good if it is long or dense enough in stop words, bad if it is long, stands outside any article
and has hardly a stop word, and undecided otherwise: short ones mostly, such as titles, single words, numbers. Second pass.
An undecided block takes the label of the nearest decided one, before or after it, in the same part of the page; at equal
distances good wins; without a decided one it is good. Inside an article, where the author's markup already says that text
is main text, only blocks made of several links can be bad. Good blocks in page order, joined by one line feed, are the text.

Defined cases: null and empty html give the empty text; a page cut off anywhere ends there, an open comment, script or tag
runs to its end; end tags without a start are passed over; unknown references stay as written; a page of any length is read
in one pass; rows that repeat give the same text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# HTML element names by role.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
RAW = set("script style textarea title noscript iframe template svg select object canvas".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead"
    " tr ul head".split()
)
BOILER_TAGS = set("nav footer aside form menu dialog button head".split())
BOILER_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: An element that starts closes these open ones up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
# Words of class and id attributes that name boilerplate, and those that name an article's body.
BOILER_WORDS = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments disqus cookie cookies"
    " consent gdpr notice notices footer masthead menu nav navbar navigation newsletter pagination pager popup modal promo"
    " promotion related recommended recommendations replies reply share sharing social sidebar sponsor sponsored subscribe"
    " subscription teaser toolbar widget copyright login signup".split()
)
NEGATIONS = set("no not has with without".split())
HEADERS = set("header topbar".split())
BODY_NAMES = set("articlebody entry-content post-content post-body article-body article-content story-body".split())
# Stop words of the languages at hand.
STOP_WORDS = frozenset(
    "the of and to in a is that for it as was with be by on not this are or from at an have which but they"
    " der die und den das von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach"
    " le la les des du un une et est que qui dans pour pas sur avec au par plus ne se ce il sont ou elle son"
    " el los las del y en que por con para una no su al lo como más pero sus este ser ha muy sin sobre".split()
)

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)|(?<=\s)(hidden)(?=[\s/]|$)""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
LETTERS = re.compile(r"[^\W\d_]+")

LONG_WORDS = 30
STOP_GOOD = 0.3
STOP_LOW = 0.1
SHORT_CHARS = 70
LINKED = 0.5
ARTICLE, MAIN, OTHER, BOILER = 3, 2, 1, 0


@dataclass
class Block:
    text: str
    place: int
    linked: float
    links: int

    def label(self) -> bool | None:
        """True for main text, False for boilerplate, None if undecided."""
        words = LETTERS.findall(self.text.lower())
        stops = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        if self.linked > LINKED and (self.links > 1 or self.place == OTHER):
            return False
        if stops >= STOP_GOOD and len(self.text) >= SHORT_CHARS:
            return True
        if self.place > OTHER:
            return True if len(words) >= LONG_WORDS else None
        if len(self.text) >= SHORT_CHARS and stops < STOP_LOW:
            return False
        return True if len(words) >= LONG_WORDS else None


def _attributes(raw: str) -> dict[str, str]:
    found = {}
    for name, value, alone in ATTRIBUTE.findall(raw):
        found.setdefault((name or alone).lower(), unescape(value.strip("\"'")))
    return found


def _place(tag: str, raw: str, outer: int) -> int:
    """Where the text of an element stands, given where the element itself does."""
    if outer == BOILER or tag in BOILER_TAGS:
        return BOILER
    known = _attributes(raw) if "=" in raw or "hidden" in raw else {}
    if known.get("role", "").lower() in BOILER_ROLES or "hidden" in known or known.get("aria-hidden") == "true":
        return BOILER
    if re.search(r"display\s*:\s*none", known.get("style", ""), re.I):
        return BOILER
    named = f"{known.get('class', '')} {known.get('id', '')}"
    if tag not in ("html", "body", "main"):
        for name in named.split():
            words = {w.lower() for w in NAME_WORD.findall(name)}
            if words & BOILER_WORDS and not words & NEGATIONS:
                return BOILER
            if outer < ARTICLE and words & HEADERS and not words & {"article", "entry", "post", "story"}:
                return BOILER
    if tag == "header" and outer < ARTICLE:
        return BOILER
    bodies = {x.lower() for x in named.split()} | {known.get("itemprop", "").lower()}
    if tag == "article" or bodies & BODY_NAMES:
        return ARTICLE
    if tag == "main" or known.get("role", "").lower() == "main":
        return max(outer, MAIN)
    return outer


class _Page:
    """The open elements and the block that is being read."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.open: list[tuple[str, int]] = []
        self.parts: list[str] = []
        self.anchored: list[str] = []
        self.links = 0
        self.depth = 0  # open links
        self.breaks = 0

    @property
    def place(self) -> int:
        return self.open[-1][1] if self.open else OTHER

    def text(self, raw: str) -> None:
        if not raw or self.place == BOILER:
            return
        self.parts.append(raw)
        if not raw.isspace():
            self.breaks = 0
        if self.depth:
            self.anchored.append(raw)

    def end_block(self) -> None:
        text = " ".join(unescape("".join(self.parts)).split())
        if text:
            linked = len(" ".join(unescape("".join(self.anchored)).split())) / len(text)
            self.blocks.append(Block(text, self.place, linked, self.links))
        self.parts, self.anchored, self.links, self.breaks = [], [], int(self.depth > 0), 0

    def pop_to(self, at: int) -> None:
        if any(self.open[k][0] in BLOCK or self.open[k][1] != self.place for k in range(at, len(self.open))) or (
            at and self.open[at - 1][1] != self.place
        ):
            self.end_block()
        self.depth -= sum(name == "a" for name, _ in self.open[at:])
        del self.open[at:]

    def close(self, names: set[str], walls: set[str]) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] in names:
                return self.pop_to(at)
            if self.open[at][0] in walls:
                return None

    def start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self.breaks += 1
            if self.breaks == 2:
                self.end_block()
            else:
                self.text(" ") if self.breaks == 1 else None
            return
        if tag in BLOCK:
            self.close({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            self.close(*CLOSES[tag])
        if tag == "a":
            self.close({"a"}, BLOCK)
        place = _place(tag, raw, self.place)
        if tag in BLOCK or place != self.place:
            self.end_block()
        if tag in VOID or raw.endswith("/") and tag not in BLOCK:
            return
        self.open.append((tag, place))
        if tag == "a":
            self.depth += 1
            self.links += 1

    def end(self, tag: str) -> None:
        self.close({tag}, set() if tag in BLOCK else BLOCK)


def read_blocks(html: str) -> list[Block]:
    """The blocks of a page that do not stand in boilerplate, in page order."""
    page, at, size = _Page(), 0, len(html)
    last = html.rfind(">")
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            page.text(html[at:])
            break
        page.text(html[at:mark])
        kind = html[mark + 1 : mark + 2]
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = size if end < 0 else end + 3
        elif kind in ("!", "?") or kind == "/" and not html[mark + 2 : mark + 3].isalpha():
            end = html.find(">", mark)
            at = size if end < 0 else end + 1
        elif kind == "/" or (kind.isascii() and kind.isalpha()):
            if mark > last:  # cut off inside a tag
                break
            found = TAG.match(html, mark)
            # An open quote: the tag ends at the next bracket.
            at = found.end() if found else html.index(">", mark) + 1
            closing = kind == "/"
            tag = (found[2] if found else html[mark + 1 + closing : at - 1].split()[0]).lower()
            if closing:
                page.end(tag)
            elif tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                at = size if end is None else (html.find(">", end.end()) + 1 or size)
            else:
                page.start(tag, found[3] if found else "")
        else:
            page.text("<")
            at = mark + 1
    page.end_block()
    return page.blocks


def main_text(html: str | None) -> str:
    """The main text of one page."""
    blocks = read_blocks(html or "")
    best = max((b.place for b in blocks), default=OTHER)
    kept = [b for b in blocks if b.place == best]
    labels = [b.label() for b in kept]
    after: list[tuple[int, bool] | None] = [None] * len(kept)
    near = None
    for k in range(len(kept) - 1, -1, -1):
        near = (k, labels[k]) if labels[k] is not None else near
        after[k] = near
    before, out = None, []
    for k, block in enumerate(kept):
        before = (k, labels[k]) if labels[k] is not None else before
        sides = [(abs(x[0] - k), not x[1]) for x in (before, after[k]) if x is not None]
        if not sides or not min(sides)[1]:
            out.append(block.text)
    return "\n".join(out)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``, its number of code points: a row per page, without a shuffle."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keep).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Few pages at a time as Python objects, whatever their length.
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py()) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[*keep, "text", "n_chars"],
                )

    return pages.select(*keep, html).mapInArrow(run, f"{schema}, text string, n_chars bigint")
