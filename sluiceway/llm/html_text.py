"""Operator 8: main text of pages by two-pass block rules.

First pass: blocks of a page are decided by their place (menus, footers, forms, ... are never text),
by the share of their characters inside links, and, if long enough, by the density of stop words (by length
alone where no block of the page shows stop words of a known language).
Second pass: blocks that the first leaves open (short, or of middling density) inherit the label of the
nearest decided block of the same region. A region is the inside or the outside of article and main
elements; blocks outside are not text where a page has such an element.

Cases: null and empty pages and pages without text give an empty text; damaged and unclosed markup is
read as far as it goes; in a tie an open block inside an article is text, one outside is not; rows
that repeat an id are all returned; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluiceway.llm.common import table

LONG_WORDS = 10
STOP_LOW, STOP_HIGH = 0.08, 0.2
LINK_DENSITY = 0.5

BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul caption title".split()
)
SILENT = frozenset(
    "script style noscript template textarea select option button svg iframe object canvas head title "
    "audio video map datalist dialog".split()
)
ASIDE = frozenset("nav footer aside form menu fieldset".split())
METADATA = frozenset("html head base link meta title style script noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_WORD = re.compile(
    r"ads?|adverts?|advert\w*|promo\w*|sponsor\w*|banner\w*|cookies?|consent|gdpr|notices?|alerts?|popup|"
    r"modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|footer\w*|masthead|topbar|header|comments?|"
    r"replies|reply|respond|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|subscription|"
    r"signup|login|search|widget\w*|pagination|pager|toolbar|disclaimer|copyright",
    re.IGNORECASE,
)
#: Words that say nothing beside such a word in one name; any other word makes it another name ("has-sidebar").
BESIDE = frozenset(
    "site page global main top bottom left right primary secondary inner outer box bar list links link buttons button "
    "block container wrapper wrap area section form item items panel unit slot text user post my the and".split()
)
ASIDE_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())

STOP_WORDS = frozenset(
    # English, German, French, Spanish
    "the of and to in a is that it for on was with as be by at this are from or an not have but they which you we "
    "der die das und in zu den von mit ist des ein eine nicht auf für sich dem auch als es im werden aus sie "
    "le la les de des et un une en est du que dans pour qui pas sur au plus ne se par avec ce il "
    "el los las y una por con para del se su lo como más o al no sus pero".split()
)


def aside_name(names: str, article: bool) -> bool:
    """Whether a class or id among ``names`` is as a whole one of something aside; a header in an article is not."""
    for name in names.split():
        words = [w for w in re.split(r"[_-]+", name.lower()) if w and not w.isdigit()]
        told = [w for w in words if w not in BESIDE]
        if told and all(ASIDE_WORD.fullmatch(w) for w in told) and not ("header" in told and (article or "post" in words)):
            return True
    return False


class Blocks(HTMLParser):
    """The text blocks of a page, in order: (text, link characters, aside, inside an article).

    While a page is read, aside is the set of containers that may be aside; 0 stands for places that are for certain,
    by their tag. ``place`` decides about the others once the page is known.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, frozenset, bool, bool]] = []  # tag, aside, article, silent
        self.blocks: list[tuple[str, int, frozenset | bool, bool]] = []
        self.containers = 0
        self.with_main: set[int] = set()
        self.parts: list[str] = []
        self.linked = self.in_link = 0
        self.link_at = self.link_depth = 0  # number of blocks and of open elements when the link began

    def _end_link(self, closed: bool) -> None:
        """A link that nobody closes ends with the block in which it began."""
        if self.in_link and not closed and len(self.blocks) > self.link_at:
            at = self.link_at + 1
            self.blocks[at:] = [(text, 0, *rest) for text, _, *rest in self.blocks[at:]]
            self.linked = 0
        self.in_link = 0

    def _end_head(self) -> None:
        """The end tag of head may be missing."""
        self.open = self.open[:next((i for i, e in enumerate(self.open) if e[0] == "head"), len(self.open))]

    def _left(self) -> None:
        if self.in_link and len(self.open) < self.link_depth:
            self._end_link(False)

    def _end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            _, aside, article, _ = self.open[-1] if self.open else ("", frozenset(), False, False)
            self.blocks.append((text, self.linked, aside, article))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag == "body" or tag not in METADATA and self.open and self.open[-1][0] in ("head", "title"):
            self._end_head()
        if tag == "a":
            self._end_link(False)
            if any(name == "href" for name, _ in attrs):
                self.in_link, self.link_at, self.link_depth = 1, len(self.blocks), len(self.open)
        if tag in BLOCKS:
            self._end_block()
            # a new block closes an open paragraph; a list item or cell closes its elder
            closes = {"p"} | ({tag} if tag in ("li", "dt", "dd", "td", "th", "tr", "option") else set())
            while self.open and self.open[-1][0] in closes:
                self.open.pop()
            self._left()
        if tag in VOID or tag not in BLOCKS and tag not in SILENT:
            return
        _, aside, article, silent = self.open[-1] if self.open else ("", frozenset(), False, False)
        named = dict(attrs)
        name = " ".join(v for v in (named.get("class"), named.get("id")) if v)
        style = (named.get("style") or "").replace(" ", "").lower()
        hidden = "hidden" in named or named.get("aria-hidden") == "true" or "display:none" in style
        is_article = tag in ("article", "main") or named.get("role") == "main"
        if tag == "main" or named.get("role") == "main":
            self.with_main |= aside
        if tag not in ("html", "body") and not is_article:
            if tag in ASIDE - {"form", "fieldset"} or tag == "header" and not article:
                aside = aside | {0}
            elif tag in ASIDE or aside_name(name, article) or named.get("role") in ASIDE_ROLE:
                self.containers += 1
                aside = aside | {self.containers}
        self.open.append((tag, aside, article or is_article, silent or tag in SILENT or hidden))

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self._end_link(True)
        if tag in BLOCKS:
            self._end_block()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                break
        self._left()

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][0] == "head" and data.strip():
            self._end_head()
        if self.open and self.open[-1][3]:
            return
        self.parts.append(data)
        if self.in_link:
            self.linked += len("".join(data.split()))

    def close(self) -> None:
        super().close()
        self._end_block()
        self._end_link(False)
        self.place()

    def place(self) -> None:
        """A container is not aside if it holds main or, where no article stands outside, an article or most of the
        page's text."""
        free = set(self.with_main) - {0}
        if not any(article and not aside - free for _, _, aside, article in self.blocks):
            held, total = {}, 0
            for text, linked, aside, article in self.blocks:
                if 0 in aside:
                    continue
                size = max(0, len(text) - text.count(" ") - linked)
                total += size
                for container in aside:
                    held[container] = held.get(container, 0) + size
                    if article:
                        free.add(container)
            free |= {c for c, size in held.items() if 2 * size > total}
        #: whether a container of the block is named as something aside, whatever it holds
        self.named = [bool(aside) for _, _, aside, _ in self.blocks]
        self.blocks = [(text, linked, bool(aside - free), article) for text, linked, aside, article in self.blocks]


EDGES = re.compile(r"^\W+|\W+$")


#: Scripts that write words without spaces; one character is worth several letters.
DENSE = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
LONG_LETTERS = 50


def stop_density(words: list[str]) -> float:
    return sum(EDGES.sub("", w) in STOP_WORDS for w in words) / len(words)


def first_pass(text: str, linked: int, aside: bool, article: bool, known: bool = True) -> str:
    """good, bad or open; in a language that is not ``known`` by length instead of stop words"""
    letters = len(text) - text.count(" ")
    if aside:
        return "bad"
    # an article may list its sources and name its owner
    if not article and (linked > LINK_DENSITY * letters or text.startswith("©")):
        return "bad"
    if not known:
        return "good" if letters + 2 * len(DENSE.findall(text)) >= LONG_LETTERS else "open"
    words = text.lower().split()
    if len(words) < LONG_WORDS:
        return "open"
    density = stop_density(words)
    if density >= STOP_HIGH:
        return "good"
    return "bad" if density < STOP_LOW and not article else "open"


def second_pass(labels: list[str], article: bool) -> list[bool]:
    """Which blocks of one region are text; open blocks take after the nearest decided one."""
    far = len(labels) + 1
    before, after, last = [], [None] * len(labels), (far, "")
    for label in labels:
        before.append(last)
        last = (1, label) if label != "open" else (last[0] + 1 if last[1] else far, last[1])
    last = (far, "")
    for i in range(len(labels) - 1, -1, -1):
        after[i] = last
        last = (1, labels[i]) if labels[i] != "open" else (last[0] + 1 if last[1] else far, last[1])
    out = []
    for label, (d0, l0), (d1, l1) in zip(labels, before, after):
        if label == "open":
            label = l0 if d0 < d1 else l1 if d1 < d0 else l0 if l0 == l1 else ""
        out.append(label == "good" or label == "" and article)
    return out


def main_text(html: str | None) -> str:
    page = Blocks()
    page.feed(html or "")
    page.close()
    has_article = any(article and not aside for _, _, aside, article in page.blocks)
    long = (b[0].lower().split() for b in page.blocks if not b[2])
    known = any(len(words) >= LONG_WORDS and stop_density(words) >= STOP_LOW for words in long)
    found: dict[bool, list[int]] = {}
    for region in (True, False):
        # what stands aside is decided by its place and says nothing of its neighbours
        at = [i for i, (_, _, aside, article) in enumerate(page.blocks) if article == region and not aside]
        kept = second_pass([first_pass(*page.blocks[i], known) for i in at], region)
        found[region] = [i for i, keep in zip(at, kept) if keep]

    def size(region: bool) -> int:
        return sum(len(page.blocks[i][0]) for i in found[region])

    # the region that holds most of the text, so that a teaser marked as an article does not hide the text beside it
    chosen = found[has_article and size(True) >= size(False)]
    if not chosen:
        # a page of short blocks alone: nothing was decided, so all that does not stand aside is text
        chosen = [
            i for i, block in enumerate(page.blocks) if not page.named[i] and first_pass(*block, known) == "open"
        ]
    return "\n".join(page.blocks[i][0] for i in chosen)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    schema = pages.select("page_id", "url").schema.add("text", "string").add("n_chars", "long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    return pages.select("page_id", "url", F.col("html")).mapInArrow(read, schema)


def op8_block_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_block_text": op8_block_text}
ORACLES: dict[str, str] = {}
