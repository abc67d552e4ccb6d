"""Main text of web pages: block rules in two passes."""

from __future__ import annotations

import html as references
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from voltide.llm.blocks import text_blocks
from voltide.llm.quality import STOP_WORDS

# Element names and the words of class, id and role that mark parts of a page.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED_TAGS = frozenset("script style noscript template iframe svg math object head title select button textarea canvas audio video".split())
BOILER_TAGS = frozenset("nav aside footer dialog menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "aside footer comment comments respond reply replies disqus cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe "
    "subscription share sharing social related recommended widget login signup search pagination pager toolbar contentinfo complementary dialog "
    "hidden rightbar leftbar".split())
# Words that name a part's place or make beside a word of BOILER_WORDS, as in site-footer (but not has-sidebar).
PLACE_WORDS = frozenset(
    "site page main global top bottom left right primary secondary inner outer container wrapper wrap box block list item items area section region "
    "column col content body bar slot unit link links button buttons form text title header heading post posts icon icons group inline".split())
HEADER_WORDS = frozenset("header masthead topbar".split())

# Quantifiers don't give back what they took, and a tag that is cut off ends with the page, so that no search fails late.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?|"[^"]*"|'[^']*'""")
UNSEEN = re.compile(r"display\s*:\s*none", re.I)
RAW_TAGS = frozenset("script style textarea title noscript template iframe".split())
START, END = re.compile(r"<([a-zA-Z][a-zA-Z0-9:-]*+)"), re.compile(r"</([a-zA-Z][a-zA-Z0-9:-]*+)[^>]*+(?:>|\Z)")
SENTENCE_END = re.compile(r"[.!?…](?:\s|$)|[。！？।۔؟]")


SOFT, HARD = 1, 2  # marks of elements


@dataclass
class Block:
    text: str
    linked: int  # code points inside links
    heading: bool
    boiler: bool  # inside navigation, notices, comments and the like
    article: bool
    share: float = 0.0  # stop words of all words
    label: str = ""

    @property
    def size(self) -> int:
        """Code points, those of scripts without spaces between words twice."""
        return len(self.text) + sum(c >= "\u2e80" for c in self.text)


class Places:
    """Where the tags of a page start and end, found in two passes, so that looking ahead doesn't read the page again."""

    def __init__(self, page: str):
        self.starts, self.ends, self.blocks = defaultdict(list), defaultdict(list), []
        for m in START.finditer(page):
            self.starts[m[1].lower()].append(m.start())
        for m in END.finditer(page):
            self.ends[m[1].lower()].append((m.start(), m.end()))
        for tag in BLOCK_TAGS:
            self.blocks += self.starts[tag] + [x for x, _ in self.ends[tag]]
        self.blocks.sort()

    def end_of(self, tag: str, at: int) -> tuple[int, int] | None:
        """The next end tag."""
        k = bisect_left(self.ends[tag], (at, 0))
        return self.ends[tag][k] if k < len(self.ends[tag]) else None

    def any_start(self, tag: str, low: int, high: int) -> bool:
        k = bisect_left(self.starts[tag], low)
        return k < len(self.starts[tag]) and self.starts[tag][k] < high

    def any_block(self, low: int, high: int) -> bool:
        k = bisect_left(self.blocks, low)
        return k < len(self.blocks) and self.blocks[k] < high


def _compound(part: str, words: frozenset[str]) -> bool:
    """One of the words written together with a word of place, as commentlist."""
    return any(part[:k] in words and part[k:] in PLACE_WORDS or part[:k] in PLACE_WORDS and part[k:] in words for k in range(2, len(part) - 1))


def _names(token: str, words: frozenset[str]) -> bool:
    """A whole class, id or role: one of the words, with nothing beside it but others and words of place."""
    parts = {x for x in re.split(r"[^a-z]+", token[:200]) if x}
    named = {x for x in parts if x in words or x not in PLACE_WORDS and _compound(x, words)}
    return bool(named) and parts - named <= PLACE_WORDS


def _marked(attributes: str, in_article: bool) -> int:
    """HARD for what is hidden, SOFT for what a class, id or role names as no part of an article, else 0."""
    soft = 0
    words = BOILER_WORDS if in_article else BOILER_WORDS | HEADER_WORDS
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), "".join(values).lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and UNSEEN.search(value):
            return HARD
        if name in ("class", "id", "role") and any(_names(x, words) for x in value.split()):
            soft = SOFT
    return soft


def _stop_share(text: str, stop_words: frozenset[str]) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?\"'()") in stop_words for w in words) / max(len(words), 1)


def _dense(blocks: list[Block], dense: float = 0.2, short: int = 70, long: int = 200, most_linked: float = 0.5) -> list[bool]:
    """Blocks of prose: with few links and, from `short` code points on, enough stop words. Where no block has these, as
    in another language, long ones with two sentences and more are."""
    plain = [b.linked <= most_linked * len(b.text) for b in blocks]
    found = [p and len(b.text) >= short and b.share >= dense for p, b in zip(plain, blocks)]
    if any(found):
        return found
    return [p and b.size >= long and len(SENTENCE_END.findall(b.text)) >= 2 for p, b in zip(plain, blocks)]


def _boiler(elements: list[tuple[str, int, int, bool]], found: list[tuple[Block, int]]) -> list[bool]:
    """Which elements (tag, parent, mark, in an article) are boilerplate: hard ones, soft ones that are no wrapper of the
    article, and all in them. A wrapper is or holds a main, holds an article or h1 that is not marked itself, or, where
    no unmarked article has dense text, holds most of the page's dense text."""
    hard, clear = [], []
    for tag, parent, mark, _ in elements:
        hard.append(mark == HARD or parent >= 0 and hard[parent])
        clear.append(not mark and (parent < 0 or clear[parent]))
    holds, mass = [False] * len(elements), [0] * len(elements)
    total, elsewhere = 0, False
    shown = [(b, k) for b, k in found if k < 0 or not hard[k]]
    for (b, k), prose in zip(shown, _dense([b for b, _ in shown])):
        if prose:
            total += len(b.text)
            if k >= 0:
                mass[k] += len(b.text)
                elsewhere |= clear[k] and b.article
    for k in range(len(elements) - 1, -1, -1):
        tag, parent, mark, _ = elements[k]
        if tag == "main" and not hard[k]:
            holds[k] = True
        if parent >= 0 and not hard[k]:
            mass[parent] += mass[k]
            holds[parent] |= holds[k] or tag in ("article", "h1") and not mark
    out: list[bool] = []
    for k, (tag, parent, mark, _) in enumerate(elements):
        wraps = holds[k] or not elsewhere and 2 * mass[k] > total
        out.append(parent >= 0 and out[parent] or mark == HARD or mark == SOFT and not wraps)
    return out


def blocks_of(page: str, stop_words: frozenset[str] = frozenset(STOP_WORDS)) -> list[Block]:
    """The page's text between block tags, in order. Unclosed tags end with the element around them."""
    out: list[tuple[Block, int]] = []  # with the element around the block, -1 for none
    elements: list[tuple[str, int, int, bool]] = []  # tag, parent, mark, article
    stack: list[int] = []  # open elements
    wrappers: set[str] = set()  # other tags than block tags among them
    parts: list[str] = []
    linked, links, heading, breaks = 0, 0, False, 0
    opened: Counter[str] = Counter()  # open elements by tag
    places: Places | None = None

    def close() -> None:
        nonlocal linked, breaks
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            article = elements[stack[-1]][3] if stack else False
            out.append((Block(text, linked, heading, False, article, _stop_share(text, stop_words)), stack[-1] if stack else -1))
        parts.clear()
        linked = breaks = 0

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        data = page[at : m.start()] if m else page[at:]
        if data:
            if breaks and not data.isspace():
                breaks = 0
            parts.append(data)
            if links:
                linked += len(data)
        if not m:
            break
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in SKIPPED_TAGS:
            if not closing and (tag in RAW_TAGS or tag not in VOID_TAGS and not m[3].rstrip().endswith("/")):
                places = places or Places(page)
                e = places.end_of(tag, at)
                at = e[1] if e else (at if tag == "head" else end)
            parts.append(" ")
        elif tag == "br":
            breaks += 1
            if breaks == 2:
                close()
            else:
                parts.append(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif tag in BLOCK_TAGS or closing and tag in wrappers:
            close()
            heading = tag in HEADINGS and not closing
            if tag in VOID_TAGS:
                continue
            if closing:
                while opened[tag]:
                    ended = elements[stack.pop()][0]
                    opened[ended] -= 1
                    if ended == tag:
                        links = 0
                        break
            else:
                if tag == "p" and stack and elements[stack[-1]][0] == "p":
                    stack.pop()
                    opened["p"] -= 1
                article = bool(stack) and elements[stack[-1]][3]
                mark = HARD if tag in BOILER_TAGS or (tag == "header" and not article) else SOFT if tag == "form" else 0
                if tag not in ("html", "body"):
                    mark = max(mark, _marked(m[3], article))
                elements.append((tag, stack[-1] if stack else -1, mark, article or tag in ("article", "main")))
                stack.append(len(elements) - 1)
                opened[tag] += 1
        elif not closing and m[3] and tag not in VOID_TAGS and (mark := _marked(m[3], True)):
            places = places or Places(page)
            e = places.end_of(tag, at)  # an inline element that is hidden or an advert
            if e and not places.any_start(tag, at, e[0]):
                if mark == SOFT and places.any_block(at, e[0]):
                    close()  # one around blocks is judged like a block
                    elements.append((tag, stack[-1] if stack else -1, mark, bool(stack) and elements[stack[-1]][3]))
                    stack.append(len(elements) - 1)
                    opened[tag] += 1
                    wrappers.add(tag)
                else:
                    at = e[1]
    close()
    boiler = _boiler(elements, out)
    for b, k in out:
        b.boiler = k >= 0 and boiler[k]
    return [b for b, _ in out]


def classify(blocks: list[Block], dense: float = 0.2, sparse: float = 0.1, short: int = 70, long: int = 200, most_linked: float = 0.5) -> None:
    """Labels `good` or `bad`. First pass: links, length and the share of stop words decide (see _dense), blocks of
    navigation and the like are bad, and so is what stands outside the article where a page marks one; short blocks and
    those between the bounds stay open. Links say nothing of a heading, nor of anything in a marked article. Second pass:
    an open block takes the label of the nearest decided one of its part of the page, a heading that of the next one;
    where none is decided, an article's blocks are good and others bad."""
    marked = any(b.article and not b.boiler for b in blocks)
    shown = [b for b in blocks if not b.boiler]
    prose = {id(b) for b, found in zip(shown, _dense(shown, dense, short, long, most_linked)) if found}
    for b in blocks:
        if b.boiler or marked and not b.article:
            b.label = "bad"
        elif b.linked > most_linked * len(b.text) and not b.article:
            b.label = "" if b.heading else "bad"
        elif id(b) in prose or b.article and (len(b.text) >= long or len(b.text) >= short and b.share >= dense):
            b.label = "good"
        elif len(b.text) < long or b.share >= sparse or b.article:
            b.label = ""
        else:
            b.label = "bad"
    part = [b for b in blocks if b.article] if marked else blocks
    decided = [k for k, b in enumerate(part) if b.label and not b.boiler and not (b.article and b.label == "bad")]
    left = -1
    for k, b in enumerate(part):
        while left + 1 < len(decided) and decided[left + 1] < k:
            left += 1
        if b.label:
            continue
        before = decided[left] if left >= 0 else None
        after = decided[left + 1] if left + 1 < len(decided) else None
        if before is None and after is None:
            b.label = "good" if b.article else "bad"
        elif after is not None and (before is None or b.heading or after - k < k - before):
            b.label = part[after].label
        elif after is not None and before is not None and after - k == k - before:
            b.label = "good" if "good" in (part[before].label, part[after].label) else "bad"
        else:
            b.label = part[before].label


def main_text(page: str, stop_words: frozenset[str] = frozenset(STOP_WORDS)) -> str:
    blocks = blocks_of(page, stop_words)
    classify(blocks)
    return "\n\n".join(b.text for b in blocks if b.label == "good")


def extract_pages(pages: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """The article of whole pages, blocks joined by empty lines.

    General: the project keeps no web pages. pages: page_id, url, html; other columns are ignored. Returns page_id, url,
    text. No shuffle; a page is read in one pass and classified in two (see classify).

    A NULL, empty or text-free page has an empty text. Unclosed and cut-off tags are tolerated, and time grows with the
    length of a page, also of one of many MB, which is read whole in one task. Repeated rows and equal or NULL ids give
    a row each, an empty table none."""
    stops = frozenset(stop_words or STOP_WORDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in text_blocks(batches, "html"):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(t, stops) for t in texts], pa.string())], ["page_id", "url", "text"])

    d = pages.select("page_id", "url", "html")
    kinds = dict(d.dtypes)
    return d.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
