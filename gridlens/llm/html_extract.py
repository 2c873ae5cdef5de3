"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass decides a block by where it stands
(menus, headers, footers, asides, forms and boxes named as adverts, notices or comments are out),
by link density, length and stop-word density. A name that only holds such a word among others
(``content-sidebar``, ``ad-free``) is a hint: its box is out unless it reads as prose and boxes of
that kind hold as much prose as the rest of the page. Standing in an article or main element is a strong
feature beside these: it halves the stop-word density asked for, and where such elements hold most
of the text, blocks elsewhere have to be long or plain prose. A short article with a link in it is a card that
leads to another page. Blocks too short or too plain to decide are left open; the second pass gives
each the label of its nearest decided neighbour, in the innermost box around it that has a decided
block, kept on a tie between kept and dropped.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.quality_rules import STOP_WORDS

#: Elements that end a block, whose content is no text, and that stand outside the main text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
NO_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video select textarea title".split())
#: Of these the rest of the page is content where the end tag is missing; any other without one is ignored.
RAW = frozenset("script style textarea title".split())
OUTSIDE = frozenset("nav header footer aside form menu head dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INSIDE = frozenset("article main".split())
#: Elements whose blocks belong together.
BOXES = frozenset("article body center div main section td".split())
#: Elements that hold the page or the article: their names say what else stands there, not what they are.
HOLDERS = frozenset("html body article main".split())
#: First parts of names that say what is missing or beside: ``no-comments``, ``with-sidebar``.
BESIDE = frozenset("no non not with without has have is hide hidden".split())
#: Class, id or role words of boxes outside the main text.
OUTSIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments commentlist contentinfo cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice popup promo related search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Of these, words that mean the same in any company.
ALWAYS = frozenset("advert adverts advertisement comment comments commentlist contentinfo cookie cookies consent disqus gdpr newsletter promo signup sponsor sponsored subscribe".split())
#: Words that say nothing of what a box holds.
PLAIN = frozenset("a area b bar block body bottom box button c class column container content css el elem element entry group id inner item js left link links list main module outer page panel pane right row section side site slot top unit wrap wrapper zone".split())
LEAST_CHARS, MOST_LINKS, LEAST_STOP = 60, 0.5, 0.12
#: Characters of a long block.
LONG = 5 * LEAST_CHARS

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_STOP = frozenset(STOP_WORDS)


OUT, HINT = 1, 2


def _outside(tag: str, attributes: str) -> int:
    """``OUT`` for an element outside the main text, ``HINT`` if a part of a name says so, else 0."""
    if tag in OUTSIDE:
        return OUT
    if not attributes.strip():
        return 0
    if _HIDDEN.search(attributes):
        return OUT
    if tag in HOLDERS:
        return 0
    hint = 0
    for name in " ".join(a or b or c for a, b, c in _NAMES.findall(attributes)).lower().split():
        parts = [x for x in re.split(r"[^a-z]+", name) if x]
        if parts and parts[0] not in BESIDE and not OUTSIDE_NAMES.isdisjoint(parts):
            rest = [x for x in parts if x not in OUTSIDE_NAMES and x not in PLAIN]
            holder = parts[0] in ("main", "content") or "content" in parts
            if not ALWAYS.isdisjoint(parts) or not rest and not holder and not (len(parts) > 1 and parts[-1] in ("right", "left")):
                return OUT
            hint = HINT
    return hint


class _Ends:
    """Where the contents of elements without text end; the page is read once for each kind of element."""

    def __init__(self, page: str):
        self.page = page
        self.of: dict[str, dict[int, int] | list[int]] = {}

    def after(self, tag: str, at: int) -> int:
        """After the element's own end tag, those of elements of its kind inside it passed over; without one the page's end for raw text, else ``at``."""
        if tag not in self.of:
            found = re.compile(rf"<(/?){tag}(?=[\s/>])[^>]*?(/?)>", re.I).finditer(self.page)
            if tag in RAW:
                self.of[tag] = [m.end() for m in found if m[1]]
            else:
                match: dict[int, int] = {}
                open_: list[int] = []
                for m in found:
                    if not m[1]:
                        if not m[2]:
                            open_.append(m.end())
                    elif open_:
                        match[open_.pop()] = m.end()
                self.of[tag] = match
        ends = self.of[tag]
        if isinstance(ends, dict):
            return ends.get(at, at)
        k = bisect_right(ends, at)
        return ends[k] if k < len(ends) else len(self.page)


class Block(NamedTuple):
    """A block with text: characters inside links, whether it stands outside, the innermost article (0: none), box and named box around it (0: none)."""

    text: str
    linked: int
    outside: bool
    article: int
    box: int
    hint: int


def blocks(page: str, parents: dict[int, int] | None = None) -> Iterator[Block]:
    """The blocks of a page in order; ``parents`` gets the box around each box."""
    parents = {} if parents is None else parents
    open_tags: list[tuple[str, int, int]] = []  # element, whether it stands outside, its number if it is a box
    boxes, hints = [0], [0]
    out_depth = links = opened = 0
    articles: list[int] = []
    parts: list[str] = []
    linked = at = 0
    ends, count = _Ends(page), {}  # open elements of each kind

    def close() -> Iterator[Block]:
        nonlocal parts, linked
        text = " ".join("".join(parts).split())
        if text:
            yield Block(text, linked, out_depth > 0, articles[-1] if articles else 0, boxes[-1], hints[-1])
        parts, linked = [], 0

    def leave(k: int) -> None:
        nonlocal out_depth, links
        for name, outside, box in open_tags[k:]:
            out_depth -= outside == OUT
            if outside == HINT:
                hints.pop()
            if name in INSIDE:
                articles.pop()
            links -= name == "a"
            count[name] -= 1
            if box:
                boxes.pop()
        del open_tags[k:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw)
            parts.append(text)
            if links:
                linked += len(" ".join(text.split()))

    n = len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK_TAGS or _outside(tag, m[3] or ""):
            yield from close()
        if m[1]:
            for k in range(len(open_tags) - 1, -1, -1) if count.get(tag) else ():
                if open_tags[k][0] == tag:
                    leave(k)
                    break
            continue
        if tag in NO_TEXT:
            if not (m[3] or "").endswith("/") or tag in RAW:
                at = ends.after(tag, at)
            continue
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK_TAGS:
            continue
        if tag in ("p", "li", "a", "dt", "dd", "option", "tr", "td", "th"):  # these end an open one of their kind
            for k in range(len(open_tags) - 1, -1, -1) if count.get(tag) else ():
                name = open_tags[k][0]
                if name == tag:
                    leave(k)
                    break
                if name in BLOCK_TAGS and name != "p":
                    break
        outside = _outside(tag, m[3] or "")
        opened += 1
        open_tags.append((tag, outside, opened if tag in BOXES else 0))
        count[tag] = count.get(tag, 0) + 1
        out_depth += outside == OUT
        if outside == HINT:
            hints.append(opened)
        if tag in BOXES:
            parents[opened] = boxes[-1]
            boxes.append(opened)
        if tag in INSIDE:
            articles.append(opened)
        links += tag == "a"
    yield from close()


def prose(text: str, least: float) -> bool:
    """Whether at least that share of the words are stop words."""
    tokens = text.lower().split()
    return sum(t.strip(".,;:!?") in _STOP for t in tokens) >= least * len(tokens)


def decide(text: str, linked: int, outside: bool, article: bool, whole: bool) -> bool | None:
    """First pass: in, out, or None where the block alone does not tell. ``whole``: articles hold most of the page's text."""
    if outside or linked > MOST_LINKS * len(text):
        return False
    if whole and not article and len(text) < LONG and (linked or len(text) < 2 * LEAST_CHARS or not prose(text, LEAST_STOP)):
        return False
    if len(text) < LEAST_CHARS:
        return None
    if prose(text, LEAST_STOP / 2 if article else LEAST_STOP):
        return True
    return True if len(text) >= LONG and not linked else None


def cards(found: list[tuple]) -> set[int]:
    """Numbers of short articles with a link in them, on pages that have a longer text."""
    sizes: dict[int, int] = {}
    linking = set()
    for text, linked, outside, article, *_ in found:
        if not outside:
            sizes[article] = sizes.get(article, 0) + len(text) - linked
            if linked:
                linking.add(article)
    most = max(sizes.values(), default=0)
    return {k for k, n in sizes.items() if k and k in linking and n < LONG and n < most}


def inherit(labels: list[bool | None]) -> list[bool]:
    """Second pass: open labels take the nearest decided one, the kept one on a tie; all open: kept."""
    n, far = len(labels), len(labels) + 1
    left, right = [(far, None)] * n, [(far, None)] * n
    last = (far, None)
    for i in range(n):
        last = (0, labels[i]) if labels[i] is not None else (last[0] + 1, last[1])
        left[i] = last
    last = (far, None)
    for i in range(n - 1, -1, -1):
        last = (0, labels[i]) if labels[i] is not None else (last[0] + 1, last[1])
        right[i] = last
    out = []
    for (a, x), (b, y) in zip(left, right, strict=True):
        near = [v for d, v in ((a, x), (b, y)) if v is not None and d == min(d for d, v in ((a, x), (b, y)) if v is not None)]
        out.append(any(near) if near else True)
    return out


def resolved(found: list[Block]) -> list[Block]:
    """Boxes with a hint in their name decided: in if they read as prose and such boxes hold as much of it as the rest of the page."""
    if not any(b.hint for b in found):
        return found
    in_box: dict[int, list[Block]] = {}
    for b in found:
        if not b.outside:
            in_box.setdefault(b.hint, []).append(b)
    size = {k: sum(len(b.text) - b.linked for b in v) for k, v in in_box.items()}
    reads = {k for k, v in in_box.items() if k and size[k] >= LONG and sum(b.linked for b in v) <= MOST_LINKS / 2 * size[k] and prose(" ".join(b.text for b in v), LEAST_STOP)}
    elsewhere = sum(len(b.text) for b in in_box.get(0, ()) if decide(b.text, b.linked, False, b.article > 0, False))
    let_in = reads if sum(size[k] for k in reads) >= elsewhere else set()
    return [b._replace(outside=b.outside or b.hint not in let_in) if b.hint else b for b in found]


def main_text(page: str | None) -> str:
    """The main text of one page; blocks in page order, two line ends between them."""
    parents: dict[int, int] = {}
    found = resolved(list(blocks(page or "", parents)))
    card = cards(found)
    found = [b._replace(outside=True) if b.article in card else b for b in found]
    first = [decide(b.text, b.linked, b.outside, b.article > 0, False) for b in found]
    inside = sum(len(b.text) for b in found if b.article and not b.outside)
    elsewhere = sum(len(b.text) for b, label in zip(found, first, strict=True) if label and not b.article)
    if inside and inside >= elsewhere:
        first = [decide(b.text, b.linked, b.outside, b.article > 0, True) for b in found]
    if not any(first):  # nothing is sure: what stands open in an article stays, or anywhere where no article does
        marked = any(label is None and b.article for b, label in zip(found, first, strict=True))
        first = [True if label is None and (b.article or not marked) else label for b, label in zip(found, first, strict=True)]
    kept = inherit(first)
    own = [i for i, b in enumerate(found) if not b.outside]
    decided = [p for p, i in enumerate(own) if first[i] is not None]
    # The blocks of a box stand one after the other: first and last place of each, its inner boxes' included.
    low: dict[int, int] = {}
    high: dict[int, int] = {}
    for p, i in enumerate(own):
        box = found[i].box
        low.setdefault(box, p)
        high[box] = p
    for box in sorted(parents, reverse=True):
        if box in low:
            low[parents[box]] = min(low.get(parents[box], low[box]), low[box])
            high[parents[box]] = max(high.get(parents[box], high[box]), high[box])
    for p, i in enumerate(own) if decided else ():
        if first[i] is None:
            k = bisect_right(decided, p)
            left, right, box = decided[k - 1] if k else None, decided[k] if k < len(decided) else None, found[i].box
            while box and not (left is not None and left >= low[box] or right is not None and right <= high[box]):
                box = parents[box]
            if box:
                near = [x for x in (left if left is not None and left >= low[box] else None, right if right is not None and right <= high[box] else None) if x is not None]
                least = min(abs(x - p) for x in near)
                kept[i] = any(first[own[x]] for x in near if abs(x - p) == least)
    return "\n\n".join(b.text for b, keep in zip(found, kept, strict=True) if keep)


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)`` for every page; null and empty pages give an empty text.

    Pages are independent, so there is no shuffle. Broken markup never fails: unclosed elements
    end with the page (of those without text, only scripts, styles, titles and text areas; others
    are ignored), stray end tags are ignored, a cut-off tag or comment ends the page.
    Repeated rows are extracted each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
