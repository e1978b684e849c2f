"""Main text of web pages by the distribution of line blocks.

Markup is stripped to lines, one per block element.  A line's weight is its text outside links; lines of page furniture
(menus, notices, comments ...) weigh nothing; adverts, forms and furniture inside a marked article are passed over, so that
they do not part a text.  Weights are summed over sliding windows of ``WINDOW`` lines.  Text begins where the sums surge
above a share of those of a usual paragraph, reaches back to the foot of that surge and the headings on it, and ends where
they dive to nothing; all lines between that are no furniture are kept.  Where lines marked as an article hold the highest
sums of text outside links, their links weigh as text and lines outside weigh nothing; surges and dives choose among them in
the same way.  Marks on lesser lines (teaser cards) are not followed.  Pages are read row by row without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlens.llm.common import batches

WINDOW = 3
#: A surge reaches this share of the sum of ``WINDOW`` usual paragraphs, or of the highest sum if that is less.
SURGE = 0.2
#: Characters of a line that counts as a paragraph, and the most that a usual one counts for.
PARAGRAPH = (80, 400)
_BATCH_BYTES = 4 << 20

_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre search section select summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Elements that may hold others; an unclosed paragraph or list item ends by itself.
_NESTED = _BLOCKS - frozenset("p li dd dt hr option tr td th html body head label".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object canvas audio video noframes noembed xmp datalist".split())
_FURNITURE = frozenset("nav aside footer form button select fieldset dialog menu label legend search head".split())
#: Furniture that stands in the midst of a text.
_INSERTS = frozenset("form button select fieldset dialog label legend".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar tablist".split())
_TITLES = frozenset("header masthead banner".split())
_ADVERTS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promoted".split())
_ASIDES = _ADVERTS | frozenset("comment comments commentlist discussion disqus respond replies".split())
_PARTS = _ASIDES | frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets cookie cookies consent gdpr notice notices popup modal "
    "newsletter subscribe subscription signup login share sharing social related recommended pagination pager toolbar toc skip".split()
)
_TOKEN = re.compile(
    r"<!--.*?-->|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?![\w-])\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _part(tag: str, attributes: str, inside: bool) -> int:
    """2 for an element of page furniture, 1 for one in the midst of a text, else 0; ``inside`` an article its title block is 0."""
    if tag in _FURNITURE or (tag == "header" and not inside):
        return 1 if tag in _INSERTS else 2
    if not attributes or tag in ("body", "html"):
        return 0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return 1
        if name == "role" and value.lower() in _ROLES:
            return 2
        if name in ("class", "id"):
            words = {w.lower() for w in _NAME.findall(value)}
            if words & (_ASIDES if tag in ("article", "main") else _PARTS) or (not inside and words & _TITLES):
                return 1 if words & _ADVERTS else 2
    return 0


def lines(page: str) -> Iterator[tuple[str, int, bool, int, bool]]:
    """Text of each block, its kind of furniture, whether it is in an article, its characters inside links, whether it is a heading."""
    stack: list[tuple[str, int, bool]] = []
    part, article = 0, False
    link = 0
    held: list[str] = []
    linked = at = 0

    def flush():
        nonlocal held, linked
        text = " ".join(html.unescape("".join(held)).split())
        row = (text, part, article, min(linked, len(text)), bool(stack) and stack[-1][0] in _HEADINGS)
        held, linked = [], 0
        return row if text else None

    def take(text: str) -> None:
        nonlocal linked
        held.append(text)
        if link:
            linked += len(" ".join(html.unescape(text).split()))

    last = page.rfind(">") + 1  # no tag ends beyond
    while found := _TOKEN.search(page, at, last):
        if found.start() > at:
            take(page[at : found.start()])
        at = found.end()
        close, tag, attributes = found.group(1), found.group(2), found.group(3)
        if tag is None:
            close, tag, attributes = found.group(4), found.group(5), found.group(6)
        if tag is None:
            continue  # comment or declaration
        tag = tag.lower()
        if tag in _RAW:
            if not close and not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag == "a":
            link = 0 if close else 1
        elif tag == "br":
            held.append(" ")
        elif tag in _BLOCKS:
            if row := flush():
                yield row
            link = 0
            if tag in _NESTED:
                if not close:
                    stack.append((tag, part, article))
                    article = article or tag in ("article", "main") or ("role" in attributes and "\"main\"" in attributes)
                    part = max(part, _part(tag, attributes, article))
                else:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == tag:
                            _, part, article = stack[i]
                            del stack[i:]
                            break
    rest = page[at:]
    if "<" in rest and re.search(r"<[a-zA-Z/!?]", rest):
        rest = rest[: re.search(r"<[a-zA-Z/!?]", rest).start()]  # a tag that never ends
    take(rest)
    if row := flush():
        yield row


def sums_of(weights: np.ndarray) -> np.ndarray:
    """Sum of each window, by its first line."""
    return np.convolve(weights, np.ones(WINDOW, np.int64))[WINDOW - 1 :]


def between(weights: np.ndarray, headings: np.ndarray) -> np.ndarray:
    """Lines from the foot of each surge to the dive after it."""
    kept = np.zeros(len(weights), bool)
    if not weights.any():
        return kept
    sums = sums_of(weights)
    usual = np.sort(weights[weights >= min(PARAGRAPH[0], weights.max())])
    high = sums > SURGE * min(int(sums.max()), WINDOW * min(int(usual[(len(usual) - 1) // 2]), PARAGRAPH[1]))
    i = 0
    while i < len(weights):
        if not high[i]:
            i += 1
            continue
        start = i
        while start and (weights[start - 1] or headings[start - 1]):
            start -= 1
        while not (weights[start] or headings[start]):
            start += 1
        end = i
        while end < len(weights) and sums[end]:
            end += 1
        kept[start:end] = True
        i = end + 1
    return kept


def main_text(page: str) -> str:
    found = [x for x in lines(page) if not (x[1] and (x[1] == 1 or x[2]))]
    if not found:
        return ""
    part, marked = (np.array([bool(x[i]) for x in found]) for i in (1, 2))
    whole, linked = np.array([len(x[0]) for x in found], np.int64), np.array([x[3] for x in found], np.int64)
    weights = np.where(part, 0, whole - linked)
    inside, outside = (int(sums_of(np.where(side, weights, 0)).max()) for side in (marked, ~marked))
    # Or an article of links, beside which nothing surges.
    usable = ~part
    if marked.any() and (inside >= outside or outside <= SURGE * sums_of(np.where(marked, whole, 0)).max()):
        usable = marked
        weights = np.where(marked, whole, 0)
    kept = between(weights, usable & np.array([x[4] for x in found])) & usable
    return "\n".join(x[0] for x, k in zip(found, kept) if k)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; a null, empty or text-free page has the text ''.

    Character references are decoded, white space inside a block is one space, blocks are joined by a line break.  Repeated rows
    and null ids stay rows of their own; other columns are ignored.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(source, _BATCH_BYTES, "html"):
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
