"""Operator 2: main text of HTML pages by line-block distribution.

A page is read as a stream of tags and text.  What never is text (scripts, styles, controls, hidden elements) is left out.  What is left falls
into lines, one for each block element; a line carries the length of its text, without the text of its links.  Line
blocks are sums over a sliding window of lines.  A surge point is where the block sum rises over a threshold with text in
the following windows, a dive point is where it falls to nothing; the lines between a surge and its dive are kept.

Names and marks are evidence, the distribution decides.
* Elements that as a rule hold no article (menus, headers, footers, sidebars, forms, notices, adverts, comments; by element name, role, or words of class and
  id) are left out as long as there is a surge without them.  If there is none, the one among them that holds the most text loses its bad name:
  sidebars, headers, forms and the like if a surge lies inside, menus and footers (such as a menu that is never closed) if they hold
  a marked article; comments, adverts and notices only if they are, or hold, a marked article on a page without other text. A loosely
  named element also loses its name if a marked article inside outweighs all surges outside.
* Marks (article, main, role=main, itemprop=articleBody) double the weight of text.  Surges are sought among the unmarked lines and among those of each mark,
  so that no window spans both; the heaviest surge (the densest block if no window reaches the threshold) says where the main text is.  In a mark, that
  is all of the mark's text, however short its lines are.  Articles beside it stay if they have half of its text and no linked title (parts of
  the text); teasers, and articles inside an article (readers' comments) that are smaller, go.
* Outside marks, lines with text outside links stay if they stand between two surges, or in the container (div, section, article, main; the page itself
  for lines in no other) of a surge: a short line is no end of the text. Lines that are links only are kept inside a surge's windows and in marks.
Headings in a header of a marked article belong to the article, and so does a first heading right before it if it has none itself.
Of the words of class and id, blocks of text (paragraphs, headings, list items, cells) heed those of adverts and notices only.

The whole page is one value in one row, so pages are worked on where they lie: no shuffle, and memory for one page at a time.

Defined results: null and empty html give empty text and 0; markup that never ends counts up to the end of the page;
repeated rows are all returned; columns besides those named are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkweave.llm._text import by_bytes, held
from linkweave.session import table

#: Lines in a window, and characters that a window needs for a surge.
WINDOW, SURGE = 3, 40

#: Weight of text in a marked element.
PRIOR = 2

#: Element names (fixed values): without content; with raw content; never text; seldom an article; inside a line; what holds the lines of one text together.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
NEVER = RAW | frozenset("head button select option svg math canvas audio video object map datalist legend output".split())
LOOSE_ELEMENTS, FIRM_ELEMENTS = frozenset("header form fieldset".split()), frozenset("nav footer aside menu dialog".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr img".split()
)
CONTAINERS = frozenset("div section article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How sure a name tells that an element holds no article.
LOOSE, FIRM, SURE = 0, 1, 2
#: Roles and words of class or id that tell so (fixed values).
ROLES = {r: FIRM for r in "navigation contentinfo complementary search menu menubar dialog alertdialog alert toolbar".split()} | {"banner": LOOSE, "form": LOOSE}
WORDS = (
    {w: LOOSE for w in "banner header masthead sidebar sidebars aside widget widgets promo promotion popup modal overlay related recommended recommendations toolbar skip toc menu".split()}
    | {w: FIRM for w in "nav navbar navigation menubar breadcrumb breadcrumbs footer pager pagination share sharing social copyright disclaimer signup login".split()}
    | {w: SURE for w in "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert newsletter subscribe subscription".split()}
    | {w: SURE for w in "comment comments commentlist disqus respond reply replies reactions".split()}
)
#: A block of text may bear other words than these for its looks or its subject (fixed values).
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th blockquote pre figcaption caption".split()) | INLINE
BLOCK_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors cookie cookies consent gdpr newsletter subscribe copyright".split())
#: How the last line of a page without a footer element begins if it is one.
_RIGHTS = re.compile(r"(?:©|\(c\)\s|copyright\b|all rights reserved)", re.I)
#: Closing tags that may be missing: a start tag of the second kind ends an open element of the first (fixed values).
_BLOCK = "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul"
IMPLIED = {"p": frozenset(_BLOCK.split()), "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option", "optgroup"])}

_TAG = re.compile(r"(?:!--(?P<comment>.*?)(?:--!?>|$)|(?P<other>[!?][^>]*(?:>|$))|/(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|$)|(?P<start>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)|(?P<open>[a-zA-Z][^\s/>]*)[^>]*(?:>|$))", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAMED = re.compile(r"class|id\b|role|hidden|style|itemprop", re.I)
#: Such words only tell that something else has or lacks a sidebar and the like.
_ABOUT = re.compile(r"\b(?:has|with|no|without|hide|show)[-_]+\w+", re.I)


def never_text(name: str, attributes: dict[str, str]) -> bool:
    """Whether an element is no text at all, or not shown."""
    return name in NEVER or "hidden" in attributes or attributes.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attributes.get("style", "")))


def bad_name(name: str, attributes: dict[str, str]) -> int | None:
    """How sure it is by its name, role, class and id that an element is no part of an article; None: they don't tell so."""
    found = [FIRM] if name in FIRM_ELEMENTS else [LOOSE] if name in LOOSE_ELEMENTS else []
    if name not in ("html", "body", "main") and attributes:
        named = _ABOUT.sub(" ", f"{attributes.get('class', '')} {attributes.get('id', '')}")
        words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", named).lower())
        found += [WORDS[w] for w in words if w in WORDS and (name not in BLOCKS or w in BLOCK_WORDS)]
        if (role := attributes.get("role", "").lower()) in ROLES:
            found.append(ROLES[role])
    if is_article(name, attributes):  # its mark outweighs loose words
        found = [x for x in found if x == SURE]
    return max(found, default=None)


def is_article(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role", "").lower() == "main" or attributes.get("itemprop", "").lower() == "articlebody"


@dataclass
class Line:
    text: str
    #: length of the text outside links
    length: int
    #: innermost element with a bad name, outermost marked element, innermost article element, container; 0: none
    bad: int
    mark: int
    article: int
    box: int
    #: innermost element that isn't inside a line
    block: str = ""


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    #: the container around each container
    around: list[int] = field(default_factory=lambda: [0])
    #: of elements with a bad name: the next one around, how sure the name is, whether marked elements are inside, whether it is marked itself
    bad_around: list[int] = field(default_factory=lambda: [0])
    sure: list[int] = field(default_factory=lambda: [SURE])
    holds_mark: list[bool] = field(default_factory=lambda: [False])
    is_mark: list[bool] = field(default_factory=lambda: [False])
    #: the article element around each article element
    article_around: list[int] = field(default_factory=lambda: [0])


def read(html: str) -> Page:
    """The lines of a page with what stands around them.

    A div that is a line itself, with no other line and no block in it, is not the line's container."""
    page = Page()
    parts: list[str] = []
    linked = 0
    stack: list[tuple[str, tuple[bool, int, int, int, int]]] = []  # open elements with the state around them
    skipped, bad, mark, article, box = False, 0, 0, 0, 0
    links = marks = 0
    headers: dict[int, int] = {}  # header elements in marked ones, by their number: what is around them
    own: set[int] = set()  # lines whose innermost block is their container
    at, n = 0, len(html)

    def flush() -> None:
        nonlocal linked
        text = " ".join(unescape("".join(parts)).split())
        if text:
            block = next((x[0] for x in reversed(stack) if x[0] not in INLINE), "")
            if block in CONTAINERS:
                own.add(len(page.lines))
            page.lines.append(Line(text, max(0, len(text) - linked), headers.get(bad, bad) if block in HEADINGS else bad, mark, article, box, block))
        parts.clear()
        linked = 0

    def leave(k: int) -> None:
        """Close the elements from place k of the stack on."""
        nonlocal skipped, bad, mark, article, box, links
        links -= sum(x[0] == "a" for x in stack[k:])
        if any(x[0] not in INLINE for x in stack[k:]) and not skipped:
            flush()
        skipped, bad, mark, article, box = stack[k][1]
        del stack[k:]

    while at < n:
        opens = html.find("<", at)
        m = _TAG.match(html, opens + 1) if opens >= 0 else None
        text = html[at:] if opens < 0 else html[at:opens] if m else html[at : opens + 1]
        if text and not skipped:
            parts.append(text)
            if links:
                linked += len(text)
        if opens < 0:
            break
        at = m.end() if m else opens + 1
        if not m:  # a lone "<" is text
            continue
        if m["comment"] is not None or m["other"] is not None:
            continue
        if m["end"]:
            name = m["end"].lower()
            if name == "br" and not skipped:
                flush()
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if k is not None and not (name == "p" and any(x[0] in ("article", "div", "section", "main", "td") for x in stack[k + 1 :])):
                leave(k)
            elif name not in INLINE and not skipped:
                flush()
            continue
        name = (m["start"] or m["open"]).lower()
        raw = m["attributes"] or ""
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in IMPLIED and name in IMPLIED[stack[k][0]]:
                leave(k)
                break
            if stack[k][0] in ("table", "ul", "ol", "dl", "div", "article", "section", "main", "body", "aside", "nav", "footer", "header", "form"):
                break
        if name not in INLINE and not skipped:
            flush()
        if name in VOID:
            continue
        attributes = {a.lower(): unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(raw)} if _NAMED.search(raw) else {}
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = close.end() if close else n
            continue
        stack.append((name, (skipped, bad, mark, article, box)))
        links += name == "a"
        if skipped := skipped or never_text(name, attributes) or (name == "label" and any(x[0] == "form" for x in stack)):
            continue
        marked, sure = is_article(name, attributes), bad_name(name, attributes)
        if sure is not None:
            page.bad_around.append(bad)
            page.sure.append(sure)
            page.holds_mark.append(False)
            page.is_mark.append(marked)
            if name == "header" and mark:
                headers[len(page.sure) - 1] = headers.get(bad, bad)
            bad = len(page.sure) - 1
        if marked:
            around = bad
            while around:
                page.holds_mark[around] = True
                around = page.bad_around[around]
            if not mark:
                marks += 1
                mark = marks
        if name == "article":
            page.article_around.append(article)
            article = len(page.article_around) - 1
        if name in CONTAINERS:
            page.around.append(box)
            box = len(page.around) - 1
    if not skipped:
        flush()
    held = Counter(x.box for x in page.lines)
    held.update(page.around[1:])
    for k, x in enumerate(page.lines):
        if k in own and held[x.box] == 1:
            x.box = page.around[x.box]
    return page


def between(lengths: np.ndarray, window: int = WINDOW, surge: int = SURGE) -> np.ndarray:
    """Which lines lie between a surge and its dive.

    The block sum of line i covers the lines i to i + window - 1.  A surge is a line with text whose block sum reaches
    ``surge``; the dive that follows is the first line from which a whole block has less than ``surge``."""
    n = len(lengths)
    keep = np.zeros(n, bool)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    block = sums[np.minimum(np.arange(n) + window, n)] - sums[:n]
    i = 0
    while i < n:
        if block[i] >= surge and lengths[i] > 0:
            j = i
            while j < n and block[j] >= surge:
                j += 1
            # the window that dives has less than the threshold: its own lines are out, unless it is the text's last window
            end = j
            while end < n and lengths[end] > 0 and block[end] > 0 and end - j < window - 1:
                end += 1
            keep[i:end] = True
            i = end
        else:
            i += 1
    return keep


def joined(lengths: np.ndarray, keep: np.ndarray, boxes: np.ndarray, around: list[int], window: int = WINDOW) -> np.ndarray:
    """The kept lines and the lines with text that belong to them: between two surges, or in the container of a surge."""
    if not keep.any():
        if not lengths.any():
            return keep
        # no surge anywhere: the densest block, the first of several
        sums = np.concatenate([[0], np.cumsum(lengths)])
        at = int(np.argmax(sums[np.minimum(np.arange(len(lengths)) + window, len(lengths))] - sums[:-1]))
        keep = np.zeros(len(lengths), bool)
        keep[at : at + window] = lengths[at : at + window] > 0
    places = np.flatnonzero(keep)
    near = np.zeros(len(lengths), bool)
    near[places[0] : places[-1]] = True
    held = np.zeros(len(around), bool)
    held[boxes[keep & (lengths > 0)]] = True
    page, held[0] = held[0], False
    for box in range(1, len(around)):
        held[box] |= held[around[box]]
    held[0] = page  # the page holds the lines in no other container only
    return keep | ((lengths > 0) & (near | held[boxes]))


def reaches(lengths: np.ndarray, window: int, surge: int) -> bool:
    """Whether there is a surge: some block sum reaches the threshold."""
    sums = np.concatenate([[0], np.cumsum(lengths)])
    return bool((sums[np.minimum(np.arange(len(lengths)) + window, len(lengths))] - sums[:-1]).max(initial=0) >= surge)


def heaviest_run(lengths: np.ndarray, window: int, surge: int) -> int:
    """Most text between a surge and its dive; 0 without a surge."""
    if not reaches(lengths, window, surge):
        return 0
    keep = between(lengths, window, surge)
    runs = np.cumsum(np.diff(keep.astype(np.int8), prepend=0) == 1)
    return int(np.bincount(runs, np.where(keep, lengths, 0)).max(initial=0))


def acquitted(page: Page, window: int, surge: int) -> np.ndarray:
    """Which lines count: those in no element with a bad name, but for the names that the distribution outweighs.

    Elements are numbered as they open, so that those inside one follow it without a gap; what each of them holds is summed up once, from the inside out."""
    n = len(page.sure)
    lengths = np.array([x.length for x in page.lines], np.int64)
    bad = np.array([x.bad for x in page.lines])
    marked = np.array([x.mark > 0 for x in page.lines])
    text, in_marks = np.bincount(bad, lengths, n).astype(np.int64), np.bincount(bad, np.where(marked, lengths, 0), n).astype(np.int64)
    own = np.bincount(bad, minlength=n) > 0
    end, nearest_sure = list(range(1, n + 1)), [0] * n
    for k in range(n - 1, 0, -1):
        around = page.bad_around[k]
        end[around] = max(end[around], end[k])
        if page.sure[k] != SURE:
            text[around] += text[k]
            in_marks[around] += in_marks[k]
    for k in range(1, n):
        nearest_sure[k] = k if page.sure[k] == SURE else nearest_sure[page.bad_around[k]]
    below_sure = np.array(nearest_sure)[bad]
    inside: dict[int, list[int]] = {}
    for k in range(1, n):
        inside.setdefault(page.bad_around[k], []).append(k)
    surges: dict[int, bool] = {}

    def has_surge(k: int) -> bool:
        if k not in surges:
            surges[k] = reaches(np.where((bad >= k) & (bad < end[k]) & (below_sure <= k), lengths, 0), window, surge)
        return surges[k]

    good = np.zeros(n, bool)
    good[0] = True
    # all but what can never be acquitted; the heaviest first
    open_ = [(-int(text[k]), k) for k in inside.get(0, [])]
    heapq.heapify(open_)
    counts = good[bad]
    outside, nothing = heaviest_run(np.where(counts, lengths, 0), window, surge), not lengths[counts].any()
    while True:
        passed, choice = [], 0
        while open_ and open_[0][0] < 0:
            _, k = entry = heapq.heappop(open_)
            sure, holds = page.sure[k], page.holds_mark[k]
            allowed = nothing and (page.is_mark[k] or holds) if sure == SURE else holds or (sure == LOOSE and not outside)
            if allowed and (sure == LOOSE and PRIOR * int(in_marks[k]) > outside if outside else sure != LOOSE or (nothing and holds) or has_surge(k)):
                choice = k
                break
            passed.append(entry)
        if not choice:
            return good[bad]
        good[choice] = True
        for k in inside.get(choice, []):
            heapq.heappush(open_, (-int(text[k]), k))
        if own[choice]:  # else nothing has changed, and what didn't fit still doesn't
            for entry in passed:
                heapq.heappush(open_, entry)
            counts = good[bad]
            outside, nothing = heaviest_run(np.where(counts, lengths, 0), window, surge), not lengths[counts].any()
        else:
            waiting = passed
            open_ += waiting
            heapq.heapify(open_) if waiting else None


def main_text(html: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The article's blocks, joined by an empty line; empty if there is none."""
    page = read(html or "")
    if not page.lines:
        return ""
    counts = acquitted(page, window, surge) if len(page.sure) > 1 else np.ones(len(page.lines), bool)
    lines = [x for x, c in zip(page.lines, counts, strict=True) if c]
    if not lines:
        return ""
    lengths, marks = np.array([x.length for x in lines], np.int64), np.array([x.mark for x in lines])
    free = np.where(marks == 0, lengths, 0)
    # Groups of marked lines: an article element, or what a mark holds outside article elements.
    groups = np.array([0 if not x.mark else x.article or -x.mark for x in lines])
    heads: dict[int, int] = {}
    weight = {g: int(lengths[groups == g].sum()) for g in dict.fromkeys(groups[groups != 0].tolist())}
    for k in range(len(lines) - 1, -1, -1):
        heads[int(groups[k])] = k
    outside = heaviest_run(free, window, surge) or (0 if weight and max(weight.values()) else int(free.max(initial=0)))
    largest = max(weight, key=lambda g: (heaviest_run(np.where(groups == g, lengths, 0), window, surge), weight[g])) if weight else 0
    if largest and (PRIOR * weight[largest] >= outside):
        keep = np.zeros(len(lines), bool)
        home = lines[heads[largest]].mark
        for g, text in weight.items():
            teaser = lengths[heads[g]] == 0
            nested = g > 0 and page.article_around[g] > 0
            if g == largest or (g == -home) or (2 * text >= weight[largest] and not teaser and not nested) or (g > 0 and g == page.article_around[max(largest, 0)]):
                keep |= groups == g
        first = int(np.argmax(keep))
        if first and lines[first - 1].block == "h1" and not lines[first - 1].mark and not any(x.block == "h1" for x, k in zip(lines, keep, strict=True) if k):
            keep[first - 1] = True  # the title right before the mark
    else:
        keep = joined(free, between(free, window, surge), np.array([x.box for x in lines]), page.around, window)
        last = np.flatnonzero(keep)
        if len(last) > 1 and _RIGHTS.match(lines[last[-1]].text):
            keep[last[-1]] = False
    return "\n\n".join(x.text for x, k in zip(lines, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", out: str = "text", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """Replaces the column ``html`` by ``out``, the main text of each page."""
    kept = [f for f in pages.schema.fields if f.name not in (html, out)]
    schema = T.StructType([*kept, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("pages")
        for whole in batches:
            for batch in by_bytes(whole, html):
                texts = [main_text(x, window, surge) for x in batch.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], names=schema.fieldNames())

    return pages.select(*(f.name for f in kept), html).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: main text of every page."""
    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
