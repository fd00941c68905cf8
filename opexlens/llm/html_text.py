"""Main text of HTML pages by tag-path ratios.

A page is read into blocks of text, each under its root-to-leaf path of block
tags (inline tags belong to the block around them).  Per path, the text
length outside links and the punctuation of its blocks are summed and divided
by their number; both ratios are smoothed over neighbouring blocks and fused by
multiplication.  Class and id names of menus, adverts and the like are a weak
vote: they divide a path's ratio, unless the element holds most of the page's
text; standing in an article or main element multiplies it.  Paths above a
share of the weighted mean are content, and they alone decide where the text
is: the smallest element around all content blocks, or, if that is the page
itself, the elements around each of them.  What stands inside comes whole, in
page order, but for voted-down or linked blocks below the threshold.

Only elements that are no text by the standard (scripts, forms, navigation,
footers and so on) and reader comments are left out beforehand.

Pages are independent rows: Spark deals them out, nothing is shuffled.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opexlens.llm.common import table

# Names of the HTML standard and usual names of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup "
                   "time tt u var".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FURNITURE_TAGS = frozenset("head nav footer aside form script style noscript iframe template button select option textarea input menu dialog svg "
                           "canvas object audio video map noembed noframes title".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
FURNITURE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu "
                            "submenu breadcrumb breadcrumbs sidebar rail widget footer foot header masthead topbar toolbar cookie cookies consent gdpr "
                            "notice notices notification alert popup modal overlay share sharing social related recommended recommendations newsletter "
                            "subscribe subscription login signup search pagination pager copyright disclaimer skip teaser teasers".split())
# Words that may stand beside such a name without changing what it says.
NEUTRAL_NAMES = frozenset("site main top bottom left right global primary secondary box block blocks list area wrapper wrap container section bar inner "
                          "outer item items content text body link links panel group row col column title label unit slot".split())
CONTENT_TAGS = frozenset(("article", "main"))
P_CLOSERS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                      "header hr main menu nav ol p pre section table ul".split())
SIBLING_CLOSERS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
                   "option": ("option",)}
# Elements that hold one block of text each rather than a run of blocks.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody table ul ol dl figcaption figure caption address summary".split())
SCOPES = frozenset("ul ol dl table article section div main body html".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PART = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，！？؟।]")


COMMENT_NAMES = frozenset("comment comments disqus respond replies reply".split())
CLEAR, BY_NAME, SURE = 0, 1, 2
NAME_VOTE, CONTENT_VOTE = 0.04, 3.0
# Text share of the page from which an element's names are overruled.
# (and no article or main element stands elsewhere).
OVERRULED = 0.6


def _says(token: str, names: frozenset) -> bool:
    """Whether a whole class or id token is one of the names, or such names
    with neutral words (``site-footer``, not ``with-sidebar``)."""
    parts = {p.lower() for p in _PART.split(token) if p.strip("0123456789")}
    return bool(parts & names) and parts <= names | NEUTRAL_NAMES


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    """CLEAR, BY_NAME (only class or id say so: a vote) or SURE (tag, role, or
    reader comments)."""
    if tag in FURNITURE_TAGS or tag == "header" and not in_article:
        return SURE
    found = CLEAR
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body") else ():
        value = "".join(values)
        if name.lower() == "role":
            if value.strip().lower() in FURNITURE_ROLES:
                return SURE
            continue
        for token in value.split():
            if _says(token, COMMENT_NAMES):
                return SURE
            if tag not in CONTENT_TAGS and _says(token, FURNITURE_NAMES) and not (in_article and "header" in token.lower()):
                found = BY_NAME
    return found


def blocks(page: str) -> list[tuple[tuple, str, int, int]]:
    """(path of (tag, number) steps, text, characters inside links, number of the
    outermost element voted down by name or 0) of every text block outside
    furniture, in page order."""
    out: list[tuple[tuple, str, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # tag, number, furniture
    text: list[str] = []
    linked, at, number, links = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        if joined:
            voted = next((n for _, n, f in stack if f == BY_NAME), 0)
            out.append((tuple((t, n) for t, n, _ in stack if t not in INLINE), joined, linked, voted))
        text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links
        if any(t not in INLINE for t, _, _ in stack[to:]):
            flush()
        links -= sum(t == "a" for t, _, _ in stack[to:])
        del stack[to:]

    def add(raw: str) -> None:
        nonlocal linked
        if raw and not (stack and stack[-1][2] == SURE):
            value = html.unescape(raw)
            text.append(value)
            if links:
                linked += len(value.strip())

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break  # a stray end tag does not close blocks
            else:
                if tag == "p":
                    flush()
            continue
        if tag in VOID:
            if tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in P_CLOSERS:  # an open paragraph ends here
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] in SCOPES:
                    break
        for i in range(len(stack) - 1, -1, -1) if tag in SIBLING_CLOSERS else ():
            if stack[i][0] in SIBLING_CLOSERS[tag]:
                pop(i)
                break
            if stack[i][0] in SCOPES:
                break
        if tag not in INLINE:
            flush()
        number += 1
        outer = stack[-1][2] if stack else CLEAR
        if tag in CONTENT_TAGS and outer == BY_NAME:
            outer = CLEAR
        stack.append((tag, number, max(outer, _furniture(tag, m[3], any(t in CONTENT_TAGS for t, _, _ in stack)))))
        links += tag == "a"
        if m[3].rstrip().endswith("/") and tag not in INLINE and tag in FURNITURE_TAGS:
            pop(len(stack) - 1)
        elif tag in RAW:  # no markup inside
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            add(page[at:end.start()] if end else page[at:])
            at = end.end() if end else len(page)
            pop(len(stack) - 1)
    flush()
    return out


def _smooth(values: list[float]) -> list[float]:
    """Gaussian mean over the nearest five blocks."""
    weights, out = (0.04, 0.16, 0.6, 0.16, 0.04), []
    for i in range(len(values)):
        near = [(values[i + d - 2], w) for d, w in enumerate(weights) if 0 <= i + d - 2 < len(values)]
        out.append(sum(v * w for v, w in near) / sum(w for _, w in near))
    return out


def path_ratios(found: list[tuple[tuple, str, int, int]], voted: list[bool]) -> tuple[list[tuple], dict[tuple, float]]:
    """(path key of every block, ratio of every path).  Blocks voted down by
    name form paths of their own."""
    names = [(tuple(t for t, _ in path), v) for (path, _, _, _), v in zip(found, voted)]
    totals: dict[tuple, list[int]] = {}
    for name, (_, text, linked, _) in zip(names, found):
        sums = totals.setdefault(name, [0, 0, 0])
        sums[0] += len(text) - linked
        sums[1] += len(_PUNCTUATION.findall(text))
        sums[2] += 1
    length = _smooth([totals[n][0] / totals[n][2] for n in names])
    marks = _smooth([totals[n][1] / totals[n][2] for n in names])
    ratio: dict[tuple, list[float]] = {}
    for name, a, b in zip(names, length, marks):
        vote = (NAME_VOTE if name[1] else 1.0) * (CONTENT_VOTE if any(t in CONTENT_TAGS for t in name[0]) else 1.0)
        ratio.setdefault(name, []).append(vote * a * math.log1p(b + 1))
    return names, {n: sum(v) / len(v) for n, v in ratio.items()}


def _root(path: tuple) -> tuple:
    """The element around a content block: its article or main element, else
    the nearest one that groups blocks."""
    inside = next((i for i, (t, _) in enumerate(path) if t in CONTENT_TAGS), None)
    if inside is not None:
        return path[:inside + 1]
    while path and path[-1][0] in LEAVES:
        path = path[:-1]
    return path


def main_text(page: str, share: float = 0.35, link_share: float = 0.6) -> str:
    """The content blocks' regions, joined by line feeds; "" if there are none."""
    found = blocks(page)
    if not found:
        return ""
    sizes = [len(t) for _, t, _, _ in found]
    held: dict[int, int] = {}
    for (_, _, linked, element), size in zip(found, sizes):
        held[element] = held.get(element, 0) + size - linked
    marked = {e for path, _, _, e in found if any(t in CONTENT_TAGS for t, _ in path)}
    overruled = {e for e, n in held.items() if n >= OVERRULED * sum(held.values()) and not marked - {e}}
    voted = [e != 0 and e not in overruled for _, _, _, e in found]
    names, ratio = path_ratios(found, voted)
    # Mean weighted by text, so many tiny blocks do not lower it.
    mean = sum(ratio[n] * s for n, s in zip(names, sizes)) / sum(sizes)
    linked = [b[2] > link_share * s for b, s in zip(found, sizes)]
    content = [ratio[n] >= share * mean and not x for n, x in zip(names, linked)]
    if not any(content):
        return ""
    paths = [b[0] for b in found]
    common = None
    for path in (p for p, c in zip(paths, content) if c):
        if common is None:
            common = path
        while common != path[:len(common)]:
            common = common[:-1]
    common = _root(common)
    whole_page = not common or common[-1][0] in ("html", "body")
    roots = {_root(p) for p, c in zip(paths, content) if c} if whole_page else {common}
    wide = {r for r in roots if not r or r[-1][0] in ("html", "body")}
    out, lead = [], None
    for path, (_, text, _, _), name, c, v, x in zip(paths, found, names, content, voted, linked):
        inside = any(path[:i] in roots for i in range(len(path) + 1) if path[:i] not in wide)
        # Text right under the page counts with its neighbours of the same kind only.
        beside = bool(wide) and _root(path) in wide
        if c or (inside or beside) and not v and not x:
            if lead is not None and not out:
                out.append(lead)
            out.append(text)
        # A heading just before the text belongs to it.
        lead = text if path and path[-1][0] == "h1" and not v and not x else None
    return "\n".join(out)


def extract(df: DataFrame, column: str = "html") -> DataFrame:
    """``df`` without its html column plus ``text`` (main text, empty if
    none) and ``n_chars``; columns of these names are replaced.

    Null and empty pages give an empty text.  Repeated rows get equal
    results; an empty table gives no rows; a page of any length is read whole,
    its blocks held in memory."""
    names = [c for c in df.columns if c not in (column, "text", "n_chars")]

    def run(batches):
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(names))] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names + ["text", "n_chars"])

    kept = [df.schema[n] for n in names]
    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return df.select(*[F.col(f"`{n}`") for n in names], F.col(column).alias("__html")).mapInArrow(run, T.StructType(kept + added))


def op9_html(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
