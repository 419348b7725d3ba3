"""HTML main text by tag-path ratios."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from starwright.llm.registry import query, table

SPREAD = 1.0  # deviation of the smoothing, in blocks
SHARE = 0.12  # of the best path's fused ratio that a path must reach
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[^<]+|<", re.S)
OPEN = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")  # with a quote that never ends
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
SPACES = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。，、！？；：]")
# fixed values: elements of the HTML standard by their role
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in sorted(RAW)}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
            "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
            "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
            "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"},
         "th": {"tr", "table"}, "option": {"select"}}
# elements that never hold text of an article, and those that seldom do outside of one
NEVER = {"head", "button", "select", "noscript", "template", "svg", "object", "audio", "video", "canvas", "map",
         "script", "style", "textarea", "iframe"}
SELDOM = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
# whole names (of class, id or role) of parts that seldom hold the article
SELDOM_NAMES = {
    "ad", "ads", "adv", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "nav", "navbar",
    "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "widget", "footer", "header", "masthead", "cookie",
    "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "login", "share",
    "sharing", "social", "related", "recommended", "comment", "comments", "commentlist", "respond", "disqus",
    "search", "pagination", "pager", "toc", "complementary", "contentinfo"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTED = {"li", "dt", "dd", "td", "th", "caption", "pre", "blockquote", "figcaption"}  # short text of an article


@dataclass
class Tree:
    """Elements of a page by number, each with the number of the one around it; 0 is none.

    Numbers grow inwards, so sums over all ancestors or descendants are one pass up or down the list.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])

    def add(self, parent: int, tag: str) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        return len(self.parent) - 1


class Block(NamedTuple):
    """A block of text: its tag path, its innermost aside, and the one around its article (-1: in none)."""

    path: int
    text: str
    linked: int
    aside: int
    outer: int


def blocks(page: str) -> tuple[list[Block], Tree, Tree]:
    """The blocks of text in page order, the tag paths, and the asides.

    A path is the block elements from the root down, with their class; equal paths have one number.
    ``linked`` counts the characters inside links. Character references are decoded, white space becomes one
    space. Asides are elements that seldom hold an article. Text of elements that never hold any is left
    out. Tags left open are closed as browsers do; a tag that never ends is text, one whose
    quote never ends is taken to its first ``>``.

    Open elements are found by their tag, so time is linear in the page, however deep it is nested.
    """
    out: list[Block] = []
    paths, asides = Tree(), Tree()
    known: dict[tuple[int, str], int] = {}
    stack: list[tuple[str, int, bool, int, int]] = [("", 0, False, 0, -1)]  # (tag, path, left out, aside, outer)
    opened: dict[str, list[int]] = defaultdict(list)  # places of a tag on the stack
    parts: list[str] = []
    linked = links = 0
    last = page.rfind(">")

    def flush() -> None:
        nonlocal linked
        text = SPACES.sub(" ", html.unescape("".join(parts))).strip(" ")
        if text:
            _, path, _, aside, outer = stack[-1]
            out.append(Block(path, text, linked, aside, outer))
        parts.clear()
        linked = 0

    def close_to(index: int) -> None:
        flush()
        while len(stack) > index:
            opened[stack.pop()[0]].pop()

    def innermost(tags: Iterable[str]) -> int:
        return max((opened[t][-1] for t in tags if opened.get(t)), default=0)

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at) if at < last or page[at] != "<" or page.startswith("<!--", at) else None
        if m is None:  # no tag ends from here on
            stop = page.find("<", at + 1)
            stop = end if stop < 0 else stop
            if not stack[-1][2]:
                parts.append(page[at:stop])
                linked += stop - at if links else 0
            at = stop
            continue
        if m[0] == "<":
            m = OPEN.match(page, at) or m
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                if not stack[-1][2]:
                    parts.append(text)
                    linked += len(text) if links else 0
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            continue
        if m[1]:
            if opened.get(tag):
                close_to(opened[tag][-1])
                links = 0
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                parts.append(" ") if tag == "br" else flush()
            continue
        if tag in RAW:
            flush()
            stop = RAW_END[tag].search(page, at)
            at = stop.end() if stop else end
            continue
        if tag in CLOSES_P and opened.get("p"):
            close_to(opened["p"][-1])
        if tag in SIBLINGS:
            sibling = innermost(SIBLINGS[tag])
            if sibling and sibling > innermost(SCOPE[tag] - SIBLINGS[tag]):
                close_to(sibling)
        flush()
        names = " ".join(v for a in ATTRIBUTE.finditer(m[3]) for v in a.groups()[1:] if v) if "=" in m[3] else ""
        _, path, away, aside, outer = stack[-1]
        away = tag != "body" and (away or tag in NEVER)
        if tag in SELDOM and not (tag == "header" and outer >= 0) or (
                names and tag not in HEADINGS and tag not in ("html", "body", "article", "main")
                and not SELDOM_NAMES.isdisjoint(structural(m[3], tag == "section" and outer >= 0))):
            aside = asides.add(aside, tag)
        if tag in ("article", "main") and outer < 0:
            outer = aside
        step = path, f"{tag}.{names}" if names else tag
        if step not in known:
            known[step] = paths.add(path, tag)
        opened[tag].append(len(stack))
        stack.append((tag, known[step], away, aside, outer))
        links = 0
    flush()
    return out, paths, asides


def structural(attributes: str, topic: bool) -> list[str]:
    """Names of class, id and role, in lower case; without the id if that names a ``topic``."""
    return [name for a in ATTRIBUTE.finditer(attributes) if not (topic and a[1].lower() == "id")
            for name in (a[2] or a[3] or a[4] or "").lower().split()]


def in_favour(found: list[Block], asides: Tree) -> list[Block]:
    """The blocks outside of asides, where a page has an article or main element with such blocks.

    Else an aside around an article or main element does not count inside it, and one that holds most
    of the page's unlinked text is none, unless it is nav or footer.
    """
    if any(b.outer >= 0 and not b.aside for b in found):
        return [b for b in found if not b.aside]
    text = [0] * len(asides.parent)
    for b in found:
        text[b.aside] += max(0, len(b.text) - b.linked)
    total = sum(text)
    for a in range(len(text) - 1, 0, -1):
        text[asides.parent[a]] += text[a]
    against = [0] * len(text)  # asides from one outwards that count as such
    for a in range(1, len(text)):
        real = asides.tag[a] in ("nav", "footer") or 2 * text[a] <= total
        against[a] = against[asides.parent[a]] + real
    return [b for b in found if against[b.aside] == against[max(b.outer, 0)]]


def main_text(page: str | None) -> str:
    """The content blocks of a page, joined by one space.

    Text length, punctuation and blocks are added up per tag path, links not counted. Each
    block gets its path's ratios (text per block and punctuation per block), both are smoothed over
    the page by a Gaussian, and fused by product. A path is content if its blocks' mean fused
    value reaches SHARE of the best path's; all blocks of a content path are kept, so a short
    paragraph among long ones is kept as well. Lists, tables, quotes and other short blocks are not
    cut for their length: a path with few links is kept if it is in an article or main element that
    holds content, or in the container of most content, either as a list, table, quote or the like or
    between content blocks; in body itself both are asked.
    """
    found, tree, asides = blocks(page or "")
    found = in_favour(found, asides)
    if not found:
        return ""
    paths = {p: i for i, p in enumerate(dict.fromkeys(b[0] for b in found))}
    owner = np.array([paths[b[0]] for b in found])
    chars = np.array([max(0.0, len(b[1]) - b[2]) for b in found])
    marks = np.array([len(PUNCTUATION.findall(b[1])) for b in found], float)
    marks *= chars / np.array([max(1, len(b[1])) for b in found])
    count = np.bincount(owner)
    text_ratio = (np.bincount(owner, chars) / count)[owner]
    mark_ratio = (np.bincount(owner, marks) / count)[owner]
    reach = int(3 * SPREAD)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SPREAD) ** 2)

    def smooth(x: np.ndarray) -> np.ndarray:
        weight = np.convolve(np.ones(len(x)), kernel, "full")[reach:-reach]
        return np.convolve(x, kernel, "full")[reach:-reach] / weight

    fused = smooth(text_ratio) * (1 + smooth(mark_ratio))
    value = np.bincount(owner, fused) / count
    if not value.max() > 0:
        return ""
    content = value >= SHARE * value.max()
    # a heading between content of the same parent belongs to it
    best = {tree.parent[p] or p for p, i in paths.items() if content[i]}  # or inside one without a parent
    for p, i in paths.items():
        if p and tree.parent[p] in best and tree.tag[p] in HEADINGS:
            content[i] = True
    nodes = len(tree.parent)
    own, sizes, first, final = [0] * nodes, [0] * nodes, [len(found)] * nodes, [-1] * nodes
    begin, stop = list(first), list(final)  # of content blocks of the path itself
    for k, (b, i) in enumerate(zip(found, owner)):
        if content[i]:
            own[b.path] += len(b.text)
            begin[b.path], stop[b.path] = min(begin[b.path], k), k
    for n in range(nodes - 1, 0, -1):  # sums over what is inside, without the path itself
        up = tree.parent[n]
        sizes[up] += sizes[n] + own[n]
        first[up], final[up] = min(first[up], first[n], begin[n]), max(final[up], final[n], stop[n])
    total = sum(own)
    article, listings, container = [0] * nodes, [0] * nodes, [0] * nodes
    for n in range(1, nodes):
        up, tag = tree.parent[n], tree.tag[n]
        article[n] = article[up] or (n if tag in ("article", "main") and final[n] >= 0 else 0)  # outermost with content
        listings[n] = listings[up] + (tag in LISTED)
        container[n] = n if 2 * sizes[n] >= total else container[up]  # innermost with half of the content or more
    length = np.bincount(owner, [len(b.text) for b in found])
    few_links = np.bincount(owner, chars) >= 0.5 * length
    kept = []
    for k, (b, i) in enumerate(zip(found, owner)):
        keep = content[i]
        if not keep and few_links[i]:
            if article[b.path]:
                keep = True
            else:
                home = container[tree.parent[b.path]]
                between = first[home] < k < final[home]
                listed = listings[b.path] > listings[home]
                plain = tree.tag[home] in ("", "html", "body")
                keep = between and listed if plain else between or listed
        if keep:
            kept.append(b.text)
    return " ".join(kept)


def extract_text(df: DataFrame, html_col: str = "html", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry..., text, n_chars`` of every row: the main text of its page by :func:`main_text`.

    NULL and empty pages give an empty text, and so do pages without content. Every page is read
    whole, in one pass without a shuffle; rows are independent, so repeated rows and NULLs elsewhere
    change nothing. Columns not in ``carry`` are dropped; an empty table gives no rows.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def batches(source: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts = [main_text(v.as_py()) for v in batch.column(len(carry))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(carry))], pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())], [*carry, "text", "n_chars"])

    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in carry], "text string", "n_chars long"])
    return df.select(*carry, df[html_col].alias("__html")).mapInArrow(batches, schema)


@query("op2_tag_path_text")
def op2_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), carry=("page_id", "url"))
