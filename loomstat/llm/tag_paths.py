"""Main-text extraction by tag-path ratios.

A page is read into text nodes, each with its root-to-leaf tag path (elements that only style text, such as ``b``, are no
steps of it). Paths are nodes of a tree that share their beginnings. Per path, text length and punctuation are summed and
divided by the number of text nodes (text-to-path and punctuation-to-path ratio). Both are smoothed over the path tree: a
path also counts all others, with a weight that falls by ``FALL`` a step, so that a heading next to long paragraphs is
lifted and a lone notice elsewhere is not; one pass up and one pass down the tree do it. The fused ratio is the geometric
mean of the two, times a prior: ``INSIDE`` for paths through an ``article`` or ``main`` element, ``PART`` for paths through a
part that a page has besides its article (menus, page headers and footers, asides, forms, or a class or id that names such a
part). Paths of at least ``KEEP`` of the page's largest value are content; parts never are.

Content chooses the article: the ``article`` and ``main`` elements that hold content, if most of it lies in such elements, else
the smallest container of all content. In it, everything is kept that is no part, whatever its ratio (lists, tables, code,
quotes), but for lists of links: a subtree without content of at least ``LINKS`` links that are ``LINK_SHARE`` of its text.

A name does not count if it only says what a part has (``has-sidebar``, ``comments-open``), if it names a header inside the
article, or if its element holds the article: the largest ``article`` or ``main``, if that has more text than all else so
marked that no name leaves out, or, on a page without these elements, most of the text.

The text is that of the content nodes in page order: character references decoded, white space inside a block one
space, trimmed, blocks joined by one line feed; nothing else is dropped or cut.

Time and memory are linear in the page: attributes are scanned once, elements share paths by parent pointers, and all sums go
up or down the trees once. Edge cases: null and empty pages, and pages without content, give an empty text; unclosed and
stray tags and quotes are tolerated (a block start ends an open paragraph; a quote opens a value only after ``=``); repeated
rows are extracted each; extra columns are ignored; an empty table gives an empty result. Memory holds one page at a time
besides the batch.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstat.llm.common import bounded_batches, tidy

KEEP = 0.3
FALL = 0.5  # of the smoothing's weight, a step of the path tree
INSIDE, PART = 2.0, 0.02  # priors
LINKS, LINK_SHARE = 3, 0.8

# Element kinds of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
STYLE = set("b i em strong u s small big font span mark code tt kbd samp var sub sup abbr acronym cite dfn q ins del bdi bdo wbr time data".split())
ENDS_PARAGRAPH = BLOCK - {"br", "body", "html"}
ENDS_ITSELF = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "menu"}
# Parts of a page that are never its article.
NEVER = set("nav footer aside form head button select label dialog menu object canvas audio video map".split()) | RAW
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?|cookies?|consent|notice|popup|modal|overlay|"
    r"sidebar|nav|navbar|navigation|menu|breadcrumbs?|masthead|header|footer|comments?|commentlist|disqus|replies|respond|related|"
    r"recommended|share|sharing|social|newsletter|subscribe|signup|login|widget|pagination|pager|toolbar|skip)(?=$|[\s_-]|\d)", re.I)
# Names of what a part has or how it is set, and names of headers.
MODIFIER = re.compile(r"(?:^|(?<=\s))(?:(?:has|no|with)[_-]\S*|\S*[_-](?:open|enabled))(?=$|\s)", re.I)
HEADERS = re.compile(r"[\s_-]*(?:header|masthead)", re.I)
ROLES = re.compile(r"(?:navigation|banner|contentinfo|complementary|search|form|dialog|alert|menu|menubar)\b", re.I)
HOLDS = {"article", "main"}
TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li dt dd td th tr caption pre blockquote figcaption a".split()) | STYLE  # no containers of an article

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PUNCT = re.compile(r"[.,;:!?…،。、！？]")


class _Path:
    """A node of the path tree with the sums of its own text nodes."""

    __slots__ = ("at", "above", "children", "length", "punct", "nodes", "part", "holds")

    def __init__(self, at: int, above: int, part: bool, holds: bool):
        self.at, self.above, self.children, self.part, self.holds = at, above, {}, part, holds
        self.length = self.punct = self.nodes = 0


class _Element:
    __slots__ = ("at", "tag", "label", "parent", "kind", "named", "wraps", "holds", "part", "path")

    def __init__(self, at: int, tag: str, label: str, parent: _Element | None, kind: bool = False, named: bool = False):
        self.at, self.tag, self.label, self.parent = at, tag, label, parent  # ``at``: place in the list of elements
        self.kind, self.named, self.wraps = kind, named, False  # a part by its kind; by its class or id, unless it wraps the article
        self.holds = tag in HOLDS or bool(parent and parent.holds)
        self.part, self.path = False, None


def _up(e: _Element | None) -> Iterator[_Element]:
    while e:
        yield e
        e = e.parent


def _named(value: str, tag: str, holds: bool) -> bool:
    """Whether a class or id names a part that is never the article."""
    found = (m[0] for m in NAMED.finditer(MODIFIER.sub("", value)))
    return not tag.startswith("h1") and any(not (holds and HEADERS.fullmatch(x)) for x in found)


def _tags(html: str) -> Iterator[tuple[int, int, re.Match | None, str]]:
    """(start, end, name match or None for comments and the like, attributes) of all tags; text lies between them."""
    at = scan = 0
    last, closed = html.rfind(">"), {'"': True, "'": True}
    while (start := html.find("<", scan)) >= 0:
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            end = len(html) if end < 0 else end + 3
        elif start > last:
            return
        elif html[start + 1] in "!?":
            end = html.find(">", start) + 1
        elif name := _NAME.match(html, start):
            i = name.end()
            while (stop := _STOP.search(html, i)) and stop[0] != ">":
                i, k = stop.end(), stop.start() - 1
                while html[k].isspace():
                    k -= 1
                if html[k] == "=" and closed[stop[0]]:
                    close = html.find(stop[0], i)
                    if close >= 0:
                        i = close + 1
                    else:
                        closed[stop[0]] = False  # nor will a later one find its end
            end = (stop.end() if stop else html.find(">", start) + 1)
            at = yield start, end, name, html[name.end() : end - 1]
            scan = at or end
            continue
        else:
            scan = start + 1
            continue
        yield start, end, None, ""
        scan = end


def nodes(html: str) -> tuple[list[_Element], list[tuple[_Element, int, str]]]:
    """All elements, parents first, and the text nodes as (element, block number, raw text)."""
    root = _Element(0, "#root", "", None)
    every, found, stack, opened, block, at = [root], [], [root], Counter(), 0, 0
    low = None

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    tags, skip = _tags(html), None
    while True:
        try:
            start, end, m, attributes = tags.send(skip)
        except StopIteration:
            break
        skip = None
        if start > at:
            found.append((stack[-1], block, html[at:start]))
        at = end
        if m is None:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            block += 1
        if m[1]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in VOID:
            continue
        if tag in ENDS_PARAGRAPH and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag in ENDS_PARAGRAPH:
                    break
        if tag in ENDS_ITSELF and any(opened[t] for t in ENDS_ITSELF[tag]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ENDS_ITSELF[tag]:
                    close(k)
                    break
                if stack[k].tag in SCOPES:
                    break
        kind, named, label = tag in NEVER, False, tag
        if tag == "header" and not stack[-1].holds:
            kind = True
        if attributes and tag not in ("html", "body"):
            for a in _ATTR.finditer(attributes):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    kind = True
                elif key == "role":
                    kind |= bool(ROLES.match(value))
                elif value and tag not in HOLDS:
                    named |= _named(value, tag, stack[-1].holds)
                    if key == "class":
                        label = tag + "." + value.split()[0] if value.split() else tag
        if attributes.endswith("/") and tag in ("svg", "math"):
            continue
        e = _Element(len(every), tag, label, stack[-1], kind, named)
        every.append(e)
        if tag in RAW:  # its text is no text of the page
            low = low or html.lower()
            shut = low.find("</" + tag, at) if len(low) == len(html) else html.find("</" + m[2], at)
            at = skip = len(html) if shut < 0 else shut
        stack.append(e)
        opened[tag] += 1
    if at < len(html):
        found.append((stack[-1], block, html[at:]))
    return every, found


def _summed(every: list[_Element], own: list[float]) -> list[float]:
    """Sums over whole subtrees, in place."""
    for e in reversed(every):
        if e.parent:
            own[e.parent.at] += own[e.at]
    return own


def _wrap(every: list[_Element], found: list[tuple[_Element, int, str]]) -> None:
    """Set ``wraps`` of the elements around the article, so that their names do not count, and then ``part``."""
    kind = [False] * len(every)
    named = False
    for e in every:
        kind[e.at] = e.kind or bool(e.parent and kind[e.parent.at])
        e.part = e.kind or e.named or bool(e.parent and e.parent.part)
        named |= e.named
    if not named:
        return
    size, clean = [0] * len(every), 0
    for e, _, raw in found:
        if not kind[e.at] and not raw.isspace():
            size[e.at] += len(raw)
            clean += len(raw) * (e.holds and not e.part)
    _summed(every, size)
    marked = [e for e in every if e.tag in HOLDS and size[e.at]]
    if marked:
        most = max(marked, key=lambda e: (e.tag == "article", size[e.at]))
        if size[most.at] > clean:
            for e in _up(most):
                e.wraps = True
    else:
        for e in every:
            e.wraps = 2 * size[e.at] > size[0]
    for e in every:
        e.part = e.kind or (e.named and not e.wraps) or bool(e.parent and e.parent.part)


def _paths(every: list[_Element], found: list[tuple[_Element, int, str]]) -> list[_Path]:
    """The path tree of a page, parents first, with every element's path and the sums of the text nodes."""
    out: list[_Path] = []
    for e in every:
        above = e.parent.path if e.parent else None
        if above and e.tag in STYLE and e.part == e.parent.part:
            e.path = above
            continue
        key = (e.label, e.part, e.holds)
        path = above.children.get(key) if above else None
        if path is None:
            path = _Path(len(out), above.at if above else -1, e.part, e.holds)
            out.append(path)
            if above:
                above.children[key] = path
        e.path = path
    for e, _, text in found:
        e.path.length += len(text)
        e.path.punct += len(_PUNCT.findall(text))
        e.path.nodes += 1
    return out


def content_paths(paths: list[_Path]) -> set[_Path]:
    """Paths whose smoothed, fused ratio, times its prior, reaches KEEP of the largest; ``paths`` lists parents first."""
    fused = [1.0] * len(paths)
    smooth = []
    for own in ([p.length / p.nodes if p.nodes else 0.0 for p in paths], [(p.punct + 1) / p.nodes if p.nodes else 0.0 for p in paths],
                [1.0 if p.nodes else 0.0 for p in paths]):
        for i in range(len(paths) - 1, 0, -1):  # what lies below, from the leaves up
            own[paths[i].above] += FALL * own[i]
        for i in range(1, len(paths)):  # and everything else, from the root down; the parent's own share of this path is taken out
            own[i] += FALL * (own[paths[i].above] - FALL * own[i])
        smooth.append(own)
    for i, p in enumerate(paths):
        fused[i] = math.sqrt(smooth[0][i] * smooth[1][i]) / smooth[2][i] * (PART if p.part else INSIDE if p.holds else 1.0) if p.nodes else 0.0
    least = KEEP * max(fused)
    return {p for p, v in zip(paths, fused, strict=True) if p.nodes and v >= least and not p.part}


def _article(every: list[_Element], content: list[tuple[_Element, int, str]]) -> set[_Element]:
    """Elements whose text is the article: the outermost article and main elements around content, if they hold most of it,
    or the smallest container of all content."""
    if 2 * sum(len(text) for e, _, text in content if e.holds) >= sum(len(text) for _, _, text in content):
        holder: list[_Element | None] = [None] * len(every)
        for e in every:
            holder[e.at] = (holder[e.parent.at] if e.parent else None) or (e if e.tag in HOLDS else None)
        return {holder[e.at] for e, _, _ in content if holder[e.at]}
    held = [0] * len(every)
    for e, _, _ in content:
        held[e.at] += 1
    _summed(every, held)
    smallest = next(e for e in reversed(every) if held[e.at] == len(content))  # the last and so the deepest that holds all
    while smallest.parent and smallest.tag in TEXTUAL:
        smallest = smallest.parent
    return {smallest}


def _kept(every: list[_Element], found: list[tuple[_Element, int, str]], content: set[_Path]) -> list[bool]:
    """For each element, whether its own text nodes belong to the text."""
    chosen = [x for x in found if x[0].path in content]
    out = [False] * len(every)
    if not chosen:
        return out
    roots = _article(every, chosen)
    in_link, length, linked, links, has = [False] * len(every), *([0] * len(every) for _ in range(4))
    for e in every:
        in_link[e.at] = e.tag == "a" or bool(e.parent and in_link[e.parent.at])
    for e, _, text in found:
        length[e.at] += len(text)
        linked[e.at] += len(text) * in_link[e.at]
        links[e.at] += in_link[e.at]
        has[e.at] += e.path in content
    for sums in (length, linked, links, has):
        _summed(every, sums)
    for e in every:
        i = e.at
        inside = e in roots or bool(e.parent and out[e.parent.at])
        menu = not has[i] and links[i] >= LINKS and linked[i] >= LINK_SHARE * length[i]
        out[i] = inside and not menu and (not e.part or e.path in content)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    every, raws = nodes(html)
    _wrap(every, raws)
    found = [(e, b, text) for e, b, raw in raws if (text := unescape(raw)) and not text.isspace()]
    kept = _kept(every, found, content_paths(_paths(every, found)))
    blocks: dict[int, list[str]] = {}
    for e, b, raw in raws:  # white space between nodes separates words
        if kept[e.at] or raw.isspace() and b in blocks:
            blocks.setdefault(b, []).append(unescape(raw))
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, url, text, n_chars."""

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in rows:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})
        tidy()

    bounded_batches(pages.sparkSession)
    # ids travel as text: pandas has no nullable long without loss
    out = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), "html").mapInPandas(
        run, "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast("long"))
