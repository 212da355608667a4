"""Main text of web pages by a site style tree.

Pages of one host are merged by the paths of their block elements (tag and classes from the
root).  A path is a node of the style tree; its importance combines the entropy of the
presentations below it and of its contents over the host's pages.  Branches that repeat the same
few contents on many pages are removed; elements that the markup itself names as navigation,
advertisement and so on are always removed.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Collection, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import arrow_batches, written

#: Most (host, path) nodes of low importance that go to all executors; beyond it pages are joined with them by host.
MAX_BROADCAST_NODES = 100_000

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_SPECIAL = re.compile(r"[\"'>]")
_ATTRIBUTE = re.compile(r"([a-zA-Z:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: HTML element names by their part in a page.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul head button label object canvas video audio".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NOISE = frozenset("head nav footer aside form button select option optgroup label fieldset dialog menu search object canvas video audio".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promotion recommend recommended related reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar topbar tracking widget".split()
)
#: Elements whose content is no markup, and what ends each.
_RAW = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in ("script", "style", "noscript", "template", "textarea", "svg", "title", "iframe")}
_CLOSED_BY_BLOCK = "p"
_SIBLINGS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_NOT_INSIDE_P = _BLOCK - {"button", "label", "select", "option", "optgroup", "object", "canvas", "video", "audio"}


class _Node:
    __slots__ = ("tag", "path", "noise", "core", "plain", "low")

    def __init__(self, tag: str, path: int, noise: bool, core: bool, plain: bool, low: bool):
        self.tag, self.path, self.noise, self.core, self.plain, self.low = tag, path, noise, core, plain, low


def _open(tag: str, attributes: str, parent: _Node, low: Collection[int]) -> _Node:
    names, role, hidden = "", "", False
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += " " + value.lower()
            elif key == "role":
                role = value.lower()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                hidden = True
    words = set(re.findall(r"[a-z]+", names))
    noise = parent.noise or hidden or role in _NOISE_ROLES
    if tag not in ("html", "body", "main"):
        noise = noise or tag in _NOISE or bool(words & _NOISE_NAMES) or (tag == "header" or "header" in words) and not parent.core
    core = (tag in ("article", "main") or role in ("main", "article")) and not noise or parent.core
    step = f"{parent.path}/{tag}{'.' + '.'.join(sorted(words)) if words else ''}"
    path = xxhash.xxh3_64_intdigest(step) - (1 << 63)
    plain = (parent.plain or not parent.core) and (not core or tag in ("article", "main") or not words and tag not in ("div", "section"))
    return _Node(tag, path, noise, core, plain, parent.low or path in low)


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, stop, closing, tag, attributes) of a page's markup in order; the tag is empty for comments, raw elements and the like.

    One pass: what a search has found, or found missing, holds for all places before it.  A ``<``
    that begins no markup, or a tag whose quotes or bracket never close, is text.
    """
    n, at = len(page), 0
    last = {q: page.rfind(q) for q in "\"'><"}
    seen_from, seen = 0, -1  # the first special character from any place between them
    ends: dict[int, int] = {}  # of tags that reach the quote at a place; -1: they never end

    def special(i: int) -> int:
        nonlocal seen_from, seen
        if not seen_from <= i <= seen:
            m = _SPECIAL.search(page, i)
            seen_from, seen = i, m.start() if m else n
        return seen

    def end_of_tag(i: int) -> int:
        met = []
        while True:
            i = special(i)
            if i >= n:
                end = -1
            elif page[i] == ">":
                end = i + 1
            elif i in ends:
                end = ends[i]
            elif last[page[i]] <= i:
                end = -1
            else:
                met.append(i)
                i = page.index(page[i], i + 1) + 1
                continue
            ends.update(dict.fromkeys(met, end))
            return end

    while (lt := page.find("<", at)) >= 0:
        at = lt + 1
        if page.startswith("<!--", lt):
            stop = page.find("-->", lt + 4)
            at = n if stop < 0 else stop + 3
            yield lt, at, False, "", ""
            continue
        closing = page.startswith("/", lt + 1)
        name = _NAME.match(page, lt + 1 + closing)
        if name:
            stop = end_of_tag(name.end())
            if stop >= 0:
                tag = name[0].lower()
                if not closing and tag in _RAW:
                    m = _RAW[tag].search(page, stop)
                    at = m.end() if m else n
                    yield lt, at, False, "", ""
                else:
                    at = stop
                    yield lt, at, closing, tag, page[name.end() : stop - 1]
                continue
        if page[lt + 1 : lt + 2] in ("!", "?", "/") and lt + 1 < n:
            stop = page.find(">", lt) if last[">"] > lt else -1
            at = n if stop < 0 else stop + 1
            yield lt, at, False, "", ""
        elif name and last["<"] == lt and last[">"] < lt:  # cut off inside its last tag
            at = n
            yield lt, at, False, "", ""


def blocks(page: str | None, low: Collection[int] = ()) -> list[tuple[int, str, bool, bool, bool, bool]]:
    """Text blocks of a page in order: (path, text, noise, core, plain, low); null pages have none.

    ``path``: hash of the block's element and its ancestors, by tags and classes; ``noise``: the
    markup names the block or an ancestor as none of the article; ``core``: it stands in an article
    or main element; ``plain``: it and its ancestors up to the core have no class, id or generic
    container; ``low``: its path or that of an ancestor is among ``low``.
    """
    out: list[tuple[int, str, bool, bool, bool, bool]] = []
    stack = [_Node("", 0, False, False, True, False)]
    open_: Counter[str] = Counter()
    text: list[str] = []

    def end_block() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                top = stack[-1]
                out.append((top.path, words, top.noise, top.core, top.plain, top.low))

    def close(k: int) -> None:
        for node in stack[k:]:
            open_[node.tag] -= 1
        del stack[k:]

    page, at = page or "", 0
    for start, stop, closing, tag, attributes in tags(page):
        if start > at:
            text.append(page[at:start])
        at = stop
        if tag == "br":
            text.append(" ")
        if tag in _VOID or tag not in _BLOCK:
            if tag in ("hr", "img"):
                text.append(" ")
            continue
        end_block()
        if closing:
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in _NOT_INSIDE_P and stack[-1].tag == _CLOSED_BY_BLOCK:
            close(len(stack) - 1)
        alike = next((x for x in ({"dt", "dd"}, {"td", "th"}) if tag in x), {tag})
        if (bounds := _SIBLINGS.get(tag)) and any(open_[x] for x in alike):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in alike:
                    close(k)
                    break
        stack.append(_open(tag, attributes, stack[-1], low))
        open_[tag] += 1
    text.append(page[at:])
    end_block()
    return out


def extract(page: str | None, low: Collection[int] = ()) -> str:
    """The main text: blocks joined by line feeds.  ``low``: paths of low importance on the page's host.

    With an article or main element its blocks are the text, else all blocks outside noise.  Low
    paths go with all below them, but plain paragraphs and headings of an article never do.
    """
    found = [b for b in blocks(page, low) if not b[2]]
    core = [b for b in found if b[3]] or found
    return "\n".join(b[1] for b in core if b[3] and b[4] or not b[5])


def host_of(url: str | None) -> str:
    """Host of a URL in lower case; the empty string for null or a URL without one."""
    m = re.match(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def style_tree(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Nodes of each host's style tree: (host, path, pages, importance).

    Identical pages count once.  Content importance of a node is 1 - H / log(pages), where H is
    the entropy of the pages over the node's distinct contents turned round: contents that are
    all alike give 0, contents that never repeat give 1.  Presentation importance is the entropy
    of the number of blocks under the node over the pages, to the same base.  The node has the
    larger of both.  A node of one page has importance 1.
    """
    arrow_batches(pages.sparkSession)
    rows = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            host, page_key, path, content, count = [], [], [], [], []
            for url, page in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                nodes: dict[int, list[str]] = {}
                for p, words, noise, *_ in blocks(page):
                    if not noise:
                        nodes.setdefault(p, []).append(words)
                key = xxhash.xxh3_64_intdigest((page or "").encode("utf-8", "surrogatepass")) - (1 << 63)
                for p, words in nodes.items():
                    host.append(host_of(url))
                    page_key.append(key)
                    path.append(p)
                    content.append(xxhash.xxh3_64_intdigest("\n".join(words).encode("utf-8", "surrogatepass")) - (1 << 63))
                    count.append(len(words))
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(page_key, pa.int64()), pa.array(path, pa.int64()), pa.array(content, pa.int64()), pa.array(count, pa.int32())], ["host", "page", "path", "content", "count"])

    nodes = rows.mapInArrow(run, "host string, page long, path long, content long, count int").distinct()
    entropy = lambda n: -F.sum(n * F.log(n))  # noqa: E731  of counts, without their total
    by_content = nodes.groupBy("host", "path", "content").agg(F.count("*").alias("n"))
    contents = by_content.groupBy("host", "path").agg(F.sum("n").alias("pages"), entropy(F.col("n")).alias("same"))
    by_count = nodes.groupBy("host", "path", "count").agg(F.count("*").alias("n"))
    counts = by_count.groupBy("host", "path").agg(entropy(F.col("n")).alias("shape"))
    m = F.col("pages")
    # H of shares n / m is log m - sum(n log n) / m; divided by log m.
    share = lambda c: 1 + F.col(c) / (m * F.log(m))
    importance = F.when(m > 1, F.greatest(share("same"), share("shape") * F.lit(0.5))).otherwise(1.0)
    return contents.join(counts, ["host", "path"]).select("host", "path", "pages", importance.alias("importance"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", threshold: float = 0.3, least_pages: int = 8) -> DataFrame:
    """One row per page: id, url, text (empty if none), n_chars.

    Paths of importance under ``threshold`` on ``least_pages`` or more pages of their host are
    removed.  Null and empty pages have no text; repeated rows get a row each; pages without a
    host form one host.
    """
    nodes = style_tree(pages, url_col, html_col)
    low = written(nodes.filter((F.col("importance") < threshold) & (F.col("pages") >= least_pages)).select("host", "path"), "style")
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    schema = base.select(F.col("id").alias(id_col), "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def batch(b: pa.RecordBatch, paths: list) -> pa.RecordBatch:
        texts = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), paths, strict=True)]
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], [id_col, "url", "text", "n_chars"])

    if low.count() <= MAX_BROADCAST_NODES:
        by_host: dict[str, set[int]] = {}
        for host, path in low.collect():
            by_host.setdefault(host, set()).add(path)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield batch(b, [shared.value.get(host_of(u), ()) for u in b.column("url").to_pylist()])

        return base.mapInArrow(run, schema)
    host = F.lower(F.coalesce(F.nullif(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")), F.lit("")))
    joined = base.withColumn("host", host).join(low.groupBy("host").agg(F.collect_list("path").alias("paths")), "host", "left")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(b, [set(p or ()) for p in b.column("paths").to_pylist()])

    return joined.select("id", "url", "html", "paths").mapInArrow(run_joined, schema)
