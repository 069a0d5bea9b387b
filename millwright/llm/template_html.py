"""Main-text extraction by equivalence-class template deduction (operator 8).

Over all pages of a host, every tag token - told apart by its full path of open elements with
their classes - gets an occurrence vector: how often it stands on each page. The vector is
kept as a sum of per-page hashes weighted by count, so it is aggregated by Spark like any
sum and no host is ever gathered in one task. Tokens of one host with equal vectors form an
equivalence class; classes that stand on most pages of the host, a fixed number of times and
inside one another (by path), nest into the host's template. The same is done for text
strings: a string that stands on most pages is template text.

What lies between template tokens are the slots. Slots inside menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments are dropped; the
content slot is the template's article or main element, or, on hosts without one that holds
enough of the text, the template element with most of the remaining text. A class word
(as in 'with-sidebar') drops no element around the content slot. Inside the slot, template text goes
where its element holds nothing else; a repeated string among changing ones stays. A page on
which the slot's element does not stand exactly once deviates from its host's template:
there article and main elements decide, and without them all text but the template's is
kept. The slot's text is returned block by block.

Edge cases: null and empty html give an empty text; a page without a host takes part as a
host of its own name ''; broken and cut-off markup is read to the end; hosts with fewer than
``LEAST_PAGES`` pages have no template text (too few pages to tell it from content); repeated
pages count as pages; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import written
from millwright.llm.host_reputation import url_parts

LEAST_PAGES = 5       # of a host, for template text
SHARE = 0.6           # of a host's pages that a template class stands on
WRAPPED = 0.1         # of a host's text; class words that leave less name a wrapper of the page
BOXED = 0.9           # of the texts at a path; where so many are template text, the element is a box of it

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|aria-label|hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title svg math iframe object".split())
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I | re.A) for tag in _RAW}
_INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSED_BY = {"p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
              "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
              "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"])}
_AROUND = frozenset("nav header footer aside form button select label dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: words in a class or id that name what is not the article
_NOT_TEXT = frozenset("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
                      "header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent notice notices alert popup modal overlay "
                      "newsletter subscribe subscription signup login comment comments disqus reply replies respond form search pagination pager skip".split())
_MAIN = ("article", "main")


def _names(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attributes)} if attributes and "=" in attributes or "hidden" in attributes else {}


class _Node:
    """An open element: ``path`` names the full path of block elements down to it."""

    __slots__ = ("tag", "parent", "path", "depth", "hard", "soft", "own", "whole")

    def __init__(self, tag: str, parent: _Node | None, path: int, depth: int, hard: bool, soft: bool):
        self.tag, self.parent, self.path, self.depth, self.hard, self.soft = tag, parent, path, depth, hard, soft
        self.own = self.whole = 0


class _Page:
    """One reading of a page: its elements and texts in page order, and the count of every tag path.

    An element is dropped with all below it by its tag, role or style (hard), or by a word of
    its class or id (soft). A soft drop does not hold for an element around the page's slot.
    """

    def __init__(self, html: str):
        self.tags: Counter[int] = Counter()
        self.nodes: list[_Node] = [_Node("", None, 0, 0, False, False)]
        self.texts: list[tuple[_Node, int, str]] = []                   # element, block number, raw text
        stack: list[_Node] = self.nodes[:]
        block = at = 0
        while m := _TOKEN.search(html, at):
            if m.start() > at:
                self.texts.append((stack[-1], block, html[at:m.start()]))
            at = m.end()
            if not m[2]:
                continue
            tag = m[2].lower()
            if tag not in _INLINE:
                block += 1
            elif tag == "br":
                self.texts.append((stack[-1], block, " "))
            if m[1]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k:]
                        break
                    if stack[k].tag in _MAIN and tag in _INLINE:
                        break
                continue
            if tag in _RAW:
                if not m[3].endswith("/"):                              # only its end tag counts, whatever looks like a tag before it
                    end = _RAW_END[tag].search(html, at)
                    at = end.end() if end else len(html)
                continue
            while tag in _CLOSED_BY.get(stack[-1].tag, ()):
                stack.pop()
            if tag not in _INLINE and tag in _CLOSED_BY["p"] and any(x.tag == "p" for x in stack):
                k = max(k for k, x in enumerate(stack) if x.tag == "p")
                if all(x.tag in _INLINE for x in stack[k + 1:]):        # an open inline element does not keep a paragraph open
                    del stack[k:]
            names = _names(m[3])
            words = set(_SPLIT.split(f"{names.get('class', '')} {names.get('id', '')}".lower()))
            hard = tag in _AROUND or names.get("role", "").lower() in _ROLES or "hidden" in names or "display:none" in names.get("style", "").replace(" ", "")
            soft = not words.isdisjoint(_NOT_TEXT)
            if tag in ("html", "body", *_MAIN):
                hard = soft = False
            parent = stack[-1]
            node = _Node(tag, parent, parent.path, parent.depth, hard, soft)
            if tag not in _INLINE:
                node.path, node.depth = _hash(f"{parent.path:x}", tag, names.get("class", "")), parent.depth + 1
                self.tags[node.path] += 1
            self.nodes.append(node)
            if tag not in _VOID and not m[3].endswith("/"):
                stack.append(node)
        if at < len(html):
            rest = html[at:]
            self.texts.append((stack[-1], block, rest if not rest.startswith("<") else ""))

    def _lifted(self, slots: list[_Node]) -> set[_Node]:
        """The elements around the slots: those given and, where every article or main stands below a class word, the main or the longest article."""
        found: set[_Node] = set()
        for slot in slots:
            node: _Node | None = slot
            while node and node not in found:
                found.add(node)
                node = node.parent
        hard, soft = {id(x): False for x in self.nodes}, {id(x): False for x in self.nodes}
        for x in self.nodes[1:]:
            hard[id(x)] = x.hard or hard[id(x.parent)]
            soft[id(x)] = x.soft and x not in found or soft[id(x.parent)]
        named = [x for x in self.nodes if x.tag in _MAIN and not hard[id(x)]]
        if named and all(soft[id(x)] for x in named):
            length: Counter[int] = Counter()
            for x, _, raw in self.texts:
                length[id(x)] += len(raw)
            for x in reversed(self.nodes[1:]):
                length[id(x.parent)] += length[id(x)]
            node = max(named, key=lambda x: (x.tag == "main", length[id(x)]))
            while node:
                found.add(node)
                node = node.parent
        return found

    def kept(self, slots: list[_Node]) -> tuple[list[tuple[_Node, int, str]], list[tuple[_Node, int, str]]]:
        """The texts that stay, and those that a class word drops."""
        lifted = self._lifted(slots)
        state = {id(self.nodes[0]): 0}
        for x in self.nodes[1:]:
            state[id(x)] = 2 if x.hard else max(state[id(x.parent)], int(x.soft and x not in lifted))
        return [t for t in self.texts if state[id(t[0])] == 0], [t for t in self.texts if state[id(t[0])] == 1]

    def weigh(self) -> list[tuple[_Node, str, bool]]:
        """The blocks outside hard drops, with whether they stay; sets of every element the characters kept below
        it (``whole``) and those kept if only class words below it counted (``own``)."""
        lifted = self._lifted([])
        kept, dropped = self.kept([])
        blocks = [(x, text, True) for x, text in _blocks(kept)] + [(x, text, False) for x, text in _blocks(dropped)]
        for x, text, stays in blocks:
            x.own += len(text)
            x.whole += len(text) * stays
        for x in reversed(self.nodes[1:]):
            x.parent.whole += x.whole
            if not x.hard and not (x.soft and x not in lifted):
                x.parent.own += x.own
        return blocks

    def at(self, path: int | None) -> list[_Node]:
        return [x for x in self.nodes if x.path == path and x.tag not in _INLINE] if path else []


def _below(texts: list[tuple[_Node, int, str]], tops: list[_Node]) -> list[tuple[_Node, int, str]]:
    """The texts below one of the elements."""
    known: dict[int, bool] = {id(x): True for x in tops}

    def below(x: _Node) -> bool:
        way = []
        while id(x) not in known and x.parent:
            way.append(x)
            x = x.parent
        found = known.get(id(x), False)
        known.update((id(w), found) for w in way)
        return found

    return [t for t in texts if below(t[0])]


def _hash(*parts: str) -> int:
    """A positive 63-bit hash, never 0."""
    import xxhash

    return xxhash.xxh64_intdigest("\x1f".join(parts).encode("utf-8", "surrogatepass"), 8) >> 1 or 1


def _blocks(texts: list[tuple[_Node, int, str]]) -> Iterator[tuple[_Node, str]]:
    """(element, text) per block: the pieces between two block tags, decoded, white space joined, trimmed."""
    k = 0
    while k < len(texts):
        last = k
        while last + 1 < len(texts) and texts[last + 1][1] == texts[k][1]:
            last += 1
        raw = "".join(t[2] for t in texts[k:last + 1])
        text = " ".join((unescape(raw) if "&" in raw else raw).split())
        if text:
            yield texts[k][0], text
        k = last + 1


def tokens(pages: DataFrame) -> DataFrame:
    """(host, kind, token, at, depth, named, pages, count, vector, chars, own): kind 0 tag paths, 1 texts (``at``: their path), 2 pages,
    3 paths that hold texts; tokens on one page only are left out."""
    sums_of = ("pages", "count", "vector", "chars", "own")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            total: dict[tuple[str, int, int, int, int, bool], list[int]] = {}

            def add(key: tuple[str, int, int, int, int, bool], page: int, count: int, chars: int = 0, own: int = 0) -> None:
                row = total.setdefault(key, [0, 0, 0, 0, 0])
                for k, x in enumerate((1, count, page * count % (1 << 40), chars, own)):
                    row[k] += x

            for host, mark, html in zip(pdf["host"], pdf["mark"], pdf["html"], strict=True):
                page, seen = _Page(html), int(mark)
                add((host, 2, 0, 0, 0, False), seen, 1)
                texts: Counter[tuple[int, int]] = Counter()
                for x, text, _ in page.weigh():
                    texts[_hash(f"{x.path:x}", text), x.path] += 1
                sizes: dict[int, tuple[int, bool, int, int]] = {}
                for x in page.nodes[1:]:
                    if x.tag not in _INLINE:
                        _, _, chars, own = sizes.get(x.path, (0, False, 0, 0))
                        sizes[x.path] = x.depth, x.tag in _MAIN, chars + x.whole, own + x.own
                for path, (depth, named, chars, own) in sizes.items():
                    add((host, 0, path, 0, depth, named), seen, page.tags[path], chars, own)
                held: Counter[int] = Counter()
                for (text, path), count in texts.items():
                    add((host, 1, text, path, 0, False), seen, count)
                    held[path] += count
                for path, count in held.items():
                    add((host, 3, path, 0, 0, False), seen, count)
            keys = list(total)
            yield pd.DataFrame({"host": pd.Series([k[0] for k in keys], dtype=object), **{n: [k[i] for k in keys] for i, n in enumerate(("kind", "token", "at", "depth", "named"), 1)},
                                **{n: [total[k][i] for k in keys] for i, n in enumerate(sums_of)}})

    found = pages.mapInPandas(read, "host string, kind int, token long, at long, depth int, named boolean, pages long, count long, vector long, chars long, own long")
    sums = found.groupBy("host", "kind", "token", "at", "depth", "named").agg(*[F.sum(F.col(c).cast("decimal(38,0)") if c == "vector" else c).alias(c) for c in sums_of])
    return sums.filter("kind = 2 or pages > 1")


def templates(pages: DataFrame) -> DataFrame:
    """(host, content, constant, boxed): the content element of each host's template, hashes of its template texts,
    and of those that stand in template elements without other text.

    Equivalence classes are the groups of equal (pages, count, vector); valid are those on
    most pages of the host. Valid classes of tag tokens that stand once on a page nest by path.
    The content element is the outermost article or main among them that holds ``1 - SHARE`` of
    the host's text outside menus and the like, or else the innermost element that holds
    ``SHARE`` of it. A host that class words would leave less than ``WRAPPED`` of its text
    has them on a wrapper: there the text counts that words below an element leave it.
    """
    rows = written(tokens(pages), "html-tokens")
    sizes = rows.filter("kind = 2").select("host", F.col("pages").alias("n"))
    valid = rows.filter("kind in (0, 1)").join(sizes, "host").filter(F.col("pages") >= F.greatest(F.lit(2), F.col("n") * SHARE))
    member = F.struct("token", "at", "depth", "named", "chars", "own")
    classes = valid.groupBy("host", "kind", "pages", "count", "vector").agg(F.collect_set(member).alias("members"), F.max("n").alias("n"))
    nested = classes.select("host", "kind", "n", "count", (F.col("count") == F.col("pages")).alias("once"), F.explode("members").alias("m")).select("host", "kind", "n", "count", "once", "m.*")
    tags = nested.filter("kind = 0 and once")
    most = tags.groupBy("host").agg(F.max("chars").alias("chars_most"), F.max("own").alias("own_most"))
    wrapped = F.col("chars_most") < WRAPPED * F.col("own_most")
    slots = tags.join(most, "host").select("host", "token", "depth", "named", F.when(wrapped, F.col("own")).otherwise(F.col("chars")).alias("size"), F.when(wrapped, F.col("own_most")).otherwise(F.col("chars_most")).alias("whole"))
    slots = slots.filter("size > 0").groupBy("host").agg(
        F.min(F.when(F.col("named") & (F.col("size") >= (1 - SHARE) * F.col("whole")), F.struct("depth", -F.col("size"), "token"))).alias("main"),
        F.max(F.when(F.col("size") >= SHARE * F.col("whole"), F.struct("depth", "size", "token"))).alias("dense"))
    content = slots.select("host", F.coalesce(F.col("main.token"), F.col("dense.token")).alias("content"))
    texts = nested.filter((F.col("kind") == 1) & (F.col("n") >= LEAST_PAGES)).select("host", "token", "at", "count")
    held = rows.filter("kind = 3").select("host", F.col("token").alias("at"), F.col("count").alias("all"))
    fixed = texts.groupBy("host", "at").agg(F.sum("count").alias("fixed"), F.collect_set("token").alias("tokens")).join(held, ["host", "at"])
    texts = fixed.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("constant"),
                                      F.array_sort(F.flatten(F.collect_list(F.when(F.col("fixed") >= BOXED * F.col("all"), F.col("tokens"))))).alias("boxed"))
    return written(sizes.select("host").join(content, "host", "left").join(texts, "host", "left"), "html-templates")


def main_text(html: str | None, content: int | None, constant: frozenset[int], boxed: frozenset[int] = frozenset()) -> str:
    """The text of the content slot of one page."""
    if not html:
        return ""
    page = _Page(html)
    slots = page.at(content)
    kept, _ = page.kept(slots)
    if len(slots) == 1:                        # the page fits its host's template
        inside = _below(kept, slots)
        if any(raw.strip() for _, _, raw in inside):
            return "\n".join(text for x, text in _blocks(inside) if not boxed or _hash(f"{x.path:x}", text) not in boxed)
    inside = _below(kept, [x for x in page.nodes if x.tag in _MAIN]) or _below(kept, slots)
    if inside:
        return "\n".join(text for x, text in _blocks(inside) if not boxed or _hash(f"{x.path:x}", text) not in boxed)
    return "\n".join(text for x, text in _blocks(kept) if not constant or _hash(f"{x.path:x}", text) not in constant)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page."""
    host, _ = url_parts(F.col("url"))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    mark = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("page_id"), F.lit(-1)), F.coalesce("url", F.lit(""))), 24)
    made = templates(rows.select("host", mark.alias("mark"), "html")).withColumnRenamed("host", "of")

    @F.pandas_udf("string")
    def slot(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for html, content, constant, boxed in batches:
            sets = [[frozenset(k) if k is not None else frozenset() for k in x] for x in (constant, boxed)]
            yield pd.Series([main_text(h, int(c) if c else None, *k) for h, c, *k in zip(html, content, *sets, strict=True)], dtype=object)

    return rows.join(made, F.col("host") == F.col("of"), "left").select("page_id", "url", slot("html", F.coalesce("content", F.lit(0)), "constant", "boxed").alias("text"))
