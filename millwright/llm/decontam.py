"""Benchmark decontamination by q-gram lemma filtering (operator 1).

A document is contaminated when it quotes an item: some ``STRETCH`` consecutive characters of
the item, from any place in it (all of a shorter item), occur in the text within the edit
budget (``ERROR`` of the stretch, so that a replaced word passes). By the q-gram lemma e single
edits leave m - q + 1 - q e of the stretch's q-grams, within neighbouring diagonals; a replaced
word of w characters is one run of edits and costs only w + q - 1. The filter asks for the
q-grams that ``SINGLE`` scattered edits leave (as a share of the stretch), which a replaced word
of up to some 30 characters leaves as well. So, on the normalised text (ASCII lower case, runs
of white space as one space):

1. positions whose q-gram occurs in the benchmark are marked (rolling hash, bit table);
2. stretches with too few marks for any item are dropped (running sum);
3. the rest look up (item, diagonal) and are counted in overlapping diagonal bands;
4. in bands with enough shared q-grams, every stretch of the item is counted by its own q-grams
   (a running difference); those that reach the bound are verified by banded alignment, the
   fullest first, until one is within the budget.

The benchmark is the query set: it is read in blocks of at most ``BLOCK_CHARS`` characters, so
what travels to the tasks has a fixed bound; every document meets every block. Texts are
scanned whole, in overlapping blocks of bounded memory.

Edge cases: null and empty texts are clean; null, empty and very short (below q characters)
items match nothing; a text that ends (or begins) inside an item is judged by the stretch it
holds; repeated items report each id; repeated rows are judged alike; an empty benchmark leaves
all documents clean; extra columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.llm.common import ASCII_LOWER, ASCII_UPPER

Q = 10
STRETCH = 80
ERROR = 0.15                                  # edits of a stretch, as a share of its characters
SINGLE = 0.05                                 # scattered edits that its q-grams must survive
BLOCK_CHARS = 8_000_000
TEXT_BLOCK = 1 << 20
_TABLE = 22                                   # bits of the mark table
_BASE = 0x9E3779B97F4A7C15
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())
HIT = "array<struct<item_id:bigint,first:int,last:int,distance:int>>"


def normalise(text: str | None) -> str:
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    return b" ".join(words).decode("utf-8", "surrogatepass")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Polynomial hash of every q-gram, put together from grams of 1, 2, 4 ... characters."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, size, power, at = np.zeros(n, np.uint64), 1, _BASE, 0
    part = codes + np.uint64(1)
    while True:
        if q & size:
            h = h * np.uint64(power) + part[at:at + n]
            at += size
        if 2 * size > q:
            return h ^ (h >> np.uint64(29))
        part = part[:-size] * np.uint64(power) + part[size:]
        size, power = 2 * size, power * power % (1 << 64)


def _banded(a: str, b: str, budget: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the stretch of ``b`` closest to ``a``, if within ``budget`` edits.

    ``b`` is a window a few characters longer than ``a``; any start and end in it is free. Only
    the diagonals that the window leaves room for are filled.
    """
    at = b.find(a)
    if at >= 0:
        return 0, at, at + len(a)
    if len(b) < len(a) - budget:               # the text ends too early
        return None
    room = len(b) - len(a) + budget            # diagonals -budget .. room
    wide = room + budget + 1
    far = budget + 1
    row = [(0, j) if 0 <= (j := d - budget) <= len(b) else (far, 0) for d in range(wide)]
    for i in range(1, len(a) + 1):
        new = [(far, 0)] * wide
        for d in range(wide):
            j = i + d - budget
            if not 0 <= j <= len(b):
                continue
            best = (row[d][0] + (a[i - 1] != b[j - 1]), row[d][1]) if j else (i, 0)
            if d + 1 < wide:
                best = min(best, (row[d + 1][0] + 1, row[d + 1][1]))
            if d and j:
                best = min(best, (new[d - 1][0] + 1, new[d - 1][1]))
            new[d] = best
        row = new
        if min(row)[0] > budget:
            return None
    score, start, end = min((row[d][0], row[d][1], len(a) + d - budget) for d in range(wide))
    return (score, start, end) if score <= budget else None


class Benchmark:
    """Q-gram index of one block of items."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, stretch: int = STRETCH, error: float = ERROR, single: float = SINGLE):
        kept = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if len(t) >= q]
        self.q, self.ids, self.texts = q, [i for i, _ in kept], [t for _, t in kept]
        self.size = np.array([min(stretch, len(t)) for t in self.texts], np.int64)
        self.budget = (error * self.size).astype(np.int64)
        self.bound = np.maximum(1, self.size - q + 1 - q * (single * self.size).astype(np.int64))
        grams = [_grams(_codes(t), q) for t in self.texts]
        sizes = [len(g) for g in grams]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.gram = flat[order]
        self.part = np.repeat(np.arange(len(grams)), sizes)[order]
        self.offset = (np.concatenate([np.arange(n) for n in sizes]) if grams else np.zeros(0, np.int64))[order]
        self.mark = np.zeros(1 << _TABLE, bool)
        self.mark[(self.gram >> np.uint64(64 - _TABLE)).astype(np.int64)] = True
        self.longest = max(sizes, default=0)
        self.reach = int(self.size.max(initial=0))
        self.slack = int(self.budget.max(initial=0))

    def _bands(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(item, first diagonal, places) of the bands with enough shared q-grams in one text block; places: starts
        of the item's stretches that reach their bound, the fullest first."""
        grams = _grams(codes, self.q)
        marked = self.mark[(grams >> np.uint64(64 - _TABLE)).astype(np.int64)]
        reach = self.reach + self.slack
        run = np.concatenate(([0], np.cumsum(marked)))
        n = len(grams)
        ahead = run[np.minimum(np.arange(n) + reach, n)] - run[:n]
        starts = np.flatnonzero((ahead >= self.bound.min()) & marked)
        if not len(starts):
            return
        near = np.zeros(n + 1, np.int64)       # positions within reach of a dense start
        np.add.at(near, starts, 1)
        np.add.at(near, np.minimum(starts + reach, n), -1)
        at = np.flatnonzero(marked & (np.cumsum(near[:n]) > 0))
        lo, hi = np.searchsorted(self.gram, grams[at], "left"), np.searchsorted(self.gram, grams[at], "right")
        count = hi - lo
        at, lo, count = at[count > 0], lo[count > 0], count[count > 0]
        step = max(1, 4_000_000 // max(1, int(count.max(initial=1))))
        width = 2 * self.slack + 2             # bands of this width, each overlapping half of its neighbours

        def looked_up() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """(band, item offset) of the shared q-grams, a bounded number at a time."""
            for k in range(0, len(at), step):
                c = count[k:k + step]
                entry = np.repeat(lo[k:k + step] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
                diagonal = np.repeat(at[k:k + step], c) - self.offset[entry] + self.longest
                for shift in (0, width // 2):
                    yield (self.part[entry] * (1 << 40) + (diagonal + shift) // width) * 2 + (shift > 0), self.offset[entry]

        tally = [np.unique(key, return_counts=True) for key, _ in looked_up()]
        if not tally:
            return
        keys, where = np.unique(np.concatenate([t[0] for t in tally]), return_inverse=True)
        hits = np.bincount(where, np.concatenate([t[1] for t in tally]))
        keys = keys[hits >= self.bound[keys // 2 // (1 << 40)]]
        if not len(keys):
            return
        some = [(key[here], offset[here]) for key, offset in looked_up() if (here := np.isin(key, keys)).any()]
        key, offset = np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
        order = np.lexsort((offset, key))
        key, offset = key[order], offset[order]
        cuts = np.searchsorted(key, keys, "left").tolist()
        for band, a, b in zip(keys.tolist(), cuts, [*cuts[1:], len(key)], strict=True):
            part = band // 2 // (1 << 40)
            places = self._places(part, np.unique(offset[a:b]))
            if len(places):
                yield part, band // 2 % (1 << 40) * width - width // 2 * (band & 1) - self.longest, places

    def _places(self, part: int, shared: np.ndarray) -> np.ndarray:
        """Starts of the item's stretches that hold enough of the shared q-grams (by offset), the fullest first."""
        length, size = len(self.texts[part]), int(self.size[part])
        held = np.zeros(length + 1, np.int64)
        held[shared + 1] = 1
        held = np.cumsum(held)
        start = np.arange(length - size + 1)
        inside = held[start + size - self.q + 1] - held[start]
        good = np.flatnonzero(inside >= self.bound[part])
        return good[np.argsort(-inside[good], kind="stable")]

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, first, last, distance) per item found; the span is in the normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        if not text or not self.texts:
            return []
        text = normalise(text)
        overlap = 2 * (self.reach + 2 * self.slack + self.q)
        width = 2 * self.slack + 2
        for at in range(0, max(1, len(text)), TEXT_BLOCK):
            piece = text[at:at + TEXT_BLOCK + overlap]
            if len(piece) < self.q:
                continue
            for part, diagonal, places in self._bands(_codes(piece)):
                e, item = int(self.budget[part]), self.ids[part]
                for start in places.tolist():
                    stretch = self.texts[part][start:start + int(self.size[part])]
                    lo = max(0, diagonal + start - e)
                    hit = _banded(stretch, piece[lo:max(0, diagonal + start + width + len(stretch) + e)], e)
                    if hit:
                        new = (hit[0], at + lo + hit[1], at + lo + hit[2])
                        best[item] = min(best.get(item, new), new)
                        break
        return [(item, first, last, d) for item, (d, first, last) in sorted(best.items())]


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> list[list[tuple[int, str]]]:
    """The items in blocks of at most ``chars`` characters (an item longer than that is a block)."""
    items = benchmark.filter(F.col("item_id").isNotNull() & (F.length("text") >= Q)).select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // chars)
    if n <= 1:
        return [[(r["item_id"], r["text"]) for r in items.orderBy("item_id").collect()]] if n else []
    order = Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, 0)
    cut = items.withColumn("block", F.floor((F.sum(F.length("text")).over(order) - 1) / chars)).persist()
    found = sorted(r["block"] for r in cut.select("block").distinct().collect())
    out = [[(r["item_id"], r["text"]) for r in cut.filter(F.col("block") == b).collect()] for b in found]
    cut.unpersist()
    return out


def hits(text: Column, items: list[tuple[int, str]]) -> Column:
    @F.pandas_udf(HIT)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Benchmark(items)
        for batch in texts:
            yield pd.Series([[{"item_id": i, "first": a, "last": b, "distance": d} for i, a, b, d in index.search(t)] for t in batch], dtype=object)

    return search(text)


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows plus ``hits``: the benchmark items found in each text."""
    found = [hits(F.col("text"), items) for items in blocks(benchmark)]
    return docs.withColumn("hits", F.concat(*found) if found else F.array().cast(HIT))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The input rows without the contaminated documents."""
    columns = docs.columns
    found = [hits(F.col("text"), items) for items in blocks(benchmark)]
    for k, h in enumerate(found):
        docs = docs.withColumn(f"__hits{k}", F.size(h)).filter(F.col(f"__hits{k}") == 0)
    return docs.select(*columns)
