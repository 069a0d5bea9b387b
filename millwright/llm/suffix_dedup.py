"""Exact removal of repeated byte strings with suffix arrays (operator 3).

A byte goes when a string of ``LENGTH`` bytes covers it that also starts earlier in the corpus
(smaller doc_id, or earlier in the document).

1. Every window of LENGTH bytes is assigned to the smallest hash (leftmost on ties) of its
   ``GRAM``-byte grams. Equal windows have equal grams, so they agree on that hash; neighbouring
   windows mostly share it, so they travel together as one segment of text.
2. The hashes are counted over the corpus. Segments whose hash occurs once hold no repeat and
   are not looked at again.
3. The places of the others are shuffled by hash (a hash with more than ``HOT`` places is
   salted over several shards). Segments of equal content, known by a second 64-bit hash, are
   one string: all but the earliest are marked without moving any text.
4. Where one hash has several contents, their text is fetched and shuffled into shards. Each
   task sorts the suffixes of its shard by Larsson-Sadakane refinement - first by 8 bytes, then doubling, only inside groups that are
   still tied - and computes their common prefixes with Kasai's rule, in numpy. Suffixes in
   one run of common prefixes >= LENGTH are occurrences of one string: all but the earliest
   are marked.
5. The earliest strings of salted shards are dealt out by content and merged across shards by
   binary search in the sorted strings held so far; all but the earliest are marked.
6. The marks of a document are united and its bytes cut.

Edge cases: null text counts as empty; documents shorter than LENGTH lose nothing; rows that
repeat both id and text are one document (each gets the same result); of rows that share
only the id, the smaller text hash comes first; null ids come before all others; an empty
table gives no rows; extra columns are ignored. Cuts are by bytes, so ``kept`` is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import among, written

LENGTH = 100
GRAM = 24
HOT = 4096                  # segments of one hash in a shard
CHUNK = 1 << 19             # bytes hashed at once; positions in a chunk need at most 20 bits
SHARD = 2 << 20             # bytes of a suffix array, about
_SEPARATOR = b"\xff"        # never a byte of UTF-8
_MIX = [np.array(x, np.uint64) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


# ---- windows and their hashes ---------------------------------------------------------------

def _packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as a big-endian number; zeros behind the end."""
    x = np.concatenate((data, np.zeros(8, np.uint8))).astype(np.uint64)
    for size in (1, 2, 4):
        x = x[:-size] << np.uint64(8 * size) | x[size:]
    return x[:len(data)]


def _segments(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window, last window) of the segments of texts lying in ``data``."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _packed(data)
    grams = len(data) - GRAM + 1
    h = np.zeros(grams, np.uint64)
    for k in range(0, GRAM, 8):
        h = (h ^ words[k:k + grams]) * _MIX[k // 8]
        h ^= h >> np.uint64(32)
    h = (h * _MIX[0]) & np.uint64(~((1 << 20) - 1) & (1 << 64) - 1) | np.arange(grams, dtype=np.uint64)
    width, low, span = LENGTH - GRAM + 1, h, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[:len(low) - (width - span)], low[width - span:])
    edge = np.zeros(n + 1, np.int32)
    fits = lengths >= LENGTH
    np.add.at(edge, starts[fits], 1)
    np.add.at(edge, starts[fits] + lengths[fits] - LENGTH + 1, -1)
    inside = np.cumsum(edge[:n]) > 0
    new = np.ones(n, bool)
    new[1:] = low[1:n] != low[:n - 1]
    new[starts[fits]] = True
    first = np.flatnonzero(inside & new)
    stops = np.flatnonzero(new | ~inside)
    after = np.searchsorted(stops, first, "right")
    last = np.append(stops, n)[after] - 1
    return (low[first] >> np.uint64(20)).astype(np.int64), first, last


def _chunks(texts: list[bytes], contents: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """(hash, text number, first window, last window, content hash) of all texts, a bounded number of bytes at a time."""
    import xxhash

    held, size = [], 0

    def flush() -> tuple[np.ndarray, ...]:
        joined = b"".join(p for _, _, p in held)
        lengths = np.array([len(p) for _, _, p in held])
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        h, first, last = _segments(np.frombuffer(joined, np.uint8), starts, lengths)
        content = np.zeros(0, np.int64)
        if contents:
            view, digest = memoryview(joined), xxhash.xxh64_intdigest
            content = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + LENGTH).tolist(), strict=True)], np.uint64).view(np.int64)
        of = np.searchsorted(starts, first, "right") - 1
        shift = np.array([at for _, at, _ in held])[of] - starts[of]
        return h, np.array([k for k, _, _ in held])[of], first + shift, last + shift, content

    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) - LENGTH + 1), CHUNK):
            piece = text[at:at + CHUNK + LENGTH - 1]
            if size and size + len(piece) > CHUNK + LENGTH:
                yield flush()
                held, size = [], 0
            held.append((k, at, piece))
            size += len(piece)
    if held:
        yield flush()


def _bytes(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") for t in texts]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            found = [c[0] for c in _chunks(_bytes(pdf["text"][at:at + 1000]), False)]
            h, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
            yield pd.DataFrame({"h": h, "n": n})


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per segment; ``at`` holds its first window and, in the lowest byte, how many follow."""
    for pdf in batches:
        ids, tags = pdf["doc_id"].to_numpy(), pdf["tag"].to_numpy()
        for at in range(0, len(pdf), 1000):
            for h, of, first, last, content in _chunks(_bytes(pdf["text"][at:at + 1000]), True):
                yield pd.DataFrame({"h": h, "content": content, "doc_id": ids[at + of], "tag": tags[at + of], "at": first * 256 + (last - first)})


# ---- suffix arrays --------------------------------------------------------------------------

def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes of ``data`` in order. (Kasai's rule needs the whole order, not a prefix of it.)"""
    n = len(data)
    key = _packed(data)
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0)) + 1
    rank[n] = 0
    known = 8
    while True:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        part = order[at]
        pair = rank[part] * (n + 2) + rank[np.minimum(part + known, n)]
        by = np.argsort(pair, kind="stable")
        part, pair = part[by], pair[by]
        order[at] = part
        fresh = np.ones(len(at), bool)
        fresh[1:] = pair[1:] != pair[:-1]
        head[at] = fresh
        rank[part] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))] + 1
        known *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH, lanes: int = 32) -> np.ndarray:
    """Common prefix, up to ``most``, of each suffix in ``order`` with the one before it.

    Kasai's rule: dropping a suffix's first byte shortens its common prefix by one at most.
    Every ``lanes``-th position is compared from scratch, its followers go on from there, all
    lanes at once.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    key = np.concatenate((_packed(data), np.zeros(most + 8, np.uint64)))
    common = np.zeros(n, np.int64)
    for lane in range(min(lanes, n)):
        at = np.arange(lane, n, lanes)
        size = np.maximum(common[at - 1] - 1, 0) if lane else np.zeros(len(at), np.int64)
        todo = np.flatnonzero((before[at] >= 0) & (size < most))
        while len(todo):
            x, y, s = at[todo], before[at[todo]], size[todo]
            differ = key[x + s] ^ key[y + s]
            equal = np.full(len(todo), 8, np.int64)
            for k in range(8):
                equal -= differ >= np.uint64(1 << 8 * k)
            size[todo] = s + np.minimum(equal, n - np.maximum(x, y) - s)
            todo = todo[(differ == 0) & (size[todo] < most) & (np.maximum(x, y) + size[todo] < n)]
        size[before[at] < 0] = 0
        common[at] = np.minimum(size, most)
    return common[order]


def _repeats(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(repeated, part starts, earliest) for parts in corpus order.

    repeated: per byte of the joined parts, whether the string starting there also starts
    earlier; earliest: positions of strings that do not.
    """
    data = np.frombuffer(_SEPARATOR.join(parts) + _SEPARATOR, np.uint8)
    lengths = np.array([len(p) for p in parts])
    starts = np.concatenate(([0], np.cumsum(lengths[:-1] + 1)))
    edge = np.zeros(len(data) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths - LENGTH + 1, -1)
    whole = np.cumsum(edge[:-1]) > 0
    order = suffix_array(data)
    group = np.cumsum(common_prefixes(data, order) < LENGTH)
    keep = whole[order]
    order, group = order[keep], group[keep]
    lead = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(order) else np.zeros(0, np.int64)
    earliest = np.minimum.reduceat(order, lead) if len(order) else order
    repeated = whole.copy()
    repeated[earliest] = False
    return repeated, starts, earliest


_ROW = "h long, salt int, doc_id long, tag long, first int, part binary"
_SETTLED = "kind int, h long, salt int, doc_id long, tag long, first int, last int"   # kind 0: bytes first to last-1 go; 1: a content to compare
_MARK = "kind int, doc_id long, tag long, first int, last int, part binary"           # kind 0: as above; 1: string of a salted shard


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of segments whose content came earlier, and the contents of hashes that have several; rows come by (h, salt), then in corpus order."""
    columns = ["kind", "h", "salt", "doc_id", "tag", "first", "last"]
    group: tuple[int, int] | None = None
    seen: set[int] = set()
    held: list[tuple] = []
    for pdf in batches:
        out: list[tuple] = []
        for h, salt, content, doc, tag, at in zip(*(pdf[c].tolist() for c in ("h", "salt", "content", "doc_id", "tag", "at")), strict=True):
            if (h, salt) != group:
                if len(held) > 1 or held and held[0][2]:
                    out += held
                group, seen, held = (h, salt), set(), []
            a = at >> 8
            if content in seen:
                out.append((0, h, salt, doc, tag, a, a + (at & 255) + LENGTH))
            else:
                seen.add(content)
                held.append((1, h, salt, doc, tag, a, a + (at & 255) + LENGTH))
        yield pd.DataFrame(out, columns=columns)
    yield pd.DataFrame(held if len(held) > 1 or held and held[0][2] else [], columns=columns)


def _cut_segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The text of the wanted segments."""
    for pdf in batches:
        for at in range(0, len(pdf), 1000):
            out: list[tuple] = []
            part = pdf[at:at + 1000]
            for doc, tag, text, places in zip(part["doc_id"], part["tag"], part["text"], part["places"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(p["h"], p["salt"], doc, tag, p["first"], raw[p["first"]:p["last"]]) for p in places]
            yield pd.DataFrame(out, columns=["h", "salt", "doc_id", "tag", "first", "part"])


def _marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks and salted strings of the shards in one partition; rows come by (h, salt), then in corpus order."""
    columns = ["kind", "doc_id", "tag", "first", "last", "part"]

    def shard(held: list[tuple]) -> pd.DataFrame:
        out: list[tuple] = []
        held = sorted(held, key=lambda row: row[2:5])        # corpus order, also between the salts of one hash
        parts = [row[5] for row in held]
        repeated, starts, earliest = _repeats(parts)
        runs = np.flatnonzero(np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8))).reshape(-1, 2)
        for (a, b), k in zip(runs.tolist(), (np.searchsorted(starts, runs[:, 0], "right") - 1).tolist(), strict=True):
            row, off = held[k], a - int(starts[k])
            out.append((0, row[2], row[3], row[4] + off, row[4] + off + (b - a) + LENGTH - 1, None))
        salted = np.array([row[1] > 0 for row in held])
        of = np.searchsorted(starts, earliest, "right") - 1
        for a, k in zip(earliest[salted[of]].tolist(), of[salted[of]].tolist(), strict=True):
            row, off = held[k], a - int(starts[k])
            out.append((1, row[2], row[3], row[4] + off, row[4] + off + LENGTH, parts[k][off:off + LENGTH]))
        return pd.DataFrame(out, columns=columns)

    held: list[tuple] = []
    size = 0
    for pdf in batches:
        for row in pdf[["h", "salt", "doc_id", "tag", "first", "part"]].itertuples(index=False, name=None):
            if size > SHARD and (row[0], row[1]) != (held[-1][0], held[-1][1]):
                yield shard(held)
                held, size = [], 0
            held.append(row)
            size += len(row[5])
    if held:
        yield shard(held)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Marks of strings that an earlier shard holds too; rows come in corpus order, equal strings in one partition.

    Each batch is sorted and looked up by binary search in the sorted strings held so far;
    what is new is merged in.
    """
    held = np.zeros(0, f"S{LENGTH + 1}")
    for pdf in batches:
        part = np.array([p + b"\x01" for p in pdf["part"]], dtype=f"S{LENGTH + 1}")   # numpy drops trailing zero bytes
        kinds, first = np.unique(part, return_index=True)
        at = np.minimum(np.searchsorted(held, kinds), max(0, len(held) - 1))
        new = held[at] != kinds if len(held) else np.ones(len(kinds), bool)
        stays = np.zeros(len(part), bool)
        stays[first[new]] = True
        held = np.insert(held, np.searchsorted(held, kinds[new]), kinds[new])
        yield pdf[~stays][["doc_id", "tag", "first", "last"]]


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key_id, tag, repeated, text): key_id stands for null too; tag tells texts of one id apart, 0 where there is one;
    repeated: whether several rows have the id."""
    texts = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("key_id"), F.coalesce("text", F.lit("")).alias("text"))
    name = F.shiftleft(F.hash("text").cast("long"), 32) + F.pmod(F.xxhash64("text"), F.lit(1 << 32))     # in order of the 32-bit hash, then told apart by a second one
    several = texts.select("key_id", name.alias("x")).groupBy("key_id").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("*").alias("rows")).filter("rows > 1")
    several = written(several.select(F.col("key_id").alias("again"), (F.col("low") != F.col("high")).alias("differ")), "repeated-ids")
    tag = F.when(F.col("differ"), name).otherwise(F.lit(0).cast("long"))
    return texts.join(several, F.col("key_id") == F.col("again"), "left").select("doc_id", "key_id", tag.alias("tag"), F.col("again").isNotNull().alias("repeated"), "text")


def repeated_spans(keyed: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): byte spans [first, last) to remove, in order of their start, of documents as ``_keyed`` gives them."""
    long = keyed.filter(F.octet_length("text") >= LENGTH).select(F.col("key_id").alias("doc_id"), "tag", "text", "repeated")
    once = written(long.filter("repeated").drop("repeated").dropDuplicates(["doc_id", "tag"]), "repeated-rows")   # rows that repeat id and text are one document
    texts = long.filter("not repeated").drop("repeated").unionByName(once)
    counts = texts.select("text").mapInPandas(_count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = written(counts.filter("n > 1"), "shared-hashes")
    salts = F.ceil(F.col("n") / HOT).cast("int")
    places = texts.mapInPandas(_places, "h long, content long, doc_id long, tag long, at long")
    found = places.join(shared, "h").withColumn("salt", F.when(salts > 1, F.pmod(F.hash("doc_id", "tag"), salts) + 1).otherwise(F.lit(0))).drop("n")
    settled = found.repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id", "tag", "at").mapInPandas(_settle, _SETTLED)
    settled = written(settled, "settled-segments")
    wanted = settled.filter("kind = 1").groupBy("doc_id", "tag").agg(F.collect_set(F.struct("h", "salt", "first", "last")).alias("places"))
    wanted = written(wanted, "wanted-segments")
    texts = texts.withColumn("key", F.xxhash64("doc_id", "tag"))
    texts = texts.filter(among(wanted.select(F.xxhash64("doc_id", "tag").alias("key")), "key"))
    parts = texts.join(wanted, ["doc_id", "tag"]).select("doc_id", "tag", "text", "places").mapInPandas(_cut_segments, _ROW)
    marks = parts.repartition("h", "salt").sortWithinPartitions("h", "salt", "doc_id", "tag", "first").mapInPandas(_marks, _MARK)
    marks = written(marks, "repeat-marks")
    strings = marks.filter("kind = 1").drop("kind").repartition(F.xxhash64("part")).sortWithinPartitions("doc_id", "tag", "first")
    across = strings.mapInPandas(_merge, "doc_id long, tag long, first int, last int")
    span = ["doc_id", "tag", "first", "last"]
    every = settled.filter("kind = 0").select(*span).unionByName(marks.filter("kind = 0").select(*span)).unionByName(across)
    return written(every.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("spans")), "repeat-spans")


def _unite(spans: list | np.ndarray | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in spans if spans is not None else ():
        if out and s["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["last"])
        else:
            out.append([s["first"], s["last"]])
    return [(a, b) for a, b in out]


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) per document."""
    texts = _keyed(docs)
    spans = repeated_spans(texts).select(F.col("doc_id").alias("of"), F.col("tag").alias("of_tag"), "spans")

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def cut(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for text, marked in batches:
            out = []
            for t, s in zip(_bytes(text), marked, strict=True):
                whole = _unite(s)
                edges = [0, *(x for span in whole for x in span), len(t)]
                out.append((sum(b - a for a, b in whole), len(whole), b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            yield pd.DataFrame(out, columns=["n_removed", "n_spans", "kept"])

    rows = texts.join(spans, (F.col("key_id") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), cut("text", "spans").alias("c")).select("doc_id", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")
