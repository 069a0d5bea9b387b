"""SimHash near-duplicates by anchor-point covering (operator 7).

Fingerprint: bit-wise majority of the XXH64 hashes (seed 42) of the 4-word shingles, repeats
included. Documents of one fingerprint form a class; classes link at ``DISTANCE`` or fewer
differing bits, and the connected components of the links are the groups.

Finding the links: the 64 bits are cut into three segments. Two fingerprints that differ in
at most 4 bits differ in at most 1 bit of some segment. In each segment the anchors are the
words of a covering code: a perfect Hamming [15, 11] code on 15 bits (covering radius 1) and
every word on the remaining 6 or 7 bits. A fingerprint is at home at the one anchor within
the covering radius, and is replicated as a visitor to every anchor within covering radius
plus threshold (1 + 1) that can be the home of a fingerprint one bit away: 14 or 15 a
segment. Any link therefore meets at the home of one end. Per anchor, homes are compared with
the visitors in numpy blocks on the full 64 bits, and only a spanning forest of the links is
passed on: no pair of a dense group is lost, but not all of its pairs are listed. An anchor
with more than ``HOMES`` homes is split into chunks of homes; its visitors go to every chunk
and stream past it, so a task holds ``HOMES`` fingerprints and one batch.

Edge cases: null and empty texts have fingerprint 0 and link like any other; fewer than four
words make one shingle; repeated rows share a class; null ids never name a component unless
it has no other id; extra columns are ignored (``deduplicate`` keeps them); an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import ASCII_LOWER, ASCII_UPPER, connected_components, written

SHINGLE = 4
DISTANCE = 4
HOMES = 2048
BITS = 15                                  # of the Hamming code: 2^4 - 1
SEGMENTS = ((0, 21), (21, 42), (42, 64))   # threshold in a segment: DISTANCE // len(SEGMENTS) = 1
_LOWER = bytes.maketrans(ASCII_UPPER.encode(), ASCII_LOWER.encode())


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of one text, as an unsigned integer."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 16384):
        ones += np.unpackbits(h[at:at + 16384].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long column."""

    @F.pandas_udf("long")
    def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint_of(t, shingle) for t in batch], dtype=np.uint64).view(np.int64))

    return simhash(text)


def _syndrome(z: Column) -> Column:
    """Position (1 to 15) of the one bit to flip to reach the Hamming code; 0 for a code word."""
    bits = [sum(1 << (p - 1) for p in range(1, BITS + 1) if p >> k & 1) for k in range(4)]
    parity = [F.shiftleft(F.bit_count(z.bitwiseAND(F.lit(mask))) % 2, k) for k, mask in enumerate(bits)]
    return parity[0] + parity[1] + parity[2] + parity[3]


def _flips(weight: int) -> list[list[int]]:
    """Per syndrome, the bit patterns of up to ``weight`` flips that lead to a code word."""
    out: list[list[int]] = [[] for _ in range(BITS + 1)]
    out[0].append(0)
    for i in range(1, BITS + 1):
        out[i].append(1 << (i - 1))
        if weight > 1:
            for j in range(i + 1, BITS + 1):
                out[i ^ j].append(1 << (i - 1) | 1 << (j - 1))
    return out


def anchors(fp: Column, segment: int) -> tuple[Column, Column]:
    """(home anchor, all anchors visited) of a fingerprint in one segment, as longs with the segment on top."""
    low, high = SEGMENTS[segment]
    width = high - low
    part = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
    code = part.bitwiseAND(F.lit((1 << BITS) - 1))
    table = lambda rows: F.array(*[F.array(*[F.lit(x).cast("long") for x in r]) for r in rows])
    at = (_syndrome(code) + 1).cast("int")
    top = F.lit(segment << 32).cast("long")
    home = part.bitwiseXOR(F.element_at(F.element_at(table(_flips(1)), at), 1)).bitwiseOR(top)
    near = F.transform(F.element_at(table(_flips(2)), at), lambda p: part.bitwiseXOR(p).bitwiseOR(top))
    beside = F.array(*[home.bitwiseXOR(F.lit(1 << k).cast("long")) for k in range(BITS, width)])
    return home, F.concat(near, beside)


def _compare(distance: int):
    """Spanning edges of each (anchor, chunk): rows come sorted by key, homes (visit 0) first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, homes, label = None, np.empty(0, np.uint64), np.empty(0, np.int64)
        for pdf in batches:
            keys, fps, visit = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64), pdf["visit"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (visit[1:] != visit[:-1])) + 1
            a, b = [], []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if hi == lo:
                    continue
                if keys[lo] != key:
                    key, homes, label = keys[lo], np.empty(0, np.uint64), np.empty(0, np.int64)
                if visit[lo] == 0:
                    homes = np.concatenate((homes, fps[lo:hi]))
                    label = np.arange(len(homes))
                    continue
                if not len(homes):
                    continue
                step = max(1, 250_000 // len(homes))
                for at in range(lo, hi, step):
                    guests = fps[at:min(hi, at + step)]
                    near = np.bitwise_count(homes[None, :] ^ guests[:, None]) <= distance
                    own = homes[None, :] == guests[:, None]
                    for v in np.flatnonzero((near & ~own).any(axis=1)).tolist():
                        close = np.flatnonzero(near[v])
                        found, one = np.unique(label[close], return_index=True)
                        mine = label[own[v]]
                        for c, k in zip(found.tolist(), close[one].tolist(), strict=True):
                            if not len(mine) or c != mine[0]:
                                a.append(guests[v])
                                b.append(homes[k])
                        if len(found) > 1:
                            label[np.isin(label, found)] = found[0]
            yield pd.DataFrame({"a": np.array(a, dtype=np.uint64).view(np.int64), "b": np.array(b, dtype=np.uint64).view(np.int64)})

    return run


def links(classes: DataFrame, distance: int = DISTANCE, homes: int = HOMES) -> DataFrame:
    """Spanning edges (a, b) between the distinct fingerprints of ``classes`` (fp) that link."""
    if distance // len(SEGMENTS) > 1:
        raise ValueError(f"the code covers distances up to {2 * len(SEGMENTS) - 1}")
    each = [anchors(F.col("fp"), s) for s in range(len(SEGMENTS))]
    at_home = classes.select("fp", F.explode(F.array(*[h for h, _ in each])).alias("anchor"))
    counts = at_home.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > homes)
    hot = written(counts.select("anchor", F.ceil(F.col("n") / homes).cast("int").alias("chunks")), "hot-anchors")
    visits = classes.select("fp", F.explode(F.concat(*[v for _, v in each])).alias("anchor"))
    at_home = at_home.join(hot, "anchor", "left").withColumn("chunk", F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))))
    visits = visits.join(hot, "anchor", "left").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("chunks", F.lit(1)).cast("bigint") - 1)))
    key = (F.col("anchor") * F.lit(1 << 24) + F.col("chunk")).alias("key")
    rows = at_home.select(key, "fp", F.lit(0).alias("visit")).unionByName(visits.select(key, "fp", F.lit(1).alias("visit")))
    return rows.repartition("key").sortWithinPartitions("key", "visit", "fp").mapInPandas(_compare(distance), "a long, b long")


def groups(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, fp, component, component_id, kept columns) for every row: the group's smallest fingerprint and smallest id."""
    marked = written(docs.select("doc_id", *keep, fingerprint(F.col("text"), shingle).alias("fp")), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    classes = written(marked.groupBy("fp").agg(first), "classes")
    parts = connected_components(links(classes.select("fp"), distance))
    named = classes.join(parts, classes["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    named = written(named, "components")
    smallest = written(named.groupBy("component").agg(F.min("first").alias("first")), "smallest")
    labelled = written(named.select("fp", "component").join(smallest, "component").select("fp", "component", F.col("first.doc_id").alias("component_id")), "labelled")
    return marked.join(labelled, "fp").select("doc_id", "fp", "component", "component_id", *keep)


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """The input rows of which one per group stays: that with the smallest id (of repeated rows, one).

    Texts are fingerprinted once; the second pass finds the rows that stay by id and text hash, without Python.
    """
    tagged = docs.withColumn("__tag", F.xxhash64("text"))
    found = written(groups(tagged, shingle, distance, ["__tag"]), "groups")
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("component", "doc_id", "fp", "__tag").agg(F.count("*").alias("copies"))
    keep = chosen.groupBy("component").agg(F.min(F.struct("fp", "doc_id", "__tag", "copies")).alias("k"))
    keep = written(keep.select(F.col("k.doc_id").alias("__id"), F.col("k.__tag").alias("__of"), F.col("k.copies").alias("__copies")), "kept")
    columns = docs.columns
    kept = tagged.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tag") == F.col("__of")))
    once = kept.filter("__copies = 1").select(*columns)
    return once.unionByName(kept.filter("__copies > 1").dropDuplicates(["__id", "__of"]).select(*columns))
