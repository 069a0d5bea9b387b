"""Collocated phrases of two and three words, per language, by prefix-free parsing (operator 12).

1. Texts fall into pieces at punctuation and line ends. A piece longer than ``WHOLE`` words is
   parsed: a window of two words whose hash is divisible by ``EVERY`` (a trigger) starts a chunk,
   and the chunk runs on through the next trigger's window, so that neighbours overlap by two
   words. Where a chunk starts depends on its words alone, so copies fall into the same chunks.
2. The chunks of a corpus form a dictionary with parse frequencies (a shuffle on the chunk).
3. n-grams are counted inside distinct chunks only, weighted by the chunk's frequency. Those
   that start inside the overlap belong to the next chunk: a chunk that goes on is marked and
   counts no n-gram starting at its last two words, so each occurrence counts once. Lengths
   follow one another: a bit table of bounded size spares n-grams with a rare part.
4. Phrases of at least ``LEAST`` occurrences meet the counts of their parts (as frequent
   themselves) for the scores; those mostly inside a longer candidate go; the best per
   language are ranked in salted groups first.

Scores are decimals of 38 digits: exact while 10^6 f^2 stays below 10^38.

Edge cases: null and empty texts hold no words; a null language is ``und``; repeated rows
count each; ties go by more occurrences, then by the phrase's bytes; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.llm.common import written

LEAST = 10
LONGEST = 3                 # words of a phrase
INSIDE = 50                 # % of a phrase's occurrences inside one longer candidate that drop it
SCALE = 1_000_000
TOP = 2000
WHOLE = 12                  # pieces of at most so many words are one chunk
EVERY = 8                   # one window in so many is a trigger
SALTS = 64
BITS = 24                   # log2 of the bits that say which phrases may be frequent
_TURN = 7                   # bits by which a phrase's hash turns per word
_GOES_ON = "\t"             # never part of a word; ends a chunk whose last two words start the next
_BREAK = re.compile(rb" ?[.,;:!?\x0a-\x0d][ .,;:!?\x0a-\x0d]*")        # after _GAP became single spaces
_GAP = re.compile(rb"[ \t]+")


# ---- parsing ----------------------------------------------------------------------------------

def chunks(piece: bytes) -> list[bytes]:
    """The overlapping chunks of a piece whose words are joined by single spaces."""
    if piece.count(b" ") < WHOLE:
        return [piece]
    words = piece.split(b" ")
    first, mark = 0, _GOES_ON.encode()
    out = []
    for k in range(1, len(words) - 1):
        if zlib.crc32(words[k + 1], zlib.crc32(words[k])) % EVERY == 0:
            out.append(b" ".join(words[first:k + 2]) + mark)
            first = k
    out.append(b" ".join(words[first:]))
    return out


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            some = pdf[at:at + 2000]
            held: dict[str, Counter[bytes]] = {}
            for lang, text in zip(some["lang"].tolist(), some["text"].tolist(), strict=True):
                low = _GAP.sub(b" ", text.encode("utf-8", "surrogatepass").lower()).strip(b" ")
                held.setdefault(lang, Counter()).update(_BREAK.split(low))
            for lang, found in held.items():
                found.pop(b"", None)
                if not found:
                    continue
                parsed: Counter[bytes] = Counter()
                for piece, n in found.items():
                    for c in chunks(piece):
                        parsed[c] += n
                yield pd.DataFrame({"lang": lang, "chunk": [c.decode("utf-8", "surrogatepass") for c in parsed], "n": list(parsed.values())})


def dictionary(docs: DataFrame) -> DataFrame:
    """(lang, chunk, n): the distinct chunks with their parse frequencies."""
    texts = docs.filter("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(_parse, "lang string, chunk string, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


# ---- counting ---------------------------------------------------------------------------------

def _rolled(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each place on (meaningless where the chunk ends before)."""
    out = hashes
    for k in range(1, size):
        out = (out << np.uint64(_TURN) | out >> np.uint64(64 - _TURN)) ^ np.roll(hashes, -k)
    return out


def _count(lang: str, chunk: list[str], n: list[int], lengths: tuple[int, ...], may: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Weighted n-grams of the given ``lengths`` in chunks, '' counting the words; with ``may`` (a table of
    frequent phrases one word shorter) only where both shorter parts may be frequent."""
    import xxhash

    goes_on = np.fromiter((c.endswith(_GOES_ON) for c in chunk), bool, len(chunk))
    sizes = np.fromiter((c.count(" ") + 1 for c in chunk), np.int64, len(chunk))
    ids, names = pd.factorize(np.array(" ".join(chunk).replace(_GOES_ON, "").split(" "), object), sort=True)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(ids))       # words from here to the chunk's end
    weight = np.repeat(np.array(n, np.int64), sizes)
    starts = (left > 2) | ~np.repeat(goes_on, sizes)                      # the overlap belongs to the next chunk
    names = names.tolist()
    if 1 in lengths:
        yield pd.DataFrame({"lang": lang, "phrase": [""], "n": [int(weight[starts].sum())]})
    bits = max(1, len(names).bit_length())
    for size in lengths:
        at = np.flatnonzero(starts & (left >= size))
        if may is not None:
            salt = lang + " "
            hashes = np.fromiter((xxhash.xxh64_intdigest((salt + w).encode("utf-8", "surrogatepass"), 42) for w in names), np.uint64, len(names))[ids]
            bit = _rolled(hashes, size - 1) >> np.uint64(64 - BITS)
            ok = (may[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at = at[ok[at] & ok[at + 1]]
        if not len(at):
            continue
        code = ids[at]
        for k in range(1, size):
            if bits * (k + 1) > 62:
                code = np.unique(code, return_inverse=True)[1]
            code = code << bits | ids[at + k]
        order = np.argsort(code)
        heads = np.flatnonzero(np.concatenate(([True], code[order][1:] != code[order][:-1])))
        first = at[order[heads]]
        texts = [names[i] for i in ids[first].tolist()]
        for k in range(1, size):
            texts = [t + " " + names[i] for t, i in zip(texts, ids[first + k].tolist(), strict=True)]
        yield pd.DataFrame({"lang": lang, "phrase": texts, "n": np.add.reduceat(weight[at][order], heads)})


def _grams(lengths: tuple[int, ...], may: np.ndarray | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[list[str], list[int]]] = {}
        rows = 0
        for pdf in batches:
            for lang, some in pdf.groupby("lang", sort=False):
                c, n = held.setdefault(lang, ([], []))
                c += some["chunk"].tolist()
                n += some["n"].tolist()
            rows += len(pdf)
            if rows >= 120_000:
                for lang, (c, n) in held.items():
                    yield from _count(lang, c, n, lengths, may)
                held, rows = {}, 0
        for lang, (c, n) in held.items():
            yield from _count(lang, c, n, lengths, may)

    return run


def _marked(found: DataFrame) -> np.ndarray:
    """A table of 2**BITS bits, whatever the input: those of the phrases in ``found`` are set."""
    hashes = F.transform(F.split("phrase", " "), lambda w: F.xxhash64(F.concat("lang", F.lit(" "), w)))
    turned = lambda a: F.shiftleft(a, _TURN).bitwiseOR(F.shiftrightunsigned(a, 64 - _TURN))
    bit = F.shiftrightunsigned(F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: turned(a).bitwiseXOR(h)), 64 - BITS)
    bytes_ = found.filter("phrase <> ''").select(bit.alias("bit")).groupBy(F.shiftright("bit", 3).alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(bit & 7 as int)))").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 3, np.uint8)
    out[bytes_["byte"].to_numpy()] = bytes_["bits"].to_numpy()
    return out


def counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, n): occurrences of the phrases of 1 to ``LONGEST`` words that occur at least ``least``
    times; the phrase '' counts all words of a language.

    One and two words are counted in one pass. Longer phrases follow length by length, counted only
    where both phrases one word shorter may be frequent, as a bit table of those says. It never
    misses one, so nothing frequent is lost.
    """
    parsed = written(dictionary(docs), "chunks")
    found: list[DataFrame] = []
    for lengths in ((1, 2), *((size,) for size in range(3, LONGEST + 1))):
        may = _marked(found[-1].filter(F.size(F.split("phrase", " ")) == lengths[0] - 1)) if found else None
        grams = parsed.mapInPandas(_grams(lengths, may), "lang string, phrase string, n long")
        found.append(written(grams.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "phrases"))
    return reduce(DataFrame.unionByName, found)


# ---- candidates -------------------------------------------------------------------------------

def scored(found: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of all candidates: the lowest-scoring cut, ties to the smallest k."""
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice("words", F.lit(1), k), " ").alias("first"), F.array_join(F.slice("words", k + 1, F.size("words")), " ").alias("rest")))
    cand = found.select("lang", "phrase", F.col("n").alias("a"), words.alias("words")).filter(F.size("words") > 1)
    parts = cand.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.*")
    one = found.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    two = found.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    both = parts.join(one, ["lang", "first"]).join(two, ["lang", "rest"]).withColumns({"up": F.lit(SCALE).cast("decimal(38,0)") * big("a") * big("a"), "down": big("l") * big("r")})
    cut = F.min(F.struct(F.expr("cast(up div down as bigint)").alias("score"), "k", "l", "r")).alias("c")
    return both.groupBy("lang", "phrase").agg(F.max("a").alias("a"), cut).select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def dominated(found: DataFrame, inside: int = INSIDE) -> DataFrame:
    """(lang, phrase) of the candidates whose words lie inside a longer candidate at least ``inside`` % as frequent."""
    words = F.split("phrase", " ")
    size = F.size(words)
    within = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda m: F.transform(F.sequence(F.lit(1), size - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    most = found.filter(size > 2).select("lang", F.col("n").alias("longer"), F.explode(within).alias("phrase")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return found.join(most, ["lang", "phrase"]).filter(100 * F.col("longer") >= inside * F.col("n")).select("lang", "phrase")


def mine(docs: DataFrame, top: int = TOP) -> DataFrame:
    """The best ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    found = counts(docs)
    kept = scored(found).join(dominated(found), ["lang", "phrase"], "left_anti")
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).filter(F.col("rank") <= top).drop("_salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top)
    total = found.filter("phrase = ''").select("lang", "n")
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
