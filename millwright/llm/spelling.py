"""Spelling variants grouped under their most frequent neighbour (operator 13).

Words are counted over the corpus and two words are near when exactly one inserted, deleted
or replaced code point tells them apart. A word's form is its most frequent near word, if
that is ``TIMES`` as frequent; its root is the end of the chain of forms.

1. One edit leaves either the first half or the rest of a word unchanged. A word of m code
   points is therefore listed under its first half and under its second, once as the shorter
   partner (of words with m and m + 1) and once as the longer one (m - 1 and m).
2. Lists longer than ``LONG_LIST`` are split again: what is left of the words is halved the
   same way, so a list is bounded by the words that agree on about three quarters.
3. A task scans its sorted lists. For one query word the rows of the banded edit matrix are
   kept by depth; the next word of the list starts from the row at its common prefix with
   the one before, and where a row holds no value below two, the whole range that shares
   this prefix is skipped by binary search. Rows of three capped values are small numbers
   whose successors stand in a table.
4. Each list reports per word how many near words it met and the best; sums over the lists
   follow by a shuffle on the word. A pair that agrees on both halves' keys counts in the first.

Frequencies grow at least ``TIMES`` per step along forms, so chains are short (18 steps up to
2**63) and five rounds of pointer doubling reach every root.

Edge cases: null texts hold no words; a null doc_id counts as an empty string; repeated rows
count each; of forms that tie the smallest in code-point order is taken; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import written

RUN = "[A-Za-zÀ-ÿ]"
SHORTEST = 7
LEAST = 2                   # occurrences of a word
SLIP = 31                   # one in so many (document, run) pairs loses a code point
TIMES = 10
LONG_LIST = 2048
_TOP = "\U0010ffff"


# ---- words ------------------------------------------------------------------------------------

def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    runs = re.compile(RUN + "{%d,}" % SHORTEST)
    for pdf in batches:
        held: Counter[str] = Counter()
        for doc, text in zip(pdf["doc"].tolist(), pdf["text"].tolist(), strict=True):
            found = Counter(runs.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
            salt = zlib.crc32(f"{doc}:".encode())
            for w, n in found.items():
                h = zlib.crc32(w.encode(), salt)
                if h % SLIP == 0:
                    k = h % len(w)
                    w = w[:k] + w[k + 1:]
                    if len(w) < SHORTEST:
                        continue
                held[w] += n
            if len(held) > 200_000:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held = Counter()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}, columns=["word", "n"]).astype({"word": object, "n": "int64"})


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words that occur at least ``LEAST`` times."""
    texts = docs.filter("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return texts.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)


# ---- lists ------------------------------------------------------------------------------------

#: A list's kind: code points of prefix and suffix that its words share, and the prefix whose
#: agreement means that another list counts the pair; s is the shorter partner's length.
def _lengths(s: Column) -> dict[str, tuple[Column, Column, Column]]:
    zero, half = F.lit(0), F.floor(s / 2).cast("int")
    rest = s - half
    front, back = F.floor(rest / 2).cast("int"), F.floor(half / 2).cast("int")
    return {
        "F": (half, zero, zero), "R": (zero, rest, half),
        "FF": (half + front, zero, zero), "FR": (half, rest - front, half + front),
        "RF": (back, rest, half), "RR": (zero, s - back, back),
    }


def _entry(kind: str, s: Column) -> Column:
    before, after, other = _lengths(s)[kind]
    w = F.col("word")
    tail = F.when(after > 0, F.right(w, after)).otherwise("")
    key = F.concat_ws("|", F.lit(kind), s.cast("string"), w.substr(F.lit(1), before), tail)
    return F.struct(F.lit(kind).alias("kind"), s.alias("s"), key.alias("key"), before.alias("head"), after.alias("tail"), other.alias("other"))


def _lists(words: DataFrame, long_list: int) -> DataFrame:
    """(key, s, head, tail, other, word, n): each word in its lists, long lists split."""
    m = F.length("word")
    sides = F.explode(F.filter(F.array(m, m - 1), lambda s: s >= SHORTEST)).alias("s")
    base = words.select("word", "n", sides)
    first = base.select("word", "n", F.explode(F.array(*[_entry(k, F.col("s")) for k in ("F", "R")])).alias("e")).select("word", "n", "e.*")
    long = written(first.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > long_list).select("key"), "long-lists")
    kept = first.join(long, "key", "left_anti")
    again = first.join(long, "key", "left_semi").select("word", "n", "s", "kind")
    halves = F.when(F.col("kind") == "F", F.array(_entry("FF", F.col("s")), _entry("FR", F.col("s")))).otherwise(F.array(_entry("RF", F.col("s")), _entry("RR", F.col("s"))))
    split = again.select("word", "n", F.explode(halves).alias("e")).select("word", "n", "e.*")
    return kept.unionByName(split, allowMissingColumns=True).select("key", "s", "head", "tail", "other", "word", "n")


def _successors() -> list[int]:
    """Next row of the banded matrix by row (values at columns d-1, d, d+1, capped at 2, base 3) and matches."""
    table = []
    for state in range(27):
        a, b, c = state // 9, state // 3 % 3, state % 3
        for bits in range(8):
            x = min(a + (not bits & 4), b + 1, 2)
            y = min(b + (not bits & 2), c + 1, x + 1, 2)
            z = min(c + (not bits & 1), y + 1, 2)
            table.append(9 * x + 3 * y + z)
    return table


_NEXT, _DEAD, _START = _successors(), 26, 2 * 9 + 0 * 3 + 1


def within_one(query: str, words: list[str], common: list[int]) -> Iterator[int]:
    """Positions of the sorted ``words`` at most one edit from ``query``; common[j] is the prefix
    that words[j] shares with the word before."""
    q, m = "\0" + query + "\0\0\0", len(query)      # no code point of a word is \0
    rows = [_START] * (m + 3)
    j, n, depth = 0, len(words), 0
    while j < n:
        w = words[j]
        d = min(common[j], depth)
        state = rows[d]
        end = len(w)
        while d < end:
            ch = w[d]
            state = _NEXT[state * 8 + (q[d] == ch) * 4 + (q[d + 1] == ch) * 2 + (q[d + 2] == ch)]
            d += 1
            if state == _DEAD:
                break
            rows[d] = state
        if state == _DEAD:
            depth = d - 1
            j = bisect_left(words, w[:d] + _TOP, j + 1)
            continue
        depth = end
        gap = m - end
        if -2 < gap < 2 and state // (9, 3, 1)[gap + 1] % 3 < 2:
            yield j
        j += 1


def _prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        k += 1
    return k


def _near(s: int, head: int, tail: int, other: int, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, best count, best word) of one list; words in order of what tells them apart."""
    middles = [w[head:len(w) - tail] for w in words]
    order = sorted(range(len(words)), key=middles.__getitem__)
    words, counts, middles = ([x[k] for k in order] for x in (words, counts, middles))
    common = [0, *(_prefix(a, b) for a, b in zip(middles, middles[1:], strict=False))]
    number, best = [0] * len(words), [(1, "")] * len(words)

    def meet(i: int, j: int) -> None:
        number[i] += 1
        best[i] = min(best[i], (-counts[j], words[j]))

    for i, w in enumerate(words):
        if len(w) != s:
            continue
        for j in within_one(middles[i], middles, common):
            v = words[j]
            if j == i or other and w[:other] == v[:other]:
                continue
            meet(i, j)
            if len(v) != s:
                meet(j, i)
    for i, n in enumerate(number):
        if n:
            yield words[i], n, -best[i][0], best[i][1]


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The lists of a partition, one after the other; a list may go on in the next batch."""
    key, at, words, counts = None, None, [], []
    for pdf in batches:
        out = []
        for k, s, head, tail, other, w, n in zip(*(pdf[c].tolist() for c in ("key", "s", "head", "tail", "other", "word", "n")), strict=True):
            if k != key:
                if len(words) > 1:
                    out += _near(*at, words, counts)
                key, at, words, counts = k, (s, head, tail, other), [], []
            words.append(w)
            counts.append(n)
        yield pd.DataFrame(out, columns=["word", "near", "form_n", "form"])
    if len(words) > 1:
        yield pd.DataFrame(list(_near(*at, words, counts)), columns=["word", "near", "form_n", "form"])


def neighbours(words: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near words."""
    lists = _lists(words, long_list)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lists.repartition(parts, "key").sortWithinPartitions("key")
    found = dealt.mapInPandas(_scan, "word string, near long, form_n long, form string")
    per_word = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("n"), "form")).alias("b"))
    return per_word.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.form").alias("best"))


# ---- forms and roots --------------------------------------------------------------------------

def roots(links: DataFrame) -> DataFrame:
    """(word, root) of words with a form; ``links`` is (word, form, ...)."""
    cur = written(links.select("word", F.col("form").alias("root")), "roots")
    for _ in range(5):                        # 2**5 steps; counts grow TIMES per step
        ahead = cur.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = cur.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        step = written(step, "roots")
        cur = step.select("word", "root")
        if not step.agg(F.max("moved")).first()[0]:
            break
    return cur


def variants(docs: DataFrame, long_list: int = LONG_LIST) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root."""
    words = written(vocabulary(docs), "vocabulary")
    near = words.join(neighbours(words, long_list), "word", "left")
    is_form = F.col("best_n") >= TIMES * F.col("n")
    rows = written(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                               F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")), "variants")
    ends = roots(rows.filter("form is not null"))
    return rows.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
