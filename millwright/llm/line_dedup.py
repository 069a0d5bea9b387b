"""Line de-duplication by an exact set-similarity join (operator 4, native).

A line's tokens are its 5-word shingles (the whole line if it has fewer words); lines match at
a Jaccard similarity of ``JACCARD`` or more, and a line goes when an earlier one - smaller
(doc_id, line number) - matches it. Blank lines never match.

1. Word counts over all documents, in ``CLASSES`` hashed bins, give each token a rarity: the
   count of its first word, which bounds the token's own count. Tokens are ordered by rarity.
2. Equal lines fall into one class at once. Of every class only the prefix of n - ceil(0.8 n) + 1
   rarest tokens is shuffled: two lines that match share a prefix token.
3. Classes under one token are ranked by their first occurrence. Every class is compared with
   the first of its token, those still unmatched with ranks 2-5, then 6-21 and so on, so a
   large family of near copies is settled by its first members instead of by all its pairs,
   and still no earlier match is missed. Before a pair is formed it passes the length and
   positional filters and a parity bitmap: each token flips one of ``64 * WORDS`` bits of its
   class, so two classes differ in at least as many tokens as their bitmaps in bits. Members of
   a family that only begin alike are told apart by it and make no pair; lines of over some 500
   words fill it, and are told apart by their sets only. The rest is verified on the full token sets.

Edge cases: null and empty texts have no line to remove; rows that repeat both id and text
are one document, rows that share only the id are not; null ids order before all others; an
empty table gives no rows; extra columns are ignored (``remove`` keeps them). A document that
loses all its lines stays with an empty text.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.llm.common import written

SHINGLE = 5
JACCARD = 0.8
CLASSES = 1 << 14
BITS = 1 << 22
WORDS = 4                   # longs of a class's parity bitmap
FEW = 8                     # classes under a token whose pairs are all tried before any text is fetched
_BLANKS = " \t\x0b\f\r"


def _row(df: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.coalesce("text", F.lit("")))


def _words(line: Column) -> Column:
    return F.split(F.trim(line, F.lit(_BLANKS)), r"[ \t\x0B\f\r]+")


def _bin(word: Column) -> Column:
    return word.bitwiseAND(F.lit(CLASSES - 1).cast("long")).cast("int")


def rarity(docs: DataFrame) -> Column:
    """Array of CLASSES rarity grades (0: rarest) in the top byte of a long, from the counts of all words of all documents."""
    words = docs.select(F.explode(F.split("text", r"[ \t-\r]+")).alias("w")).select(_bin(F.xxhash64("w")).alias("bin"))
    counts = {r["bin"]: r["n"] for r in words.groupBy("bin").agg(F.count("*").alias("n")).collect()}
    grades = [str(min(127, int(4 * math.log2(counts.get(b, 0) + 1))) << 56) for b in range(CLASSES)]
    return F.split(F.lit(",".join(grades)), ",").cast("array<bigint>")   # folded to a literal once


def _shingles(df: DataFrame, grades: Column | None) -> DataFrame:
    """Adds ``tokens``: distinct shingle hashes, with their grade on top if grades are given."""

    def token(i: Column) -> Column:
        whole = F.xxhash64(*[F.get("h", i + k) for k in range(SHINGLE)])          # missing words of a short line are skipped
        return whole if grades is None else F.shiftrightunsigned(whole, 8).bitwiseOR(F.get(grades, _bin(F.get("h", i))))

    df = df.withColumn("h", F.transform(_words(F.col("line")), lambda w: F.xxhash64(w)))
    return df.withColumn("tokens", F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("h") - SHINGLE, F.lit(0))), token))).drop("h")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line_no, line, line_id) of the lines with words."""
    # the row is hashed before its lines are dealt out, once a document instead of once a line
    rows = docs.filter(F.length("text") > 0).select("doc_id", _row(docs).alias("row"), F.split("text", "\n").alias("all"))
    lines = rows.select("doc_id", "row", F.posexplode("all").alias("line_no", "line"))
    return lines.filter(F.trim("line", F.lit(_BLANKS)) != "").withColumn("line_id", F.xxhash64(F.trim("line", F.lit(_BLANKS))))


def _classes(docs: DataFrame, jaccard: float) -> DataFrame:
    """(line_id, first, n, prefix): equal lines as one class, with its first occurrence and its rarest tokens."""
    sized = _shingles(_lines(docs), rarity(docs)).withColumn("n", F.size("tokens"))
    size = (F.col("n") - F.ceil(jaccard * F.col("n") - 1e-9) + 1).cast("int")
    prefix = F.slice(F.sort_array("tokens"), F.lit(1), size)
    # 32 bits of a token are enough to meet on: a chance meeting is found out when the sets are compared
    narrow = sized.select("line_id", F.struct("doc_id", "line_no", "row").alias("first"), "n", F.transform(prefix, lambda t: F.hash(t)).alias("prefix"))
    return written(narrow.groupBy("line_id").agg(F.min("first").alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix")), "line-classes")


def _shared(classes: DataFrame) -> DataFrame:
    """Classes under each prefix token that several classes share, ranked by first occurrence."""
    rows = classes.select("line_id", "n", F.posexplode("prefix").alias("i", "token"))
    several = rows.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("c > 1").drop("c")
    met = written(several, "shared-tokens").join(classes.select("line_id", "first"), "line_id")
    by = Window.partitionBy("token").orderBy("first", "line_id")
    return written(met.withColumns({"rank": F.row_number().over(by), "family": F.count(F.lit(1)).over(Window.partitionBy("token"))}), "ranked-tokens")


def _pairs(probes: DataFrame, leaders: DataFrame, jaccard: float) -> DataFrame:
    """(line_id, other): classes that share a prefix token with an earlier one and pass the length and positional filters."""
    bitmap = [f"s{k}" for k in range(WORDS) if f"s{k}" in probes.columns]
    other = leaders.select("token", F.col("line_id").alias("other"), F.col("rank").alias("o_rank"), F.col("n").alias("o_n"), F.col("i").alias("o_i"), *[F.col(c).alias(f"o_{c}") for c in bitmap])
    least = F.ceil(F.lit(jaccard / (1 + jaccard)) * (F.col("n") + F.col("o_n")) - 1e-9)      # common tokens that the similarity takes
    close = F.least("n", "o_n") >= jaccard * F.greatest("n", "o_n") - 1e-9
    room = F.least(F.col("n") - F.col("i"), F.col("o_n") - F.col("o_i"))                      # common tokens from this one on, at most
    may = (F.col("o_rank") < F.col("rank")) & (F.col("line_id") != F.col("other")) & close & (room >= least)
    if bitmap:
        unlike = reduce(add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"o_{c}"))) for c in bitmap])
        may = may & (unlike <= F.col("n") + F.col("o_n") - 2 * least)                        # tokens in one of the two, at most
    return probes.join(other, "token").filter(may).select("line_id", "other").distinct()


def _bitmap() -> list[Column]:
    """The parity bitmap of ``tokens``, as columns ``s0`` to ``s<WORDS - 1>``."""
    return [F.expr(f"aggregate(tokens, 0L, (a, t) -> a ^ if(pmod(shiftrightunsigned(t, 6), {WORDS}) = {k}, shiftleft(1L, cast(t & 63 as int)), 0L))").alias(f"s{k}") for k in range(WORDS)]


def _held(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """The lines that may be wanted, by a table of ``BITS`` bits whatever the input: none is missed."""
    at = F.pmod("line_id", F.lit(BITS))
    word, bit = F.floor(at / 32).cast("int"), F.expr(f"shiftleft(1L, cast(pmod(line_id, {BITS}) % 32 as int))")
    table = wanted.groupBy(word.alias("w")).agg(F.bit_or(bit).alias("bits"))
    return lines.join(F.broadcast(table), word == F.col("w")).filter(F.col("bits").bitwiseAND(bit) != 0).drop("w", "bits")


def _token_sets(docs: DataFrame, shared: DataFrame, jaccard: float) -> DataFrame:
    """(line_id, tokens): the full token sets of the classes that may pair up.

    Under a token with few classes all pairs are tried on lengths and positions first; classes
    that pass with none of them need no set. Larger families keep all their members.
    """
    few = shared.filter(F.col("family") <= FEW)
    pairs = _pairs(few, few, jaccard)
    ids = pairs.select("line_id").unionByName(pairs.select(F.col("other").alias("line_id"))).unionByName(shared.filter(F.col("family") > FEW).select("line_id")).distinct()
    wanted = written(ids, "wanted-lines")
    # the bit table only spares the shuffle lines that are not wanted; the join decides
    lines = _held(_lines(docs).select("line_id", "line"), wanted).groupBy("line_id").agg(F.first("line").alias("line"))
    return written(_shingles(lines.join(wanted, "line_id"), None).select("line_id", "tokens"), "token-sets")


def _matched(docs: DataFrame, classes: DataFrame, jaccard: float) -> DataFrame:
    """(line_id) of the classes whose first line matches an earlier line of another class."""
    shared = _shared(classes)
    done = docs.sparkSession.createDataFrame([], "line_id long")
    deepest = shared.agg(F.max("rank")).first()[0] or 0
    if deepest < 2:
        return done
    sets = _token_sets(docs, shared, jaccard)
    # classes without a set have no one to pair up with
    shared = written(shared.join(sets.select("line_id", *_bitmap()), "line_id"), "sketched-tokens")
    low = high = 1
    while low < deepest:
        probes = shared.filter(F.col("rank") > low).join(done, "line_id", "left_anti")
        pairs = written(_pairs(probes, shared.filter(F.col("rank").between(low, high)), jaccard), "line-pairs")
        left = pairs.join(sets.withColumnRenamed("tokens", "a"), "line_id")
        full = left.join(sets.select(F.col("line_id").alias("other"), F.col("tokens").alias("b")), "other")
        common = F.size(F.array_intersect("a", "b"))
        similar = full.filter(common >= jaccard * (F.size("a") + F.size("b") - common) - 1e-9).select("line_id").distinct()
        done = written(done.unionByName(similar), "matched-lines")
        low, high = high + 1, 4 * high + 1
    return done


def find(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """(doc_id, row, line_no, near) of every line to remove; near: its first copy matches an earlier line."""
    classes = _classes(docs, jaccard)
    near = _matched(docs, classes, jaccard).withColumn("near", F.lit(True))
    judged = written(classes.join(near, "line_id", "left").select(F.col("line_id").alias("of"), "first", F.coalesce("near", F.lit(False)).alias("near")), "judged-lines")
    lines = _lines(docs).drop("line").join(judged, F.col("line_id") == F.col("of"))
    later = F.struct("doc_id", "line_no", "row") != F.col("first")
    return lines.filter(later | F.col("near")).select("doc_id", "row", "line_no", "near")


def _per_document(removed: DataFrame) -> DataFrame:
    """(of, lines, near): the lines to remove of each document, by its row hash; a document's own lines only."""
    return written(removed.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_set("line_no")).alias("lines"), F.count_if("near").alias("near")), "removed-lines")


def summary(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near, removed_lines per document."""
    gone = _per_document(find(docs, jaccard))
    lines = F.when(F.length("text") > 0, F.size(F.split("text", "\n"))).otherwise(F.lit(0))
    rows = docs.select("doc_id", _row(docs).alias("row"), lines.alias("n_lines")).join(gone, F.col("row") == F.col("of"), "left")
    return rows.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).alias("n_removed"), F.least(F.coalesce("near", F.lit(0)), F.coalesce(F.size("lines"), F.lit(0))).cast("int").alias("n_near"), F.coalesce("lines", F.array().cast("array<int>")).alias("removed_lines"))


def remove(docs: DataFrame, jaccard: float = JACCARD) -> DataFrame:
    """The input rows without the removed lines; ``n_chars``, where there is one, follows the text."""
    columns = docs.columns
    gone = _per_document(find(docs, jaccard)).select(F.col("of").alias("__of"), F.col("lines").alias("__gone"))
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    rows = docs.withColumn("__row", _row(docs)).join(gone, F.col("__row") == F.col("__of"), "left")
    rows = rows.withColumn("text", F.when(F.col("__gone").isNotNull(), kept).otherwise(F.col("text")))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.when(F.col("__gone").isNotNull(), F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return rows.select(*columns)
