"""Document fingerprints by winnowing (operator 6, native).

The text's words (runs of non-white space; longer ones in pieces of ``PIECE`` characters) are
hashed, k = ``GRAM`` neighbouring hashes are rolled into one gram hash by doubling
(1 + 1, 2 + 2, 4 + 1 words), and in every window of ``WINDOW`` grams the smallest hash is
chosen, the rightmost one on ties. A chosen gram is one long: 32 bits of its hash on top, below
them the complement of its position, so the plain minimum of a window breaks ties to the
right, equal choices of neighbouring windows fall together, and positions are kept. Any
shared run of ``GRAM + WINDOW - 1`` words shares a chosen gram.

Everything is array expressions on the row, so a text is fingerprinted where it lies. The
neighbour ("next document") comes from one shuffle into ranges of ids: ``BUCKET_ROWS``
documents each, plus the first document of the following range as a guest.

Edge cases: null text counts as empty; an empty text has an empty fingerprint, alike (1.0) to
another empty one and unlike (0.0) to any other; fewer than k words make one gram; rows
without an id come last, ties and repeated rows are ordered by text; a table of one row is its
own neighbour; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.llm.common import written

GRAM = 5
WINDOW = 8
PIECE = 32
BUCKET_ROWS = 512
_POSITION = 2**31 - 1


def _ahead(col: str, by: int) -> Column:
    return F.slice(col, by + 1, F.greatest(F.size(col) - by, F.lit(0)))


def with_fingerprint(df: DataFrame, text: str, out: str, window: int = WINDOW) -> DataFrame:
    """Adds ``out``: the chosen (hash, position) longs of a text column without nulls, by position."""
    a, b, c = f"_{out}a", f"_{out}b", f"_{out}c"
    words = F.regexp_extract_all(F.col(text), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    df = df.withColumn(a, F.transform(words, lambda w: F.xxhash64(w)))
    df = df.withColumn(b, F.zip_with(a, _ahead(a, 1), lambda x, y: F.xxhash64(x, y)))       # a missing neighbour is skipped by the hash
    df = df.withColumn(c, F.zip_with(b, _ahead(b, 2), lambda x, y: F.xxhash64(x, y)))
    df = df.withColumn(b, F.zip_with(c, _ahead(a, 4), lambda x, y: F.xxhash64(x, y)))
    grams = F.slice(b, 1, F.greatest(F.size(b) - (GRAM - 1), F.least(F.size(b), F.lit(1))))
    packed = F.transform(grams, lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(_POSITION).cast("long") - i.cast("long")))
    df = df.withColumn(c, packed).withColumn(b, F.col(c))
    span = 1
    while 2 * span <= window:
        df = df.withColumn(b, F.zip_with(b, _ahead(b, span), lambda x, y: F.least(x, y)))
        span *= 2
    if span < window:
        df = df.withColumn(b, F.zip_with(b, _ahead(b, window - span), lambda x, y: F.least(x, y)))
    whole = F.slice(b, 1, F.greatest(F.size(b) - (window - 1), F.least(F.size(b), F.lit(1))))
    return df.withColumn(out, F.array_distinct(whole)).drop(a, b, c)


def hashes(chosen: Column) -> Column:
    """The set of chosen gram hashes, without positions."""
    return F.array_distinct(F.transform(chosen, lambda x: F.shiftrightunsigned(x, 31)))


def positions(chosen: Column) -> Column:
    """Word positions (from 0) of the chosen grams."""
    return F.transform(chosen, lambda x: F.lit(_POSITION).cast("long") - x.bitwiseAND(F.lit(_POSITION).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two hash sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(F.lit(1.0))


def digest(chosen: Column) -> Column:
    """A short name of a fingerprint: number of chosen grams and a hash of all of them with positions."""
    return F.concat_ws("-", F.size(chosen).cast("string"), F.lower(F.hex(F.xxhash64(chosen))))


def with_next(docs: DataFrame, rows: int = BUCKET_ROWS) -> DataFrame:
    """(doc_id, text, guest, bucket) shuffled into id ranges, each with the first row after it as a guest."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    seen = texts.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).first()
    low, high = seen["low"] or 0, seen["high"] or 0
    ranges = max(1, -(-seen["n"] // rows))
    width = max(1, -(-(high - low + 1) // ranges))
    place = F.coalesce(F.floor((F.col("doc_id") - low) / width), F.lit(ranges + 1)).alias("bucket")
    texts = texts.select("doc_id", "text", place)
    by = Window.orderBy("bucket")
    firsts = texts.groupBy("bucket").agg(F.min("doc_id").alias("first"))
    after = F.struct(F.lead("bucket").over(by).alias("bucket"), F.lead("first").over(by).alias("first"))
    around = F.min(F.struct("bucket", "first")).over(Window.partitionBy())
    ahead = firsts.withColumn("after", F.when(F.lead("bucket").over(by).isNull(), around).otherwise(after))
    ahead = written(ahead.select(F.col("bucket").alias("host"), F.col("after.bucket").alias("of"), F.col("after.first").alias("first")), "next-bucket")
    guests = texts.join(ahead, (F.col("bucket") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("first")))
    own = texts.withColumn("guest", F.lit(0))
    return own.unionByName(guests.select("doc_id", "text", F.col("host").alias("bucket"), F.lit(1).alias("guest"))).repartition("bucket")


def compare(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text and of the next document, with likenesses.

    The edited text replaces the last half of the characters by the next document's first ones.
    """
    rows = with_fingerprint(with_next(docs), "text", "chosen")
    by = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "text")
    rows = rows.select("*", F.lead("text").over(by).alias("next_text"), F.lead("chosen").over(by).alias("next_chosen")).filter("guest = 0")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next_text", F.col("text")), F.lit(1), half))
    rows = rows.select("doc_id", n.cast("bigint").alias("n_chars"), "chosen", F.coalesce("next_chosen", "chosen").alias("next_chosen"), edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_chosen")
    sets = rows.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "chosen", "edited_chosen",
                       hashes(F.col("chosen")).alias("own"), hashes(F.col("edited_chosen")).alias("changed"), hashes(F.col("next_chosen")).alias("following"))
    return sets.select("doc_id", "n_chars", "edited_sha256", "chosen", "edited_chosen",
                       likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("following")).alias("near_next"))
