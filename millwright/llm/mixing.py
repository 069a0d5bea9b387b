"""Mix sources to target weights from fixed-length token blocks (operator 5, native).

Each source is one token stream (documents in a fixed pseudorandom bucket order), cut into
blocks of ``block`` words. The output is a row of shards of ``shard`` block slots. Every slot
draws its source from the target weights, so the source counts of a shard are multinomial;
a repair on the (shard, source) counts hands the surplus of over-drawn sources to
under-drawn ones, so that every source ends at exactly its number of slots. A source's j-th
slot reads, in epoch ``j div n``, block ``p(j mod n)`` where p is a keyed pseudorandom
permutation of its n block indexes (swap-or-not shuffle: exact for any n, no table). A
joined block index brings the words back to documents. The last slot of a source takes only
the words still missing to its target, and no block is read more often than a started epoch
allows, so no document exceeds the cap.

Edge cases: null text counts 0 words and is kept with taken 0; a null source is a source of
its own, last in order; ids and whole rows may repeat (each row is a document of its own);
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.llm.common import WORD, prefix_sum, uniform, written

BLOCK = 128        # words of a block
SHARD = 4096       # block slots of an output shard
WEIGHTS = (1, 2, 3)
CAP = 3            # a source gives at most so many times its size
ROUNDS = 24        # of the swap-or-not shuffle
BUCKET_ROWS = 512  # documents of a prefix-sum bucket, about


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) -> plus weight and target words.

    One row per source. A source stops at cap x size when its share would pass it; the excess
    goes to the others by weight until none is above. Ordered by size/weight, the stopped
    sources are the first ones, so running sums give the level at once.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    named = sources.withColumn("k", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")))
    full = F.lit(cap) * F.col("source_size")
    upto = Window.orderBy(F.col("ratio"), "k")
    every = Window.partitionBy()
    levelled = (
        named.withColumn("ratio", full / F.col("weight"))
        .withColumn("words", F.sum("source_size").over(every))
        .withColumn("stopped", F.coalesce(F.sum(full).over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(upto.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("words") - F.col("stopped")) / F.col("open"))
    )
    # the first source that is not stopped sets the level for all after it
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct(F.col("ratio"), F.col("k"), F.col("level")))).over(every)
    return levelled.withColumn("level", level["level"]).select(
        "source", "k", "weight", "source_size", F.least(full.cast("double"), F.coalesce(F.col("level") * F.col("weight"), full.cast("double"))).alias("target"))


def swap_or_not(x: Column, n: Column, *key: Column, rounds: int = ROUNDS) -> Column:
    """Keyed pseudorandom permutation of 0..n-1 (Hoang, Morris, Rogaway 2012)."""

    def step(acc: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(r, *key), n) - acc, n)
        coin = F.xxhash64(r, F.greatest(acc, mirror), *key)
        return F.when(F.pmod(coin, F.lit(2)) == 1, mirror).otherwise(acc)

    return F.when(n > 1, F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), x.cast("bigint"), step)).otherwise(F.lit(0).cast("bigint"))


def _slots(plan: DataFrame, n_slots: int, shard: int, seed: int) -> DataFrame:
    """(k, first, last, shard): ranges of a source's slot numbers that an output shard holds."""
    spark = plan.sparkSession
    # inverse CDF by a guide table: cells of [0, 1), each with the sources that reach into it
    cells = 4096
    total = F.sum("slots").over(Window.partitionBy())
    edge = F.sum("slots").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    spans = plan.withColumn("lo", F.coalesce(edge, F.lit(0)) / total).withColumn("hi", (F.coalesce(edge, F.lit(0)) + F.col("slots")) / total).filter("slots > 0")
    guide = spans.select("k", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    drawn = (
        spark.range(n_slots).select(F.floor(F.col("id") / shard).alias("shard"), uniform(F.lit(seed), F.col("id")).alias("u"))
        .withColumn("cell", F.floor(F.col("u") * cells))
        .join(guide, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi")))
        .groupBy("shard", "k").agg(F.count("*").alias("c"))
    )
    # repair: a source keeps its first `slots` draws; later draws go to sources that lack some
    drawn = written(drawn, "drawn")
    drawn = prefix_sum(drawn.withColumn("bucket", F.floor(F.col("shard") / 1024)), ["k"], "bucket", ["shard"], "c", "at")
    held = drawn.join(plan.select("k", "slots"), "k").withColumn("kept", F.greatest(F.lit(0), F.least(F.col("c"), F.col("slots") - F.col("at"))))
    held = written(held, "held")
    ranges = held.filter("kept > 0").select("k", "shard", F.col("at").alias("first"), (F.col("at") + F.col("kept") - 1).alias("last"))
    spare = held.filter("kept < c").select("shard", F.col("k").alias("donor"), (F.col("c") - F.col("kept")).alias("extra"))
    spare = prefix_sum(spare.withColumn("one", F.lit(0)).withColumn("bucket", F.floor(F.col("shard") / 1024)), ["one"], "bucket", ["shard", "donor"], "extra", "pos")
    got = held.groupBy("k").agg(F.sum("kept").alias("got"))
    lack = plan.join(got, "k", "left").select("k", F.coalesce("got", F.lit(0)).alias("got"), (F.col("slots") - F.coalesce("got", F.lit(0))).alias("need")).filter("need > 0")
    lack = lack.withColumn("lo", F.coalesce(F.sum("need").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # the lacking sources, one row each, as intervals of the surplus numbers; joined by cells of it
    width = max(1, math.ceil(n_slots / 4096))
    reach = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.floor(b / width)))
    left = spare.select("shard", "pos", "extra", reach(F.col("pos"), F.col("pos") + F.col("extra") - 1).alias("cell"))
    right = lack.select("k", "got", "lo", "need", reach(F.col("lo"), F.col("lo") + F.col("need") - 1).alias("cell"))
    cell0, cell1 = F.col("cell") * width, (F.col("cell") + 1) * width
    begin = F.greatest(F.col("pos"), F.col("lo"), cell0)
    end = F.least(F.col("pos") + F.col("extra"), F.col("lo") + F.col("need"), cell1)
    moved = left.join(right, "cell").withColumn("begin", begin).withColumn("end", end).filter("begin < end").select(
        "k", "shard", (F.col("got") + F.col("begin") - F.col("lo")).alias("first"), (F.col("got") + F.col("end") - 1 - F.col("lo")).alias("last"))
    return ranges.unionByName(moved)


def _mixed(docs: DataFrame, keep: Sequence[str], block: int, shard: int, weights: Sequence[int], cap: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(the documents along their source's stream, with ``keep``; the draws). Each is written, so that nothing is worked out twice."""
    sized = written(docs.select("doc_id", "source", *keep, n_words(F.col("text")).alias("size")), "sizes")   # the texts are read once
    nb = max(1, math.ceil(sized.count() / BUCKET_ROWS))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = (
        targets(sources, weights, cap)
        .withColumn("blocks", F.ceil(F.col("source_size") / block))
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("bigint"))
        .withColumn("slots", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block))
    )
    plan = written(plan, "plan")
    n_slots = int(plan.agg(F.sum("slots")).first()[0] or 0)
    ranges = written(_slots(plan, n_slots, shard, seed), "ranges")
    slots = ranges.select("k", "shard", F.explode(F.sequence("first", "last")).alias("slot")).join(plan.select("k", "blocks", "slots", "source_size", "rest"), "k")
    epoch = F.floor(F.col("slot") / F.col("blocks"))
    at = swap_or_not(F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"), F.lit(seed), F.col("k"), F.col("epoch"))
    whole = F.least(F.lit(block).cast("bigint"), F.col("source_size") - F.col("block") * block)
    last = (F.col("slot") == F.col("slots") - 1) & (F.col("rest") % block > 0)
    draws = slots.withColumn("epoch", epoch).withColumn("block", at).select(
        "k", "shard", "slot", "epoch", "block", F.when(last, F.least(whole, F.col("rest") % block)).otherwise(whole).alias("words"))
    # documents along their source's stream
    named = plan.select(F.col("source").alias("of"), "k", "source_size", "target")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), F.col("size")), F.lit(nb)))
    rows = prefix_sum(rows, ["k"], "bucket", ["doc_id", "size"], "size", "start").drop("bucket")
    return written(rows, "stream"), written(draws, "draws")


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """The documents cut at the block borders of their source's stream: (k, start, size, block, begin, end) in words."""
    cut = F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block")
    return rows.filter("size > 0").select("k", "start", "size", "source_size", cut).withColumns({
        "begin": F.greatest(F.col("start"), F.col("block") * block), "end": F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)})


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(documents with size, source_size, target, taken; draws of blocks).

    draws: (k, shard, slot, epoch, block, words) - which block of which source fills a slot.
    """
    rows, draws = _mixed(docs, [], block, shard, weights, cap, seed)
    sizes = rows.groupBy("k").agg(F.max("source_size").alias("source_size"))
    # words wanted of a block: `reads` whole reads, and one read of its first `part` words
    is_part = F.col("words") < F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    wanted = draws.join(sizes, "k").groupBy("k", "block").agg(
        F.sum(F.when(is_part, 0).otherwise(1)).alias("reads"), F.sum(F.when(is_part, F.col("words")).otherwise(0)).alias("part"))
    begin, end = F.col("begin"), F.col("end")
    part = F.greatest(F.lit(0), F.least(end - F.col("block") * block, F.col("part")) - (begin - F.col("block") * block))
    taken = _pieces(rows, block).join(wanted, ["k", "block"]).groupBy("k", "start").agg(F.sum((end - begin) * F.col("reads") + part).alias("taken"))
    # a document of the stream is (k, start): only rows of size 0 share a start with another
    out = rows.join(taken, ["k", "start"], "left").select(
        "doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("bigint").alias("taken"))
    return out, draws


def shards(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = 5) -> DataFrame:
    """The mix itself: (shard, k, slot, block, words), one row per drawn block with its words in order.

    Documents are packed into their source's blocks word by word and the blocks joined with the
    draws by index; a block's last, partial draw holds its first words only.
    """
    listed = docs.withColumn("__words", F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), 0))
    rows, draws = _mixed(listed, ["__words"], block, shard, weights, cap, seed)
    start, stop = F.col("start"), F.col("start") + F.col("size")

    def piece(b: Column) -> Column:
        begin, end = F.greatest(start, b * block), F.least(stop, (b + 1) * block)
        return F.struct(b.alias("block"), begin.alias("begin"), F.slice("__words", (begin - start + 1).cast("int"), (end - begin).cast("int")).alias("words"))

    cut = F.explode(F.transform(F.sequence(F.floor(start / block), F.floor((stop - 1) / block)), piece)).alias("p")
    packed = rows.filter("size > 0").select("k", cut).select("k", "p.block", F.struct("p.begin", "p.words").alias("piece"))
    blocks = packed.groupBy("k", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["words"])).alias("all"))
    return draws.join(blocks, ["k", "block"]).select("shard", "k", "slot", "block", F.slice("all", F.lit(1), F.col("words").cast("int")).alias("words"))
