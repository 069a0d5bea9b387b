"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.session import scratch_path

#: The six white-space bytes of the contracts: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; other scripts keep their case."""
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def written(df: DataFrame, name: str) -> DataFrame:
    """Lineage cut as a Parquet table in the shared folder of ``spark.checkpoint.dir``.

    It survives lost executors, and Spark knows its size when it plans the next join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uniform(*cols: Column) -> Column:
    """Reproducible uniform draw in [0, 1) from a hash of the columns (53 bits)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def among(rows: DataFrame, key: str, bits: int = 1 << 18) -> Column:
    """Whether a long column ``key`` may be one of those in ``rows``: a bit table of ``bits`` bits
    whatever the input, so no key is missed and the table never grows. It only spares a shuffle
    rows that cannot join; the join decides."""
    at = F.pmod(key, F.lit(bits))
    held = rows.groupBy(F.floor(at / 32).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({key}, 32) as int))")).alias("bits"))
    words = [0] * (bits // 32)
    for r in held.collect():
        words[r["w"]] = r["bits"]
    table = F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>")      # folded to a literal once
    word = F.get(table, F.floor(at / 32).cast("int"))
    return F.bitwise_not(word).bitwiseAND(F.expr(f"shiftleft(1L, cast(pmod({key}, 32) as int))")) == 0


def prefix_sum(df: DataFrame, group: Sequence[str], bucket: str, order: Sequence[str], value: str, out: str) -> DataFrame:
    """Exclusive running sum of ``value`` inside each group, in (bucket, order) order, without
    bringing a group into one task: bucket totals, a running sum over the buckets (one row
    per bucket), then a running sum inside each bucket.

    Rows that tie on the whole order may swap places; their sums are then interchangeable.
    """
    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, bucket]
    starts = totals.select(*[F.col(c).alias(f"_{c}") for c in keys], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    return rows.join(starts, same).withColumn(out, F.col("_start") + F.col("_inside")).drop("_start", "_inside", *[f"_{c}" for c in keys])


def connected_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) for every node of an edge list (a, b) of longs; component = smallest node.

    Alternating large-star / small-star rounds (Kiveris et al. 2014): each is a grouped
    minimum and a join; the number of rounds grows with the logarithm of the longest chain.
    The minima are written before the join, so Spark sees their size: it broadcasts them when
    small and otherwise splits a hot node's rows over tasks. ``max_rounds`` only guards
    against a bug: exceeding it raises.
    """
    cur = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    sig = _edge_signature(cur)
    for _ in range(max_rounds):
        if sig[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "large")
        large = written(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "star")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "small")
        small = (
            large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        )
        cur = written(small, "edges")
        new = _edge_signature(cur)
        if new == sig:
            break
        sig = new
    else:
        raise RuntimeError("connected components did not settle")
    roots = cur.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _edge_signature(edges: DataFrame) -> tuple[int, int]:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return int(r["n"]), int(r["h"] or 0)
