"""Exact quantiles from a sketch and one exact pass (used by Q5/Q6/Q7, F7, N4).

Spark's exact ``percentile`` keeps a value→count map of the whole group in one task
(for a global aggregate: every distinct value of the table in one reducer).  Here:

  1. one pass builds a mergeable quantile sketch of every value per (group, column) - KLL of width
     ``WIDTH``, rank error under 0.07 % of the rows at 99 % - and asks it for a value on either side
     of each wanted rank, ``AWAY`` of the rows (three errors) away: a bracket that should hold it;
  2. one exact pass counts what lies below each bracket (one number per task) and the values
     inside it. Only these, about 2·AWAY of the rows, are shuffled (all of a group of fewer than
     2/AWAY rows). The counts tell whether every bracket holds its ranks. Should one miss, the pass
     is repeated with the brackets of ``percentile_approx``, whose bound on the error is certain
     but which costs several times as much;
  3. a bracket is cut into ``PARTS`` of equal width; part totals tell which part holds the rank,
     and only that part's values are ordered, so no task sorts a whole bracket.

NaN and null are missing.  The result is interpolated as Spark's ``percentile`` does
(position (n−1)·p between the floor and ceil order statistics), so values equal the
built-in aggregate.  Two actions and a look at the counts, whatever the number of columns; a rank
outside a certain bracket (impossible by its bound) would be an error, not a wrong value.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.session import materialize

WIDTH = 8192
AWAY = 0.002
ACCURACY = 10_000           # of the certain brackets
SLACK = 4
PARTS = 256


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def _renamed(df: DataFrame, keys: list[str], tag: str) -> tuple[DataFrame, list[str]]:
    names = {k: f"{tag}{k}" for k in keys}
    return df.withColumnsRenamed(names), list(names.values())


def _brackets(d: DataFrame, groups: list[str], k: int, probs: list[float], certain: bool = False) -> DataFrame:
    """One row per group: for column i its count ``n<i>``, and ``lo<i>`` / ``hi<i>``, a value on either side of each probability."""
    away = SLACK / ACCURACY if certain else AWAY
    sides = [min(1.0, max(0.0, p + side)) for side in (-away, away) for p in probs]
    if certain:
        asked = F.array(*map(F.lit, sides))
        got = d.groupBy(*groups).agg(*[a for i in range(k) for a in (
            F.count(f"v{i}").alias(f"n{i}"), F.percentile_approx(f"v{i}", asked, F.lit(ACCURACY)).alias(f"at{i}"), F.min(f"v{i}").alias(f"min{i}"), F.max(f"v{i}").alias(f"max{i}"))])
    else:
        # a sketch knows the number, the least and the greatest of its values; an empty one cannot be asked for a value
        asked = F.array(*map(F.lit, [*sides, 0.0, 1.0]))
        got = d.groupBy(*groups).agg(*[F.kll_sketch_agg_double(f"v{i}", F.lit(WIDTH)).alias(f"at{i}") for i in range(k)])
        got = got.withColumns({f"n{i}": F.kll_sketch_get_n_double(f"at{i}") for i in range(k)})
        got = got.withColumns({f"at{i}": F.when(F.col(f"n{i}") > 0, F.kll_sketch_get_quantile_double(f"at{i}", asked)) for i in range(k)})
        got = got.withColumns({f"{name}{i}": F.col(f"at{i}")[len(sides) + j] for i in range(k) for j, name in enumerate(("min", "max"))})
    few = lambda i: F.col(f"n{i}") < 2 / away      # noqa: E731  too few rows for the slack to span a rank on either side: all of them
    low = lambda i, j, p: F.when(few(i) | F.lit(p <= away), F.col(f"min{i}")).otherwise(F.col(f"at{i}")[j])
    high = lambda i, j, p: F.when(few(i) | F.lit(p >= 1 - away), F.col(f"max{i}")).otherwise(F.col(f"at{i}")[len(probs) + j])
    out = []
    for i in range(k):
        out += [F.col(f"n{i}"), F.array(*[low(i, j, p) for j, p in enumerate(probs)]).alias(f"lo{i}"), F.array(*[high(i, j, p) for j, p in enumerate(probs)]).alias(f"hi{i}")]
    return got.select(*groups, *out)


def _inside(d: DataFrame, groups: list[str], k: int, probs: list[float], certain: bool = False) -> DataFrame:
    """(groups…, cid, slot, v, c): how often a value inside a bracket occurs, and what lies below (v null), with the bracket's ranks and the value's part."""
    keys = [*groups, "cid"]
    held, hkeys = _renamed(materialize(_brackets(d, groups, k, probs, certain), "quantile-brackets"), groups, "h_")
    rows = d.join(held, _same(groups, hkeys)) if groups else d.crossJoin(held)

    def item(i: int, j: int) -> Column:
        v, lo, hi = F.col(f"v{i}"), F.col(f"lo{i}")[j], F.col(f"hi{i}")[j]
        # what lies below the bracket is counted under one null value
        inside = F.when(v >= lo, v)
        return F.when(v <= hi, F.struct(F.lit(i).alias("cid"), F.lit(j).alias("slot"), inside.alias("v")))

    items = F.explode(F.array(*[item(i, j) for i in range(k) for j in range(len(probs))])).alias("e")
    counts = rows.select(*groups, items).filter(F.col("e").isNotNull()).select(*groups, "e.*").groupBy(*keys, "slot", "v").agg(F.count(F.lit(1)).alias("c"))

    # one row per (group, column, probability): its bracket and the ranks wanted of it
    about = F.explode(F.array(*[F.struct(F.lit(i).alias("cid"), F.lit(j).alias("slot"), F.col(f"n{i}").alias("n"), F.col(f"lo{i}")[j].alias("lo"), F.col(f"hi{i}")[j].alias("hi"), F.lit(float(p)).alias("p"))
                                for i in range(k) for j, p in enumerate(probs)])).alias("e")
    wanted = held.select(*[F.col(h).alias(f"w_{g}") for g, h in zip(groups, hkeys, strict=True)], about).filter(F.col("e.n") > 0)
    at = (F.col("e.n") - 1) * F.col("e.p")
    wanted = wanted.select(*[f"w_{g}" for g in groups], F.col("e.cid").alias("w_cid"), F.col("e.slot").alias("w_slot"), F.col("e.lo").alias("lo"), F.col("e.hi").alias("hi"),
                           at.alias("at"), F.floor(at).cast("long").alias("first"), F.ceil(at).cast("long").alias("second"))
    wkeys = [f"w_{x}" for x in [*keys, "slot"]]
    inside = counts.join(wanted, _same([*keys, "slot"], wkeys)).drop(*wkeys)
    # halves first: the width of a bracket may pass the largest double
    width = F.col("hi") / 2 - F.col("lo") / 2
    place = F.when(width > 0, F.nanvl((F.col("v") / 2 - F.col("lo") / 2) / width * PARTS, F.lit(0.0))).otherwise(0.0)
    part = F.when(F.col("v").isNull(), -1).otherwise(F.least(F.lit(float(PARTS)), F.greatest(F.lit(0.0), place)).cast("int"))
    return materialize(inside.withColumn("part", part), "quantile-values")


def _missed(inside: DataFrame, keys: list[str]) -> bool:
    """Whether a wanted rank lies outside its bracket."""
    below, upto = F.coalesce(F.sum(F.when(F.col("part") < 0, F.col("c"))), F.lit(0)), F.sum("c")
    held = inside.groupBy(*keys, "slot").agg(((F.first("first") < below) | (F.first("second") >= upto)).alias("missed"))
    return not held.filter("missed").isEmpty()


def quantile_table(df: DataFrame, values: dict[str, Column], probs: list[float], groups: list[str] | None = None) -> DataFrame:
    """(groups…, cid, q): the quantiles of each value column (cid: its number) per group; absent where all are missing."""
    groups, k = list(groups or []), len(values)
    keys = [*groups, "cid"]
    d = df.select(*groups, *[F.nanvl(v.cast("double"), F.lit(None)).alias(f"v{i}") for i, v in enumerate(values.values())])
    inside = _inside(d, groups, k, probs)
    if _missed(inside, keys):
        inside = _inside(d, groups, k, probs, certain=True)

    by = Window.partitionBy(*keys, "slot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = inside.groupBy(*keys, "slot", "part").agg(F.sum("c").alias("t"), F.first("first").alias("first"), F.first("second").alias("second"))
    parts = parts.withColumn("start", F.coalesce(F.sum("t").over(by), F.lit(0)))
    holds = lambda r: (F.col(r) >= F.col("start")) & (F.col(r) < F.col("start") + F.col("t"))
    near, nkeys = _renamed(parts.filter((F.col("part") >= 0) & (holds("first") | holds("second"))).select(*keys, "slot", "part", "start"), [*keys, "slot", "part"], "n_")
    some = inside.join(near, _same([*keys, "slot", "part"], nkeys)).drop(*nkeys)
    upto = Window.partitionBy(*keys, "slot", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("end", F.col("start") + F.sum("c").over(upto))
    here = lambda r: F.max(F.when((F.col(r) < F.col("end")) & (F.col(r) >= F.col("end") - F.col("c")), F.col("v")))
    picked = some.groupBy(*keys, "slot").agg(here("first").alias("a"), here("second").alias("b"), F.first("at").alias("at"))
    found = lambda c: F.coalesce(F.col(c), F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double"))
    low, high = found("a"), found("b")
    q = F.when((F.floor("at") == F.ceil("at")) | (low == high), low).otherwise((F.ceil("at") - F.col("at")) * low + (F.col("at") - F.floor("at")) * high)
    per = picked.select(*keys, "slot", q.alias("q")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("slot", "q"))).alias("s"))
    return per.select(*keys, F.col("s.q").alias("q"))


def wide(table: DataFrame, names: list[str], groups: list[str], i: int = 0) -> DataFrame:
    """One row per group: the i-th quantile of each value column, under the column's name."""
    return table.groupBy(*groups).agg(*[F.max(F.when(F.col("cid") == c, F.col("q")[i])).alias(n) for c, n in enumerate(names)])


def exact_quantiles(df: DataFrame, values: dict[str, Column], probs: list[float]) -> dict[str, list[float | None]]:
    """{name: [q(p) for p in probs]} of the whole table: one row per column comes to the driver."""
    found = {r["cid"]: list(r["q"]) for r in quantile_table(df, values, probs).collect()}
    return {n: found.get(i, [None] * len(probs)) for i, n in enumerate(values)}
