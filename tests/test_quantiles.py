"""Exact range-refinement quantiles equal Spark's single-buffer ``percentile`` aggregate."""

from pyspark.sql import functions as F

from millwright.operators.quantiles import exact_quantiles, quantile_table

PROBS = [0.0, 0.01, 0.25, 0.5, 0.75, 0.94, 0.99, 1.0]


def _frame(spark):
    d = spark.range(20000).select(
        (F.col("id") % 3).cast("string").alias("g"),
        F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(F.round(F.randn(5) * 40 + 300, 1)).alias("a"),
        F.exp(F.rand(6) * 30).alias("b"),                       # values spread over 13 orders of magnitude
        (F.col("id") % 4).cast("double").alias("c"),             # heavy ties
    )
    return d


def test_global_matches_percentile(spark):
    d = _frame(spark)
    got = exact_quantiles(d, {"a": F.col("a"), "b": F.col("b"), "c": F.col("c")}, PROBS)
    ref = d.agg(*[F.percentile(c, F.array(*[F.lit(p) for p in PROBS])).alias(c) for c in "abc"]).first()
    for c in "abc":
        assert got[c] == list(ref[c]), c


def test_grouped_matches_percentile(spark):
    d = _frame(spark)
    d = d.withColumn("g", F.when(F.col("g") != "2", F.col("g")))      # a null group counts as a group
    got = {(r["g"], "ab"[r["cid"]]): list(r["q"]) for r in quantile_table(d, {"a": F.col("a"), "b": F.col("b")}, [0.25, 0.5, 0.75], ["g"]).collect()}
    ref = d.groupBy("g").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(c) for c in "ab"]).collect()
    assert len(got) == 6
    for r in ref:
        for c in "ab":
            assert got[r["g"], c] == list(r[c])


def test_all_null_and_single_value(spark):
    d = spark.range(10).select(F.lit(None).cast("double").alias("x"), F.lit(2.5).alias("y"))
    got = exact_quantiles(d, {"x": F.col("x"), "y": F.col("y")}, [0.5])
    assert got == {"x": [None], "y": [2.5]}


def test_nan_infinity_and_width(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1.0, 1e308, nan), (2.0, -1e308, inf), (nan, 0.0, 1.0), (None, 1.0, None), (3.0, 2.0, -inf), (2.0, 3.0, 2.0)] * 5
    d = spark.createDataFrame(rows, "a double, b double, c double")
    got = exact_quantiles(d, {c: F.col(c) for c in "abc"}, [0.0, 0.5, 1.0])
    for c in "abc":
        clean = d.filter(~F.isnan(c))
        assert got[c] == list(clean.agg(F.percentile(c, F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0)))).first()[0]), c


def test_only_rows_inside_brackets_are_exchanged(spark, monkeypatch):
    from millwright.operators import quantiles

    kept = {}
    write = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, name: kept.setdefault(name, write(df, name)))
    n = 200_000
    d = spark.range(n).select((F.col("id") % 2).alias("g"), (F.rand(3) * 1e6).alias("a"), F.randn(4).alias("b"))       # all values distinct
    d = write(d, "distinct-doubles")
    got = {(r["g"], r["cid"]): r["q"] for r in quantile_table(d, {"a": F.col("a"), "b": F.col("b")}, [0.25, 0.5], ["g"]).collect()}
    for r in d.groupBy("g").agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5))).alias(c) for c in "ab"]).collect():
        assert got[r["g"], 0] == r["a"] and got[r["g"], 1] == r["b"]
    assert set(kept) == {"quantile-brackets", "quantile-values"}                # two passes over the rows
    assert kept["quantile-values"].count() < 0.01 * 2 * n                       # of 2 n values


def test_a_bracket_that_misses_its_rank_is_found_out(spark, monkeypatch):
    """The sketch may err; the counts tell, and the brackets are made again by the sure way."""
    from millwright.operators import quantiles

    made = []
    brackets = quantiles._brackets

    def misled(d, groups, k, probs, certain=False):
        made.append(certain)
        got = brackets(d, groups, k, probs, certain)
        return got if certain else got.withColumn("lo0", F.transform("lo0", lambda v: v + 200)).withColumn("hi0", F.transform("hi0", lambda v: v + 200))

    monkeypatch.setattr(quantiles, "_brackets", misled)
    d = spark.range(20000).select((F.col("id") * 7919 % 20000).cast("double").alias("a"), (F.col("id") % 4).cast("double").alias("c"))
    assert exact_quantiles(d, {"a": F.col("a"), "c": F.col("c")}, [0.25, 0.5]) == {"a": [4999.75, 9999.5], "c": [0.75, 1.5]}
    assert made == [False, True]


def test_large_groups_with_infinities_take_one_sketch_pass(spark, monkeypatch):
    """The costly ``percentile_approx`` is not run over the rows; a group without values has no row."""
    from millwright.operators import quantiles

    plans = []
    write = quantiles.materialize
    monkeypatch.setattr(quantiles, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    inf = float("inf")
    d = spark.range(12000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 < 2, F.when(F.col("id") % 5 == 0, F.lit(inf)).when(F.col("id") % 5 == 1, F.lit(-inf)).otherwise(F.rand(9) - 0.5)).alias("a"))
    d = write(d, "infinite-doubles")
    got = {r["g"]: list(r["q"]) for r in quantile_table(d, {"a": F.col("a")}, PROBS, ["g"]).collect()}
    ref = {r["g"]: list(r["a"]) for r in d.filter("g < 2").groupBy("g").agg(F.percentile("a", F.array(*map(F.lit, PROBS))).alias("a")).collect()}
    assert got == ref and set(got) == {0, 1}
    assert [n for n, _ in plans] == ["quantile-brackets", "quantile-values"] and not any("percentile_approx" in p for _, p in plans)
