"""Evaluation (E1–E13) and champion selection.

Input: a long table ``(model, label, score[, prediction])`` with one row per
(scored row, model), so every model is evaluated in the same grouped jobs.
Curve metrics first compress to distinct ``(model, score)`` with counts (a
partial aggregate), then prefix-sum the compressed table in score ranges — the
raw rows are never ordered, and a continuous score is not one task per model. AUC, average
precision and the confusion counts all come from that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.session import materialize

PCT = 100.0


def _pred(score: str, prediction: str | None) -> Column:
    return col(prediction) if prediction else (col(score) >= 0.5).cast("int")


def confusion(df: DataFrame, group: list[str], label="label", score="score", prediction: str | None = None) -> DataFrame:
    """Tn, fp, fn, tp per group."""
    y, p = col(label), _pred(score, prediction)
    return df.groupBy(*group).agg(
        F.count_if((y == 0) & (p == 0)).alias("tn"), F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"), F.count_if((y == 1) & (p == 1)).alias("tp"),
    )


def rates(cm: DataFrame) -> DataFrame:
    """E2 + E6: accuracy, precision, recall, F1 in % (2 dp; zero division → 0) and MCC (4 dp)."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(F.lit(0.0))
    f1 = F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(F.lit(0.0))
    den = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    mcc = F.when(den > 0, (tp * tn - fp * fn) / den).otherwise(F.lit(0.0))
    return cm.withColumns({
        "accuracy": np_round(F.when(n > 0, (tp + tn) / n).otherwise(F.lit(0.0)) * PCT, 2),
        "precision": np_round(prec * PCT, 2), "recall": np_round(rec * PCT, 2), "f1_score": np_round(f1 * PCT, 2),
        "mcc": np_round(mcc, 4),
    })


def brier(df: DataFrame, group: list[str], label="label", score="score") -> DataFrame:
    """Mean squared error of the probability, 4 dp."""
    return df.groupBy(*group).agg(np_round(F.avg(F.pow(col(score) - col(label), 2)), 4).alias("brier_score"))


def score_counts(df: DataFrame, group: list[str], label="label", score="score") -> DataFrame:
    """Compressed curve input: one row per (group, distinct score) with positive / negative counts."""
    return df.groupBy(*group, col(score).alias("s")).agg(
        F.count_if(col(label) == 1).alias("pos"), F.count_if(col(label) != 1).alias("neg"))


def _ranges(sc: DataFrame, keys: list[str]) -> DataFrame:
    """The score counts in order of score, written once, with ``__b``: the number of a row's score range, increasing with the score.

    Spark's range partitioning cuts the ranges (as many as the platform's partition size asks for), so no
    row carries a list of cuts, and whatever is computed from the result starts from this table.
    """
    return materialize(sc.repartitionByRange(*keys, "s").withColumn("__b", F.spark_partition_id()), "score-ranges")


def _running(df: DataFrame, keys: list[str], descending: bool, sums: dict[str, str], following: list[str] = ()) -> DataFrame:
    """Inclusive running sums (out → in) along the score, their totals (``all_<out>``), and the next row's values (``next_<c>``).

    Range totals first (a row per range), then a window inside each range: no task holds a
    group. A range's last row takes what follows from the first row of the next one.
    """
    down = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    first = (F.max if descending else F.min)(F.struct("s", *following)) if following else F.lit(None)
    parts = df.groupBy(*keys, "__b").agg(*[F.sum(v).alias(f"__t_{o}") for o, v in sums.items()], first.alias("__first"))
    wt = Window.partitionBy(*keys).orderBy(down("__b"))
    before = wt.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    parts = parts.select(*keys, "__b", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in sums], *[F.sum(f"__t_{o}").over(whole).alias(f"all_{o}") for o in sums],
                         F.lead("__first").over(wt).alias("__after"))
    w = Window.partitionBy(*keys, "__b").orderBy(down("s"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumns({**{f"__r_{o}": F.sum(v).over(upto) for o, v in sums.items()}, **{f"__n_{c}": F.lead(c).over(w) for c in following}})
    out = rows.join(parts, [*keys, "__b"]).withColumns({
        **{o: F.col(f"__o_{o}") + F.col(f"__r_{o}") for o in sums},
        **{f"next_{c}": F.coalesce(F.col(f"__n_{c}"), F.col(f"__after.{c}")) for c in following}})
    return out.drop("__after", *[f"__{x}_{o}" for o in sums for x in "or"], *[f"__n_{c}" for c in following])


def _keyed(sc: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    return (sc, list(group)) if group else (sc.withColumn("__g", F.lit(0)), ["__g"])


def _cumulate(sc: DataFrame, group: list[str], following: bool = False) -> tuple[DataFrame, list[str]]:
    """(rows, keys): over distinct scores from the highest down, cpos, cneg and idx (1-based), their totals
    all_…, and with ``following`` the next row's pos / neg."""
    sc, keys = _keyed(sc, group)
    c = _ranges(sc, keys).withColumn("__one", F.lit(1))
    return _running(c, keys, True, {"cpos": "pos", "cneg": "neg", "idx": "__one"}, ["pos", "neg"] if following else []).drop("__one"), keys


def curve_metrics(sc: DataFrame, group: list[str]) -> DataFrame:
    """E4 + E5 on the compressed (group, score, pos, neg) table, from one run of prefix sums.

    roc_auc: tie-aware (Mann–Whitney), 0.95 if only one class is present; pr_auc:
    Σ (R_n − R_{n−1}) · P_n over thresholds in descending score order, 0.85 if one class.
    """
    c, _ = _cumulate(sc, group)
    below = F.col("all_cneg") - F.col("cneg")                    # negatives of a smaller score
    u = F.col("pos") * (below + 0.5 * F.col("neg"))
    term = (F.col("pos") / F.col("all_cpos")) * (F.col("cpos") / (F.col("cpos") + F.col("cneg")))
    g = c.groupBy(*group).agg(F.sum(u).alias("u"), F.sum(F.when(F.col("all_cpos") > 0, term)).alias("ap"), F.max("all_cpos").alias("P"), F.max("all_cneg").alias("N"))
    both = (F.col("P") > 0) & (F.col("N") > 0)
    return g.select(*group, F.when(both, F.col("u") / (F.col("P") * F.col("N"))).otherwise(F.lit(0.95)).alias("roc_auc"),
                    F.when(both, F.col("ap")).otherwise(F.lit(0.85)).alias("pr_auc"))


def roc_auc(df: DataFrame, group: list[str], label="label", score="score") -> DataFrame:
    """E4 of scored rows."""
    return curve_metrics(score_counts(df, group, label, score), group).select(*group, "roc_auc")


def average_precision(df: DataFrame, group: list[str], label="label", score="score") -> DataFrame:
    """E5 of scored rows."""
    return curve_metrics(score_counts(df, group, label, score), group).select(*group, "pr_auc")


def _thinned(points: DataFrame, keys: list[str], sizes: DataFrame, most: int | None) -> DataFrame:
    """All points (numbered ``k`` from 0), or those at numpy ``linspace(0, n - 1, min(most, n)).astype(int)``.

    ``sizes``: one row per group with its number of points ``n_pts``; the wanted indexes are joined.
    """
    if most is None:
        return points.withColumn("point_no", F.col("k").cast("int"))
    n, k = F.col("n_pts"), F.least(F.col("n_pts"), F.lit(most))
    step = (n - 1).cast("double") / (k - 1).cast("double")
    at = F.transform(F.sequence(F.lit(0), (k - 1).cast("int")), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i.cast("double") * step)).cast("long"))
    wanted = sizes.select(*keys, F.posexplode(at).alias("point_no", "k"))
    return points.join(wanted, [*keys, "k"])


def roc_curve(df: DataFrame, group: list[str], label="label", score="score", max_points: int | None = None) -> DataFrame:
    """ROC points (fpr, tpr, 4 dp): distinct thresholds without the inner points of straight
    stretches, after (0, 0). ``max_points`` thins the curve to evenly indexed points."""
    c, keys = _cumulate(score_counts(df, group, label, score), group, following=True)
    tot = c.groupBy(*keys).agg(F.max("all_cpos").alias("P"), F.max("all_cneg").alias("N"))
    bends = (F.col("next_pos") != F.col("pos")) | (F.col("next_neg") != F.col("neg"))
    kept = c.filter((F.col("idx") == 1) | F.col("next_pos").isNull() | bends).drop("next_pos", "next_neg", "idx", "all_idx").withColumn("__one", F.lit(1))
    kept = _running(kept, keys, True, {"k": "__one"})
    sizes = kept.groupBy(*keys).agg((F.count(F.lit(1)) + 1).alias("n_pts"))
    zero = tot.select(*keys, F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("cpos"), F.lit(0).cast("long").alias("cneg"))
    pts = _thinned(kept.select(*keys, F.col("k").cast("long").alias("k"), "cpos", "cneg").unionByName(zero), keys, sizes, max_points).join(tot, keys)
    fpr = F.when(F.col("N") > 0, F.col("cneg") / F.col("N")).otherwise(F.lit(float("nan")))
    tpr = F.when(F.col("P") > 0, F.col("cpos") / F.col("P")).otherwise(F.lit(float("nan")))
    return pts.select(*group, "point_no", np_round(fpr, 4).alias("fpr"), np_round(tpr, 4).alias("tpr"))


def pr_curve(df: DataFrame, group: list[str], label="label", score="score", max_points: int | None = None) -> DataFrame:
    """precision–recall points over every distinct score, ascending score, then (R=0, P=1); thinned by ``max_points``."""
    c, keys = _cumulate(score_counts(df, group, label, score), group)
    c = c.withColumns({"P": F.col("all_cpos"), "D": F.col("all_idx")})
    tot = c.groupBy(*keys).agg(F.max("D").alias("D"))
    prec = F.when(F.col("cpos") + F.col("cneg") > 0, F.col("cpos") / (F.col("cpos") + F.col("cneg"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("P") > 0, F.col("cpos") / F.col("P")).otherwise(F.lit(1.0))
    # ascending-score position: k = D − idx (idx is 1-based in descending order)
    pts = c.select(*keys, (F.col("D") - F.col("idx")).alias("k"), prec.alias("precision"), rec.alias("recall"))
    end = tot.select(*keys, F.col("D").alias("k"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    sel = _thinned(pts.unionByName(end), keys, tot.select(*keys, (F.col("D") + 1).alias("n_pts")), max_points)
    return sel.select(*group, "point_no", np_round(F.col("recall"), 4).alias("recall"), np_round(F.col("precision"), 4).alias("precision"))


def rul_errors(df: DataFrame, group: list[str], truth="rul", pred="pred_rul") -> DataFrame:
    """MAE, RMSE (2 dp), R² (4 dp)."""
    e = col(pred) - col(truth)
    g = df.groupBy(*group).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sum(e * e).alias("sse"),
                               F.var_pop(col(truth)).alias("vp"), F.count(F.lit(1)).alias("n"))
    r2 = F.when(F.col("vp") > 0, F.lit(1.0) - F.col("sse") / (F.col("vp") * F.col("n"))).otherwise(F.lit(0.0))
    return g.select(*group, np_round(F.col("mae"), 2).alias("mae"), np_round(F.sqrt("mse"), 2).alias("rmse"),
                    np_round(r2, 4).alias("r2_score"))


def weighted_bce(df: DataFrame, group: list[str], pos_weight: float | Column, label="label", score="score") -> DataFrame:
    """Mean of −(w·y·ln p + (1−y)·ln(1−p)), p clipped to [1e-5, 1 − 1e-5]."""
    p = F.least(F.greatest(col(score), F.lit(1e-5)), F.lit(1.0 - 1e-5))
    w = pos_weight if isinstance(pos_weight, Column) else F.lit(float(pos_weight))
    y = col(label).cast("double")
    return df.groupBy(*group).agg(F.avg(-(w * y * F.log(p) + (F.lit(1.0) - y) * F.log(F.lit(1.0) - p))).alias("bce"))


def champion(board: DataFrame, f1="f1_score", order="model_no") -> DataFrame:
    """Highest F1 (already 2 dp); ties keep candidate order. Leaderboard is one row per model."""
    w = Window.orderBy(F.col(f1).desc(), F.col(order).asc())
    return board.withColumn("leaderboard_rank", F.row_number().over(w)).withColumn(
        "is_champion", F.col("leaderboard_rank") == 1)


def leaderboard(scored: DataFrame, group: list[str], split: str = "split", label="label", score="score") -> DataFrame:
    """One row per group with E1, E2, E4–E7 of the test split and E3, the accuracy on the train split.

    The scored rows are read once: they are compressed to counts per (group, split, distinct
    score), written, and every metric is a sum over those.
    """
    sc = materialize(score_counts(scored.filter(col(split).isin("test", "train")), [*group, split], label, score), "score-counts")
    sure, pos, neg = F.col("s") >= 0.5, F.col("pos"), F.col("neg")
    some = lambda n, at: F.sum(F.when(at, n).otherwise(0)).alias
    base = sc.groupBy(*group, split).agg(
        some(neg, ~sure)("tn"), some(neg, sure)("fp"), some(pos, ~sure)("fn"), some(pos, sure)("tp"),
        np_round(F.sum(pos * F.pow(F.col("s") - 1, 2) + neg * F.pow("s", 2)) / F.sum(pos + neg), 4).alias("brier_score"))
    b = rates(base)
    test, train = (b.filter(col(split) == part).drop(split) for part in ("test", "train"))
    curves = curve_metrics(sc.filter(col(split) == "test").drop(split), group)
    out = test.join(curves, group).join(train.select(*group, F.col("accuracy").alias("train_accuracy")), group, "left")
    return out.withColumns({"roc_auc": np_round(F.col("roc_auc") * PCT, 2), "pr_auc": np_round(F.col("pr_auc") * PCT, 2)})
