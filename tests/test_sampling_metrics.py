import math

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from millwright.operators import metrics as E
from millwright.operators import sampling as B


def test_two_level_rank_equals_global_order(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    r = B.two_level_rank(df, ["g"], B.md5_key("k"), F.col("k"))
    w = Window.partitionBy("g").orderBy(B.md5_key("k"), "k")
    ref = df.withColumn("ref", F.row_number().over(w))
    j = r.join(ref, ["k", "g"])
    assert j.filter(F.col("rank") != F.col("ref")).count() == 0
    assert j.count() == 5000


def test_split_partitions_and_keeps_rates(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    s = B.stratified_split(df, "y", "k")
    assert s.count() == 3000 and s.select("k").distinct().count() == 3000
    rates = {r["split"]: r["rate"] for r in s.groupBy("split").agg(F.avg("y").alias("rate")).collect()}
    for v in rates.values():
        assert abs(v - 0.1) < 0.005
    sizes = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert sizes == {"test": 600, "val": 300, "train": 2100}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4)).round(3)
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, v array<double>")
    got = {(r["id"], r["nn_rank"]): r["nn_id"] for r in B.knn_within(df, "id", "v", 3).collect()}
    for i in range(60):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[i] = np.inf
        order = np.lexsort((np.arange(60), np.round(d, 9)))[:3]
        for r, j in enumerate(order, 1):
            assert got[(i, r)] == j


def test_smote_points_on_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(size=3)], 1 if i < 20 else 0) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, y int")
    syn, info = B.smote(df, "y", "id", "v")
    assert info["n_new"] == math.floor(0.38 * 100 - 20)
    vec = {r[0]: np.array(r[1]) for r in rows}
    out = syn.collect()
    assert len(out) == info["n_new"]
    for r in out:
        a, b = vec[r["base_id"]], vec[r["nn_id"]]
        assert np.allclose(np.array(r["v"]), a + r["gap"] * (b - a))


def test_smote_skipped_when_above_ratio(spark):
    df = spark.createDataFrame([(i, [float(i)], 1 if i < 50 else 0) for i in range(100)], "id long, v array<double>, y int")
    syn, info = B.smote(df, "y", "id", "v")
    assert info.get("skipped") and syn.count() == 0


def _auc_brute(y, s):
    pos = [a for a, b in zip(s, y) if b == 1]
    neg = [a for a, b in zip(s, y) if b == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def _ap_brute(y, s):
    P = sum(y)
    thr = sorted(set(s), reverse=True)
    ap, prev_r = 0.0, 0.0
    for t in thr:
        tp = sum(1 for a, b in zip(s, y) if a >= t and b == 1)
        fp = sum(1 for a, b in zip(s, y) if a >= t and b == 0)
        r = tp / P
        ap += (r - prev_r) * (tp / (tp + fp))
        prev_r = r
    return ap


def test_auc_ap_with_ties(spark):
    rng = np.random.default_rng(3)
    y = [int(v) for v in rng.integers(0, 2, 300)]
    s = [float(v) for v in np.round(rng.random(300) * 0.5 + np.array(y) * 0.3, 1)]   # heavy ties
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    auc = E.roc_auc(df, []).first()["roc_auc"]
    ap = E.average_precision(df, []).first()["pr_auc"]
    assert abs(auc - _auc_brute(y, s)) < 1e-12
    assert abs(ap - _ap_brute(y, s)) < 1e-12


def test_single_class_constants(spark):
    df = spark.createDataFrame([(1, 0.3), (1, 0.9)], "label int, score double")
    assert E.roc_auc(df, []).first()["roc_auc"] == 0.95
    assert E.average_precision(df, []).first()["pr_auc"] == 0.85


def test_rates_zero_division(spark):
    cm = spark.createDataFrame([(10, 0, 0, 0)], "tn long, fp long, fn long, tp long")
    r = E.rates(cm).first()
    assert (r["precision"], r["recall"], r["f1_score"], r["mcc"], r["accuracy"]) == (0.0, 0.0, 0.0, 0.0, 100.0)


def test_roc_curve_starts_at_origin_and_ends_at_one(spark):
    rng = np.random.default_rng(5)
    y = [int(v) for v in rng.integers(0, 2, 500)]
    s = [float(v) for v in rng.random(500).round(3)]
    df = spark.createDataFrame(list(zip(y, s)), "label int, score double")
    pts = sorted((r["point_no"], r["fpr"], r["tpr"]) for r in E.roc_curve(df, [], max_points=35).collect())
    assert pts[0][1:] == (0.0, 0.0) and pts[-1][1:] == (1.0, 1.0) and len(pts) <= 35
    pr = sorted((r["point_no"], r["recall"], r["precision"]) for r in E.pr_curve(df, [], max_points=35).collect())
    assert pr[-1][1:] == (0.0, 1.0) and len(pr) <= 35


def test_knn_with_many_cells_and_split_cells_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate((rng.normal(0, 1, (150, 3)), rng.normal(9, 0.1, (100, 3)), np.zeros((10, 3))))
    df = spark.createDataFrame([(f"k{i:03d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, v array<double>")
    monkeypatch.setattr(B, "CELL_ROWS", 20)
    monkeypatch.setattr(B, "QUERY_ROWS", 16)
    got = {(r["id"], r["nn_rank"]): r["nn_id"] for r in B.knn_within(df, "id", "v", 4).collect()}
    for i in range(len(x)):
        dist = np.round(np.sqrt(((x[i] - x) ** 2).sum(axis=1)), 9)
        want = [j for j in np.lexsort((np.arange(len(x)), dist)) if j != i][:4]
        assert [got[f"k{i:03d}", r + 1] for r in range(4)] == [f"k{j:03d}" for j in want]


def test_curves_of_one_model_with_all_scores_distinct(spark):
    rng = np.random.default_rng(9)
    n = 3000
    score, label = rng.random(n), rng.integers(0, 2, n)
    df = spark.createDataFrame([("m", int(y), float(s)) for y, s in zip(label, score)], "model string, label int, score double")
    order = np.argsort(-score)
    tp, fp = np.cumsum(label[order]), np.cumsum(1 - label[order])
    auc = E.roc_auc(df, ["model"]).first()["roc_auc"]
    rank = np.empty(n)
    rank[np.argsort(score)] = np.arange(1, n + 1)
    pos = int(label.sum())
    assert abs(auc - (rank[label == 1].sum() - pos * (pos + 1) / 2) / (pos * (n - pos))) < 1e-9
    keep = [i for i in range(n) if i in (0, n - 1) or tp[i + 1] - 2 * tp[i] + tp[i - 1] or fp[i + 1] - 2 * fp[i] + fp[i - 1]]
    want = [(0.0, 0.0)] + [(round(fp[i] / (n - pos), 4), round(tp[i] / pos, 4)) for i in keep]
    got = [(r["fpr"], r["tpr"]) for r in E.roc_curve(df, ["model"]).orderBy("point_no").collect()]
    assert len(got) == len(want) and all(abs(a - c) < 2e-4 and abs(b - d) < 2e-4 for (a, b), (c, d) in zip(got, want))
    assert E.pr_curve(df, ["model"]).count() == n + 1 and E.roc_curve(df, [], max_points=35).count() == 35
