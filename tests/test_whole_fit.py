"""Models are fitted on all rows of their splits, however many; boosted trees do not depend on where the rows are."""

import numpy as np
from pyspark.sql import functions as F

from millwright.operators import boosting as BO
from millwright.operators import models as M
from millwright.operators import sampling as B
from millwright.operators.lab import RUL, ModelLab
from millwright.plans import q_models as Q

SMALL = M.ModelConfig(gbt_iter=4, gbt_depth=3, leaf_depth=3, leaves=5, rf_trees=3, rf_depth=3, lr_iter=5, mlp_iter=4, mlp_steps=2, rul_iter=3, rul_depth=3, rul_subsample=1.0)


def _rows(spark, n):
    x = [F.rand(i).alias(c) for i, c in enumerate("abc")]
    d = spark.range(0, n, 1, 3).select(F.concat(F.lit("k"), "id").alias("rk"), *x)
    return d.withColumns({"machine_failure": (F.col("a") + 0.4 * F.col("b") > 1.15).cast("int"), "rul": 100 - 90 * F.col("a")}).localCheckpoint()


def test_every_row_of_the_split_is_fitted(spark):
    lab = ModelLab(_rows(spark, 12000), ["a", "b", "c"], cfg=SMALL)
    n = {s: sum(v for (k, _), v in lab.sizes.items() if k == s) for s in ("train", "val")}
    assert lab.train.count() == n["train"] > 6000
    model = lab.fitted(RUL)[RUL]
    assert [r[7] for r in model.nodes if r[1] == 0] == [n["train"] + n["val"]] * 3           # the root's cover counts the rows
    both, info = lab.oversampled
    assert info["n_min"] + info["n_maj"] == n["train"] and both.count() == n["train"] + info["n_new"]


def test_the_queries_bound_no_fitting_rows(spark):
    assert Q.lab(spark, "/root/testdata/sf0.001").fit_rows is None


def test_trees_are_the_same_in_one_task_and_in_many(spark, monkeypatch):
    d = _rows(spark, 3000)
    for label, cfg in (("machine_failure", BO.Boosting(4, 4, 0.2, row_share=0.8, feature_share=0.7)),
                       ("machine_failure", BO.Boosting(3, 6, 0.2, leaves=7, least_rows=20, least_weight=1e-3, l2=0.0)),
                       ("rul", BO.Boosting(3, 4, 0.2, row_share=0.9, logistic=False))):
        one = BO.fit(d, ["a", "b", "c"], label, cfg, "rk")
        with monkeypatch.context() as m:
            for name, v in (("ONE_TASK_ROWS", 0), ("TASK_ROWS", 500), ("FAN_IN", 2), ("LINEAGE", 2)):
                m.setattr(BO, name, v)
            many = BO.fit(d.repartition(6), ["a", "b", "c"], label, cfg, "rk")
        assert len(one.nodes) > 20 and many == one


def test_leaf_wise_trees_split_the_most_gainful_leaf_first():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (3000, 3)).astype(float)
    y = ((x[:, 0] > 20) ^ (x[:, 1] * x[:, 2] > 300)).astype(float)
    whole = BO.grow(x, y, BO.Boosting(1, 5, 0.2, least_rows=20))[1]
    few = BO.grow(x, y, BO.Boosting(1, 5, 0.2, leaves=6, least_rows=20))[1]
    by = {r[1]: r for r in whole}
    heap, taken = [0], []
    while len(taken) < 5:
        k = max((i for i in heap if by[i][2] >= 0), key=lambda i: by[i][8])
        heap.remove(k)
        heap += by[k][4:6]
        taken.append((by[k][2], by[k][3], round(by[k][8], 9)))
    assert sorted(taken) == sorted((r[2], r[3], round(r[8], 9)) for r in few if r[2] >= 0)


def test_bins_of_values_beyond_the_points():
    v = np.random.default_rng(5).normal(size=50_000)
    edges = BO._edges(*BO._merged(*[np.concatenate(c) for c in zip(*(BO._points(p, np.ones(len(p))) for p in np.split(v, 5)))]))
    share = np.diff(np.searchsorted(np.sort(v), edges)) / len(v)
    assert 245 <= len(edges) <= 254 and share.max() < 2.5 / BO.BINS


def test_a_query_asks_only_cells_within_its_bound(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.random((600, 2)), rng.random((600, 2)) + 50))
    d = spark.createDataFrame([(f"k{i:04d}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, v array<double>")
    monkeypatch.setattr(B, "CELL_ROWS", 100)
    written, keep = {}, B.materialize
    monkeypatch.setattr(B, "materialize", lambda df, name: written.setdefault(name, keep(df, name)))
    got = {(r["id"], r["nn_rank"]): r["nn_id"] for r in B.knn_within(d, "id", "v", 3).collect()}
    assert written["knn-asked"].count() < 1200 * 2                                        # of eleven other cells
    for i in range(0, 1200, 37):
        order = [j for j in np.lexsort((np.arange(1200), np.round(np.sqrt(((x[i] - x) ** 2).sum(axis=1)), 9))) if j != i][:3]
        assert [got[f"k{i:04d}", r + 1] for r in range(3)] == [f"k{j:04d}" for j in order]


def test_explanations_cross_no_exchange(spark):
    """Every row of attributions was shuffled by its key to meet its score, and written twice."""
    ctx = ModelLab(_rows(spark, 400), ["a", "b", "c"], cfg=SMALL)
    ctx._made["champion"] = M.LEAFY
    ctx._made[f"model-{M.LEAFY}"] = M.fit_leafy(ctx.train, ctx.features, SMALL)
    d, name = Q.explained(spark, ctx)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert name == M.LEAFY and "Join" not in plan and "Repartition" in plan
    got = d.toPandas()
    margin = got["base"] + np.stack(got["shap"]).sum(axis=1)
    assert len(got) == 400 and np.abs(1 / (1 + np.exp(-margin)) - got["score"]).max() < 1e-9


def test_a_replica_works_out_one_md5_a_sensor(spark):
    from millwright.functions.exprs import clip, hash_normal, np_round
    from millwright.streaming import monitor as T

    d = spark.createDataFrame([("a", 1.5, 100.0), ("b", None, 300.0), (None, 2.5, None)], "rk string, air double, rpm double")
    rng = {c: {"std": 2.0, "min": 0.0, "max": 200.0} for c in ("air", "rpm")}
    got = T.perturbed_replicas(d, ["air", "rpm"], rng, 2)
    assert got.columns == ["rk", "air", "rpm", "replica"]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 2
    key = F.concat(F.col("rk"), F.lit("#"), F.col("replica").cast("string"))
    want = d.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(1)))).select("rk", *[np_round(clip(F.col(c) + F.lit(0.04 * 2.0) * hash_normal(key, c), 0.0, 200.0), n).alias(c) for c, n in (("air", 2), ("rpm", 0))], "replica")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
