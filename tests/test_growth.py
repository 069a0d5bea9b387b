"""What must not grow: the code of a label, the tasks that read a whole split, the passes over the texts."""

from pyspark import TaskContext
from pyspark.sql import functions as F

from millwright.llm import simhash
from millwright.operators import labels as L
from millwright.operators.lab import ModelLab


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_label_terms_are_written_out_once(spark):
    """``clip`` names its argument twice; nested clips doubled the plan at every level."""
    names = [f"s{i}" for i in range(7)]
    t = spark.createDataFrame([("a", "L", 300.1, 309.5, 1400.0, 40.0, 100.0, 1, *[float(i) for i in range(7)])],
                              "rk string, tier string, air double, proc double, rpm double, torque double, wear double, machine_failure int, " + ", ".join(f"{n} double" for n in names))
    assert _plan(L.milling_degradation(t)).count("isnull") < 40
    assert _plan(L.domain_stress_labels(t, [(n, 1.0, 1.0, 0.0, 9.0) for n in names])).count("isnull") < 40
    r = L.domain_stress_labels(t.withColumn("s0", F.lit(None).cast("double")), [(n, 1.0, 1.0, 0.0, 9.0) for n in names]).first()
    assert r["stress"] is None and r["health"] is None
    r = L.domain_stress_labels(t, [(n, 1.0, 1.0, 0.0, 9.0) for n in names]).first()
    assert abs(r["stress"] - (0.4 + 0.0 + 0.4 + 0.8 + 1.2 + 1.2 + 1.2) / 7) < 1e-12


def test_a_fitting_sample_is_filtered_by_many_tasks(spark):
    rows = spark.range(0, 400, 1, 8).select(F.col("id").cast("string").alias("rk"), (F.col("id") % 4 == 0).cast("int").alias("machine_failure"), F.col("id").cast("double").alias("x"))
    ctx = ModelLab(rows, ["x"], fit_rows=40)
    # a split of many files, as a large table has
    path = ctx.split.inputFiles()[0].rsplit("/", 1)[0] + "-many"
    ctx.split.repartition(8).write.parquet(path)
    ctx._made["split"] = spark.read.parquet(path)
    task = F.udf(lambda v: TaskContext.get().partitionId(), "int")
    ctx._made["split"] = spark.read.parquet(path).withColumn("task", task("x"))
    few = ctx.train
    assert few.count() == 40 and few.rdd.getNumPartitions() == 1
    keys = [r["rk"] for r in few.collect()]
    assert keys == sorted(keys)
    assert few.select("task").distinct().count() > 1       # else one task reads every file


def test_texts_are_fingerprinted_once(spark, monkeypatch):
    passes = []
    once = simhash.fingerprint
    monkeypatch.setattr(simhash, "fingerprint", lambda *a: passes.append(1) or once(*a))
    docs = spark.createDataFrame([(1, "a b c d e", 9), (1, "a b c d e", 9), (1, "A b c d e", 9), (2, "a b c d e", 9), (3, None, 0), (None, "", 0), (4, "one two three four five six", 9)], "doc_id long, text string, n_chars long")
    kept = sorted((r["doc_id"], r["text"].lower() if r["text"] else r["text"]) for r in simhash.deduplicate(docs).collect())
    assert kept == [(1, "a b c d e"), (3, None), (4, "one two three four five six")]
    assert len(passes) == 1
