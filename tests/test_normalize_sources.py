from pyspark.sql import functions as F

from millwright.operators import normalize as N
from millwright.sources import io as IO
from millwright.sources.catalog import resolve

import pytest


def test_sanitize_names():
    assert N.sanitize_name("Air temperature [K]") == "Air_temperature_K"
    assert N.sanitize_name("a/b, c:d <e>") == "a_b_c_d_e"


def test_target_detection_paths(spark):
    by_name = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, status string")
    d, info = N.normalize(by_name)
    assert info["detected_target"] == "status"
    assert [r[0] for r in d.select(N.TARGET).collect()] == [0, 0, 0]   # text → 0
    by_content = spark.createDataFrame([(5, 0, 1.0), (6, 1, 2.0)], "id int, q int, v double")
    _, info = N.normalize(by_content)
    assert info["detected_target"] == "q"
    all_null = spark.createDataFrame([(5, None), (6, None)], "id int, z double")
    _, info = N.normalize(all_null)
    assert info["detected_target"] == "z"   # empty set is a subset


def test_synthesized_target_rate(spark):
    df = spark.range(1000).select((F.col("id") * 1.0).alias("a"), ((F.col("id") * 7) % 13).cast("double").alias("b"))
    d, info = N.normalize(df)
    assert info["detected_target"] == "Synthesized Anomaly Target"
    rate = d.agg(F.avg(N.TARGET)).first()[0]
    assert 0.04 <= rate <= 0.08


def test_upload_gate_29_30(spark):
    assert not IO.upload_gate(spark.range(29))
    assert IO.upload_gate(spark.range(30))


def test_unknown_key_raises(spark, tmp_path):
    with pytest.raises(ValueError):
        resolve("no_such_dataset")
    (tmp_path / "mine.csv").write_text("a,b\n1,2\n")
    assert resolve("mine", str(tmp_path), spark)["custom"]


def test_malformed_lines_are_set_aside(spark):
    from millwright.session import scratch_path
    from millwright.sources import io as IO

    folder = scratch_path(spark, "t-drop-in")
    lines = ["id,load,name", "1,2.5,a", "2", "3,4,b,extra", "4,,\"c, d\"", "5, 7 ,", "", "6,1e3,f"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(f"{folder}/plant.csv")
    good, rejects = IO.load_custom_checked(spark, "plant", folder)
    assert good.dtypes == [("id", "bigint"), ("load", "double"), ("name", "string")]
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 2.5, "a"), (4, None, "c, d"), (5, 7.0, None), (6, 1000.0, "f")]
    assert sorted(r["line"] for r in rejects.collect()) == ["2", "3,4,b,extra"]
    assert IO.load_custom(spark, "plant", folder).count() == 4
