import math

from pyspark.sql import functions as F

from millwright.operators import labels as L
from millwright.operators import prescribe as R


def test_milling_rules_on_thresholds(spark):
    # (air, proc, rpm, torque, wear, tier): ΔT exactly 8.6 is not < 8.6; rpm 1380 is not < 1380
    rows = [
        ("hdf_edge", 300.0, 308.6, 1379.0, 40.0, 10.0, "M"),
        ("hdf", 300.0, 308.5, 1379.0, 40.0, 10.0, "M"),
        ("rpm_edge", 300.0, 308.5, 1380.0, 40.0, 10.0, "M"),
        ("osf_L", 300.0, 310.0, 1500.0, 55.0, 201.0, "L"),
        ("ok", 300.0, 310.0, 1500.0, 40.0, 10.0, "H"),
    ]
    df = spark.createDataFrame(rows, "rk string, air double, proc double, rpm double, torque double, wear double, tier string")
    out = {r["rk"]: r for r in L.milling_flags(df, F.lit(230), F.lit(False)).collect()}
    assert out["hdf"]["hdf"] == 1 and out["hdf"]["failure_mode"] == "HDF (Heat Dissipation)"
    assert out["rpm_edge"]["hdf"] == 0
    assert out["osf_L"]["osf"] == 1  # 201*55 = 11055 > 11000 (tier L)
    assert out["ok"]["machine_failure"] == 0 and out["ok"]["failure_mode"] == "No Failure"
    # ΔT computed on doubles: 308.6 - 300.0 is 8.600000000000023 → not < 8.6
    assert out["hdf_edge"]["hdf"] == (1 if (308.6 - 300.0) < 8.6 else 0)


def test_last_rule_wins(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    out = L.rule_set_labels(df, [("first", "a > 0"), ("second", "b > 0")]).first()
    assert out["failure_mode"] == "second" and out["machine_failure"] == 1


def test_severity_boundaries(spark):
    rows = [(68.0, 90.0, 100.0), (67.99, 90.0, 100.0), (36.0, 90.0, 100.0), (18.0, 90.0, 100.0),
            (10.0, 76.0, 100.0), (10.0, 90.0, 18.0), (10.0, 90.0, 48.0), (10.0, 90.0, 200.0)]
    df = spark.createDataFrame(rows, "p double, h double, r double")
    got = [x[0] for x in df.select(R.severity(F.col("p"), F.col("h"), F.col("r"))).collect()]
    assert got == ["CRITICAL", "WARNING", "WARNING", "ADVISORY", "ADVISORY", "CRITICAL", "WARNING", "OPTIMAL"]


def test_plant_precedence(spark):
    # vib 8 & temp 90 & dB 95: seizure and resonance both fire; seizure is applied last
    df = spark.createDataFrame([("x", 8.0, 90.0, 10.0, 95.0, 40.0, 100.0)],
                               "rk string, `Vibration RMS [mm/s]` double, `Bearing Temp [C]` double, `Spindle Current [A]` double, "
                               "`Acoustic Emission [dB]` double, `Lubricant Viscosity [cSt]` double, `Operating Hours [h]` double")
    r = L.plant_labels(df).first()
    assert r["failure_mode"] == "Bearing Thermal Seizure" and r["machine_failure"] == 1
    assert 1.0 <= r["rul"] <= 12.0
