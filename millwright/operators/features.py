"""Feature engineering.

Column roles are passed by name so the same operators run on the reference's
bracketed names or on short adapter names.  Output feature names are snake-case;
``FEATURE_LABELS`` maps them to the reference's display names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators.quantiles import exact_quantiles

# --- fixed values: display names of engineered features ---
FEATURE_LABELS = {
    "temp_diff": "Temp Diff [K]",
    "power_w": "Mechanical Power [W]",
    "overstrain": "Overstrain Index [Nm*min]",
    "thermal_ratio": "Thermal Ratio",
    "torque_per_krpm": "Torque per kRPM",
    "thermal_margin": "Thermal Margin HPC/LPT",
    "core_fan_ratio": "Core-to-Fan Speed Ratio",
    "pressure_fuel_eff": "Pressure-Fuel Efficiency",
    "total_coolant_bleed": "Total Coolant Bleed [lbm/s]",
    "vibro_thermal_stress": "Vibro-Thermal Stress",
    "electro_acoustic_index": "Electro-Acoustic Index",
    "interaction_stress_index": "Interaction Stress Index",
    "multi_sensor_load_ratio": "Multi-Sensor Load Ratio",
}

# --- fixed values: metadata columns never treated as sensors ---
METADATA_COLS = {
    "UDI", "UID", "Product ID", "unit_id", "Machine failure", "Failure Mode",
    "TWF", "HDF", "PWF", "OSF", "RNF", "RUL [min]", "Health Index [%]",
}


@dataclass(frozen=True)
class Milling:
    air: str = "Air temperature [K]"
    proc: str = "Process temperature [K]"
    rpm: str = "Rotational speed [rpm]"
    torque: str = "Torque [Nm]"
    wear: str = "Tool wear [min]"
    tier: str = "Type"


SHORT_MILLING = Milling("air", "proc", "rpm", "torque", "wear", "tier")


def tier_encode(df: DataFrame, tier_col: str = "Type", out: str = "type_encoded") -> DataFrame:
    """F1: L/M/H → 0/1/2 after upper-casing; unknown → 1; missing column → 1.0."""
    if tier_col not in df.columns:
        return df.withColumn(out, F.lit(1.0))
    u = F.upper(col(tier_col).cast("string"))
    return df.withColumn(
        out, F.when(u == "L", 0.0).when(u == "M", 1.0).when(u == "H", 2.0).otherwise(1.0)
    )


MILLING_FEATURES = ("temp_diff", "power_w", "overstrain", "thermal_ratio", "torque_per_krpm")


def milling_feature_exprs(m: Milling = Milling()) -> dict[str, Column]:
    air, proc, rpm, torque, wear = (col(c) for c in (m.air, m.proc, m.rpm, m.torque, m.wear))
    return {
        "temp_diff": np_round(proc - air, 2),
        "power_w": np_round(torque * (rpm * F.lit(2.0 * math.pi / 60.0)), 1),
        "overstrain": np_round(wear * torque, 1),
        "thermal_ratio": np_round(proc / F.greatest(air, F.lit(1.0)), 4),
        "torque_per_krpm": np_round(torque / F.greatest(rpm / 1000.0, F.lit(0.1)), 2),
    }


def milling_features(df: DataFrame, m: Milling = Milling()) -> DataFrame:
    """physics features of the milling set."""
    return df.withColumns(milling_feature_exprs(m))


@dataclass(frozen=True)
class Turbofan:
    # --- fixed values: the turbofan set's column names ---
    s2: str = "s2_LPC_temp [R]"
    s3: str = "s3_HPC_temp [R]"
    s4: str = "s4_LPT_temp [R]"
    s7: str = "s7_HPC_pressure [psia]"
    s8: str = "s8_fan_speed [rpm]"
    s9: str = "s9_core_speed [rpm]"
    s12: str = "s12_fuel_flow_ratio"
    s20: str = "s20_HPT_coolant_bleed"
    s21: str = "s21_LPT_coolant_bleed"


SHORT_TURBOFAN = Turbofan("s2", "s3", "s4", "s7", "s8", "s9", "s12", "s20", "s21")
TURBOFAN_FEATURES = ("thermal_margin", "core_fan_ratio", "pressure_fuel_eff", "total_coolant_bleed")


def turbofan_features(df: DataFrame, t: Turbofan = SHORT_TURBOFAN) -> DataFrame:
    """turbofan ratios."""
    one = F.lit(1.0)
    return df.withColumns(dict(zip(TURBOFAN_FEATURES, (
        np_round((col(t.s3) + col(t.s4)) / F.greatest(col(t.s2), one), 4),
        np_round(col(t.s9) / F.greatest(col(t.s8), one), 4),
        np_round(col(t.s7) / F.greatest(col(t.s12), one), 4),
        np_round(col(t.s20) + col(t.s21), 3),
    ), strict=True)))


def sensor_columns(df: DataFrame, extra_exclude: set[str] | None = None) -> list[str]:
    """Numeric columns that are not metadata, in schema order."""
    from pyspark.sql.types import NumericType

    ex = METADATA_COLS | {"type_encoded", "Type_Encoded"} | (extra_exclude or set())
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType) and f.name not in ex]


def generic_features(df: DataFrame, raw_cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Plant features when their inputs exist, else the generic interaction fallback."""
    cols = set(df.columns)
    eng: dict[str, Column] = {}
    if {"Vibration RMS [mm/s]", "Bearing Temp [C]"} <= cols:
        eng["vibro_thermal_stress"] = np_round(col("Vibration RMS [mm/s]") * col("Bearing Temp [C]") / 100.0, 2)
    if {"Spindle Current [A]", "Acoustic Emission [dB]"} <= cols:
        eng["electro_acoustic_index"] = np_round(col("Spindle Current [A]") * col("Acoustic Emission [dB]") / 100.0, 2)
    if not eng and len(raw_cols) >= 2:
        c1, c2 = col(raw_cols[0]), col(raw_cols[1])
        eng["interaction_stress_index"] = np_round(c1 * c2 / 10.0, 2)
        if len(raw_cols) >= 3:
            eng["multi_sensor_load_ratio"] = np_round(col(raw_cols[2]) / F.greatest(F.abs(c1), F.lit(0.1)), 3)
    return df.withColumns(eng), list(eng)


def engineer(df: DataFrame, dataset_key: str, raw_cols: list[str], m: Milling = Milling()) -> tuple[DataFrame, list[str]]:
    """Dispatch F2 / F3 / F4–F6 the way the reference picks a rule set."""
    names = set(df.columns)
    if dataset_key == "ai4i2020" or {m.air, m.proc, m.rpm, m.torque, m.wear} <= names:
        return milling_features(df, m), list(milling_feature_exprs(m))
    for t in (Turbofan(), SHORT_TURBOFAN):
        if t.s3 in names:
            return turbofan_features(df, t), list(TURBOFAN_FEATURES)
    return generic_features(df, raw_cols)


def operating_ranges(df: DataFrame, sensors: list[str], exact: bool = True) -> DataFrame:
    """per-sensor min/max/median/mean/std/q01/q99 (4 dp) and slider step, one aggregate + unpivot.

    Exact percentiles come from range refinement (``quantiles``) and enter as literals."""
    probs = [0.01, 0.5, 0.99]
    ps = F.array(*[F.lit(p) for p in probs])
    qx = exact_quantiles(df, {c: col(c) for c in sensors}, probs) if exact else {}
    aggs = []
    for i, c in enumerate(sensors):
        v = col(c)
        q = (F.array(*[F.lit(x).cast("double") for x in qx[c]]) if exact
             else F.percentile_approx(v, ps, 100_000))
        aggs.append(F.struct(
            F.lit(c).alias("sensor"), F.lit(i).alias("position"),
            F.min(v).cast("double").alias("mn"), F.max(v).cast("double").alias("mx"),
            F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), q.alias("q"),
        ).alias(f"r{i}"))
    wide = df.agg(*aggs)
    long = wide.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(sensors))])).alias("r")).select("r.*")
    rng = F.col("mx") - F.col("mn")
    step = F.when(rng > 0, np_round(rng / 200.0, 4)).otherwise(F.lit(0.1))
    return long.select(
        "position", "sensor",
        np_round(F.col("mn"), 4).alias("min"), np_round(F.col("mx"), 4).alias("max"),
        np_round(F.col("q")[1], 4).alias("median"), np_round(F.col("mean"), 4).alias("mean"),
        np_round(F.col("std"), 4).alias("std"), np_round(F.col("q")[0], 4).alias("q01"),
        np_round(F.col("q")[2], 4).alias("q99"), F.greatest(step, F.lit(0.001)).alias("step"),
    )


def feature_baseline(df: DataFrame, features: list[str]) -> DataFrame:
    """F8: fill null with 0, then mean and (sample std + 1e-6) per feature (long form)."""
    filled = [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in features]
    wide = df.agg(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), F.avg(e).alias("mean"),
                             (F.stddev_samp(e) + F.lit(1e-6)).alias("std")).alias(f"r{i}")
                    for i, (c, e) in enumerate(zip(features, filled))])
    return wide.select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(features))])).alias("r")).select("r.*")


def assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    """feature vector in a fixed order (nulls → 0 as the reference's ``fillna(0)``)."""
    filled = df.withColumns({f"__f{i}": F.coalesce(col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)})
    va = VectorAssembler(inputCols=[f"__f{i}" for i in range(len(features))], outputCol=out)
    return va.transform(filled).drop(*[f"__f{i}" for i in range(len(features))])


def standardize(df: DataFrame, features: list[str], suffix: str = "_z") -> DataFrame:
    """(x − mean) / population std (scikit-learn convention; constant column → 0)."""
    stats = df.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_pop(col(c)).alias("s")).alias(f"s{i}")
                     for i, c in enumerate(features)]).first()
    exprs = {}
    for i, c in enumerate(features):
        m, s = stats[f"s{i}"]["m"], stats[f"s{i}"]["s"]
        s = 1.0 if (s is None or s == 0.0) else s
        exprs[c + suffix] = (col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(exprs)


def encode_modes(df: DataFrame, mode_col: str = "failure_mode", out: str = "mode_id") -> DataFrame:
    """failure modes → ids in alphabetical order (``StringIndexer`` alphabetAsc)."""
    si = StringIndexer(inputCol=mode_col, outputCol=out, stringOrderType="alphabetAsc", handleInvalid="keep")
    return si.fit(df).transform(df)
