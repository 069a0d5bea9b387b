"""Registered queries: feature engineering."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators import features as FE
from millwright.operators import labels as L
from millwright.operators.quality import Cleaner, drop_exact_duplicates
from millwright.plans.oracles import TWO_PI_OVER_60, clean_ctes, oracle, q
from millwright.plans.q_labels import FLAGS_SQL
from millwright.plans.registry import register
from millwright.sources.catalog import DOMAIN_SPECS
from millwright.sources.fixtures import fixture

S = ["air", "proc", "rpm", "torque", "wear"]
MILL_SQL = (f"round_even(proc-air, 2) temp_diff, round_even(torque*(rpm*{TWO_PI_OVER_60}), 1) power_w, "
            f"round_even(wear*torque, 1) overstrain, round_even(proc/greatest(air, 1.0), 4) thermal_ratio, "
            f"round_even(torque/greatest(rpm/1000.0, 0.1), 2) torque_per_krpm")
ENC_SQL = "cast(case upper(tier) when 'L' then 0.0 when 'M' then 1.0 when 'H' then 2.0 else 1.0 end as double) type_encoded"


@register("q_f01_tier_encode", oracle(["tel_raw"], f"select rk, h, {ENC_SQL} from tel_raw"))
def f01(spark, sf):
    return FE.tier_encode(fixture(spark, sf, "tel_raw"), "tier").select("rk", "h", "type_encoded")


@register("q_f02_milling_features", oracle(["tel_clean"], f"select rk, {MILL_SQL} from tel_clean"))
def f02(spark, sf):
    d = FE.milling_features(fixture(spark, sf, "tel_clean"), FE.SHORT_MILLING)
    return d.select("rk", *FE.milling_feature_exprs(FE.SHORT_MILLING).keys())


@register("q_f03_turbofan_features", oracle(["unit_cycles"], "select unit_id, cycle, round_even((s3+s4)/greatest(s2, 1.0), 4) thermal_margin, "
                                                              "round_even(s9/greatest(s8, 1.0), 4) core_fan_ratio, round_even(s7/greatest(s12, 1.0), 4) pressure_fuel_eff, "
                                                              "round_even(s20+s21, 3) total_coolant_bleed from unit_cycles"))
def f03(spark, sf):
    d = FE.turbofan_features(fixture(spark, sf, "unit_cycles"))
    return d.select("unit_id", "cycle", "thermal_margin", "core_fan_ratio", "pressure_fuel_eff", "total_coolant_bleed")


_TURBOFAN_VECTOR = ["s2", "s3", "s4", "s7", "s8", "s9", "s12", "s20", "s21"]


@register("q_f09_assembled", oracle(["unit_cycles"], "select unit_id, cycle, cast(i - 1 as integer) position, coalesce(v[i], 0.0) value from (select unit_id, cycle, [" + ", ".join(f"cast({c} as double)" for c in _TURBOFAN_VECTOR)
                                    + ", round_even((s3+s4)/greatest(s2, 1.0), 4), round_even(s9/greatest(s8, 1.0), 4), round_even(s7/greatest(s12, 1.0), 4), round_even(s20+s21, 3)] v from unit_cycles) a, "
                                    "generate_series(1, 13) t(i)"))
def f09(spark, sf):
    """F3 + F9: engineer() on the turbofan set under its own column names, then the feature vector in a fixed order, by position."""
    named = FE.Turbofan()
    d = fixture(spark, sf, "unit_cycles").withColumnsRenamed({c: getattr(named, c) for c in _TURBOFAN_VECTOR})
    out, eng = FE.engineer(d, "cmapss", [])
    vec = FE.assemble(out, [*(getattr(named, c) for c in _TURBOFAN_VECTOR), *eng])
    return vec.select("unit_id", "cycle", F.posexplode(vector_to_array("features")).alias("position", "value"))


@register("q_f04_plant_features", oracle(["plant"], f"select rk, round_even({q('Vibration RMS [mm/s]')}*{q('Bearing Temp [C]')}/100.0, 2) vibro_thermal_stress, "
                                                    f"round_even({q('Spindle Current [A]')}*{q('Acoustic Emission [dB]')}/100.0, 2) electro_acoustic_index from plant"))
def f04(spark, sf):
    d = fixture(spark, sf, "plant")
    raw = FE.sensor_columns(d, {"h"})
    out, eng = FE.generic_features(d, raw)
    return out.select("rk", *eng)


def _f06_sql():
    parts = []
    for k, spec in DOMAIN_SPECS.items():
        c1, c2, c3 = (q(s[0]) for s in spec["sensors"][:3])
        parts.append(f"select '{k}' domain, rk, round_even({c1}*{c2}/10.0, 2) interaction_stress_index, "
                     f"round_even({c3}/greatest(abs({c1}), 0.1), 3) multi_sensor_load_ratio from domain_{k}")
    return oracle([f"domain_{k}" for k in DOMAIN_SPECS], "\nunion all\n".join(parts))


@register("q_f06_generic_features", _f06_sql)
def f06(spark, sf):
    from functools import reduce

    parts = []
    for k in DOMAIN_SPECS:
        d = fixture(spark, sf, f"domain_{k}")
        out, eng = FE.generic_features(d, FE.sensor_columns(d, {"h"}))
        parts.append(out.select(F.lit(k).alias("domain"), "rk", *eng))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _clean_model(spark, sf):
    raw = fixture(spark, sf, "tel_raw")
    m, work = Cleaner(S, "tier").fit_dedup(raw)
    return m.transform(work)


def _f07_sql():
    ctes = clean_ctes("tel_raw", S, ["rk", "h"])
    parts = []
    for i, c in enumerate(S):
        parts.append(f"select {i} position, '{c}' sensor, round_even(min({c}), 4) min, round_even(max({c}), 4) max, "
                     f"round_even(quantile_cont({c}, 0.5), 4) median, round_even(avg({c}), 4) mean, round_even(stddev_samp({c}), 4) std, "
                     f"round_even(quantile_cont({c}, 0.01), 4) q01, round_even(quantile_cont({c}, 0.99), 4) q99, "
                     f"greatest(case when max({c})-min({c}) > 0 then round_even((max({c})-min({c}))/200.0, 4) else 0.1 end, 0.001) step from cl")
    return oracle(["tel_raw"], "\nunion all\n".join(parts), ctes)


@register("q_f07_operating_ranges", _f07_sql)
def f07(spark, sf):
    return FE.operating_ranges(_clean_model(spark, sf), S)


def _f08_sql():
    ctes = clean_ctes("tel_raw", S, ["rk", "h"]) + [("fx", f"select *, {ENC_SQL}, {MILL_SQL} from cl")]
    feats = ["type_encoded"] + S + ["temp_diff", "power_w", "overstrain", "thermal_ratio", "torque_per_krpm"]
    parts = [f"select {i} position, '{c}' feature, round_even(avg(coalesce({c}, 0.0)), 6) mean, round_even(stddev_samp(coalesce({c}, 0.0)) + 1e-6, 6) std from fx"
             for i, c in enumerate(feats)]
    return oracle(["tel_raw"], "\nunion all\n".join(parts), ctes)


@register("q_f08_feature_baseline", _f08_sql)
def f08(spark, sf):
    d = FE.milling_features(FE.tier_encode(_clean_model(spark, sf), "tier"), FE.SHORT_MILLING)
    feats = ["type_encoded"] + S + list(FE.milling_feature_exprs(FE.SHORT_MILLING))
    b = FE.feature_baseline(d, feats)
    return b.select("position", "feature", np_round(F.col("mean"), 6).alias("mean"), np_round(F.col("std"), 6).alias("std"))


def _f10_sql():
    st = ", ".join(f"avg({c}) m_{c}, case when coalesce(stddev_pop({c}), 0) = 0 then 1.0 else stddev_pop({c}) end s_{c}" for c in S)
    sel = ", ".join(f"round_even(({c} - m_{c})/s_{c}, 6) {c}_z" for c in S)
    return oracle(["tel_clean"], f"select rk, {sel} from tel_clean cross join (select {st} from tel_clean) s")


@register("q_f10_standardize", _f10_sql)
def f10(spark, sf):
    d = FE.standardize(fixture(spark, sf, "tel_clean"), S)
    return d.select("rk", *[np_round(F.col(f"{c}_z"), 6).alias(f"{c}_z") for c in S])


@register("q_f11_mode_ids", oracle(["tel_clean"], f"select failure_mode, cast(dense_rank() over (order by failure_mode) - 1 as double) mode_id, n from "
                                                  f"(select failure_mode, count(*) n from ({FLAGS_SQL}) f group by failure_mode) g"))
def f11(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    d = L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0)
    e = FE.encode_modes(d, "failure_mode")
    return e.groupBy("failure_mode", "mode_id").agg(F.count(F.lit(1)).alias("n"))
