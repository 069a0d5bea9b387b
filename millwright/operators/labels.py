"""Rule labelling: fault flags, failure modes, RUL and health.

The reference draws thresholds and noise from an RNG; here every random draw
is ``hash_uniform(key, salt)`` so labels are reproducible, partition-independent
and identical in any engine.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import clip, col, hash_uniform, np_round
from millwright.operators.scoring import osf_limit

# --- fixed values: failure-mode names ---
MILLING_MODES = {
    "RNF": "RNF (Random Failure)",
    "TWF": "TWF (Tool Wear Failure)",
    "OSF": "OSF (Overstrain Failure)",
    "PWF": "PWF (Power Failure)",
    "HDF": "HDF (Heat Dissipation)",
}
TURBOFAN_MODES = [("HPC Degradation", 0.45), ("Fan Blade Erosion", 0.25), ("LPT Thermal Fatigue", 0.20),
                  ("High Pressure Bleed Leak", 0.10)]
PLANT_MODES = {
    "seizure": "Bearing Thermal Seizure",
    "lubrication": "Lubrication Breakdown",
    "motor": "Motor Winding Overload",
    "resonance": "Harmonic Resonance",
}
HEALTHY = "No Failure"
OMEGA = 2.0 * math.pi / 60.0


def ordered_mode(rules: list[tuple[str, Column]]) -> Column:
    """Later rules overwrite earlier ones: reversed ``coalesce(when …)``."""
    return F.coalesce(*[F.when(cond, F.lit(name)) for name, cond in reversed(rules)], F.lit(HEALTHY))


def milling_flags(df: DataFrame, twf_threshold: Column, rnf: Column, air="air", proc="proc", rpm="rpm",
                  torque="torque", wear="wear", tier="tier") -> DataFrame:
    """L1 flags + L2 mode precedence (RNF < TWF < OSF < PWF < HDF)."""
    a, p, r, t, w = (col(c) for c in (air, proc, rpm, torque, wear))
    power = t * (r * F.lit(OMEGA))
    flags = {
        "twf": (w >= twf_threshold).cast("int"),
        "hdf": (((p - a) < 8.6) & (r < 1380)).cast("int"),
        "pwf": ((power < 3500.0) | (power > 9000.0)).cast("int"),
        "osf": ((w * t) > osf_limit(col(tier))).cast("int"),
        "rnf": rnf.cast("int"),
    }
    d = df.withColumns(flags)
    d = d.withColumn("machine_failure", F.greatest(*[F.col(k) for k in ("twf", "hdf", "pwf", "osf", "rnf")]))
    mode = ordered_mode([(MILLING_MODES[k.upper()], F.col(k) == 1) for k in ("rnf", "twf", "osf", "pwf", "hdf")])
    return d.withColumn("failure_mode", mode)


def milling_degradation(df: DataFrame, key: str = "rk", air="air", proc="proc", rpm="rpm", torque="torque",
                        wear="wear", tier="tier", failed="machine_failure") -> DataFrame:
    """L3: weighted degradation → RUL (failed rows: hash-uniform 0–8) and health."""
    a, p, r, t, w = (col(c) for c in (air, proc, rpm, torque, wear))
    # Built in steps of named columns: ``clip`` names its argument twice, so nested in one expression the terms
    # would be written out (and worked out) two to the power of the depth times.
    d = df.withColumns({"__power": t * (r * F.lit(OMEGA)), "__td": p - a})
    power, td = F.col("__power"), F.col("__td")
    # --- fixed values: limits and weights of the degradation index ---
    d = d.withColumns({
        "__wear": w / 225.0, "__over": (w * t) / osf_limit(col(tier)),
        "__warm": (F.lit(10.0) - td) / 3.0, "__slow": (F.lit(1450.0) - r) / 250.0,
        "__weak": (F.lit(3800.0) - power) / 800.0, "__strong": (power - 8500.0) / 1000.0,
    })
    # one lambda clips the four terms: a method with every clip written out is too long for the JIT
    part = F.transform(F.array("__warm", "__slow", "__weak", "__strong"), lambda v: clip(v, 0.0, 1.0))
    d = d.withColumn("__part", part)
    warm, slow, weak, strong = (F.col("__part")[i] for i in range(4))
    d = d.withColumn("__deg", F.lit(0.45) * clip("__wear", 0.0, 1.15) + F.lit(0.30) * clip("__over", 0.0, 1.15) + F.lit(0.15) * (warm * slow) + F.lit(0.10) * F.greatest(weak, strong))
    d = d.withColumn("degradation", clip("__deg", 0.0, 1.0))
    deg = F.col("degradation")
    u = hash_uniform(key, "rul") * 8.0
    d = d.withColumns({"__rul": np_round(F.when(col(failed) == 1, u).otherwise((F.lit(1.0) - deg) * 220.0), 1), "__health": F.lit(100.0) * (F.lit(1.0) - deg)})
    d = d.withColumns({"rul": clip("__rul", 0.0, 240.0), "health": np_round(clip("__health", 0.0, 100.0), 1)})
    return d.drop("__power", "__td", "__wear", "__over", "__warm", "__slow", "__weak", "__strong", "__part", "__deg", "__rul", "__health")


def run_to_failure_labels(df: DataFrame, unit="unit_id", cycle="cycle") -> DataFrame:
    """L4: RUL = min(max_cycle − cycle, 125); imminent ≤ 30; unit mode when imminent; health from progress.

    max(cycle) per unit is a partial (map-side) aggregate joined back on the unit key — no window,
    so a unit holding a third of all rows is still split across tasks.
    """
    mx = df.groupBy(col(unit).alias("__u")).agg(F.max(col(cycle)).alias("__max"))
    d = df.join(mx, col(unit) == F.col("__u")).drop("__u")
    true_rul = F.col("__max") - col(cycle)
    u = hash_uniform(unit, "mode")
    cum, modes = 0.0, []
    for name, pr in TURBOFAN_MODES:
        cum += pr
        modes.append((name, cum))
    unit_mode = None
    for name, c in modes[:-1]:
        unit_mode = F.when(u < c, F.lit(name)) if unit_mode is None else unit_mode.when(u < c, F.lit(name))
    unit_mode = unit_mode.otherwise(F.lit(modes[-1][0]))
    prog = col(cycle) / F.col("__max")
    deg = clip(F.pow(prog, F.lit(2.4)), 0.0, 1.35)
    imminent = (true_rul <= 30).cast("int")
    return d.withColumns({
        "rul": F.least(true_rul, F.lit(125.0)).cast("double"),
        "machine_failure": imminent,
        "failure_mode": F.when(imminent == 1, unit_mode).otherwise(F.lit(HEALTHY)),
        "health": np_round(clip(F.lit(100.0) * (F.lit(1.0) - deg / 1.15), 0.0, 100.0), 1),
    }).drop("__max")


def plant_labels(df: DataFrame, key: str = "rk") -> DataFrame:
    """Plant fault rules, precedence lubrication < motor < resonance < seizure, stress → RUL, health."""
    vib, temp, amp, db, visc, hrs = (col(c) for c in (
        "Vibration RMS [mm/s]", "Bearing Temp [C]", "Spindle Current [A]", "Acoustic Emission [dB]",
        "Lubricant Viscosity [cSt]", "Operating Hours [h]"))
    rules = {
        "seizure": (vib > 6.2) & (temp > 82.0),
        "lubrication": (visc < 31.0) & (hrs > 650),
        "motor": (amp > 26.5) & (db > 88.0),
        "resonance": (vib > 7.5) & (db > 90.0),
    }
    fail = F.greatest(*[r.cast("int") for r in rules.values()])
    mode = ordered_mode([(PLANT_MODES[k], rules[k]) for k in ("lubrication", "motor", "resonance", "seizure")])
    d = df.withColumns({"machine_failure": fail, "failure_mode": mode, "__warm": (temp - 50.0) / 45.0, "__thin": (F.lit(48.0) - visc) / 25.0})
    d = d.withColumn("__s", F.lit(0.35) * (vib / 8.0) + F.lit(0.30) * clip("__warm", 0.0, 1.2) + F.lit(0.20) * (hrs / 1200.0) + F.lit(0.15) * clip("__thin", 0.0, 1.2))
    d = d.withColumn("__stress", clip("__s", 0.0, 1.0))
    stress = F.col("__stress")
    u = F.lit(1.0) + hash_uniform(key, "rul") * 11.0
    d = d.withColumns({"rul": np_round(F.when(F.col("machine_failure") == 1, u).otherwise((F.lit(1.0) - stress) * 300.0), 1), "__health": F.lit(100.0) * (F.lit(1.0) - stress)})
    return d.withColumn("health", np_round(clip("__health", 0.0, 100.0), 1)).drop("__warm", "__thin", "__s", "__stress", "__health")


def rule_set_labels(df: DataFrame, modes: list[tuple[str, str]]) -> DataFrame:
    """Ordered (mode, SQL predicate) rules; any → failure; last match wins."""
    conds = [(name, F.coalesce(F.expr(pred), F.lit(False))) for name, pred in modes]
    fail = F.greatest(*[c.cast("int") for _, c in conds]) if conds else F.lit(0)
    return df.withColumns({"machine_failure": fail, "failure_mode": ordered_mode(conds)})


def domain_stress_labels(df: DataFrame, sensors: list[tuple[str, float, float, float, float]], key: str = "rk",
                         failed: str = "machine_failure") -> DataFrame:
    """Mean clipped |v − mean|/(2.5·std) over the spec sensors → RUL and health."""
    # in steps, as in ``milling_degradation``; one lambda clips all sensors, as a method with every clip written out is too long for the JIT
    far = F.array(*[F.abs(col(n) - F.lit(m)) / F.lit(2.5 * s) for n, m, s, _, _ in sensors])
    total = F.aggregate(F.transform(far, lambda v: clip(v, 0.0, 1.2)), F.lit(0.0), lambda a, v: a + v)
    d = df.withColumn("__s", total / float(len(sensors))).withColumn("stress", clip("__s", 0.0, 1.0))
    s, f = F.col("stress"), col(failed)
    u = F.lit(1.5) + hash_uniform(key, "rul") * 12.5
    d = d.withColumns({"rul": np_round(F.when(f == 1, u).otherwise((F.lit(1.0) - s) * 240.0), 1), "__health": F.lit(100.0) * (F.lit(1.0) - s * 0.85 - f * 0.45)})
    return d.withColumn("health", np_round(clip("__health", 0.0, 100.0), 1)).drop("__s", "__health")


def degrade(df: DataFrame, sensors: list[str], key: str = "rk", missing_rate: float = 0.012,
            spike_rate: float = 0.015) -> DataFrame:
    """Deterministic corruption — ~1.2 % nulls, ~1.5 % spikes of ±(4.2–5.8)·std (2 dp).

    The per-column std is one aggregate row, applied as literals.
    """
    stds = df.agg(*[F.stddev_samp(col(c)).alias(f"s{i}") for i, c in enumerate(sensors)]).first()
    out = {}
    for i, c in enumerate(sensors):
        sd = stds[f"s{i}"]
        sd = 1.0 if (sd is None or sd <= 0) else float(sd)
        um, us = hash_uniform(key, f"{c}|m"), hash_uniform(key, f"{c}|s")
        sign = F.when(hash_uniform(key, f"{c}|sign") < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))
        mag = (F.lit(4.2) + hash_uniform(key, f"{c}|mag") * 1.6) * F.lit(sd) * sign
        spike = (us < spike_rate) & ~(um < missing_rate)
        v = F.when(spike, np_round(col(c) + mag, 2)).otherwise(col(c))
        out[c] = F.when(um < missing_rate, F.lit(None).cast("double")).otherwise(v)
    return df.withColumns(out)
