"""Scoring and prognostics.

P9–P12 are the closed-form scorer: pure column arithmetic, so it runs in one
whole-stage-codegen projection on a batch table or a stream.  P2–P5 take the
probability columns of fitted models (see ``models.py``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import clip, col, np_round

# --- fixed values: per-model calibration offsets of the closed-form scorer, in model order ---
MODEL_OFFSETS: list[tuple[str, float]] = [
    ("XGBoost", 0.0),
    ("Random Forest", -0.012),
    ("LightGBM", 0.008),
    ("ANN (Deep MLP)", 0.022),
    ("1D-CNN", 0.015),
    ("BiLSTM", 0.019),
    ("Logistic Regression", 0.045),
]
DEEP_MODELS = ("ANN (Deep MLP)", "1D-CNN", "BiLSTM")
HEALTHY = "No Failure"


def osf_limit(tier: Column) -> Column:
    u = F.upper(tier)
    return F.when(u == "L", 11000.0).when(u == "H", 13000.0).otherwise(12000.0)


def milling_risk(df: DataFrame, air="air", proc="proc", rpm="rpm", torque="torque", wear="wear",
                 tier="tier", out_prefix: str = "") -> DataFrame:
    """Closed-form milling risk = max of the four fault scores, clipped to [0.015, 0.98], plus its mode."""
    a, p, r, t, w = (col(c) for c in (air, proc, rpm, torque, wear))
    td = np_round(p - a, 2)
    pw = np_round(t * (r * F.lit(2.0 * math.pi) / F.lit(60.0)), 1)
    ov = np_round(w * t, 1)
    lim = osf_limit(F.coalesce(col(tier), F.lit("M")))
    # --- fixed values: limits and slopes of the closed form ---
    twf = F.greatest(F.lit(0.0), (w - 175.0) / 55.0)
    hdf = F.when((td < 8.8) & (r < 1400), F.lit(0.82)).otherwise(
        F.greatest(F.lit(0.0), (F.lit(9.2) - td) / 4.0) * F.greatest(F.lit(0.0), (F.lit(1450.0) - r) / 250.0))
    pwf = F.when(pw < 3500, (F.lit(3600.0) - pw) / 600.0).when(pw > 9000, (pw - 8800.0) / 800.0).otherwise(F.lit(0.02))
    osf = F.greatest(F.lit(0.0), (ov - lim * 0.78) / (lim * 0.28))
    d = df.withColumns({"__twf": twf, "__hdf": hdf, "__pwf": pwf, "__osf": osf})
    T_, H_, P_, O_ = (F.col(c) for c in ("__twf", "__hdf", "__pwf", "__osf"))
    base = F.least(F.lit(0.98), F.greatest(F.lit(0.015), F.greatest(T_, H_, P_, O_)))
    mode = (
        F.when((O_ >= T_) & (O_ >= H_) & (O_ >= P_) & (O_ > 0.25), F.lit("OSF (Overstrain Failure)"))
        .when((H_ >= T_) & (H_ >= P_) & (H_ > 0.25), F.lit("HDF (Heat Dissipation)"))
        .when((P_ >= T_) & (P_ > 0.25), F.lit("PWF (Power Failure)"))
        .when(T_ > 0.25, F.lit("TWF (Tool Wear Failure)"))
        .otherwise(F.lit(HEALTHY))
    )
    return d.withColumns({f"{out_prefix}base_risk": base, f"{out_prefix}risk_mode": mode}).drop(
        "__twf", "__hdf", "__pwf", "__osf")


def generic_risk(df: DataFrame, sensors: list[str], ranges: dict[str, tuple[float, float]], top_mode: str | None) -> DataFrame:
    """P10: mean |v − median| / max(std, .001) → (avg − .55)/1.65 clipped [.02, .96]; mode if > .35.

    ``ranges`` maps sensor → (median, std) from F7 (a handful of literals).
    """
    zs = [F.abs(F.coalesce(col(c), F.lit(ranges[c][0])) - F.lit(ranges[c][0])) / F.lit(max(ranges[c][1], 0.001))
          for c in sensors]
    avg_z = sum(zs[1:], zs[0]) / float(max(len(sensors), 1))
    base = F.least(F.lit(0.96), F.greatest(F.lit(0.02), (avg_z - 0.55) / 1.65))
    mode = F.when(base > 0.35, F.lit(top_mode or "Detected Anomaly Failure")).otherwise(F.lit(HEALTHY))
    return df.withColumns({"base_risk": base, "risk_mode": mode})


def model_probability_exprs(base: Column) -> dict[str, Column]:
    """Per-model calibrated probability in %, clipped to [0.8, 99.2], 2 dp."""
    return {
        m: np_round(F.least(F.lit(99.2), F.greatest(F.lit(0.8), (base + F.lit(off)) * 100.0)), 2)
        for m, off in MODEL_OFFSETS
    }


def model_probability_map(df: DataFrame, base="base_risk", out="model_probs") -> DataFrame:
    """P11 as a map column model → % (ordered as the offsets)."""
    probs = model_probability_exprs(col(base))
    return df.withColumn(out, F.create_map(*[x for m, e in probs.items() for x in (F.lit(m), e)]))


def explode_models(df: DataFrame, base="base_risk", keep: list[str] | None = None) -> DataFrame:
    """P11 long form: one row per (row, model) — the ``scored`` table used by the E operators."""
    arr = F.array(*[F.struct(F.lit(i).alias("model_no"), F.lit(m).alias("model"), F.lit(off).alias("off"))
                    for i, (m, off) in enumerate(MODEL_OFFSETS)])
    keep = keep or []
    d = df.select(*[col(c) for c in keep], col(base).alias("__b"), F.explode(arr).alias("__m"))
    pct = np_round(F.least(F.lit(99.2), F.greatest(F.lit(0.8), (F.col("__b") + F.col("__m.off")) * 100.0)), 2)
    return d.select(*[col(c) for c in keep], F.col("__m.model_no").alias("model_no"),
                    F.col("__m.model").alias("model"), pct.alias("prob_pct"))


def choose_model(probs: Column, model: str | None, champion: str) -> Column:
    """Requested model's probability, else the champion's."""
    if model is None:
        return F.element_at(probs, F.lit(champion))
    return F.coalesce(F.element_at(probs, F.lit(model)), F.element_at(probs, F.lit(champion)))


def closed_form_prognosis(df: DataFrame, prob_col: str = "failure_prob_pct", base="base_risk",
                          max_rul: float = 220.0) -> DataFrame:
    """RUL = max(2, (1 − .92·risk)·ref) 1 dp; health = clip(100 − .85·p, 4, 99.5) 1 dp; severity ignores RUL."""
    p = col(prob_col)
    rul = np_round(F.greatest(F.lit(2.0), (F.lit(1.0) - col(base) * 0.92) * max_rul), 1)
    health = np_round(F.least(F.lit(99.5), F.greatest(F.lit(4.0), F.lit(100.0) - p * 0.85)), 1)
    d = df.withColumns({"pred_rul": rul, "health_pct": health})
    h = F.col("health_pct")
    sev = (F.when((p >= 68) | (h <= 32), "CRITICAL").when((p >= 36) | (h <= 60), "WARNING")
           .when(p >= 18, "ADVISORY").otherwise("OPTIMAL"))
    return d.withColumn("js_severity", sev)


def floor_rul(c: Column) -> Column:
    """RUL floored at 0, 1 dp."""
    return np_round(F.greatest(F.lit(0.0), c), 1)


def health_index(prob_pct: Column, rul: Column, max_rul_ref: float = 220.0) -> Column:
    """0.55·(100 − risk) + 0.45·clip(RUL/ref·100, 0, 100), 1 dp (ref 125 turbofan, else 220)."""
    rul_h = clip(rul / max_rul_ref * 100.0, 0.0, 100.0)
    return np_round(F.lit(0.55) * (F.lit(100.0) - prob_pct) + F.lit(0.45) * rul_h, 1)


def fill_inputs(df: DataFrame, medians: dict[str, float], tier_col: str | None = "tier") -> DataFrame:
    """Absent inputs → training median; tier → 'M'."""
    ex = {c: F.coalesce(col(c).cast("double"), F.lit(m)) for c, m in medians.items()}
    if tier_col:
        ex[tier_col] = F.coalesce(col(tier_col), F.lit("M"))
    return df.withColumns(ex)


def ensemble_averages(probs: Column) -> tuple[Column, Column]:
    """Classical vs neural average risk from a model → % map, 2 dp (empty side → 0)."""
    deep = F.array(*[F.lit(m) for m in DEEP_MODELS])
    dl = F.map_filter(probs, lambda k, v: F.array_contains(deep, k))
    ml = F.map_filter(probs, lambda k, v: ~F.array_contains(deep, k))

    def avg(m: Column) -> Column:
        vals = F.map_values(m)
        s = F.aggregate(vals, F.lit(0.0), lambda acc, x: acc + x)
        return np_round(s / F.greatest(F.size(vals), F.lit(1)), 2)

    return avg(ml), avg(dl)


def mode_distribution(mode_probs: Column) -> Column:
    """array<struct(mode, probability_pct)> sorted by probability desc (stable on name)."""
    return F.array_sort(
        mode_probs,
        lambda a, b: F.when(a["probability_pct"] > b["probability_pct"], -1)
        .when(a["probability_pct"] < b["probability_pct"], 1)
        .when(a["mode"] < b["mode"], -1).when(a["mode"] > b["mode"], 1).otherwise(0),
    )


def dominant_mode(dist: Column, prob_pct: Column) -> Column:
    """P5: best non-healthy mode if risk ≥ 28 %, else the overall best."""
    non_h = F.filter(dist, lambda x: x["mode"] != HEALTHY)
    return F.when((prob_pct >= 28.0) & (F.size(non_h) > 0), non_h[0]["mode"]).otherwise(dist[0]["mode"])
