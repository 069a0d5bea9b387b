"""Flagship plan: which milling rows are at risk, and what should be changed?

raw telemetry → Cleaner (Q1–Q10) → physics features (F2) → closed-form risk
(P9) → per-model calibration (P11) → prognosis (P12 RUL, P7 health) →
severity (R1) → diagnostics / work orders / parts / setpoints (R2–R5) →
counterfactual re-score at the setpoints (R11) → risk delta (R12).

After the cleaner's fit (four one-row aggregates) the whole report is a single
projection over the de-duplicated table: no further shuffle, and it runs on a
stream unchanged (``report_from_clean``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators import prescribe as R
from millwright.operators.features import SHORT_MILLING, Milling, milling_features
from millwright.operators.quality import Cleaner, CleanerModel, drop_exact_duplicates
from millwright.operators.scoring import (
    DEEP_MODELS, MODEL_OFFSETS, health_index, milling_risk, model_probability_exprs,
)

MILLING_SHORT = ["air", "proc", "rpm", "torque", "wear"]


def report_from_clean(clean: DataFrame, champion: str = "XGBoost", key: str = "rk", m: Milling = SHORT_MILLING,
                      max_rul: float = 220.0) -> DataFrame:
    feats = milling_features(clean, m)
    scored = milling_risk(feats, m.air, m.proc, m.rpm, m.torque, m.wear, m.tier)
    probs = model_probability_exprs(F.col("base_risk"))
    off = dict(MODEL_OFFSETS)[champion]
    ml = [probs[n] for n, _ in MODEL_OFFSETS if n not in DEEP_MODELS]
    dl = [probs[n] for n, _ in MODEL_OFFSETS if n in DEEP_MODELS]
    rul = np_round(F.greatest(F.lit(2.0), (F.lit(1.0) - F.col("base_risk") * 0.92) * max_rul), 1)
    d = scored.withColumns({
        "failure_prob_pct": probs[champion], "pred_rul": rul,
        # P8 on the per-model columns, summed in model order
        "classical_avg_pct": np_round(reduce(lambda a, b: a + b, ml, F.lit(0.0)) / float(len(ml)), 2),
        "deep_avg_pct": np_round(reduce(lambda a, b: a + b, dl, F.lit(0.0)) / float(len(dl)), 2),
    })
    d = d.withColumn("health_index", health_index(F.col("failure_prob_pct"), F.col("pred_rul"), max_rul))
    d = d.withColumn("severity", R.severity(F.col("failure_prob_pct"), F.col("health_index"), F.col("pred_rul")))
    fnd = R.milling_findings(m.air, m.proc, m.rpm, m.torque, m.wear, m.tier)
    keep = ["n_findings", "diagnostics_text", "n_actions", "actions_text", "spare_parts_text", "tuning_text",
            "opt_torque", "opt_rpm", "opt_wear", "opt_air"]
    d = d.withColumns({k: fnd[k] for k in keep})
    # Re-score the counterfactual inputs with the same closed form
    cf = milling_risk(d, "opt_air", m.proc, "opt_rpm", "opt_torque", "opt_wear", m.tier, out_prefix="cf_")
    proj = np_round(F.least(F.lit(99.2), F.greatest(F.lit(0.8), (F.col("cf_base_risk") + F.lit(off)) * 100.0)), 2)
    cf = cf.withColumn("projected_risk_pct", proj)
    actions = F.when(F.col("n_actions") == 0,
                     R.default_actions_text(F.col("severity"), F.col("risk_mode"), F.lit("Tool wear [min]"))
                     ).otherwise(F.col("actions_text"))
    parts = F.when(F.col("spare_parts_text") == "", F.lit(R.PART_DEFAULT)).otherwise(F.col("spare_parts_text"))
    return cf.select(
        col(key), col(m.tier).alias("tier"),
        "failure_prob_pct", F.col("risk_mode").alias("dominant_mode"), "pred_rul", "health_index", "severity",
        "classical_avg_pct", "deep_avg_pct", "n_findings",
        F.col("diagnostics_text").alias("diagnostics"), actions.alias("actions"), parts.alias("spare_parts"),
        F.col("tuning_text").alias("tuning"), "projected_risk_pct",
        np_round(F.col("projected_risk_pct") - F.col("failure_prob_pct"), 2).alias("risk_delta"),
    )


OPTIMAL_SENSORS = [("Air temperature [K]", "air"), ("Process temperature [K]", "proc")]


def complete(report: DataFrame, medians: dict[str, float]) -> DataFrame:
    """Every row gets a consensus line among its diagnostics, a summary and, where
    there is nothing to tune, the first two sensors at their medians as 'Optimal Window'."""
    calm = " | ".join(f"{name}={round(medians[c], 2)}=Optimal Window" for name, c in OPTIMAL_SENSORS)
    consensus = R.consensus_line(F.col("classical_avg_pct"), F.col("deep_avg_pct"))
    return report.withColumns({
        "diagnostics": F.concat_ws(" | ", F.when(F.col("diagnostics") != "", F.col("diagnostics")), consensus),
        "tuning": F.when(F.col("tuning") == "", F.lit(calm)).otherwise(F.col("tuning")),
        "summary": R.summary(F.col("severity"), F.col("failure_prob_pct"), F.col("classical_avg_pct"), F.col("deep_avg_pct"),
                             F.col("dominant_mode"), F.col("pred_rul"), F.col("health_index")),
    })


def milling_risk_report(raw: DataFrame, champion: str = "XGBoost", key: str = "rk", exact: bool = True,
                        model: CleanerModel | None = None) -> DataFrame:
    """Entry point over raw telemetry with short column names (``tel_raw`` shape)."""
    if model is None:
        model, work = Cleaner(MILLING_SHORT, "tier", exact=exact).fit_dedup(raw)
        clean = model.transform(work)
    else:
        clean = model.transform(drop_exact_duplicates(raw))
    return complete(report_from_clean(clean, champion, key), model.medians)
