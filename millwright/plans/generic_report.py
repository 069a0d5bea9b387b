"""Generic (non-milling) scoring and prescription plan: P10–P12, X4–X6, R1, R6–R10, R13.

Fit: three one-row aggregates over the table (operating ranges F7, feature
baseline F8, importance shares) plus the top failure mode (D1) — all bounded
by the column count and collected as literals.  Score: one projection per row;
attributions are sorted inside the row (no shuffle).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators import explain as X
from millwright.operators import prescribe as R
from millwright.operators.features import feature_baseline, generic_features, operating_ranges, tier_encode
from millwright.operators.report import top_failure_mode
from millwright.operators.scoring import DEEP_MODELS, MODEL_OFFSETS, generic_risk, health_index, model_probability_exprs


@dataclass
class GenericContext:
    sensors: list[str]
    features: list[str]
    engineered: list[str]
    ranges: dict[str, tuple[float, float]]     # sensor → (median, std) from F7 (4 dp)
    baseline: dict[str, tuple[float, float]]   # feature → (mean, std + 1e-6) from F8
    importance: list[dict]
    top_mode: str | None


def prepare(df: DataFrame, sensors: list[str], tier: str = "tier") -> tuple[DataFrame, list[str]]:
    d = tier_encode(df, tier)
    d, eng = generic_features(d, sensors)
    return d, eng


def fit_context(df: DataFrame, sensors: list[str], label: str = "machine_failure", mode: str = "failure_mode",
                tier: str = "tier") -> GenericContext:
    d, eng = prepare(df, sensors, tier)
    feats = ["type_encoded"] + sensors + eng
    rng = {r["sensor"]: (r["median"], r["std"]) for r in operating_ranges(d, sensors).collect()}
    base = {r["feature"]: (r["mean"], r["std"]) for r in feature_baseline(d, feats).collect()}
    imp = X.correlation_importance(d, feats, label)
    return GenericContext(sensors, feats, eng, rng, base, imp, top_failure_mode(df, mode))


def generic_report(df: DataFrame, ctx: GenericContext, champion: str = "XGBoost", key: str = "rk",
                   tier: str = "tier", max_rul: float = 220.0) -> DataFrame:
    d, _ = prepare(df, ctx.sensors, tier)
    d = generic_risk(d, ctx.sensors, ctx.ranges, ctx.top_mode)
    probs = model_probability_exprs(F.col("base_risk"))
    ml = [probs[n] for n, _ in MODEL_OFFSETS if n not in DEEP_MODELS]
    dl = [probs[n] for n, _ in MODEL_OFFSETS if n in DEEP_MODELS]
    d = d.withColumns({
        "failure_prob_pct": probs[champion],
        "classical_avg_pct": np_round(reduce(lambda a, b: a + b, ml, F.lit(0.0)) / float(len(ml)), 2),
        "deep_avg_pct": np_round(reduce(lambda a, b: a + b, dl, F.lit(0.0)) / float(len(dl)), 2),
        "pred_rul": np_round(F.greatest(F.lit(2.0), (F.lit(1.0) - F.col("base_risk") * 0.92) * max_rul), 1),
        "attrib": X.zscore_attributions(ctx.importance, ctx.baseline),
    })
    p, rul = F.col("failure_prob_pct"), F.col("pred_rul")
    d = d.withColumn("health_index", health_index(p, rul, max_rul))
    d = d.withColumn("severity", R.severity(p, F.col("health_index"), rul))
    d = d.withColumn("js_health", np_round(F.least(F.lit(99.5), F.greatest(F.lit(4.0), F.lit(100.0) - p * 0.85)), 1))
    d = d.withColumn("js_severity", F.when((p >= 68) | (F.col("js_health") <= 32), "CRITICAL")
                     .when((p >= 36) | (F.col("js_health") <= 60), "WARNING").when(p >= 18, "ADVISORY").otherwise("OPTIMAL"))
    # Of the top-4 attributions, raw sensors with impact > 0.02 and away from the median
    top4 = F.slice("attrib", 1, 4)
    med = F.create_map(*[x for s in ctx.sensors for x in (F.lit(s), F.lit(float(ctx.ranges[s][0])))])
    raw = F.create_map(*[x for s in ctx.sensors for x in (F.lit(s), col(s).cast("double"))])

    def tune(a):
        cur = F.coalesce(F.element_at(raw, a["feature"]), F.element_at(med, a["feature"]))
        m = F.element_at(med, a["feature"])
        ok = m.isNotNull() & (a["impact"] > 0.02) & (F.abs(cur - m) > 1e-3)
        return F.when(ok, F.concat_ws("=", a["feature"], np_round(m, 2).cast("string"), R.signed(m - cur, 2)))

    r6 = F.filter(F.transform(top4, tune), lambda x: x.isNotNull())
    r7 = F.concat_ws(" | ", *[F.concat_ws("=", F.lit(s), F.lit(str(round(ctx.ranges[s][0], 2))), F.lit("Optimal Window"))
                               for s in ctx.sensors[:2]])
    d = d.withColumn("tuning", F.when(F.size(r6) > 0, F.concat_ws(" | ", r6)).otherwise(r7))
    # R8 lines
    fp = X.first_positive(F.col("attrib"))
    d = d.withColumns({
        "xai_line": F.when(fp.isNotNull(), R.xai_line(fp["feature"], fp["value"], fp["impact"])),
        "consensus_line": R.consensus_line(F.col("classical_avg_pct"), F.col("deep_avg_pct")),
    })
    d = d.withColumn("summary", R.summary(F.col("severity"), p, F.col("classical_avg_pct"), F.col("deep_avg_pct"),
                                          F.col("risk_mode"), rul, F.col("health_index")))
    d = d.withColumn("actions", R.default_actions_text(F.col("severity"), F.col("risk_mode"), F.col("attrib")[0]["feature"]))
    # R13 (closed-form generic setpoints) and X6 (closed-form attributions)
    r13 = R.js_generic_setpoints(ctx.sensors, ctx.ranges)
    d = d.withColumn("js_tuning", F.concat_ws(" | ", F.transform(r13, lambda t: F.concat_ws("=", t["sensor"], t["recommended"].cast("string"), t["change"]))))
    vals = {s: col(s) for s in ctx.sensors}
    js = X.js_attributions(ctx.importance, p, vals)
    d = d.withColumn("js_attrib", F.concat_ws(" | ", F.transform(js, lambda a: F.concat_ws("=", a["feature"], a["impact"].cast("string")))))
    return d
