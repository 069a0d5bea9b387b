"""Registered queries: scoring (P1, P3, P5, P7–P12), explanation (X4–X6), prescription (R1–R13), summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators import explain as X
from millwright.operators import labels as L
from millwright.operators import prescribe as R
from millwright.operators import report as D
from millwright.operators.features import operating_ranges
from millwright.operators.quality import Cleaner, drop_exact_duplicates
from millwright.operators.sampling import stratified_split
from millwright.operators.scoring import (
    MODEL_OFFSETS, choose_model, closed_form_prognosis, dominant_mode, ensemble_averages, explode_models,
    fill_inputs, floor_rul, health_index, milling_risk, mode_distribution, model_probability_map,
)
from millwright.plans import generic_report as GR
from millwright.plans.oracles import clean_ctes, oracle, prob_expr, q, risk_ctes
from millwright.plans.q_labels import _rules_sql
from millwright.plans.q_quality import report_sql
from millwright.plans.registry import register
from millwright.plans.risk_report import report_from_clean
from millwright.sources.catalog import DOMAIN_SPECS
from millwright.sources.fixtures import fixture

S = ["air", "proc", "rpm", "torque", "wear"]
DOM = "ims_bearing"
DSENS = [s[0] for s in DOMAIN_SPECS[DOM]["sensors"]]


# ------------------------------------------------------------------ P1
def _p01_sql():
    ctes = clean_ctes("tel_raw", S, ["rk", "h"])
    ctes.append(("md", "select " + ", ".join(f"round_even(quantile_cont({c}, 0.5), 4) m_{c}" for c in S) + " from cl"))
    sel = ", ".join(f"coalesce({c}, m_{c}) {c}" for c in S)
    return oracle(["tel_raw"], f"select rk, h, coalesce(tier, 'M') tier, {sel} from tel_raw cross join md", ctes)


@register("q_p01_fill_inputs", _p01_sql)
def p01(spark, sf):
    raw = fixture(spark, sf, "tel_raw")
    m, work = Cleaner(S, "tier").fit_dedup(raw)
    clean = m.transform(work)
    med = {r["sensor"]: r["median"] for r in operating_ranges(clean, S).collect()}
    return fill_inputs(raw, med, "tier").select("rk", "h", "tier", *S)


# ------------------------------------------------------------------ P9, P11, P12, P3, P8, P5, P7
def _risk(spark, sf):
    t = fixture(spark, sf, "tel_flags")
    return milling_risk(t)


RISK_CTES = risk_ctes("tel_flags", "r9")


@register("q_p09_closed_form_risk", oracle(["tel_flags"], "select rk, round_even(base_risk, 9) base_risk, risk_mode from r9", RISK_CTES))
def p09(spark, sf):
    return _risk(spark, sf).select("rk", np_round(F.col("base_risk"), 9).alias("base_risk"), "risk_mode")


MODELS_VALUES = ", ".join(f"({i}, '{m}', cast({off!r} as double))" for i, (m, off) in enumerate(MODEL_OFFSETS))


@register("q_p11_model_calibration", oracle(["tel_flags"], f"select rk, model_no, model, round_even(least(99.2, greatest(0.8, (base_risk + off)*100.0)), 2) prob_pct "
                                                           f"from r9 cross join (values {MODELS_VALUES}) m(model_no, model, off)", RISK_CTES))
def p11(spark, sf):
    return explode_models(_risk(spark, sf), keep=["rk"])


@register("q_p12_closed_form_prognosis", oracle(["tel_flags"], f"select rk, pred_rul, health_pct, case when p>=68 or health_pct<=32 then 'CRITICAL' when p>=36 or health_pct<=60 then 'WARNING' "
                                                               f"when p>=18 then 'ADVISORY' else 'OPTIMAL' end js_severity from (select rk, p, "
                                                               f"round_even(greatest(2.0, (1.0 - base_risk*0.92)*220.0), 1) pred_rul, round_even(least(99.5, greatest(4.0, 100.0 - p*0.85)), 1) health_pct "
                                                               f"from (select *, {prob_expr('base_risk', 0.0)} p from r9) a) b", RISK_CTES))
def p12(spark, sf):
    r = model_probability_map(_risk(spark, sf)).withColumn("failure_prob_pct", F.col("model_probs")["XGBoost"])
    return closed_form_prognosis(r).select("rk", "pred_rul", "health_pct", "js_severity")


@register("q_p03_model_choice", oracle(["tel_flags"], f"select rk, {prob_expr('base_risk', 0.008)} chosen_pct, {prob_expr('base_risk', 0.0)} fallback_pct from r9", RISK_CTES))
def p03(spark, sf):
    r = model_probability_map(_risk(spark, sf))
    return r.select("rk", choose_model(F.col("model_probs"), "LightGBM", "XGBoost").alias("chosen_pct"),
                    choose_model(F.col("model_probs"), "Not A Model", "XGBoost").alias("fallback_pct"))


def _avg_sql(names):
    terms = [prob_expr("base_risk", off) for m, off in MODEL_OFFSETS if m in names]
    s = "0.0"
    for t in terms:
        s = f"({s} + {t})"
    return f"round_even({s} / {len(terms)}, 2)"


@register("q_p08_ensemble_averages", oracle(["tel_flags"], f"select rk, {_avg_sql([m for m, _ in MODEL_OFFSETS if m not in ('ANN (Deep MLP)', '1D-CNN', 'BiLSTM')])} classical_avg_pct, "
                                                           f"{_avg_sql(['ANN (Deep MLP)', '1D-CNN', 'BiLSTM'])} deep_avg_pct from r9", RISK_CTES))
def p08(spark, sf):
    r = model_probability_map(_risk(spark, sf))
    ml, dl = ensemble_averages(F.col("model_probs"))
    return r.select("rk", ml.alias("classical_avg_pct"), dl.alias("deep_avg_pct"))


@register("q_p05_dominant_mode", oracle(["tel_flags"], f"select rk, case when p >= 28.0 and risk_mode <> 'No Failure' then risk_mode "
                                                       f"when risk_mode <> 'No Failure' and p > round_even(100.0 - p, 2) then risk_mode "
                                                       f"when risk_mode <> 'No Failure' and p = round_even(100.0 - p, 2) and risk_mode < 'No Failure' then risk_mode "
                                                       f"else 'No Failure' end dominant_mode from (select *, {prob_expr('base_risk', 0.0)} p from r9) a", RISK_CTES))
def p05(spark, sf):
    r = model_probability_map(_risk(spark, sf)).withColumn("p", F.col("model_probs")["XGBoost"])
    healthy = F.struct(F.lit("No Failure").alias("mode"), np_round(F.lit(100.0) - F.col("p"), 2).alias("probability_pct"))
    fault = F.struct(F.col("risk_mode").alias("mode"), F.col("p").alias("probability_pct"))
    dist = F.when(F.col("risk_mode") == "No Failure", F.array(healthy)).otherwise(F.array(healthy, fault))
    return r.select("rk", dominant_mode(mode_distribution(dist), F.col("p")).alias("dominant_mode"))


def _l03_ctes():
    from millwright.plans.q_labels import FLAGS_SQL, LIM, OMEGA, clipsql, hu
    deg = (f"{clipsql('0.45*' + clipsql('wear/225.0', 0.0, 1.15) + ' + 0.30*' + clipsql(f'(wear*torque)/{LIM}', 0.0, 1.15) + ' + 0.15*('
                      + clipsql('(10.0-(proc-air))/3.0', 0.0, 1.0) + '*' + clipsql('(1450.0-rpm)/250.0', 0.0, 1.0) + ') + 0.10*greatest('
                      + clipsql(f'(3800.0-torque*(rpm*{OMEGA}))/800.0', 0.0, 1.0) + ', ' + clipsql(f'(torque*(rpm*{OMEGA})-8500.0)/1000.0', 0.0, 1.0) + ')', 0.0, 1.0)}")
    ctes = [("lb", f"select *, least(greatest(round_even(case when machine_failure=1 then {hu('rk', 'rul')}*8.0 else (1.0-({deg}))*220.0 end, 1), 0.0), 240.0) rul, "
                   f"round_even(least(greatest(100.0*(1.0-({deg})), 0.0), 100.0), 1) health from ({FLAGS_SQL}) f")]
    return ctes + risk_ctes("lb", "r9")


@register("q_p07_health_index", oracle(["tel_clean"], f"select rk, round_even(greatest(0.0, rul), 1) rul_floor, "
                                                      f"round_even(0.55*(100.0 - p) + 0.45*least(greatest(rul/220.0*100.0, 0.0), 100.0), 1) health_index "
                                                      f"from (select *, {prob_expr('base_risk', 0.0)} p from r9) a", _l03_ctes()))
def p07(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    d = L.milling_degradation(L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0))
    r = model_probability_map(milling_risk(d)).withColumn("p", F.col("model_probs")["XGBoost"])
    return r.select("rk", floor_rul(F.col("rul")).alias("rul_floor"), health_index(F.col("p"), F.col("rul")).alias("health_index"))


# ------------------------------------------------------------------ R1, R2–R5 on clean telemetry
@register("q_r01_severity", oracle(["tel_flags"], f"select rk, severity, case severity when 'CRITICAL' then 'danger' when 'WARNING' then 'warning' when 'ADVISORY' then 'info' else 'success' end badge_color, "
                                                  f"case severity when 'CRITICAL' then 'Immediate Intervention (< 15 mins)' when 'WARNING' then 'Scheduled Stop Within Shift (< 2 hours)' "
                                                  f"when 'ADVISORY' then 'Preventive Check Next Cycle (< 24 hours)' else 'Nominal Continuous Operation' end urgency_window from "
                                                  f"(select rk, case when p>=68.0 or h<=32.0 or rul<=18.0 then 'CRITICAL' when p>=36.0 or h<=60.0 or rul<=48.0 then 'WARNING' "
                                                  f"when p>=18.0 or h<=76.0 then 'ADVISORY' else 'OPTIMAL' end severity from (select rk, p, rul, "
                                                  f"round_even(0.55*(100.0-p) + 0.45*least(greatest(rul/220.0*100.0, 0.0), 100.0), 1) h from "
                                                  f"(select rk, {prob_expr('base_risk', 0.0)} p, round_even(greatest(2.0, (1.0 - base_risk*0.92)*220.0), 1) rul from r9) a) b) c", RISK_CTES))
def r01(spark, sf):
    r = model_probability_map(_risk(spark, sf)).withColumn("p", F.col("model_probs")["XGBoost"])
    r = r.withColumn("rul", np_round(F.greatest(F.lit(2.0), (F.lit(1.0) - F.col("base_risk") * 0.92) * 220.0), 1))
    r = r.withColumn("h", health_index(F.col("p"), F.col("rul")))
    s = R.severity_struct(R.severity(F.col("p"), F.col("h"), F.col("rul")))
    return r.select("rk", s["severity"].alias("severity"), s["badge_color"].alias("badge_color"), s["urgency_window"].alias("urgency_window"))


def _r02_sql():
    ctes, body = report_sql([], "tel_clean")
    return oracle(["tel_clean"], body, ctes)


@register("q_r02_milling_prescription", _r02_sql)
def r02(spark, sf):
    return report_from_clean(fixture(spark, sf, "tel_clean"))


# ------------------------------------------------------------------ generic path on a domain set
def _domain_ctx(spark, sf):
    d = fixture(spark, sf, f"domain_{DOM}")
    lab = L.rule_set_labels(d, DOMAIN_SPECS[DOM]["modes"])
    ctx = GR.fit_context(lab, DSENS)
    return lab, ctx


def _generic(spark, sf):
    lab, ctx = _domain_ctx(spark, sf)
    return GR.generic_report(lab, ctx)


def _generic_ctes() -> list[tuple[str, str]]:
    fail, mode = _rules_sql(DOM)
    c1, c2, c3 = (q(s) for s in DSENS[:3])
    feats = ["type_encoded"] + DSENS + ["interaction_stress_index", "multi_sensor_load_ratio"]
    ctes = [
        ("lab", f"select *, {fail} machine_failure, {mode} failure_mode, "
                f"cast(case upper(tier) when 'L' then 0.0 when 'M' then 1.0 when 'H' then 2.0 else 1.0 end as double) type_encoded, "
                f"round_even({c1}*{c2}/10.0, 2) interaction_stress_index, round_even({c3}/greatest(abs({c1}), 0.1), 3) multi_sensor_load_ratio "
                f"from domain_{DOM}"),
        ("rng", "select " + ", ".join(f"round_even(quantile_cont({q(s)}, 0.5), 4) med{i}, round_even(stddev_samp({q(s)}), 4) sd{i}" for i, s in enumerate(DSENS)) + " from lab"),
        ("fb", " union all ".join(f"select {i} position, '{f}' feature, avg(coalesce({q(f)}, 0.0)) mean, stddev_samp(coalesce({q(f)}, 0.0)) + 1e-6 sd, "
                                  f"coalesce(abs(corr(coalesce({q(f)}, 0.0), cast(machine_failure as double))), 0.0) v from lab" for i, f in enumerate(feats))),
        ("imp", "select *, round_even(v / ((select sum(v) from fb) + 1e-9) * 100.0, 2) pct from fb"),
        ("imp2", "select *, row_number() over (order by pct desc, position) - 1 ord from imp"),
        ("topm", "select failure_mode from lab where failure_mode <> 'No Failure' group by failure_mode order by count(*) desc, failure_mode limit 1"),
    ]
    zs = " + ".join(f"abs({q(s)} - med{i}) / greatest(sd{i}, 0.001)" for i, s in enumerate(DSENS))
    ctes.append(("sc", f"select lab.*, least(0.96, greatest(0.02, (({zs}) / {float(len(DSENS))!r} - 0.55) / 1.65)) base_risk from lab cross join rng"))
    ctes.append(("sc2", f"select *, case when base_risk > 0.35 then coalesce((select failure_mode from topm), 'Detected Anomaly Failure') else 'No Failure' end risk_mode, "
                        f"{prob_expr('base_risk', 0.0)} p, round_even(greatest(2.0, (1.0 - base_risk*0.92)*220.0), 1) pred_rul, "
                        f"{_avg_sql([m for m, _ in MODEL_OFFSETS if m not in ('ANN (Deep MLP)', '1D-CNN', 'BiLSTM')])} avg_ml, "
                        f"{_avg_sql(['ANN (Deep MLP)', '1D-CNN', 'BiLSTM'])} avg_dl from sc"))
    ctes.append(("sc3", "select *, round_even(0.55*(100.0-p) + 0.45*least(greatest(pred_rul/220.0*100.0, 0.0), 100.0), 1) health_index from sc2"))
    ctes.append(("sc4", "select *, case when p>=68.0 or health_index<=32.0 or pred_rul<=18.0 then 'CRITICAL' when p>=36.0 or health_index<=60.0 or pred_rul<=48.0 then 'WARNING' "
                        "when p>=18.0 or health_index<=76.0 then 'ADVISORY' else 'OPTIMAL' end severity, "
                        "round_even(least(99.5, greatest(4.0, 100.0 - p*0.85)), 1) js_health from sc3"))
    att = " union all ".join(
        f"select rk, '{f}' feature, round_even(coalesce({q(f)}, 0.0), 3) value, "
        f"round_even((coalesce({q(f)}, 0.0) - (select mean from imp2 where feature = '{f}')) / (select sd from imp2 where feature = '{f}') "
        f"* ((select pct from imp2 where feature = '{f}') / 100.0), 4) impact, (select ord from imp2 where feature = '{f}') ord from lab"
        for f in feats)
    ctes.append(("att", f"select *, row_number() over (partition by rk order by abs(impact) desc, ord) rnk from ({att}) a"))
    return ctes


def _generic_sql(body: str) -> str:
    return oracle([f"domain_{DOM}"], body, _generic_ctes())


@register("q_p10_generic_risk", lambda: _generic_sql(
    "select rk, round_even(base_risk, 9) base_risk, risk_mode, p failure_prob_pct, pred_rul, health_index, severity, js_health, "
    "case when p>=68 or js_health<=32 then 'CRITICAL' when p>=36 or js_health<=60 then 'WARNING' when p>=18 then 'ADVISORY' else 'OPTIMAL' end js_severity from sc4"))
def p10(spark, sf):
    g = _generic(spark, sf)
    return g.select("rk", np_round(F.col("base_risk"), 9).alias("base_risk"), "risk_mode", "failure_prob_pct", "pred_rul",
                    "health_index", "severity", "js_health", "js_severity")


@register("q_x04_local_attributions", lambda: _generic_sql(
    "select rk, cast(rnk as integer) \"rank\", feature, value, impact, case when impact > 0 then 'Increases Risk' else 'Reduces Risk' end direction from att where rnk <= 10"))
def x04(spark, sf):
    return X.explode_attributions(_generic(spark, sf), "rk", "attrib", 10).withColumn("rank", F.col("rank").cast("int"))


def _r06_body():
    sens = ", ".join(f"'{s}'" for s in DSENS)
    med_case = "case feature " + " ".join(f"when '{s}' then med{i}" for i, s in enumerate(DSENS)) + " end"
    cur_case = "case feature " + " ".join(f"when '{s}' then {q(s)}" for s in DSENS) + " end"
    r7 = " || ' | ' || ".join(f"'{s}=' || cast(round_even(med{i}, 2) as varchar) || '=Optimal Window'" for i, s in enumerate(DSENS[:2]))
    return (f"select lab.rk, coalesce(t.txt, {r7}) tuning from lab cross join rng left join ("
            f"select rk, string_agg(feature || '=' || cast(round_even(m, 2) as varchar) || '=' || printf('%+.2f', round_even(m - cur, 2)), ' | ' order by rnk) txt from ("
            f"select att.rk, att.feature, att.rnk, att.impact, {med_case} m, coalesce({cur_case}, {med_case}) cur from att join lab using (rk) cross join rng "
            f"where att.rnk <= 4 and att.feature in ({sens})) z where impact > 0.02 and abs(cur - m) > 1e-3 group by rk) t on t.rk = lab.rk")


@register("q_r06_generic_setpoints", lambda: _generic_sql(_r06_body()))
def r06(spark, sf):
    return _generic(spark, sf).select("rk", "tuning")


def _r08_body():
    xai = ("(select printf('Primary XAI Attribution: ''%s'' (%s) contributes +%s log-odds toward failure.', feature, cast(value as varchar), printf('%.3f', round_even(impact, 3))) "
           "from att a where a.rk = sc4.rk and impact > 0 order by rnk limit 1)")
    cons = "printf('Hybrid Ensemble Consensus: Classical ML Avg Risk = %s%% | Deep Learning (ANN/CNN/BiLSTM) Avg Risk = %s%%.', cast(avg_ml as varchar), cast(avg_dl as varchar))"
    summ = ("case when severity in ('CRITICAL','WARNING') then printf('" + R.SUMMARY_ALERT.replace("'", "''") + "', severity, cast(p as varchar), cast(avg_ml as varchar), cast(avg_dl as varchar), risk_mode, cast(pred_rul as varchar), cast(health_index as varchar)) "
            "else printf('" + R.SUMMARY_CALM.replace("'", "''") + "', severity, cast(p as varchar), cast(health_index as varchar), cast(avg_ml as varchar), cast(avg_dl as varchar), cast(pred_rul as varchar)) end")
    top = "(select feature from att a where a.rk = sc4.rk and rnk = 1)"
    acts = (f"case when severity in ('CRITICAL','WARNING') then '[P1 - IMMEDIATE] ' || printf('" + R.ACT_DEFAULT_P1.replace("'", "''") + f"', risk_mode, {top}) || ' | [P2 - SHIFT TASK] {R.ACT_DEFAULT_P2}' "
            f"else '[P3 - PREVENTIVE] {R.ACT_DEFAULT_P3}' end")
    return f"select rk, {xai} xai_line, {cons} consensus_line, {summ} summary, {acts} actions from sc4"


@register("q_r08_r10_summaries", lambda: _generic_sql(_r08_body()))
def r08(spark, sf):
    return _generic(spark, sf).select("rk", "xai_line", "consensus_line", "summary", "actions")


def _r13_body():
    parts = []
    for i, s in enumerate(DSENS):
        v = f"coalesce({q(s)}, med{i})"
        parts.append(f"select rk, {i} pos, case when abs({v} - med{i}) / greatest(sd{i}, 0.001) > 1.2 then '{s}=' || cast(round_even(med{i}, 2) as varchar) || '=' || printf('%.2f', round_even(med{i} - {v}, 2)) end t from lab cross join rng")
    u = " union all ".join(parts)
    return (f"select lab.rk, coalesce(x.txt, '') js_tuning from lab left join (select rk, string_agg(t, ' | ' order by pos) txt from "
            f"(select *, row_number() over (partition by rk order by pos) k from ({u}) a where t is not null) b where k <= 3 group by rk) x on x.rk = lab.rk")


@register("q_r13_js_generic_setpoints", lambda: _generic_sql(_r13_body()))
def r13(spark, sf):
    return _generic(spark, sf).select("rk", "js_tuning")


def _x06_body():
    parts = []
    for idx in range(8):
        hi = -1.0 if idx % 3 == 2 else 1.0
        lo = 1.0 if idx == 0 else -1.0
        parts.append(f"select sc4.rk, {idx} i, imp2.feature || '=' || cast(round_even((imp2.pct / 100.0) * (sc4.p / 35.0 + 0.3) * "
                     f"case when sc4.p > 35 then {hi} else {lo} end, 4) as varchar) t from sc4 join imp2 on imp2.ord = {idx}")
    return f"select rk, string_agg(t, ' | ' order by i) js_attrib from ({' union all '.join(parts)}) a group by rk"


@register("q_x06_js_attributions", lambda: _generic_sql(_x06_body()))
def x06(spark, sf):
    return _generic(spark, sf).select("rk", "js_attrib")


# ------------------------------------------------------------------ D1, D2
@register("q_d01_failure_mode_distribution", oracle(["tel_clean"], "select failure_mode mode, count(*) count, round_even(count(*) / (select count(*) from tel_clean) * 100.0, 2) pct "
                                                                   "from (" + __import__("millwright.plans.q_labels", fromlist=["FLAGS_SQL"]).FLAGS_SQL + ") f where failure_mode <> 'No Failure' group by failure_mode"))
def d01(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    return D.failure_mode_distribution(L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0))


def _d02_sql():
    ctes = _l03_ctes()
    ctes.append(("lab2", "select rk, machine_failure label, row_number() over (partition by machine_failure order by md5(rk), rk) r, count(*) over (partition by machine_failure) n_c from lb"))
    ctes.append(("sp", "select rk, case when (r-1)*5 < n_c then 'test' when (r-1)*10 < n_c*3 then 'val' else 'train' end split from lab2"))
    return oracle(["tel_clean"], "select count(*) total_records, count_if(split='train') train_records, count_if(split='val') val_records, count_if(split='test') test_records, "
                                 "cast(sum(machine_failure) as bigint) total_failures, round_even(avg(machine_failure)*100.0, 2) failure_rate_pct, round_even(avg(rul), 1) avg_rul, "
                                 "round_even(avg(health), 1) avg_health_index from lb join sp using (rk)", ctes)


@register("q_d02_dataset_summary", _d02_sql)
def d02(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    d = L.milling_degradation(L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0))
    sp = stratified_split(d.select("rk", "machine_failure"), "machine_failure", "rk").select("rk", "split")
    return D.dataset_summary(d.join(sp, "rk"))
