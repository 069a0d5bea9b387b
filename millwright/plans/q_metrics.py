"""Registered queries: evaluation metrics (E1–E13) and champion selection (M12) on the closed-form score set."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from millwright.functions.exprs import np_round
from millwright.operators import labels as L
from millwright.operators import metrics as E
from millwright.operators import sampling as B
from millwright.operators.scoring import MODEL_OFFSETS, explode_models, milling_risk
from millwright.plans.oracles import oracle, risk_ctes
from millwright.plans.registry import register
from millwright.sources.fixtures import fixture

G = ["model_no", "model"]


def scored(spark, sf):
    """``scored``: (rk, model, label, score) from P9/P11 on the rule-labelled telemetry."""
    t = fixture(spark, sf, "tel_flags").withColumn("label", F.greatest("twf", "hdf", "pwf", "osf", "rnf"))
    r = milling_risk(t)
    e = explode_models(r, keep=["rk", "label"])
    return e.withColumn("score", F.col("prob_pct") / 100.0)


MODELS_VALUES = ", ".join(f"({i}, '{m}', cast({off!r} as double))" for i, (m, off) in enumerate(MODEL_OFFSETS))
SCORED_CTES = risk_ctes("tel_flags", "r9") + [
    ("sc", f"select rk, greatest(twf,hdf,pwf,osf,rnf) label, m.model_no, m.model, "
           f"round_even(least(99.2, greatest(0.8, (base_risk + m.off)*100.0)), 2)/100.0 score "
           f"from r9 cross join (values {MODELS_VALUES}) m(model_no, model, off)"),
]
CM = ("select model_no, model, count_if(label=0 and score<0.5) tn, count_if(label=0 and score>=0.5) fp, "
      "count_if(label=1 and score<0.5) fn, count_if(label=1 and score>=0.5) tp from {src} group by model_no, model")
RATES = ("select *, round_even(case when tn+fp+fn+tp>0 then (tp+tn)/(tn+fp+fn+tp) else 0.0 end*100.0, 2) accuracy, "
         "round_even(case when tp+fp>0 then tp/(tp+fp) else 0.0 end*100.0, 2) \"precision\", "
         "round_even(case when tp+fn>0 then tp/(tp+fn) else 0.0 end*100.0, 2) recall, "
         "round_even(case when 2*tp+fp+fn>0 then 2*tp/(2*tp+fp+fn) else 0.0 end*100.0, 2) f1_score, "
         "round_even(case when (tp+fp)*(tp+fn)*(tn+fp)*(tn+fn) > 0 then (tp*tn - fp*fn)/sqrt(cast(tp+fp as double)*(tp+fn)*(tn+fp)*(tn+fn)) else 0.0 end, 4) mcc "
         "from ({cm}) c")


def _cm(src="sc"):
    return RATES.format(cm=CM.format(src=src))


@register("q_e01_confusion_rates", oracle(["tel_flags"], _cm(), SCORED_CTES))
def e01(spark, sf):
    return E.rates(E.confusion(scored(spark, sf), G))


SPLIT_CTES = SCORED_CTES + [
    ("lab", "select rk, label, row_number() over (partition by label order by md5(rk), rk) r, count(*) over (partition by label) n_c "
            "from (select rk, greatest(twf,hdf,pwf,osf,rnf) label from tel_flags) x"),
    ("spl", "select rk, case when (r-1)*5 < n_c then 'test' when (r-1)*10 < n_c*3 then 'val' else 'train' end split from lab"),
    ("sct", "select sc.*, spl.split from sc join spl using (rk)"),
]


@register("q_e03_train_vs_test_accuracy", oracle(["tel_flags"], "select s.model_no, s.model, s.split, round_even(avg(case when (score>=0.5) = (label=1) then 1.0 else 0.0 end)*100.0, 2) accuracy "
                                                                "from sct s where split in ('train','test') group by s.model_no, s.model, s.split", SPLIT_CTES))
def e03(spark, sf):
    s = scored(spark, sf)
    sp = B.stratified_split(s.filter(F.col("model_no") == 0).select("rk", "label"), "label", "rk").select("rk", "split")
    j = s.join(sp, "rk").filter(F.col("split").isin("train", "test"))
    return E.rates(E.confusion(j, G + ["split"])).select(*G, "split", "accuracy")


AUC_SQL = ("select model_no, model, case when sum(pos)>0 and sum(neg)>0 then sum(pos*((cneg-neg)+0.5*neg))/(sum(pos)*sum(neg)) else 0.95 end roc_auc from "
           "(select *, sum(neg) over (partition by model_no order by s rows between unbounded preceding and current row) cneg from "
           "(select model_no, model, score s, count_if(label=1) pos, count_if(label<>1) neg from sc group by model_no, model, score) a) b group by model_no, model")
AP_SQL = ("select model_no, model, case when max(P)>0 and max(N)>0 then sum((pos/P)*(cpos/(cpos+cneg))) else 0.85 end pr_auc from "
          "(select *, sum(pos) over (partition by model_no order by s desc rows between unbounded preceding and current row) cpos, "
          "sum(neg) over (partition by model_no order by s desc rows between unbounded preceding and current row) cneg, "
          "sum(pos) over (partition by model_no) P, sum(neg) over (partition by model_no) N from "
          "(select model_no, model, score s, count_if(label=1) pos, count_if(label<>1) neg from sc group by model_no, model, score) a) b group by model_no, model")


@register("q_e04_roc_auc_ap_brier", oracle(["tel_flags"], "select a.model_no, a.model, round_even(roc_auc, 9) roc_auc, round_even(pr_auc, 9) pr_auc, brier_score from "
                                                           f"({AUC_SQL}) a join ({AP_SQL}) p using (model_no, model) join "
                                                           "(select model_no, round_even(avg(pow(score-label, 2)), 4) brier_score from sc group by model_no) b using (model_no)", SCORED_CTES))
def e04(spark, sf):
    s = scored(spark, sf)
    d = E.curve_metrics(E.score_counts(s, G), G).join(E.brier(s, G), G)
    return d.select(*G, np_round(F.col("roc_auc"), 9).alias("roc_auc"), np_round(F.col("pr_auc"), 9).alias("pr_auc"), "brier_score")


ROC_SQL = (
    "with cu as (select *, sum(pos) over w cpos, sum(neg) over w cneg, row_number() over (partition by model_no order by s desc) idx from "
    "(select model_no, model, score s, count_if(label=1) pos, count_if(label<>1) neg from sc group by model_no, model, score) a "
    "window w as (partition by model_no order by s desc rows between unbounded preceding and current row)), "
    "d2 as (select *, lag(cpos) over o - 2*cpos + lead(cpos) over o d2p, lag(cneg) over o - 2*cneg + lead(cneg) over o d2n from cu window o as (partition by model_no order by idx)), "
    "tot as (select model_no, model, sum(pos) P, sum(neg) N from cu group by model_no, model), "
    "pts as (select model_no, model, idx, cpos, cneg from d2 where d2p <> 0 or d2n <> 0 or d2p is null or d2n is null "
    "union all select model_no, model, 0, 0, 0 from tot), "
    "kp as (select *, row_number() over (partition by model_no order by idx) - 1 k from pts) "
    "select kp.model_no, kp.model, cast(k as integer) point_no, round_even(cneg/N, 4) fpr, round_even(cpos/P, 4) tpr from kp "
    "join tot on tot.model_no = kp.model_no"
)


@register("q_e08_roc_curve", oracle(["tel_flags"], ROC_SQL, SCORED_CTES))
def e08(spark, sf):
    return E.roc_curve(scored(spark, sf), G)


PR_SQL = (
    "with cu as (select *, sum(pos) over w cpos, sum(neg) over w cneg, row_number() over (partition by model_no order by s desc) idx, "
    "sum(pos) over (partition by model_no) P, count(*) over (partition by model_no) D from "
    "(select model_no, model, score s, count_if(label=1) pos, count_if(label<>1) neg from sc group by model_no, model, score) a "
    "window w as (partition by model_no order by s desc rows between unbounded preceding and current row)), "
    "pts as (select model_no, model, D - idx k, case when cpos+cneg>0 then cpos/(cpos+cneg) else 0.0 end \"precision\", "
    "case when P>0 then cpos/P else 1.0 end recall, D + 1 n_pts from cu "
    "union all select distinct model_no, model, D k, 1.0, 0.0, D + 1 from cu) "
    "select model_no, model, cast(k as integer) point_no, round_even(recall, 4) recall, round_even(\"precision\", 4) \"precision\" from pts"
)


@register("q_e09_pr_curve", oracle(["tel_flags"], PR_SQL, SCORED_CTES))
def e09(spark, sf):
    return E.pr_curve(scored(spark, sf), G)


LB_SQL = (
    f"with te as (select * from sct where split = 'test'), tr as (select * from sct where split = 'train'), "
    f"r as ({RATES.format(cm=CM.format(src='te'))}), "
    f"ta as (select model_no, accuracy train_accuracy from ({RATES.format(cm=CM.format(src='tr'))}) x), "
    f"au as ({AUC_SQL.replace('from sc group', 'from te group')}), ap as ({AP_SQL.replace('from sc group', 'from te group')}), "
    f"br as (select model_no, round_even(avg(pow(score-label, 2)), 4) brier_score from te group by model_no) "
    f"select r.*, round_even(roc_auc*100.0, 2) roc_auc, round_even(pr_auc*100.0, 2) pr_auc, brier_score, train_accuracy, "
    f"cast(row_number() over (order by f1_score desc, r.model_no) as integer) leaderboard_rank, "
    f"row_number() over (order by f1_score desc, r.model_no) = 1 is_champion "
    f"from r join au using (model_no, model) join ap using (model_no, model) join br using (model_no) join ta using (model_no)"
)


@register("q_e10_leaderboard", oracle(["tel_flags"], LB_SQL, SPLIT_CTES))
def e10(spark, sf):
    # split the base rows (one per rk), join once, then fan out to the 7 models
    t = fixture(spark, sf, "tel_flags").withColumn("label", F.greatest("twf", "hdf", "pwf", "osf", "rnf"))
    r = milling_risk(B.stratified_split(t, "label", "rk"))
    j = explode_models(r, keep=["rk", "label", "split"]).withColumn("score", F.col("prob_pct") / 100.0)
    board = E.leaderboard(j, G)
    return E.champion(board).withColumn("leaderboard_rank", F.col("leaderboard_rank").cast("int"))


def _rul_sql():
    from millwright.plans.q_labels import _l03_sql  # noqa: F401
    return None


E12_SQL_TAIL = ("select round_even(avg(abs(e)), 2) mae, round_even(sqrt(avg(e*e)), 2) rmse, "
                "round_even(case when var_pop(rul) > 0 then 1.0 - sum(e*e)/(var_pop(rul)*count(*)) else 0.0 end, 4) r2_score from "
                "(select rul, pred_rul - rul e from j) x")


def _e12_sql():
    from millwright.plans.q_labels import FLAGS_SQL, LIM, OMEGA, clipsql, hu
    deg = (f"{clipsql('0.45*' + clipsql('wear/225.0', 0.0, 1.15) + ' + 0.30*' + clipsql(f'(wear*torque)/{LIM}', 0.0, 1.15) + ' + 0.15*('
                      + clipsql('(10.0-(proc-air))/3.0', 0.0, 1.0) + '*' + clipsql('(1450.0-rpm)/250.0', 0.0, 1.0) + ') + 0.10*greatest('
                      + clipsql(f'(3800.0-torque*(rpm*{OMEGA}))/800.0', 0.0, 1.0) + ', ' + clipsql(f'(torque*(rpm*{OMEGA})-8500.0)/1000.0', 0.0, 1.0) + ')', 0.0, 1.0)}")
    ctes = [("lb", f"select *, least(greatest(round_even(case when machine_failure=1 then {hu('rk', 'rul')}*8.0 else (1.0-({deg}))*220.0 end, 1), 0.0), 240.0) rul "
                   f"from ({FLAGS_SQL}) f")]
    ctes += risk_ctes("lb", "r9")
    ctes.append(("j", "select rul, round_even(greatest(2.0, (1.0 - base_risk*0.92)*220.0), 1) pred_rul from r9"))
    return oracle(["tel_clean"], E12_SQL_TAIL, ctes)


@register("q_e12_rul_errors", _e12_sql)
def e12(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    d = L.milling_degradation(L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0))
    r = milling_risk(d)
    r = r.withColumn("pred_rul", np_round(F.greatest(F.lit(2.0), (F.lit(1.0) - F.col("base_risk") * 0.92) * 220.0), 1))
    return E.rul_errors(r, [])


@register("q_e13_weighted_bce", oracle(["tel_flags"], "select model_no, model, round_even(avg(-(w*label*ln(p) + (1.0-label)*ln(1.0-p))), 6) bce from "
                                                       "(select *, least(greatest(score, 1e-5), 1.0 - 1e-5) p from sc) s cross join "
                                                       "(select least(4.5, greatest(1.0, (count(*) - count_if(label=1))/greatest(count_if(label=1), 1))) w from sc where model_no = 0) c "
                                                       "group by model_no, model", SCORED_CTES))
def e13(spark, sf):
    s = scored(spark, sf)
    w = B.class_weights(s.filter(F.col("model_no") == 0), "label").first()["dl_pos_weight"]
    return E.weighted_bce(s, G, w).select(*G, np_round(F.col("bce"), 6).alias("bce"))
