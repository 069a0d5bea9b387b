"""Registered queries: flagship report and data-quality operators (Q1–Q14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators.quantiles import exact_quantiles, quantile_table
from millwright.operators.quality import Cleaner, drop_exact_duplicates, duplicate_counts, missing_profile, numeric_cast
from millwright.plans.oracles import (
    TWO_PI_OVER_60, audit_select, clean_ctes, oracle, prob_expr, q, risk_ctes,
)
from millwright.plans.registry import register
from millwright.operators import prescribe as R
from millwright.plans.risk_report import MILLING_SHORT, OPTIMAL_SENSORS, milling_risk_report
from millwright.sources.fixtures import fixture

S = MILLING_SHORT
KEYS = ["rk", "h"]


def _raw(spark, sf):
    return fixture(spark, sf, "tel_raw")


# ---------------------------------------------------------------- flagship
def report_sql(ctes: list[tuple[str, str]], src: str) -> tuple[list[tuple[str, str]], str]:
    """(CTEs, body) of the milling report on the clean readings of ``src``, before it is completed."""
    ctes = list(ctes)
    ctes.append(("ft", f"select *, case upper(coalesce(tier,'M')) when 'L' then 11000.0 when 'H' then 13000.0 else 12000.0 end lim2, "
                       f"round_even(proc-air, 2) f_td, round_even(torque*(rpm*{TWO_PI_OVER_60}), 1) f_pw, round_even(wear*torque, 1) f_ov from {src}"))
    ctes += risk_ctes("ft", "r1")
    ctes.append(("s1", f"select *, {prob_expr('base_risk', 0.0)} failure_prob_pct, "
                       f"round_even(greatest(2.0, (1.0 - base_risk*0.92)*220.0), 1) pred_rul, "
                       f"round_even(((((0.0 + {prob_expr('base_risk', 0.0)}) + {prob_expr('base_risk', -0.012)}) + {prob_expr('base_risk', 0.008)}) + {prob_expr('base_risk', 0.045)}) / 4, 2) classical_avg_pct, "
                       f"round_even((((0.0 + {prob_expr('base_risk', 0.022)}) + {prob_expr('base_risk', 0.015)}) + {prob_expr('base_risk', 0.019)}) / 3, 2) deep_avg_pct "
                       f"from r1"))
    ctes.append(("s2", "select *, round_even(0.55*(100.0-failure_prob_pct) + 0.45*least(greatest(pred_rul/220.0*100.0, 0.0), 100.0), 1) health_index from s1"))
    ctes.append(("s3", "select *, case when failure_prob_pct>=68.0 or health_index<=32.0 or pred_rul<=18.0 then 'CRITICAL' "
                       "when failure_prob_pct>=36.0 or health_index<=60.0 or pred_rul<=48.0 then 'WARNING' "
                       "when failure_prob_pct>=18.0 or health_index<=76.0 then 'ADVISORY' else 'OPTIMAL' end severity, "
                       "(f_td<8.6 and rpm<1380) c_hdf, (f_pw<3500.0 or f_pw>9000.0) c_pwf, (f_ov>lim2*0.90) c_osf, (wear>=185) c_twf, "
                       "(torque>46.0 or f_ov>lim2*0.85) t_tq, (rpm<1410 or rpm>2100) t_rpm, (wear>150) t_wear, (air>301.5) t_air from s2"))
    ctes.append(("s4", "select *, case when t_air then 299.2 else air end opt_air, case when t_rpm then 1560.0 else rpm end opt_rpm, "
                       "case when t_tq then 37.5 else torque end opt_torque, case when t_wear then 15.0 else wear end opt_wear from s3"))
    s4_cols = "opt_air", "opt_rpm", "opt_torque", "opt_wear"
    from millwright.plans.oracles import milling_risk_sql, milling_risk_final
    a, b = milling_risk_sql("s4", air=s4_cols[0], proc="proc", rpm=s4_cols[1], torque=s4_cols[2], wear=s4_cols[3], tier="tier", prefix="cf_")
    ctes += [("c1", a), ("c2", b + " from c1"), ("c3", f"select *, {milling_risk_final('cf_')} from c2")]
    fx = lambda e, d: f"printf('%.{d}f', round_even({e}, {d}))"
    sg = lambda e, d: f"printf('%+.{d}f', round_even({e}, {d}))"
    diags = (f"list_filter([case when c_hdf then printf('Thermodynamic Heat Dissipation Deficit: ΔT = %s K (< 8.6 K) coupled with low convective speed (%s rpm < 1380 rpm).', {fx('f_td', 1)}, {fx('rpm', 0)}) end, "
             f"case when c_pwf then printf('Mechanical Power Envelope Breach: Spindle Power = %s W (Safe operating range: 3,500 W – 9,000 W).', {fx('f_pw', 0)}) end, "
             f"case when c_osf then printf('Overstrain Stress Overload: Tool Wear × Torque = %s Nm·min (Threshold for Tier %s: %s Nm·min).', {fx('f_ov', 0)}, upper(coalesce(tier,'M')), {fx('lim2', 0)}) end, "
             f"case when c_twf then printf('Cutting Tool Wear Critical Zone: %s min accumulated (TWF failure zone: 200–240 min).', {fx('wear', 0)}) end], lambda x: x is not null)")
    acts = (f"list_filter([case when c_hdf then '[P1 - IMMEDIATE] Boost spindle speed to 1,550 rpm and engage auxiliary coolant chiller to restore convective heat transfer.' end, "
            f"case when c_pwf then '[P1 - IMMEDIATE] Re-modulate VFD drive torque/speed ratio so mechanical power stabilizes near 5,800 W.' end, "
            f"case when c_osf then printf('[P1 - IMMEDIATE] Throttle feed torque from %s Nm down to 36.0 Nm and replace worn cutting insert.', {fx('torque', 1)}) end, "
            f"case when c_twf then '[P2 - SHIFT TASK] Trigger automated CNC tool-changer swap to fresh tool insert (reset wear to 0 min).' end], lambda x: x is not null)")
    default_acts = ("case when severity in ('CRITICAL','WARNING') then printf('[P1 - IMMEDIATE] Apply AI Counterfactual Setpoints to mitigate ''%s'' and inspect primary sensor channel (%s).', risk_mode, 'Tool wear [min]') "
                    "|| ' | [P2 - SHIFT TASK] Perform borescope / thermographic inspection during next scheduled changeover.' "
                    "else '[P3 - PREVENTIVE] Maintain current CNC/turbine operating profile; next automated lubrication & calibration check in 48 hours.' end")
    parts = ("list_filter([case when c_hdf then 'Spindle Chiller Coolant Filter & Thermal Valve' end, "
             "case when c_pwf then 'VFD Inverter Current Sensor & Fuse Module' end, "
             "case when c_osf or c_twf then printf('Grade-%s Coated Carbide Milling Insert', upper(coalesce(tier,'M'))) end], lambda x: x is not null)")
    tuning = (f"list_filter([case when t_tq then 'Torque [Nm]=37.5=' || {sg('37.5 - torque', 1)} || ' Nm' end, "
              f"case when t_rpm then 'Rotational speed [rpm]=1560.0=' || {sg('1560.0 - round_even(rpm, 0)', 0)} || ' rpm' end, "
              f"case when t_wear then 'Tool wear [min]=15.0=' || {sg('15.0 - round_even(wear, 0)', 0)} || ' min (Tool Swap)' end, "
              f"case when t_air then 'Air temperature [K]=299.2=' || {sg('299.2 - air', 1)} || ' K' end], lambda x: x is not null)")
    body = (f"select rk, tier, failure_prob_pct, risk_mode dominant_mode, pred_rul, health_index, severity, classical_avg_pct, deep_avg_pct, "
            f"cast(len({diags}) as integer) n_findings, array_to_string({diags}, ' | ') diagnostics, "
            f"case when len({acts}) = 0 then {default_acts} else array_to_string({acts}, ' | ') end actions, "
            f"case when len({parts}) = 0 then 'Standard Preventive Seal & Sensor Calibration Kit' else array_to_string({parts}, ' | ') end spare_parts, "
            f"array_to_string({tuning}, ' | ') tuning, "
            f"{prob_expr('cf_base_risk', 0.0)} projected_risk_pct, "
            f"round_even({prob_expr('cf_base_risk', 0.0)} - failure_prob_pct, 2) risk_delta from c3")
    return ctes, body


def _flagship_sql() -> str:
    ctes, body = report_sql(clean_ctes("tel_raw", S, KEYS), "cl")
    text = lambda *cols: ", ".join(f"cast({c} as varchar)" for c in cols)
    avgs = text("classical_avg_pct", "deep_avg_pct")
    cons = "printf('" + R.DIAG_CONSENSUS + f"', {avgs})"
    calm = " || ' | ' || ".join(f"'{name}=' || cast(round_even(q{S.index(c)}, 2) as varchar) || '=Optimal Window'" for name, c in OPTIMAL_SENSORS)
    summ = ("case when severity in ('CRITICAL','WARNING') then printf('" + R.SUMMARY_ALERT.replace("'", "''") + f"', severity, {text('failure_prob_pct')}, {avgs}, dominant_mode, {text('pred_rul', 'health_index')}) "
            "else printf('" + R.SUMMARY_CALM.replace("'", "''") + f"', severity, {text('failure_prob_pct', 'health_index')}, {avgs}, {text('pred_rul')}) end")
    body = (f"select b.* replace (case when diagnostics = '' then {cons} else diagnostics || ' | ' || {cons} end as diagnostics, "
            f"case when tuning = '' then {calm} else tuning end as tuning), {summ} summary from ({body}) b cross join st")
    return oracle(["tel_raw"], body, ctes)


@register("q00_milling_risk_report", _flagship_sql)
def q00(spark, sf):
    return milling_risk_report(_raw(spark, sf))


# ---------------------------------------------------------------- Q1, Q2
@register("q01_duplicates", oracle(["tel_raw"], "select count(*) initial_rows, (select count(*) from (select distinct * from tel_raw) d) cleaned_rows, "
                                                "count(*) - (select count(*) from (select distinct * from tel_raw) d) duplicates_removed from tel_raw"))
def q01(spark, sf):
    return duplicate_counts(_raw(spark, sf))


@register("q02_tier_mode", oracle(["tel_raw"], "select count_if(tier is null) tier_missing, coalesce((select tier from (select distinct * from tel_raw) d "
                                               "where tier is not null group by tier order by count(*) desc, tier limit 1), 'M') tier_fill "
                                               "from (select distinct * from tel_raw) x"))
def q02(spark, sf):
    d = drop_exact_duplicates(_raw(spark, sf))
    return d.agg(F.count_if(F.col("tier").isNull()).alias("tier_missing"),
                 F.coalesce(F.mode("tier", True), F.lit("M")).alias("tier_fill"))


# ---------------------------------------------------------------- Q3, Q4, Q5
def _missing_sql():
    cols = S + ["tier"]
    parts = [f"select '{c}' as \"column\", count_if({q(c)} is null) missing, round_even(count_if({q(c)} is null)/greatest(count(*),1)*100.0, 2) missing_pct "
             f"from (select distinct * from tel_raw) d" for c in cols]
    return oracle(["tel_raw"], "\nunion all\n".join(parts))


@register("q03_missing_profile", _missing_sql)
def q03(spark, sf):
    return missing_profile(drop_exact_duplicates(_raw(spark, sf)), S + ["tier"])


def _texty(spark, sf):
    d = _raw(spark, sf)
    return d.withColumns({c: F.when(F.col("h") % 89 == i, F.lit("n/a")).otherwise(F.col(c).cast("string")) for i, c in enumerate(S)})


def _coerce_sql():
    parts = [f"select '{c}' as \"column\", count_if(try_cast(v as double) is null) n_null, round_even(sum(try_cast(v as double)), 3) total "
             f"from (select case when h%89={i} then 'n/a' else cast({q(c)} as varchar) end v from tel_raw) t" for i, c in enumerate(S)]
    return oracle(["tel_raw"], "\nunion all\n".join(parts))


@register("q04_numeric_coercion", _coerce_sql)
def q04(spark, sf):
    d = _texty(spark, sf)
    aggs = [F.struct(F.lit(c).alias("column"), F.count_if(numeric_cast(c).isNull()).alias("n_null"),
                     np_round(F.sum(numeric_cast(c)), 3).alias("total")).alias(f"r{i}") for i, c in enumerate(S)]
    return d.agg(*aggs).select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(S))])).alias("r")).select("r.*")


def _moments_sql():
    parts = [f"select '{c}' as \"column\", round_even(avg({q(c)}), 6) mean, round_even(stddev_samp({q(c)}), 6) std, "
             f"round_even(quantile_cont({q(c)}, 0.5), 6) median from (select distinct * from tel_raw) d" for c in S]
    return oracle(["tel_raw"], "\nunion all\n".join(parts))


@register("q05_valid_moments", _moments_sql)
def q05(spark, sf):
    d = drop_exact_duplicates(_raw(spark, sf))
    med = exact_quantiles(d, {c: col(c) for c in S}, [0.5])
    aggs = [F.struct(F.lit(c).alias("column"), np_round(F.avg(col(c)), 6).alias("mean"),
                     np_round(F.stddev_samp(col(c)), 6).alias("std"),
                     np_round(F.lit(med[c][0]).cast("double"), 6).alias("median")).alias(f"r{i}") for i, c in enumerate(S)]
    return d.agg(*aggs).select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(S))])).alias("r")).select("r.*")


# ---------------------------------------------------------------- Q6
def _tier_median_sql():
    ctes = clean_ctes("tel_raw", S, KEYS)
    body = "\nunion all\n".join(f"select tier, '{c}' as \"column\", round_even(tm{i}, 6) median from tm" for i, c in enumerate(S))
    return oracle(["tel_raw"], body, ctes)


@register("q06_tier_medians", _tier_median_sql)
def q06(spark, sf):
    raw = _raw(spark, sf)
    d = drop_exact_duplicates(raw)
    mode = d.filter("tier is not null").groupBy("tier").count().orderBy(F.desc("count"), "tier").first()
    t = d.withColumn("tier", F.coalesce("tier", F.lit(mode["tier"] if mode else "M")))
    med = quantile_table(t, {c: col(c) for c in S}, [0.5], ["tier"])
    return med.select("tier", F.element_at(F.array(*[F.lit(c) for c in S]), F.col("cid") + 1).alias("column"), np_round(F.col("q")[0], 6).alias("median"))


# ---------------------------------------------------------------- Q7, Q8, Q9/Q10, Q11, Q12, Q13
def _audit_sql():
    ctes = clean_ctes("tel_raw", S, KEYS)
    return oracle(["tel_raw"], f"select * from ({audit_select(S)}) a", ctes)


@register("q12_audit_table", _audit_sql)
def q12(spark, sf):
    m = Cleaner(S, "tier").fit(_raw(spark, sf))
    return m.audit_table(spark)


def _outlier_sql():
    ctes = clean_ctes("tel_raw", S, KEYS)
    return oracle(["tel_raw"], f"select \"column\", iqr_outliers_detected, zscore_outliers_detected from ({audit_select(S)}) a", ctes)


@register("q07_outlier_audit", _outlier_sql)
def q07(spark, sf):
    m = Cleaner(S, "tier").fit(_raw(spark, sf))
    return m.audit_table(spark).select("column", "iqr_outliers_detected", "zscore_outliers_detected")


def _cleaned_sql():
    ctes = clean_ctes("tel_raw", S, KEYS)
    return oracle(["tel_raw"], "select * from cl", ctes)


@register("q09_winsorized_table", _cleaned_sql)
def q09(spark, sf):
    raw = _raw(spark, sf)
    m, work = Cleaner(S, "tier").fit_dedup(raw)
    return m.transform(work)


def _after_sql():
    ctes = clean_ctes("tel_raw", S, KEYS)
    body = "\nunion all\n".join(f"select '{c}' as \"column\", round_even(avg({q(c)}), 6) mean_after, round_even(stddev_samp({q(c)}), 6) std_after from cl" for c in S)
    return oracle(["tel_raw"], body, ctes)


@register("q11_after_moments", _after_sql)
def q11(spark, sf):
    raw = _raw(spark, sf)
    m, work = Cleaner(S, "tier").fit_dedup(raw)
    clean = m.transform(work)
    aggs = [F.struct(F.lit(c).alias("column"), np_round(F.avg(col(c)), 6).alias("mean_after"),
                     np_round(F.stddev_samp(col(c)), 6).alias("std_after")).alias(f"r{i}") for i, c in enumerate(S)]
    return clean.agg(*aggs).select(F.explode(F.array(*[F.col(f"r{i}") for i in range(len(S))])).alias("r")).select("r.*")


def _report_sql():
    ctes = clean_ctes("tel_raw", S, KEYS)
    body = (f"select (select count(*) from tel_raw) initial_rows, (select n from st) cleaned_rows, "
            f"(select count(*) from tel_raw) - (select n from st) duplicates_removed, "
            f"cast(sum(missing_before) as bigint) + (select tier_missing from st) total_missing_detected, 0::bigint total_missing_after, "
            f"cast(sum(iqr_outliers_detected) as bigint) total_iqr_outliers_detected, cast(sum(zscore_outliers_detected) as bigint) total_zscore_outliers_detected, "
            f"'Type-Stratified Median & Mode Imputation' imputation_method, 'Tukey IQR Audit + Robust Winsorization Capping' outlier_method, "
            f"'StandardScaler (Z-Score Normalization for DL & Linear Models)' scaling_method from ({audit_select(S)}) a")
    return oracle(["tel_raw"], body, ctes)


@register("q13_quality_report", _report_sql)
def q13(spark, sf):
    m = Cleaner(S, "tier").fit(_raw(spark, sf))
    return m.report_df(spark)


# ---------------------------------------------------------------- Q14
def _refit_sql():
    ctes = [("half", "select * from tel_raw where h%2=0")] + clean_ctes("half", S, KEYS)
    sel = []
    for i, c in enumerate(S):
        from millwright.functions.exprs import lower_name_rounds_to_int
        e = f"least(greatest(coalesce(r.{q(c)}, tm.tm{i}, st.q{i}, 0.0), fe.wl{i}), fe.wh{i})"
        sel.append(f"round_even({e}, {0 if lower_name_rounds_to_int(c) else 3}) {q(c)}")
    body = (f"select r.rk, r.h, coalesce(r.tier, st.tier_mode) tier, {', '.join(sel)} from tel_raw r cross join st cross join fe "
            f"left join tm on tm.tier = coalesce(r.tier, st.tier_mode)")
    return oracle(["tel_raw"], body, ctes)


@register("q14_refit_apply", _refit_sql)
def q14(spark, sf):
    raw = _raw(spark, sf)
    m = Cleaner(S, "tier").fit(raw.filter(F.col("h") % 2 == 0))
    return m.transform(raw)
