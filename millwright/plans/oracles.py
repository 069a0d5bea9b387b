"""DuckDB oracle SQL builders (independent re-statements of the operators in SQL).

Only used by ``__spark_entry__.oracle_sql`` and the tests; nothing here runs on Spark.
"""

from __future__ import annotations

import math

from millwright.functions.exprs import lower_name_rounds_to_int
from millwright.sources.fixtures import hash_uniform_sql, oracle

TWO_PI = repr(2.0 * math.pi)
TWO_PI_OVER_60 = repr(2.0 * math.pi / 60.0)


def q(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def rnd(expr: str, d: int) -> str:
    return f"round_even({expr}, {d})"


def clean_ctes(src: str, sensors: list[str], keys: list[str], tier: str | None = "tier", k: float = 2.2,
               prefix: str = "") -> list[tuple[str, str]]:
    """CTEs dd (dedup), st (stats), tf (tier filled), tm (tier medians), imp (imputed), qt, cl (cleaned)."""
    p = prefix
    st_cols = ["count(*) n"]
    if tier:
        st_cols += [f"count_if({q(tier)} is null) tier_missing",
                    f"coalesce((select {q(tier)} from {p}dd where {q(tier)} is not null group by {q(tier)} "
                    f"order by count(*) desc, {q(tier)} limit 1), 'M') tier_mode"]
    for i, c in enumerate(sensors):
        st_cols += [f"count_if({q(c)} is null) m{i}", f"avg({q(c)}) a{i}", f"stddev_samp({q(c)}) s{i}",
                    f"quantile_cont({q(c)}, 0.5) q{i}"]
    ctes = [(f"{p}dd", f"select distinct * from {src}"), (f"{p}st", f"select {', '.join(st_cols)} from {p}dd")]
    other = [c for c in keys]
    if tier:
        ctes.append((f"{p}tf", f"select {', '.join(q(c) for c in other)}, coalesce({q(tier)}, {p}st.tier_mode) {q(tier)}, "
                              f"{', '.join(q(c) for c in sensors)} from {p}dd cross join {p}st"))
        ctes.append((f"{p}tm", f"select {q(tier)}, " + ", ".join(f"quantile_cont({q(c)}, 0.5) tm{i}" for i, c in enumerate(sensors))
                     + f" from {p}tf group by {q(tier)}"))
        imp = ", ".join(f"coalesce({p}tf.{q(c)}, {p}tm.tm{i}, {p}st.q{i}, 0.0) {q(c)}" for i, c in enumerate(sensors))
        ctes.append((f"{p}imp", f"select {', '.join(p + 'tf.' + q(c) for c in other)}, {p}tf.{q(tier)}, {imp} "
                                f"from {p}tf join {p}tm on {p}tf.{q(tier)} = {p}tm.{q(tier)} cross join {p}st"))
    else:
        imp = ", ".join(f"coalesce({p}dd.{q(c)}, {p}st.q{i}, 0.0) {q(c)}" for i, c in enumerate(sensors))
        ctes.append((f"{p}imp", f"select {', '.join(p + 'dd.' + q(c) for c in other)}, {imp} from {p}dd cross join {p}st"))
    ctes.append((f"{p}qt", "select " + ", ".join(
        f"quantile_cont({q(c)}, 0.25) q25_{i}, quantile_cont({q(c)}, 0.75) q75_{i}" for i, c in enumerate(sensors))
        + f" from {p}imp"))
    ctes.append((f"{p}fe", "select " + ", ".join(
        f"q25_{i} - 1.5*greatest(q75_{i}-q25_{i}, 1e-6) tl{i}, q75_{i} + 1.5*greatest(q75_{i}-q25_{i}, 1e-6) th{i}, "
        f"q25_{i} - {k}*greatest(q75_{i}-q25_{i}, 1e-6) wl{i}, q75_{i} + {k}*greatest(q75_{i}-q25_{i}, 1e-6) wh{i}"
        for i, c in enumerate(sensors)) + f" from {p}qt"))
    cl = []
    for i, c in enumerate(sensors):
        e = f"least(greatest({p}imp.{q(c)}, wl{i}), wh{i})"
        cl.append(f"{rnd(e, 0 if lower_name_rounds_to_int(c) else 3)} {q(c)}")
    tier_sel = f"{p}imp.{q(tier)}, " if tier else ""
    ctes.append((f"{p}cl", f"select {', '.join(p + 'imp.' + q(c) for c in other)}, {tier_sel}{', '.join(cl)} "
                           f"from {p}imp cross join {p}fe"))
    return ctes


def audit_select(sensors: list[str], p: str = "") -> str:
    """Q12 per-column audit table over the clean CTEs."""
    parts = []
    for i, c in enumerate(sensors):
        parts.append(
            f"select '{c}' as \"column\", st.m{i} as missing_before, round_even(st.m{i}/greatest(st.n,1)*100.0, 2) missing_pct, "
            f"0::bigint missing_after, 'Grouped Median by Tier' imputation_strategy, "
            f"(select count_if({q(c)} < tl{i} or {q(c)} > th{i}) from {p}imp cross join {p}fe) iqr_outliers_detected, "
            f"(select count_if(abs(({q(c)} - coalesce(st.a{i}, 0.0)) / greatest(coalesce(st.s{i}, 1.0), 1e-6)) > 3.0) from {p}imp) zscore_outliers_detected, "
            f"printf('IQR Winsorization [%.2f, %.2f]', round_even(fe.wl{i}, 2), round_even(fe.wh{i}, 2)) outlier_treatment, "
            f"round_even(coalesce(st.a{i}, 0.0), 2) mean_before, (select round_even(avg({q(c)}), 2) from {p}cl) mean_after, "
            f"round_even(coalesce(st.s{i}, 1.0), 2) std_before, (select round_even(stddev_samp({q(c)}), 2) from {p}cl) std_after "
            f"from {p}st st cross join {p}fe fe"
        )
    return "\nunion all\n".join(parts)


def milling_risk_sql(src: str, air="air", proc="proc", rpm="rpm", torque="torque", wear="wear", tier="tier",
                     prefix: str = "") -> tuple[str, str]:
    """(select-list fragment, FROM) computing P9 base_risk and risk_mode on ``src`` columns; returns two CTE bodies."""
    p = prefix
    s1 = (f"select *, round_even({proc}-{air}, 2) {p}td, round_even({torque}*(({rpm}*{TWO_PI})/60.0), 1) {p}pw, "
          f"round_even({wear}*{torque}, 1) {p}ov, case upper(coalesce({tier},'M')) when 'L' then 11000.0 when 'H' then 13000.0 else 12000.0 end {p}lim "
          f"from {src}")
    s2 = (f"select *, greatest(0.0, ({wear}-175.0)/55.0) {p}s_twf, "
          f"case when {p}td<8.8 and {rpm}<1400 then 0.82 else greatest(0.0,(9.2-{p}td)/4.0)*greatest(0.0,(1450.0-{rpm})/250.0) end {p}s_hdf, "
          f"case when {p}pw<3500 then (3600.0-{p}pw)/600.0 when {p}pw>9000 then ({p}pw-8800.0)/800.0 else 0.02 end {p}s_pwf, "
          f"greatest(0.0, ({p}ov-{p}lim*0.78)/({p}lim*0.28)) {p}s_osf")
    return s1, s2


def milling_risk_final(p: str = "") -> str:
    return (f"least(0.98, greatest(0.015, greatest({p}s_twf,{p}s_hdf,{p}s_pwf,{p}s_osf))) {p}base_risk, "
            f"case when {p}s_osf>={p}s_twf and {p}s_osf>={p}s_hdf and {p}s_osf>={p}s_pwf and {p}s_osf>0.25 then 'OSF (Overstrain Failure)' "
            f"when {p}s_hdf>={p}s_twf and {p}s_hdf>={p}s_pwf and {p}s_hdf>0.25 then 'HDF (Heat Dissipation)' "
            f"when {p}s_pwf>={p}s_twf and {p}s_pwf>0.25 then 'PWF (Power Failure)' "
            f"when {p}s_twf>0.25 then 'TWF (Tool Wear Failure)' else 'No Failure' end {p}risk_mode")


def risk_ctes(src: str, name: str = "rk9", **cols) -> list[tuple[str, str]]:
    s1, s2 = milling_risk_sql(src, **cols)
    return [(f"{name}_a", s1), (f"{name}_b", s2 + f" from {name}_a"),
            (name, f"select *, {milling_risk_final()} from {name}_b")]


def prob_expr(base: str, off: float) -> str:
    return f"round_even(least(99.2, greatest(0.8, ({base} + {off!r})*100.0)), 2)"


def hash_u(key: str, salt: str | None = None) -> str:
    return hash_uniform_sql(key, "duckdb", salt)


__all__ = ["oracle", "clean_ctes", "audit_select", "risk_ctes", "prob_expr", "q", "rnd", "hash_u",
           "milling_risk_final", "milling_risk_sql"]
