"""Registered queries: labelling rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators import labels as L
from millwright.plans.oracles import oracle, q
from millwright.plans.registry import register
from millwright.sources.catalog import DOMAIN_SPECS
from millwright.sources.fixtures import fixture, hash_uniform_sql

OMEGA = repr(L.OMEGA)
LIM = "case upper(tier) when 'L' then 11000.0 when 'H' then 13000.0 else 12000.0 end"


def hu(key, salt):
    return hash_uniform_sql(key, "duckdb", salt)


def clipsql(e, lo, hi):
    return f"least(greatest({e}, {lo}), {hi})"


def _flags(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    return L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0)


FLAGS_SQL = (f"select *, greatest(twf,hdf,pwf,osf,rnf) machine_failure, case when hdf=1 then 'HDF (Heat Dissipation)' "
             f"when pwf=1 then 'PWF (Power Failure)' when osf=1 then 'OSF (Overstrain Failure)' when twf=1 then 'TWF (Tool Wear Failure)' "
             f"when rnf=1 then 'RNF (Random Failure)' else 'No Failure' end failure_mode from (select *, "
             f"cast(wear >= 200 + h%41 as integer) twf, cast((proc-air)<8.6 and rpm<1380 as integer) hdf, "
             f"cast(torque*(rpm*{OMEGA})<3500.0 or torque*(rpm*{OMEGA})>9000.0 as integer) pwf, "
             f"cast(wear*torque > {LIM} as integer) osf, cast(h%997=0 as integer) rnf from tel_clean) x")


@register("q_l01_milling_flags", oracle(["tel_clean"], f"select rk, twf, hdf, pwf, osf, rnf, machine_failure, failure_mode from ({FLAGS_SQL}) f"))
def l01(spark, sf):
    return _flags(spark, sf).select("rk", "twf", "hdf", "pwf", "osf", "rnf", "machine_failure", "failure_mode")


def _l03_sql():
    deg = (f"{clipsql('0.45*' + clipsql('wear/225.0', 0.0, 1.15) + ' + 0.30*' + clipsql(f'(wear*torque)/{LIM}', 0.0, 1.15) + ' + 0.15*('
                      + clipsql('(10.0-(proc-air))/3.0', 0.0, 1.0) + '*' + clipsql('(1450.0-rpm)/250.0', 0.0, 1.0) + ') + 0.10*greatest('
                      + clipsql(f'(3800.0-torque*(rpm*{OMEGA}))/800.0', 0.0, 1.0) + ', ' + clipsql(f'(torque*(rpm*{OMEGA})-8500.0)/1000.0', 0.0, 1.0) + ')', 0.0, 1.0)}")
    body = (f"select rk, machine_failure, round_even(d, 6) degradation, "
            f"least(greatest(round_even(case when machine_failure=1 then {hu('rk', 'rul')}*8.0 else (1.0-d)*220.0 end, 1), 0.0), 240.0) rul, "
            f"round_even(least(greatest(100.0*(1.0-d), 0.0), 100.0), 1) health from (select *, {deg} d from ({FLAGS_SQL}) f) g")
    return oracle(["tel_clean"], body)


@register("q_l03_milling_degradation", _l03_sql)
def l03(spark, sf):
    d = L.milling_degradation(_flags(spark, sf))
    return d.select("rk", "machine_failure", np_round(F.col("degradation"), 6).alias("degradation"), "rul", "health")


def _l04_sql():
    u = hu("unit_id", "mode")
    cum, whens = 0.0, []
    for name, pr in L.TURBOFAN_MODES[:-1]:
        cum += pr
        whens.append(f"when {u} < {cum!r} then '{name}'")
    mode = f"case {' '.join(whens)} else '{L.TURBOFAN_MODES[-1][0]}' end"
    body = (f"select unit_id, cycle, cast(least(max_cycle - cycle, 125.0) as double) rul, cast(max_cycle - cycle <= 30 as integer) machine_failure, "
            f"case when max_cycle - cycle <= 30 then {mode} else 'No Failure' end failure_mode, "
            f"round_even(least(greatest(100.0*(1.0 - least(greatest(pow(cycle/max_cycle, 2.4), 0.0), 1.35)/1.15), 0.0), 100.0), 1) health "
            f"from unit_cycles")
    return oracle(["unit_cycles"], body)


@register("q_l04_run_to_failure", _l04_sql)
def l04(spark, sf):
    d = L.run_to_failure_labels(fixture(spark, sf, "unit_cycles").select("unit_id", "cycle"))
    return d.select("unit_id", "cycle", "rul", "machine_failure", "failure_mode", "health")


def _l05_sql():
    v, t, a, db, vi, hr = (q(c) for c in ("Vibration RMS [mm/s]", "Bearing Temp [C]", "Spindle Current [A]",
                                           "Acoustic Emission [dB]", "Lubricant Viscosity [cSt]", "Operating Hours [h]"))
    s = clipsql(f"0.35*({v}/8.0) + 0.30*{clipsql(f'({t}-50.0)/45.0', 0.0, 1.2)} + 0.20*({hr}/1200.0) + 0.15*{clipsql(f'(48.0-{vi})/25.0', 0.0, 1.2)}", 0.0, 1.0)
    body = (f"select rk, machine_failure, failure_mode, round_even(case when machine_failure=1 then 1.0 + {hu('rk', 'rul')}*11.0 else (1.0-s)*300.0 end, 1) rul, "
            f"round_even(least(greatest(100.0*(1.0-s), 0.0), 100.0), 1) health from (select rk, {s} s, "
            f"greatest(cast({v}>6.2 and {t}>82.0 as integer), cast({vi}<31.0 and {hr}>650 as integer), cast({a}>26.5 and {db}>88.0 as integer), cast({v}>7.5 and {db}>90.0 as integer)) machine_failure, "
            f"case when {v}>6.2 and {t}>82.0 then 'Bearing Thermal Seizure' when {v}>7.5 and {db}>90.0 then 'Harmonic Resonance' "
            f"when {a}>26.5 and {db}>88.0 then 'Motor Winding Overload' when {vi}<31.0 and {hr}>650 then 'Lubrication Breakdown' else 'No Failure' end failure_mode from plant) p")
    return oracle(["plant"], body)


@register("q_l05_plant_labels", _l05_sql)
def l05(spark, sf):
    return L.plant_labels(fixture(spark, sf, "plant")).select("rk", "machine_failure", "failure_mode", "rul", "health")


def _duck_pred(pred: str) -> str:
    return pred.replace("`", '"')


def _rules_sql(key):
    modes = DOMAIN_SPECS[key]["modes"]
    fail = "greatest(" + ", ".join(f"cast(coalesce({_duck_pred(p)}, false) as integer)" for _, p in modes) + ")"
    mode = "case " + " ".join(f"when coalesce({_duck_pred(p)}, false) then '{n}'" for n, p in reversed(modes)) + " else 'No Failure' end"
    return fail, mode


def _l06_sql():
    parts = []
    for k in DOMAIN_SPECS:
        fail, mode = _rules_sql(k)
        parts.append(f"select '{k}' domain, rk, {fail} machine_failure, {mode} failure_mode from domain_{k}")
    return oracle([f"domain_{k}" for k in DOMAIN_SPECS], "\nunion all\n".join(parts))


def _domain_labelled(spark, sf, k):
    d = fixture(spark, sf, f"domain_{k}")
    return L.rule_set_labels(d, DOMAIN_SPECS[k]["modes"]).withColumn("domain", F.lit(k))


@register("q_l06_rule_labels", _l06_sql)
def l06(spark, sf):
    parts = [_domain_labelled(spark, sf, k).select("domain", "rk", "machine_failure", "failure_mode") for k in DOMAIN_SPECS]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _l07_sql():
    parts = []
    for k, spec in DOMAIN_SPECS.items():
        fail, _ = _rules_sql(k)
        terms = [clipsql(f"abs({q(n)} - {m})/{2.5 * s!r}", 0.0, 1.2) for n, m, s, _, _ in spec["sensors"]]
        st = clipsql("(" + " + ".join(terms) + f")/{float(len(terms))!r}", 0.0, 1.0)
        parts.append(f"select '{k}' domain, rk, round_even(s, 6) stress, round_even(case when f=1 then 1.5 + {hu('rk', 'rul')}*12.5 else (1.0-s)*240.0 end, 1) rul, "
                     f"round_even(least(greatest(100.0*(1.0 - s*0.85 - f*0.45), 0.0), 100.0), 1) health from (select rk, {st} s, {fail} f from domain_{k}) x")
    return oracle([f"domain_{k}" for k in DOMAIN_SPECS], "\nunion all\n".join(parts))


@register("q_l07_domain_stress", _l07_sql)
def l07(spark, sf):
    parts = []
    for k, spec in DOMAIN_SPECS.items():
        d = L.domain_stress_labels(_domain_labelled(spark, sf, k), spec["sensors"])
        parts.append(d.select("domain", "rk", np_round(F.col("stress"), 6).alias("stress"), "rul", "health"))
    return reduce(lambda a, b: a.unionByName(b), parts)


SENS = ["air", "proc", "rpm", "torque", "wear"]


def _l08_sql():
    sel = []
    for c in SENS:
        um, us = hu("rk", f"{c}|m"), hu("rk", f"{c}|s")
        sign = f"case when {hu('rk', c + '|sign')} < 0.5 then -1.0 else 1.0 end"
        mag = f"(4.2 + {hu('rk', c + '|mag')}*1.6)*sd_{c}*{sign}"
        sel.append(f"case when {um} < 0.012 then null when {us} < 0.015 and not ({um} < 0.012) then round_even({c} + {mag}, 2) else {c} end {c}")
    sds = ", ".join(f"case when coalesce(stddev_samp({c}),0) <= 0 then 1.0 else stddev_samp({c}) end sd_{c}" for c in SENS)
    body = f"select rk, {', '.join(sel)} from tel_clean cross join (select {sds} from tel_clean) s"
    return oracle(["tel_clean"], body)


@register("q_l08_degrade", _l08_sql)
def l08(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    return L.degrade(t, SENS).select("rk", *SENS)
