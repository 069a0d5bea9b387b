"""Registered queries: schema normalization of unknown tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from millwright.functions.exprs import col
from millwright.operators import labels as L
from millwright.operators import normalize as N
from millwright.plans.oracles import oracle, q
from millwright.plans.registry import register
from millwright.sources.catalog import DOMAIN_SPECS
from millwright.sources.fixtures import fixture
from millwright.sources.tables import table

TGT, RUL, HEALTH = '"Machine failure"', '"RUL [min]"', '"Health Index [%]"'


def _orders(spark, sf):
    return table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "status")


def _tel_renamed(spark, sf):
    t = fixture(spark, sf, "tel_clean")
    d = L.milling_degradation(L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0))
    return d.select("rk", "air", "proc", "rpm", "torque", "wear", F.col("twf").alias("failure"), "rul")


def _stress_sql(src: str, nums: list[str], tgt: str = TGT) -> str:
    parts = [f"({q(c)} - (select min({q(c)}) from {src}))/((select max({q(c)}) from {src}) - (select min({q(c)}) from {src}) + 1e-6)" for c in nums]
    s = f"least(greatest(({' + '.join(parts)})/{len(parts)}, 0.0), 1.0)"
    return (f"round_even(case when {tgt} = 1 then 5.0 else (1.0 - {s})*200.0 end, 1) {RUL}, "
            f"round_even((1.0 - {s})*100.0, 1) {HEALTH}")


def _synth_sql(src: str, nums: list[str]) -> str:
    zs = [f"abs(({q(c)} - (select avg({q(c)}) from {src}))/((select stddev_samp({q(c)}) from {src}) + 1e-6))" for c in nums]
    z = f"greatest({', '.join(zs)})" if len(zs) > 1 else zs[0]
    return f"select *, coalesce(cast(zmax >= (select quantile_cont(zmax, 0.94) from (select {z} zmax from {src}) x) as integer), 0) {TGT} from (select *, {z} zmax from {src}) y"


# ------------------------------------------------------------------ N1 + N3 + N5/N6 + N8 on orders
ORD_SQL = ("with src as (select o_orderkey, o_custkey, o_orderstatus status, o_totalprice, o_orderdate, o_orderpriority from orders), "
           f"t as (select *, cast(coalesce(try_cast(status as double), 0.0) as integer) {TGT} from src) "
           f"select o_orderkey, {TGT}, case when {TGT} = 1 then 'Detected Anomaly Failure' else 'No Failure' end \"Failure Mode\", 'M' \"Type\", "
           + _stress_sql("t", ["o_orderkey", "o_custkey", "o_totalprice"]) + " from t")


@register("q_n01_target_by_name", ORD_SQL)
def n01(spark, sf):
    d, _ = N.normalize(_orders(spark, sf))
    return d.select("o_orderkey", col(N.TARGET), col(N.MODE), col(N.TIER), col(N.RUL), col(N.HEALTH))


# ------------------------------------------------------------------ N2 on labels
LAB_SQL = (f"with t as (select *, cast(coalesce(try_cast(quality as double), 0.0) as integer) {TGT} from labels) "
           f"select doc_id, {TGT}, " + _stress_sql("t", ["doc_id", "quality", "toxic"]) + " from t")


@register("q_n02_target_by_content", LAB_SQL)
def n02(spark, sf):
    d, _ = N.normalize(table(spark, sf, "labels"))
    return d.select("doc_id", col(N.TARGET), col(N.RUL), col(N.HEALTH))


# ------------------------------------------------------------------ N4 on part, N8 on supplier
def _part_sql():
    # the stress set is the numeric columns of the table (the synthesized score is not a column of it)
    return (f"with t as ({_synth_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])}) "
            f"select p_partkey, {TGT}, case when {TGT} = 1 then 'Detected Anomaly Failure' else 'No Failure' end \"Failure Mode\", "
            + _stress_sql("t", ["p_partkey", "p_size", "p_retailprice"]) + " from t")


@register("q_n04_synthesized_target", _part_sql)
def n04(spark, sf):
    d, _ = N.normalize(table(spark, sf, "part"))
    return d.select("p_partkey", col(N.TARGET), col(N.MODE), col(N.RUL), col(N.HEALTH))


def _supp_sql():
    return (f"with t as ({_synth_sql('supplier', ['s_suppkey', 's_nationkey', 's_acctbal'])}) "
            f"select s_suppkey, {TGT}, " + _stress_sql("t", ["s_suppkey", "s_nationkey", "s_acctbal"]) + " from t")


@register("q_n08_stress_rul_health", _supp_sql)
def n08(spark, sf):
    d, _ = N.normalize(table(spark, sf, "supplier"))
    return d.select("s_suppkey", col(N.TARGET), col(N.RUL), col(N.HEALTH))


# ------------------------------------------------------------------ N7 + N9 on renamed telemetry
def _tel_sql():
    from millwright.plans.q_scoring import _l03_ctes

    ctes = _l03_ctes() + [("tr", "select rk, air, proc, rpm, torque, wear, twf failure, rul from lb"),
                          ("t", f"select *, cast(coalesce(try_cast(failure as double), 0.0) as integer) {TGT}, coalesce(try_cast(rul as double), 100.0) {RUL} from tr")]
    return oracle(["tel_clean"], f"select rk, {TGT}, {RUL}, round_even(least(greatest(100.0*{RUL}/greatest((select max({RUL}) from t), 1.0), 0.0), 100.0), 1) {HEALTH} from t", ctes)


@register("q_n07_rul_alias_health", _tel_sql)
def n07(spark, sf):
    d, _ = N.normalize(_tel_renamed(spark, sf))
    return d.select("rk", col(N.TARGET), col(N.RUL), col(N.HEALTH))


# ------------------------------------------------------------------ N10 schema info over all inputs
def _info_sql():
    from millwright.plans.q_scoring import _l03_ctes

    ctes = _l03_ctes()
    parts = [
        f"select 'orders' source, count(*) row_count, round_even(avg(cast(coalesce(try_cast(o_orderstatus as double), 0.0) as integer))*100.0, 2) failure_rate_pct, 'status' detected_target from orders",
        f"select 'labels', count(*), round_even(avg(quality)*100.0, 2), 'quality' from labels",
        f"select 'part', count(*), round_even(avg({TGT})*100.0, 2), 'Synthesized Anomaly Target' from ({_synth_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])}) a",
        f"select 'supplier', count(*), round_even(avg({TGT})*100.0, 2), 'Synthesized Anomaly Target' from ({_synth_sql('supplier', ['s_suppkey', 's_nationkey', 's_acctbal'])}) b",
        f"select 'customer', count(*), round_even(avg({TGT})*100.0, 2), 'Synthesized Anomaly Target' from ({_synth_sql('customer', ['c_custkey', 'c_nationkey', 'c_acctbal'])}) c",
        "select 'telemetry', count(*), round_even(avg(twf)*100.0, 2), 'failure' from lb",
    ]
    return oracle(["tel_clean"], "\nunion all\n".join(parts), ctes)


@register("q_n10_schema_info", _info_sql)
def n10(spark, sf):
    srcs = [("orders", _orders(spark, sf)), ("labels", table(spark, sf, "labels")), ("part", table(spark, sf, "part")),
            ("supplier", table(spark, sf, "supplier")), ("customer", table(spark, sf, "customer")),
            ("telemetry", _tel_renamed(spark, sf))]
    outs = []
    for name, df in srcs:
        d, info = N.normalize(df)
        outs.append(N.schema_info(d, info).select(F.lit(name).alias("source"), "row_count", "failure_rate_pct", "detected_target"))
    return reduce(lambda a, b: a.unionByName(b), outs)


# ------------------------------------------------------------------ N11 sensor selection, N12 sanitizing
@register("q_n11_sensor_columns", oracle([], "select 0 position, 'p_partkey' \"column\", count(p_partkey) n_values from part union all "
                                             "select 1, 'p_size', count(p_size) from part union all select 2, 'p_retailprice', count(p_retailprice) from part"))
def n11(spark, sf):
    d, _ = N.normalize(table(spark, sf, "part"))
    cols = [r["column"] for r in N.sensor_table(d).orderBy("position").collect()]
    counts = d.agg(*[F.count(col(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    rows = [(i, c, counts[f"n{i}"]) for i, c in enumerate(cols)]
    return spark.createDataFrame(rows, "position int, column string, n_values long")


def _n12_sql():
    key = "domain_ims_bearing"
    cols = ["rk", "h", "tier"] + [s[0] for s in DOMAIN_SPECS["ims_bearing"]["sensors"]]
    sel = ", ".join(f"{q(c)} as {q(N.sanitize_name(c))}" for c in cols)
    return oracle([key], f"select {sel} from {key}")


@register("q_n12_sanitized_table", _n12_sql)
def n12(spark, sf):
    return N.sanitize_columns(fixture(spark, sf, "domain_ims_bearing"))
