"""Registered queries: monitoring (T1–T5).  T3–T5 run as Structured Streaming jobs
(file source → availableNow trigger → parquet sink with checkpoint) and read the sink back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators import labels as L
from millwright.operators.features import operating_ranges
from millwright.operators.quality import Cleaner
from millwright.operators.report import failure_mode_distribution
from millwright.plans.oracles import clean_ctes, oracle
from millwright.plans.q_labels import _rules_sql
from millwright.plans.q_quality import _flagship_sql
from millwright.plans.registry import register
from millwright.plans.risk_report import MILLING_SHORT, complete, report_from_clean
from millwright.session import scratch_path
from millwright.sources import fixtures as FX
from millwright.sources.catalog import DOMAIN_SPECS
from millwright.sources.tables import table
from millwright.streaming import monitor as T

SCEN = ["TWF", "HDF", "PWF", "OSF", "RNF", "normal", "other"]


# ------------------------------------------------------------------ T1
def _t01_sql():
    fail, mode = _rules_sql("ims_bearing")
    parts = []
    for s in SCEN:
        if s == "normal":
            c = "greatest(twf,hdf,pwf,osf,rnf) = 0"
        elif s in T.SLOTS:
            c = f"{s.lower()} = 1"
        else:
            c = "greatest(twf,hdf,pwf,osf,rnf) = 1"
        parts.append(f"select 'telemetry' source, '{s}' scenario, count(*) n_rows from tel_flags where {c}")
    ctes = [("dl", f"select *, {fail} machine_failure, {mode} failure_mode from domain_ims_bearing"),
            ("mo", "select failure_mode, row_number() over (order by count(*) desc, failure_mode) - 1 i, count(*) over () n from dl "
                   "where failure_mode <> 'No Failure' group by failure_mode")]
    for s in SCEN:
        if s == "normal":
            c = "machine_failure = 0"
        elif s in T.SLOTS:
            c = f"failure_mode = (select failure_mode from mo where i = {T.SLOTS[s]} % n)"
        else:
            c = "machine_failure = 1"
        parts.append(f"select 'domain', '{s}', count(*) from dl where {c}")
    return FX.oracle(["tel_flags", "domain_ims_bearing"], "\nunion all\n".join(parts), ctes)


@register("q_t01_scenario_selection", _t01_sql)
def t01(spark, sf):
    tf = FX.fixture(spark, sf, "tel_flags").withColumn("machine_failure", F.greatest("twf", "hdf", "pwf", "osf", "rnf"))
    dom = L.rule_set_labels(FX.fixture(spark, sf, "domain_ims_bearing"), DOMAIN_SPECS["ims_bearing"]["modes"])
    order = [r["mode"] for r in failure_mode_distribution(dom).orderBy(F.col("count").desc(), "mode").collect()]
    outs = []
    for name, d, flags in (("telemetry", tf, {"twf", "hdf", "pwf", "osf", "rnf"}), ("domain", dom, set())):
        counts = d.agg(*[F.count_if(T.scenario(s, order, flags)).alias(s) for s in SCEN])       # one pass per table
        outs.append(counts.select(F.explode(F.array(*[F.struct(F.lit(s).alias("scenario"), F.col(s).alias("n_rows")) for s in SCEN])).alias("r"))
                    .select(F.lit(name).alias("source"), "r.scenario", "r.n_rows"))
    return reduce(lambda a, b: a.unionByName(b), outs)


# ------------------------------------------------------------------ T2
S = ["air", "proc", "rpm", "torque", "wear"]


def _t02_sql(k: int = 2):
    rng = "select " + ", ".join(f"round_even(min({c}), 4) mn_{c}, round_even(max({c}), 4) mx_{c}, round_even(stddev_samp({c}), 4) sd_{c}" for c in S) + " from tel_clean"
    sel = []
    for c in S:
        z = FX.hash_normal_sql("concat(rk, '#', cast(replica as varchar))", c, "duckdb")
        e = f"least(greatest({c} + (0.04*sd_{c})*{z}, mn_{c}), mx_{c})"
        sel.append(f"round_even({e}, {0 if c in ('rpm', 'wear') else 2}) {c}")
    body = f"select rk, replica, {', '.join(sel)} from (select *, unnest(generate_series(0, {k - 1})) replica from tel_clean) t cross join ({rng}) r"
    return FX.oracle(["tel_clean"], body)


@register("q_t02_perturbed_replicas", _t02_sql)
def t02(spark, sf):
    t = FX.fixture(spark, sf, "tel_clean")
    rng = {r["sensor"]: r.asDict() for r in operating_ranges(t, S).collect()}
    return T.perturbed_replicas(t, S, rng, 2).select("rk", F.col("replica").cast("bigint").alias("replica"), *S)


# ------------------------------------------------------------------ streams
def _stream_table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    schema = table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 64).parquet(sf)


def _run_to_parquet(df: DataFrame, spark: SparkSession, name: str) -> DataFrame:
    out, ck = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode("append") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)


def _t03_sql():
    full = _flagship_sql()
    # streaming applies the fitted cleaner to every arriving row (no de-duplication state)
    sel = []
    for i, c in enumerate(MILLING_SHORT):
        e = f"least(greatest(coalesce(r.{c}, tm.tm{i}, st.q{i}, 0.0), fe.wl{i}), fe.wh{i})"
        sel.append(f"round_even({e}, {0 if c in ('rpm', 'wear') else 3}) {c}")
    cl_all = (f"select r.rk, r.h, coalesce(r.tier, st.tier_mode) tier, {', '.join(sel)} from tel_raw r cross join st cross join fe "
              f"left join tm on tm.tier = coalesce(r.tier, st.tier_mode)")
    return full.replace("ft as (", f"cl_all as ({cl_all}),\nft as (", 1).replace(" from cl)", " from cl_all)", 1)


@register("q_t03_stream_scoring", _t03_sql)
def t03(spark, sf):
    model = Cleaner(MILLING_SHORT, "tier").fit(FX.fixture(spark, sf, "tel_raw"))
    li = _stream_table(spark, sf, "lineitem")
    tc = spark.sql(FX.view_sql("tel_clean", "spark"), lineitem=li)
    raw = spark.sql(FX.view_sql("tel_raw", "spark"), tel_clean=tc)
    rep = complete(report_from_clean(model.transform(raw)), model.medians)
    return _run_to_parquet(rep, spark, "t03")


def _event_ranges(spark, sf):
    ev = table(spark, sf, "events", ["value"])
    r = operating_ranges(ev, ["value"]).first()
    return {"value": (r["median"], r["std"])}


SCORE_SQL = ("with rg as (select round_even(quantile_cont(value, 0.5), 4) med, round_even(stddev_samp(value), 4) sd from events), "
             "b as (select user_id, event_id, epoch_us(cast(ts as timestamp)) ts_us, least(0.96, greatest(0.02, ((abs(coalesce(value, med) - med)/greatest(sd, 0.001))/1.0 - 0.55)/1.65)) base from events cross join rg), "
             "p as (select *, round_even(least(99.2, greatest(0.8, base*100.0)), 2) fail_prob, round_even(greatest(2.0, (1.0 - base*0.92)*220.0), 1) rul from b), "
             "h as (select *, round_even(least(99.5, greatest(4.0, 100.0 - fail_prob*0.85)), 1) health from p), "
             "sc as (select *, case when fail_prob>=68 or health<=32 then 'CRITICAL' when fail_prob>=36 or health<=60 then 'WARNING' when fail_prob>=18 then 'ADVISORY' else 'OPTIMAL' end severity from h) ")


def _buffers(spark, sf) -> DataFrame:
    rng = _event_ranges(spark, sf)
    ev = T.event_time(_stream_table(spark, sf, "events"))
    scored = T.score_events(ev, rng)
    out = _run_to_parquet(T.stateful_buffers(scored), spark, "t45")
    return T.latest_snapshot(out)


@register("q_t04_rolling_history", SCORE_SQL + "select user_id, cast(back as integer) pos, event_id, fail_prob, health, rul from "
                                               "(select *, row_number() over (partition by user_id order by ts_us desc, event_id desc) back from sc) x where back <= 32")
def t04(spark, sf):
    b = _buffers(spark, sf)
    return b.filter(F.col("kind") == "history").select("user_id", "pos", "event_id", "fail_prob", "health", "rul")


@register("q_t05_alert_feed", SCORE_SQL + "select user_id, cast(pos as integer) pos, event_id, severity, fail_prob, rul from "
                                          "(select s1.*, row_number() over (partition by user_id order by ts_us desc, event_id desc) pos from "
                                          "(select *, row_number() over (partition by user_id order by ts_us, event_id) rn1 from sc) s1 "
                                          "where severity <> 'OPTIMAL' or rn1 = 1) x where pos <= 15")
def t05(spark, sf):
    b = _buffers(spark, sf)
    return b.filter(F.col("kind") == "alert").select("user_id", "pos", "event_id", "severity", "fail_prob", "rul")


def batch_buffers(spark, sf):
    """Batch equivalents of T4 / T5 (used by tests: stream result equals batch)."""
    rng = _event_ranges(spark, sf)
    scored = T.score_events(T.event_time(table(spark, sf, "events")), rng)
    return T.rolling_history(scored), T.alert_feed(scored)
