"""Registered queries: sampling, splitting, balancing."""

from __future__ import annotations

from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round
from millwright.operators import sampling as B
from millwright.plans.oracles import oracle
from millwright.plans.registry import register
from millwright.sources.fixtures import fixture, hash_uniform_sql


def flagged(spark, sf):
    t = fixture(spark, sf, "tel_flags")
    return t.withColumn("label", F.greatest("twf", "hdf", "pwf", "osf", "rnf"))


LABELLED = "select *, greatest(twf,hdf,pwf,osf,rnf) label from tel_flags"
RANKED = f"select *, row_number() over (partition by label order by md5(rk), rk) r, count(*) over (partition by label) n_c from ({LABELLED}) l"


def _b01_sql(max_rows=8000):
    body = (f"with cnt as (select label, count(*) n_c from ({LABELLED}) l group by label), "
            f"tot as (select sum(n_c) n from cnt), "
            f"ex as (select label, cast({max_rows} as double)*n_c/n e from cnt, tot), "
            f"fl as (select label, e, floor(e) f, e - floor(e) fr from ex), "
            f"rest as (select {max_rows} - sum(f) rest from fl), "
            f"quota as (select label, cast(f as bigint) + case when row_number() over (order by fr desc, cast(label as varchar)) <= (select rest from rest) then 1 else 0 end q from fl) "
            f"select rk, label from ({RANKED}) r join quota using (label) where r <= q")
    return oracle(["tel_flags"], body)


@register("q_b01_stratified_sample", _b01_sql)
def b01(spark, sf):
    return B.stratified_sample(flagged(spark, sf), "label", "rk", 8000).select("rk", "label")


@register("q_b02_stratified_split", oracle(["tel_flags"], f"select rk, label, case when (r-1)*5 < n_c then 'test' when (r-1)*10 < n_c*3 then 'val' else 'train' end split from ({RANKED}) r"))
def b02(spark, sf):
    return B.stratified_split(flagged(spark, sf), "label", "rk").select("rk", "label", "split")


def _b03_sql():
    hu = lambda k, s: hash_uniform_sql(k, "duckdb", s)
    body = (
        "with m as (select vec_id, cast(embedding as double[]) x from minority_vec where minority = 1), "
        "cnt as (select (select count(*) from minority_vec where minority = 1) n_min, (select count(*) from minority_vec where minority <> 1) n_maj), "
        "par as (select n_min, cast(floor(0.38*n_maj - n_min) as bigint) n_new, least(5, n_min - 1) k from cnt), "
        "nn as (select a.vec_id, b.vec_id nn_id, row_number() over (partition by a.vec_id order by round(list_distance(a.x, b.x), 9), b.vec_id) nn_rank "
        "from m a join m b on a.vec_id <> b.vec_id), "
        "base as (select vec_id, x, row_number() over (order by md5(cast(vec_id as varchar)), vec_id) base_no from m), "
        "ids as (select unnest(generate_series(0, n_new - 1)) syn_id from par where n_min >= 6 and n_new > 0), "
        f"syn as (select syn_id, (syn_id % (select n_min from par)) + 1 base_no, cast(floor({hu('syn_id', 'nn')} * (select k from par)) + 1 as integer) nn_rank, "
        f"{hu('syn_id', 'gap')} gap from ids) "
        "select syn_id, base.vec_id base_id, nn.nn_id, round_even(gap, 9) gap, "
        "round_even(list_sum(list_transform(generate_series(1, len(base.x)), lambda i: base.x[i] + gap*(o.x[i] - base.x[i]))), 6) vsum "
        "from syn join base using (base_no) join nn on nn.vec_id = base.vec_id and nn.nn_rank = syn.nn_rank "
        "join m o on o.vec_id = nn.nn_id")
    return oracle(["minority_vec"], body)


@register("q_b03_smote", _b03_sql)
def b03(spark, sf):
    d = fixture(spark, sf, "minority_vec")
    syn, _info = B.smote(d, "minority", "vec_id", "embedding")
    vsum = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return syn.select("syn_id", "base_id", "nn_id", np_round(F.col("gap"), 9).alias("gap"), np_round(vsum, 6).alias("vsum"))


@register("q_b04_class_weights", oracle(["tel_flags"], f"select n, n_pos, n_neg, n/(2.0*n_neg) weight_neg, n/(2.0*n_pos) weight_pos, "
                                                       f"least(4.5, greatest(1.0, n_neg/greatest(n_pos, 1))) dl_pos_weight from "
                                                       f"(select count(*) n, count_if(label=1) n_pos, count(*) - count_if(label=1) n_neg from ({LABELLED}) l) c"))
def b04(spark, sf):
    return B.class_weights(flagged(spark, sf), "label")


PREVIEW_COLS = "rk, tier, air, proc, rpm, torque, wear, label"


@register("q_b05_preview_sample", oracle(["tel_flags"], f"with f as (select {PREVIEW_COLS} from ({LABELLED}) l where label = 1 order by md5(rk), rk limit 7), "
                                                        f"h as (select {PREVIEW_COLS} from ({LABELLED}) l where label = 0 order by md5(rk), rk limit 14 - (select count(*) from f)) "
                                                        f"select * from f union all select * from h"))
def b05(spark, sf):
    d = flagged(spark, sf).select(*[c.strip() for c in PREVIEW_COLS.split(",")])
    return B.preview_sample(d, "label", "rk", 14)


@register("q_b06_explanation_sample", oracle(["tel_flags"], f"select rk, label from ({LABELLED}) l order by md5(rk), rk limit 180"))
def b06(spark, sf):
    return B.explanation_sample(flagged(spark, sf).select("rk", "label"), "rk", 180)
