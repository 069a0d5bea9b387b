"""The registered queries of the corpus operators, and their DuckDB oracles where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm import collocations, decontam, host_reputation, line_dedup, mixing, packing, quality_gam, simhash, spelling, suffix_dedup, template_html, toxicity, winnow
from millwright.llm.common import ASCII_LOWER, ASCII_UPPER, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").alias("n_items"), F.col("hits.item_id").alias("item_ids"), F.array_min("hits.distance").alias("least_distance"))


@_query
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.deduplicate(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.summary(table(spark, sf_dir, "documents"))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


@_query
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict", "n_labelled", "n_bad")


@_query
def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", winnow.digest(F.col("chosen")).alias("fingerprint"), winnow.digest(F.col("edited_chosen")).alias("edited_fingerprint"), "near_edited", "near_next")


@_query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = template_html.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@_query
def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.sequences(table(spark, sf_dir, "documents"))


@_query
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


@_query
def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents")).select("word", "n", "n_near", "form", "form_n", "root")


def _url_sql() -> str:
    """DuckDB statement of op10: url parts, rules (longest wins), beta-binomial shrinkage and posterior bound."""
    h = host_reputation
    upper, lower = ASCII_UPPER, ASCII_LOWER
    fits = [f"case when (host = '{r}' or host like '%.{r}') and starts_with(path, '{p}') then {{'n': {len(r + p)}, 'rule': '{r}{p}', 'verdict': '{v}'}} end" for v, r, p in h.RULES]
    strength = lambda t: (
        f"select bad_all/n_all mean, case when n_all is null then {h.STRONGEST} when room <= 0 or (spread - var*(k-1))/room <= 0 then {h.STRONGEST} "
        f"else least({h.STRONGEST}, greatest({h.WEAKEST}, (1 - (spread - var*(k-1))/room) / ((spread - var*(k-1))/room))) end m from "
        f"(select *, npp - n_all*(bad_all/n_all)*(bad_all/n_all) spread, (bad_all/n_all)*(1 - bad_all/n_all) var, (bad_all/n_all)*(1 - bad_all/n_all)*(n_all - n2/n_all - (k-1)) room from "
        f"(select count(*) k, cast(sum(n) as double) n_all, cast(sum(bad) as double) bad_all, cast(sum(n*n) as double) n2, sum(n*(bad/n)*(bad/n)) npp from {t}) a) b")
    shrunk = lambda prior, m, t: f"(coalesce({t}.bad, 0) + {m}*{prior}) / (coalesce({t}.n, 0) + {m})"
    return f"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{upper}', '{lower}') host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) path from pages),
l as (select doc_id, max(cast(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1 as integer)) bad from labels
      where doc_id is not null and (quality is not null or toxic is not null) group by 1),
o as (select host, bad from (select host, try_cast(regexp_extract(path, '(\\d{{1,18}})[^\\d]*$', 1) as bigint) doc_id from u) p join l using (doc_id)),
dm as (select host, regexp_extract(host, '([^.]*[.])?[^.]*$') domain, regexp_extract(host, '[^.]*$') suffix from (select distinct host from u) a),
uh as (select host, domain, suffix, count(*) n, sum(bad) bad from o join dm using (host) group by all),
ud as (select domain, suffix, sum(n) n, sum(bad) bad from uh group by all),
us as (select suffix, sum(n) n, sum(bad) bad from uh group by all),
ms as ({strength('us')}), md as ({strength('ud')}), mh as ({strength('uh')}),
r1 as (select dm.*, coalesce(ms.mean, 0.0) mean, {shrunk('coalesce(ms.mean, 0.0)', 'ms.m', 'us')} mu_s from dm cross join ms left join us using (suffix)),
r2 as (select r1.*, {shrunk('mu_s', 'md.m', 'ud')} mu_d from r1 cross join md left join ud on ud.domain = r1.domain),
r3 as (select r2.host, coalesce(uh.n, 0) n_labelled, coalesce(uh.bad, 0) n_bad, mh.m, {shrunk('mu_d', 'mh.m', 'uh')} rate from r2 cross join mh left join uh on uh.host = r2.host),
f as (select u.*, list_sort(list_filter([{', '.join(fits)}], lambda x: x is not null), 'DESC')[1] best from u)
select f.page_id, f.host, f.path, best.rule as rule,
       coalesce(best.verdict, case when greatest(rate - {h.Z}*sqrt(rate*(1 - rate)/(n_labelled + m + 1)), 0.0) >= {h.BLOCK_AT} then 'block' else 'allow' end) verdict,
       cast(n_labelled as bigint) n_labelled, cast(n_bad as bigint) n_bad
from f join r3 using (host)"""


ORACLES["op10_url_filter"] = _url_sql()
