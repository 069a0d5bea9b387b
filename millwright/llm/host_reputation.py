"""URL filter by empirical-Bayes host reputation (operator 10, native).

Labelled page outcomes (bad or not) are counted per host, registered domain and public
suffix. Each level's beta prior is centred on its parent's shrunk rate, with a strength
fitted to all units of that level by the beta-binomial method of moments, so a host with few
labels leans on its domain, the domain on its suffix, the suffix on the whole corpus. A host
is blocked when the lower posterior bound of its bad rate reaches ``block_at``. Explicit
rules (host and path prefix, longest wins) come first.

Edge cases: a null url, or one without ``://``, has empty host and path, fits no rule and is
judged by the prior alone; null labels count as not labelled; repeated label rows of one
document count once (bad if any is bad); an empty table gives no rows; extra columns of the
input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millwright.llm.common import ascii_lower

#: (verdict, host, path): the host and all its subdomains, paths that start with the path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
Z = 1.645          # one-sided 95 % bound
BLOCK_AT = 0.5     # block when the bad rate is above this with that confidence
WEAKEST, STRONGEST = 1.0, 10_000.0   # range of a prior's strength in pseudo-pages


def url_parts(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    host = ascii_lower(F.regexp_extract(url, r"://([^/?#]*)", 1))
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix): the last two labels and the last label of the host."""
    return F.substring_index(host, ".", -2), F.substring_index(host, ".", -1)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) per labelled page; a page's document is the last number of its url's path."""
    host, path = url_parts(F.col("url"))
    number = F.regexp_extract(path, r"(\d{1,18})[^\d]*$", 1)
    seen = pages.select(host.alias("host"), F.when(number != "", number).cast("bigint").alias("doc_id")).filter("doc_id is not null")
    bad = (F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)
    known = labels.filter("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.max(bad.cast("int")).alias("bad"))
    return seen.join(known, "doc_id").select("host", "bad")


def _strength(units: DataFrame) -> tuple[float, float]:
    """(mean, prior strength) of the beta-binomial over units (n, bad), by moments; one aggregate row."""
    p = F.col("bad") / F.col("n")
    first = units.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("n") * p * p).alias("npp")).first()
    if not first["n"]:
        return 0.0, STRONGEST
    k, n, mean = first["k"], float(first["n"]), first["bad"] / first["n"]
    spread = first["npp"] - n * mean * mean
    var = mean * (1 - mean)
    room = var * (n - first["n2"] / n - (k - 1))
    rho = (spread - var * (k - 1)) / room if room > 0 else 0.0
    return mean, STRONGEST if rho <= 0 else min(STRONGEST, max(WEAKEST, (1 - rho) / rho))


def reputation(hosts: DataFrame, outcomes: DataFrame, z: float = Z) -> DataFrame:
    """Posterior per host: host, n_labelled, n_bad, bad_rate (mean), bad_low (lower bound)."""
    domain, suffix = levels(F.col("host"))
    units = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad")
    units = units.persist()
    by_domain = units.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = units.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    mean, m_suffix = _strength(by_suffix)
    _, m_domain = _strength(by_domain)
    _, m_host = _strength(units)
    units.unpersist()

    def shrunk(prior: Column, m: float, side: str) -> Column:
        n, bad = F.coalesce(F.col(f"{side}_n"), F.lit(0)), F.coalesce(F.col(f"{side}_bad"), F.lit(0))
        return (bad + m * prior) / (n + m)

    names = lambda df, key, side: df.select(key, F.col("n").alias(f"{side}_n"), F.col("bad").alias(f"{side}_bad"))
    rated = (
        hosts.select("host", domain.alias("domain"), suffix.alias("suffix"))
        .join(names(by_suffix, "suffix", "s"), "suffix", "left")
        .join(names(by_domain, "domain", "d"), "domain", "left")
        .join(names(units, "host", "h"), "host", "left")
        .withColumn("mu_s", shrunk(F.lit(mean), m_suffix, "s"))
        .withColumn("mu_d", shrunk(F.col("mu_s"), m_domain, "d"))
        .withColumn("bad_rate", shrunk(F.col("mu_d"), m_host, "h"))
    )
    total = F.coalesce(F.col("h_n"), F.lit(0)) + m_host
    low = F.col("bad_rate") - z * F.sqrt(F.col("bad_rate") * (1 - F.col("bad_rate")) / (total + 1))
    return rated.select("host", F.coalesce("h_n", F.lit(0)).alias("n_labelled"), F.coalesce("h_bad", F.lit(0)).alias("n_bad"), "bad_rate", F.greatest(low, F.lit(0.0)).alias("bad_low"))


def host_rules(spark: SparkSession, hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(host, rules): the rules whose host is the url's host or a parent domain of it."""
    listed = spark.createDataFrame([(h + p, v, h, p) for v, h, p in rules], "rule string, verdict string, rule_host string, path string")
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return hosts.select("host", F.explode(parents).alias("rule_host")).join(listed, "rule_host").groupBy("host").agg(F.collect_list(F.struct(F.length("rule").alias("size"), "rule", "verdict", "path")).alias("rules"))


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, block_at: float = BLOCK_AT, z: float = Z) -> DataFrame:
    """page_id, host, path, rule, verdict, n_labelled, n_bad, bad_rate, bad_low for every row of ``pages``."""
    host, path = url_parts(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = urls.select("host").distinct()
    per_host = reputation(hosts, page_outcomes(pages, labels), z).join(host_rules(pages.sparkSession, hosts, rules), "host", "left")
    fits = F.filter(F.coalesce("rules", F.array()), lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(fits)
    return (
        urls.join(per_host, "host", "left").withColumn("best", best)
        .select("page_id", "host", "path", F.col("best.rule").alias("rule"),
                F.coalesce(F.col("best.verdict"), F.when(F.col("bad_low") >= block_at, "block").otherwise("allow")).alias("verdict"),
                "n_labelled", "n_bad", "bad_rate", "bad_low")
    )
