"""Summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millwright.functions.exprs import col, np_round

HEALTHY = "No Failure"


def failure_mode_distribution(df: DataFrame, mode: str = "failure_mode") -> DataFrame:
    """Count and % of all rows per non-healthy mode, in value-count order (count desc, then name)."""
    g = df.groupBy(col(mode).alias("mode")).agg(F.count(F.lit(1)).alias("count"))
    tot = g.agg(F.sum("count").alias("__total"))
    d = g.crossJoin(F.broadcast(tot))  # one-row total
    d = d.filter(F.col("mode") != HEALTHY)
    return d.select("mode", "count", np_round(F.col("count") / F.col("__total") * 100.0, 2).alias("pct"))


def top_failure_mode(df: DataFrame, mode: str = "failure_mode") -> str | None:
    r = failure_mode_distribution(df, mode).orderBy(F.col("count").desc(), F.col("mode")).limit(1).collect()
    return r[0]["mode"] if r else None


def dataset_summary(df: DataFrame, label: str = "machine_failure", rul: str = "rul", health: str = "health",
                    split: str | None = "split") -> DataFrame:
    """Totals, split sizes, failures, failure rate %, mean RUL and health (1 dp) — one aggregate."""
    aggs = [F.count(F.lit(1)).alias("total_records")]
    if split:
        aggs += [F.count_if(col(split) == s).alias(f"{s}_records") for s in ("train", "val", "test")]
    aggs += [F.sum(col(label)).cast("long").alias("total_failures"),
             np_round(F.avg(col(label)) * 100.0, 2).alias("failure_rate_pct"),
             np_round(F.avg(col(rul)), 1).alias("avg_rul"), np_round(F.avg(col(health)), 1).alias("avg_health_index")]
    return df.agg(*aggs)


def top_drivers(importance: DataFrame, group: str = "dataset", n: int = 5) -> DataFrame:
    """D3 part: top-n features per dataset by importance share (ties by rank)."""
    w = Window.partitionBy(group).orderBy(F.col("importance_pct").desc(), F.col("rank"))
    return importance.withColumn("driver_rank", F.row_number().over(w)).filter(F.col("driver_rank") <= n)
