"""Map an unknown table onto the canonical machine-health schema.

Each decision is one small aggregate over the table (distinct counts of candidate
columns, 0/1 membership of every column, moments, min/max, a percentile), so a
mapping costs a fixed number of scans regardless of width; the mapping itself is
a projection.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.exprs import clip, col, np_round

# --- fixed values: candidate names ---
TARGET_CANDIDATES = ["Machine failure", "machine_failure", "failure", "Failure", "target", "Target", "label",
                     "Label", "status", "is_failed"]
RUL_CANDIDATES = ["RUL [min]", "RUL", "rul", "remaining_useful_life", "RUL_cycles"]
STRESS_EXCLUDE = {"Machine failure", "UDI", "unit_id", "TWF", "HDF", "PWF", "OSF", "RNF"}
TARGET, MODE, TIER, RUL, HEALTH = "Machine failure", "Failure Mode", "Type", "RUL [min]", "Health Index [%]"

_SANITIZE = re.compile(r"[\[\]<>/:,\s]+")


def sanitize_name(name: str) -> str:
    """Runs of brackets, angle brackets, slash, colon, comma or whitespace → '_', trimmed of '_'."""
    return _SANITIZE.sub("_", str(name)).strip("_")


def sanitize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[sanitize_name(c) for c in df.columns])


def _is_numeric(dt) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, exclude: set[str] = frozenset()) -> list[str]:
    return [f.name for f in df.schema.fields if _is_numeric(f.dataType) and f.name not in exclude]


def detect_target_by_name(df: DataFrame, max_distinct: int = 5) -> str | None:
    """First candidate present with ≤ 5 distinct non-null values (HLL pre-check, exact count only if small)."""
    present = [c for c in TARGET_CANDIDATES if c in df.columns]
    if not present:
        return None
    approx = df.agg(*[F.approx_count_distinct(col(c)).alias(f"a{i}") for i, c in enumerate(present)]).first()
    small = [c for i, c in enumerate(present) if approx[f"a{i}"] <= 4 * max_distinct]
    exact = {}
    if small:
        r = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(small)]).first()
        exact = {c: r[f"d{i}"] for i, c in enumerate(small)}
    for c in present:
        if c in exact and exact[c] <= max_distinct:
            return c
    return None


def detect_target_by_content(df: DataFrame) -> str | None:
    """First column (schema order) whose non-null values are all in {0, 1} (all-null qualifies)."""
    checks = []
    for f in df.schema.fields:
        c = col(f.name)
        if _is_numeric(f.dataType):
            e = F.coalesce(F.bool_and(c.isNull() | c.isin(0, 1)), F.lit(True))
        elif isinstance(f.dataType, T.BooleanType):
            e = F.lit(True)
        else:
            e = F.coalesce(F.bool_and(c.isNull()), F.lit(True))
        checks.append(e)
    if not checks:
        return None
    r = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks)]).first()
    for i, f in enumerate(df.schema.fields):
        if r[f"c{i}"]:
            return f.name
    return None


def coerce_target(c: str) -> Column:
    """Numeric coercion, non-numeric → 0, cast to int (truncation)."""
    return F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)).cast("int")


def synthesize_target(df: DataFrame, quantile: float = 0.94, exact: bool = True) -> Column | None:
    """Row max |z| over numeric columns ≥ its 94th percentile (z with sample std + 1e-6)."""
    nums = numeric_columns(df)
    if not nums:
        return None
    st = df.agg(*[F.struct(F.avg(col(c)).alias("m"), F.stddev_samp(col(c)).alias("s")).alias(f"s{i}")
                  for i, c in enumerate(nums)]).first()
    zs = []
    for i, c in enumerate(nums):
        m, s = st[f"s{i}"]["m"], st[f"s{i}"]["s"]
        if m is None:
            continue
        sd = (s if s is not None else float("nan")) + 1e-6
        zs.append(F.abs((col(c).cast("double") - F.lit(m)) / F.lit(sd)))
    if not zs:
        return F.lit(0)
    zmax = F.greatest(*zs) if len(zs) > 1 else zs[0]
    if exact:
        from millwright.operators.quantiles import exact_quantiles

        thr = exact_quantiles(df, {"z": zmax}, [quantile])["z"][0]
    else:
        thr = df.agg(F.percentile_approx(zmax, F.lit(quantile), 100_000).alias("t")).first()["t"]
    if thr is None:
        return F.lit(0)
    return F.coalesce((zmax >= F.lit(thr)).cast("int"), F.lit(0))


def stress_rul_health(df: DataFrame, failed: Column) -> tuple[Column, Column]:
    """Mean min–max scaled stress over numeric columns → RUL (5 if failed else (1−s)·200) and Health."""
    nums = numeric_columns(df, STRESS_EXCLUDE)
    if not nums:
        return F.lit(120.0), F.lit(85.0)
    mm = df.agg(*[F.struct(F.min(col(c)).cast("double").alias("lo"), F.max(col(c)).cast("double").alias("hi")).alias(f"r{i}")
                  for i, c in enumerate(nums)]).first()
    parts = []
    for i, c in enumerate(nums):
        lo, hi = mm[f"r{i}"]["lo"], mm[f"r{i}"]["hi"]
        if lo is None:
            continue
        parts.append((col(c).cast("double") - F.lit(lo)) / F.lit(hi - lo + 1e-6))
    if not parts:
        return F.lit(120.0), F.lit(85.0)
    # row mean skipping nulls
    num = sum([F.coalesce(p, F.lit(0.0)) for p in parts[1:]], F.coalesce(parts[0], F.lit(0.0)))
    cnt = sum([p.isNotNull().cast("int") for p in parts[1:]], parts[0].isNotNull().cast("int"))
    s = clip(F.when(cnt > 0, num / cnt), 0.0, 1.0)
    rul = np_round(F.when(failed == 1, F.lit(5.0)).otherwise((F.lit(1.0) - s) * 200.0), 1)
    health = np_round((F.lit(1.0) - s) * 100.0, 1)
    return rul, health


def normalize(df: DataFrame, exact: bool = True) -> tuple[DataFrame, dict]:
    """Detect or synthesize target, mode, tier, RUL and health; returns (table, schema info)."""
    detected = detect_target_by_name(df)
    if detected is None:
        detected = detect_target_by_content(df)
    d = df
    if detected and detected != TARGET:
        d = d.withColumn(TARGET, coerce_target(detected))
    elif TARGET not in d.columns:
        syn = synthesize_target(d, exact=exact)
        d = d.withColumn(TARGET, syn if syn is not None else F.lit(0))
    if MODE not in d.columns:
        d = d.withColumn(MODE, F.when(col(TARGET) == 1, "Detected Anomaly Failure").otherwise("No Failure"))
    if TIER not in d.columns:
        d = d.withColumn(TIER, F.lit("M"))
    found_rul = next((c for c in RUL_CANDIDATES if c in d.columns), None)
    if found_rul and found_rul != RUL:
        d = d.withColumn(RUL, F.coalesce(F.expr(f"try_cast(`{found_rul}` as double)"), F.lit(100.0)))
    elif RUL not in d.columns:
        rul, health = stress_rul_health(d, col(TARGET))
        d = d.withColumns({RUL: rul, HEALTH: health})
    if HEALTH not in d.columns:
        mx = d.agg(F.max(col(RUL)).alias("m")).first()["m"]
        mx = max(float(mx) if mx is not None else 1.0, 1.0)
        d = d.withColumn(HEALTH, np_round(clip(F.lit(100.0) * col(RUL) / mx, 0.0, 100.0), 1))
    return d, {"detected_target": detected or "Synthesized Anomaly Target"}


def schema_info(d: DataFrame, info: dict) -> DataFrame:
    """Row count, failure rate %, detected target — one aggregate."""
    return d.agg(F.count(F.lit(1)).alias("row_count"), np_round(F.avg(col(TARGET)) * 100.0, 2).alias("failure_rate_pct")
                 ).withColumn("detected_target", F.lit(info["detected_target"]))


def sensor_table(df: DataFrame) -> DataFrame:
    """Numeric, non-metadata columns as a (position, column) table."""
    from millwright.operators.features import sensor_columns

    spark = df.sparkSession
    cols = sensor_columns(df)
    return spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "position int, column string")
