"""Monitoring on Structured Streaming.

* T1 scenario selection and T2 perturbed replicas are stateless projections /
  filters (batch or stream).
* T3 continuous scoring: ``readStream`` (file source) → fitted cleaner literals →
  features → closed-form risk → severity → sink.  No shuffle, no state.
* T4 / T5 keep, per unit, the last 32 scored points and the last 15 alerts.  On a
  stream this is ``applyInPandasWithState`` with bounded, typed state (32 + 15 + 1
  points per key) kept in event order, so rows may come late by any time; the batch equivalent is a per-unit ``row_number`` limit, which
  Spark plans as a map-side group limit before the shuffle, so a hot unit never
  ships more than 32 rows per input partition.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from millwright.functions.exprs import clip, col, lower_name_rounds_to_int, md5_normal, np_round
from millwright.operators.scoring import generic_risk

HISTORY = 32
ALERTS = 15
SLOTS = {"TWF": 0, "HDF": 1, "PWF": 2, "OSF": 3, "RNF": 4}


# ----------------------------------------------------------------------------- T1
def scenario(name: str, mode_order: list[str], flag_cols: set[str], label: str = "machine_failure", mode: str = "failure_mode") -> Column:
    """The rows a scenario draws from: a named fault flag; else the mode at the slot index (D1 order);
    else any failure; 'normal' = healthy rows.  ``mode_order`` is D1's non-healthy modes (small)."""
    s = name.upper()
    if name == "normal":
        return col(label) == 0
    if s in SLOTS and s.lower() in flag_cols:
        return col(s.lower()) == 1
    if s in SLOTS and mode_order:
        return col(mode) == F.lit(mode_order[SLOTS[s] % len(mode_order)])
    return col(label) == 1


def scenario_rows(df: DataFrame, name: str, mode_order: list[str], flag_cols: set[str], label: str = "machine_failure", mode: str = "failure_mode") -> DataFrame:
    return df.filter(scenario(name, mode_order, flag_cols, label, mode))


# ----------------------------------------------------------------------------- T2
def perturbed_replicas(df: DataFrame, sensors: list[str], ranges: dict[str, dict], k: int, key: str = "rk") -> DataFrame:
    """K replicas per row: v + 0.04·std·N(0,1) (hash-normal on key#replica), clamped to [min, max],
    rounded by name (integer for rpm/wear/cycle/hours, else 2 dp)."""
    d = df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    # in steps of named columns: the draw names the md5 four times and ``clip`` the value twice, so written out
    # in one expression a row would work eight md5s out per sensor
    rkey = F.concat(col(key).cast("string"), F.lit("#"), F.col("replica").cast("string"))
    d = d.withColumns({f"__md5_{i}": F.md5(F.concat(rkey, F.lit("|"), F.lit(c))) for i, c in enumerate(sensors)})
    d = d.withColumns({f"__v_{i}": col(c) + F.lit(0.04 * ranges[c]["std"]) * md5_normal(F.col(f"__md5_{i}")) for i, c in enumerate(sensors)})
    d = d.withColumns({f"__v_{i}": clip(f"__v_{i}", ranges[c]["min"], ranges[c]["max"]) for i, c in enumerate(sensors)})
    d = d.withColumns({c: np_round(f"__v_{i}", 0 if lower_name_rounds_to_int(c) else 2) for i, c in enumerate(sensors)})
    return d.drop(*[f"__md5_{i}" for i in range(len(sensors))], *[f"__v_{i}" for i in range(len(sensors))])


# ----------------------------------------------------------------------------- scoring used by T3–T5
def score_events(df: DataFrame, ranges: dict[str, tuple[float, float]], sensors: list[str] = ("value",),
                 top_mode: str | None = None) -> DataFrame:
    """Closed-form generic scoring of telemetry events: risk %, health, RUL, severity."""
    d = generic_risk(df, list(sensors), ranges, top_mode)
    p = np_round(F.least(F.lit(99.2), F.greatest(F.lit(0.8), F.col("base_risk") * 100.0)), 2)
    d = d.withColumn("fail_prob", p)
    d = d.withColumns({
        "health": np_round(F.least(F.lit(99.5), F.greatest(F.lit(4.0), F.lit(100.0) - F.col("fail_prob") * 0.85)), 1),
        "rul": np_round(F.greatest(F.lit(2.0), (F.lit(1.0) - F.col("base_risk") * 0.92) * 220.0), 1),
    })
    fp, h = F.col("fail_prob"), F.col("health")
    return d.withColumn("severity", F.when((fp >= 68) | (h <= 32), "CRITICAL").when((fp >= 36) | (h <= 60), "WARNING")
                        .when(fp >= 18, "ADVISORY").otherwise("OPTIMAL"))


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Parquet timestamps read as TIMESTAMP_NTZ; cast to TIMESTAMP (session zone) and keep micros for ordering."""
    return df.withColumn("ts_us", F.unix_micros(col(ts).cast("timestamp")))


# ----------------------------------------------------------------------------- T4 / T5 batch
def rolling_history(scored: DataFrame, unit: str = "user_id", n: int = HISTORY) -> DataFrame:
    """T4 batch: last n points per unit (newest = pos n ... oldest)."""
    w = Window.partitionBy(unit).orderBy(F.col("ts_us").desc(), F.col("event_id").desc())
    d = scored.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return d.select(col(unit), "back", "event_id", "fail_prob", "health", "rul")


def alert_feed(scored: DataFrame, unit: str = "user_id", n: int = ALERTS) -> DataFrame:
    """T5 batch: non-OPTIMAL events plus each unit's first event; newest 15 per unit, newest first."""
    first = scored.groupBy(col(unit).alias("__u")).agg(F.min(F.struct("ts_us", "event_id")).alias("__f"))
    d = scored.join(first, col(unit) == F.col("__u"))
    is_first = (F.col("ts_us") == F.col("__f.ts_us")) & (F.col("event_id") == F.col("__f.event_id"))
    d = d.filter((F.col("severity") != "OPTIMAL") | is_first).drop("__u", "__f")
    w = Window.partitionBy(unit).orderBy(F.col("ts_us").desc(), F.col("event_id").desc())
    d = d.withColumn("feed_pos", F.row_number().over(w)).filter(F.col("feed_pos") <= n)
    return d.select(col(unit), "feed_pos", "event_id", "severity", "fail_prob", "rul")


# ----------------------------------------------------------------------------- T4 / T5 stream
_POINT = "struct<ts_us:bigint,event_id:bigint,severity:string,fail_prob:double,health:double,rul:double>"
#: last points, last non-OPTIMAL points and the first point, all in event order; version counts the unit's batches
STATE_SCHEMA = f"hist array<{_POINT}>, alerts array<{_POINT}>, first array<{_POINT}>, version bigint"
OUT_SCHEMA = T.StructType([
    T.StructField("user_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("pos", T.IntegerType()),
    T.StructField("event_id", T.LongType()), T.StructField("severity", T.StringType()),
    T.StructField("fail_prob", T.DoubleType()), T.StructField("health", T.DoubleType()), T.StructField("rul", T.DoubleType()),
    T.StructField("version", T.LongType()),
])


def _update_buffers(key, pdfs, state):
    """Per unit: merge new points into bounded buffers in (ts, event_id) order, however late they come; emit the buffers."""
    hist, alerts, first, version = ([tuple(p) for p in x] if isinstance(x, (list, tuple)) else x for x in (state.get if state.exists else ([], [], [], 0)))
    for pdf in pdfs:                                   # one Arrow batch at a time
        new = sorted(zip(pdf["ts_us"].tolist(), pdf["event_id"].tolist(), pdf["severity"].tolist(), pdf["fail_prob"].tolist(), pdf["health"].tolist(), pdf["rul"].tolist(), strict=True))
        hist = sorted(hist + new)[-HISTORY:]
        alerts = sorted(alerts + [p for p in new if p[2] != "OPTIMAL"])[-ALERTS:]
        first = sorted(first + new[:1])[:1]
    version += 1
    state.update((hist, alerts, first, version))
    feed = sorted(alerts + [p for p in first if p[2] == "OPTIMAL"])[-ALERTS:]
    uid = int(key[0])
    rows = [(uid, kind, len(points) - i, *p[1:], version) for kind, points in (("history", hist), ("alert", feed)) for i, p in enumerate(points)]
    yield pd.DataFrame(rows, columns=[f.name for f in OUT_SCHEMA.fields])


def stateful_buffers(scored_stream: DataFrame, unit: str = "user_id") -> DataFrame:
    """T4 + T5 on a stream: bounded per-unit state via ``applyInPandasWithState``."""
    s = scored_stream.select(col(unit).cast("long").alias("user_id"), "ts_us", "event_id", "severity", "fail_prob", "health", "rul")
    return s.groupBy("user_id").applyInPandasWithState(
        _update_buffers, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def latest_snapshot(out: DataFrame) -> DataFrame:
    """Keep each unit's most recent emitted buffers (the version counts a unit's batches, so it never repeats)."""
    v = out.groupBy("user_id").agg(F.max("version").alias("__v"))
    return out.join(v, "user_id").filter(F.col("version") == F.col("__v")).drop("__v", "version")
