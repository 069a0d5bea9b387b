"""Registered queries: sources and sinks (S1–S6, S8) and the cross-dataset report (D3)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.functions.exprs import col, np_round
from millwright.operators import explain as X
from millwright.operators import labels as L
from millwright.operators import normalize as N
from millwright.operators.quality import Cleaner, drop_exact_duplicates
from millwright.operators.report import top_drivers
from millwright.plans.oracles import clean_ctes, oracle
from millwright.plans.q_labels import _rules_sql
from millwright.plans.registry import register
from millwright.plans.risk_report import MILLING_SHORT
from millwright.session import scratch_path
from millwright.sources import io as IO
from millwright.sources.catalog import CATALOG, DOMAIN_SPECS, PLANT_SENSORS, catalog_df
from millwright.sources.fixtures import fixture
from millwright.sources.tables import table


@register("q_s01_csv_roundtrip", oracle(["tel_raw"], "select * from tel_raw"))
def s01(spark, sf):
    raw = fixture(spark, sf, "tel_raw")
    path = IO.write_csv(raw, scratch_path(spark, "s01-csv"))
    return IO.read_csv(spark, path, raw.schema)


def _s03_sql():
    from millwright.plans.q_normalize import _stress_sql, _synth_sql

    return (f"with t as ({_synth_sql('part', ['p_partkey', 'p_size', 'p_retailprice'])}) "
            f"select p_partkey, \"Machine failure\", " + _stress_sql("t", ["p_partkey", "p_size", "p_retailprice"]) + " from t")


@register("q_s03_custom_csv", _s03_sql)
def s03(spark, sf):
    folder = scratch_path(spark, "s03-drop-in")
    IO.write_csv(table(spark, sf, "part"), f"{folder}/plant_upload.csv")
    d, _ = N.normalize(IO.load_custom(spark, "plant_upload", folder))
    return d.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), col(N.TARGET), col(N.RUL), col(N.HEALTH))


@register("q_s03_malformed_csv", "select count_if(not short and not long) n_good, count_if(short or long) n_rejected, cast(sum(case when short or long then 0 else p_size end) as bigint) sum_size, "
          "round_even(cast(sum(case when short or long then 0 else p_retailprice end) as double), 2) sum_price, count_if(not short and not long and p_partkey % 13 = 0) n_empty, "
          "'p_partkey bigint, p_size bigint, p_retailprice double, note string' types "
          "from (select *, p_partkey % 97 = 0 short, p_partkey % 97 = 5 long from part) p")
def s03_malformed(spark, sf):
    """S3: a drop-in file with ragged lines: its good rows typed by whole columns, its other lines counted as rejects."""
    p = table(spark, sf, "part")
    note = F.when(F.col("p_partkey") % 13 == 0, "").otherwise(F.concat(F.lit("part "), F.col("p_partkey").cast("string")))
    fields = [F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_retailprice").cast("string"), note]
    full = F.concat_ws(",", *fields)
    line = F.when(F.col("p_partkey") % 97 == 0, F.concat_ws(",", *fields[:2])).when(F.col("p_partkey") % 97 == 5, F.concat(full, F.lit(",left over"))).otherwise(full)
    folder = scratch_path(spark, "s03-ragged")
    # every part file starts with the header: a first line of two
    header = F.lit("p_partkey,p_size,p_retailprice,note")
    first = F.row_number().over(Window.partitionBy("_file").orderBy("p_partkey")) == 1
    rows = p.withColumn("_file", F.pmod(F.xxhash64("p_partkey"), F.lit(8))).repartition(8, "_file")
    rows.select(F.when(first, F.concat(header, F.lit("\n"), line)).otherwise(line).alias("value"), "_file").write.partitionBy("_file").text(f"{folder}/ragged.csv")
    good, rejects = IO.load_custom_checked(spark, "ragged", folder)
    good = good.drop("_file")
    types = ", ".join(f"{n} {t}" for n, t in good.dtypes)
    sums = good.agg(F.count(F.lit(1)).alias("n_good"), F.sum("p_size").alias("sum_size"), np_round(F.sum("p_retailprice"), 2).alias("sum_price"), F.count_if(F.col("note").isNull()).alias("n_empty"))
    return sums.crossJoin(rejects.agg(F.count(F.lit(1)).alias("n_rejected"))).withColumn("types", F.lit(types))


@register("q_s02_catalog", "select * from (values " + ", ".join(
    f"({i + 1}, '{k}', '{t.replace(chr(39), chr(39) * 2)}', '{f}', '{d.replace(chr(39), chr(39) * 2)}', {len(DOMAIN_SPECS.get(k, {}).get('modes', []))}, "
    f"{len(DOMAIN_SPECS[k]['sensors']) if k in DOMAIN_SPECS else {'ai4i2020': 5, 'cmapss': 16, 'custom_plant': 6}[k]})" for i, (k, t, f, d) in enumerate(CATALOG)) + ") t(position, key, title, filename, domain, n_rules, n_sensors)")
def s02(spark, sf):
    """The catalogue as a table."""
    return catalog_df(spark)


GATE_TABLES = ["region", "nation", "supplier", "benchmark", "labels", "orders"]


@register("q_s04_upload_gate", oracle([], "\nunion all\n".join(
    f"select '{t}' source, (select count(*) from (select 1 from {t} limit 30) x) >= 30 accepted" for t in GATE_TABLES)))
def s04(spark, sf):
    rows = [(t, IO.upload_gate(table(spark, sf, t))) for t in GATE_TABLES]
    return spark.createDataFrame(rows, "source string, accepted boolean")


@register("q_s05_export_cleaned", lambda: oracle(["tel_raw"], "select * from cl", clean_ctes("tel_raw", MILLING_SHORT, ["rk", "h"])))
def s05(spark, sf):
    raw = fixture(spark, sf, "tel_raw")
    m, work = Cleaner(MILLING_SHORT, "tier").fit_dedup(raw)
    clean = m.transform(work)
    csv = IO.write_csv(clean, scratch_path(spark, "s05-csv"))
    IO.write_parquet(clean, scratch_path(spark, "s05-parquet"))
    return IO.read_csv(spark, csv, clean.schema)


# ------------------------------------------------------------------ S8 + S6: all catalogued datasets
def labelled_datasets(spark, sf):
    """(key, labelled DataFrame with machine_failure / failure_mode / health) for every catalogued set."""
    out = []
    t = fixture(spark, sf, "tel_clean")
    mill = L.milling_degradation(L.milling_flags(t, F.lit(200) + F.col("h") % 41, F.col("h") % 997 == 0))
    out.append(("ai4i2020", mill))
    uc = fixture(spark, sf, "unit_cycles")
    out.append(("cmapss", L.run_to_failure_labels(uc)))
    out.append(("custom_plant", L.plant_labels(fixture(spark, sf, "plant"))))
    for k, spec in DOMAIN_SPECS.items():
        d = L.rule_set_labels(fixture(spark, sf, f"domain_{k}"), spec["modes"])
        out.append((k, L.domain_stress_labels(d, spec["sensors"])))
    return out


def _summary(key, d):
    title = {k: (t, dom) for k, t, _, dom in CATALOG}[key]
    return d.agg(F.count(F.lit(1)).alias("total_records"), F.sum("machine_failure").cast("long").alias("total_failures"),
                 np_round(F.avg("machine_failure") * 100.0, 2).alias("failure_rate_pct"),
                 np_round(F.avg("health"), 1).alias("avg_health_index")).select(
        F.lit(key).alias("dataset"), F.lit(title[0]).alias("title"), F.lit(title[1]).alias("domain"), "*")


def _s08_sql():
    from millwright.plans.q_scoring import _l03_ctes

    titles = {k: (t, dom) for k, t, _, dom in CATALOG}
    esc = lambda s: s.replace("'", "''")
    parts = []
    ctes = _l03_ctes()
    parts.append(("ai4i2020", "select machine_failure, health from lb"))
    parts.append(("cmapss", "select cast(max_cycle - cycle <= 30 as integer) machine_failure, round_even(least(greatest(100.0*(1.0 - least(greatest(pow(cycle/max_cycle, 2.4), 0.0), 1.35)/1.15), 0.0), 100.0), 1) health from unit_cycles"))
    from millwright.plans.q_labels import _l05_sql, _l07_sql  # noqa: F401
    v, tt, vi, hr = '"Vibration RMS [mm/s]"', '"Bearing Temp [C]"', '"Lubricant Viscosity [cSt]"', '"Operating Hours [h]"'
    a, db = '"Spindle Current [A]"', '"Acoustic Emission [dB]"'
    s = (f"least(greatest(0.35*({v}/8.0) + 0.30*least(greatest(({tt}-50.0)/45.0, 0.0), 1.2) + 0.20*({hr}/1200.0) + "
         f"0.15*least(greatest((48.0-{vi})/25.0, 0.0), 1.2), 0.0), 1.0)")
    parts.append(("custom_plant", f"select greatest(cast({v}>6.2 and {tt}>82.0 as integer), cast({vi}<31.0 and {hr}>650 as integer), cast({a}>26.5 and {db}>88.0 as integer), "
                                  f"cast({v}>7.5 and {db}>90.0 as integer)) machine_failure, round_even(least(greatest(100.0*(1.0-{s}), 0.0), 100.0), 1) health from plant"))
    for k, spec in DOMAIN_SPECS.items():
        fail, _ = _rules_sql(k)
        terms = [f"least(greatest(abs(\"{n}\" - {m})/{2.5 * sd!r}, 0.0), 1.2)" for n, m, sd, _, _ in spec["sensors"]]
        st = f"least(greatest(({' + '.join(terms)})/{float(len(terms))!r}, 0.0), 1.0)"
        parts.append((k, f"select f machine_failure, round_even(least(greatest(100.0*(1.0 - s*0.85 - f*0.45), 0.0), 100.0), 1) health from (select {st} s, {fail} f from domain_{k}) x"))
    body = "\nunion all\n".join(
        f"select '{k}' dataset, '{esc(titles[k][0])}' title, '{esc(titles[k][1])}' domain, count(*) total_records, cast(sum(machine_failure) as bigint) total_failures, "
        f"round_even(avg(machine_failure)*100.0, 2) failure_rate_pct, round_even(avg(health), 1) avg_health_index from ({q}) z" for k, q in parts)
    views = ["tel_clean", "unit_cycles", "plant"] + [f"domain_{k}" for k in DOMAIN_SPECS]
    return oracle(views, body, ctes)


@register("q_s08_multi_dataset", _s08_sql)
def s08(spark, sf):
    return IO.union_all([_summary(k, d) for k, d in labelled_datasets(spark, sf)])


@register("q_s06_json_report", lambda: _s08_sql().replace("round_even(avg(health), 1) avg_health_index", "round_even(avg(health), 1) avg_health_index"))
def s06(spark, sf):
    rep = IO.union_all([_summary(k, d) for k, d in labelled_datasets(spark, sf)])
    nested = rep.select("dataset", "title", "domain", F.struct("total_records", "total_failures", "failure_rate_pct", "avg_health_index").alias("summary"))
    path = IO.write_json_report(nested, scratch_path(spark, "s06-json"))
    back = spark.read.schema(nested.schema).json(path)
    return back.select("dataset", "title", "domain", "summary.*")


@register("q_d03_cross_dataset_drivers")
def d03(spark, sf):
    """D3: per dataset, the summary row plus the top-5 drivers by importance share (rows-only check)."""
    frames, imps = [], []
    for k, d in labelled_datasets(spark, sf):
        from pyspark.sql.types import NumericType

        feats = [f.name for f in d.schema.fields if isinstance(f.dataType, NumericType)
                 and f.name not in {"h", "machine_failure", "rul", "health", "degradation", "stress", "twf", "hdf", "pwf", "osf", "rnf",
                                    "unit_id", "max_cycle"}]
        imp = X.correlation_importance(d, feats, "machine_failure")
        imps.append(X.importance_df(spark, imp).withColumn("dataset", F.lit(k)))
        frames.append(_summary(k, d))
    drivers = top_drivers(IO.union_all(imps)).groupBy("dataset").agg(
        F.concat_ws(" | ", F.transform(F.sort_array(F.collect_list(F.struct("driver_rank", "feature"))), lambda s: s["feature"])).alias("top_drivers"))
    return IO.union_all(frames).join(drivers, "dataset", "left")


__all__ = ["labelled_datasets", "PLANT_SENSORS"]
