import duckdb
import numpy as np
from pyspark.sql import functions as F

from millwright.functions.exprs import clip, hash_normal, hash_uniform, np_round
from millwright.sources.fixtures import hash_normal_sql, hash_uniform_sql


def test_np_round_matches_numpy(spark):
    vals = [2.345, 0.285, 2.5, 3.5, -2.5, 1.005, 302.05, 12.3449999]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(np_round("x", 2)).collect()]
    assert got == [float(np.round(v, 2)) for v in vals]
    got0 = [r[0] for r in df.select(np_round("x", 0)).collect()]
    assert got0 == [float(np.round(v)) for v in vals]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(clip("x", -1.0, 1.0)).collect()] == [None, 1.0, -1.0]


def test_hash_draws_match_duckdb(spark):
    keys = [f"k{i}" for i in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    s = {r[0]: (r[1], r[2]) for r in df.select("k", hash_uniform("k", "salt"), hash_normal("k", "z")).collect()}
    con = duckdb.connect()
    con.execute("create table t as select * from (values " + ",".join(f"('{k}')" for k in keys) + ") v(k)")
    d = {r[0]: (r[1], r[2]) for r in con.execute(
        f"select k, {hash_uniform_sql('k', 'duckdb', 'salt')}, {hash_normal_sql('k', 'z', 'duckdb')} from t").fetchall()}
    for k in keys:
        assert s[k][0] == d[k][0]
        assert abs(s[k][1] - d[k][1]) < 1e-12
    u = np.array([v[0] for v in s.values()])
    assert 0.0 <= u.min() and u.max() < 1.0
