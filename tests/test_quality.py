import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millwright.operators.quality import Cleaner, drop_exact_duplicates, duplicate_counts


def _table(spark):
    rows = [
        ("a", "L", 1.0, 10.0, 5.0, None),
        ("b", "L", 2.0, 10.0, 5.0, None),
        ("c", "M", None, 10.0, 5.0, None),
        ("d", "M", 4.0, 10.0, 5.0, None),
        ("e", None, 100.0, 10.0, 5.0, None),
        ("e", None, 100.0, 10.0, 5.0, None),   # exact duplicate
        ("f", "H", 3.0, 10.0, 5.0, None),
        ("g", "H", 2.5, 10.0, 5.0, None),
    ]
    return spark.createDataFrame(rows, "k string, tier string, s_rpm double, flat double, other double, empty double")


def _pandas_reference(pdf: pd.DataFrame, sensors):
    """Straight re-statement of the cleaning rules on pandas, for the hand-made table."""
    work = pdf.drop_duplicates().reset_index(drop=True)
    mode = work["tier"].mode()
    work["tier"] = work["tier"].fillna(mode.iloc[0] if not mode.empty else "M")
    out = {}
    for c in sensors:
        v = pd.to_numeric(work[c], errors="coerce")
        valid = v.dropna()
        med = float(valid.median()) if len(valid) else 0.0
        imp = v.fillna(work.groupby("tier")[c].transform("median")).fillna(med)
        q25, q75 = float(imp.quantile(0.25)), float(imp.quantile(0.75))
        iqr = max(q75 - q25, 1e-6)
        lo, hi = q25 - 2.2 * iqr, q75 + 2.2 * iqr
        cl = imp.clip(lo, hi)
        cl = np.round(cl) if "rpm" in c.lower() else np.round(cl, 3)
        out[c] = (list(cl), (lo, hi), int(((imp < q25 - 1.5 * iqr) | (imp > q75 + 1.5 * iqr)).sum()))
    return work, out


def test_cleaner_matches_pandas_rules(spark):
    df = _table(spark)
    sensors = ["s_rpm", "flat", "empty"]
    m = Cleaner(sensors, "tier").fit(df)
    got = m.transform(drop_exact_duplicates(df)).orderBy("k").toPandas()
    work, ref = _pandas_reference(df.toPandas(), sensors)
    work = work.sort_values("k").reset_index(drop=True)
    for c in sensors:
        exp = pd.Series(ref[c][0], index=work.index)
        assert list(got[c]) == list(exp), c
        assert m.fences[c][0] == ref[c][1][0] and m.fences[c][1] == ref[c][1][1]
        assert m.after[c]["iqr_outliers"] == ref[c][2]
    # constant column: IQR floored at 1e-6, values unchanged
    assert set(got["flat"]) == {10.0}
    # all-null column: imputed with 0.0 (no valid values)
    assert set(got["empty"]) == {0.0}
    # tier filled with the mode (ties → smallest: H, L, M all twice → 'H')
    assert m.tier_fill == "H"
    assert m.counts["duplicates_removed"] == 1


def test_winsorized_within_fences_and_idempotent_nulls(spark):
    df = _table(spark)
    m = Cleaner(["s_rpm"], "tier").fit(df)
    out = m.transform(df)
    lo, hi = m.fences["s_rpm"]
    vals = [r[0] for r in out.select("s_rpm").collect()]
    assert all(math.floor(lo) <= v <= math.ceil(hi) for v in vals)
    assert out.filter(F.col("s_rpm").isNull()).count() == 0
    m2 = Cleaner(["s_rpm"], "tier").fit(out)
    assert m2.before["s_rpm"]["missing"] == 0


def test_duplicate_counts(spark):
    r = duplicate_counts(_table(spark)).first()
    assert (r["initial_rows"], r["cleaned_rows"], r["duplicates_removed"]) == (8, 7, 1)


def test_nan_is_missing_and_text_or_infinity_does_not_raise(spark):
    from millwright.operators.quality import clean, missing_profile

    inf, nan = float("inf"), float("nan")
    rows = [(str(i), "LMH"[i % 3], float(i % 9), "nan" if i % 5 == 0 else str(i % 7), inf if i == 3 else -inf if i == 4 else float(i), None) for i in range(30)]
    rows[7] = ("7", "M", nan, "bad", 1e308, None)
    d = spark.createDataFrame(rows, "k string, tier string, x double, t string, y double, empty double")
    miss = {r["column"]: r["missing"] for r in missing_profile(d, ["x", "t", "y", "empty"]).collect()}
    assert miss == {"x": 1, "t": 7, "y": 0, "empty": 30}
    out, m = clean(d, ["x", "t", "y", "empty"], "tier")
    got = out.filter("k = '7'").first()
    assert got["x"] == np.median([i % 9 for i in range(30) if i % 3 == 1 and i != 7])
    assert m.before["x"]["missing"] == 1 and out.count() == 30 and out.filter("isnan(x) or x is null or t is null").count() == 0
