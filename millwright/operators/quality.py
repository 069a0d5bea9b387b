"""Data-quality audit and cleaning (Q1–Q14).

``Cleaner.fit`` runs a fixed number of aggregate actions regardless of the number
of sensor columns:

  1. the de-duplicated table (persisted) and its statistics: row counts, missing counts, mean,
     sample std, tier mode - grouped by tier, then one row,
  2. exact medians, overall and per tier after the tier fill, in one call (``quantiles``: a
     sketch and an exact pass); the tiers' are a written table,
  3. quartiles of the imputed values, likewise,
  4. audit counts (Tukey, z) and after-cleaning moments — one row.

``CleanerModel.transform`` is a projection (``coalesce`` / ``least`` / ``greatest`` /
``rint``) over a join with the table of tier medians, whose size Spark knows; it also
runs on a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.exprs import clip, col, lower_name_rounds_to_int, np_round
from millwright.operators.quantiles import exact_quantiles, quantile_table, wide
from millwright.session import materialize


def _quantiles(df: DataFrame, values: dict[str, Column], probs: list[float], exact: bool) -> dict[str, list[float | None]]:
    """{column: quantiles} of the whole table, exact or by ``percentile_approx``."""
    if exact:
        return exact_quantiles(df, values, probs)
    r = df.agg(*[F.percentile_approx(v, F.array(*map(F.lit, probs)), 100_000).alias(f"q{i}") for i, v in enumerate(values.values())]).first()
    return {c: list(r[f"q{i}"]) if r[f"q{i}"] is not None else [None] * len(probs) for i, c in enumerate(values)}


def numeric_cast(c: str) -> Column:
    """Q4: numeric coercion, bad text and NaN → null (``pd.to_numeric(errors='coerce')``; NaN is missing)."""
    return F.expr(f"nanvl(try_cast(`{c}` as double), null)")


def duplicate_counts(df: DataFrame) -> DataFrame:
    """Q1 counts: initial rows, distinct rows, duplicates — one shuffle with partial aggregation.

    A hot group of copies is combined map-side, so no task receives it whole.
    """
    g = df.groupBy(*[col(c) for c in df.columns]).count()
    return g.agg(
        F.sum("count").cast("long").alias("initial_rows"),
        F.count(F.lit(1)).cast("long").alias("cleaned_rows"),
    ).withColumn("duplicates_removed", F.col("initial_rows") - F.col("cleaned_rows"))


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    """Q1: drop exact duplicate rows (null equals null)."""
    return df.dropDuplicates()


@dataclass
class CleanerModel:
    sensors: list[str]
    tier_col: str | None
    tier_fill: str
    medians: dict[str, float]
    fences: dict[str, tuple[float, float]]
    tukey: dict[str, tuple[float, float]]
    before: dict[str, dict] = field(default_factory=dict)
    after: dict[str, dict] = field(default_factory=dict)
    counts: dict = field(default_factory=dict)
    tier_table: DataFrame | None = None  # one row per tier: its medians, joined by the tier

    # ---- transform (Q2, Q4, Q6, Q9, Q10 as one projection) ----
    def impute_exprs(self) -> dict[str, Column]:
        out = {}
        tier = self.tier_expr()
        for c in self.sensors:
            raw = numeric_cast(c)
            if tier is not None and self.tier_table is not None:
                out[c] = F.coalesce(raw, F.col(f"`__tm_{c}`"), F.lit(self.medians[c]))
            else:
                out[c] = F.coalesce(raw, F.lit(self.medians[c]))
        return out

    def tier_expr(self) -> Column | None:
        if self.tier_col is None:
            return None
        return F.coalesce(col(self.tier_col), F.lit(self.tier_fill))

    def clean_exprs(self) -> dict[str, Column]:
        out = {}
        for c, e in self.impute_exprs().items():
            lo, hi = self.fences[c]
            clipped = clip(e, lo, hi)
            out[c] = np_round(clipped, 0) if lower_name_rounds_to_int(c) else np_round(clipped, 3)
        return out

    def _with_tier_join(self, df: DataFrame) -> DataFrame:
        if self.tier_col is None or self.tier_table is None:
            return df
        t = self.tier_table.select(
            F.col("tier").alias("__tier"), *[F.col(f"`{c}`").alias(f"__tm_{c}") for c in self.sensors]
        )
        return df.join(t, self.tier_expr() == F.col("__tier"), "left").drop("__tier")

    def transform(self, df: DataFrame) -> DataFrame:
        d = self._with_tier_join(df)
        exprs = self.clean_exprs()
        if self.tier_col is not None:
            exprs[self.tier_col] = self.tier_expr()
        out = d.withColumns(exprs)
        return out.drop(*[f"__tm_{c}" for c in self.sensors]) if self.tier_table is not None else out

    def impute(self, df: DataFrame) -> DataFrame:
        d = self._with_tier_join(df)
        exprs = self.impute_exprs()
        if self.tier_col is not None:
            exprs[self.tier_col] = self.tier_expr()
        out = d.withColumns(exprs)
        return out.drop(*[f"__tm_{c}" for c in self.sensors]) if self.tier_table is not None else out

    # ---- reports (Q3, Q12, Q13) ----
    def audit_table(self, spark: SparkSession) -> DataFrame:
        rows = []
        n = self.counts["cleaned_rows"]
        for c in self.sensors:
            b, a = self.before[c], self.after[c]
            lo, hi = self.fences[c]
            rows.append(
                (
                    c,
                    int(b["missing"]),
                    round(b["missing"] / max(n, 1) * 100.0, 2),
                    0,
                    "Grouped Median by Tier",
                    int(a["iqr_outliers"]),
                    int(a["z_outliers"]),
                    f"IQR Winsorization [{lo:.2f}, {hi:.2f}]",
                    None if b["mean"] is None else round(b["mean"], 2),
                    None if a["mean"] is None else round(a["mean"], 2),
                    None if b["std"] is None else round(b["std"], 2),
                    None if a["std"] is None else round(a["std"], 2),
                )
            )
        schema = T.StructType(
            [
                T.StructField("column", T.StringType()),
                T.StructField("missing_before", T.LongType()),
                T.StructField("missing_pct", T.DoubleType()),
                T.StructField("missing_after", T.LongType()),
                T.StructField("imputation_strategy", T.StringType()),
                T.StructField("iqr_outliers_detected", T.LongType()),
                T.StructField("zscore_outliers_detected", T.LongType()),
                T.StructField("outlier_treatment", T.StringType()),
                T.StructField("mean_before", T.DoubleType()),
                T.StructField("mean_after", T.DoubleType()),
                T.StructField("std_before", T.DoubleType()),
                T.StructField("std_after", T.DoubleType()),
            ]
        )
        return spark.createDataFrame(rows, schema)

    def report(self) -> dict:
        # --- fixed values: names of the methods in the report ---
        return {
            "initial_rows": self.counts["initial_rows"],
            "cleaned_rows": self.counts["cleaned_rows"],
            "duplicates_removed": self.counts["duplicates_removed"],
            "total_missing_detected": int(sum(self.before[c]["missing"] for c in self.sensors)) + self.counts["tier_missing"],
            "total_missing_after": 0,
            "total_iqr_outliers_detected": int(sum(self.after[c]["iqr_outliers"] for c in self.sensors)),
            "total_zscore_outliers_detected": int(sum(self.after[c]["z_outliers"] for c in self.sensors)),
            "imputation_method": "Type-Stratified Median & Mode Imputation",
            "outlier_method": "Tukey IQR Audit + Robust Winsorization Capping",
            "scaling_method": "StandardScaler (Z-Score Normalization for DL & Linear Models)",
        }

    def report_df(self, spark: SparkSession) -> DataFrame:
        r = self.report()
        schema = T.StructType(
            [T.StructField(k, T.LongType() if isinstance(v, int) else T.StringType()) for k, v in r.items()]
        )
        return spark.createDataFrame([tuple(r.values())], schema)


class Cleaner:
    """Fit cleaning statistics; ``fit(df).transform(other)`` re-applies them (Q14)."""

    def __init__(self, sensors: list[str], tier_col: str | None = "tier", iqr_multiplier: float = 2.2,
                 exact: bool = True, dedup: bool = True):
        self.sensors = list(sensors)
        self.tier_col = tier_col
        self.k = iqr_multiplier
        self.exact = exact
        self.dedup = dedup

    def fit(self, df: DataFrame) -> CleanerModel:
        model, _ = self.fit_dedup(df)
        self._cached.unpersist()
        return model

    def fit_dedup(self, df: DataFrame) -> tuple[CleanerModel, DataFrame]:
        """Fit and also return the de-duplicated input, persisted once and shared by every
        statistics pass and by the caller's ``transform`` (the cached frame is ``self._cached``)."""
        tier_col = self.tier_col if (self.tier_col and self.tier_col in df.columns) else None
        if self.dedup:
            # one grouped pass (map-side combined) gives the distinct rows with their copy counts
            g = df.groupBy(*[col(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("__copies"))
        else:
            g = df.withColumn("__copies", F.lit(1).cast("long"))
        self._cached = g.persist(StorageLevel.MEMORY_AND_DISK)
        return self._fit_on(self._cached, tier_col), self._cached.drop("__copies")

    def _stats(self, counted: DataFrame, tier_col: str | None):
        """One row: initial rows n, distinct rows m, missing tiers, the mode, and per sensor its missing count m<i>,
        mean a<i> and sample std s<i>; first per tier, so that the mode needs no pass of its own."""
        parts, aggs = [F.sum("__copies").alias("__n"), F.count(F.lit(1)).alias("__m")], []
        for i, c in enumerate(self.sensors):
            v = numeric_cast(c)
            parts += [F.count(v).alias(f"c{i}"), F.avg(v).alias(f"a{i}"), F.var_pop(v).alias(f"v{i}")]
        tiers = counted.groupBy((col(tier_col) if tier_col else F.lit("")).alias("__t")).agg(*parts)
        for i in range(len(self.sensors)):
            n, mean, var = (F.col(f"{x}{i}") for x in "cav")
            total, average = F.sum(n), F.sum(n * mean) / F.nullif(F.sum(n), F.lit(0))
            spread = F.sum(n * var) + F.greatest(F.lit(0.0), F.sum(n * mean * mean) - total * average * average)
            aggs += [(F.sum("__m") - total).alias(f"m{i}"), average.alias(f"a{i}"), F.sqrt(spread / F.nullif(total - 1, F.lit(0))).alias(f"s{i}")]
        named = F.when(F.col("__t").isNotNull(), F.struct((-F.col("__m")).alias("n"), F.col("__t").alias("t")))
        return tiers.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n"), F.coalesce(F.sum("__m"), F.lit(0)).alias("m"),
                         F.coalesce(F.sum(F.when(F.col("__t").isNull(), F.col("__m"))), F.lit(0)).alias("tier_missing"), F.min(named)["t"].alias("mode"), *aggs).first()

    def _fit_on(self, counted: DataFrame, tier_col: str | None) -> CleanerModel:
        ex, work = self.exact, counted.drop("__copies")
        g = self._stats(counted, tier_col)
        counts = {"initial_rows": int(g["n"]), "cleaned_rows": int(g["m"]), "duplicates_removed": int(g["n"] - g["m"]), "tier_missing": int(g["tier_missing"]) if tier_col else 0}
        before = {}
        for i, c in enumerate(self.sensors):
            mean = g[f"a{i}"]
            before[c] = {"missing": int(g[f"m{i}"] or 0), "mean": mean if mean is not None else 0.0, "std": g[f"s{i}"] if mean is not None else 1.0}
        tier_fill = g["mode"] if tier_col and g["mode"] is not None else "M"
        model = CleanerModel(self.sensors, tier_col, tier_fill, {}, {}, {}, before, {}, counts)

        # medians, overall and per tier after the tier fill: every row counts in its tier and in the whole
        vals = {c: numeric_cast(c) for c in self.sensors}
        if ex and tier_col:
            scopes = F.explode(F.array(F.struct(F.lit(False).alias("whole"), model.tier_expr().alias("tier")), F.struct(F.lit(True).alias("whole"), F.lit(None).cast("string").alias("tier")))).alias("__scope")
            both = materialize(wide(quantile_table(work.withColumn("__scope", scopes), vals, [0.5], ["__scope"]), self.sensors, ["__scope"]), "medians")
            model.tier_table = both.filter(~F.col("__scope.whole")).select(F.col("__scope.tier").alias("tier"), *[col(c) for c in self.sensors])
            whole = both.filter("__scope.whole").select(*[col(c) for c in self.sensors]).first()
            mid = {c: whole[c] if whole is not None else None for c in self.sensors}
        else:
            mid = {c: q[0] for c, q in _quantiles(work, vals, [0.5], ex).items()}
            if tier_col:
                tw = work.withColumn("__tier", model.tier_expr())
                tab = tw.groupBy("__tier").agg(*[F.percentile_approx(v, F.lit(0.5), 100_000).alias(c) for c, v in vals.items()])
                model.tier_table = materialize(tab.withColumnRenamed("__tier", "tier"), "tier-medians")
        model.medians = {c: float(m) if m is not None else 0.0 for c, m in mid.items()}

        # quartiles of the imputed values
        imputed = model.impute(work)
        qs = _quantiles(imputed, {c: col(c) for c in self.sensors}, [0.25, 0.75], ex)
        for c in self.sensors:
            q25, q75 = (float(x) if x is not None else float("nan") for x in qs[c])
            iqr = max(q75 - q25, 1e-6)
            model.tukey[c] = (q25 - 1.5 * iqr, q75 + 1.5 * iqr)
            model.fences[c] = (q25 - self.k * iqr, q75 + self.k * iqr)

        # audit counts on imputed values + moments after cleaning
        cleaned = model.clean_exprs()
        imp = model.impute_exprs()
        d = model._with_tier_join(work)
        aggs = []
        for i, c in enumerate(self.sensors):
            lo, hi = model.tukey[c]
            b = before[c]
            aggs.append(F.count_if((imp[c] < lo) | (imp[c] > hi)).alias(f"t{i}"))
            if b["std"] is None:
                aggs.append(F.lit(0).alias(f"z{i}"))
            else:
                sd = max(b["std"], 1e-6)
                aggs.append(F.count_if(F.abs((imp[c] - F.lit(b["mean"])) / F.lit(sd)) > 3.0).alias(f"z{i}"))
            aggs += [F.avg(cleaned[c]).alias(f"ma{i}"), F.stddev_samp(cleaned[c]).alias(f"sa{i}")]
        a = d.agg(*aggs).first()
        for i, c in enumerate(self.sensors):
            model.after[c] = {"iqr_outliers": a[f"t{i}"], "z_outliers": a[f"z{i}"],
                              "mean": a[f"ma{i}"], "std": a[f"sa{i}"]}
        return model


def clean(df: DataFrame, sensors: list[str], tier_col: str | None = "tier", iqr_multiplier: float = 2.2,
          exact: bool = True) -> tuple[DataFrame, CleanerModel]:
    """Reference behaviour: fit on the table, then de-duplicate and transform it."""
    model, work = Cleaner(sensors, tier_col, iqr_multiplier, exact).fit_dedup(df)
    return model.transform(work), model


def missing_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q3: missing count and % per column, one aggregate then an unpivot (``stack``)."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("__n"), *[F.count_if(numeric_cast(c).isNull() if c != "tier" else col(c).isNull()).alias(f"__m{i}")
                                    for i, c in enumerate(columns)])
    stack = ", ".join(f"'{c}', `__m{i}`" for i, c in enumerate(columns))
    return wide.selectExpr("__n", f"stack({len(columns)}, {stack}) as (`column`, missing)").select(
        "column",
        F.col("missing").cast("long").alias("missing"),
        np_round(F.col("missing") / F.greatest(F.col("__n"), F.lit(1)) * 100.0, 2).alias("missing_pct"),
    )
