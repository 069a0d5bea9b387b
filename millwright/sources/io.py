"""Sources and sinks.

Writes go to a folder under the cluster's shared ``spark.checkpoint.dir`` (see
``session.scratch_path``), never to a machine-local temp folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.functions.exprs import col
from millwright.session import materialize
from millwright.sources.catalog import resolve

MIN_UPLOAD_ROWS = 30


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """CSV with header; explicit schema when the source is catalogued, else inferred types."""
    r = spark.read.option("header", True)
    if schema is not None:
        return r.schema(schema).csv(path)
    return r.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> str:
    """Export as CSV with header (one folder of part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").parquet(path)
    return path


REJECTED = "_rejected"


def read_drop_in(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: (rows, rejects) of a CSV of unknown make with a header.

    Lines with too few or too many fields do not fail the read and are not guessed at: they go to
    ``rejects`` (one string column, the line as it stands). A column's type is settled by all its
    values among the good rows: whole numbers, numbers, else text; empty fields are null.
    """
    names = spark.read.option("header", True).csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, REJECTED]])
    lines = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", REJECTED).schema(text).csv(path)
    lines = materialize(lines, "drop-in")       # parsed once, whole: a pruned read would not see a line's length
    good = lines.filter(col(REJECTED).isNull()).drop(REJECTED)
    value = lambda n: F.nullif(F.trim(col(n)), F.lit(""))
    fits = lambda n, kind: (F.count(value(n)) == F.count(value(n).try_cast(kind)))
    found = good.agg(*[F.when(F.count(value(n)) == 0, "string").when(fits(n, "bigint"), "bigint").when(fits(n, "double"), "double").otherwise("string").alias(f"t{i}") for i, n in enumerate(names)]).first()
    typed = [(col(n) if found[f"t{i}"] == "string" else value(n).cast(found[f"t{i}"])).alias(n) for i, n in enumerate(names)]
    return good.select(*typed), lines.filter(col(REJECTED).isNotNull()).select(col(REJECTED).alias("line"))


def load_custom_checked(spark: SparkSession, key: str, custom_dir: str) -> tuple[DataFrame, DataFrame]:
    """S3: drop-in ``<custom_dir>/<key>.csv`` resolved through the catalog: its rows and its rejected lines."""
    entry = resolve(key, custom_dir, spark)
    if not entry.get("custom"):
        raise ValueError(f"{key} is a catalogued dataset, not a drop-in file")
    return read_drop_in(spark, entry["filename"])


def load_custom(spark: SparkSession, key: str, custom_dir: str) -> DataFrame:
    """S3: the rows of a drop-in file, without its malformed lines."""
    return load_custom_checked(spark, key, custom_dir)[0]


def upload_gate(df: DataFrame, min_rows: int = MIN_UPLOAD_ROWS) -> bool:
    """Accept only tables with at least 30 rows — reads at most 30 rows, never the whole table."""
    return df.limit(min_rows).count() >= min_rows


def write_json_report(df: DataFrame, path: str) -> str:
    """One JSON object per dataset (nested structs allowed)."""
    df.write.mode("overwrite").json(path)
    return path


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Long-form results of many datasets; columns missing in one input become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
