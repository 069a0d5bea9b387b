"""What the two classifiers share: the labelled rows they may learn from, and the held-out mark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


def held_out(folds: int, fold: int) -> Column:
    """True for the documents whose labels are never learnt from; a null id is not held out."""
    return F.coalesce(remainder(F.col("doc_id"), folds) == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, most: int) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents outside the held-out fold.

    The documents with the smallest id hashes are taken, so reruns agree and the sample is
    spread over the table. ``most`` is the documented bound of the fitting sample: its ids are
    the only rows broadcast here.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), folds) != fold))
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
