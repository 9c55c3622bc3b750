"""Joining documents with labels, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of FOLDS folds by crc32 of the doc_id, fold 0 is held out.
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """A null doc_id belongs to no fold that is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def taught(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and y (0 or 1) of what may be learnt: not held out, one row per doc_id. Several labels count as 1 if any is 1; null labels don't count."""
    return labels.filter(F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))


def training(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """rows with a label (as y) that are not held out."""
    return rows.filter(~held_out(F.col("doc_id"))).join(taught(labels, label).withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).drop("_id")
