"""What the training-data operators share: word rules, table access, cutting lineage."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shoalgrid.lineage import cut
from shoalgrid.shipping import ship

#: Words are maximal runs without a space or a character from tab to carriage return.
SEPARATORS = "[\\x20\\x09-\\x0D]+"
#: Parts that packed rows are dealt to at once.
COARSE = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; only Spark's reader sees the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, in order (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it (also inside lambdas)."""
    return F.transform(F.array(value), body)[0]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, tag: str, together: int | None = None) -> DataFrame:
    """df as a table in the shared folder, read back. together: see cut()."""
    return cut(df, tag, together)


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of jobs that are done. Spark does so when the driver collects what stood for them, and what it queues for
    cleaning is only known after a first collection; so twice, with time for the cleaner."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def arrow_batches(spark: SparkSession, rows: int = 1000, megabytes: int = 16) -> None:
    """Ready the session for Arrow functions: bound what one batch holds, for tables with very long texts, and ship this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))
    ship(spark)


def share_out(rows: DataFrame, parts: int, refine: Callable | None = None, coarse: int = COARSE) -> DataFrame:
    """rows (part, packed ...) at the task that their part names, of `parts` tasks.

    Rows are packed by part, so with very many parts they would be many and small, their number growing with the square of the input. Beyond `coarse` parts rows come packed
    for groups of parts (see groups_of) instead; those of a group meet in a task, refine packs them anew for each part, from far more entries, and they move on."""
    if parts <= coarse:
        return rows.repartitionById(parts, "part")
    return rows.repartitionById(-(-parts // groups_of(parts, coarse)), "part").mapInArrow(refine, rows.schema).repartitionById(parts, "part")


def groups_of(parts: int, coarse: int = COARSE) -> int:
    """How many parts rows are first packed for together: 1 up to `coarse` parts."""
    return -(-parts // coarse)
