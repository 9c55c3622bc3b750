"""Cutting lineage in iterative operators: tables in the folder that all executors share, and letting go of them."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch tables that are there, by application, in the order of their making.
_made: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local session gets a folder of its own; a cluster has none that would do."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="shoalgrid-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/shoalgrid-{app}/{tag}-{uuid.uuid4().hex}"
    if app not in _made:
        _made[app] = []
        atexit.register(_end, spark, app)
    _made[app].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def _end(spark: SparkSession, app: str) -> None:
    """What is left goes with the application, if its driver can still be reached."""
    try:
        _delete(spark, f"{shared_dir(spark)}/shoalgrid-{app}")
    except Exception:  # the application was stopped before
        return


def cut(df: DataFrame, tag: str, together: int | None = None) -> DataFrame:
    """df as a table in the shared folder: the lineage ends there, and a lost executor costs no recomputation.

    together: how many rows are written, and later read, at once, for tables whose rows are megabytes. By themselves writers first look at their memory after 100 rows, and
    readers take a whole row group of nested values, so a task would hold all of its rows."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    bounds = {} if together is None else {"parquet.block.row.count.limit": str(together)}
    df.write.option("compression", "zstd").options(**bounds).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables that cut() has made and that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            _delete(df.sparkSession, path)
            _made[df.sparkSession.sparkContext.applicationId].remove(path)


@contextmanager
def swept(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """At the end, scratch tables made inside are deleted, but for those that were put into the list given."""
    app, keep = spark.sparkContext.applicationId, []
    before = set(_made.get(app, ()))
    yield keep
    kept = {getattr(df, "_scratch", None) for df in keep}
    for path in [p for p in _made.get(app, ()) if p not in before and p not in kept]:
        _delete(spark, path)
        _made[app].remove(path)
