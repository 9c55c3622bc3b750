"""Sending this package to the executors, whose Arrow functions import from it."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once an application: the package as an archive, served by the driver."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="shoalgrid-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    package = Path(__file__).resolve().parent
    archive = f"{folder}/shoalgrid-code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
