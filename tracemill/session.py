"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_HOME = Path(__file__).resolve().parent
_ARCHIVE = "tracemill_modules.zip"


def ship(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once a session."""
    context = spark.sparkContext
    if any(f.endswith(_ARCHIVE) for f in context.listFiles):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-modules-"), _ARCHIVE)
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_HOME.rglob("*.py")):
            archive.write(source, source.relative_to(_HOME.parent))
    context.addPyFile(path)


def shipped(query):
    """The query, run with the package on the workers."""

    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
