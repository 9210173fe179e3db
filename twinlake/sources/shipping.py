"""Send this package to the Python workers, so that a session started elsewhere can run its operators."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's archive to the application, once; Spark hands it to every worker."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        root = Path(__file__).resolve().parents[1]
        copy = Path(tempfile.mkdtemp(prefix="twinlake-")) / "src"
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        context.addPyFile(shutil.make_archive(os.fspath(copy.parent / "twinlake_source"), "zip", copy))
        _sent.add(context.applicationId)
    return spark
