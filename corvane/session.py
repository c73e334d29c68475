"""Making the package importable by Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once a session, unless their PYTHONPATH has it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or any(p and Path(p).resolve() == ROOT for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)):
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="corvane-zip-")  # on the driver only, whose file server sends it on
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{folder}/corvane", "zip", ROOT, "corvane"))
