"""Getting this package to Spark's Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, unless PYTHONPATH already leads them to it."""
    root = Path(__file__).resolve().parents[1]
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.sparkContext.applicationId in _shipped:
        return
    archive = shutil.make_archive(str(Path(tempfile.mkdtemp(prefix="spark-")) / "hearthline"), "zip", root, "hearthline")
    spark.sparkContext.addPyFile(archive)
    _shipped.add(spark.sparkContext.applicationId)
