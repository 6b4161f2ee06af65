"""Sending the package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once a context, wherever the driver was started."""
    context = spark.sparkContext
    if getattr(context, "tidemark_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as archive:
        for file in sorted(PACKAGE.rglob("*.py")):
            archive.write(file, file.relative_to(PACKAGE.parent))
    context.addPyFile(str(path))
    context.tidemark_shipped = True
