"""Make this package importable on the executors, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per context: the package's sources as a py-file, which Spark hands to every executor."""
    context = spark.sparkContext
    if getattr(context, "_sarnai_shipped", False):
        return
    top = Path(__file__).resolve().parent
    at = os.path.join(tempfile.mkdtemp(prefix="sarnai-"), "sarnai.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    context.addPyFile(at)
    context._sarnai_shipped = True
