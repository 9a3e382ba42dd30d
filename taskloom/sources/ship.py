"""The package on every executor."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Gives this package to the session's Python workers, once for each Spark application."""
    context = spark.sparkContext
    if getattr(context, "_taskloom_shipped", False):
        return
    root = Path(__file__).resolve().parent.parent
    if root.is_dir():
        path = Path(tempfile.mkdtemp(prefix="taskloom-"), "taskloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, Path("taskloom", p.relative_to(root)))
        context.addPyFile(str(path))  # Spark's own file server hands it to executors
    context._taskloom_shipped = True
