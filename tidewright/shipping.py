"""Brings the package to executors that don't have it: as a zip file that Spark hands out."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Adds the package to the session's Python files, once for each Spark context."""
    context = spark.sparkContext
    if getattr(context, "_tidewright_shipped", False):
        return
    context._tidewright_shipped = True
    home = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(home):  # imported from a zip file itself
        return
    path = os.path.join(tempfile.mkdtemp(prefix="tidewright-"), "tidewright.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(home):
            for name in sorted(n for n in names if n.endswith(".py")):
                full = os.path.join(folder, name)
                out.write(full, os.path.join("tidewright", os.path.relpath(full, home)))
    context.addPyFile(path)
