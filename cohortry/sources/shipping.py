"""Bring this package to Python workers that do not have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add the package's code to the application's files, once. Spark serves it from
    the driver to every executor, later ones included."""
    package = Path(__file__).resolve().parent.parent
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if app in _shipped or str(package.parent) in known or not package.is_dir():
        return
    _shipped.add(app)
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / f"{package.name}-trees.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
