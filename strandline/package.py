"""Sends this package's source to the executors, for sessions started where it isn't on their path."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a zip file to the session's Python files, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    spark.sparkContext.addPyFile(str(target))
    _SENT.add(app)
