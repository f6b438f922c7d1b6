"""Sends this package to executors that would not find it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package as a file of the application, once, unless the workers' PYTHONPATH already has it."""
    root, app = Path(__file__).resolve().parents[1], spark.sparkContext.applicationId
    listed = {Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if app in _sent or root in listed:
        return
    path = os.path.join(tempfile.mkdtemp(), "latticework.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.glob("latticework/**/*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
