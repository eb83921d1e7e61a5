"""Makes this package importable for Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors: sent as a zip unless PYTHONPATH already names it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    where = tempfile.mkdtemp(prefix="codequarry-zip-")
    atexit.register(shutil.rmtree, where, ignore_errors=True)
    with zipfile.ZipFile(f"{where}/codequarry_src.zip", "w") as z:
        for p in (ROOT / "codequarry").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(f"{where}/codequarry_src.zip")
