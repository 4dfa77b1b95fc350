"""Shipping of the package to executors, so that Python workers can import it anywhere."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per Spark context, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if getattr(sc, "_gistline_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="gistline-")  # read by this driver's file server alone
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "gistline_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in _PACKAGE.rglob("*.py"):
            z.write(p, f"{_PACKAGE.name}/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(target)
    sc._gistline_shipped = True
