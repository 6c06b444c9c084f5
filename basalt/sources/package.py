"""Sending this package to the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession



def ship(spark: SparkSession) -> None:
    """Send this package along with the application, once, so that tasks can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_basalt_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="basalt-")) / "basalt_package.zip"
    with zipfile.ZipFile(to, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(to))
    sc._basalt_shipped = True
