"""Folders for tables that a job writes for itself."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share, as spark.checkpoint.dir names it.

    Where the session names none, a session in one process takes a temporary one; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.fullmatch(r"local(\[[\d*]+(,\s*\d+)?\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="basalt-")
    return f"{where.rstrip('/')}/basalt-{uuid.uuid4().hex}"
