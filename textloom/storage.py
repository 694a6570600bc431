"""A folder for tables that the engine writes for itself."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

RUN = f"textloom-engine-{uuid.uuid4().hex}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; a temporary folder only where that is unset and driver and executor are one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="textloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{RUN}/{name}-{uuid.uuid4().hex}"
