"""Session helpers: executors get this package with the session's own file server."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def shipped(spark: SparkSession) -> SparkSession:
    """Make this package importable by Python workers; once for each context."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(":") or getattr(sc, "_emendata_shipped", False):
        return spark
    at = Path(tempfile.mkdtemp(prefix="emendata-")) / "emendata_package.zip"  # served by the driver while it lives
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted((ROOT / "emendata").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(at))
    sc._emendata_shipped = True
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared folder (spark.checkpoint.dir), of our own only where none is set and all runs in one process; it goes when the driver ends."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    at = f"{(at or 'file:/tmp/checkpoints/emendata').rstrip('/')}/emendata/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at
