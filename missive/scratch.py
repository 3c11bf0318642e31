"""Where tables that a session makes for itself are written, and how many rows its Python workers hold."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset a session of this machine alone, as in tests, gets a folder of its own; on
    a cluster it is an error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="missive-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/missive/{uuid.uuid4().hex}/{tag}"


def bounded_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small where the session still has Spark's default of 10,000 rows:
    texts can be long, and a batch is held whole by a worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(rows))
