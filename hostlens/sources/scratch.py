"""Shared scratch space for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: `spark.checkpoint.dir`; a local one only in local mode."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        root = tempfile.mkdtemp(prefix="hostlens-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, **options: str) -> DataFrame:
    """Compute a reused result once, with its lineage cut on reliable storage; options of the writer."""
    path = scratch_path(df.sparkSession, "table")
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """Broadcast hint for a lookup side whose row count was checked; a join by shuffle beyond it, whatever the size of
    the files: neither side goes through the driver."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df.hint("merge")


def present(df: DataFrame) -> bool:
    """Whether the files a stored result reads are still there (scratch space may be cleared)."""
    files = df.inputFiles()
    try:
        df.sparkSession.read.text(sorted(files)[:1] + sorted(files)[-1:])
    except AnalysisException:
        return False
    return bool(files)
