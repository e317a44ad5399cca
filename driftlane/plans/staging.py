"""Cutting lineage between the stages of a job."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """Checkpoint folder of the session, from ``spark.checkpoint.dir``.

    There is no default: the folder must be one that all executors share.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Materialises a frame that several later steps read.

    The rows are written to the shared folder, so a lost executor costs one
    reread instead of the whole lineage. With
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` they go when unused.
    """
    if not df.sparkSession.sparkContext.getCheckpointDir():
        checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def work_folder(spark: SparkSession) -> str:
    """A new folder below the shared one; a local session without the setting uses a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/work-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path
