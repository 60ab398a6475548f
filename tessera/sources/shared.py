"""The folder that a session's driver and executors share, and what is kept there for a while."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the session names. Where it names none, a local session gets a temporary one; on a cluster
    that would be on one machine alone, so there it is an error."""
    folder, sc = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if not folder:
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
        folder = sc.getCheckpointDir()
    return folder


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove_folder(spark: SparkSession, folder: str) -> None:
    fs, path = hadoop_path(spark, folder)
    fs.delete(path, True)


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: what it was read from may go."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession, name: str):
    """A new folder below the shared one, which goes at the end of the block."""
    folder = os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")
    try:
        yield folder
    finally:
        remove_folder(spark, folder)
