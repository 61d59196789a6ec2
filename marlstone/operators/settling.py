"""Frames that are read more than once, cut from their lineage in the shared folder."""

from __future__ import annotations

import gc
import re
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER = "/tmp/checkpoints/marlstone"


def prepare(spark: SparkSession) -> None:
    """Give the context a checkpoint folder: that of spark.checkpoint.dir, else its own one.

    Where neither is set, a session in one process gets a folder of ours; on a cluster that is an
    error, as executors don't share local folders.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _OWN_FOLDER
    context.setCheckpointDir(found)


def settled(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint."""
    prepare(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df from compressed columns in the shared folder, for frames too large for a checkpoint's plain rows."""
    prepare(df.sparkSession)
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.written_at = path
    return found


class Tables:
    """Written frames of an operator's steps, deleted when nothing reads them any more."""

    def __init__(self) -> None:
        self._frames: list[DataFrame] = []

    def write(self, df: DataFrame) -> DataFrame:
        self._frames.append(written(df))
        return self._frames[-1]

    def clear(self, but: DataFrame | None = None) -> None:
        """Delete them, and let Spark drop the shuffles of finished steps: it waits for the driver's collector."""
        for df in self._frames:
            if df is not but:
                context = df.sparkSession.sparkContext
                path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
                path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
        if self._frames:
            context = self._frames[0].sparkSession.sparkContext
            gc.collect()
            context._jvm.System.gc()
        self._frames = [df for df in self._frames if df is but]
