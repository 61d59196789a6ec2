"""What several operators share: a shared folder for cut lineage, and column hygiene."""

from __future__ import annotations

import gc
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space as the contracts name it: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"

_OWN_FOLDER = "/tmp/checkpoints/marlstone"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or else of the context's checkpoints.

    Where neither is set a session in one process gets a folder of our own; on a cluster that is an
    error, as executors don't share local folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(_OWN_FOLDER)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    The new plan starts from replicated files, so a lost executor costs a reread and not a
    recomputation, and several consumers share one computation.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstone/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def discard(settled: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    spark = settled.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(settled.settled_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let go of what finished steps have left behind.

    Spark drops shuffle files, broadcasts and plans only when the driver's JVM has collected the
    frames that they belonged to, and between many short steps that may not happen for long.
    """
    gc.collect()
    pa.default_memory_pool().release_unused()
    spark.sparkContext._jvm.System.gc()


class Scratch:
    """Settled tables of an operator's steps, deleted when its result no longer reads them."""

    def __init__(self) -> None:
        self._tables: list[DataFrame] = []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        self._tables.append(settle(df, label))
        return self._tables[-1]

    def clear(self) -> None:
        spark = self._tables[-1].sparkSession if self._tables else None
        while self._tables:
            discard(self._tables.pop())
        if spark is not None:
            release(spark)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without the columns whose names (case aside) an operator is about to write."""
    taken = {n.lower() for n in names}
    return df.select(*[quoted(c) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(df: DataFrame, *fields: tuple[str, str]) -> T.StructType:
    """The schema of df followed by new fields given as (name, DDL type)."""
    added = T.StructType([T.StructField(n, T.StructType.fromDDL(f"x {t}")["x"].dataType) for n, t in fields])
    return T.StructType([*df.schema.fields, *added.fields])


def bytes_of(df: DataFrame, text_col: str) -> int:
    """UTF-8 bytes of a text column: one number, from one scan of that column."""
    row = df.agg(F.sum(F.octet_length(quoted(text_col).cast("string")).cast("long"))).first()
    return int(row[0] or 0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of a few rows, so a worker holds little besides the batch itself."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
