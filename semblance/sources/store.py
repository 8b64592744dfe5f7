"""Tables between the steps of a plan, and tables of too few files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SPLIT = 128 << 20
BATCH, READ = 8 << 20, 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH`` bytes for the session's Python stages: by default one may
    take 64 MB, many times over as Python strings, in the worker of every core."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(key).rstrip("b")) <= BATCH:
        spark.conf.set(key, str(BATCH))


def small_splits(spark: SparkSession) -> None:
    """Files are read ``READ`` bytes a task: texts take long to prepare, and with a
    task a file the last ones leave most cores idle."""
    key = "spark.sql.files.maxPartitionBytes"
    if int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()) > READ:
        spark.conf.set(key, str(READ))


def shared(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share. Only a local
    session without that setting gets a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="semblance-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def opened(folder: str):
    """(file system, path in it) of a folder, a path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def stored(df: DataFrame, what: str = "stored") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what is read several times is
    computed once, and a lost executor costs none of it."""
    path = f"{shared(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A small table of fewer files than cores, dealt out to all of them: one row
    group is one task, and texts cost far more to prepare than to exchange. Any
    table of more files, or of more bytes than its splits would fill, stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPLIT and len(df.inputFiles()) < cores else df
