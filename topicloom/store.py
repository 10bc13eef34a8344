"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
#: Spark deletes what an execution shuffled when it ends, if this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this process serves, which goes when the process ends, but
    only for a local master: on a cluster the executors would not see it, so that case is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return f"{folder.rstrip('/')}/topicloom-{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="topicloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return _own_folder[0]


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors, and its size is known.

    What the write shuffled goes when it is done, as nothing reads it again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)  # smaller than the default; these tables are read a few times at most
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by a key, of which no value is frequent, into tasks for all cores: short rows that take long come in few files."""
    # not by the key itself, since Spark drops a repartition that an aggregate's already equals
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(key))


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a staged table that nothing reads any more."""
    _delete(df.sparkSession, df.staged_path)


def clear(spark: SparkSession) -> None:
    """Deletes all staged tables of this application; results that are not written yet still need them."""
    _delete(spark, shared_dir(spark))
