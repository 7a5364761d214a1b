"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; a folder of our own only if it is unset and all runs on this machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = os.path.join(tempfile.gettempdir(), "quillspark-checkpoints")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def written(df: DataFrame) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder: lost executors can't lose it, and its lineage ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


def files_of(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it names it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files, files.makeQualified(where)


def remove(df: DataFrame) -> None:
    """Deletes the table behind a written DataFrame that nothing reads any more."""
    if path := _written.pop(df, None):
        files, where = files_of(df.sparkSession, path)
        files.delete(where, True)
