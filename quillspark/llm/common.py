"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many rows.
BROADCAST_ROWS = 500_000


def small_batches(spark: SparkSession) -> None:
    """Python workers get Arrow batches of a few MB, so that what they hold doesn't depend on how long texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id falls in no fold (null)."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(parts))


def small_join(big: DataFrame, small: DataFrame, on: list[str], how: str, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins by broadcast if small has at most so many rows, by shuffle otherwise."""
    few = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if few else small.hint("merge"), on, how)


def fresh(df: DataFrame, name: str) -> str:
    """A column name like the one given that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


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


_settled: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def settled(df: DataFrame) -> DataFrame:
    """df, computed once into a Parquet table in the shared folder: lost executors can't lose it, and its lineage ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _settled[out] = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table behind a settled DataFrame that nothing reads any more."""
    if path := _settled.pop(df, None):
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
