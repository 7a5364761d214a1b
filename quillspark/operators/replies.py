"""Replies of outside models, each prompt asked once.

A reply is stored under the hash of its role and prompt as soon as it is there,
so that a task that is run again after a failure, a second action and a later
run find it and don't ask again.  Within a run each distinct prompt is in one
task.  When a run is done its replies are a table, and the single files go.

A store is a folder that driver and executors share; executors write to it
through Arrow's file systems.  Two attempts of one task at the same time (speculative
ones) may both ask; they are off by default.
"""

from __future__ import annotations

import asyncio
import inspect
import uuid
from collections.abc import Awaitable, Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import files_of
from ..sources.files import arrow_files

#: Calls that a task makes at the same time.
AT_ONCE = 4
Model = Callable[[str], "str | None | Awaitable[str | None]"]


def _stored(files, path: str) -> str | None:
    try:
        with files.open_input_stream(path) as f:
            return f.read().decode()
    except FileNotFoundError:
        return None


def _store(files, path: str, reply: str) -> None:
    own = f"{path}-{uuid.uuid4().hex}"
    with files.open_output_stream(own) as f:
        f.write(reply.encode())
    files.move(own, path)


async def _replies(prompts: list[tuple[str, str]], model: Model, pending: str, strict: bool) -> list[str | None]:
    files, root = arrow_files(pending)
    gate = asyncio.Semaphore(AT_ONCE)

    async def one(name: str, prompt: str) -> str | None:
        path = f"{root}/{name}"
        if (known := _stored(files, path)) is not None:
            return known
        async with gate:
            try:
                reply = await model(prompt) if inspect.iscoroutinefunction(model) else await asyncio.to_thread(model, prompt)
            except Exception:  # noqa: BLE001  a model is a guest: what it raises concerns its own prompt only, unless all are wanted
                if strict:
                    raise
                return None
        if reply is not None:
            _store(files, path, reply)
        return reply

    return await asyncio.gather(*(one(name, prompt) for name, prompt in prompts))


def _ask(batches, model: Model, pending: str, strict: bool):
    for batch in batches:
        names, prompts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        got = asyncio.run(_replies(list(zip(names, prompts)), model, pending, strict))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, type=pa.string())], names=["hash", "reply"])


def ask_once(requests: DataFrame, model: Model, store: str, role: str, strict: bool = False, tasks: int | None = None) -> DataFrame:
    """requests with reply, the model's answer to their prompt; null for a null prompt and where the model failed (with strict, its error is raised).

    requests: prompt and any other columns.  What failed isn't stored and is asked again by the next run."""
    spark: SparkSession = requests.sparkSession
    named = requests.withColumn("__hash", F.sha2(F.concat(F.lit(f"{role}\x00"), F.col("prompt")), 256))
    files, folder = files_of(spark, f"{store}/{role}")
    table, pending = (spark._jvm.org.apache.hadoop.fs.Path(folder, name) for name in ("table", "pending"))
    files.mkdirs(pending)
    todo = named.filter("prompt is not null").select(F.col("__hash").alias("hash"), "prompt").dropDuplicates(["hash"])
    if files.exists(table):
        todo = todo.join(spark.read.schema("hash string, reply string").parquet(table.toString()), "hash", "left_anti")
    dealt = todo.repartition(tasks or spark.sparkContext.defaultParallelism, "hash")
    said = dealt.mapInArrow(partial(_ask, model=model, pending=pending.toString(), strict=strict), "hash string, reply string")
    said.filter("reply is not null").write.mode("append").parquet(table.toString())
    files.delete(pending, True)
    known = spark.read.schema("hash string, reply string").parquet(table.toString()).withColumnRenamed("hash", "__hash")
    return named.join(known, "__hash", "left").drop("__hash")
