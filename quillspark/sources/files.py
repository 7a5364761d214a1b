"""Single files that take the place of others together, and folders of texts written by tasks."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import files_of


def arrow_files(folder: str):
    """Arrow's file system of a folder that Hadoop names, and the folder as it names it."""
    import pyarrow.fs

    scheme, _, rest = folder.partition(":")
    # Hadoop writes file:/x where others write file:///x.
    return pyarrow.fs.FileSystem.from_uri(f"file://{'/' + rest.lstrip('/')}" if scheme == "file" else folder)


def publish(spark: SparkSession, paths: list[str], write: Callable[[object], None]) -> None:
    """Writes every path, or leaves what was there before.

    write gets an output stream.  Each file is written beside its place; then old files step aside, new ones take their
    places, and only when all have do the old ones go.  After a failure the old ones come back."""
    made = []
    try:
        for path in paths:
            files, final = files_of(spark, path)
            beside = lambda what, final=final: spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}-{what}-{uuid.uuid4().hex}")
            entry = {"files": files, "final": final, "staged": beside("new"), "old": beside("old"), "aside": False, "placed": False}
            made.append(entry)
            files.mkdirs(final.getParent())
            stream = files.create(entry["staged"], True)
            try:
                write(stream)
            finally:
                stream.close()
        for e in made:
            if e["files"].exists(e["final"]):
                _rename(e["files"], e["final"], e["old"])
                e["aside"] = True
            _rename(e["files"], e["staged"], e["final"])
            e["placed"] = True
    except BaseException:
        for e in reversed(made):
            if e["placed"]:
                e["files"].delete(e["final"], False)
            if e["aside"]:
                _rename(e["files"], e["old"], e["final"])
            e["files"].delete(e["staged"], False)
        raise
    for e in made:
        e["files"].delete(e["old"], False)


def _rename(files, old, new) -> None:
    if not files.rename(old, new):
        raise OSError(f"{new.toString()} can't be written")


def _texts(batches: Iterator[pa.RecordBatch], folder: str):
    files, root = arrow_files(folder)
    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            own = f"{root}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(own) as f:
                f.write((text or "").encode())
            # A task that is run again puts the same file in its place.
            files.move(own, f"{root}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["n"])


def write_texts(rows: DataFrame, folder: str) -> int:
    """rows (name, text): a file of that name for each, in a new folder, which is there when all are; how many. Names tell the rows apart."""
    spark = rows.sparkSession
    files, final = files_of(spark, folder)
    if files.exists(final):
        raise FileExistsError(f"{folder} is there already")
    staged = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}")
    files.mkdirs(staged)
    try:
        written = rows.select("name", "text").mapInArrow(partial(_texts, folder=staged.toString()), "n long").groupBy().sum("n").first()[0] or 0
        if files.listStatus(staged) is not None and rows.select("name").distinct().count() != written:
            raise ValueError("two rows have one name")
        _rename(files, staged, final)
    except BaseException:
        files.delete(staged, True)
        raise
    return written
