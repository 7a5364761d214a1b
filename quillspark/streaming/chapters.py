"""Rules over chapter files that arrive in a folder.  Chapters don't depend on each other, so no state is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.chapters import title


def arriving(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """A stream of chapter_number, chapter_path, title, content."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", "*.md").load(path)
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"(?i)^chapter-(\d+)\.md$", 1)
    named = files.select(number.alias("n"), name.alias("name"), F.col("_metadata.file_path").alias("chapter_path"), F.regexp_replace("value", "\r\n?", "\n").alias("content")).filter("n <> ''")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    return named.select(F.col("n").cast("int").alias("chapter_number"), "chapter_path", title(F.col("content"), stem).alias("title"), "content")


def check_arriving(chapters: DataFrame, rules: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Appends the findings of every batch of chapters as Parquet; a batch that is run again replaces its own files."""

    def each(batch: DataFrame, number: int) -> None:
        rules(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chapters.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
