"""Chapters from Markdown files, tables and strings; glossary and cast from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def title(content: Column, otherwise: Column) -> Column:
    """The first line that starts with "# " when stripped, without it; else the other."""
    heads = F.filter(F.split(content, "\n", -1), lambda x: F.trim(x).startswith("# "))
    return F.coalesce(F.trim(F.substr(F.trim(F.get(heads, F.lit(0))), F.lit(3))), otherwise)


def from_markdown(spark: SparkSession, path: str) -> DataFrame:
    """chapter_number, chapter_path, title, content of a folder's chapter-NNN.md files, or of one file.

    Files with other names are passed over.  Line ends become a single newline; a byte order mark stays."""
    files = spark.read.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(path)
    name = F.col("_metadata.file_name")
    number = F.regexp_extract(name, r"(?i)^chapter-(\d+)\.md$", 1)
    content = F.regexp_replace("value", "\r\n?", "\n")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return (
        files.filter(number != "")
        .select(number.cast("int").alias("chapter_number"), F.col("_metadata.file_path").alias("chapter_path"), content.alias("content"), stem.alias("__stem"))
        .select("chapter_number", "chapter_path", title(F.col("content"), F.col("__stem")).alias("title"), "content")
        .orderBy("chapter_number")
    )


def from_table(df: DataFrame, number: str = "doc_id", text: str = "text") -> DataFrame:
    """Any table with a number and a text as chapters; rows with a null text are passed over."""
    stem = F.concat(F.lit("chapter-"), F.col(number).cast("string"))
    return df.filter(F.col(text).isNotNull()).select(
        F.col(number).alias("chapter_number"), stem.alias("chapter_path"), title(F.col(text), stem).alias("title"), F.col(text).alias("content")
    )


def from_text(spark: SparkSession, text: str, number: int = 1) -> DataFrame:
    return from_table(spark.createDataFrame([(number, text)], "doc_id long, text string"))


GLOSSARY = T.StructType([T.StructField("term", T.StringType()), T.StructField("definition", T.StringType()), T.StructField("aliases", T.ArrayType(T.StringType()))])
CAST_FIELDS = ["slug", "name", "pronouns", "backstory", "arc_summary", "dialogue_voice", "physical_description"]
CAST = T.StructType([
    *(T.StructField(c, T.StringType()) for c in CAST_FIELDS),
    T.StructField("history", T.ArrayType(T.StringType())), T.StructField("voice_wildcards", T.ArrayType(T.StringType())),
    T.StructField("voice_observations", T.ArrayType(T.StructType([T.StructField("note", T.StringType())]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """term, definition, aliases; entries without a term are passed over."""
    return spark.read.schema(GLOSSARY).option("multiLine", True).json(path).filter(F.trim("term") != "")


def cast(spark: SparkSession, path: str) -> DataFrame:
    """One row for each readable character file of a folder."""
    rows = spark.read.schema(CAST).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).filter(F.col("_corrupt_record").isNull() & F.col("name").isNotNull()).drop("_corrupt_record")
