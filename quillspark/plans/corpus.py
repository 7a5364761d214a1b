"""A corpus in which every rule has hits: the documents, with injections that one SQL expression makes in either engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.chapters import from_table

_NL = "chr(10)"
#: condition on doc_id, what is replaced, by what (SQL expressions that both engines read alike).
INJECTIONS = [
    ("doc_id % 2 = 0", "' of '", "'  of '"),
    ("doc_id % 3 = 0", "', '", "' , '"),
    ("doc_id % 5 = 0", "' to '", "' in order to '"),
    ("doc_id % 5 = 1", "' and '", "' very '"),
    ("doc_id % 5 = 2", "' in '", "' — '"),
    ("doc_id % 5 = 3", "' on '", "' she said quietly. \"Go  on, \" '"),
    ("doc_id % 5 = 4", "' that '", "' jurassic '"),
    ("doc_id % 13 = 1", "' is '", "' due to the fact that '"),
    ("doc_id % 17 = 2", "' for '", "' what?? '"),
    ("doc_id % 19 = 3", "' with '", "' filled the silence, the quiet kind. '"),
    ("doc_id % 23 = 4", "' be '", "' Garrick, the tall woman '"),
    ("doc_id % 29 = 5", "' was '", "' Then Mara saw he felt '"),
    ("doc_id % 31 = 6", "' the '", "' the grey Grey GREY '"),
    ("doc_id % 11 = 0", f"concat('.', {_NL})", f"concat('. ', {_NL})"),
]


def _body() -> str:
    text = "text"
    for condition, old, new in INJECTIONS:
        text = f"replace({text}, {old}, CASE WHEN {condition} THEN {new} ELSE {old} END)"
    scenes = f"CASE WHEN doc_id % 7 = 0 THEN concat('.', {_NL}, {_NL}, '---', {_NL}, {_NL}) ELSE concat('.', {_NL}) END"
    text = f"replace({text}, concat('.', {_NL}), {scenes})"
    blank = f"CASE WHEN doc_id % 7 = 0 THEN {_NL} ELSE concat({_NL}, {_NL}) END"
    return f"replace({text}, {_NL}, {blank})"


CONTENT = (
    f"concat('---', {_NL}, 'title:  x', {_NL}, '---', {_NL}, {_NL}, '# Doc  ', CAST(doc_id AS STRING), {_NL}, {_NL}, {_body()}, "
    f"CASE WHEN doc_id % 13 = 0 THEN concat({_NL}, {_NL}, '```', {_NL}, 'code  here!!', {_NL}, '```', {_NL}) ELSE '' END)"
)


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents dealt out by their number: a file may be one row group, which one task reads, and what follows takes far longer than reading."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").filter("text is not null")
    return docs.repartition(4 * max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()), "doc_id")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    # A generator of one row: what stands above it reads the text that it made, and doesn't make it again for each use.
    return from_table(docs.select("doc_id", F.explode(F.array(F.expr(CONTENT))).alias("text")))


def raw_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(_documents(spark, sf_dir))
