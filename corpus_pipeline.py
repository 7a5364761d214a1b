"""The corpus pipeline: five stages, each over all that the one before it kept.

All stages take tables without rows, rows with nulls in any column, repeated
rows and extra columns of any name: extra columns pass unread through all but
the last stage, which doesn't return them, and what becomes of null and empty
texts and of repeated rows each stage's function states.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.common import shared_dir, table
from quillspark.llm.decontamination import drop_contaminated
from quillspark.llm.jaccard_join import one_of_each
from quillspark.llm.language_id import keep_identified
from quillspark.llm.line_dedup import clean_lines
from quillspark.llm.pieces import encode_documents

STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", clean_lines),
    ("ngram_jaccard", one_of_each),
    ("decontamination", drop_contaminated),
    ("sentencepiece", encode_documents),
]

#: Learned languages, verified similarity and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage gives is written as Parquet in the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
