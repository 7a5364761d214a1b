"""Line deduplication by site-relative frequency.

For each host, the number of its pages that contain a line is divided by the
number of its pages; lines above a boilerplate ratio are dropped from all its
pages.  Only DataFrame functions are used.

Lines are told apart by 64-bit hashes.  Defined results: blank lines and rows
with a null host or a null text are left as they are (a page with a null text
still counts as a page of its host).  A line that repeats within a page counts
once for the page, and every copy of it goes.  Repeated rows are pages of
their own.  A page of which nothing remains keeps its row, with an empty text.
All columns of the input are returned as they are but for the text; of the two
that are added, one whose name is taken gets an underscore before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, settled, small_join, table

#: A line is boilerplate if more than this share of its host's pages have it, and at least MIN_PAGES do.
MAX_RATIO = 0.1
MIN_PAGES = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blank(line: Column) -> Column:
    return F.trim(line) == ""


def boilerplate(pages: DataFrame, host: str, text: str, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Per host with boilerplate: the host, and the hashes of its boilerplate lines.

    A host has at most (its mean number of lines a page) / max_ratio of them, so that the arrays stay short."""
    of_host = pages.filter(F.col(host).isNotNull()).select(F.col(host).alias("__host"), F.col(text).alias("__text"))
    totals = of_host.groupBy("__host").agg(F.count("*").alias("__pages"))
    hashes = F.array_distinct(F.transform(F.filter(_lines(F.col("__text")), lambda x: ~_blank(x)), lambda x: F.xxhash64(x)))
    counts = of_host.select("__host", F.explode(hashes).alias("__line")).groupBy("__host", "__line").agg(F.count("*").alias("__with"))
    frequent = small_join(counts.filter(F.col("__with") >= min_pages), totals, ["__host"], "inner").filter(F.col("__with") > max_ratio * F.col("__pages"))
    return frequent.groupBy("__host").agg(F.collect_list("__line").alias("__drop"))


def dedup_lines(pages: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with boilerplate lines dropped from the text, and n_lines and n_dropped."""
    site, listed, kept = (fresh(pages, c) for c in ("__host", "__drop", "__kept"))
    drop = settled(boilerplate(pages, host, text, max_ratio, min_pages)).toDF(site, listed)
    joined = small_join(pages.withColumn(site, F.col(host)), drop, [site], "left")
    lines = _lines(F.col(text))
    left = F.filter(lines, lambda x: _blank(x) | ~F.array_contains(F.col(listed), F.xxhash64(x)))
    body = joined.withColumn(kept, F.when(F.col(listed).isNull() | F.col(text).isNull(), lines).otherwise(left))
    count = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    return body.select(
        *(F.when(F.col(text).isNotNull(), F.concat_ws("\n", kept)).alias(text) if c == text else F.col(f"`{c}`") for c in pages.columns),
        count(F.size(lines)).alias(fresh(pages, "n_lines")),
        count(F.size(lines) - F.size(kept)).alias(fresh(pages, "n_dropped")),
    )


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: boilerplate lines go from the texts; every document stays, with its new length; other columns are kept as they are."""
    out = dedup_lines(docs)
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.withColumn("n_chars", length).select(*(F.col(f"`{c}`") for c in docs.columns))


SQL_LINES = f"""
d AS (SELECT row_number() OVER () AS rid, * FROM {{docs}}),
l AS (SELECT DISTINCT rid, source, unnest(string_split(text, chr(10))) AS line FROM d WHERE source IS NOT NULL),
t AS (SELECT source, count(*) AS pages FROM d WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT source, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY source, line),
b AS (SELECT f.source, list(f.line) AS lines FROM f JOIN t USING (source)
      WHERE n >= {MIN_PAGES} AND n > {MAX_RATIO} * pages GROUP BY f.source),
c AS (SELECT d.*, string_split(d.text, chr(10)) AS before,
             list_filter(string_split(d.text, chr(10)), lambda x: trim(x) = '' OR b.lines IS NULL OR NOT list_contains(b.lines, x)) AS after
      FROM d LEFT JOIN b USING (source))
"""

SQL = f"""WITH {SQL_LINES.format(docs="documents")}
SELECT doc_id, source, array_to_string(after, chr(10)) AS text,
       coalesce(len(before), 0)::BIGINT AS n_lines, coalesce(len(before) - len(after), 0)::BIGINT AS n_dropped
FROM c"""
