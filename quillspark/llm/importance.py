"""Importance resampling towards a target distribution, on hashed n-grams.

Each document is weighed by how much more often its n-grams' buckets occur in a
target corpus than in the raw one, and documents are drawn without replacement
by adding Gumbel noise that depends on the id alone: the highest scores are a
sample in proportion to the weights, the same in each run.

Within a partition DuckDB does the text: blocks of an Arrow batch are tables to
it, SQL takes the words, unnests them, makes longer n-grams by a window, and
buckets the distinct ones by a registered function, zlib's CRC.  What it gives
is the buckets of each document with their counts; they are spilled to Parquet
in the shared folder, and all that follows is Spark's: counts are merged over
all documents, gains are computed for each bucket, each document is scored from
its own counts, without its text, and the highest scores are ranked.

The rank needs no sort in one task: scores are whole numbers, the table of how
many documents have each score is bounded by their range, and only documents of
one score are sorted among themselves.

Defined results: a null or empty text has no features and weight 0; a null id
has no noise, so that such a row has a weight and neither a score nor a rank
and doesn't count towards what is drawn; repeated rows are drawn each for
itself, in any order among themselves.  With no target text all counts are 0
there.  Extra columns are neither read nor returned.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import crcsql
from .common import discard, settled, small_batches, small_join, table
from .textvec import blocks

#: Runs of digits, letters and all beyond ASCII; only A-Z is lowered.
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: Characters of the texts that are one table to DuckDB.
BLOCK_CHARS = 4_000_000


@dataclass(frozen=True)
class Settings:
    """Features are runs of 1 to longest words in ``buckets`` buckets; ``percent`` of the documents with at least least_words words are drawn, with the noise of a seed."""

    longest: int = 1
    buckets: int = 10_000
    percent: int = 10
    least_words: int = 20
    seed: int = 2024


def features_sql(longest: int, buckets: int) -> str:
    """SQL over texts (rid, text): rid, n_words, n_features, and the buckets of its features with their counts."""
    grams = ["SELECT rid, pos, word AS gram FROM words"]
    if longest > 1:
        ahead = "".join(f", lead(word, {k}) OVER (PARTITION BY rid ORDER BY pos) AS w{k}" for k in range(1, longest))
        grams = [f"SELECT rid, pos, concat_ws(' ', {', '.join(['word', *(f'w{i}' for i in range(1, k))])}) AS gram FROM runs" + (f" WHERE w{k - 1} IS NOT NULL" if k > 1 else "") for k in range(1, longest + 1)]
        runs = f"runs AS (SELECT rid, pos, word{ahead} FROM words), "
    else:
        runs = ""
    return f"""
WITH taken AS (SELECT rid, regexp_extract_all(text, '{WORD}') AS found FROM texts),
words AS (SELECT rid, unnest(found) AS word, unnest(range(len(found))) AS pos FROM taken),
{runs}grams AS ({' UNION ALL '.join(grams)}),
per AS (SELECT rid, gram, count(*) AS n FROM grams GROUP BY rid, gram),
hashed AS (SELECT gram, crc(translate(gram, '{CAPITALS}', '{CAPITALS.lower()}')) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM per)),
counted AS (SELECT rid, bucket, sum(n)::BIGINT AS n FROM per JOIN hashed USING (gram) GROUP BY rid, bucket),
listed AS (SELECT rid, sum(n)::BIGINT AS n_features, list(bucket::INTEGER) AS buckets, list(n::INTEGER) AS counts FROM counted GROUP BY rid)
SELECT rid, len(found)::BIGINT AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
       coalesce(buckets, []::INTEGER[]) AS buckets, coalesce(counts, []::INTEGER[]) AS counts
FROM taken LEFT JOIN listed USING (rid) ORDER BY rid"""


def _crc(words: pa.ChunkedArray) -> pa.Array:
    column = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    return pa.array([zlib.crc32(w) for w in column.cast(pa.binary()).to_pylist()], type=pa.int64())


def _count(batches, sql: str):
    """The bucket counts of each row, by a DuckDB of this partition."""
    import duckdb

    # It holds one block at a time and never writes to a disk of its own.
    db = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
    db.create_function("crc", _crc, ["VARCHAR"], "BIGINT", type="arrow")
    try:
        for batch in batches:
            texts = batch.column(1).fill_null("") if batch.num_rows else batch.column(1)
            sizes = [range(n) for n in pa.compute.binary_length(texts).to_pylist()]
            for a, b in blocks(sizes, BLOCK_CHARS):
                block = pa.table({"rid": pa.array(np.arange(b - a)), "text": texts.slice(a, b - a)})
                db.register("texts", block)
                out = db.sql(sql).to_arrow_table().combine_chunks()
                db.unregister("texts")
                columns = [out.column(c).combine_chunks() if out.column(c).num_chunks != 1 else out.column(c).chunk(0) for c in ("n_words", "n_features", "buckets", "counts")]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *columns], names=[batch.schema.names[0], "n_words", "n_features", "buckets", "counts"])
    finally:
        db.close()


def bucket_counts(texts: DataFrame, key: str, text: str, settings: Settings = Settings()) -> DataFrame:
    """Per row: key, n_words, n_features, buckets and counts (of its features). Spilled as a table: it is merged first, then scored."""
    small_batches(texts.sparkSession)
    kind = texts.schema[key].dataType.simpleString()
    sql = features_sql(settings.longest, settings.buckets)
    return settled(texts.select(key, text).mapInArrow(partial(_count, sql=sql), f"`{key}` {kind}, n_words long, n_features long, buckets array<int>, counts array<int>"))


def merged(spilled: DataFrame) -> DataFrame:
    """bucket, n: counts of all rows together, at most one row for each bucket."""
    pairs = spilled.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """For each bucket 1000 times the log of its share of the target over its share of the raw corpus, one added to each count, rounded down.

    The list has one number for each bucket, whatever the size of the corpora."""
    every = raw.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    one = every.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").select("bucket", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in "st"))
    totals = one.agg(F.sum("s").alias("S"), F.sum("t").alias("T")).first()
    d = lambda c: c.cast("double")
    ratio = d(F.col("t") + 1) * d(F.lit(totals["S"] + buckets)) / (d(F.col("s") + 1) * d(F.lit(totals["T"] + buckets)))
    return [r[0] for r in one.select(F.floor(1000 * F.log(ratio)), "bucket").orderBy("bucket").collect()]


def _floored(total: Column, n: Column) -> Column:
    """total / n rounded down, in whole numbers."""
    return ((total - F.pmod(total, n)) / n).cast("long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise of a key in thousandths, rounded down; null for a null key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def scored(spilled: DataFrame, gain: list[int], key: str, seed: int) -> DataFrame:
    """spilled with weight and score."""
    # One constant array, folded once: a number for each bucket.
    table_ = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate(F.zip_with("buckets", "counts", lambda b, n: F.get(table_, b) * n), F.lit(0).cast("long"), lambda a, x: a + x)
    weight = F.when(F.col("n_features") > 0, _floored(F.col("total"), F.col("n_features"))).otherwise(F.lit(0).cast("long"))
    rows = spilled.withColumn("total", total).withColumn("weight", weight)
    return rows.select(key, "n_words", "n_features", "weight", (F.col("weight") + noise(F.col(key), seed)).alias("score"))


def drawn(rows: DataFrame, key: str, percent: int, least_words: int) -> DataFrame:
    """rows (settled) with rank: 1, 2, 3... of the percent with the highest scores, ties to smaller keys; null for the others."""
    may = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    # A row for each score: their range is that of the gains and the noise, not that of the documents.
    per = sorted(((r["score"], r["n"]) for r in rows.filter(may).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    left = sum(n for _, n in per) * percent // 100
    before, last = [], None
    at = 0
    for score, n in per:
        if at >= left:
            break
        before.append((score, at))
        last, at = score, at + n
    if last is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    ahead = rows.sparkSession.createDataFrame(before, "score long, ahead long")
    best = F.when(may & (F.col("score") >= last), F.row_number().over(Window.partitionBy("score").orderBy(F.col(key), "n_features", "weight")))
    of_best = small_join(rows.filter(may & (F.col("score") >= last)), ahead, ["score"], "inner").withColumn("rank", F.col("ahead") + best.cast("long")).drop("ahead")
    ranked = of_best.withColumn("rank", F.when(F.col("rank") <= left, F.col("rank")))
    rest = rows.filter(~F.coalesce(may & (F.col("score") >= last), F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_key: str = "item_id", target_text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Every row of docs: key, n_words, n_features, weight, score, and rank if it is drawn."""
    own = bucket_counts(docs, key, text, settings)
    wanted = bucket_counts(target, target_key, target_text, settings)
    gain = gains(merged(own), merged(wanted), settings.buckets)
    discard(wanted)
    rows = settled(scored(own, gain, key, settings.seed))
    discard(own)
    return drawn(rows, key, settings.percent, settings.least_words).select(key, "n_words", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


_S = Settings()


def _sql_counts(name: str, source: str, key: str) -> str:
    return f"""{name}_words AS (SELECT {key}, unnest(regexp_extract_all(translate(text, '{CAPITALS}', '{CAPITALS.lower()}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM {source}),
{name}_counts AS (SELECT word, count(*) AS n FROM {name}_words GROUP BY word),
{name}_buckets AS (SELECT {crcsql.crc32("word")} % {_S.buckets} AS bucket, sum(n)::BIGINT AS n FROM {name}_counts, crc_table GROUP BY 1)"""


SQL = f"""WITH {crcsql.TABLE},
{_sql_counts("raw", "documents", "doc_id")},
{_sql_counts("target", "benchmark", "item_id")},
totals AS (SELECT (SELECT coalesce(sum(n), 0)::BIGINT FROM raw_buckets) AS S, (SELECT coalesce(sum(n), 0)::BIGINT FROM target_buckets) AS T),
gains AS (SELECT b.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (S + {_S.buckets})::DOUBLE / ((coalesce(r.n, 0) + 1)::DOUBLE * (T + {_S.buckets})::DOUBLE)))::BIGINT AS gain
          FROM range({_S.buckets}) b(bucket) LEFT JOIN raw_buckets r USING (bucket) LEFT JOIN target_buckets t USING (bucket), totals),
word_gains AS (SELECT word, gain FROM (SELECT word, {crcsql.crc32("word")} % {_S.buckets} AS bucket FROM raw_counts, crc_table) JOIN gains USING (bucket)),
per AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM raw_words JOIN word_gains USING (word) GROUP BY doc_id),
weighed AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features,
                   coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) AS weight FROM documents d LEFT JOIN per USING (doc_id)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{_S.seed}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM weighed),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, {_S.percent} * count(*) OVER () // 100 AS most FROM scored WHERE n_features >= {_S.least_words})
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score, CASE WHEN place <= most THEN place END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""
