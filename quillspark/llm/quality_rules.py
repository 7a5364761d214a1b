"""Quality rules: exact base rules, then importance weights of hashed n-grams.

Every document is scored by the mean log-likelihood ratio of its hashed word
unigrams and bigrams between two multinomials: trusted-target text (documents
labelled as good) and the raw corpus (all documents), both counted over whole
tables.  A fixed threshold decides.  Only DataFrame functions are used.

Defined results: a null or empty text has no words, all counts 0, base_failed
true, kept false and a null llr.  Repeated rows are counted and judged one by
one.  A document labelled more than once is trusted if any of its labels is
good.  If nothing is trusted the ratio is 0 for each n-gram and the base rules
decide alone.  Columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, small_join, table

BUCKETS = 1 << 16
#: Added to each bucket's count in both multinomials.
SMOOTHING = 1.0
#: A document whose mean log-likelihood ratio is below this goes.
MIN_LLR = -0.25
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
SYMBOLS = "[#*$%&|<>]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spaced(text: Column) -> Column:
    """Each of 0x09-0x0D as a space."""
    for code in range(0x09, 0x0E):
        text = F.replace(text, F.lit(chr(code)), F.lit(" "))
    return text


def hash_words(text: Column) -> Column:
    """The 64-bit hash of each word, in order."""
    return F.transform(F.array_remove(F.split(spaced(text), " ", -1), ""), lambda w: F.xxhash64(w))


def _shift(values: Column, by: int) -> Column:
    return F.slice(values, by + 1, F.greatest(F.size(values) - by, F.lit(0)))


def _paired(values: Column, others: Column) -> Column:
    """A hash of each value and the one at the same place of others, which may be shorter (then null takes its place)."""
    return F.zip_with(values, others, lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """How many words of an array of hashes lie in a 5-word window that occurs twice or more."""

    def windows(pairs: Column) -> Column:
        fives = _paired(_paired(pairs, _shift(pairs, 2)), _shift(words, 4))
        return F.slice(fives, 1, F.size(words) - 4)

    def covered(at: Column) -> Column:
        steps = F.zip_with(at, _shift(at, 1), lambda p, q: F.least(F.lit(5), F.coalesce(q - p, F.lit(5))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, n: total + n)

    def counted(g: Column) -> Column:
        # A key holds as much of the hash as leaves room for the place, so that equal windows are neighbours when sorted.
        n = F.size(g).cast("long")
        keys = _let(F.floor(F.lit(1 << 62) / n).cast("long"), lambda room: F.sort_array(
            F.transform(g, lambda h, i: F.coalesce(F.pmod(h, room) * n + i, F.lit(0).cast("long")))
        ))

        def repeats(s: Column) -> Column:
            at = F.transform(s, lambda x: F.pmod(x, n).cast("int"))
            return _let(at, lambda p: _let(F.transform(p, lambda i: F.get(g, i)), lambda h: F.sort_array(F.transform(
                F.filter(p, lambda i, k: F.coalesce(F.get(h, k) == F.get(h, k + 1), F.lit(False)) | F.coalesce(F.get(h, k) == F.get(h, k - 1), F.lit(False))),
                lambda i: F.coalesce(i, F.lit(0)),
            ))))

        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("long")).otherwise(_let(_let(keys, repeats), covered))

    return F.when(F.size(words) <= 5, F.lit(0).cast("long")).otherwise(_let(_let(_paired(words, _shift(words, 1)), windows), counted))


def base_columns(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.replace(spaced(text), F.lit(" "), F.lit(""))).cast("long"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(words),
    }


def grams(df: DataFrame, words: str) -> DataFrame:
    """A row for each word of each row of df, with the buckets of the word and of it and the next; one with nulls if it has no word."""
    mask = F.lit(BUCKETS - 1)
    zipped = F.arrays_zip(F.col(words).alias("a"), _shift(F.col(words), 1).alias("b"))
    rows = df.withColumn("__g", F.explode_outer(zipped)).drop(words)
    one, two = F.col("__g")["a"], F.col("__g")["b"]
    return rows.withColumns({
        "uni": one.bitwiseAND(mask),
        "bi": F.when(two.isNotNull(), F.xxhash64(one, two).bitwiseAND(mask)),
    }).drop("__g")


def log_ratios(docs: DataFrame, trusted: DataFrame, key: str, text: str) -> DataFrame:
    """The log-likelihood ratio of each bucket: BUCKETS rows whatever the corpus is."""
    good = trusted.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__good", F.lit(True))
    flagged = small_join(docs.select(key, text), good, [key], "left").select(
        F.coalesce("__good", F.lit(False)).alias("good"), hash_words(F.coalesce(text, F.lit(""))).alias("words")
    )
    counts = settled(
        grams(flagged, "words").select("good", F.explode(F.array("uni", "bi")).alias("bucket")).filter("bucket is not null")
        .groupBy("bucket", "good").agg(F.count("*").alias("n"))
        .groupBy("bucket").agg(F.sum("n").alias("raw"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("target"))
    )
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket")).join(F.broadcast(counts), "bucket", "left").fillna(0)
    totals = counts.agg(F.sum("raw").alias("raws"), F.sum("target").alias("targets"))
    flat = SMOOTHING * BUCKETS
    target = F.log((F.col("target") + SMOOTHING) / (F.col("targets") + flat))
    raw = F.log((F.col("raw") + SMOOTHING) / (F.col("raws") + flat))
    llr = F.when(F.col("targets") > 0, target - raw).otherwise(0.0)
    return every.join(F.broadcast(totals), how="cross").select("bucket", llr.alias("llr"))


def quality_rules(docs: DataFrame, trusted: DataFrame, key: str = "doc_id", text: str = "text", min_llr: float = MIN_LLR) -> DataFrame:
    """Per row of docs: the id, the base counts, base_failed, llr (mean log-likelihood ratio of its n-grams) and kept."""
    ratios = settled(log_ratios(docs, trusted, key, text))
    body = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.coalesce(text, F.lit("")).alias("__text"))
    words = body.withColumn("__words", hash_words(F.col("__text")))
    counted = words.withColumns(base_columns(F.col("__text"), F.col("__words"))).drop("__text")
    names = [c for c in counted.columns if c not in ("__row", "__words")]
    scored = (
        grams(counted, "__words")
        .join(F.broadcast(ratios.toDF("uni", "__u")), "uni", "left")
        .join(F.broadcast(ratios.toDF("bi", "__b")), "bi", "left")
        .groupBy("__row")
        .agg(*(F.first(c).alias(c) for c in names), (F.sum(F.coalesce("__u", F.lit(0.0)) + F.coalesce("__b", F.lit(0.0))) / F.nullif(F.count("uni") + F.count("bi"), F.lit(0))).alias("llr"))
    )
    out = scored.select(F.col("__key").alias(key), *names[1:], F.when(F.col("n_words") > 0, F.col("llr")).alias("llr"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.coalesce("llr", F.lit(0.0)) >= min_llr))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    return quality_rules(table(spark, sf_dir, "documents"), trusted)
