"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer documents are not learned from, so that a sample of so many rows is of a bounded size.
MAX_SAMPLE_CHARS = 50_000


def labelled(docs: DataFrame, labels: DataFrame, label: str, usable: Column, key: str, text: str, rows: int) -> DataFrame:
    """key, text, __label: one document of each of at most ``rows`` labelled ids that are usable, in the order of their ids.

    Half of the sample may be of label 1 and half of label 0; of each label those
    ids are taken whose hashes are the smallest, so that the sample is the same in
    each run.  An id with several labels counts as 1 if one of them is 1, an id
    with several texts is learned by the least of them; null ids, labels and texts
    and documents of more than MAX_SAMPLE_CHARS characters are passed over."""
    clean = labels.filter(usable & F.col(label).isNotNull() & F.col(key).isNotNull())
    one = clean.groupBy(key).agg(F.max(label).cast("int").alias("__label"))
    picked = None
    for value in (0, 1):
        part = one.filter(F.col("__label") == value).orderBy(F.xxhash64(key), key).limit(rows // 2)
        picked = part if picked is None else picked.unionByName(part)
    # At most ``rows`` ids and labels: a fixed size.
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in picked.collect()], picked.schema)
    fit = docs.select(key, text).filter(F.length(text) <= MAX_SAMPLE_CHARS)
    return fit.join(F.broadcast(chosen), key).groupBy(key).agg(F.min(text).alias(text), F.first("__label").alias("__label")).orderBy(key)
