"""Substring deduplication by MinHash banding of short paragraphs.

A paragraph here ends with a line or with a sentence mark of any script (and
closing quotes or brackets after it) before white space, so that a passage is
cut alike wherever it is pasted.  What is longer than LONG words is cut by its
content: after the words whose hash, with that of their next two, is the least
within REACH words, so that a cut moves with the passage and one that lies
within a long line is found but for its edges.  Paragraphs that share a
band collide; colliding paragraphs with different words are verified by the
exact Jaccard similarity of their 5-word shingles; links make components, and
each component that is not of one document alone keeps its first paragraph and
gives up the others.  Adjoining
repeated paragraphs are reported as one passage if they have MIN_WORDS words
or more, which leaves headings and licence lines alone.

Bands have one row each: a paragraph of fewer than 8 words can only match an
equal one and has one band; others have BANDS, which miss a pair of similarity
0.8 with a probability of 0.2 ** BANDS, and an equal one never.  Within a
bucket every pair of different texts is verified that is not in one component
by then: texts that share most meet the others first, and large buckets are
dealt in pairs of chunks.  A pair is verified where the bucket is read, so
that only links leave it, fewer than it has texts.  Equal paragraphs of a
block of rows take part as one, and so do those of a bucket.

Defined results: null and empty texts and paragraphs of fewer than 5 words
take no part, and short ones don't part their neighbours.  Repeated rows are
documents of their own.  Ties are broken by id, then by place.  Columns other
than id and text are neither read nor returned.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, settled, small_batches, small_join, table
from .components import connected_components
from .textvec import Words, as_bytes, blocks, mix, windows

SHINGLE = 5
NEAR_WORDS = 8
BANDS = 3
PERCENT = 80
MIN_WORDS = 20
#: Paragraphs of more words are cut by content, where a hash is the least of so many words on both sides.
LONG, REACH = 64, 5
#: Words of a chunk of a large bucket.
CHUNK_WORDS = 50_000
#: What ends a sentence, and what may stand behind it.
MARKS = [m.encode() for m in ".!?…。！？｡।॥؟۔።"]
CLOSERS = [c.encode() for c in "\"')]}>*_”’»」』）"]


#: Last bytes of these: most words end with none of them.
_MAY_END = np.zeros(256, dtype=bool)
_MAY_END[[x[-1] for x in (*MARKS, *CLOSERS)]] = True


def _ends_with(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, what: bytes) -> np.ndarray:
    """Whether the bytes from start to stop end with what."""
    out = stop - start >= len(what)
    for i, byte in enumerate(reversed(what)):
        out &= buf[stop - 1 - i] == byte
    return out


def sentence_ends(words: Words) -> np.ndarray:
    """Whether each word ends a sentence."""
    out = np.zeros(len(words.end), dtype=bool)
    at = np.flatnonzero(_MAY_END[words.buf[words.end - 1]])
    start, stop = words.start[at], words.end[at]
    for _ in range(3):
        before = stop.copy()
        for closer in CLOSERS:
            stop = stop - len(closer) * _ends_with(words.buf, start, before, closer)
        if (before == stop).all():
            break
    for mark in MARKS:
        out[at] |= _ends_with(words.buf, start, stop, mark)
    return out


def content_cuts(h: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Words after which a run of more than LONG words is cut. last: the words that end a run."""
    m = len(h)
    head = np.flatnonzero(np.concatenate(([True], last[:-1])))
    size = np.diff(np.append(head, m))
    cut = np.zeros(m, dtype=bool)
    run = np.repeat(np.arange(len(head)), size)
    at = np.flatnonzero(size[run] > LONG)
    if not len(at):
        return cut
    value = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    whole = at[at < m - 2]
    value[whole] = mix(mix(h[whole]) + mix(h[whole + 1] + np.uint64(1)) * np.uint64(3) + h[whole + 2] * np.uint64(5))
    at = at[~last[at]]
    for step in range(1, REACH + 1):
        at = at[(at >= step) & (at + step < m)]
        # Of equal ones the first counts; near the ends of a run nothing is cut, so that no piece is shorter than REACH.
        at = at[(run[at - step] == run[at]) & (run[at + step] == run[at])]
        at = at[(value[at] < value[at - step]) & (value[at] <= value[at + step])]
    cut[at] = True
    return cut


class Paragraphs:
    """Paragraphs of at least SHINGLE words: doc, seq (among those of the doc), first word and word count, hash, shingles."""

    def __init__(self, texts: list[bytes]):
        self.words = words = Words(texts)
        self.h = h = words.hashes()
        m = len(h)
        lines = np.cumsum(words.buf == 10)
        last = np.zeros(m, dtype=bool)
        if m:
            last[-1] = True
            last[:-1] = sentence_ends(words)[:-1] | (lines[words.start[1:]] > lines[words.end[:-1] - 1])
            last |= content_cuts(h, last)
        head = np.flatnonzero(np.concatenate(([True], last[:-1]))) if m else np.zeros(0, np.int64)
        size = np.diff(np.append(head, m))
        keep = size >= SHINGLE
        self.first, self.size = head[keep], size[keep]
        self.doc = np.searchsorted(words.first, self.first, "right") - 1
        n = np.bincount(self.doc, minlength=len(texts))
        self.seq = np.arange(len(self.doc)) - np.repeat(np.cumsum(n) - n, n)
        self.count = self.size - SHINGLE + 1
        self.at = np.cumsum(self.count) - self.count
        where = np.arange(self.count.sum()) - np.repeat(self.at, self.count) + np.repeat(self.first, self.count)
        self.shingles = windows(h, SHINGLE)[where]
        self.hash = mix(np.add.reduceat(mix(self.shingles), self.at) + self.size.astype(np.uint64)) if len(self.at) else np.zeros(0, np.uint64)

    def minima(self, band: int) -> np.ndarray:
        seed = mix(np.array([band + 1], dtype=np.uint64))[0]
        return mix(np.minimum.reduceat(mix(self.shingles ^ seed), self.at) + np.uint64(band)) if len(self.at) else self.hash

    def chars(self) -> tuple[np.ndarray, np.ndarray]:
        """Code points at which each starts and ends within its text."""
        buf = self.words.buf
        points = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
        base = points[self.words.offset[self.doc]]
        return points[self.words.start[self.first]] - base, points[self.words.end[self.first + self.size - 1]] - base


NAMES = ["key", "local", "row", "seq", "hash", "words", "start", "end"]
KEYED = "key long, local boolean, row long, seq int, hash long, words int, start int, end int"


def _banded(batches):
    """A row for each band of the first of equal paragraphs of a block; one without a key for each other of them."""
    for batch in batches:
        texts = as_bytes(batch.column(1))
        rows = batch.column(0).to_numpy()
        for a, b in blocks(texts, 8_000_000):
            p = Paragraphs(texts[a:b])
            if not len(p.hash):
                continue
            _, sample, count = np.unique(p.hash, return_index=True, return_counts=True)
            several = np.zeros(len(p.hash), dtype=bool)
            several[sample] = count > 1
            lead = np.zeros(len(p.hash), dtype=bool)
            lead[sample] = True
            start, end = p.chars()
            columns = [rows[a:b][p.doc], p.seq, p.hash.view(np.int64), p.size, start, end]
            short, long_ = np.flatnonzero(lead & (p.size < NEAR_WORDS)), np.flatnonzero(lead & (p.size >= NEAR_WORDS))
            parts = [(short, p.hash[short]), *((long_, p.minima(band)[long_]) for band in range(BANDS))]
            at = np.concatenate([i for i, _ in parts])
            key = np.concatenate([k for _, k in parts]).view(np.int64)
            copies = np.flatnonzero(~lead)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            for pick, keys, local in ((at, pa.array(key), several[at]), (copies, pa.nulls(len(copies), pa.int64()), np.ones(len(copies), bool))):
                yield pa.RecordBatch.from_arrays([keys, pa.array(local), *(pa.array(c[pick].astype(np.int64)).cast(k) for c, k in zip(columns, kinds))], names=NAMES)


def _wanted(batches):
    """The shingles of the paragraphs whose places are asked for."""
    for batch in batches:
        texts, asked = as_bytes(batch.column(0)), batch.column(1).to_pylist()
        for a, b in blocks(texts, 2_000_000):
            p = Paragraphs(texts[a:b])
            begin = np.searchsorted(p.doc, np.arange(b - a))
            pick = np.array([begin[d] + s for d in range(b - a) for s in asked[a + d]], dtype=np.int64)
            sets = [np.unique(p.shingles[p.at[i] : p.at[i] + p.count[i]]).tobytes() for i in pick]
            yield pa.RecordBatch.from_arrays([pa.array(p.hash[pick].view(np.int64)), pa.array(sets, type=pa.binary())], names=["hash", "members"])


def _links_of(sizes: np.ndarray, flat: np.ndarray, right: np.ndarray | None, percent: int) -> tuple[list[int], list[int]]:
    """Links that tie up what the pairs of these sets that reach percent tie up; with right, only pairs across the two sides count."""
    n = len(sizes)
    _, term, df = np.unique(flat, return_inverse=True, return_counts=True)
    at = np.cumsum(sizes) - sizes
    postings = np.repeat(np.arange(n), sizes)[np.argsort(term, kind="stable")]
    starts = np.cumsum(df) - df
    component, left = np.arange(n), n
    a, b = [], []
    for i in np.argsort(-np.add.reduceat(df[term], at), kind="stable"):
        if left == 1:
            break
        of = term[at[i] : at[i] + sizes[i]]
        span = df[of]
        shared = np.bincount(postings[np.arange(span.sum()) + np.repeat(starts[of] - np.cumsum(span) + span, span)], minlength=n)
        ok = (component != component[i]) & (100 * shared >= percent * (sizes + sizes[i] - shared))
        if right is not None:
            ok &= right != right[i]
        found = np.flatnonzero(ok)
        if len(found):
            met, one = np.unique(component[found], return_index=True)
            a += [int(i)] * len(met)
            b += found[one].tolist()
            component[np.isin(component, met)] = component[i]
            left -= len(met)
    return a, b


def _links(batches, percent: int):
    """Of rows sorted by key, lo and hi: links within each such run, which is two chunks at most."""
    names = ["key", "lo", "hi", "chunk", "hash"]
    held, sets = None, []
    for batch in _and_end(batches):
        if batch is not None:
            new = [batch.column(c).to_numpy() for c in names]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            sets += batch.column("members").to_pylist()
        if held is None or not len(held[0]):
            continue
        key, lo, hi, chunk, text = held
        change = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        stops = [*change, len(key)] if batch is None else change
        at, out_a, out_b = 0, [], []
        for stop in stops:
            members = sets[at:stop]
            sizes = np.array([len(m) // 8 for m in members], dtype=np.int64)
            sides = chunk[at:stop] == hi[at] if lo[at] != hi[at] else None
            a, b = _links_of(sizes, np.frombuffer(b"".join(members), dtype=np.uint64), sides, percent)
            out_a += text[at:stop][a].tolist()
            out_b += text[at:stop][b].tolist()
            at = stop
        held, sets = [x[at:] for x in held], sets[at:]
        yield pa.RecordBatch.from_arrays([pa.array(out_a, type=pa.int64()), pa.array(out_b, type=pa.int64())], names=["a", "b"])


def _and_end(batches):
    yield from batches
    yield None


def repeated_paragraphs(docs: DataFrame, key: str, text: str, percent: int = PERCENT) -> DataFrame:
    """Every paragraph of a component that two documents or more share: id, row, seq, words, start, end, component (a hash), copies and kept (the first one)."""
    small_batches(docs.sparkSession)
    # Rows are numbered once, in a table, so that the texts read later are those that were banded.
    rows = settled(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("__key"), F.col(text).alias("__text")))
    banded = rows.select("row", "__text").mapInArrow(_banded, KEYED)
    # Paragraphs without a key stay apart from each other.
    spread = F.coalesce("key", F.xxhash64("row", "seq"))
    met = settled(
        banded.withColumn("__bucket", spread).withColumn("size", F.count("key").over(Window.partitionBy("__bucket")))
        .filter((F.col("size") > 1) | F.col("local")).drop("__bucket", "local")
    )

    texts = met.filter((F.col("size") > 1) & (F.col("words") >= NEAR_WORDS)).groupBy("key", "hash").agg(F.first("words").alias("words"), F.min(F.struct("row", "seq")).alias("at"))
    of_key = Window.partitionBy("key")
    by_size = of_key.orderBy("words", "hash").rowsBetween(Window.unboundedPreceding, -1)
    open_rows = settled(
        texts.withColumn("size", F.count("*").over(of_key)).filter("size > 1")
        .withColumn("chunk", F.floor(F.coalesce(F.sum(F.col("words").cast("long")).over(by_size), F.lit(0)) / CHUNK_WORDS).cast("int"))
        .withColumn("last", F.max("chunk").over(of_key))
    )
    asked = open_rows.select("at.*").groupBy("row").agg(F.collect_set("seq").alias("seqs"))
    found = small_join(rows.select("row", "__text"), asked, ["row"], "inner").select("__text", "seqs").mapInArrow(_wanted, "hash long, members binary")
    sets = settled(found.dropDuplicates(["hash"]))
    dealt = (
        open_rows.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .withColumn("lo", F.least("chunk", "with")).withColumn("hi", F.greatest("chunk", "with"))
        .join(sets, "hash").select("key", "lo", "hi", "chunk", "hash", "members")
        .repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    )
    groups = settled(connected_components(dealt.mapInArrow(partial(_links, percent=percent), "a long, b long")))
    discard(sets)
    discard(open_rows)

    each = met.select("row", "seq", "hash", "words", "start", "end").distinct()
    named = each.join(groups.toDF("hash", "component"), "hash", "left").withColumn("component", F.coalesce("component", "hash"))
    full = settled(named.join(rows.select("row", F.col("__key").alias(key)), "row").drop("hash"))
    for done in (rows, met, groups):
        discard(done)
    stats = full.groupBy("component").agg(F.count("*").alias("copies"), F.min(F.struct(key, "row", "seq")).alias("first"), F.min("row").alias("low"), F.max("row").alias("high")).filter("low < high")
    kept = (F.col("first.row") == F.col("row")) & (F.col("first.seq") == F.col("seq"))
    return full.join(stats, "component").select(key, "row", "seq", "words", "start", "end", "component", "copies", kept.alias("kept"))


def repeated_passages(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each passage that other places repeat: id, start and end (code points), words, removed_words (those to take out) and its components."""
    units = repeated_paragraphs(docs, key, text, percent)
    of_row = Window.partitionBy("row").orderBy("seq")
    islands = units.withColumn("island", F.col("seq") - F.row_number().over(of_row))
    return (
        islands.groupBy("row", "island").agg(
            F.first(key).alias(key), F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), F.sum("words").alias("words"),
            F.sum(F.when(F.col("kept"), 0).otherwise(F.col("words"))).alias("removed_words"), F.max("copies").alias("copies"),
            F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "component"))), lambda x: x["component"])).alias("components"),
        )
        .filter(F.col("words") >= min_words).drop("island")
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that has a repeated passage."""
    found = repeated_passages(table(spark, sf_dir, "documents"))
    return found.groupBy("doc_id", "row").agg(
        F.count("*").alias("n_passages"), F.sum("words").alias("repeated_words"), F.sum("removed_words").alias("removed_words"), F.max("copies").alias("copies"),
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("start", "end"))), lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("components")))).alias("components"),
    ).drop("row")
