"""Benchmark decontamination with a BM25 index of the test items and block-max WAND.

Every passage (a window of words) of every training document is a query
against an inverted index of test items.  Items are in blocks, and each term
has its largest impact, over all and within each block where it occurs.  Of a
passage's terms those with the longest lists are passed over as long as their
largest impacts together stay below the threshold: no item can reach it by
them alone.  Only blocks in the lists of the others are looked at, and of
these only those whose bound reaches the threshold are opened.  All items that
reach it (a share of the item's own score, so that it is the same for short
and long items) are retrieved.  The longer of an item's two parts, question and answer,
is indexed as well, so that an item whose parts lie far apart is retrieved by
it.  A hit is kept if shares of the shingles of the question and of the answer
are found in the document, each MIN_OVERLAP or more, wherever they stand.

The index is built from at most ITEMS_PER_INDEX items at a time: a larger
benchmark is read in ranges of that many items, each against all documents.

Defined results: null and empty texts and items match nothing.  Items with the
same id are told apart by nothing but their text: each is searched, and the
best match is reported.  Repeated documents are each reported.  A part with
fewer than 5 words is one shingle; one without words asks for nothing.  Columns other than ids and texts are
neither read nor returned by the search.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .textvec import Words, as_bytes, blocks, windows

ITEMS_PER_INDEX = 50_000
#: Words of a passage, and of the step to the next: any item of up to half a passage lies within one passage as a whole.
PASSAGE, STEP = 128, 64
BLOCK = 8
#: Cells of a table of bounds that are held at most; a larger index has lists alone.
SMALL_TABLE = 8_000_000
K1, B = 1.2, 0.75
#: Share of the item's own score that a passage must reach.
MIN_SCORE = 0.6
SHINGLE = 5
MIN_OVERLAP = 0.8

_NOT_WORD = np.ones(256, dtype=bool)
for _a, _b in ((ord("0"), ord("9")), (ord("a"), ord("z")), (ord("A"), ord("Z")), (0x80, 0xFF)):
    _NOT_WORD[_a : _b + 1] = False


def lowered(column: pa.Array) -> list[bytes]:
    return as_bytes(pc.utf8_lower(column.cast(pa.string())))


def shingles(h: np.ndarray) -> tuple[int, np.ndarray]:
    """The words of a shingle, fewer for a shorter text, and the distinct shingles."""
    k = min(SHINGLE, len(h))
    return k, np.unique(windows(h, k)) if k else np.zeros(0, dtype=np.uint64)


def split_item(text: bytes) -> tuple[bytes, bytes]:
    """Question and answer: the answer is the last line, else the last sentence, else the last third of the words."""
    body = text.rstrip(b" \t\r\n")
    cut = max(body.rfind(b"\n"), body[:-1].rfind(b". ") + 1)
    if cut <= 0:
        words = body.split(b" ")
        return b" ".join(words[: -(len(words) // 3) or len(words)]), b" ".join(words[len(words) - len(words) // 3 :])
    return body[:cut], body[cut:]


class Index:
    """Terms (sorted hashes), their postings, and the impact bounds by block of entries.

    An entry is an item, or the longer of its parts.  Entries are in order of their own scores, so that impacts within a block are alike."""

    def __init__(self, ids: list[int], texts: list[bytes]):
        self.ids, items = ids, len(texts)
        parts = [split_item(t) for t in texts]
        sets = [[shingles(Words([p], lower=False, parts=_NOT_WORD).hashes()) for p in both] for both in parts]
        self.question, self.answer = [s[0] for s in sets], [s[1] for s in sets]
        longer = Words([p for both in parts for p in both], lower=False, parts=_NOT_WORD).count.reshape(-1, 2).argmax(axis=1)
        texts = texts + [both[i] for both, i in zip(parts, longer)]
        words = Words(texts, lower=False, parts=_NOT_WORD)
        h, doc = words.hashes(), words.doc
        self.terms, term = np.unique(h, return_inverse=True)
        n, length = len(texts), words.count
        pair, tf = np.unique(doc.astype(np.int64) * max(len(self.terms), 1) + term, return_counts=True)
        item, term = pair // max(len(self.terms), 1), pair % max(len(self.terms), 1)
        # Whole items alone tell how rare a word is.
        among = np.bincount(term[item < items], minlength=len(self.terms))
        idf = np.log(1 + (items - among + 0.5) / (among + 0.5))
        df = np.bincount(term, minlength=len(self.terms))
        mean = max(length[:items].mean(), 1) if n else 1
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / mean))
        own = np.bincount(item, weights=impact, minlength=n)
        # A passage holds at most its own number of words of a longer item.
        reach = np.minimum(1, PASSAGE / 2 / np.maximum(length, 1))
        impact = impact / np.maximum(own * reach, 1e-9)[item]
        rank = np.argsort(own, kind="stable")
        place = np.empty(n, dtype=np.int64)
        place[rank] = np.arange(n)
        order = np.lexsort((place[item], term))
        self.item, self.impact = place[item][order], impact[order].astype(np.float32)
        #: Of each entry: its item, and whether it is a part.
        self.of, self.is_part = rank % max(items, 1), rank >= items
        self.blocks = n // BLOCK + 1
        #: Of each posting: its term and block, as one sorted number; and each such number once, with the largest impact there.
        self.place = np.repeat(np.arange(len(df)), df) * self.blocks + self.item // BLOCK
        self.met, first = np.unique(self.place, return_index=True)
        self.bounds = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        #: Of each term: where its blocks start, how many they are, and its largest impact.
        self.begin = np.searchsorted(self.met, np.arange(len(df)) * self.blocks)
        self.length = np.diff(np.append(self.begin, len(self.met)))
        self.top = np.maximum.reduceat(self.bounds, self.begin) if len(df) else self.bounds
        self.few = np.zeros(1 << 16, dtype=bool)
        self.few[self.terms >> np.uint64(48)] = True
        #: Of a small index the largest impacts by term and block as a table, which is quicker to add up than lists.
        self.table = None
        if len(self.terms) * self.blocks <= SMALL_TABLE:
            self.table = np.zeros((len(self.terms), self.blocks), dtype=np.float32)
            self.table[self.met // self.blocks, self.met % self.blocks] = self.bounds

    def term_of(self, h: np.ndarray) -> np.ndarray:
        """The term of each word, or -1."""
        out = np.full(len(h), -1, dtype=np.int64)
        if len(self.terms):
            maybe = np.flatnonzero(self.few[h >> np.uint64(48)])
            at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
            hit = self.terms[at] == h[maybe]
            out[maybe[hit]] = at[hit]
        return out


def passages(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The document, first and last word (exclusive) of each passage."""
    count = np.maximum(-(-(words.count - (PASSAGE - STEP)) // STEP), (words.count > 0).astype(int))
    doc = np.repeat(np.arange(len(count)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    first = words.first[doc] + nth * STEP
    return doc, first, np.minimum(first + PASSAGE, words.first[doc + 1])


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of adjoining ranges, given by their first number and their length."""
    return np.arange(n.sum()) + np.repeat(begin - np.cumsum(n) + n, n)


def _candidates(index: Index, who: np.ndarray, t: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The passages and blocks whose bound reaches the threshold: who and t are the distinct (passage, term) pairs, sorted."""
    # A passage whose terms' largest impacts don't reach the threshold together is passed over.
    starts = np.flatnonzero(np.diff(who, prepend=-1))
    size = np.diff(np.append(starts, len(who)))
    may = np.add.reduceat(index.top[t], starts, dtype=np.float64) >= threshold - 1e-6
    pairs = np.repeat(may, size)
    who, t, size = who[pairs], t[pairs], size[may]
    if not len(who):
        return who, who
    if index.table is not None:
        rows, blocks_of = [], []
        at = np.cumsum(size) - size
        for a, b in _even(size, max(SMALL_TABLE // index.blocks, 1)):
            low, high = at[a], at[b - 1] + size[b - 1]
            bound = np.add.reduceat(index.table[t[low:high]], at[a:b] - low, axis=0)
            row, block = np.nonzero(bound >= threshold - 1e-6)
            rows.append(who[at[a:b]][row])
            blocks_of.append(block)
        return np.concatenate(rows), np.concatenate(blocks_of)
    order = np.lexsort((-index.length[t], who))
    who, t = who[order], t[order]
    starts = np.cumsum(size) - size
    total = np.cumsum(index.top[t], dtype=np.float64)
    before = np.repeat((total - index.top[t])[starts], np.diff(np.append(starts, len(who))))
    # The pivot: up to it, terms with long lists can't reach the threshold together.
    counts = total - before >= threshold
    rest = np.bincount(who[~counts], weights=index.top[t[~counts]], minlength=who[-1] + 1)
    w, x = who[counts], t[counts]
    out = []
    for a, b in _even(index.length[x], 2_000_000, w):
        n = index.length[x[a:b]]
        at = _ranges(index.begin[x[a:b]], n)
        pair, place = np.unique(np.repeat(w[a:b], n) * np.int64(index.blocks) + index.met[at] % index.blocks, return_inverse=True)
        bound = np.bincount(place, weights=index.bounds[at])
        pair = pair[bound + rest[pair // index.blocks] >= threshold - 1e-6]
        out.append(pair)
    pair = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return pair // index.blocks, pair % index.blocks


def retrieve(index: Index, words: Words, threshold: float) -> list[tuple[int, int, float]]:
    """(document, item, score) of all items that reach the threshold in a passage of the document, as a whole or by the longer part, with the best score of the whole, else of the part."""
    term = index.term_of(words.hashes())
    doc, first, last = passages(words)
    best: dict[tuple[int, int], tuple[bool, float]] = {}
    at = np.flatnonzero(term >= 0)
    low, high = np.searchsorted(at, first), np.searchsorted(at, last)
    size = high - low
    terms = max(len(index.terms), 1)
    for a, b in _even(size, 200_000):
        span = size[a:b]
        pair = np.unique(np.repeat(np.arange(b - a), span) * np.int64(terms) + term[at[_ranges(low[a:b], span)]])
        who, t = pair // terms, pair % terms
        if not len(who):
            continue
        row, block = _candidates(index, who, t, threshold)
        starts, stops = np.searchsorted(who, row, "left"), np.searchsorted(who, row, "right")
        for c, d in _even(stops - starts, 500_000):
            n = (stops - starts)[c:d]
            slot = np.repeat(np.arange(d - c), n)
            opened = t[_ranges(starts[c:d], n)] * index.blocks + block[c:d][slot]
            begin, stop = np.searchsorted(index.place, opened, "left"), np.searchsorted(index.place, opened, "right")
            posting = _ranges(begin, stop - begin)
            entry = np.repeat(slot, stop - begin) * BLOCK + index.item[posting] % BLOCK
            score = np.bincount(entry, weights=index.impact[posting], minlength=(d - c) * BLOCK)
            for x in np.flatnonzero(score >= threshold):
                k = c + x // BLOCK
                entry = block[k] * BLOCK + x % BLOCK
                key = (int(doc[a + row[k]]), int(index.of[entry]))
                best[key] = max(best.get(key, (False, 0.0)), (not index.is_part[entry], float(score[x])))
    return [(d, i, s) for (d, i), (_, s) in sorted(best.items())]


def _even(size: np.ndarray, limit: int, owner: np.ndarray | None = None):
    """Ranges of rows with about limit units together; rows of one owner aren't parted."""
    total = np.cumsum(size)
    a = 0
    while a < len(size):
        b = int(np.searchsorted(total, (total[a - 1] if a else 0) + limit, "right"))
        b = max(b, a + 1)
        if owner is not None:
            b = int(np.searchsorted(owner, owner[b - 1], "right"))
        yield a, b
        a = b


def _share(part: np.ndarray, found: np.ndarray) -> float:
    if not len(part):
        return 1.0
    at = np.minimum(np.searchsorted(found, part), max(len(found) - 1, 0))
    return float((found[at] == part).mean()) if len(found) else 0.0


def hits(index: Index, texts: list[bytes], threshold: float, overlap: float):
    """(document, item, score, question overlap, answer overlap) of verified items."""
    words = Words(texts, lower=False, parts=_NOT_WORD)
    found = retrieve(index, words, threshold)
    if not found:
        return []
    h, out, sets = words.hashes(), [], {}
    for d, i, score in found:
        own = h[words.first[d] : words.first[d + 1]]

        def has(part, own=own, d=d):
            k, wanted = part
            if (d, k) not in sets:
                sets[d, k] = np.unique(windows(own, k)) if k else own[:0]
            return _share(wanted, sets[d, k])

        question = has(index.question[i])
        if question >= overlap and (answer := has(index.answer[i])) >= overlap:
            out.append((d, i, score, question, answer))
    return out


def _search(batches, index: Index, threshold: float, overlap: float):
    for batch in batches:
        texts = lowered(batch.column(1))
        for a, b in blocks(texts, 2_000_000):
            found = hits(index, texts[a:b], threshold, overlap)
            rows = pa.array([a + d for d, *_ in found], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows),
                    pa.array([index.ids[i] for _, i, *_ in found], type=pa.int64()),
                    *(pa.array([x[j] for x in found], type=pa.float64()) for j in (2, 3, 4)),
                ],
                names=[batch.schema.names[0], "item_id", "score", "question_overlap", "answer_overlap"],
            )


def _without(batches, index: Index, threshold: float, overlap: float, at: int):
    for batch in batches:
        texts = lowered(batch.column(at))
        for a, b in blocks(texts, 2_000_000):
            leaky = {d for d, *_ in hits(index, texts[a:b], threshold, overlap)}
            yield batch.slice(a, b - a).filter(pa.array([d not in leaky for d in range(b - a)], type=pa.bool_()))


def indexes(items: DataFrame, key: str = "item_id", text: str = "text", limit: int = ITEMS_PER_INDEX):
    """An index for each range of at most limit items, in the order of their ids."""
    rows = items.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")
    after = None
    while True:
        # Repeated ids may lengthen a range: all rows of its last id belong to it.
        ids = (rows if after is None else rows.filter(F.col("id") > after)).select("id").distinct().orderBy("id").limit(limit).collect()
        if not ids:
            return
        low, high = ids[0][0], ids[-1][0]
        found = rows.filter(F.col("id").between(low, high)).orderBy("id", "text").toArrow()
        yield Index(found.column(0).to_pylist(), lowered(found.column(1).combine_chunks()))
        after = high


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = MIN_SCORE, overlap: float = MIN_OVERLAP) -> DataFrame:
    """One row for each document and test item that it holds: ids, best BM25 score (share of the item's own), and both overlaps."""
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, item_id long, score double, question_overlap double, answer_overlap double"
    small_batches(docs.sparkSession)
    out = None
    for index in indexes(items):
        part = docs.select(key, text).mapInArrow(partial(_search, index=index, threshold=threshold, overlap=overlap), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str, threshold: float = MIN_SCORE, overlap: float = MIN_OVERLAP) -> DataFrame:
    """Pipeline stage: documents that hold a test item go."""
    small_batches(spark)
    at = docs.columns.index("text")
    for index in indexes(table(spark, sf_dir, "benchmark")):
        docs = docs.mapInArrow(partial(_without, index=index, threshold=threshold, overlap=overlap, at=at), docs.schema)
    return docs
