"""Best-fit packing of documents into sequences of a fixed number of tokens, by exact complements.

A document is its token ids and one end id.  Only a longer document than a
sequence is cut: all its pieces but the first are whole sequences.  What is
left to pack are pieces of 1 to ``limit`` tokens, and where a piece goes depends
on its length alone, so that the plan is made from the number of pieces of each
length, ``limit`` numbers whatever the size of the corpus:

1. Exact complements.  From the longest length down, the gap that a piece
   leaves is looked up among single lengths, then sums of two and of three;
   the combination found is used as often as the counts allow.
2. Best fit.  Of what is left the longest lengths go first, each into the open
   sequences with the least room that takes them, else into new ones.

A plan is a list of combinations, each with the number of its sequences; it has
a few entries for each length.  Pieces then learn their places without a
shuffle of texts or ids: each task numbers its pieces of one length in the
order in which it meets them, the numbers of tasks and lengths are added up, and the
number of a piece within its length finds its combination, its copy and its
place there by a search in sorted numbers.

Defined results: a null or empty text is one piece of the end id.  Each row is
packed, repeated rows and rows with a null id too.  Extra columns are neither
read nor returned.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import settled, small_batches, small_join, table
from .textvec import list_array

LIMIT = 2048
#: The id after the ids of each document.
END = 0
#: Numbers of one length stay below this one.
MOST = 1 << 44


@dataclass(frozen=True)
class Tokenizer:
    """A byte-level BPE: its own file, and the same vocabulary as ranks, which a faster library reads.

    Ids are the same by both, but for texts that spell out a special token: those go by the file itself.
    Without ranks all texts do."""

    file: str
    ranks: bytes | None = None
    pattern: str | None = None
    special: tuple[str, ...] = ()

    @classmethod
    def load(cls, path: str | None = None, ranks: str | None = None) -> Tokenizer:
        """The tokenizer of a file (a public one by default), with the ranks of its vocabulary where their path is given."""
        from tokenizers import Tokenizer as File

        pattern = None
        if path is None:
            import public_tokenizers

            path, ranks, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
        elif ranks is not None:
            raise ValueError("ranks need the pattern that cuts words: give it to Tokenizer itself")
        with open(path, encoding="utf-8") as f:
            file = f.read()
        special = tuple(t.content for t in File.from_str(file).get_added_tokens_decoder().values())
        given = None
        if ranks is not None:
            with open(ranks, "rb") as f:
                given = f.read()
        return cls(file, given, pattern, special)

    def encoder(self):
        """A function that gives the ids of a text as an array."""
        from tokenizers import Tokenizer as File

        whole = File.from_str(self.file)
        plain = lambda text: np.array(whole.encode(text, add_special_tokens=False).ids, dtype=np.int32)
        if self.ranks is None:
            return plain
        import tiktoken

        rank = {base64.b64decode(token): int(n) for token, n in map(bytes.split, self.ranks.splitlines())}
        fast = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=rank, special_tokens={})

        def ids(text: str) -> np.ndarray:
            if any(s in text for s in self.special):
                return plain(text)
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

        return ids


_encoders: dict[int, object] = {}


def _encoder(tokenizer: Tokenizer):
    """One for each tokenizer and Python worker."""
    key = hash(tokenizer)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = tokenizer.encoder()
    return _encoders[key]


def cuts(n: int, limit: int) -> np.ndarray:
    """Where the pieces of n ids start: all but the first are of limit ids."""
    return np.concatenate(([0], np.arange(n % limit or limit, n, limit)))


def _pieces(batches, tokenizer: Tokenizer, limit: int, end: int):
    encode = _encoder(tokenizer)
    task = TaskContext.get().partitionId()
    seen = np.zeros(limit + 1, dtype=np.int64)
    for batch in batches:
        texts = batch.column(1)
        at, n = 0, batch.num_rows
        while at < n:
            docs, found, size = at, [], 0
            # So many ids are held at a time, and at least one document.
            while docs < n and size < 1_000_000:
                found.append(np.append(encode(texts[docs].as_py() or ""), np.int32(end)))
                size += len(found[-1])
                docs += 1
            starts = [cuts(len(x), limit) for x in found]
            pieces = np.array([len(s) for s in starts])
            start = np.concatenate(starts)
            total = np.repeat([len(x) for x in found], pieces)
            first = np.repeat(np.cumsum(pieces) - pieces, pieces)
            length = np.where(np.arange(len(start)) + 1 < first + np.repeat(pieces, pieces), np.append(start[1:], 0), total) - start
            order = np.argsort(length, kind="stable")
            new = np.concatenate(([True], length[order][1:] != length[order][:-1]))
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            nth = np.empty(len(start), dtype=np.int64)
            nth[order] = np.arange(len(start)) - head + seen[length[order]]
            seen += np.bincount(length, minlength=limit + 1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, docs - at).take(pa.array(np.repeat(np.arange(docs - at), pieces))), pa.array((np.arange(len(start)) - first).astype(np.int32)),
                    pa.array(start), pa.array(length), list_array(np.concatenate(found), length, pa.int32()), pa.array(np.full(len(start), task, dtype=np.int64)), pa.array(nth),
                ],
                names=[batch.schema.names[0], "piece", "start", "length", "ids", "task", "nth"],
            )
            at = docs


def cut_documents(docs: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text", limit: int = LIMIT, end: int = END) -> DataFrame:
    """Per piece: key, piece (from 0), start (ids of its document before it), length, ids; task and nth number the pieces of one length. As a table: it is read more than once."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(key, text).mapInArrow(partial(_pieces, tokenizer=tokenizer, limit=limit, end=end), f"`{key}` {kind}, piece int, start long, length long, ids array<int>, task long, nth long")
    return settled(made)


class Sums:
    """Which lengths there are, and the lengths that add up to a gap: one, two or three of them."""

    def __init__(self, left: np.ndarray):
        self.left = left

    def one(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] else None

    def two(self, gap: int) -> tuple[int, ...] | None:
        """The two with the longest length of all."""
        there = self.left[: gap + 1] > 0
        both = np.flatnonzero(there & there[::-1])
        for a in both[::-1]:
            if 2 * a != gap or self.left[a] > 1:
                return int(a), gap - int(a)
        return None

    def three(self, gap: int) -> tuple[int, ...] | None:
        """The three with the longest length of all, then the longest second one."""
        there = self.left[: gap + 1] > 0
        size = 2 * len(there)
        # How many ordered pairs add up to each sum: a table of sums of two.
        pairs = np.rint(np.fft.irfft(np.fft.rfft(there, size) ** 2, size))[: gap + 1] > 0
        for a in np.flatnonzero(there & pairs[::-1])[::-1]:
            self.left[a] -= 1
            rest = self.two(gap - int(a))
            self.left[a] += 1
            if rest:
                return int(a), *rest
        return None


def plan(counts: np.ndarray) -> list[tuple[Counter, int]]:
    """Combinations of lengths, each with the number of its sequences, that use up counts (at n: the pieces of length n; the last is a whole sequence)."""
    limit = len(counts) - 1
    left = counts.astype(np.int64).copy()
    out: list[tuple[Counter, int]] = []
    if left[limit]:
        out.append((Counter({limit: 1}), int(left[limit])))
    left[limit] = 0
    sums = Sums(left)
    for length in range(limit - 1, 0, -1):
        while left[length]:
            left[length] -= 1
            gap = limit - length
            found = sums.one(gap) or sums.two(gap) or sums.three(gap)
            left[length] += 1
            if found is None:
                break
            used = Counter((length, *found))
            times = min(int(left[n]) // k for n, k in used.items())
            for n, k in used.items():
                left[n] -= k * times
            out.append((used, times))
    # Best fit, the longest first: room -> sequences that are open, by what they hold.
    room: dict[int, list[tuple[Counter, int]]] = {limit: []}
    for length in np.flatnonzero(left)[::-1].tolist():
        many = int(left[length])
        for gap in sorted(g for g in room if g >= length):
            each = gap // length
            if gap == limit:
                # New sequences, as many as are needed.
                room[gap] = [(Counter(), -(-many // each))]
            while many and room[gap]:
                held, times = room[gap].pop()
                full = min(times, many // each)
                for n, take in ((each, full), (many - full * each, 1 if full < times and many - full * each else 0)):
                    if take:
                        room.setdefault(gap - n * length, []).append((held + Counter({length: n}), take))
                        many -= n * take
                        times -= take
                    if n < each:
                        break
                if times:
                    room[gap].append((held, times))
                if not many:
                    break
            if not many:
                break
    return out + [x for gap, some in room.items() if gap < limit for x in some]


class Places:
    """A plan as sorted numbers: the nth piece of a length is in the copy of a combination, after what is longer there."""

    def __init__(self, combinations: list[tuple[Counter, int]]):
        used: Counter = Counter()
        rows, sequence = [], 0
        for lengths, times in combinations:
            offset = 0
            for length in sorted(lengths, reverse=True):
                n = lengths[length]
                rows.append((length * MOST + used[length], used[length], n, sequence, offset))
                used[length] += n * times
                offset += n * length
            sequence += times
        self.sequences = sequence
        rows.sort()
        self.key, self.first, self.each, self.sequence, self.offset = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else [np.zeros(0, dtype=np.int64)] * 5

    def find(self, length: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sequence of each piece and its offset there."""
        at = np.searchsorted(self.key, length * MOST + nth, "right") - 1
        copy, which = np.divmod(nth - self.first[at], self.each[at])
        return self.sequence[at] + copy, self.offset[at] + which * length


def pack(pieces: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """pieces (as cut_documents gives them) with sequence_id (from 0, without gaps) and offset (their place in the sequence)."""
    per = pieces.groupBy("length", "task").agg((F.max("nth") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    numbered = settled(per.withColumn("before", F.coalesce(before, F.lit(0))))
    counts = np.zeros(limit + 1, dtype=np.int64)
    # At most one row for each length.
    for row in numbered.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[row["length"]] = row["n"]
    places = Places(plan(counts))

    @F.arrow_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, nth: pa.Array) -> pa.Array:
        found = places.find(length.to_numpy(), nth.to_numpy())
        return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["sequence_id", "offset"])

    joined = small_join(pieces, numbered.select("length", "task", "before"), ["length", "task"], "inner")
    at = joined.withColumn("at", place(F.col("length"), F.col("before") + F.col("nth")))
    return at.select(key, "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each sequence as a row: sequence_id, n_tokens, ids, and its documents with the place where each begins. A group holds at most ``limit`` ids."""
    part = F.struct("offset", "length", F.col(key).alias("doc"), "ids")
    rows = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    return rows.select(
        "sequence_id", F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("n_tokens"),
        F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"), F.transform("parts", lambda p: p["doc"]).alias("docs"), F.transform("parts", lambda p: p["offset"]).alias("offsets"),
    )


def ids_crc32(ids: Column) -> Column:
    """The unsigned crc32 of ids as little-endian 32-bit numbers."""

    @F.arrow_udf("bigint")
    def crc(lists: pa.Array) -> pa.Array:
        flat = lists.flatten().to_numpy().astype("<u4")
        stop = np.cumsum(lists.value_lengths().to_numpy())
        return pa.array([zlib.crc32(flat[a:b]) for a, b in zip([0, *stop[:-1]], stop)], type=pa.int64())

    return crc(ids)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(cut_documents(table(spark, sf_dir, "documents"), Tokenizer.load()))
    return packed.select("doc_id", "piece", "start", "length", ids_crc32(F.col("ids")).alias("ids_crc32"), "sequence_id", "offset")
