"""SentencePiece encoding and decoding, batched in numpy.

Texts are cut into units that no piece can cross (a run of spaces with the
word after it; a line break).  The distinct units of a block of texts are
encoded once: units of equal length advance together, the hash of each
substring probes the sorted keys of the pieces, and vectorised maxima choose.
Two kinds of models are read:

* unigram: a Viterbi pass over the ends of all units at once; maxima store
  backpointers.
* bpe: such a pass would give other pieces than the model's own, as its scores
  are merge ranks, so the best-ranked neighbours of each unit are merged, all
  units a merge a step, until none can be.

Unknown characters become byte pieces where the model has them.  Defined
results: a null or empty text has no ids.  Decoding gives the text back,
except that U+2581 in a text comes back as a space, as in the models' own
library.  Repeated rows and null ids are harmless: each row is encoded alone.
"""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession

from .common import small_batches, table
from .textvec import as_bytes, blocks, list_array, mix, powers

SPACE = 0x2581
#: Longer units are merged one by one with a heap.
LONG = 256
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _char(points: np.ndarray) -> np.ndarray:
    return mix(points.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


class Model:
    """Sorted hashes of the pieces with their ids and scores, and the bytes of each piece."""

    def __init__(self, serialized: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(serialized)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that keep texts as they are can be read")
        self.kind = proto.trainer_spec.model_type
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and bpe models can be read")
        self.prefix = norm.add_dummy_prefix
        names = [p.piece for p in proto.pieces]
        types = np.array([p.type for p in proto.pieces])
        score = np.array([p.score for p in proto.pieces], dtype=np.float64)
        usable = np.flatnonzero(types == NORMAL)
        points = [_points(names[i]) for i in usable]
        for i, p in zip(usable, points):
            inner = np.flatnonzero(p == SPACE)
            if len(inner) and (p[: inner[-1] + 1] != SPACE).any() or (len(p) > 1 and 10 in p):
                raise ValueError(f"the piece {names[i]!r} crosses units")
        size = np.array([len(p) for p in points])
        self.longest = int(size.max())
        keys = np.zeros(len(points), dtype=np.uint64)
        for n in np.unique(size):
            at = np.flatnonzero(size == n)
            h = (_char(np.array([points[i] for i in at])) * powers(int(n))[None, :]).sum(axis=1, dtype=np.uint64)
            keys[at] = mix(h ^ np.uint64(int(n) << 48))
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], usable[order].astype(np.int32)
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.score = score[self.ids]
        self.few = np.zeros(1 << 20, dtype=bool)
        self.few[self.keys >> np.uint64(44)] = True
        self.unknown = int(np.flatnonzero(types == UNKNOWN)[0])
        self.unknown_score = score[usable].min() - 10
        byte = np.flatnonzero(types == BYTE)
        self.byte_ids = np.full(256, -1, dtype=np.int32)
        for i in byte:
            self.byte_ids[int(names[i][3:5], 16)] = i
        self.has_bytes = bool((self.byte_ids >= 0).all())
        data = [bytes([int(names[i][3:5], 16)]) if types[i] == BYTE else b"" if types[i] == CONTROL else b" \xe2\x81\x87 " if types[i] == UNKNOWN else names[i].replace("▁", " ").encode() for i in range(len(names))]
        self.data = np.frombuffer(b"".join(data), dtype=np.uint8)
        self.size = np.array([len(d) for d in data], dtype=np.int64)
        self.at = np.cumsum(self.size) - self.size

    @classmethod
    def load(cls, path: str | None = None) -> Model:
        with open(path or default_model(), "rb") as file:
            return cls(file.read())

    def probe(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash among the sorted keys, or -1."""
        flat = h.ravel()
        out = np.full(len(flat), -1, dtype=np.int32)
        maybe = np.flatnonzero(self.few[flat >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.keys, flat[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == flat[maybe]
        out[maybe[hit]] = at[hit]
        return out.reshape(h.shape)


def _substrings(model: Model, chars: np.ndarray) -> np.ndarray:
    """[unit, start, length - 1]: the place of that substring among the keys, or -1. chars: hashed characters of units of one length."""
    n, length = chars.shape
    width = min(model.longest, length)
    out = np.full((n, length, width), -1, dtype=np.int32)
    p = powers(width)
    h = np.zeros((n, length), dtype=np.uint64)
    for k in range(1, width + 1):
        h = h[:, : length - k + 1] + chars[:, k - 1 :] * p[k - 1]
        out[:, : length - k + 1, k - 1] = model.probe(mix(h ^ np.uint64(k << 48)))
    return out


def _merge(model: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For units of one length: which characters start a symbol, and the key of that symbol (-1: an unknown character)."""
    n, length = chars.shape
    place = _substrings(model, chars)
    width = place.shape[2]
    score = np.append(model.score, -np.inf)
    rows = np.arange(n)
    end = np.broadcast_to(np.arange(1, length + 1), (n, length)).copy()
    before = np.broadcast_to(np.arange(-1, length - 1), (n, length)).copy()
    gain = np.full((n, length), -np.inf)
    if width > 1:
        gain[:, : length - 1] = score[place[:, : length - 1, 1]]
    starts = np.ones((n, length), dtype=bool)

    def pair(r, i):
        """The score of the symbol at i and the one after it as one."""
        j = end[r, i]
        out = np.full(len(r), -np.inf)
        ok = np.flatnonzero(j < length)
        ok = ok[end[r[ok], j[ok]] - i[ok] <= width]
        out[ok] = score[place[r[ok], i[ok], end[r[ok], j[ok]] - i[ok] - 1]]
        return out

    while len(rows):
        best = gain[rows].argmax(axis=1)
        go = gain[rows, best] > -np.inf
        rows, best = rows[go], best[go]
        gone = end[rows, best]
        end[rows, best] = end[rows, gone]
        starts[rows, gone] = False
        gain[rows, gone] = -np.inf
        after = end[rows, best]
        has = after < length
        before[rows[has], after[has]] = best[has]
        gain[rows, best] = pair(rows, best)
        left = before[rows, best]
        has = left >= 0
        gain[rows[has], left[has]] = pair(rows[has], left[has])
    unit, at = np.nonzero(starts)
    key = np.full((n, length), -1, dtype=np.int32)
    key[unit, at] = place[unit, at, end[unit, at] - at - 1]
    return starts, key


def _merge_long(model: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_merge for one long unit, with a heap of its pairs."""
    length = len(chars)
    p = powers(model.longest)
    end, before = list(range(1, length + 1)), list(range(-1, length - 1))
    alive = [True] * length

    def key(i: int, j: int) -> int:
        if j - i > model.longest:
            return -1
        h = (chars[i:j] * p[: j - i]).sum(dtype=np.uint64)
        return int(model.probe(mix(np.array([h ^ np.uint64((j - i) << 48)])))[0])

    heap: list[tuple[float, int, int]] = []

    def push(i: int) -> None:
        if i >= 0 and end[i] < length:
            stop = end[end[i]]
            if (k := key(i, stop)) >= 0:
                heapq.heappush(heap, (-model.score[k], i, stop))

    for i in range(length - 1):
        push(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= length or end[end[i]] != stop:
            continue
        gone = end[i]
        alive[gone] = False
        end[i] = stop
        if stop < length:
            before[stop] = i
        push(i)
        push(before[i])
    starts = np.array(alive)
    keys = np.full(length, -1, dtype=np.int32)
    for i in np.flatnonzero(starts):
        keys[i] = key(int(i), end[i])
    return starts[None, :], keys[None, :]


def _viterbi(model: Model, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_merge for unigram models: the best segmentation of all units of one length together."""
    n, length = chars.shape
    place = _substrings(model, chars)
    score = np.append(model.score, -np.inf)
    best = np.full((n, length + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, length + 1), dtype=np.int32)
    for end in range(1, length + 1):
        for size in range(min(end, place.shape[2]), 0, -1):
            found = place[:, end - size, size - 1]
            value = score[found]
            if size == 1:
                value = np.where(found < 0, model.unknown_score, value)
            value = value + best[:, end - size]
            better = value > best[:, end]
            best[better, end] = value[better]
            back[better, end] = size
    starts, key = np.zeros((n, length), dtype=bool), np.full((n, length), -1, dtype=np.int32)
    at = np.full(n, length)
    rows = np.arange(n)
    while len(rows):
        size = back[rows, at[rows]]
        at[rows] -= size
        starts[rows, at[rows]] = True
        key[rows, at[rows]] = place[rows, at[rows], size - 1]
        rows = rows[at[rows] > 0]
    return starts, key


def _utf8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of each character, and how many."""
    data = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
    return data, 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)


def _expand(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... (size[0] of them), at[1], ..."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) - np.repeat(total - size, size) + np.repeat(at, size)


def encode_block(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts one after another, and how many each text has."""
    head = " " if model.prefix else ""
    full = [head + t if t else "" for t in texts]
    lens = np.fromiter((len(t) for t in full), dtype=np.int64, count=len(full))
    points = _points("".join(full)).copy()
    if not len(points):
        return np.zeros(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64)
    points[points == 0x20] = SPACE
    gap, line = points == SPACE, points == 10
    cut = gap.copy()
    cut[1:] &= ~gap[:-1]
    cut |= line
    cut[1:] |= line[:-1]
    doc_start = np.cumsum(lens) - lens
    cut[doc_start[lens > 0]] = True
    start = np.flatnonzero(cut)
    size = np.diff(np.append(start, len(points)))
    chars = _char(points)
    place = np.arange(len(points)) - np.repeat(start, size)
    h = mix(np.add.reduceat(chars * powers(int(size.max()))[place], start) + size.astype(np.uint64))
    _, sample, which = np.unique(h, return_index=True, return_inverse=True)
    u_start, u_size = start[sample], size[sample]

    u_count = np.zeros(len(sample), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    for length in np.unique(u_size):
        same = np.flatnonzero(u_size == length)
        step = max(1, 4_000_000 // (int(length) * min(int(length), model.longest)))
        for a in range(0, len(same), step):
            units = same[a : a + step]
            at = u_start[units][:, None] + np.arange(length)
            if model.kind == UNIGRAM:
                starts, key = _viterbi(model, chars[at])
            elif length > LONG:
                both = [_merge_long(model, chars[row]) for row in at]
                starts, key = (np.concatenate(x) for x in zip(*both))
            else:
                starts, key = _merge(model, chars[at])
            row, col = np.nonzero(starts)
            key = key[row, col]
            ids = model.ids[key]
            ids[key < 0] = model.unknown
            n = np.ones(len(row), dtype=np.int64)
            if model.has_bytes and (key < 0).any():
                data, width = _utf8(points[at[row, col][key < 0]])
                n[key < 0] = width
                wide = np.repeat(ids, n)
                wide[np.repeat(key < 0, n)] = model.byte_ids[data]
                ids = wide
            u_count[units] = np.bincount(row, weights=n, minlength=len(units)).astype(np.int64)
            parts.append((units, ids))
    order = np.concatenate([u for u, _ in parts])
    flat = np.concatenate([i for _, i in parts])
    begin = np.zeros(len(sample), dtype=np.int64)
    begin[order] = np.cumsum(u_count[order]) - u_count[order]
    count = u_count[which]
    ids = flat[_expand(begin[which], count)]
    doc_of = np.searchsorted(doc_start, start, "right") - 1
    # Of texts that start at one place all but the last are empty.
    return ids, np.bincount(doc_of, weights=count, minlength=len(texts)).astype(np.int64)


def decode_block(model: Model, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """UTF-8 of each text."""
    size = model.size[ids]
    data = model.data[_expand(model.at[ids], size)].tobytes()
    stop = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
    cut = 1 if model.prefix else 0
    return [data[a + cut : b] if b > a and data[a : a + 1] == b" " else data[a:b] for a, b in zip(stop[:-1], stop[1:])]


def _encode(batches, model: Model, keep: int):
    for batch in batches:
        texts = [t or "" for t in batch.column(keep).to_pylist()]
        raw = as_bytes(batch.column(keep))
        for a, b in blocks(texts, 2_500_000):
            ids, counts = encode_block(model, texts[a:b])
            back = decode_block(model, ids, counts)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i).slice(a, b - a) for i in range(keep)),
                    pa.array(counts),
                    list_array(ids, counts, pa.int32()),
                    pa.array([x == y for x, y in zip(back, raw[a:b])], type=pa.bool_()),
                ],
                names=[*batch.schema.names[:keep], "n_tokens", "ids", "round_trip"],
            )


def _decode(batches, model: Model, keep: int):
    for batch in batches:
        column = batch.column(keep)
        counts = np.array([0 if n is None else n for n in pa.compute.list_value_length(column).to_pylist()], dtype=np.int64)
        texts = decode_block(model, column.flatten().to_numpy(zero_copy_only=False), counts)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in range(keep)), pa.array([t.decode("utf-8", "replace") for t in texts], type=pa.string())],
            names=[*batch.schema.names[:keep], "text"],
        )


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in columns)


def encode(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id by default) of each row, and n_tokens, ids and round_trip (decoding the ids gives the text)."""
    keep = ["doc_id"] if keep is None else keep
    small_batches(df.sparkSession)
    schema = _kinds(df, keep) + "n_tokens long, ids array<int>, round_trip boolean"
    return df.select(*keep, text).mapInArrow(partial(_encode, model=model, keep=len(keep)), schema)


def decode(df: DataFrame, model: Model, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (doc_id by default) of each row, and the text of its ids."""
    keep = ["doc_id"] if keep is None else keep
    return df.select(*keep, ids).mapInArrow(partial(_decode, model=model, keep=len(keep)), _kinds(df, keep) + "text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), Model.load(model_path))


def encode_documents(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None, model_path: str | None = None) -> DataFrame:
    """Pipeline stage, the last: every document that is left with its ids."""
    return encode(docs, Model.load(model_path), keep=["doc_id", "lang", "source", "n_chars"])
