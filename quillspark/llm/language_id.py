"""Language identification of spans.

Script ranges narrow the candidate languages of each word; a word's score for
each candidate comes from hashed character trigrams and the hashed word, and a
Viterbi pass with a switching penalty labels the spans of mixed-language text.

Defined results: a null or empty text, or one without letters, gets ``und``,
score 0 and no spans.  Words of a script that no learned language uses make
spans of ``und``; a text of such words alone gets the language whose scores
are best all the same, with score 0.  Ties go to the language whose name sorts
first.  Repeated rows and rows with a null id are each labelled like any other
row; the latter are never learned from and not held out.  With no rows to learn from every text gets ``und``.  Columns other than
those to keep and the text are not read; added columns whose names are taken
get an underscore before them.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from .common import fold, fresh, small_batches, table
from .textvec import blocks

#: At most about so many training documents of each language are read, none longer than this.
DOCS_PER_LANGUAGE = 1000
#: Of a corpus with more values of lang than this the most frequent are learned.
MAX_LANGUAGES = 200
MAX_TRAINING_CHARS = 200_000
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
#: Cost, in nats, of a change of language between two words.
SWITCH_PENALTY = 12.0
#: A script counts for a language if it has at least this share of its letters.
MIN_SCRIPT_SHARE = 0.02

#: First code points of the script ranges, fixed values: start, script.
SCRIPT_RANGES = [
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3130, "hangul"),
    (0x3190, "other"), (0x31F0, "kana"), (0x3200, "other"), (0x3400, "han"), (0xA000, "other"),
    (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB07, "other"),
    (0x20000, "han"), (0x30000, "other"),
]
SCRIPTS = sorted({s for _, s in SCRIPT_RANGES})
_RANGE_START = np.array([a for a, _ in SCRIPT_RANGES])
_RANGE_SCRIPT = np.array([SCRIPTS.index(s) for _, s in SCRIPT_RANGES], dtype=np.int8)
_tables: dict[str, np.ndarray] = {}


def _unicode() -> tuple[np.ndarray, np.ndarray]:
    """By code point: is it a letter, and its lower case."""
    if not _tables:
        _tables["letter"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(_tables["letter"]):
            c = chr(i).lower()
            if len(c) == 1:
                lower[i] = ord(c)
        _tables["lower"] = lower
    return _tables["letter"], _tables["lower"]


class Letters:
    """Words (runs of letters) of a block of texts, with their hashed features."""

    def __init__(self, texts: list[str]):
        letter, lower = _unicode()
        points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        offset = np.concatenate(([0], np.cumsum(lens + 1)))
        is_letter = letter[points]
        edge = np.flatnonzero(np.diff(is_letter.view(np.int8), prepend=np.int8(0), append=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, offset)
        self.count = np.diff(self.first)
        self.offset = offset
        folded = np.zeros(len(points) + 2, dtype=np.uint32)
        folded[1:-1] = lower[points] * is_letter
        gram = folded[:-2] * np.uint32(0x9E3779B1) + folded[1:-1] * np.uint32(0x85EBCA77) + folded[2:] * np.uint32(0xC2B2AE3D)
        gram = gram[is_letter]
        gram ^= gram >> np.uint32(15)
        gram *= np.uint32(0x27D4EB2F)
        self.gram = gram >> np.uint32(32 - BUCKET_BITS)
        n = self.end - self.start
        self.at = np.concatenate(([0], np.cumsum(n)))[: len(n)]
        place = np.arange(len(gram), dtype=np.uint32) - np.repeat(self.at.astype(np.uint32), n)
        word = folded[1:-1][is_letter] * np.uint32(0x165667B1) + place * np.uint32(0x85EBCA77)
        word ^= word >> np.uint32(13)
        word *= np.uint32(0x27D4EB2F)
        word = np.add.reduceat(word, self.at, dtype=np.uint32) if len(n) else word
        word ^= word >> np.uint32(15)
        self.word = word * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)
        first = points[self.start]
        self.script = _RANGE_SCRIPT[np.searchsorted(_RANGE_START, first, "right") - 1]


class Model:
    """languages, the log-odds tables by feature bucket and language, and which language uses which script."""

    def __init__(self, languages: list[str], gram: np.ndarray, word: np.ndarray, uses: np.ndarray):
        self.languages, self.gram, self.word, self.uses = languages, gram, word, uses


def train(rows: list[tuple[str, str]]) -> Model:
    """A model of (language, text) rows."""
    languages = sorted({lang for lang, _ in rows})
    k = len(languages)
    grams, words = np.full((k, BUCKETS), 0.05), np.full((k, BUCKETS), 0.05)
    scripts = np.zeros((k, len(SCRIPTS)))
    for i, lang in enumerate(languages):
        texts = [t for name, t in rows if name == lang]
        for a, b in blocks(texts, 2_000_000):
            x = Letters(texts[a:b])
            grams[i] += np.bincount(x.gram, minlength=BUCKETS)
            words[i] += np.bincount(x.word, minlength=BUCKETS)
            scripts[i] += np.bincount(x.script, weights=x.end - x.start, minlength=len(SCRIPTS))
    odds = []
    for counts in (grams, words):
        logs = np.log(counts / counts.sum(axis=1, keepdims=True)) if k else counts
        odds.append((logs - logs.mean(axis=0, keepdims=True)).astype(np.float32) if k else counts)
    share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
    return Model(languages, odds[0], odds[1], share >= MIN_SCRIPT_SHARE)


def word_scores(model: Model, x: Letters) -> np.ndarray:
    """Of each word for each language; -inf where the word's script is of other languages only."""
    out = np.empty((len(x.start), len(model.languages)), dtype=np.float32)
    known = model.uses.any(axis=0)
    for i in range(len(model.languages)):
        out[:, i] = np.add.reduceat(model.gram[i][x.gram], x.at) + model.word[i][x.word]
        out[(known & ~model.uses[i])[x.script], i] = -np.inf
    return out


def uniform(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """By text: the best single language, and whether that constant path is the best of all paths for certain.

    It is if no run of words gains more than the penalty in any other language: each stretch
    that leaves the constant path for another language pays one penalty at least."""
    texts = np.flatnonzero(count)
    at = first[:-1][texts]
    total = np.add.reduceat(scores, at, axis=0, dtype=np.float64)
    best = np.zeros(len(count), dtype=np.int16)
    best[texts] = total.argmax(axis=1)
    row = np.repeat(np.arange(len(texts)), count[texts])
    own = scores[np.arange(len(scores)), best[texts][row]]
    most = np.zeros(len(texts))
    # A fall between texts makes the running minimum start anew with each.
    fall = row * 1e7
    for k in range(scores.shape[1]):
        gain = (scores[:, k] - own).astype(np.float64)
        run = np.cumsum(gain) - fall
        low = np.minimum.accumulate(run - gain)
        most = np.maximum(most, np.maximum.reduceat(run - low, at))
    sure = np.ones(len(count), dtype=bool)
    sure[texts] = most <= penalty
    return best, sure


def best_paths(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best path through each text; only texts in which a switch may pay go through the Viterbi pass."""
    scores = np.maximum(scores, np.float32(-1e4))
    if not len(scores):
        return np.zeros(0, dtype=np.int16)
    best, sure = uniform(scores, first, count, penalty)
    path = np.repeat(best, count)
    left = np.flatnonzero(~sure)
    if len(left):
        words = np.repeat(~sure, count)
        begin = np.concatenate(([0], np.cumsum(count[left])))[:-1]
        path[words] = viterbi(scores[words], begin, count[left], penalty)
    return path


def viterbi(scores: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """The best path of languages through each text's words; all texts advance together, a word a step.

    Scores are finite."""
    n, k = scores.shape
    order = np.argsort(-count, kind="stable")
    begin, total = first[order], count[order]
    active = len(total) - np.searchsorted(total[::-1], np.arange(int(total[0]) if len(total) else 0), "right")
    stay, best_before = np.zeros((n, k), dtype=bool), np.zeros(n, dtype=np.int16)
    state = np.zeros((len(total), k), dtype=np.float32)
    for t, a in enumerate(active):
        at = begin[:a] + t
        if t:
            s = state[:a]
            top = s.argmax(axis=1)
            moved = s[np.arange(a), top][:, None] - penalty
            keep = s >= moved
            stay[at], best_before[at] = keep, top
            s = np.where(keep, s, moved)
            s -= s.max(axis=1, keepdims=True)
            state[:a] = s + scores[at]
        else:
            state[:a] = scores[at]
    path = np.zeros(n, dtype=np.int16)
    now = state.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        a = active[t]
        at = begin[:a] + t
        path[at] = now[:a]
        if t:
            now[:a] = np.where(stay[at, now[:a]], now[:a], best_before[at])
    return path


ADDED = {"lang_pred": "string", "score": "double", "n_spans": "long", "spans": "array<struct<start:long,end:long,lang:string>>"}


def _label(batches, model: Model, penalty: float, ids: int, added: list[str]):
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])
    names = np.array([*model.languages, "und"], dtype=object)
    k = len(model.languages)
    for batch in batches:
        texts = [t or "" for t in batch.column(ids).to_pylist()]
        for a, b in blocks(texts, 2_500_000):
            x = Letters(texts[a:b])
            n = len(x.count)
            doc = np.repeat(np.arange(n), x.count)
            weight = (x.end - x.start).astype(float)
            if k and len(doc):
                scores = word_scores(model, x)
                path = best_paths(scores, x.first, x.count, penalty)
                anyhow = np.bincount(doc * k + path, weights=weight, minlength=n * k).reshape(n, k).argmax(axis=1)
                path = np.where(model.uses.any(axis=0)[x.script], path, k)
            else:
                path, anyhow = np.full(len(doc), k), np.full(n, k)
            share = np.bincount(doc * (k + 1) + path, weights=weight, minlength=n * (k + 1)).reshape(n, k + 1)
            best = share[:, :k].argmax(axis=1) if k else np.zeros(n, dtype=int)
            top = share[np.arange(n), best] if k else np.zeros(n)
            total = share.sum(axis=1)
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (path[1:] != path[:-1])
            head = np.flatnonzero(new)
            tail = np.concatenate((head[1:], [len(doc)]))[: len(head)] - 1
            base = x.offset[doc[head]]
            values = pa.StructArray.from_arrays(
                [pa.array(x.start[head] - base), pa.array(x.end[tail] - base), pa.array(names[path[head]], type=pa.string())],
                fields=list(kind),
            )
            n_spans = np.bincount(doc[head], minlength=n)
            offsets = np.concatenate(([0], np.cumsum(n_spans))).astype(np.int32)
            columns = [batch.column(i).slice(a, b - a) for i in range(ids)]
            columns += [
                pa.array(names[np.where(top > 0, best, np.where(x.count > 0, anyhow, k))], type=pa.string()),
                pa.array(top / np.maximum(total, 1)),
                pa.array(n_spans.astype(np.int64)),
                pa.ListArray.from_arrays(pa.array(offsets), values),
            ]
            fields = [*list(batch.schema)[:ids], *map(pa.field, added, [pa.string(), pa.float64(), pa.int64(), pa.list_(kind)])]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))


def label_spans(df: DataFrame, model: Model, text: str, keep: list[str], penalty: float = SWITCH_PENALTY) -> DataFrame:
    """The columns keep of each row, its language (the one with most letters), that share, and the labelled spans (code points)."""
    small_batches(df.sparkSession)
    kept = df.select(*(F.col(f"`{c}`") for c in keep))
    added = [fresh(kept, c) for c in ADDED]
    chosen = df.select(*(F.col(f"`{c}`") for c in keep), F.col(text).alias(fresh(kept, "text")))
    schema = StructType([*kept.schema.fields, *(StructField(c, DataType.fromDDL(kind)) for c, kind in zip(added, ADDED.values()))])
    return chosen.mapInArrow(partial(_label, model=model, penalty=penalty, ids=len(keep), added=added), schema)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Learns from at most about per_language rows of each language, those whose hashed ids are the smallest."""
    usable = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & (F.length(text) <= MAX_TRAINING_CHARS))
    sizes = {r[0]: r[1] for r in usable.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return train([])
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col(lang) == name, min(1.0, 1.1 * per_language / n)).otherwise(share)
    place = F.pmod(F.xxhash64(key), F.lit(1_000_003)) / 1_000_003
    most = int(1.3 * per_language) * len(sizes)
    rows = usable.filter(place < share).select(lang, text).limit(most).toArrow()
    return train(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    out = label_spans(docs, model, "text", ["doc_id"])
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None, min_share: float = 0.4) -> DataFrame:
    """Pipeline stage: documents without letters, or in which no language holds min_share of the letters, go.

    Rows keep their columns: each is judged by itself, so repeated rows, null ids and extra columns are harmless."""
    model = fit(docs.filter(fold("doc_id", 4) != 2))
    lang, score = fresh(docs, "lang_pred"), fresh(docs, "score")
    out = label_spans(docs, model, "text", docs.columns)
    return out.filter((F.col(lang) != "und") & (F.col(score) >= min_share)).select(*docs.columns)
