"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a document are lexicon densities (a seed list, and words and
word beginnings learned from labelled documents), the proximity of lexicon
words to second-person words, and rates of capitals, punctuation and
obfuscated spellings.  The lexicon, the trees and the calibration are each
learned from a part of their own of a bounded sample of labelled rows.

Defined results: a null or empty text has zeros for features and gets their
score.  Without labelled rows of both kinds the score is the density of the
seed list, at most 1.  Repeated rows are each scored.  A row with a null id is
scored, never learned from and not held out.  Columns other than id and text
are neither read nor returned.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees, isotonic
from .common import fold, small_batches, table
from .samples import labelled
from .textvec import _BYTE, Words, as_bytes, blocks, mix, powers, span_hashes

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 4000
#: Insults, fixed values.
SEEDS = [
    "bastard", "clown", "coward", "creep", "cretin", "despicable", "dirtbag", "disgrace", "disgusting", "dumb",
    "dumbass", "filth", "fool", "freak", "garbage", "hate", "idiot", "idiotic", "imbecile", "jerk", "liar", "loser",
    "lowlife", "lunatic", "maggot", "moron", "moronic", "nasty", "pathetic", "pig", "repulsive", "scum", "shameful",
    "sicko", "stupid", "sucker", "trash", "ugly", "useless", "vermin", "vile", "weirdo", "worthless", "wretch",
]
#: Second-person words of a few languages, fixed values.
SECOND_PERSON = [
    "you", "your", "yours", "yourself", "u", "ur", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "du",
    "dich", "dir", "dein", "deine", "ihr", "euch", "euer", "ti", "usted", "ustedes", "tus", "vosotros", "vuestro",
]
NEAR = 6
PREFIXES = range(3, 11)
MIN_ODDS = 2.0
FEATURES = [
    "log_words", "seed_rate", "learned_rate", "learned_sum", "learned_max", "any_learned", "obfuscated_hits", "near_second_person",
    "second_person_rate", "capital_rate", "shouted_rate", "punctuation_rate", "exclamation_rate", "symbol_rate", "obfuscation_rate", "spaced_letters",
]

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[0x80:] = True
_LETTER[ord("A") : ord("Z") + 1] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[ord("A") : ord("Z") + 1] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_PUNCTUATION = ~_LETTER & ~_SPACE
_PUNCTUATION[ord("0") : ord("9") + 1] = False
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>@_~^")] = True
#: What a digit or sign stands for in an obfuscated word, fixed values.
_LEET = np.arange(256, dtype=np.uint8)
for _c, _l in zip(b"013457@$!", b"oieastasi"):
    _LEET[_c] = _l
_IS_LEET = _LEET != np.arange(256)


def _hash_all(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8)
    return np.sort(span_hashes(flat, np.array([len(d) for d in data], dtype=np.int64)))


_SEED_HASHES, _SECOND_HASHES = _hash_all(SEEDS), _hash_all(SECOND_PERSON)


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The place of each hash in a sorted table, or -1."""
    if not len(table):
        return np.full(len(h), -1)
    few = np.zeros(1 << 16, dtype=bool)
    few[table >> np.uint64(48)] = True
    out = np.full(len(h), -1)
    maybe = np.flatnonzero(few[h >> np.uint64(48)])
    at = np.minimum(np.searchsorted(table, h[maybe]), len(table) - 1)
    hit = table[at] == h[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _prefix_hashes(words: Words):
    """For each prefix length: the words that are at least so long, and the hash of that many first bytes."""
    n = words.end - words.start
    p = powers(PREFIXES.stop)
    rows = np.arange(len(n))
    h = np.zeros(len(n), dtype=np.uint64)
    for k in range(1, PREFIXES.stop):
        long_enough = n[rows] >= k
        rows, h = rows[long_enough], h[long_enough]
        h = h + _BYTE[words.buf[words.start[rows] + k - 1]] * p[k - 1]
        if k >= PREFIXES.start:
            yield rows, mix(h ^ np.uint64(k << 40))


def lower(column: pa.Array) -> list[bytes]:
    return as_bytes(pc.utf8_lower(column.cast(pa.string())))


def learn_lexicon(texts: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of words and word beginnings that mark toxic (lower-case) texts, and the log-odds of each."""
    keys: list[list[np.ndarray]] = [[], []]
    for text, label in zip(texts, labels):
        words = Words([text], lower=False, parts=~_LETTER)
        found = [words.hashes(), *(h for _, h in _prefix_hashes(words))]
        keys[int(label)].append(np.unique(np.concatenate(found)))
    if not keys[0] or not keys[1]:
        return np.zeros(0, dtype=np.uint64), np.zeros(0)
    (good, n_good), (bad, n_bad) = (np.unique(np.concatenate(k), return_counts=True) for k in keys)
    place = np.minimum(np.searchsorted(good, bad), len(good) - 1)
    also = np.where(good[place] == bad, n_good[place], 0)
    odds = np.log((n_bad + 0.5) / (len(keys[1]) + 1)) - np.log((also + 0.5) / (len(keys[0]) + 1))
    pick = (n_bad >= 3) & (odds >= MIN_ODDS) & (n_bad >= 4 * also)
    return bad[pick], odds[pick]


def featurise(texts: list[bytes], lowered: list[bytes], lexicon: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The dense features of each text; lowered has the texts in lower case."""
    n = len(texts)
    words = Words(lowered, lower=False, parts=~_LETTER)
    doc, hashes = words.doc, words.hashes()
    total = np.maximum(words.count, 1)

    def per(doc, weights=None):
        return np.bincount(doc, weights=weights, minlength=n)

    seed, second = _among(hashes, _SEED_HASHES) >= 0, _among(hashes, _SECOND_HASHES) >= 0
    odds = np.zeros(len(hashes))
    found = _among(hashes, lexicon[0])
    odds[found >= 0] = lexicon[1][found[found >= 0]]
    for rows, h in _prefix_hashes(words):
        found = _among(h, lexicon[0])
        hit = found >= 0
        odds[rows[hit]] = np.maximum(odds[rows[hit]], lexicon[1][found[hit]])
    toxic = seed | (odds > 0)
    near = np.zeros(len(hashes), dtype=bool)
    at = np.flatnonzero(second)
    for step in (*range(-NEAR, 0), *range(1, NEAR + 1)):
        other = at + step
        ok = (other >= 0) & (other < len(hashes))
        ok[ok] = doc[other[ok]] == doc[at[ok]]
        near[other[ok]] = True
    most = np.zeros(n)
    np.maximum.at(most, doc[odds > 0], odds[odds > 0])

    tokens = Words(texts, lower=False)
    owner = np.repeat(np.arange(n), np.diff(tokens.offset))
    size = np.maximum(per(owner, (~_SPACE[tokens.buf]).astype(float)), 1)
    token_doc, n_tokens = tokens.doc, np.maximum(tokens.count, 1)
    letters = capitals = leet = np.zeros(0)
    if len(token_doc):
        inside = tokens.buf[tokens.inside]
        lens = tokens.end - tokens.start
        first = np.concatenate(([0], np.cumsum(lens)[:-1]))
        letters = np.add.reduceat(_LETTER[inside].astype(np.int32), first)
        capitals = np.add.reduceat(_CAPITAL[inside].astype(np.int32), first)
        leet = np.add.reduceat(_IS_LEET[inside].astype(np.int32), first)
    obfuscated = (letters >= 2) & (leet >= 1)
    if len(token_doc):
        obfuscated &= _LETTER[tokens.buf[tokens.end - 1]] | _LETTER[tokens.buf[tokens.start]]
    clear = np.zeros(n)
    if obfuscated.any():
        pick = np.repeat(obfuscated, lens)
        data = _LEET[inside[pick]]
        data = np.where(_CAPITAL[data], data + 32, data).astype(np.uint8)
        kept = _LETTER[data]
        owner_token = np.repeat(np.flatnonzero(obfuscated), lens[obfuscated])[kept]
        token, counts = np.unique(owner_token, return_counts=True)
        clear = per(token_doc[token], (_among(span_hashes(data[kept], counts), _SEED_HASHES) >= 0).astype(float))
    single = (letters == 1) & (tokens.end - tokens.start == 1)
    run = single[2:] & single[1:-1] & single[:-2] & (token_doc[2:] == token_doc[:-2]) if len(single) > 2 else np.zeros(0, bool)
    shouted = (letters >= 3) & (capitals == letters)
    rate = lambda flags: per(owner, flags[tokens.buf].astype(float)) / size
    exclamation = np.zeros(256, dtype=bool)
    exclamation[ord("!")] = True
    return np.column_stack([
        np.log1p(words.count), per(doc, seed) / total, per(doc, odds > 0) / total, per(doc, odds) / total, most, per(doc, odds > 0), clear / n_tokens,
        per(doc, toxic & near) / total, per(doc, second) / total, rate(_CAPITAL), per(token_doc, shouted) / n_tokens, rate(_PUNCTUATION),
        rate(exclamation), rate(_SYMBOL), per(token_doc, obfuscated) / n_tokens, per(token_doc[2:][run] if len(run) else np.zeros(0, int)) / n_tokens,
    ])


class Model:
    """The learned lexicon, the trees (None if nothing could be learned) and the points of the calibration."""

    def __init__(self, lexicon, trees: Trees | None, points):
        self.lexicon, self.trees, self.points = lexicon, trees, points

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.minimum(1, 20 * x[:, FEATURES.index("seed_rate")])
        raw = self.trees.raw(x)
        calibrated = np.interp(raw, *self.points)
        # The calibration is flat in places; there the trees' own order stays.
        return 0.999 * calibrated + 0.001 / (1 + np.exp(-raw))


def train(texts: list[bytes], lowered: list[bytes], labels: np.ndarray, weight: np.ndarray) -> Model:
    """Of each label, two fifths of the rows teach the lexicon, two fifths the trees and one fifth the calibration."""
    part = np.zeros(len(labels), dtype=int)
    for value in (0, 1):
        rows = np.flatnonzero(labels == value)
        part[rows] = np.arange(len(rows)) % 5
    teach = part < 2
    lexicon = learn_lexicon([t for t, p in zip(lowered, teach) if p], labels[teach])
    x = np.concatenate([featurise(texts[a:b], lowered[a:b], lexicon) for a, b in blocks(texts, 2_000_000)]) if texts else np.zeros((0, len(FEATURES)))
    grow, check = (part == 2) | (part == 3), part == 4
    if any(len(np.unique(labels[rows])) < 2 for rows in (grow, check)):
        return Model(lexicon, None, None)
    trees = Trees().fit(x[grow], labels[grow], weight[grow])
    return Model(lexicon, trees, isotonic(trees.raw(x[check]), labels[check].astype(float), weight[check]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = TRAINING_ROWS) -> Model:
    sample = labelled(docs, labels, label, usable, key, text, rows).toArrow()
    y = sample.column(2).to_numpy().astype(int)
    all_of = dict(labels.filter(usable & F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().toArrow().to_pandas().itertuples(index=False))
    weight = np.ones(len(y))
    for value in (0, 1):
        if (y == value).any():
            # The sample is balanced; the weights bring back the shares of all labelled rows.
            weight[y == value] = all_of.get(value, 0) / (y == value).sum()
    column = sample.column(1).combine_chunks()
    return train(as_bytes(column), lower(column), y, weight / max(weight.sum() / max(len(y), 1), 1e-9))


def _score(batches, model: Model):
    for batch in batches:
        texts, lowered = as_bytes(batch.column(1)), lower(batch.column(1))
        for a, b in blocks(texts, 2_000_000):
            x = featurise(texts[a:b], lowered[a:b], model.lexicon)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(model.score(x))], names=[batch.schema.names[0], "score"]
            )


def classify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, and score: the probability that the text is toxic."""
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(partial(_score, model=model), f"`{key}` {kind}, score double")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
