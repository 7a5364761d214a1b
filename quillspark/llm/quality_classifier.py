"""Quality classifier: supervised subword embeddings.

Hashed words, word bigrams and character n-grams each have a learned vector;
the vectors of a document are averaged and a softmax over the average gives its
class.  Training is stochastic gradient descent in numpy over a bounded
sample of labelled documents.  As softmax follows a linear map of the
average, every vector's part of the logit is computed once before scoring,
which gives the same result as averaging the vectors.

Defined results: a null or empty text has no features and gets the bias
alone.  Without labelled rows every score is 0.5.  Repeated rows are each
scored.  A row with a null id is scored, never learned from and not held out.
Columns other than id and text are neither read nor returned.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, small_batches, table
from .samples import labelled
from .textvec import Words, as_bytes, blocks, windows

#: At most so many labelled documents are learned from.
TRAINING_ROWS = 3000
BUCKET_BITS = 16
AGAIN = 1 << BUCKET_BITS
BUCKETS = AGAIN + 1
DIMENSIONS = 8
EPOCHS = 6
RATE = 0.3


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the hashed words, word bigrams and character trigrams and pentagrams (over bytes), one after another, and which text each is of.

    Bigrams of a word and the same word again share the bucket AGAIN, which nothing else has, whichever word it is."""
    words = Words(texts, lower=False)
    n, shift = len(texts), np.uint64(64 - BUCKET_BITS)
    doc = words.doc.astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(words.offset))
    hashes = words.hashes()
    near = doc[1:] == doc[:-1]
    pairs = np.where(hashes[1:] == hashes[:-1], AGAIN, (windows(hashes, 2) >> shift).astype(np.int32)).astype(np.int32)
    out, docs = [(hashes >> shift).astype(np.int32), pairs[near]], [doc, doc[1:][near]]
    buf = words.buf.astype(np.uint32)
    for size, seed in ((3, 0x9E3779B1), (5, 0x85EBCA77)):
        if len(buf) < size:
            continue
        m = len(buf) - size + 1
        h = np.full(m, seed, dtype=np.uint32)
        for i in range(size):
            h += buf[i : m + i]
            h *= np.uint32(0x01000193 + 2 * seed % 65521)
            h ^= h >> np.uint32(15)
        h *= np.uint32(0x27D4EB2F)
        within = owner[:m] == owner[size - 1 :]
        # The line end that closes each text counts as its last character.
        out.append((h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32)[within])
        docs.append(owner[:m][within])
    return out, docs


class Model:
    """vectors of all buckets, the softmax weights and bias, and a bucket's part of the logit of class 1."""

    def __init__(self, vectors: np.ndarray, weights: np.ndarray, bias: np.ndarray):
        self.vectors, self.weights, self.bias = vectors, weights, bias

    @property
    def logit(self) -> np.ndarray:
        return self.vectors @ (self.weights[:, 1] - self.weights[:, 0])


def train(texts: list[bytes], labels: np.ndarray, seed: int = 11) -> Model:
    """Plain SGD, a document a step, with a step size of each vector that shrinks as its gradients add up."""
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    weights = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.zeros(2, dtype=np.float32)
    seen = np.full(BUCKETS, 1e-8, dtype=np.float32)
    seen_w = np.full(weights.shape, 1e-8, dtype=np.float32)
    bags = []
    for text in texts:
        buckets, counts = np.unique(np.concatenate(features([text])[0]), return_counts=True)
        bags.append((buckets.astype(np.uint32), (counts / max(counts.sum(), 1)).astype(np.float32)))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(bags)):
            at, share = bags[i]
            mean = share @ vectors[at]
            logits = mean @ weights + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            to_mean = weights @ p
            to_weights = np.outer(mean, p)
            seen_w += to_weights**2
            weights -= rate * to_weights / np.sqrt(seen_w)
            bias -= 0.1 * rate * p
            size = share**2 * float((to_mean**2).mean())
            seen[at] += size
            vectors[at] -= (rate * share / np.sqrt(seen[at]))[:, None] * to_mean[None, :]
    return Model(vectors, weights, bias)


def probabilities(texts: list[bytes], logit: np.ndarray, bias: float) -> np.ndarray:
    """Of class 1, for each text."""
    n = len(texts)
    total, count = np.zeros(n), np.zeros(n)
    for buckets, docs in zip(*features(texts)):
        total += np.bincount(docs, weights=logit[buckets], minlength=n)
        count += np.bincount(docs, minlength=n)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -30, 30)))


def _score(batches, logit: np.ndarray, bias: float):
    for batch in batches:
        texts = as_bytes(batch.column(1))
        for a, b in blocks(texts, 2_000_000):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array(probabilities(texts[a:b], logit, bias))],
                names=[batch.schema.names[0], "score"],
            )


def fit(docs: DataFrame, labels: DataFrame, usable, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAINING_ROWS) -> Model | None:
    sample = labelled(docs, labels, label, usable, key, text, rows).select(text, "__label").toArrow()
    if not sample.num_rows:
        return None
    y = sample.column(1).to_numpy().astype(int)
    return train(as_bytes(sample.column(0).combine_chunks()), y)


def classify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, and score: the probability of good quality."""
    small_batches(docs.sparkSession)
    logit = model.logit.astype(np.float64) if model else np.zeros(BUCKETS)
    bias = float(model.bias[1] - model.bias[0]) if model else 0.0
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(partial(_score, logit=logit, bias=bias), f"`{key}` {kind}, score double")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    out = classify(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
