"""Nulls, empty tables, clashing columns, long texts, repeated rows and unbounded keys, for every operator; and models by brute force."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontamination, jaccard_join, language_id, line_dedup, passages, pieces, pii, quality_classifier, quality_rules, samples, toxicity
from quillspark.llm.common import fresh
from quillspark.llm.textvec import Words, windows

WORDS = [f"w{i}" for i in range(300)]
#: Columns that operators add or use within themselves.
CLASHES = "row long, node long, score double, lang_pred string, n_lines int, n_dropped int, key string, llr double, kept int, words int, start int, size int, ids string, n_tokens int, item_id int, component long, n int, __text string, __host string, _score int, __row int, __key int"


def documents(spark, rows, clash=False):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        for field in CLASHES.split(", "):
            name, kind = field.split()
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def rows_of(n=12):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(WORDS, 40)) + ".\nShared line of all.", "en", "s", 1) for i in range(n)]
    return [*rows, rows[0], (100, None, None, None, None), (101, "", "en", "s", 0), (None, "one two three", "en", None, 13), (None, None, None, "s", 0), (102, "long " * 60_000, "en", "s", 300_000)]


@pytest.fixture(scope="module")
def operators(spark):
    """Each operator and stage as a function of documents, with the number of rows it gives for rows_of(), None where that depends on more."""
    items = spark.createDataFrame([(1, "a b c d e f g. h i j k l m")], "item_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    model = pieces.Model.load()
    n = len(rows_of())
    return {
        "search": (lambda d: decontamination.search(d, items), 0),
        "jaccard": (jaccard_join.jaccard_join, n),
        "one_of_each": (lambda d: jaccard_join.one_of_each(spark, d), n - 1),
        "pii": (pii.extract, n),
        "pieces": (lambda d: pieces.encode(d, model), n),
        "toxicity": (lambda d: toxicity.classify(d, toxicity.fit(d, labels, F.lit(True))), n),
        "language": (lambda d: language_id.label_spans(d, language_id.fit(d), "text", ["doc_id"]), n),
        "keep_identified": (lambda d: language_id.keep_identified(spark, d), n - 3),
        "passages": (passages.repeated_passages, None),
        "lines": (line_dedup.dedup_lines, n),
        "clean_lines": (lambda d: line_dedup.clean_lines(spark, d), n),
        "rules": (lambda d: quality_rules.quality_rules(d, labels.filter("quality = 1")), n),
        "classifier": (lambda d: quality_classifier.classify(d, quality_classifier.fit(d, labels, F.lit(True))), n),
    }


NAMES = ["search", "jaccard", "one_of_each", "pii", "pieces", "toxicity", "language", "keep_identified", "passages", "lines", "clean_lines", "rules", "classifier"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, operators, name):
    assert operators[name][0](documents(spark, [])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, operators, name):
    run, n = operators[name]
    plain, clashing = run(documents(spark, rows_of())), run(documents(spark, rows_of(), clash=True))
    assert n is None or plain.count() == n
    assert collections.Counter(map(str, plain.collect())) == collections.Counter(map(str, clashing.select(*plain.columns).collect())) or name in ("lines", "pieces")
    assert clashing.count() == plain.count()


def test_fresh_names(spark):
    assert fresh(spark.createDataFrame([], "A int, _a int, b int"), "a") == "__a"


def test_samples_are_bounded(spark):
    """An id with a great many rows, and texts too long to learn from, don't swell the sample."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5000)] + [(2, "y " * 100_000), (3, "z"), (4, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 5)] * 2, "doc_id long, quality int")
    got = [tuple(r) for r in samples.labelled(docs, labels, "quality", F.lit(True), "doc_id", "text", 10).collect()]
    assert got == [(1, "text 0", 1), (3, "z", 1)]


def test_scores_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(2)
    docs = documents(spark, [(i, " ".join(rng.choice(WORDS[: 150 + 100 * (i % 2)], 30)), "en", "s", 0) for i in range(120)])
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(120)], "doc_id long, quality int, toxic int")
    for module in (quality_classifier, toxicity):
        one, two = ({r.doc_id: r.score for r in module.classify(d, module.fit(d, labels, F.lit(True))).collect()} for d in (docs, docs.orderBy(F.desc("doc_id")).repartition(7)))
        assert one == two


def test_folded_logits_equal_averaged_vectors():
    """A score by its definition: the mean of the vectors of all features, softmax over the two classes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(WORDS, n)).encode() for n in (1, 2, 9, 40)] + [b"", "é 日".encode()]
    model = quality_classifier.train(texts[:4], np.array([0, 1, 0, 1]))
    got = quality_classifier.probabilities(texts, model.logit.astype(float), float(model.bias[1] - model.bias[0]))
    for text, p in zip(texts, got):
        at = np.concatenate(quality_classifier.features([text])[0]).astype(int)
        mean = model.vectors[at].mean(axis=0) if len(at) else np.zeros(quality_classifier.DIMENSIONS)
        z = mean @ model.weights + model.bias
        assert abs(p - math.exp(z[1]) / (math.exp(z[0]) + math.exp(z[1]))) < 1e-5


def test_features_of_words_bigrams_and_characters():
    buckets, docs = quality_classifier.features([b"ab cd ab", b"x"])
    words = Words([b"ab cd ab", b"x"], lower=False).hashes()
    shift = np.uint64(64 - quality_classifier.BUCKET_BITS)
    assert list(buckets[0]) == list(words >> shift) and list(docs[0]) == [0, 0, 0, 1]
    assert list(buckets[1]) == list((windows(words, 2) >> shift)[:2]) and list(docs[1]) == [0, 0]
    # The line end that closes a text counts as its last character.
    assert [len(b) for b in buckets[2:]] == [7, 5]


def test_quality_verdicts_by_brute_force(spark):
    """llr and kept, from counts of the same hashed n-grams made by hand."""
    rng = np.random.default_rng(4)
    texts = [" ".join(rng.choice(WORDS[: 40 if i % 2 else 300], 25)) for i in range(40)] + ["", None, "a", "a b c d e f g h i j"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trusted = [i for i in range(40) if i % 2]
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs, spark.createDataFrame([(i,) for i in trusted], "doc_id long")).collect()}
    flat = sorted({w for t in texts for w in (t or "").split()})
    one = {r.w: r.h for r in spark.createDataFrame([(w,) for w in flat], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    pairs = sorted({(a, b) for t in texts for a, b in zip((t or "").split(), (t or "").split()[1:])})
    two = {(r.a, r.b): r.h for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.xxhash64(F.xxhash64("a"), F.xxhash64("b")).alias("h")).collect()}

    def grams(t):
        w = (t or "").split()
        return [one[x] % quality_rules.BUCKETS for x in w] + [two[x] % quality_rules.BUCKETS for x in zip(w, w[1:])]

    raw = collections.Counter(g for t in texts for g in grams(t))
    target = collections.Counter(g for i in trusted for g in grams(texts[i]))
    smooth = quality_rules.SMOOTHING * quality_rules.BUCKETS
    for i, t in enumerate(texts):
        found = grams(t)
        ratios = [math.log((target[g] + 1) / (target.total() + smooth)) - math.log((raw[g] + 1) / (raw.total() + smooth)) for g in found]
        want = sum(ratios) / len(ratios) if ratios else None
        assert (out[i].llr is None) == (want is None) and (want is None or abs(out[i].llr - want) < 1e-9)
        assert out[i].kept == (not out[i].base_failed and (want or 0) >= quality_rules.MIN_LLR)
    assert {r.kept for r in out.values()} == {True, False}


def test_toxicity_features_by_brute_force():
    """The plain rates of a few texts, counted by hand."""
    texts = [b"YOU are an idi0t, you IDIOT!!", b"calm words here", b"", b"a b c d", "é du Idiot".encode()]
    lowered = [t.decode().lower().encode() for t in texts]
    x = toxicity.featurise(texts, lowered, (np.zeros(0, dtype=np.uint64), np.zeros(0)))
    at = toxicity.FEATURES.index
    size = [max(sum(c not in b" " for c in t), 1) for t in texts]
    for i, t in enumerate(texts):
        assert x[i, at("capital_rate")] == sum(65 <= c <= 90 for c in t) / size[i]
        assert x[i, at("exclamation_rate")] == t.count(b"!") / size[i]
    # Words are runs of letters: you are an idi t you idiot.
    assert [x[0, at(c)] for c in ("seed_rate", "second_person_rate", "near_second_person")] == [1 / 7, 2 / 7, 1 / 7]
    assert [x[0, at(c)] for c in ("shouted_rate", "obfuscation_rate", "obfuscated_hits")] == [2 / 6, 2 / 6, 1 / 6]
    assert x[3, at("spaced_letters")] == 2 / 4 and x[4, at("seed_rate")] == 1 / 3 and not x[2].any()
