"""Operators that judge each text by itself."""

import hashlib
import re

import numpy as np
import pytest
import sentencepiece as spm
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from quillspark.llm import decontamination, language_id, pieces, pii, quality_classifier, toxicity
from quillspark.llm.boosting import isotonic

ODD = ["", " ", "a", "  a b  c", "hello\nworld", "\n\n", "é😀日本語 x", " " * 300 + "x", "ab" * 400, "a\tb\x00c", "x" * 700 + " " + "日" * 300, "<s> </s> <0x0A>", "\r\n a", "word "]
WORDS = {"en": "the of and with thing stone water bright".split(), "xx": "zob kaz vux qir plaz wem jorq".split(), "ru": "река город весна книга дорога".split()}


def text(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang], n))


@pytest.fixture(scope="module")
def model():
    return pieces.Model.load()


def encoded(model, texts):
    ids, counts = pieces.encode_block(model, texts)
    return [list(map(int, x)) for x in np.split(ids, np.cumsum(counts)[:-1])], pieces.decode_block(model, ids, counts)


def test_bpe_equals_the_library(model):
    want = spm.SentencePieceProcessor(model_file=pieces.default_model())
    got, back = encoded(model, ODD)
    assert got == [want.encode(t) for t in ODD]
    assert [b.decode() for b in back] == ODD


def test_unigram_viterbi_equals_the_library():
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.remove_extra_whitespaces = False
    for name, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        proto.pieces.add(piece=name, score=0.0, type=kind)
    rng = np.random.default_rng(5)
    names = {"▁", "a", "b", "c", "d", "\n"} | {"".join(rng.choice(list("abcd"), rng.integers(2, 5))) for _ in range(60)} | {"▁" + "".join(rng.choice(list("abcd"), rng.integers(1, 4))) for _ in range(30)}
    for name in sorted(names):
        proto.pieces.add(piece=name, score=float(-rng.uniform(1, 9) * max(1, len(name) / 2)), type=1)
    want = spm.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = ["".join(rng.choice(list("abcd  \n"), 60)) for _ in range(200)] + [""]
    got, back = encoded(pieces.Model(proto.SerializeToString()), texts)
    assert got == [want.encode(t) for t in texts]
    assert [b.decode() for b in back] == texts


def test_encode_and_decode_rows(spark, model):
    rows = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "y"), (None, None, "z"), (3, "", None)], "doc_id long, text string, ids string")
    out = pieces.encode(rows, model)
    assert sorted((r.doc_id or 0, r.n_tokens, r.round_trip) for r in out.collect()) == [(0, 0, True), (1, 2, True), (1, 2, True), (3, 0, True)]
    assert sorted(r.text for r in pieces.decode(out, model).collect()) == ["", "", "one two", "one two"]
    assert pieces.encode(rows.limit(0), model).count() == 0


def test_language_spans(spark):
    rng = np.random.default_rng(1)
    train = [(f"{lang}", text(rng, lang, 30)) for lang in WORDS for _ in range(20)]
    m = language_id.train(train)
    mixed = "the stone of water bright and thing kaz vux qir plaz zob wem jorq kaz vux"
    rows = [(1, mixed), (2, None), (3, ""), (4, "12 34 !!"), (5, text(rng, "ru", 9)), (5, text(rng, "ru", 9)), (6, "the " * 30000), (7, "ひらがな")]
    got = language_id.label_spans(spark.createDataFrame(rows, "doc_id long, text string"), m, "text", ["doc_id"]).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [(s.lang, mixed[s.start : s.end].split()[0]) for s in by[1].spans] == [("en", "the"), ("xx", "kaz")]
    assert [by[i].lang_pred for i in (2, 3, 4, 5, 6)] == ["und", "und", "und", "ru", "en"]
    # Letters of a script that no language uses: a language all the same, by a score of 0.
    assert by[7].lang_pred in WORDS and by[7].score == 0 and [s.lang for s in by[7].spans] == ["und"]
    assert by[2].score == 0 and 0 < by[1].score < 1 and by[6].n_spans == 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    count = np.array([5, 0, 1, 7])
    scores = rng.normal(0, 3, (count.sum(), 3)).astype(np.float32)
    first = np.concatenate(([0], np.cumsum(count)))
    got = language_id.best_paths(scores, first, count, 2.0)

    def value(path, s):
        return sum(s[i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))

    import itertools

    for a, b in zip(first, first[1:]):
        if b > a:
            best = max(value(p, scores[a:b]) for p in itertools.product(range(3), repeat=int(b - a)))
            assert abs(value(got[a:b], scores[a:b]) - best) < 1e-3


def test_nothing_to_learn_from(spark):
    m = language_id.train([])
    assert language_id.label_spans(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), m, "text", ["doc_id"]).first()["lang_pred"] == "und"
    docs = spark.createDataFrame([(1, "you idiot"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0.5 for r in quality_classifier.classify(docs, quality_classifier.fit(docs, labels, F.lit(True))).collect())
    scores = {r.doc_id: r.score for r in toxicity.classify(docs, toxicity.fit(docs, labels, F.lit(True))).collect()}
    assert scores[1] > 0.5 and scores[2] == 0


def labelled_docs(spark, rng, make):
    rows = [(i, make(i)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(400)] + [(None, 1, 1), (5000, 0, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def held_out_accuracy(scored):
    rows = [r for r in scored.collect() if r.doc_id < 400 and r.doc_id % 4 == 0 or r.doc_id < 400 and r.doc_id % 4 == 1]
    return np.mean([(r.score >= 0.5) == bool(r.doc_id % 2) for r in rows])


def test_quality_held_out(spark):
    rng = np.random.default_rng(3)
    docs, labels = labelled_docs(spark, rng, lambda i: text(rng, "en", 40) if i % 2 else " ".join(f"{w}&&&" for w in rng.choice(WORDS["xx"], 40)))
    out = quality_classifier.classify(docs, quality_classifier.fit(docs, labels, F.col("doc_id") % 4 >= 2))
    assert out.count() == 402 and held_out_accuracy(out) > 0.95


def test_toxicity_held_out(spark):
    rng = np.random.default_rng(4)
    docs, labels = labelled_docs(spark, rng, lambda i: text(rng, "en", 40) + (" you m0ron you idiot " if i % 2 else " fine ") + text(rng, "en", 40))
    out = toxicity.classify(docs, toxicity.fit(docs, labels, F.col("doc_id") % 4 >= 2))
    assert out.count() == 402 and held_out_accuracy(out) > 0.95
    assert all(0 <= r.score <= 1 for r in out.collect())


def test_isotonic_is_monotone():
    rng = np.random.default_rng(6)
    score = rng.normal(size=200)
    _, value = isotonic(score, (rng.random(200) < 1 / (1 + np.exp(-score))).astype(float), np.ones(200))
    assert (np.diff(value) >= 0).all()


def test_base_patterns():
    t = "a b.c@d-e.fr.x, 300.1.1.1 1.2.3.4.5 x 4111 1111-1111 1111 +1 (555) 010-9999. +12 345"
    got = {(k, t[s:e]) for k, s, e in pii.base_spans(t)}
    assert got == {(0, "b.c@d-e.fr.x"), (1, "1.2.3.4"), (2, "4111 1111-1111 1111"), (3, "+1 (555) 010-9999")}
    assert pii.base_spans("4111111111111112") == []
    # A digit before a card number makes it a longer match, which fails and is not tried again.
    assert pii.base_spans("5 4111 1111-1111 1111") == []


def plain_spans(t):
    """The base patterns as the contract states them."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        out += [(2, *m.span())] if 16 <= len(d) <= 19 and total % 10 == 0 else []
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


def test_base_patterns_equal_the_plain_ones():
    rng = np.random.default_rng(8)
    for alphabet in ("a1.@-", "12.5 ", "0+(9) -.", "aZ@.%_ 7", "4111-1 "):
        for _ in range(1500):
            t = "".join(rng.choice(list(alphabet), rng.integers(0, 40)))
            assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_are_read_once():
    import time

    start = time.time()
    for run in ("a" * 5_000_000, "1" * 5_000_000, "1." * 2_500_000, "a@" * 2_500_000, "." * 5_000_000 + "@"):
        assert pii.occurrences(run, [x for x in pii.base_spans(run) if x[0] > 1]) == []
    assert time.time() - start < 60


def test_hidden_secrets_are_recalled(spark):
    """A fifth of the secrets have a shape that no pattern knows: their context finds them."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(200):
        secret = "".join(rng.choice(list("0123456789abcdef"), 40)) if i % 5 else "Zq" + "".join(rng.choice(list("GHJKLMNPQR789"), 16))
        rows.append((i, f"{text(rng, 'en', 6)} token = \"{secret}\" {text(rng, 'en', 6)} C3PO{i} xYzzy{i}"))
    out = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {i: [dict(rows)[i][x.start : x.end] for x in r.discovered if x.kind == pii.SECRET] for i, r in out.items()}
    assert all(len(v) == 1 and v[0] == dict(rows)[i].split('"')[1] for i, v in found.items())
    assert pii.extract(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_context_discovers_new_identifiers(spark):
    rows = [(i, f"please write to contact mail a{i}@ex.org today") for i in range(6)]
    rows += [(10, "please write to contact mail bob@intranet today"), (11, "an odd bob@nowhere token"), (12, None), (13, ""), (10, "repeated 😀 row 1.2.3.4")]
    out = pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = [(r.doc_id, x.kind, x.start, x.end) for r in out for x in r.discovered]
    assert len(out) == len(rows) and found == [(10, 0, 29, 41)]
    assert sum(len(r.base) for r in out) == 7


def test_pii_query_digest(spark, tmp_path):
    spark.createDataFrame([(1, "x 1.2.3.4 y"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in pii.op3_pii(spark, str(tmp_path)).collect()}
    assert got[1].base_sha256 == hashlib.sha256(b"ip:2:9").hexdigest() and got[1].spans == "ip:2:9" and got[1].n_ip == 1
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""


def test_decontamination(spark):
    rng = np.random.default_rng(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    items = [" ".join(rng.choice(vocabulary, rng.integers(8, 60))) + ". " + " ".join(rng.choice(vocabulary, 6)) + "." for _ in range(40)]
    docs = []
    for i in range(60):
        words = " ".join(rng.choice(vocabulary, 300))
        if i % 3 == 0:
            item = items[i % 40]
            item = item.upper() if i % 2 else item.replace(" ", "  ")
            words = words + " ###" + item + "### " + words
        docs.append((i, words))
    docs += [(100, None), (101, ""), (0, docs[0][1])]
    out = decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*enumerate(items), (77, None), (78, "")], "item_id long, text string"))
    got = sorted((r.doc_id, r.item_id) for r in out.collect())

    def shingles(t):
        w = re.findall(r"[0-9a-z]+", t.lower())
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    want = sorted((d, i) for d, t in docs if t for i, item in enumerate(items) if len(shingles(item) & shingles(t)) >= 0.8 * len(shingles(item)))
    assert got == want and len(got) == 21
    assert decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("table", [8_000_000, 0])
def test_retrieval_equals_exhaustive_bm25(monkeypatch, table):
    """By a table of bounds and by lists: all items whose BM25 score, recomputed item by item, reaches the threshold in some passage: pruning loses none and adds none."""
    monkeypatch.setattr(decontamination, "SMALL_TABLE", table)
    rng = np.random.default_rng(10)
    for size in (5, 60, 400):
        common, rare = [f"c{i}" for i in range(30)], [f"r{i}" for i in range(size * 4)]
        items = []
        for _ in range(size):
            n = int(rng.integers(4, 40))
            items.append(" ".join(rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)).encode())
        docs = []
        for _ in range(30):
            words = [str(w) for w in rng.choice(common + rare[: size // 2], 250)]
            part = items[rng.integers(0, size)].decode().split()
            keep = rng.random(len(part)) < rng.choice([0.5, 0.7, 1.0])
            docs.append(" ".join([*words[:100], *(w for w, k in zip(part, keep) if k), *words[100:]]).encode())
        index = decontamination.Index(list(range(size)), items)
        parts = [decontamination.split_item(t) for t in items]
        longer = [max(p, key=lambda x: len(x.split())) for p in parts]
        entries = [t.split() for t in items] + [t.split() for t in longer]
        df = {}
        for words in entries[:size]:
            for w in set(words):
                df[w] = df.get(w, 0) + 1
        mean = max(np.mean([len(w) for w in entries[:size]]), 1)
        got = {(d, i) for d, i, _ in decontamination.retrieve(index, decontamination.Words(docs, lower=False, parts=decontamination._NOT_WORD), 0.6)}
        want, near = set(), set()
        for e, words in enumerate(entries):
            norm = decontamination.K1 * (1 - decontamination.B + decontamination.B * len(words) / mean)
            impact = {w: np.log(1 + (size - df[w] + 0.5) / (df[w] + 0.5)) * words.count(w) * (decontamination.K1 + 1) / (words.count(w) + norm) for w in set(words)}
            own = sum(impact.values()) * min(1, decontamination.PASSAGE / 2 / max(len(words), 1))
            for d, text_ in enumerate(docs):
                all_words = text_.split()
                for at in range(0, max(len(all_words) - decontamination.STEP, 1), decontamination.STEP):
                    score = sum(impact.get(w, 0) for w in set(all_words[at : at + decontamination.PASSAGE])) / max(own, 1e-9)
                    if abs(score - 0.6) < 1e-4:
                        near.add((d, e % size))
                    elif score >= 0.6:
                        want.add((d, e % size))
        assert want <= got and got - want <= near and want


def test_decontamination_by_parts(spark):
    rng = np.random.default_rng(9)
    question, answer = (" ".join(f"{x}{i}" for i in range(8)) for x in "qa")
    long_question, short_answer = " ".join(f"l{i}" for i in range(40)), " ".join(f"s{i}" for i in range(5))
    items = [(1, f"{question}?\n{answer}"), (2, f"{long_question}?\n{short_answer}"), (3, "one two three four five six\n...")]
    filler = " ".join(rng.choice([f"w{i}" for i in range(400)], 300))
    docs = [
        (1, f"{filler} {question}? Choices: A, B. Answer: {answer} {filler}"),
        (2, f"{question} {filler} {answer}"),
        (3, f"{filler} {answer} {filler}"),
        (4, f"{filler} {long_question}? {filler}"),
        (5, f"{short_answer} {filler} {long_question}"),
        (6, f"{filler} one two three four five six"),
    ]
    out = decontamination.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in out.collect()) == [(1, 1), (2, 1), (5, 2), (6, 3)]
