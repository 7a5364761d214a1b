"""Importance resampling, spelling variants and packing against brute force, and their odd cases."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import importance, packing, variants
from quillspark.llm.importance import Settings

DOC = "doc_id long, text string, row int, n long, word string, score double, ids string, task int, length string, size int"
EXTRA = (None, None, None, None, None, None, None, None)


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], DOC)


def texts(n=60, seed=0):
    rng = np.random.default_rng(seed)
    pool = ["lantern", "Lanterns", "lanterne", "river", "rivers", "É7é", "日本", "stone-wall", "stonewall", "x" * 12, "Ängste", "ängste", "don't", "42nd"]
    return [(i, " ".join(rng.choice(pool, rng.integers(0, 60)))) for i in range(n)]


ODD = [(None, "one two three " * 9), (None, None), (500, None), (501, ""), (502, "!!! ..."), (503, "lantern " * 40_000), (7, "again " * 25), (7, "again " * 25)]


# ---- importance resampling


def weights(rows, target, s: Settings):
    """rows as key, n_words, n_features, weight, score, rank, by the definition."""

    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % s.buckets for k in range(1, s.longest + 1) for i in range(len(words) - k + 1)]

    found = [(key, *features(text)) for key, text in rows]
    raw, wanted = Counter(b for _, _, f in found for b in f), Counter(b for _, text in target for b in features(text)[1])
    S, T = sum(raw.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log(float(wanted[b] + 1) * float(S + s.buckets) / (float(raw[b] + 1) * float(T + s.buckets))))
    out = []
    for key, words, f in found:
        weight = sum(map(gain, f)) // len(f) if f else 0
        score = None
        if key is not None:
            h = int(hashlib.sha256(f"{s.seed}:{key}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((key, len(words), len(f), weight, score))
    may = sorted((-r[4], r[0], i) for i, r in enumerate(out) if r[1] >= s.least_words and r[4] is not None)
    rank = {i: n + 1 for n, (_, _, i) in enumerate(may[: len(may) * s.percent // 100])}
    return Counter((*r, rank.get(i)) for i, r in enumerate(out))


@pytest.mark.parametrize("settings", [Settings(), Settings(longest=3, buckets=50, percent=40, least_words=5, seed=1)])
def test_resampling_by_brute_force(spark, settings):
    rows, target = texts() + ODD, [(1, "river stone rivers É7é"), (2, None), (3, "Lanterns river")]
    got = importance.resample(table(spark, rows).repartition(5), spark.createDataFrame(target, "item_id long, text string"), settings=settings)
    assert Counter(tuple(r) for r in got.collect()) == weights(rows, target, settings)


def test_resampling_without_rows(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert importance.resample(table(spark, []), none).count() == 0
    rows = texts(12)
    got = importance.resample(table(spark, rows), none, settings=Settings(percent=100, least_words=0))
    assert Counter(tuple(r) for r in got.collect()) == weights(rows, [], Settings(percent=100, least_words=0))


def test_blocks_of_one_partition_do_not_change_counts(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a b a", None, "b c"])], names=["doc_id", "text"])
    sql = importance.features_sql(2, 100)
    whole = [r for b in importance._count([batch], sql) for r in b.to_pylist()]
    monkeypatch.setattr(importance, "BLOCK_CHARS", 1)
    parts = [r for b in importance._count([batch], sql) for r in b.to_pylist()]
    same = lambda rows: [(r["doc_id"], r["n_words"], r["n_features"], sorted(zip(r["buckets"], r["counts"]))) for r in rows]
    assert same(whole) == same(parts) and [r["n_features"] for r in whole] == [5, 0, 3]


# ---- spelling variants


def spelled(rows, min_chars=5, min_count=3, factor=2, one_in=97):
    counts = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= min_chars:
                counts[w] += 1
    known = {w: n for w, n in counts.items() if n >= min_count}
    near = defaultdict(set)
    for a in known:
        for i in range(len(a) + 1):
            for other in [a[:i] + a[i + 1 :], *(a[:i] + c + a[i + k :] for c in {c for w in known for c in w} for k in (0, 1))]:
                if other in known and other != a:
                    near[a].add(other)
    form = {}
    for w in known:
        if near[w] and known[best := min(near[w], key=lambda x: (-known[x], x))] >= factor * known[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, n, len(near[w]), form.get(w), known.get(form.get(w)), root(w)) for w, n in known.items()}


def random_words(seed, n=3000, letters="abé", longest=8):
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list(letters), rng.integers(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("crowd", [2, 7, 256])
def test_variants_by_brute_force(spark, crowd):
    rows = [(i, " ".join(random_words(i, 300))) for i in range(12)] + ODD + [(600, "ÀÉ×÷ZZ zzyx " * 4)]
    got = variants.variants(table(spark, rows).repartition(3), min_chars=2, min_count=2, one_in=5, crowd=crowd).collect()
    want = spelled(rows, min_chars=2, min_count=2, one_in=5)
    assert len(got) == len(want) and {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got} == want


def test_each_link_comes_once_from_subdivided_blocks(spark):
    """All words of four letters of a small alphabet with one beginning and one end: every block is crowded."""
    made = sorted({f"pre{a}{b}{c}post" for a in "abcd" for b in "abcd" for c in "abcd"} | {f"pre{a}{b}post" for a in "abcd" for b in "abcd"} | {"p" * 40 + x for x in "abcdefgh"})
    words = spark.createDataFrame([(w, 1) for w in made], "word string, n long")
    got = Counter((r.word, r.other) for r in variants.near_words(words, crowd=3).collect())
    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) < 2 and any(b[:i] + b[i + 1 :] == (a if len(a) < len(b) else a[:i] + a[i + 1 :]) for i in range(len(b)))
    assert got == Counter((a, b) for a in made for b in made if a != b and one_edit(a, b))


def test_forms_are_followed_to_the_last(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    assert {r.root for r in variants.with_roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {"w37"}


def test_variants_without_rows(spark):
    assert variants.variants(table(spark, [])).count() == 0


# ---- packing


@pytest.fixture(scope="module")
def tokenizer():
    return packing.Tokenizer.load()


def test_ids_are_those_of_the_file(tokenizer):
    """The faster library and the file itself, on odd texts; special tokens that a text spells out are those of the file."""
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(5)
    parts = [*"aB1 .,'\n\t\r\x0b\x85\xa0é日א²½—’😀​　_-\x00", "'s", "'LL", "   ", "<|endoftext|>", "the ", "\n\n"]
    made = ["", "<|endoftext|>", "a<|endoftext|>b", " " * 3000, "x" * 20_000, *("".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000))]
    encode = tokenizer.encoder()
    assert [encode(t).tolist() for t in made] == [own.encode(t, add_special_tokens=False).ids for t in made]
    assert packing.Tokenizer(tokenizer.file).encoder()("a b").tolist() == encode("a b").tolist()


def test_plans_use_each_piece_once():
    rng = np.random.default_rng(0)
    for _ in range(200):
        limit = int(rng.integers(2, 60))
        counts = np.bincount(rng.integers(1, limit + 1, rng.integers(0, 400)), minlength=limit + 1) * rng.integers(0, 2, limit + 1)
        combinations = packing.plan(counts)
        used = Counter()
        for lengths, times in combinations:
            assert times > 0 and sum(n * k for n, k in lengths.items()) <= limit
            used.update({n: k * times for n, k in lengths.items()})
        assert [used[n] for n in range(1, limit + 1)] == counts[1:].tolist()
        places = packing.Places(combinations)
        length = np.repeat(np.arange(limit + 1), counts)
        sequence, offset = places.find(length, np.concatenate([np.arange(n) for n in counts]))
        order = np.lexsort((offset, sequence))
        at = 0
        for i, s in enumerate(order):
            at = 0 if i and sequence[order[i - 1]] != sequence[s] else at
            assert offset[s] == at
            at += length[s]
        assert set(sequence) == set(range(places.sequences))


def test_exact_complements_come_first():
    counts = np.zeros(101, dtype=int)
    for length, n in {70: 3, 30: 1, 20: 2, 10: 3, 5: 2, 60: 4, 40: 4, 100: 2}.items():
        counts[length] += n
    combinations = packing.plan(counts)
    whole = Counter()
    for lengths, times in combinations:
        whole[tuple(sorted(lengths.elements(), reverse=True))] += times
    assert whole == {(100,): 2, (70, 30): 1, (70, 20, 10): 2, (60, 40): 4, (10, 5, 5): 1}


def test_packing_by_brute_force(spark, tokenizer):
    rows = texts(40, 3) + ODD + [(900 + i, "word " * n) for i, n in enumerate([99, 100, 101, 199, 200, 201, 1000])]
    pieces = packing.cut_documents(table(spark, rows).repartition(4), tokenizer, limit=100)
    packed = packing.pack(pieces, limit=100)
    got = packed.collect()
    encode = tokenizer.encoder()
    want = Counter()
    for key, text in rows:
        ids = [*encode(text or "").tolist(), 0]
        first = len(ids) % 100 or 100
        starts = [0, *range(first, len(ids), 100)]
        want.update((key, i, a, tuple(ids[a:b])) for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])))
    assert Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    filled = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids)
        filled[r.sequence_id].append((r.offset, r.length, r.doc_id, r.ids))
    total = sum(r.length for r in got)
    assert len(filled) <= -(-total // 100) + 1
    whole = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    assert set(whole) == set(filled)
    for s, parts in filled.items():
        parts.sort(key=lambda p: p[0])
        assert [p[0] for p in parts] == np.cumsum([0, *(p[1] for p in parts[:-1])]).tolist() and sum(p[1] for p in parts) <= 100
        assert whole[s].ids == [i for p in parts for i in p[3]] and whole[s].n_tokens == len(whole[s].ids) and whole[s].docs == [p[2] for p in parts]
    digests = {(r.doc_id, r.piece, r.start, r.c) for r in packed.select("doc_id", "piece", "start", packing.ids_crc32(F.col("ids")).alias("c")).collect()}
    assert digests == {(d, p, a, zlib.crc32(np.array(ids, dtype="<u4").tobytes())) for d, p, a, ids in want}


def test_packing_without_rows(spark, tokenizer):
    packed = packing.pack(packing.cut_documents(table(spark, []), tokenizer))
    assert packed.count() == 0 and packing.sequences(packed).count() == 0
