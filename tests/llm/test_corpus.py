"""Operators that compare texts with each other, against brute force."""

import collections
import glob
import itertools
import os
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, line_dedup, passages, quality_rules
from quillspark.llm.components import connected_components
from quillspark.llm.queries import QUERIES, SQL

VOCABULARY = [f"w{i}" for i in range(500)]


def components(n, links):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = np.random.default_rng(1)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 60, (35, 2))] + [(i, i + 1) for i in range(100, 130)]
    want = components(131, links)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(131))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def corpus():
    rng = np.random.default_rng(2)
    rows = []
    for group in range(6):
        base = list(rng.choice(VOCABULARY, 120))
        for copy in range(12):
            words = list(base)
            for at in rng.integers(0, 120, copy % 4):
                words[at] = str(rng.choice(VOCABULARY))
            rows.append(" ".join(words).upper() if copy == 5 else "\n".join(words) if copy == 6 else " ".join(words))
    rows += ["", "a b", "A  B", "a", "x y z", None, "word " * 5000, rows[0]]
    return list(enumerate(rows))


def near_misses():
    """Copies of a few texts with one to five edits, cuts and passages of the others: many pairs just below the threshold."""
    rng = np.random.default_rng(11)
    bases = [list(rng.choice(VOCABULARY, n)) for n in (40, 60, 90, 90)]
    rows = []
    for i in range(130):
        words = list(bases[i % 4])
        for at in rng.integers(0, len(words), rng.integers(0, 6)):
            words[at] = f"e{rng.integers(0, 30)}"
        if i % 5 == 0:
            words = words[: len(words) - int(rng.integers(1, 12))]
        if i % 9 == 0:
            words += bases[(i + 1) % 4][: int(rng.integers(5, 30))]
        rows.append(" ".join(words))
    return list(enumerate(rows))


def brute_jaccard(rows, k, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    links = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return [(i, len(s), c) for (i, _), s, c in zip(rows, sets, components(len(rows), links))]


@pytest.mark.parametrize("k, percent, unit, seed", [(3, 90, 300_000, 0), (5, 80, 300, 0), (3, 90, 150, 1), (5, 80, 1, 1)])
def test_jaccard_join(spark, monkeypatch, k, percent, unit, seed):
    """Groups of near copies at all distances round the threshold, dealt in one unit a home, or in several."""
    monkeypatch.setattr(jaccard_join, "UNIT", unit)
    rows = corpus() if not seed else near_misses()
    docs = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, node string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(docs, k=k, percent=percent).collect())
    assert got == brute_jaccard(rows, k, percent)


def test_jaccard_join_with_odd_ids(spark):
    """Null ids and ids that several texts have."""
    a, b = " ".join(VOCABULARY[:60]), " ".join(VOCABULARY[100:160])
    rows = [(1, a), (1, b), (2, a + " more"), (None, b), (None, "x " * 20), (None, b + " z"), (7, "y " * 9), (None, None)]
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(1, 58, 1), (1, 58, 1), (2, 59, 1), (None, 58, 1), (None, 1, None), (None, 59, 1), (7, 1, 7), (None, 0, None)]
    assert collections.Counter(got) == collections.Counter(want)


@pytest.mark.parametrize("ids", ["plain", "odd"])
def test_one_of_each(spark, ids):
    a, b = " ".join(VOCABULARY[:60]), " ".join(VOCABULARY[100:160])
    rows = [(5, a, 0), (3, a + " more", 1), (9, b, 2), (10, None, 3), (11, "", 4), (12, "lone words", 5)]
    want = [(3, 1), (9, 2), (10, 3), (11, 4), (12, 5)]
    if ids == "odd":
        rows += [(3, a + " more", 1), (12, a, 6), (None, b, 7), (None, "twice", 8), (None, "twice", 8), (None, None, 9), (None, None, 9)]
        want += [(None, 8), (None, 9), (None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").repartition(2)
    out = jaccard_join.one_of_each(spark, docs)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r.doc_id, r.node) for r in out.collect()))) == sorted(map(str, want))
    assert jaccard_join.one_of_each(spark, docs.limit(0)).count() == 0


def test_clusters_lose_no_pair():
    """Groups that the filter parts never link."""
    rng = np.random.default_rng(12)
    for _ in range(20):
        sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(25)]
        label = jaccard_join.clusters(np.array([len(s) for s in sets]), [s[: jaccard_join.prefix_length(len(s), 60)] for s in sets], 60)
        for a, b in itertools.combinations(range(25), 2):
            assert label[a] == label[b] or 100 * len(np.intersect1d(sets[a], sets[b])) < 60 * len(np.union1d(sets[a], sets[b]))


def test_jaccard_join_of_nothing(spark):
    assert jaccard_join.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup(spark):
    rows = [(i, "a", f"Header\nown {i}\n\nFooter\nFooter") for i in range(20)] + [(i, "b", f"Header\nmine {i}") for i in range(20, 22)]
    rows += [(30, "a", None), (31, None, "Header\nx"), (32, "a", ""), (33, "a", "Header")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert out[3].text == "own 3\n" and (out[3].n_lines, out[3].n_dropped) == (5, 3)
    assert out[20].text == "Header\nmine 20" and out[31].text == "Header\nx" and out[30].text is None
    assert out[32].text == "" and out[33].text == "" and len(out) == len(rows)


def test_quality_rules(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(VOCABULARY[:40], n)) for n in (0, 1, 4, 5, 6, 9, 12, 30, 60, 200)] + ["a b c d e a b c d e", "x " * 3000, None, " \n\t\n", "é 😀 |#|\nl1\nl1\n \n \nl2"]
    texts += [" ".join(rng.choice(VOCABULARY, 50)) for _ in range(20)]
    rows = list(enumerate(texts)) + [(3, "again the same id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs, spark.createDataFrame([(i,) for i in range(15, 35)], "doc_id long")).collect())
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0d]+", t)
        seen = collections.defaultdict(list)
        for j in range(len(w) - 4):
            seen[tuple(w[j : j + 5])].append(j)
        covered = {x for at in seen.values() if len(at) > 1 for j in at for x in range(j, j + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)] += 1
    assert got == want


def test_passages(spark):
    rng = np.random.default_rng(4)

    def words(n):
        return " ".join(rng.choice(VOCABULARY, n))

    passage = ". ".join(words(12) for _ in range(5)) + "."
    rows = [(i, words(30) + ". Head line of all texts here.\n" + words(40)) for i in range(30)]
    planted = {3, 7, 19}
    rows = [(i, t + " end. " + passage + " " + words(20) if i in planted else t) for i, t in rows] + [(40, None), (41, ""), (42, "short")]
    got = {r.doc_id: r for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == planted
    text = dict(rows)
    assert all(text[i][got[i].start : got[i].end] in passage and got[i].words >= 48 for i in planted)
    assert got[3].removed_words == 0 and got[7].removed_words == got[7].words
    near = [(1, " ".join(VOCABULARY[:60])), (2, " ".join([*VOCABULARY[:59], "other"])), (3, " ".join(VOCABULARY[200:260]))]
    assert {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(near, "doc_id long, text string")).collect()} == {1, 2}


def test_passage_recall(spark):
    rng = np.random.default_rng(5)
    rows, pairs = [], []
    for i in range(120):
        base = list(rng.choice(VOCABULARY, 45))
        other = list(base)
        other[-1 - i % 3 :] = rng.choice(VOCABULARY, 1 + i % 3)
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
        s = [{tuple(w[j : j + 5]) for j in range(41)} for w in (base, other)]
        if len(s[0] & s[1]) >= 0.8 * len(s[0] | s[1]):
            pairs.append((2 * i, 2 * i + 1))
    found = {r.doc_id for r in passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert np.mean([a in found and b in found for a, b in pairs]) >= 0.9


@pytest.mark.parametrize("chunk", [50_000, 700])
def test_passages_of_a_star(spark, monkeypatch, chunk):
    """An original and copies with one edit each: copies link with the original only, which stands anywhere among them."""
    monkeypatch.setattr(passages, "CHUNK_WORDS", chunk, raising=False)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        original = [str(w) for w in rng.choice(VOCABULARY, 60)]
        rows = [(100, " ".join(original))] + [(i, " ".join([*original[: i + 5], f"edit{i}", *original[i + 6 :]])) for i in range(50)]
        found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        # Each copy has 51 of 61 shingles in common with the original: three bands miss 0.4 % of them.
        assert len({r.doc_id for r in found}) >= 50 and len({tuple(r.components) for r in found}) == 1


def test_links_of_sets():
    rng = np.random.default_rng(8)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(20)]
        right = rng.integers(0, 2, 20).astype(bool)
        for sides in (None, right):
            want = [(a, b) for a, b in itertools.combinations(range(20), 2) if (sides is None or sides[a] != sides[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 50 * len(np.union1d(sets[a], sets[b]))]
            a, b = passages._links_of(np.array([len(s) for s in sets]), np.concatenate(sets), sides, 50)
            assert components(20, zip(a, b)) == components(20, want) and len(a) < 20


@pytest.mark.parametrize("case", ["plain", "clashing", "empty"])
def test_pipeline(spark, tmp_path, case):
    import corpus_pipeline

    rng = np.random.default_rng(6)
    item = " ".join(rng.choice(VOCABULARY, 40)) + ". answer words follow here."
    body = [" ".join(rng.choice(VOCABULARY, 80)) for _ in range(20)]
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(body)] + [(20, body[0], "en", "t", 1), (21, body[1] + " " + item, "en", "s", 1), (22, "12 34", "en", "s", 5), (23, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows if case != "empty" else [], "doc_id long, text string, lang string, source string, n_chars long")
    if case == "clashing":
        for name in ("score", "lang_pred", "n_lines", "node", "__host", "ids", "row", "item_id"):
            docs = docs.withColumn(name, F.lit(None).cast("int"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == (list(range(20)) if case != "empty" else []) and all(r.round_trip for r in out)


SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def plain(value):
        # A column of whole numbers with nulls has another type in each library.
        return None if pd.isna(value) else int(value) if isinstance(value, (float, np.floating, np.integer)) and value == int(value) else value

    rows = lambda frame: sorted(str([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))
    assert rows(got) == rows(want)
