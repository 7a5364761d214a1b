"""Repeated passages: how texts are cut, recall in texts of every punctuation, and the whole query by brute force."""

import itertools
from collections import Counter

import numpy as np
import pytest

from quillspark.llm import passages
from quillspark.llm.passages import Paragraphs
from quillspark.llm.textvec import Words

WORDS = [f"w{i}" for i in range(3000)]


def prose(rng, n, mark):
    out = []
    while n > 0:
        k = min(int(rng.integers(8, 18)), n) if mark is not None else n
        words = list(rng.choice(WORDS, k))
        words[-1] += mark or ""
        out.append(" ".join(words))
        n -= k
    return " ".join(out)


def test_ends_of_sentences():
    texts = ['a. b! c? d… e.) f!" g?’” h.»] i。 j？ k। l؟ m, n" o) p;', "x.y z.", "."]
    assert [w for t in texts for w, end in zip(t.split(), passages.sentence_ends(Words([t.encode()]))) if end] == ["a.", "b!", "c?", "d…", "e.)", 'f!"', "g?’”", "h.»]", "i。", "j？", "k।", "l؟", "z.", "."]


@pytest.mark.parametrize("mark", [".", "?", '!"', "。", "।", "…”", None])
def test_recall_of_planted_passages(mark):
    """Sixty words within other text of one line: twenty of them in a row at least are cut alike in both places."""
    rng = np.random.default_rng(1)
    found = 0
    for _ in range(100):
        passage = prose(rng, 60, mark)
        one, two = (f"{prose(rng, a, mark)} {passage} {prose(rng, b, mark)}" for a, b in ((150, 150), (90, 70)))
        p = Paragraphs([one.encode(), two.encode()])
        both = set(p.hash[p.doc == 0]) & set(p.hash[p.doc == 1])
        found += p.size[(p.doc == 0) & np.isin(p.hash, list(both))].sum() >= passages.MIN_WORDS
    assert found >= 95


def test_long_runs_of_equal_words_are_not_cut():
    assert list(Paragraphs([b"again " * 5000]).size) == [5000]


def brute(rows):
    """key, start, end, words, removed_words, copies of every passage, by comparing all paragraphs with all."""
    p = Paragraphs([t.encode() for _, t in rows])
    start, end = p.chars()
    sets = [set(p.shingles[a : a + n].tolist()) for a, n in zip(p.at, p.count)]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        same = p.hash[i] == p.hash[j]
        near = min(p.size[i], p.size[j]) >= passages.NEAR_WORDS and 100 * len(sets[i] & sets[j]) >= passages.PERCENT * len(sets[i] | sets[j])
        if same or near:
            parent[root(j)] = root(i)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(root(i), []).append(i)
    shared = {}
    for members in groups.values():
        if len({p.doc[i] for i in members}) > 1:
            first = min(members, key=lambda i: (rows[p.doc[i]][0], p.doc[i], p.seq[i]))
            shared |= {i: (len(members), i == first) for i in members}
    out = Counter()
    order = sorted(shared, key=lambda i: (p.doc[i], p.seq[i]))
    islands = []
    for i in order:
        if islands and p.doc[islands[-1][-1]] == p.doc[i] and p.seq[islands[-1][-1]] + 1 == p.seq[i]:
            islands[-1].append(i)
        else:
            islands.append([i])
    for island in islands:
        words = int(sum(p.size[i] for i in island))
        if words >= passages.MIN_WORDS:
            out[rows[p.doc[island[0]]][0], int(start[island[0]]), int(end[island[-1]]), words, int(sum(0 if shared[i][1] else p.size[i] for i in island)), max(shared[i][0] for i in island)] += 1
    return out


def test_the_whole_query_by_brute_force(spark):
    """Equal and near passages, within documents too, of every punctuation; near ones differ in a word of sixty and more."""
    rng = np.random.default_rng(4)
    planted = [prose(rng, 60, m) for m in (".", "?", "。", None)] + ["\n".join(prose(rng, 30, ".") for _ in range(2))]
    # A line of thirty words without a mark is one paragraph; near copies of it have one other word at its end.
    line = " ".join(rng.choice(WORDS, 30))
    rows = []
    for i in range(24):
        near = " ".join([*line.split()[:-1], f"x{i % 5}"])
        parts = [prose(rng, int(rng.integers(20, 60)), "."), planted[i % 5], prose(rng, 40, None), near if i % 3 == 0 else "", planted[(i + 1) % 5] if i % 4 == 0 else "", planted[i % 5] if i == 7 else ""]
        rows.append((i, "\n".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.start, r.end, r.words, r.removed_words, r.copies) for r in passages.repeated_passages(df).collect())
    assert sum(got.values()) > 24 and got == brute(rows)
