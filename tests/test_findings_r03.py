"""What the findings of round 3 came to: phrases behind others, changes and anchors in long texts."""

import random
import re
import time

from pyspark.sql import functions as F

from quillspark.functions import repair
from quillspark.operators import findings, lexical, regions
from quillspark.plans import queries
from quillspark.sources.chapters import from_text


def test_a_phrase_behind_one_that_begins_within_a_word_is_found(spark):
    """The SQL of guide_banned, and of all queries that hold its rows, loses this one."""
    laid = regions.laid_out(from_text(spark, "An erathe the the lamp."))
    assert [(r.start, r.end) for r in lexical.hits(laid, lexical.banned(["the the"])).collect()] == [(10, 17)]


def _plainly(old, new):
    """The difference, character by character."""
    short, p, s = min(len(old), len(new)), 0, 0
    while p < short and old[p] == new[p]:
        p += 1
    while s < short - p and old[-1 - s] == new[-1 - s]:
        s += 1
    return p, s, old[p : len(old) - s], new[p : len(new) - s]


def test_differences_are_those_of_a_plain_walk(spark):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab é\U0001f600\n") for _ in range(rng.choice([0, 1, 2, 3, 7, 8, 9, 31, 33]))) for _ in range(300)]
    pairs = [*zip(made, made[1:]), *((x + y, x + z + y) for x, y, z in zip(made, made[1:], made[2:])), *((x, x) for x in made), ("", "")]
    rows = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "old string, new string")
    got = rows.select("old", "new", repair.difference(F.col("old"), F.col("new")).alias("d")).collect()
    assert [tuple(r.d) for r in got if None not in (r.old, r.new)] == [_plainly(*pair) for pair in pairs]
    assert {None if r.d is None else tuple(r.d) for r in got if None in (r.old, r.new)} <= {None, (None, None, None, None)}


def test_a_changed_line_is_no_array_of_characters(spark, tmp_path):
    """Each character of each line was matched by itself, and a line's difference was found three times."""
    spark.createDataFrame([(0, "a the b\nc")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.repair_gates(spark, str(tmp_path))
    assert [tuple(r) for r in found.orderBy("k").collect()] == [(0, 0, "the ", "", True, True, ""), (0, 1, "", "", False, False, "")]
    apart = spark.createDataFrame([("a", "b")], "old string, new string").select(repair.difference(F.col("old"), F.col("new")))
    assert "(?s)." not in apart._jdf.queryExecution().analyzed().toString()


def test_families_are_those_of_whole_words(spark):
    texts = ["It's mine, HE said; its its", "it''s 'tis i.e. theyx xthey _me I", "", "Ourselvesé weK", "himself's"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in [*texts, None]], "t string").select(repair.families(F.col("t"))).collect()]
    known = {w: i for i, of in enumerate(repair.FAMILIES) for w in of}
    assert got == [*(sorted({known[w.lower()] for w in re.findall(repair.WORD, x) if w.lower() in known}) for x in texts), None]


def test_anchors_in_odd_replies(spark):
    rows = [(1, "é\U0001f600 a a", ["a", "\U0001f600", "", None, "a", "a"]), (2, None, ["a"]), (3, "", ["a", ""]), (4, "aa", []), (5, "aa", None), (6, "aaa", ["aa", "aa", "a"])]
    df = spark.createDataFrame(rows, "chapter_number int, content string, excerpts array<string>")
    got = findings.anchored(df)
    assert [f.dataType.simpleString() for f in got.schema] == ["int", "int", "string", "int", "int"]
    assert sorted((r.chapter_number, r.n, r.start, r.end) for r in got.collect()) == [
        (1, 1, 3, 4), (1, 2, None, None), (1, 3, None, None), (1, 4, None, None), (1, 5, 5, 6), (1, 6, None, None), (2, 1, None, None), (3, 1, None, None), (3, 2, None, None),
        (6, 1, 0, 2), (6, 2, None, None), (6, 3, 2, 3),
    ]
    assert {r.excerpt for r in got.filter("chapter_number = 1").collect()} == {"a", "\U0001f600", "", None}


def test_anchors_take_time_in_proportion(spark):
    """A fold copied what it had found at each excerpt: twice the excerpts took four times as long, and these some minutes."""
    told = [f"Sentence {i}." for i in range(60_000)]
    row = [(1, " ".join(told), told)]
    begun = time.time()
    got = findings.anchored(spark.createDataFrame(row, "chapter_number long, content string, excerpts array<string>")).agg(F.count("start"), F.max("end")).first()
    assert tuple(got) == (60_000, len(row[0][1])) and time.time() - begun < 30
