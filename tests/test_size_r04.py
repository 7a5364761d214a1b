"""What keeps the rules fast and the driver small on large tables: places by bisection, arrays of hits that aren't broadcast, findings read once."""

import random
import re
import time

from pyspark.sql import functions as F

from quillspark.functions.text import enclosing
from quillspark.operators import checks, echoes, findings, lexical, regions
from quillspark.plans import queries
from quillspark.sources.chapters import from_text

HIT = "chapter_number long, rule_ord int, start long, end long, rule_id string, text string, word string"


def test_places_need_no_broadcast(spark):
    """Arrays of all hits went through the driver: their table is small, they aren't."""
    laid = regions.laid_out(from_text(spark, "One two. One three."))
    hits = spark.createDataFrame([(1, 7, 0, 3, "echo.local_repeat", None, "one")], HIT)
    found = checks.placed(hits, laid)
    assert found.first().text == "One two."
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_sentences_round_echoes_are_those_of_the_column(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é\U0001f600 .!?\n\t ") for _ in range(rng.choice([1, 2, 5, 20, 60]))) for _ in range(300)]
    spans = [sorted((rng.randint(0, len(t)), rng.randint(0, len(t)))) for t in texts]
    rows = spark.createDataFrame([(t, a, b) for t, (a, b) in zip(texts, spans)], "t string, start long, end long")
    want = [tuple(r.w) for r in rows.select(enclosing(F.col("t"), F.struct("start", "end")).alias("w")).collect()]
    assert [checks._widened(t, checks._stops(t)[0], a, b) for t, (a, b) in zip(texts, spans)] == want


def test_hits_without_a_place_or_a_chapter_keep_none(spark):
    laid = regions.laid_out(from_text(spark, "One.\n\n---\n\nTwo."))
    rows = [(1, 0, None, None, "canon.x", "t", None), (1, 0, 11, 12, "mech.x", None, None), (1, 0, 4, 11, "rhythm.x", "t", None), (2, 0, 0, 1, "mech.x", "t", None)]
    got = checks.placed(spark.createDataFrame(rows, HIT), laid).orderBy("rule_id").collect()
    assert [(r.start, r.text, *(r[c] for c in checks.PLACE)) for r in got] == [
        (None, "t", None, None, None, None, None), (11, "T", 5, 5, 2, 11, 15), (4, "---", 1, 4, 1, None, None),
    ]


def test_a_long_chapter_with_echoes_is_placed_in_time(spark):
    """The text before every echo was read from its start, and its end searched: some minutes."""
    n = 40_000
    laid = regions.kept(from_text(spark, "Red wall. " * n))
    hits = spark.range(n).select(
        F.lit(1).cast("long").alias("chapter_number"), F.lit(7).alias("rule_ord"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 3).alias("end"),
        F.lit("echo.local_repeat").alias("rule_id"), F.lit(None).cast("string").alias("text"), F.lit("red").alias("word"),
    )
    begun = time.time()
    row = checks.placed(hits, laid).agg(F.count_if((F.col("text") == "Red wall.") & (F.col("start") % 10 == 0) & (F.col("end") == F.col("start") + 9)).alias("right")).first()
    assert row.right == n and time.time() - begun < 30


def test_a_judges_findings_are_read_once(spark):
    c = regions.kept(from_text(spark, "One two three."))
    rows = [(1, 7, 0, 3, "echo.phrase_dup", "echo"), (1, 3, 4, 7, "mech.missing_predicate", "grammar"), (1, 3, 8, 13, "mech.missing_predicate", "grammar"), (1, 0, 0, 1, "mech.x", "grammar")]
    found = spark.createDataFrame(rows, "chapter_number long, rule_ord int, start long, end long, rule_id string, category string")
    marked = found.withColumn("start", F.col("start") + F.rand() * 0).withColumn("start", F.col("start").cast("long"))
    out = findings.judge_candidates(c, marked, reserved=1)
    assert [(r.nth, r.source, r.text) for r in out.orderBy("nth").collect()] == [(1, "missing_predicate", "two"), (2, "missing_predicate", "three"), (3, "echo", "One")]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("rand(") == 1


def _odd_texts(seed, n):
    rng = random.Random(seed)
    bits = ["One two. ", "red ", "red wall ", "it's ", "\n", "\n\n", "\n \n", "# Head red\n", "---\n", "```\nred\n```\n", '"Red," ', "é\U0001f600 ", "Said! ", "a.”) ", " \t", "?\n", "red wall red wall "]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 30, 120]))) for _ in range(n)]


def _laid(spark, texts):
    return regions.laid_out(spark.createDataFrame(list(enumerate(texts)), "chapter_number long, content string"), with_told=True)


def test_sentences_of_chapters_are_those_of_the_column(spark):
    laid = _laid(spark, ["", "---\ntitle: x\n---\n", *_odd_texts(5, 200)])
    rows = laid.select("told", regions.sentence_spans(F.col("content"), F.col("skip")).alias("want")).collect()
    assert all(r.told == r.want for r in rows) and sum(len(r.told) for r in rows) > 500


def test_close_repeats_are_those_of_words_by_windows(spark):
    """The words of all chapters were sorted by word, to tell a few of them."""
    laid = _laid(spark, _odd_texts(6, 200))
    for window, at_least in ((40, 3), (3, 2), (1, 1)):
        found = echoes.close_repeats(laid, window, at_least)
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        want = echoes.local_repeats(echoes.content_words(laid), window, at_least)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_phrases_are_found_where_all_words_are_tried(spark):
    texts = _odd_texts(7, 200)
    laid = _laid(spark, texts)
    got = {(r.chapter_number, r.para): (r.phrase, r.gap, r.start, r.end) for r in echoes.phrase_repeats(laid, (3, 2), 2).collect()}
    want = {}
    for r in laid.select("chapter_number", "content", "skip").collect():
        at = 0
        for end, then in [*((m.start(), m.end()) for m in re.finditer(r"\n\s*\n", r.content)), (len(r.content), 0)]:
            tokens = echoes._tokens(r.content[at:end], [s.asDict() for s in r.skip], at)
            best = echoes._best_repeat([w for _, _, w in tokens], (3, 2), 2)
            if best:
                size, gap, first, last = best
                want[r.chapter_number, at] = (" ".join(w for _, _, w in tokens[first : first + size]), gap, tokens[first][0], tokens[last + size - 1][1])
            at = then
    assert got == want and len(want) > 20


def test_the_plan_of_all_rules_is_small(spark):
    """Each pattern was some hundred expressions, whose analysis took longer than a small table's rules."""
    laid = regions.kept(from_text(spark, "One  two."))
    begun = time.time()
    found = checks.all_hits(laid, checks.Config(banned=("a b",), pet_words={"a": 1}, spellings={"grey": "gray"}))
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000 and time.time() - begun < 15


def test_letters_of_other_cases_and_long_runs(spark):
    laid = _laid(spark, ["The  gRey ſee İt; SEE it, see IT. K", "x" + " " * 60_000 + "y"])
    rules = [lexical.banned(["see it"]), lexical.house_spelling({"grey": "gray"}), lexical.double_space, lexical.trailing_space]
    begun = time.time()
    got = sorted((r.chapter_number, r.rule_ord, r.start, r.end, r.replacement) for r in lexical.hits(laid, *rules).collect())
    assert got == [(0, 0, 10, 16, None), (0, 0, 18, 24, None), (0, 0, 26, 32, None), (0, 1, 5, 9, "gray"), (0, 2, 3, 5, " "), (1, 2, 1, 60_001, " ")] and time.time() - begun < 20


def test_rewrites_broadcast_nothing_that_grows(spark, tmp_path):
    text = "She went very far. She was very old. She sat very still. She saw it. " * 6
    spark.createDataFrame([(i, text) for i in range(2)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.rewrites(spark, str(tmp_path))
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString() and out.count() > 0
