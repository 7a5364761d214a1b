"""Streaming, judges and reports."""

import json

from pyspark.sql import functions as F

from quillspark.operators import findings, judges, lexical
from quillspark.plans import report
from quillspark.sources.chapters import from_table
from quillspark.streaming.chapters import arriving, check_arriving


def two_chapters(spark):
    return from_table(spark.createDataFrame([(1, "He  walked , yes!!"), (2, "Fine.")], "doc_id long, text string"))


def some_findings(c):
    return findings.with_ids(findings.of_hits(lexical.hits(c, lexical.double_space, lexical.repeated_punctuation)))


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "chapter-003.md").write_text("# Three\nHe  ran.")
    (tmp_path / "in" / "notes.md").write_text("He  ran.")

    def run():
        check_arriving(arriving(spark, str(tmp_path / "in")), lambda c: lexical.hits(c, lexical.double_space), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return sorted((r.chapter_number, r.start) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(3, 10)]
    (tmp_path / "in" / "chapter-004.md").write_text("A  b")
    assert run() == [(3, 10), (4, 1)]


def test_a_failing_judge_costs_its_row_only(spark):
    def judge(row):
        if row["chapter_number"] == 2:
            raise ValueError
        return 'Sure:\n```json\n[{"excerpt": "He", "message": "m", "suggestion": "She", "severity": "error"}]\n```'

    rows = judges.ask(two_chapters(spark).select("chapter_number", "content"), judge, ["chapter_number", "content"])
    got = rows.select("chapter_number", judges.salvaged(F.col("reply"), judges.GARBLED).alias("r")).orderBy("chapter_number").collect()
    assert got[0].r[0].excerpt == "He" and got[1].r is None


def test_bands_budget_and_review(spark):
    p = spark.createDataFrame([(0.7,), (0.5,), (0.1,)], "p double").select(judges.band(F.col("p")).alias("b"))
    assert [r.b for r in p.collect()] == ["positive", "mid", "negative"]
    f = some_findings(two_chapters(spark))
    assert [r.asked for r in judges.within_budget(f, F.lit(0), 1).orderBy("start").collect()] == [True, False]
    verdicts = spark.createDataFrame([("det-c001-0001", "garbled", 0.9), ("det-c001-0002", "voice", 0.9)], "id string, choice string, confidence double")
    assert [(r.id, r.applyable) for r in judges.review_garbled(f, verdicts).collect()] == [("det-c001-0001", True)]
    assert [r.applyable for r in judges.review_garbled(f, verdicts.limit(0)).collect()] == [False, False]


def test_hollow_and_edits(spark):
    c = spark.createDataFrame([(1, 1, 100, 110, "the old key"), (1, 2, 120, 130, "other")], "chapter_number long, n int, start long, end long, text string")
    v = spark.createDataFrame([(1, 1, "hollow", "old", ""), (1, 2, "fine", "", "")], "chapter_number long, n int, label string, phrase string, why string")
    assert [(r.start, r.end) for r in judges.hollow_findings(c, v).collect()] == [(104, 107)]
    edits = [("Mara ran home now.", ""), ("Mara ran home.", "Mara ran home."), ("a b c d", "a"), ('He "hi" sat.', "He hi sat."), ("a\n\nb c", "a b c"), ("Mara ran home.", "She ran home."), ("Mara ran home.", "Mara walked home.")]
    rows = spark.createDataFrame(edits, "a string, b string").select(judges.edit_problem(F.col("a"), F.col("b")).alias("p"))
    assert [r.p for r in rows.collect()] == ["empty", None, None, "dialogue", "paragraphs", None, None]


def test_report(spark):
    c = two_chapters(spark)
    f = some_findings(c)
    rows = {r.chapter_number: json.loads(r.json) for r in report.as_json(report.report(c, f)).collect()}
    assert rows[1]["total"] == 2 and rows[1]["by_severity"]["error"] == 1 and rows[2]["findings"] == [] and rows[2]["by_engine"]["llm"] == 0
    assert report.problems(f, f.select("id")).count() == 0
    bad = f.unionByName(f.limit(1)).withColumn("rule_id", F.when(F.col("end") > 10, F.col("rule_id")))
    got = sorted(r.problem for r in report.problems(bad, spark.createDataFrame([("x",)], "id string")).collect())
    assert got[-1] == "repeated id" and "no such finding" in got and "missing value" in got


def test_report_is_written_whole(spark, tmp_path):
    c = two_chapters(spark)
    f = some_findings(c)
    path = report.write(str(tmp_path / "report"), f, c, name="book", llm_enabled=True)
    head = json.loads("".join(p.read_text() for p in (tmp_path / "report" / "head").glob("part-*")))
    assert head["summary"]["total_findings"] == 2 and head["summary"]["by_severity"] == {"error": 1, "info": 0, "suggestion": 0, "warning": 1}
    assert head["summary"]["by_engine"] == {"deterministic": 2, "llm": 0, "typesafe": 0} and head["summary"]["chapters_scanned"] == 2 and head["llm_enabled"] is True
    assert report.missing_keys(report.head(f, c)) == []
    rows = {r.chapter_number: r.finding_ids for r in spark.read.json(f"{path}/chapters").collect()}
    assert rows == {1: ["det-c001-0001", "det-c001-0002"], 2: []}
    broken = f.withColumn("excerpt", F.raise_error(F.lit("no text")).cast("string"))
    try:
        report.write(path, broken, c)
        raise AssertionError
    except Exception as error:  # noqa: BLE001
        assert "no text" in str(error)
    assert spark.read.json(f"{path}/findings").count() == 2 and [p.name for p in tmp_path.iterdir()] == ["report"]


def test_copy_findings_and_reviews(spark):
    passages = spark.createDataFrame([(1, 1, 0, 5, "heuristic", "first"), (1, 2, 9, 14, "echo", "other"), (2, 1, 3, 4, "heuristic", "x")], "chapter_number long, nth long, start long, end long, source string, text string")
    answers = [
        (1, "copy.grammar_ambiguity", "Error", 0.9, None), (1, "copy.echo_context", None, None, 0.7), (1, "copy.wordiness_context", None, None, 0.5), (1, "copy.style_consistency", "concern", 0.6, None),
        (2, "copy.grammar_ambiguity", "warning", 0.5, None), (3, "copy.wordiness_context", None, None, 0.9),
    ]
    got = judges.copy_findings(spark.createDataFrame(answers, "chapter_number long, question string, choice string, confidence double, probability double"), passages)
    assert sorted(((r.chapter_number, r.rule_id, r.severity, r.start, r.excerpt) for r in got.collect()), key=str) == [
        (1, "copy.echo_context", "suggestion", 9, "other"), (1, "copy.grammar_ambiguity", "error", 0, "first"), (1, "copy.style_consistency", "warning", None, ""), (3, "copy.wordiness_context", "suggestion", None, ""),
    ]
    f = spark.createDataFrame([("a", "mech.missing_predicate", "warning"), ("b", "mech.missing_predicate", "warning"), ("c", "word.x", "suggestion")], "id string, rule_id string, severity string")
    v = spark.createDataFrame([("a", "intentional", 0.9), ("b", "intentional", 0.2), ("c", "intentional", 0.9)], "id string, choice string, confidence double")
    assert {r.id: r.severity for r in judges.review_missing_predicates(f, v).collect()} == {"a": "info", "b": "warning", "c": "suggestion"}


def test_continuity(spark):
    replies = [
        'So: {"facts": [{"fact": "a key", "status": "Kept"}, {"fact": "mood", "status": "lost", "literal": false}]}', '{"facts": [{"fact": "a key", "status": "lost"}, {"fact": "x"}], "added": ["a dog", " "], "after_ok": false, "after_note": "n"}',
        '{"facts": []}', "nothing", None,
    ]
    got = spark.createDataFrame(list(enumerate(replies)), "i int, r string").orderBy("i").select(judges.continuity_problems(F.col("r")).alias("p")).collect()
    assert [r.p for r in got] == [[], ["fact lost: a key", "fact unclear: x", "fact added: a dog", "after text breaks: n"], ["checker listed no facts"], ["checker_unreadable"], ["checker_unreadable"]]


def test_what_a_judge_is_shown(spark):
    c = from_table(spark.createDataFrame([(1, "a" * 13_000), (2, "# T\nshort")], "doc_id long, text string"))
    passages = spark.createDataFrame([(1, 1, 0, 5, "s", "x"), (1, 2, 6500, 6600, "s", "gone"), (1, 3, 12_990, 13_000, "s", "z"), (1, 4, 5, 9, "s", "y"), (2, 1, 0, 2, "s", "alone")], "chapter_number long, nth long, start long, end long, source string, text string")
    rows = {r.chapter_number: r for r in judges.judge_state(c, some_findings(c), passages, ["line"] * 90).collect()}
    assert [p.text for p in rows[1].passages] == ["x", "z", "y"] and len(rows[1].prose) == 12_000 and rows[2].passages is None and rows[2].title == "T" and len(rows[1].glossary) == 80
    shapes = spark.createDataFrame([(1, i, i + 1) for i in range(90)], "chapter_number long, start long, end long")
    assert judges.hollow_candidates(shapes).count() == 80
    paras = spark.createDataFrame([(1, i, f"p{i}") for i in range(9)], "chapter_number long, para long, text string")
    units = spark.createDataFrame([(1, 4, 5), (1, 0, 0)], "chapter_number long, first long, last long")
    assert sorted((r.first, r.before, r.after) for r in judges.around_units(paras, units).collect()) == [(0, "", "p1\n\np2\n\np3"), (4, "p1\n\np2\n\np3", "p6\n\np7\n\np8")]
    assert spark.range(1).select(judges.new_rules(F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"))).alias("r")).first()["r"] == ["b"]
