"""Reports as files, texts as folders, and what is found round a book."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.__main__ import main
from quillspark.functions.tables import written
from quillspark.operators import cast, checks, findings, regions
from quillspark.plans import report
from quillspark.sources import discovery, files
from quillspark.sources.chapters import from_table

TEXT = "# One\n\nHe  walked , “so”. She was very tired.\n\n---\n\nShe sat. She rose. She ran."


@pytest.fixture(scope="module")
def book(spark):
    c = from_table(spark.createDataFrame([(1, TEXT), (2, "Fine.")], "doc_id long, text string"))
    # What several tests read is computed once.
    return c, written(checks.check(c, checks.Config(weak_words=0)))


def test_a_report_is_one_file(spark, tmp_path, book):
    c, found = book
    paths = [str(tmp_path / "a" / "report.json"), str(tmp_path / "b" / "copy.json")]
    report.write_file(paths, found, c, regions.laid_out(c), name="book", warnings=["w"], llm_enabled=True)
    text = open(paths[0], encoding="utf-8").read()
    told = json.loads(text)
    assert text == open(paths[1], encoding="utf-8").read() and text.endswith("}\n") and "“" not in json.dumps(told["summary"])
    assert set(told) == {*report.HEAD_KEYS, *report.TABLES} and len(told) == 15 and told["warnings"] == ["w"] and told["chapter_number"] is None
    assert [f["id"] for f in told["findings"]] == ["det-c001-0001", "det-c001-0002"] and {f["rule_id"] for f in told["may_look"]} == {"rhythm.same_opener_run", "weak.qualifier"}
    first = told["findings"][0]
    assert set(first) == {"id", "category", "severity", "message", "location", "engine", "suggestion", "rule_id", "applyable", "replacement", "confidence", "metadata"}
    assert first["location"] == {"chapter_number": 1, "chapter_path": "chapter-1", "line_start": 3, "line_end": 3, "char_start": 9, "char_end": 11, "excerpt": "  ", "scene": 1, "sentence_start": 7, "sentence_end": 25}
    assert told["summary"]["total_findings"] == 2 and [x["finding_ids"] for x in told["chapters"]] == [["det-c001-0001", "det-c001-0002"], []]
    assert [(s["scene"], s["words"], s["narration_sentences"]) for s in told["chapters"][0]["scenes"]] == [(1, 7, 1), (2, 6, 3)]
    assert os.listdir(tmp_path / "a") == ["report.json"] or sorted(os.listdir(tmp_path / "a")) == [".report.json.crc", "report.json"]


def test_files_are_replaced_together_or_not_at_all(spark, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    put = lambda text: lambda stream: stream.write(bytearray(text, "utf-8"))
    files.publish(spark, [one, two], put("old"))
    class Failing(Exception):
        pass

    calls = []
    rename = files._rename

    def fails(fs, old, new):
        calls.append(new.getName())
        if len(calls) == 4:
            raise Failing
        rename(fs, old, new)

    files._rename = fails
    try:
        with pytest.raises(Failing):
            files.publish(spark, [one, two], put("new"))
    finally:
        files._rename = rename
    assert [open(p).read() for p in (one, two)] == ["old", "old"] and not [n for n in os.listdir(tmp_path) if "new-" in n or "old-" in n and not n.endswith(".crc")]
    files.publish(spark, [one, two], put("new"))
    assert [open(p).read() for p in (one, two)] == ["new", "new"]


def test_where_reports_go(spark, tmp_path):
    stamp = datetime(2024, 5, 6, 7, 8, 9)
    path = report.report_path(spark, str(tmp_path), "analyze", stamp=stamp)
    assert path == f"{tmp_path}/analyze-20240506-070809.json" and report.report_path(spark, str(tmp_path), "companion", 7) == f"{tmp_path}/companion-ch007.json"
    open(path, "w").close()
    assert report.report_path(spark, str(tmp_path), "analyze", stamp=stamp) == f"{tmp_path}/analyze-20240506-070809-2.json"


def test_edited_chapters_as_files(spark, tmp_path, book):
    c, found = book
    edited = findings.apply_edits(c, found).select(F.concat(F.lit("chapter-"), F.lpad(F.col("chapter_number").cast("string"), 3, "0"), F.lit(".md")).alias("name"), F.col("content").alias("text"))
    assert files.write_texts(edited, str(tmp_path / "out")) == 2
    assert open(tmp_path / "out" / "chapter-001.md", encoding="utf-8").read() == TEXT.replace("He  walked ,", "He walked,") and open(tmp_path / "out" / "chapter-002.md").read() == "Fine."
    assert sorted(os.listdir(tmp_path / "out")) == ["chapter-001.md", "chapter-002.md"]
    with pytest.raises(FileExistsError):
        files.write_texts(edited, str(tmp_path / "out"))
    with pytest.raises(ValueError, match="one name"):
        files.write_texts(edited.withColumn("name", F.lit("x")), str(tmp_path / "other"))
    assert os.listdir(tmp_path) == ["out"]


def test_discovery(spark, tmp_path):
    story = tmp_path / "stories" / "The Jailer's Wound"
    (story / "chapters").mkdir(parents=True)
    for name in ("chapter-002.md", "chapter-010.md", "notes.md", "chapter-3x.md"):
        (story / "chapters" / name).write_text("# T\ntext")
    found = discovery.book(spark, str(story))
    assert [r.chapter_number for r in found.chapters.collect()] == [2, 10] and (found.slug, found.name) == ("the-jailer-s-wound", "The Jailer's Wound")
    one = discovery.one_chapter(spark, str(story / "chapters" / "chapter-010.md"))
    assert (one.chapter_number, one.name, one.chapters.count()) == (10, "The Jailer's Wound · Chapter 10", 1) and one.story_dir.endswith("The Jailer's Wound")
    for path, error in ((story / "none", FileNotFoundError), (story / "chapters" / "notes.md", ValueError), (tmp_path / "stories", FileNotFoundError)):
        with pytest.raises(error):
            discovery.book(spark, str(path))
    for path, error in ((story / "none.md", FileNotFoundError), (story / "chapters" / "notes.md", ValueError), (story, ValueError)):
        with pytest.raises(error):
            discovery.one_chapter(spark, str(path))
    (story / "chapters" / "chapter-2.md").write_text("again")
    with pytest.raises(ValueError, match="one chapter number"):
        discovery.book(spark, str(story))


def test_glossary_and_cast_above_a_chapter(spark, tmp_path):
    story = tmp_path / "stories" / "s"
    chapter = story / "a" / "b" / "chapter-001.md"
    chapter.parent.mkdir(parents=True)
    chapter.write_text("x")
    assert discovery.glossary_of(spark, str(chapter)).count() == 0 and discovery.cast_of(spark, str(chapter)).count() == 0
    assert discovery.notices(spark, str(story), 0, True) == ["No worldbuilding glossary found for this story."] and discovery.notices(spark, str(tmp_path / "x"), 3)[0] == "Book lexicon: 3 terms."
    (story / "canon" / "style").mkdir(parents=True)
    (story / "canon" / "style" / "worldbuilding-glossary.json").write_text('[{"term": "Shade", "aliases": ["shades"]}, {"term": " "}]')
    (story / "canon" / "characters").mkdir()
    (story / "canon" / "characters" / "mara.json").write_text('{"name": "Mara", "pronouns": "she/her", "backstory": "He fled. She came."}')
    (story / "canon" / "characters" / "bad.json").write_text("{")
    assert [r.term for r in discovery.glossary_of(spark, str(chapter)).collect()] == ["Shade"]
    people = discovery.cast_of(spark, str(chapter))
    assert [r.name for r in people.collect()] == ["Mara"]
    assert [(r.id, r.message, r.excerpt) for r in cast.file_findings(people).collect()] == [("det-c000-0001", "Mara's character file says she/her, but the file also uses He.", "He fled.")]
    deep = tmp_path / "stories" / "s" / "/".join("abcdefghij")
    deep.mkdir(parents=True)
    assert discovery.above(spark, str(deep), discovery.GLOSSARY) is None and discovery.above(spark, str(deep.parent.parent), discovery.GLOSSARY) is not None


def test_findings_by_kind(spark, book):
    rows = report.by_kind(book[1]).collect()
    assert [(r.severity, r.category, r.n) for r in rows] == [("error", "grammar", 2), ("suggestion", "rhythm", 1), ("suggestion", "weakener", 1)] and rows[0].ids == ["det-c001-0001", "det-c001-0002"]


def test_the_command_line(spark, tmp_path, capsys):
    story = tmp_path / "stories" / "s"
    (story / "chapters").mkdir(parents=True)
    (story / "canon" / "style").mkdir(parents=True)
    (story / "canon" / "characters").mkdir()
    (story / "canon" / "style" / "worldbuilding-glossary.json").write_text('[{"term": "in order to"}]')
    (story / "canon" / "characters" / "mara.json").write_text('{"name": "Mara", "pronouns": "she/her", "backstory": "He fled."}')
    (story / "chapters" / "chapter-001.md").write_text("# T\n\nShe  ran in order to rest. Mara, a tall man, sat prior to noon.")
    assert main(["init", str(story)]) == 0 and main(["init", str(story)]) == 0
    config = json.loads((story / "quillspark.json").read_text())
    assert config["echo_window"] == 40 and "parser" not in config
    (story / "quillspark.json").write_text(json.dumps({"banned": ["prior to"], "wordiness": False}))
    assert main(["analyze", str(story), "--reports", str(tmp_path / "r"), "--apply", str(tmp_path / "edited")]) == 0
    path = capsys.readouterr().out.split("\n")[-2]
    told = json.loads(open(path, encoding="utf-8").read())
    assert [(f["id"], f["rule_id"]) for f in told["findings"]] == [("det-c000-0001", "canon.pronoun_file"), ("det-c001-0001", "mech.double_space"), ("det-c001-0002", "guide.banned"), ("det-c001-0003", "canon.pronoun_prose")]
    assert told["warnings"][0] == "Book lexicon: 1 terms." and told["mode"] == "analyze" and told["apply"] is True and told["manuscript_name"] == "s"
    assert (tmp_path / "edited" / "chapter-001.md").read_text().startswith("# T\n\nShe ran in")
    assert main(["companion", str(story), "--reports", str(tmp_path / "r")]) == 1
    (story / "quillspark.json").write_text('{"bannned": []}')
    assert main(["companion", str(story / "chapters" / "chapter-001.md"), "--reports", str(tmp_path / "r")]) == 1 and "bannned" in capsys.readouterr().err
