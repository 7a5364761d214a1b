"""Rules on small chapters, and every query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from quillspark.functions.text import matches, truncate_middle
from quillspark.operators import echoes, findings, lexical, prose, regions
from quillspark.plans import oracle
from quillspark.plans.queries import QUERIES
from quillspark.sources.chapters import from_markdown, from_text
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def chapter(spark, text):
    return regions.laid_out(from_text(spark, text))


def hits(c, rule):
    return lexical.hits(c, rule)


def spans(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


@pytest.mark.parametrize("text, want", [("He  walked.\n", [(2, 4)]), ("  indented\n", []), ("---\ntitle:  x\n---\nOk  prose.\n```\ncode  here\n```\n", [(20, 22)])])
def test_double_space(spark, text, want):
    c = chapter(spark, text)
    assert spans(hits(c, lexical.double_space)) == want


def test_trailing_space_and_punctuation(spark):
    c = chapter(spark, "Hello  \nWorld\nHello , you.\nHe said, \"Wait , please.\"\nNo!!!! What????")
    assert spans(hits(c, lexical.trailing_space)) == [(5, 7)]
    assert [r.replacement for r in hits(c, lexical.space_before_punctuation).collect()] == [","]
    assert hits(c, lexical.repeated_punctuation).count() == 2


def test_offsets_are_code_points(spark):
    assert spans(matches(chapter(spark, "café 😀 end"), "😀")) == [(5, 6)]


def test_em_dash_and_earth(spark):
    c = chapter(spark, "Wait—no. Wait -- no. A --- line.\n---\n")
    assert hits(c, lexical.em_dash).count() == 2
    c = chapter(spark, "A pre-Cambrian telephone pole stood.")
    assert sorted(r.text for r in hits(c, lexical.earth_timeline).collect()) == ["Cambrian", "pre-Cambrian", "telephone pole"]
    c = chapter(spark, "In London a jurassic pole stood.")
    assert hits(c, lexical.earth_timeline).count() == 0


def test_wordiness_keeps_case_and_the_longer_phrase(spark):
    c = chapter(spark, "Prior to dawn, a number of birds sang due to the fact that \"prior to\" it was light.")
    got = [(r.text, r.replacement) for r in hits(c, lexical.wordiness).orderBy("start").collect()]
    assert got == [("Prior to", "Before"), ("a number of", "several"), ("due to the fact that", "because")]


def test_echoes(spark):
    c = chapter(spark, "A shadow fell. The shadow moved. Another shadow came. Which measured the morning. No. Which measured the air.")
    assert [r.word for r in echoes.local_repeats(echoes.content_words(c)).collect()] == ["shadow"]
    assert [r.phrase for r in echoes.phrase_repeats(chapter(spark, "It was long which measured the morning which measured the air.")).collect()] == ["which measured the"]


def test_scenes_sentences_and_runs(spark):
    c = chapter(spark, "---\na: b\n---\nOne here.\n---\nTwo there. Three.\n")
    assert [(r.scene, r.start) for r in regions.scenes(c).orderBy("scene").collect()] == [(1, 13), (2, 26)]
    assert [r.text for r in regions.sentences(c).orderBy("idx").collect()] == ["One here.", "Two there.", "Three."]
    assert regions.scenes(chapter(spark, "")).count() == 1
    runs = prose.opener_runs(regions.sentences(chapter(spark, "She walked in. She sat. She rose. He ran.")))
    assert [(r.opener, r.sentences) for r in runs.collect()] == [("she", 3)]
    broken = chapter(spark, "She walked in. She sat down. \"Hi,\" she said. She looked up.")
    assert prose.opener_runs(regions.sentences(broken)).count() == 0


def test_weak_words(spark):
    s = regions.sentences(chapter(spark, "She was very tired and he saw it. The ship seemed far. \"No,\" he said quietly."))
    assert sorted((r.rule_id, r.word) for r in prose.weak_words(s).collect()) == [("weak.filter_word", "saw"), ("weak.qualifier", "very"), ("weak.tag_adverb", "quietly")]
    assert prose.dense_weak_words(s).count() == 0
    assert prose.dense_weak_words(s, min_words=1).count() == 3


def test_guide(spark):
    c = chapter(spark, "# Grey\nGrey grey GREY. Of\nthe of the.")
    assert sorted(r.replacement for r in hits(c, lexical.house_spelling({"grey": "gray"})).collect()) == ["GRAY", "Gray", "gray"]
    assert hits(c, lexical.banned(["of the"])).count() == 2
    assert hits(c, lexical.pet_words({"grey": 3})).count() == 0
    assert hits(c, lexical.pet_words({"grey": 2})).count() == 3


def test_apply_and_dedupe(spark):
    c = chapter(spark, "He  walked , yes.")
    hits = findings.with_ids(findings.of_hits(lexical.hits(c, lexical.double_space, lexical.space_before_punctuation)))
    assert [r.id for r in hits.orderBy("id").collect()] == ["det-c001-0001", "det-c001-0002"]
    assert findings.apply_edits(c, hits).first()["content"] == "He walked, yes."
    doubled = hits.unionByName(hits.withColumn("rule_ord", F.lit(9)))
    assert findings.dedupe(doubled).count() == 2


def test_anchor_moves_on(spark):
    rows = spark.createDataFrame([(1, "a b a b", ["b", "b", "b", "x"])], "chapter_number long, content string, excerpts array<string>")
    assert [(r.n, r.start) for r in findings.anchored(rows).orderBy("n").collect()] == [(1, 2), (2, 6), (3, None), (4, None)]


def test_truncate_middle(spark):
    got = spark.range(1).select(truncate_middle(F.lit("a" * 30 + "b" * 30), 21).alias("t")).first()["t"]
    assert got == "a" * 9 + "\n…\n" + "b" * 9


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "chapter-010.md").write_bytes(b"# Ten\r\ntext")
    (tmp_path / "chapter-002.md").write_text("no title")
    (tmp_path / "chapter-002x.md").write_text("other")
    rows = from_markdown(spark, str(tmp_path)).collect()
    assert [(r.chapter_number, r.title, r.content) for r in rows] == [(2, "chapter-002", "no title"), (10, "Ten", "# Ten\ntext")]


def _rows(frame):
    def plain(value):
        if value is None or pd.isna(value):
            return None
        return round(value, 9) if isinstance(value, float) else str(value) if isinstance(value, bool) else value

    return sorted(map(str, (tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(oracle.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert _rows(got) == _rows(want)
