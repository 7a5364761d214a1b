"""The call that runs every rule, places, glossary, duplicates, repairs and the cast."""

import itertools
import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillspark.functions import repair
from quillspark.functions.text import context, counts_line, covered_by_any, enclosing, flat_excerpt, line_at, outside, phrase_span, running, slug, within
from quillspark.operators import cast, checks, findings, lexical, prose, regions
from quillspark.sources.chapters import from_table, from_text

TEXT = "# Title\n\nHe  walked in order to rest. The shadow fell. A shadow moved.\nAnother shadow came , again.\n\n---\n\nVery  last."


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_check_gives_ids_and_places(spark):
    rows = checks.check(from_text(spark, TEXT)).orderBy("id").collect()
    assert [(r.id, r.rule_id) for r in rows] == [
        ("det-c001-0001", "mech.double_space"), ("det-c001-0002", "mech.double_space"), ("det-c001-0003", "mech.space_before_punct"), ("det-c001-0004", "word.in_order_to"),
    ]
    first, last = rows[0], rows[1]
    assert (first.line_start, first.line_end, first.scene, TEXT[first.sentence_start : first.sentence_end]) == (3, 3, 1, "He  walked in order to rest.")
    assert (last.line_start, last.scene, TEXT[last.start : last.end]) == (8, 2, "  ")


def test_skipped_rules_and_settings(spark):
    c = from_text(spark, TEXT)
    config = checks.Config(wordiness=False, rhythm=False, weakeners=False, banned=("shadow came",), pet_words={"shadow": 2}, spellings={"Title": "title"})
    # The third use of the pet word lies within the banned phrase, which is of the same category and comes first.
    assert sorted(r.rule_id for r in checks.check(c, config, ["mech.double"]).collect()) == ["guide.banned", "guide.pet_word", "guide.pet_word", "mech.space_before_punct"]


def test_every_rule_has_its_turn(spark):
    laid = regions.laid_out(from_text(spark, TEXT))
    near = checks.placed(checks.all_hits(laid).filter("rule_id = 'echo.local_repeat'"), laid).collect()
    assert [(r.word, r.text) for r in near] == [("shadow", "Another shadow came , again.")]


def test_glossary_protects_whole_words(spark):
    hits = [(1, 0, "word.x", 0, 5, "every one", "each one", None), (1, 0, "word.x", 6, 9, "very big", "big", None), (1, 0, "word.x", 10, 19, "Old  Ones", "x", None), (1, 7, "echo.local_repeat", 20, 22, "s", None, "ones"), (1, 7, "echo.local_repeat", 30, 32, "s", None, "twos")]
    df = findings.of_hits(spark.createDataFrame(hits, "chapter_number long, rule_ord int, rule_id string, start long, end long, text string, replacement string, word string"), keep=["word"])
    forms = spark.createDataFrame([("very",), ("old ones",)], "form string")
    assert sorted(r.start for r in findings.without_protected(df, forms).collect()) == [0, 30]
    spelled = spark.createDataFrame([("Mara", 2), ("mara", 1), (" Quill ", 3), ("", 4)], "form string, nth int")
    assert sorted(r.form for r in findings.distinct_forms(spelled).collect()) == ["Quill", "mara"]


def brute_dedupe(rows):
    rank = {"deterministic": 3, "typesafe": 2, "llm": 1}
    kept = []
    for row in rows:
        for i, prior in enumerate(kept):
            a, b = row["start"], prior["start"]
            if a is not None and b is not None:
                shared = max(0, min(row["end"], prior["end"]) - max(a, b))
                whole = max(row["end"], prior["end"]) - min(a, b)
                inside = (a >= b and row["end"] <= prior["end"]) or (b >= a and prior["end"] <= row["end"])
                same = whole > 0 and (shared * 2 >= whole or inside)
            else:
                same = a is None and b is None and " ".join(row["message"].lower().split()) == " ".join(prior["message"].lower().split())
            if same:
                if rank[row["engine"]] > rank[prior["engine"]]:
                    kept[i] = row
                break
        else:
            kept.append(row)
    return kept


def test_dedupe_by_brute_force(spark):
    engines = ["llm", "typesafe", "deterministic"]
    rows = [
        {"chapter_number": 1, "category": "style", "rule_ord": i, "rule_id": "r", "start": s, "end": e, "engine": engines[i % 3], "message": m}
        for i, (s, e, m) in enumerate([(0, 10, "a"), (5, 12, "b"), (2, 4, "c"), (None, None, "Same  Note"), (None, None, "same note"), (30, 40, "d"), (36, 44, "e"), (None, None, "other"), (31, 39, "f"), (0, 40, "g"), (None, None, "SAME note ")])
    ]
    df = spark.createDataFrame(rows, "chapter_number long, category string, rule_ord int, rule_id string, start long, end long, engine string, message string").repartition(3)
    assert sorted(r.rule_ord for r in findings.dedupe(df).collect()) == sorted(r["rule_ord"] for r in brute_dedupe(rows))


def test_ids_stay_in_order_beyond_four_digits(spark):
    df = spark.createDataFrame([(1, f"det-c001-{i:04d}", "style") for i in (10000, 9999, 10001, 2)], "chapter_number long, id string, category string")
    assert findings.chapter_rollup(df).first()["finding_ids"] == "det-c001-0002,det-c001-9999,det-c001-10000,det-c001-10001"


def test_edits_that_overlap(spark):
    c = from_text(spark, "abcdef")
    edit = lambda rank, rule, s, e, old, new: (1, rank, rule, "deterministic", True, s, e, old, new)
    schema = "chapter_number long, severity string, rule_id string, engine string, applyable boolean, start long, end long, excerpt string, replacement string"
    df = spark.createDataFrame([edit("warning", "b", 0, 3, "abc", "X"), edit("error", "c", 2, 4, "cd", "-"), edit("info", "a", 5, 6, "f", ""), edit("error", "d", 4, 5, "q", "!")], schema)
    row = findings.apply_edits(c, df).first()
    assert (row.content, row.applied) == ("ab-e", 2)
    assert findings.apply_edits(c, df.limit(0)).first()["content"] == "abcdef"


def test_empty_scenes_are_listed(spark):
    laid = regions.laid_out(from_text(spark, "One here. \"Two,\" it said.\n---\n```\ncode\n```\n---\nThree."))
    rows = prose.scene_profiles(regions.sentences(laid), regions.scenes(laid)).orderBy("scene").collect()
    assert [(r.sentences, r.narration, r.words) for r in rows] == [(2, 1, 5), (0, 0, 0), (1, 1, 1)]


def test_running_sums(spark):
    for n in (0, 1, 31, 32, 33, 1100, 40_000):
        got = value(spark, running(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x.cast("long")) if n else F.array().cast("array<bigint>")))
        assert got == list(itertools.accumulate(range(1, n + 1), initial=0))[:n]


def test_text_helpers(spark):
    t, span = F.lit("One a.\n  Two b c! Three"), F.struct(F.lit(11).alias("start"), F.lit(12).alias("end"))
    assert tuple(value(spark, enclosing(t, span))) == (9, 17)
    assert [value(spark, line_at(t, F.lit(i))) for i in (0, 6, 7, 99)] == [1, 1, 2, 2]
    assert value(spark, context(t, span, 3)) == " Two b "
    assert value(spark, flat_excerpt(F.lit(" a \n b" + "c" * 200))) == "a b" + "c" * 156 + "…"
    assert value(spark, slug(F.lit("A B/é"))) == "a-b-é" and value(spark, counts_line(F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1)))) == "a=1, b=2"
    assert tuple(value(spark, phrase_span(F.lit("an old\n  Key (x)"), F.lit("old key (x)")))) == (3, 16)
    assert value(spark, phrase_span(F.lit("abc"), F.lit("zzz"))) is None and value(spark, phrase_span(F.lit("abc"), F.lit(""))) is None
    held = F.array(F.struct(F.lit(0).alias("start"), F.lit(12).alias("end")))
    assert value(spark, covered_by_any(span, held)) is True and value(spark, covered_by_any(F.struct(F.lit(11).alias("start"), F.lit(13).alias("end")), held)) is False


@pytest.mark.parametrize("old, new, single, deletion, grammar, guess", [
    ("It", "Its", True, False, True, False), ("the the cat", "the cat", True, True, False, False), ("He ran", "She ran", True, False, False, True),
    ("cat", "cat's", True, False, True, False), ("a b", "a c b", True, False, False, False), ("same", "same", False, False, False, False), ("", "x", False, False, False, False),
    ("one very long phrase here", "quite another wording now", False, False, False, False), ("him", "his", True, False, False, False), ("I saw him", "I saw her", True, False, False, True),
])
def test_repairs(spark, old, new, single, deletion, grammar, guess):
    a, b = F.lit(old), F.lit(new)
    got = spark.range(1).select(repair.is_single_repair(a, b), repair.is_pure_deletion(a, b), repair.is_one_word_grammar(a, b), repair.is_pronoun_guess(a, b, F.lit(""))).first()
    assert tuple(got) == (single, deletion, grammar, guess)


def test_safe_repairs_are_marked(spark):
    c = from_text(spark, "He saw the the cat. It tail. It ran.")
    rows = [(1, 7, 18, "the the cat", "the cat", False, None), (1, 20, 22, "It", "Its", True, "Its"), (1, None, None, "He", "She", True, "She")]
    df = spark.createDataFrame(rows, "chapter_number long, start long, end long, excerpt string, suggestion string, applyable boolean, replacement string")
    assert sorted((r.excerpt, r.applyable, r.replacement) for r in cast.mark_safe_repairs(df, c).collect()) == [("He", False, None), ("It", False, None), ("the the cat", True, "the cat")]


CAST = [("Garrick Vale", "he/him"), ("Mara Quill", "she/her"), ("Of Stone", "he/him"), ("Al Vale", "they/them"), ("B", "x")]


def test_names_and_clashes(spark):
    people = spark.createDataFrame(CAST, "name string, pronouns string")
    got = {r.name: (r.tokens, r.family) for r in cast.members(people).collect()}
    assert got == {"Garrick Vale": (["Garrick Vale", "Garrick"], 3), "Mara Quill": (["Mara Quill", "Mara", "Quill"], 4), "Of Stone": (["Of Stone", "Stone"], 3), "Al Vale": (["Al Vale", "Al"], 6), "B": (["B"], None)}
    c = from_table(spark.createDataFrame([(1, "Garrick, the woman, ran. Garrick looked toward the woman. Quill was a tall boy. The girl, Stone, sat. Al, the girl, left. Garrick, the woman, ran.")], "doc_id long, text string"))
    assert sorted((r.name, r.sentence) for r in cast.pronoun_clashes(c, people).collect()) == [("Garrick Vale", "Garrick, the woman, ran."), ("Mara Quill", "Quill was a tall boy."), ("Of Stone", "The girl, Stone, sat.")]


def test_files_that_contradict_themselves(spark):
    schema = "name string, pronouns string, backstory string, arc_summary string, history array<string>, voice_observations array<struct<note:string>>"
    rows = [("Mara", "she/her", "A quiet one. He fled.", None, ["She came."], None), ("Garrick", "he/him", None, "He won.", None, [("Her voice is low.",)]), ("Al", "they/them", "He ran.", None, None, None), ("Lee", "she", "She ran.", "", [], [])]
    got = sorted((r.name, r.sentence, r.clashing) for r in cast.file_clashes(spark.createDataFrame(rows, schema)).collect())
    assert got == [("Garrick", "Her voice is low.", ["Her"]), ("Mara", "He fled.", ["He"])]


def test_garbled_notes_and_the_cast(spark):
    rows = [
        (1, "llm.garbled", "Garrick took it hat.", "It took it hat.", ""), (2, "llm.garbled", "Garrick lost it hat.", "Garrick lost his hat.", ""),
        (3, "llm.garbled", "Garrick lost his hat.", "Garrick lost her hat.", ""), (4, "llm.garbled", "the the cat", "the cat", ""), (5, "word.x", "he", "she", ""), (6, "llm.garbled", "a b", "a c", "Wrong pronoun"),
    ]
    df = spark.createDataFrame([(*r, True) for r in rows], "id int, rule_id string, excerpt string, replacement string, message string, applyable boolean")
    people = spark.createDataFrame(CAST[:2], "name string, pronouns string")
    assert sorted((r.id, r.applyable) for r in cast.garbled_by_cast(df, people).collect()) == [(2, False), (4, True), (5, True)]
    assert sorted(r.id for r in cast.garbled_by_cast(df, None).collect()) == [1, 4, 5]


def test_a_phrase_within_a_close_repeat_stays(spark):
    """Close repeats go before duplicates do, so that they can't stand in for a phrase."""
    c = from_text(spark, "The old silver lantern burned, the old silver lantern burned while silver rain fell.")
    assert [(r.rule_id, r.id) for r in checks.check(c).collect()] == [("echo.phrase_dup", "det-c001-0001")]


def test_findings_are_told_in_their_order(spark):
    """All of one mark before those of the other; wordy phrases by the list; terms by the list; numbers have gaps where duplicates went."""
    c = from_text(spark, "What?? No!! Really?? Due to the fact that, in order to. A telephone pole, a jurassic tree.")
    rows = sorted(checks.check(c).collect(), key=lambda r: r.id)
    got = [(r.rule_id, r.excerpt) for r in rows]
    assert got == [
        ("mech.repeated_punct", "!!"), ("mech.repeated_punct", "??"), ("mech.repeated_punct", "??"), ("anachronism.earth_timeline", "jurassic"), ("anachronism.earth_timeline", "telephone pole"),
        ("word.in_order_to", "in order to"), ("word.due_to_the_fact", "Due to the fact that"),
    ]
    assert [r.message for r in rows if r.rule_id.startswith(("mech", "word"))] == [
        "Repeated '!' punctuation may be intentional fiction intensity.", *["Repeated '?' punctuation may be intentional fiction intensity."] * 2, "Prefer 'to' over 'in order to'.", "Prefer 'Because' over 'Due to the fact that'.",
    ]
    assert [r.suggestion for r in rows][:3] == ["!", "?", "?"] and rows[-1].suggestion == "Because"


def test_the_cast_has_the_last_word(spark):
    people = spark.createDataFrame(CAST, "name string, pronouns string")
    text = "Garrick, the woman, ran  on. Garrick, the lady, was a tall woman. Mara, a man,  sat."
    rows = sorted(checks.check(from_text(spark, text), cast=people).collect(), key=lambda r: r.id)
    assert [(r.id, r.rule_id, r.start) for r in rows] == [("det-c001-0001", "mech.double_space", 23), ("det-c001-0002", "mech.double_space", 78), *((f"det-c001-000{i}", "canon.pronoun_prose", None) for i in (3, 4, 5))]
    assert [r.message for r in rows[2:]] == [
        "Garrick Vale is he/him in the character file, but this sentence also says woman.", "Garrick Vale is he/him in the character file, but this sentence also says lady.", "Mara Quill is she/her in the character file, but this sentence also says man.",
    ]


def test_names_are_looked_up_by_their_words(spark):
    """A cast of many: equal joins only, names of odd characters too."""
    people = spark.createDataFrame([(f"N{i} O'Neil-{i}", "he/him") for i in range(300)] + [("***", "she/her"), ("Ärne Öl", "he/him")], "name string, pronouns string")
    c = from_text(spark, "The girl, N7, sat. ÄRNE was a woman. N7x, the girl, ran. N123's, the small woman. Then O'Neil-5 was a girl. It was, the boy, N5.")
    found = cast.tied_sentences(c, people)
    assert sorted((r.name, r.nouns) for r in found.collect()) == [("N123 O'Neil-123", ["woman"]), ("N5 O'Neil-5", ["girl"]), ("N7 O'Neil-7", ["girl"]), ("Ärne Öl", ["woman"])]
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_dedupe_of_random_findings_by_brute_force(spark):
    rng = random.Random(3)
    engines = ["llm", "typesafe", "deterministic"]
    for spread in (40, 400, 4000):
        rows = []
        for i in range(600):
            start = rng.randrange(spread)
            placed = rng.random() < 0.9
            rows.append({
                "chapter_number": 1, "category": "style", "rule_ord": i, "rule_id": "r", "start": start if placed else None, "end": start + rng.choice([0, 1, 2, 5, 9, 30, 200]) if placed else None,
                "engine": rng.choice(engines), "message": rng.choice(["One", "one ", "two", "three"]),
            })
        df = spark.createDataFrame(rows, "chapter_number long, category string, rule_ord int, rule_id string, start long, end long, engine string, message string").repartition(3)
        assert sorted(r.rule_ord for r in findings.dedupe(df).collect()) == sorted(r["rule_ord"] for r in brute_dedupe(rows))


def test_a_long_chapter_is_folded_fast():
    frame = pd.DataFrame({"start": range(0, 1_000_000, 10), "end": range(8, 1_000_008, 10), "engine": "llm", "said": ""})
    frame.loc[::7, "end"] += 5
    begun = time.process_time()
    assert len(findings._fold(frame)) == 100_000
    assert time.process_time() - begun < 30


def test_a_chapter_with_very_many_hits(spark):
    """A hundred thousand hits among as many sentences: places are found by sorting, not by trying all with all."""
    n = 100_000
    laid = regions.laid_out(spark.range(1).select(F.lit(1).cast("long").alias("chapter_number"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("One two.\n"))), "").alias("content")))
    hits = spark.range(n).select(F.lit(1).cast("long").alias("chapter_number"), F.lit(0).alias("rule_ord"), F.lit("mech.x").alias("rule_id"), (F.col("id") * 9 + 3).alias("start"), (F.col("id") * 9 + 4).alias("end"), F.lit(" ").alias("text"))
    begun = time.time()
    row = checks.placed(hits, laid).agg(F.count("*").alias("n"), F.count_if((F.col("line_start") == F.floor((F.col("start") - 3) / 9) + 1) & (F.col("sentence_start") == F.col("start") - 3) & (F.col("sentence_end") == F.col("start") + 5) & (F.col("scene") == 1)).alias("right")).first()
    assert (row["n"], row["right"]) == (n, n) and time.time() - begun < 240


def test_points_in_spans(spark):
    spans = spark.createDataFrame([(1, 0, 3, "a"), (1, 5, 9, "b"), (2, 2, 4, "c")], "chapter_number long, start long, end long, x string")
    rows = spark.createDataFrame([(1, 0, 1), (1, 2, 6), (1, 3, 4), (1, 8, 8), (1, 9, 10), (2, 0, 2), (2, 3, 9), (3, 1, 2), (1, None, None)], "chapter_number long, start long, end long")
    got = {(r.chapter_number, r.start): r.x for r in within(rows, spans, ["x"]).collect()}
    assert got == {(1, 0): "a", (1, 2): "a", (1, 3): None, (1, 8): "b", (1, 9): None, (2, 0): None, (2, 3): "c", (3, 1): None, (1, None): None}
    assert sorted((r.chapter_number, r.start) for r in outside(rows.filter("start is not null"), spans).collect()) == [(1, 3), (1, 9), (2, 0), (3, 1)]
