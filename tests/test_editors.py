"""Models that are asked once, and what a chapter's findings become by them; all models are stubs."""

import json
import os
import re
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators import checks, editors, replies
from quillspark.operators.editors import Judges
from quillspark.sources.chapters import from_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])
#: A passage with three sentences that open alike, and one whose figure is hollow.
TEXT = (
    "# One\n\nMara sat down. Mara stood up. Mara looked at the old door for a long while and then she left it there.\n\nNobody had expected rain, a grey sort of answer.\n\n"
    "He took the the lamp  home. The lamp was lit."
)
GOOD = "Mara sat down, stood up, and looked at the old door for a long while before she left it there."


def counting(folder, answer):
    """A model that leaves a file for each call."""
    os.makedirs(folder, exist_ok=True)

    def model(prompt):
        with open(os.path.join(folder, f"{os.getpid()}-{os.urandom(8).hex()}"), "w") as f:
            f.write(prompt)
        return answer(prompt)

    return model


def calls(folder):
    return len(os.listdir(folder))


def test_prompts_are_asked_once(spark, tmp_path):
    asked, store = str(tmp_path / "asked"), f"file://{tmp_path}/store"

    def answer(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    rows = spark.createDataFrame([(i, p) for i, p in enumerate(["a", "b", "a", "bad", None, "c"] * 3)], "i int, prompt string").repartition(5)
    model = counting(asked, answer)
    out = replies.ask_once(rows, model, store, "role")
    want = [{"a": "A", "b": "B", "c": "C"}.get(p) for p in ["a", "b", "a", "bad", None, "c"] * 3]
    assert [r.reply for r in out.orderBy("i").collect()] == want and [r.reply for r in out.orderBy("i").collect()] == want
    assert calls(asked) == 4
    # A later run asks what failed and what is new; another role has replies of its own.
    replies.ask_once(rows, model, store, "role").count()
    assert calls(asked) == 5
    replies.ask_once(rows.filter("prompt = 'a'"), model, store, "other").count()
    assert calls(asked) == 6
    with pytest.raises(Exception, match="no"):
        replies.ask_once(rows, model, store, "role", strict=True)


def test_a_task_that_fails_has_its_replies_already(tmp_path):
    pending = f"file:{tmp_path}/pending"
    os.makedirs(tmp_path / "pending")
    seen, fail = [], [True]

    async def model(prompt):
        seen.append(prompt)
        if prompt == "p7" and fail[0]:
            raise RuntimeError("lost")
        return f"r{prompt}"

    batches = [pa.RecordBatch.from_arrays([pa.array([f"h{i}"]), pa.array([f"p{i}"])], names=["hash", "prompt"]) for i in range(10)]
    with pytest.raises(RuntimeError):
        list(replies._ask(iter(batches), model, pending, True))
    fail[0] = False
    got = [r for b in replies._ask(iter(batches), model, pending, True) for r in b.to_pylist()]
    assert [r["reply"] for r in got] == [f"rp{i}" for i in range(10)]
    assert sorted(seen) == sorted([f"p{i}" for i in range(10)] + ["p7"])


def test_at_most_four_calls_at_once(tmp_path):
    import asyncio

    os.makedirs(tmp_path / "pending")
    now, most = [0], [0]

    async def model(prompt):
        now[0] += 1
        most[0] = max(most[0], now[0])
        await asyncio.sleep(0.01)
        now[0] -= 1
        return prompt

    batch = pa.RecordBatch.from_arrays([pa.array([f"h{i}" for i in range(30)]), pa.array(["x"] * 30)], names=["hash", "prompt"])
    list(replies._ask(iter([batch]), model, f"file://{tmp_path}/pending", False))
    assert most[0] == 4


def writer_of(edit, **more):
    return lambda prompt: json.dumps({"purpose": "Mara waits.", "cuts": ["two beats"], "edit": edit, **more})


def kept(prompt):
    return json.dumps({"facts": [{"fact": "Mara left the door", "status": "kept"}, {"fact": "a mood", "status": "lost", "literal": False}], "added": [], "after_ok": True, "wording": ["merged"]})


def lost(prompt):
    return json.dumps({"facts": [{"fact": "the door", "status": "lost"}]})


def raising(prompt):
    raise ValueError


PASSAGE = TEXT.split("\n\n")[1]
#: Per chapter: its writer, its checker, and why its edit is rejected.
CASES = [
    (writer_of(GOOD), kept, None), (raising, kept, ["writer_failed"]), (lambda p: "no JSON", kept, ["writer_unreadable"]), (writer_of(PASSAGE.replace(" ", "  ")), kept, ["unchanged"]),
    (writer_of("..."), kept, ["empty"]), (writer_of(GOOD + " " + GOOD), kept, ["length"]), (writer_of(GOOD + ' "Yes."'), kept, ["dialogue"]), (writer_of(GOOD.replace(", stood", ",\n\nstood")), kept, ["paragraphs"]),
    (writer_of(GOOD.replace("Mara", "She")), kept, ["names"]), (writer_of(GOOD.replace("the old", "the very old")), kept, ["new_problem"]), (writer_of(GOOD), raising, ["checker_failed"]),
    (writer_of(GOOD), lambda p: "fine!", ["checker_unreadable"]), (writer_of(GOOD), lost, ["fact lost: the door"]), (writer_of(GOOD), lambda p: '{"facts": []}', ["checker listed no facts"]),
]
GARBLED_CHAPTER = len(CASES) + 1


def of_case(at):
    """The model of the chapter that a prompt is about."""
    return lambda prompt: CASES[int(re.search(r"case number (\d+)", prompt).group(1)) - 1][at](prompt)


def text_of(i):
    return TEXT.replace("Nobody had", f"In case number {i}, nobody had")


def garbled_items(prompt):
    if f"case number {GARBLED_CHAPTER}," not in prompt:
        return "[]"
    return "Here:\n```json\n" + json.dumps([
        {"excerpt": "the the lamp", "message": "Doubled word.", "suggestion": "the lamp", "severity": "ERROR"}, {"excerpt": "lamp", "message": "", "suggestion": "light", "severity": "odd"},
        {"excerpt": "not there", "message": "Lost.", "suggestion": None}, {"excerpt": "", "message": ""},
    ]) + "\n```"


def review(prompt):
    state = json.loads(prompt)
    assert state["question"] == "copy.garbled_or_voice" and state["flagged_excerpt"] in state["surrounding_prose"]
    return json.dumps({"choice": "garbled" if "the the" in state["flagged_excerpt"] else "voice", "confidence": 0.9})


def hollow(prompt):
    assert ", nobody had expected rain, a grey sort of answer." in prompt.partition("CANDIDATES:\n1. ")[2]
    return '[{"n": 1, "label": "works"}, {"n": 1, "label": "HOLLOW", "phrase": "a grey  sort of answer", "why": "says nothing."}, {"n": 9, "label": "HOLLOW"}]' if f"number {GARBLED_CHAPTER}," in prompt else "[]"


def judge(prompt):
    state = json.loads(prompt)
    assert {"prose", "findings", "title", "glossary", "cast"} <= set(state)
    if state["chapter_number"] != 1:
        return "{}"
    return json.dumps({"choices": {"copy.style_consistency": {"choice": "concern", "confidence": 0.8}, "copy.grammar_ambiguity": {"choice": "warning", "confidence": 0.9}}, "nouls": {"copy.echo_context": 0.705, "copy.wordiness_context": 0.2}})


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """All models over a chapter for each case and one with garbled text: findings by chapter, and the folders of calls."""
    folder = str(tmp_path_factory.mktemp("models"))
    models = {"writer": of_case(0), "checker": of_case(1), "garbled": garbled_items, "review": review, "hollow": hollow, "chapter": judge}
    counted = {name: counting(f"{folder}/{name}", model) for name, model in models.items()}
    CASES.append((writer_of(GOOD), kept, None))
    rows = from_table(spark.createDataFrame([(i, text_of(i)) for i in range(1, GARBLED_CHAPTER + 1)], "doc_id long, text string"))
    people = spark.createDataFrame([("Mara", "she/her")], "name string, pronouns string")
    found = checks.check(rows, checks.Config(), judges=Judges(store=f"file://{folder}/store", asks=2, **counted), cast=people)
    of = {}
    for r in sorted(found.collect(), key=lambda r: r.id):
        of.setdefault(r.chapter_number, []).append(r.asDict() | {"metadata": json.loads(r.metadata or "{}")})
    CASES.pop()
    return of, folder


def test_a_checked_edit_is_a_finding(run):
    of, folder = run
    text = text_of(1)
    edit = next(r for r in of[1] if r["rule_id"] == "rewrite.passage")
    assert (edit["category"], edit["severity"], edit["engine"], edit["applyable"], edit["suggestion"]) == ("rewrite", "suggestion", "llm", False, GOOD)
    assert edit["message"] == "Passage edit: Mara waits." and text[edit["start"] : edit["end"]].startswith(PASSAGE) and edit["metadata"]["rewrite_original"] == edit["excerpt"]
    assert json.loads(edit["metadata"]["wording"]) == ["merged", "lost: a mood"] and "rhythm.same_opener_run" in json.loads(edit["metadata"]["target_rules"]) and json.loads(edit["metadata"]["cuts"]) == ["two beats"]
    assert [f["fact"] for f in json.loads(edit["metadata"]["facts"])] == ["Mara left the door"] and (edit["scene"], edit["line_start"]) == (1, 3)
    prompts = [open(x.path).read() for x in os.scandir(f"{folder}/writer")]
    mine = next(p for p in prompts if "number 2," in p)
    assert "CAST:\nMara: she/her" in mine and "BEFORE:\n# One" in mine and f"PASSAGE:\n{PASSAGE}" in mine and "AFTER:\nIn case number 2, nobody" in mine and "NOTES:\n- 3 sentences in a row start with “mara”." in mine
    # One call for each chapter, and no checker where the writer's edit didn't pass.
    assert len(prompts) == len(of) == calls(f"{folder}/garbled") == calls(f"{folder}/chapter") and calls(f"{folder}/checker") == 5


@pytest.mark.parametrize("case", range(2, len(CASES) + 1))
def test_rejected_edits_tag_their_notes(run, case):
    rows, reasons = run[0][case], CASES[case - 1][2]
    assert not any(r["rule_id"] == "rewrite.passage" for r in rows)
    tags = {r["rule_id"]: r["metadata"] for r in rows if "rewrite_rejected" in r["metadata"]}
    assert list(tags) == ["rhythm.same_opener_run"] and json.loads(tags["rhythm.same_opener_run"]["rewrite_rejected"]) == reasons
    assert ("rewrite_rejected_edit" in tags["rhythm.same_opener_run"]) == (reasons[0] not in ("writer_failed", "writer_unreadable"))


def test_garbled_text_is_found_and_reviewed(run):
    """"lamp" is searched from where the doubled word ended, and is voice; the third is beyond the budget of two."""
    rows = [r for r in run[0][GARBLED_CHAPTER] if r["rule_id"] == "llm.garbled"]
    assert [(r["severity"], r["message"], r["applyable"], r["replacement"]) for r in rows] == [("error", "Doubled word.", True, "the lamp"), ("warning", "Lost.", False, None)]
    text = text_of(GARBLED_CHAPTER)
    assert text[rows[0]["start"] : rows[0]["end"]] == "the the lamp" and rows[0]["metadata"] == {"garbled_review": "garbled"} and rows[1]["metadata"] == {"unanchored": "true"} and rows[1]["start"] is None
    assert calls(f"{run[1]}/review") == 2


def test_hollow_images_and_the_chapters_judge(run):
    rows = {r["rule_id"]: r for r in run[0][1]}
    image = next(r for r in run[0][GARBLED_CHAPTER] if r["rule_id"] == "hollow.image")
    assert image["message"] == "Hollow image “a grey sort of answer”. says nothing." and text_of(GARBLED_CHAPTER)[image["start"] : image["end"]] == "a grey sort of answer"
    # Two flagged neighbours are one passage, which an edit of the first alone leaves a paragraph short.
    assert image["metadata"]["rewrite_rejected"] == '["paragraphs"]'
    assert (rows["copy.style_consistency"]["id"], rows["copy.style_consistency"]["start"]) == ("ts-c001-0002", None)
    assert rows["copy.grammar_ambiguity"]["message"].startswith("TypeSafe grammar warning: review this passage for an actionable defect.")
    assert rows["copy.echo_context"]["message"].startswith("TypeSafe echo judgment: likely issue in context (noul=0.7") and rows["copy.echo_context"]["confidence"] == 0.705 and "copy.wordiness_context" not in rows


def test_skipped_rules_trigger_no_rewrite(spark, tmp_path):
    c = from_table(spark.createDataFrame([(1, text_of(1))], "doc_id long, text string"))
    own = Judges(store=f"file://{tmp_path}/store", writer=counting(str(tmp_path / "w"), writer_of(GOOD)), checker=kept)
    rows = checks.check(c, judges=own, skip_rules=["rhythm."]).collect()
    assert calls(tmp_path / "w") == 0 and rows and not any(r.rule_id.startswith(("rhythm", "rewrite")) for r in rows)


def test_missing_predicates_beyond_the_budget_are_tagged(spark, tmp_path):
    c = from_table(spark.createDataFrame([(1, "A. " * 40)], "doc_id long, text string"))
    rows = [(1, 4, 0, "mech.missing_predicate", "grammar", "warning", "deterministic", i * 3, i * 3 + 2, "A.", None, False, None) for i in range(4)]
    f = spark.createDataFrame(rows, "chapter_number long, rule_ord int, turn int, rule_id string, category string, severity string, engine string, start long, end long, excerpt string, replacement string, applyable boolean, suggestion string").withColumn("metadata", F.lit(None).cast(editors.META))
    own = Judges(review=lambda p: json.dumps({"choice": "intentional", "confidence": 0.9}), asks=3, store=f"file://{tmp_path}/s")
    got = editors.reviewed(f, c, own, [], []).orderBy("start").collect()
    assert [(r.severity, r.metadata["missing_predicate_review"]) for r in got] == [*[("info", "intentional")] * 3, ("warning", "budget_exhausted")]
