"""Model judges: any callable that answers for one chapter, its adapters and its gates."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import phrase_span, truncate_middle
from .messages import filled, rounded

#: Bounds of the bands of a judge's probability, and the least confidence of a choice that counts.
POSITIVE, NEGATIVE, CONFIDENCE_FLOOR = 0.65, 0.35, 0.55
ASKS_A_CHAPTER = 12

GARBLED = "array<struct<excerpt:string,message:string,suggestion:string,severity:string>>"
HOLLOW = "array<struct<n:int,label:string,phrase:string,why:string>>"


def ask(rows: DataFrame, judge: Callable[[dict], str | None], columns: list[str]) -> DataFrame:
    """rows with reply: what the judge says of each row's columns.  A judge that fails gives null and the rest goes on."""

    def run(batches):
        for frame in batches:
            replies = []
            for row in frame[columns].to_dict("records"):
                try:
                    replies.append(judge(row))
                except Exception:  # noqa: BLE001  a judge is a guest: whatever it raises concerns its own row only
                    replies.append(None)
            yield frame.assign(reply=pd.Series(replies, index=frame.index, dtype=object))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, reply string")


def salvaged(reply: Column, schema: str) -> Column:
    """The JSON list in a reply: fences and prose round it are passed over; null if there is none."""
    bare = F.regexp_replace(reply, r"(?m)^```\w*\s*$", "")
    return F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")), schema)


def band(probability: Column) -> Column:
    return F.when(probability >= POSITIVE, "positive").when(probability <= NEGATIVE, "negative").otherwise("mid")


def within_budget(findings: DataFrame, phase: Column, limit: int = ASKS_A_CHAPTER) -> DataFrame:
    """findings with asked: the first of each chapter, by phase and place, up to the limit that the reviews share."""
    nth = F.row_number().over(Window.partitionBy("chapter_number").orderBy(phase, "start", "end", "rule_id"))
    return findings.withColumn("asked", nth <= limit)


def review_garbled(findings: DataFrame, verdicts: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """verdicts: id, choice, confidence.  "voice" drops the finding; only a sure "garbled" may be pasted."""
    joined = findings.join(verdicts, "id", "left")
    sure = F.coalesce(F.col("confidence") >= floor, F.lit(False))
    kept = joined.filter(F.coalesce(F.col("choice") != "voice", F.lit(True)))
    armed = F.coalesce(F.col("applyable") & sure & (F.col("choice") == "garbled"), F.lit(False))
    return kept.withColumn("applyable", armed).select(*findings.columns)


def hollow_findings(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """candidates: chapter_number, n, start, end, text; verdicts: chapter_number, n, label, phrase, why.  The span is the phrase's, else the sentence's."""
    rows = candidates.join(verdicts, ["chapter_number", "n"]).filter(F.upper("label") == "HOLLOW")
    rows = rows.withColumn("at", phrase_span(F.col("text"), F.coalesce("phrase", F.lit(""))))
    start = F.coalesce(F.col("start") + F.col("at.start"), F.col("start"))
    end = F.coalesce(F.col("start") + F.col("at.end"), F.col("end"))
    return rows.select("chapter_number", "n", start.alias("start"), end.alias("end"), F.lit("hollow.image").alias("rule_id"), "why")


#: An edit has at least this share of the words before it.
LEAST_SHARE = 0.25


def edit_problem(before: Column, after: Column, band: float = 0.4) -> Column:
    """Why a rewritten passage may not stand, or null: empty, length, dialogue (what is quoted), paragraphs."""
    words = lambda x: F.regexp_count(x, F.lit("[A-Za-z0-9']+"))
    quoted = lambda x: F.regexp_extract_all(x, F.lit('"[^"]*"|“[^”]*”'), F.lit(0))
    blocks = lambda x: F.regexp_count(x, F.lit(r"[^\n]++(?:\n[^\n]++)*+"))
    return (
        F.when(F.coalesce(words(after), F.lit(0)) == 0, "empty").when((words(after) < LEAST_SHARE * words(before)) | (words(after) > (1 + band) * words(before)), "length")
        .when(quoted(before) != quoted(after), "dialogue").when(blocks(before) != blocks(after), "paragraphs")
    )


#: What a judge is shown of a chapter: characters of prose, passages, findings, and lines of glossary and cast; fixed values.
PROSE_CHARS, PASSAGES, RESERVED, SHOWN_FINDINGS, BOOK_LINES, HOLLOW_CANDIDATES = 12_000, 8, 2, 40, 80, 80
#: Fewer passages than this are none.
LEAST_PASSAGES = 3
#: What is asked about a chapter, in the order in which answers become findings; fixed values.
QUESTIONS = ["copy.grammar_ambiguity", "copy.style_consistency", "copy.echo_context", "copy.wordiness_context"]
#: What the findings of a chapter's judge say.
GRAMMAR = "TypeSafe grammar {label}: review this passage for an actionable defect."
STYLE = "TypeSafe style concern: sudden register clash or tense wobble somewhere in this chapter."
LIKELY = "TypeSafe {label} judgment: likely issue in context (noul={value})."
#: The questions of which a sure choice, or a high probability, is a finding: answer, rule, category, severity, source of the passage.
CHOICES = [("error", "copy.grammar_ambiguity", "grammar", "error", None), ("warning", "copy.grammar_ambiguity", "grammar", "warning", None), ("concern", "copy.style_consistency", "style", "warning", None)]
PROBABILITIES = [("copy.echo_context", "echo"), ("copy.wordiness_context", "wordiness")]


def survives_truncation(start: Column, end: Column, length: Column, limit: int = PROSE_CHARS) -> Column:
    """Whether a span meets the head or the tail that is left when the middle of a text is cut out."""
    left = (limit - 3) // 2
    right = limit - 3 - left
    return (length <= limit) | (start < left) | (end > length - right)


def copy_findings(answers: DataFrame, candidates: DataFrame, floor: float = CONFIDENCE_FLOOR, positive: float = POSITIVE) -> DataFrame:
    """The copy.* findings of a judge's answers, none of which is ever pasted.

    answers: chapter_number, question, choice, confidence, probability; candidates:
    chapter_number, nth, start, end, source, text.  A finding stands at the first
    passage, if there is one of the question's own source at the first such; a
    concern about style is about the whole chapter and stands nowhere."""
    label = F.lower("choice")
    wanted, severity = F.lit(False), F.lit("suggestion")
    for choice, rule, _, level, _ in CHOICES:
        hit = (F.col("question") == rule) & (label == choice) & (F.col("confidence") >= floor)
        wanted, severity = wanted | hit, F.when(hit, level).otherwise(severity)
    source = F.lit(None).cast("string")
    for rule, name in PROBABILITIES:
        wanted = wanted | ((F.col("question") == rule) & (F.col("probability") >= positive))
        source = F.when(F.col("question") == rule, name).otherwise(source)
    category = F.coalesce(source, *(F.when(F.col("question") == rule, c) for _, rule, c, _, _ in CHOICES))
    rows = answers.withColumns({"severity": severity, "source": source, "category": category}).filter(F.coalesce(wanted, F.lit(False)))
    passages = candidates.groupBy("chapter_number").agg(F.array_sort(F.collect_list(F.struct("nth", "start", "end", "source", "text"))).alias("passages"))
    met = rows.join(passages, "chapter_number", "left")
    own = F.filter("passages", lambda p: p["source"] == F.col("source"))
    first = F.when(F.col("question") != "copy.style_consistency", F.coalesce(F.get(own, F.lit(0)), F.get("passages", F.lit(0))))
    said = F.when(F.col("question") == "copy.style_consistency", STYLE).when(F.col("source").isNull(), filled(GRAMMAR, label=label)).otherwise(
        filled(LIKELY, label=F.col("source"), value=rounded(F.col("probability"), 2))
    )
    shown = F.when(F.coalesce("p.text", F.lit("")) != "", F.concat(F.lit(" Excerpt: "), F.substring("p.text", 1, 120))).otherwise("")
    return met.withColumn("p", first).select(
        "chapter_number", F.col("question").alias("rule_id"), "category", "severity", F.lit("typesafe").alias("engine"), F.col("p.start").alias("start"), F.col("p.end").alias("end"),
        F.coalesce("p.text", F.lit("")).alias("excerpt"), F.lit(False).alias("applyable"), F.coalesce("probability", "confidence").alias("confidence"),
        F.concat(said, shown).alias("message"),
    )


def review_missing_predicates(findings: DataFrame, verdicts: DataFrame, floor: float = CONFIDENCE_FLOOR) -> DataFrame:
    """verdicts: id, choice, confidence.  A sentence that is surely meant so is information only; all else, unread ones too, stays as it is."""
    joined = findings.join(verdicts, "id", "left")
    meant = (F.col("rule_id") == "mech.missing_predicate") & (F.col("choice") == "intentional") & (F.col("confidence") >= floor)
    return joined.withColumn("severity", F.when(F.coalesce(meant, F.lit(False)), "info").otherwise(F.col("severity"))).select(*findings.columns)


FACTS = "array<struct<fact:string,status:string,literal:boolean,note:string>>"
CONTINUITY = f"struct<facts:{FACTS},added:array<string>,after_ok:boolean,after_note:string,wording:array<string>>"


def _status(fact: Column) -> Column:
    return F.lower(F.trim(F.coalesce(fact["status"], F.lit(""))))


def _facts(told: Column) -> Column:
    return F.filter(F.coalesce(told["facts"], F.array().cast(FACTS)), lambda f: f.isNotNull())


def literal_facts(told: Column) -> Column:
    """The facts of a checker's report (as CONTINUITY has it) that are meant literally."""
    return F.filter(_facts(told), lambda f: F.coalesce(f["literal"], F.lit(True)))


def wording(told: Column) -> Column:
    """What a report says of wording, with the figures that an edit dropped: they are no facts."""
    said = F.filter(F.transform(F.coalesce(told["wording"], F.array().cast("array<string>")), F.trim), lambda w: F.coalesce(w, F.lit("")) != "")
    figures = F.filter(_facts(told), lambda f: ~F.coalesce(f["literal"], F.lit(True)) & (_status(f) != "kept"))
    return F.concat(said, F.transform(figures, lambda f: F.concat(_status(f), F.lit(": "), F.trim(F.coalesce(f["fact"], F.lit(""))))))


def continuity_problems(reply: Column) -> Column:
    """Why a checker's report speaks against an edit: an array, empty if nothing does.

    Literal facts must be listed and all kept, none added, and what follows must not break."""
    told = F.from_json(F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")), CONTINUITY)
    none = F.array().cast("array<string>")
    literal = literal_facts(told)
    lost = F.transform(F.filter(literal, lambda f: _status(f) != "kept"), lambda f: F.concat(F.lit("fact "), F.coalesce(F.nullif(_status(f), F.lit("")), F.lit("unclear")), F.lit(": "), F.trim(F.coalesce(f["fact"], F.lit("")))))
    added = F.transform(F.filter(F.coalesce(told["added"], none), lambda a: F.coalesce(F.trim(a), F.lit("")) != ""), lambda a: F.concat(F.lit("fact added: "), F.trim(a)))
    breaks = F.when(F.coalesce(told["after_ok"], F.lit(True)), none).otherwise(F.array(F.concat(F.lit("after text breaks: "), F.trim(F.coalesce(told["after_note"], F.lit(""))))))
    bare = F.when(F.size(literal) == 0, F.array(F.lit("checker listed no facts"))).otherwise(none)
    return F.when(told.isNull(), F.array(F.lit("checker_unreadable"))).otherwise(F.concat(lost, added, breaks, bare))


def new_rules(before: Column, after: Column) -> Column:
    """The rules that an edit's text breaks and the text before didn't."""
    return F.array_except(after, before)


def hollow_candidates(shapes: DataFrame, limit: int = HOLLOW_CANDIDATES) -> DataFrame:
    """shapes with n: the first of each chapter in the order of the text, as one call of a judge is shown them."""
    n = F.row_number().over(Window.partitionBy("chapter_number").orderBy("start", "end"))
    return shapes.withColumn("n", n).filter(F.col("n") <= limit)


def around_units(paragraphs: DataFrame, units: DataFrame, reach: int = 3) -> DataFrame:
    """units (chapter_number, first, last) with before and after: the texts of up to reach paragraphs (chapter_number, para, text) on each side."""
    near = (F.col("p.para") >= F.col("u.first") - reach) & (F.col("p.para") <= F.col("u.last") + reach)
    met = units.alias("u").join(paragraphs.alias("p"), (F.col("u.chapter_number") == F.col("p.chapter_number")) & near)
    piece = F.struct(F.col("p.para"), F.col("p.text"))
    texts = met.groupBy(*(F.col(f"u.{c}") for c in units.columns)).agg(
        *(F.array_sort(F.collect_list(F.when(where, piece))).alias(name) for name, where in (("before", F.col("p.para") < F.col("u.first")), ("after", F.col("p.para") > F.col("u.last"))))
    )
    joined = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "\n\n").alias(c)
    return texts.select(*units.columns, joined("before"), joined("after"))


def shown_candidates(chapters: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidates that are left when the middle of a chapter is cut out; none of a chapter that has fewer than LEAST_PASSAGES."""
    lengths = chapters.select("chapter_number", F.length("content").alias("__length"))
    kept = candidates.join(lengths, "chapter_number").filter(survives_truncation(F.col("start"), F.col("end"), F.col("__length")))
    several = F.count("*").over(Window.partitionBy("chapter_number")) >= LEAST_PASSAGES
    return kept.withColumn("__several", several).filter("__several").drop("__length", "__several")


def judge_state(chapters: DataFrame, findings: DataFrame, candidates: DataFrame, glossary: list[str] | None = None, people: list[str] | None = None) -> DataFrame:
    """What a judge is told of each chapter: chapter_number, title, prose (its middle cut out), the first findings, the passages that survive the cut (LEAST_PASSAGES or more, or none), and lines of the book."""
    told = [c for c in ("rule_ord", "turn", "start", "rule_id", "category", "message", "excerpt") if c in findings.columns]
    shown = findings.groupBy("chapter_number").agg(F.slice(F.array_sort(F.collect_list(F.struct(*told))), 1, SHOWN_FINDINGS).alias("findings"))
    passages = shown_candidates(chapters, candidates).groupBy("chapter_number").agg(F.array_sort(F.collect_list(F.struct("nth", "text", "source"))).alias("passages"))
    rows = chapters.select("chapter_number", "title", truncate_middle(F.col("content"), PROSE_CHARS).alias("prose")).join(shown, "chapter_number", "left").join(passages, "chapter_number", "left")
    lines = lambda given: F.array(*map(F.lit, (given or [])[:BOOK_LINES])).cast("array<string>")
    return rows.withColumns({"glossary": lines(glossary), "cast": lines(people)})
