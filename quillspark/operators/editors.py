"""Model judges and rewrites composed: what a chapter's findings become when models are asked.

The order is fixed: the judge of a chapter, the detector of garbled text, the
judge of hollow images, the reviews (which share a budget for each chapter,
garbled text first), then rewrites of flagged passages.  A model is a callable
from a prompt to a reply; every prompt is asked once (replies.ask_once).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.tables import shared_dir, written
from ..functions.text import between, context, let, matches, strip
from . import cast as people
from . import checks, findings, judges, prose, regions
from .replies import Model, ask_once

#: The order in which engines follow the rules.
COPY, GARBLED, HOLLOW, REWRITE = 14, 15, 16, 17
#: Notes that a rewrite is for, fixed values.
TARGETS = ["rhythm.shape_run", "rhythm.same_opener_run", "weak.", "hollow."]
META = "map<string,string>"
ADDED = {"message": "string", "suggestion": "string", "replacement": "string", "confidence": "double", "metadata": META, "word": "string", "turn": "int", "applyable": "boolean"}

#: What models are told before a prompt.
TASKS = {
    "garbled": (
        'Find text in this chapter that is broken: words dropped or doubled, sentences cut off or without a main verb, leftovers of an edit. Answer with a JSON list of '
        '{"excerpt": exact text, "message": what is wrong, "suggestion": the repaired text, "severity": "error", "warning" or "suggestion"}; [] if all is well. '
        "Terms of the book and names of the cast are meant as they are."
    ),
    "hollow": (
        'Of the numbered candidates, mark those HOLLOW whose figure tells a reader nothing, the others WORKS. Answer with a JSON list of {"n": number, "label": "HOLLOW" or "WORKS", "phrase": the hollow words, "why": a few words}.'
    ),
    "writer": (
        "Edit the passage so that it does its work in the chapter better; the notes are hints. Keep every fact, all quoted speech, names, terms, the point of view, the tense and the number of paragraphs. "
        'Answer with JSON: {"purpose": one sentence, "facts": [facts that must survive], "cuts": [what changed and why], "edit": the passage}.'
    ),
    "checker": (
        "Compare the edited passage with the original. List each fact of the original and whether it is kept, changed or lost, what the edit adds, and whether the text after it still reads right. "
        'Answer with JSON: {"facts": [{"fact": ..., "status": "kept", "changed" or "lost", "literal": true or false}], "added": [...], "after_ok": true or false, "after_note": ..., "wording": [...]}.'
    ),
}


@dataclass(frozen=True)
class Judges:
    """The models that are asked; what is None isn't.

    chapter answers a state with {"choices": {question: {"choice", "confidence"}}, "nouls": {question: probability}}, and its errors are raised;
    review answers one flagged passage with {"choice", "confidence"}; the others answer as TASKS asks them to."""

    chapter: Model | None = None
    garbled: Model | None = None
    hollow: Model | None = None
    review: Model | None = None
    writer: Model | None = None
    checker: Model | None = None
    #: Where replies are kept; a folder of the shared one if it is None.
    store: str | None = None
    rewrites: int = 8
    asks: int = judges.ASKS_A_CHAPTER
    floor: float = judges.CONFIDENCE_FLOOR
    length_band: float = 0.4


def _tag(key: str, value: Column) -> Column:
    """metadata with a key, where the value isn't null."""
    old = F.coalesce(F.col("metadata"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    return F.when(value.isNull(), F.col("metadata")).otherwise(F.map_concat(F.map_filter(old, lambda k, v: k != key), F.create_map(F.lit(key), value)))


def _rows(df: DataFrame, order: int, rule: Column | str, category: Column | str, engine: str, **given: Column) -> DataFrame:
    """Rows with chapter_number, start and end as findings of one rule (or of the rules in a column); ADDED where it isn't given is null."""
    named = {"rule_id": rule, "category": category, "engine": engine}
    values = {"rule_ord": F.lit(order), "applyable": F.lit(False), "turn": F.lit(0)} | {k: F.lit(v) if isinstance(v, str) else v for k, v in named.items()} | given
    for name, kind in ADDED.items():
        values.setdefault(name, F.lit(None))
        values[name] = values[name].cast(kind)
    return df.select("chapter_number", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), *(v.alias(k) for k, v in values.items()))


def _in_place(rows: DataFrame, laid: DataFrame) -> DataFrame:
    """Findings of models with their places."""
    return checks.placed(rows.withColumnRenamed("excerpt", "text"), laid).withColumnRenamed("text", "excerpt")


def _book(lines: list[str], title: str) -> Column:
    return F.lit(f"{title}:\n" + "\n".join(lines) + "\n\n" if lines else "")


def copy_judged(chapters: DataFrame, found: DataFrame, own: Judges, terms: list[str], names: list[str]) -> DataFrame:
    """What a chapter's judge says of it."""
    shown = judges.shown_candidates(chapters, findings.judge_candidates(chapters, found))
    state = judges.judge_state(chapters, found, shown, terms, names)
    asked = ask_once(state.select("chapter_number", F.to_json(F.struct(*state.columns)).alias("prompt")), own.chapter, own.store, "chapter", strict=True)
    told = F.from_json("reply", "struct<choices:map<string,struct<choice:string,confidence:double>>,nouls:map<string,double>>")
    rows = asked.select("chapter_number", told.alias("r"))
    none = F.lit(None)
    choices = rows.select("chapter_number", F.explode("r.choices").alias("question", "a")).select("chapter_number", "question", F.col("a.choice").alias("choice"), F.col("a.confidence").alias("confidence"), none.cast("double").alias("probability"))
    nouls = rows.select("chapter_number", F.explode("r.nouls").alias("question", "probability")).select("chapter_number", "question", none.cast("string").alias("choice"), none.cast("double").alias("confidence"), "probability")
    said = judges.copy_findings(choices.unionByName(nouls), shown, own.floor)
    turn = F.array_position(F.array(*(F.lit(q) for q in judges.QUESTIONS)), F.col("rule_id"))
    return _rows(said, COPY, F.col("rule_id"), F.col("category"), "typesafe", severity=F.col("severity"), excerpt=F.col("excerpt"), message=F.col("message"), confidence=F.col("confidence"), turn=turn)


def garbled(chapters: DataFrame, own: Judges, terms: list[str], names: list[str]) -> DataFrame:
    """What a model finds broken, each excerpt searched from where the last was found; pasted only if that is safe."""
    head = F.concat(F.lit(TASKS["garbled"] + "\n\n"), _book(terms, "BOOK TERMS"), _book(names, "CAST"))
    prompt = F.concat(head, F.lit("CHAPTER "), F.lpad(F.col("chapter_number").cast("string"), 3, "0"), F.lit(":\n"), F.col("content"))
    asked = ask_once(chapters.select("chapter_number", prompt.alias("prompt")), own.garbled, own.store, "garbled")
    items = F.coalesce(judges.salvaged(F.col("reply"), judges.GARBLED), F.array().cast(judges.GARBLED))
    bare = lambda x: strip(F.coalesce(x, F.lit("")))
    told = F.filter(items, lambda x: x.isNotNull() & ((bare(x["excerpt"]) != "") | (bare(x["message"]) != "")))
    listed = written(asked.select("chapter_number", told.alias("items")))
    at = findings.anchored(listed.join(chapters.select("chapter_number", "content"), "chapter_number").select("chapter_number", "content", F.transform("items", lambda x: bare(x["excerpt"])).alias("excerpts")))
    rows = listed.select("chapter_number", F.posexplode("items").alias("k", "item")).withColumn("n", F.col("k") + 1).join(at, ["chapter_number", "n"])
    level = F.lower(bare(F.col("item.severity")))
    lone = F.create_map(F.lit("unanchored"), F.lit("true"))
    out = _rows(
        rows, GARBLED, "llm.garbled", "garbled", "llm", severity=F.when(level.isin("error", "suggestion", "info"), level).otherwise("warning"), excerpt=F.col("excerpt"),
        message=F.coalesce(F.nullif(bare(F.col("item.message")), F.lit("")), F.lit("Passage appears garbled or broken.")), suggestion=F.nullif(bare(F.col("item.suggestion")), F.lit("")),
        turn=F.col("n"), metadata=F.when(F.col("start").isNull(), lone),
    )
    return people.mark_safe_repairs(out, chapters).select(*out.columns)


def hollow(chapters: DataFrame, told: DataFrame, own: Judges) -> DataFrame:
    """The images that a model calls hollow among the sentences (told) of a hollow shape."""
    shapes = prose.hollow_shapes(told).join(told.select("chapter_number", "start", "text"), ["chapter_number", "start"])
    listed = judges.hollow_candidates(shapes)
    flat = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    lines = listed.groupBy("chapter_number").agg(F.array_sort(F.collect_list(F.struct("n", flat(F.col("text")).alias("text")))).alias("l"))
    numbered = F.array_join(F.transform("l", lambda x: F.concat(x["n"].cast("string"), F.lit(". "), x["text"])), "\n")
    prompt = F.concat(F.lit(TASKS["hollow"] + "\n\nCHAPTER:\n"), strip(F.col("content")), F.lit("\n\nCANDIDATES:\n"), numbered)
    asked = ask_once(lines.join(chapters, "chapter_number").select("chapter_number", prompt.alias("prompt")), own.hollow, own.store, "hollow")
    # Of two verdicts on one number the last counts.
    verdicts = asked.select("chapter_number", F.posexplode(judges.salvaged(F.col("reply"), judges.HOLLOW)).alias("k", "v")).filter("v.n is not null")
    last = verdicts.groupBy("chapter_number", F.col("v.n").alias("n")).agg(F.max(F.struct("k", "v"))["v"].alias("v"))
    said = judges.hollow_findings(listed, last.select("chapter_number", "n", *(F.trim(F.col(f"v.{c}")).alias(c) for c in ("label", "phrase", "why"))))
    rows = said.join(chapters.select("chapter_number", "content"), "chapter_number")
    phrase = between(F.col("content"), F.struct("start", "end"))
    why = F.when(F.coalesce("why", F.lit("")) != "", F.concat(F.lit(" "), F.regexp_replace("why", r"\.+$", ""), F.lit("."))).otherwise("")
    message = F.concat(F.lit("Hollow image “"), F.regexp_replace(flat(phrase), "[.;]+$", ""), F.lit("”."), why)
    return _rows(rows, HOLLOW, "hollow.image", "hollow", "llm", severity=F.lit("suggestion"), excerpt=phrase, message=message, suggestion=F.lit("(cut it, or say the plain thing it stands for)"))


def reviewed(found: DataFrame, chapters: DataFrame, own: Judges, terms: list[str], names: list[str]) -> DataFrame:
    """Garbled text and missing predicates looked at once more, in their order and within the budget of their chapter.

    Garbled text that is voice goes; it may be pasted only if it is surely garbled.  A missing predicate that is surely meant so is information only.
    Without a reviewer garbled text is never pasted; beyond the budget it isn't either, and a missing predicate is tagged."""
    broken, bare = F.col("rule_id") == "llm.garbled", F.col("rule_id") == "mech.missing_predicate"
    if own.review is None:
        return found.withColumns({"applyable": F.col("applyable") & ~broken, "replacement": F.when(~broken, F.col("replacement"))})
    # A row's number tells it from all others, so that a verdict finds it; it is written, as numbers must not change.
    numbered = written(found.withColumn("__row", F.monotonically_increasing_id()))
    order = Window.partitionBy("chapter_number").orderBy("rule_ord", "turn", "start", "end", "__row")
    turns = numbered.filter(broken | bare).withColumn("rule_ord", F.when(broken, 0).otherwise(1)).withColumn("__nth", F.row_number().over(order))
    around = F.coalesce(context(F.col("content"), F.struct("start", "end")), let(
        F.call_function("locate", F.col("excerpt"), F.col("content")), lambda at: F.when((at > 0) & (F.col("excerpt") != ""), context(F.col("content"), F.struct((at - 1).alias("start"), (at - 1 + F.length("excerpt")).alias("end"))))
    ), F.col("excerpt"))
    root = lambda key: F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("")).alias(key)
    lines = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
    state = F.struct(
        F.when(broken, "copy.garbled_or_voice").otherwise("copy.missing_predicate").alias("question"), around.alias("surrounding_prose"), F.col("excerpt").alias("flagged_excerpt"),
        F.coalesce("suggestion", F.lit("")).alias("proposed_replacement"), root("root_text"), root("root_pos"), root("root_tag"), lines(terms).alias("book_lexicon"), lines(names).alias("book_cast"),
    )
    within = turns.filter(F.col("__nth") <= own.asks).join(chapters.select("chapter_number", "content"), "chapter_number")
    asked = ask_once(within.select("__row", F.to_json(state).alias("prompt")), own.review, own.store, "review")
    verdict = F.from_json("reply", "struct<choice:string,confidence:double>")
    told = asked.select("__row", F.lower(F.trim(verdict["choice"])).alias("__choice"), F.coalesce(verdict["confidence"], F.lit(0.0)).alias("__sure"), F.lit(True).alias("__asked"))
    rows = numbered.join(told, "__row", "left")
    sure = F.coalesce(F.col("__sure") >= own.floor, F.lit(False))
    armed = ~broken | F.coalesce((F.col("__choice") == "garbled") & sure, F.lit(False))
    beyond = F.when(bare & F.col("__asked").isNull(), "budget_exhausted")
    rows = rows.filter(~broken | F.coalesce(F.col("__choice") != "voice", F.lit(True)))
    rows = rows.withColumn("metadata", _tag("missing_predicate_review", F.when(bare, F.coalesce("__choice", beyond)))).withColumn("metadata", _tag("garbled_review", F.when(broken, F.col("__choice"))))
    return rows.withColumns({
        "applyable": F.col("applyable") & armed, "replacement": F.when(armed, F.col("replacement")),
        "severity": F.when(bare & F.coalesce((F.col("__choice") == "intentional") & sure, F.lit(False)), "info").otherwise(F.col("severity")),
    }).select(*found.columns)


def strict(config: checks.Config) -> checks.Config:
    """Settings by which every weak word counts and no scene is flat: an edit may not bring in anything new."""
    return replace(config, weak_limits={rule: -1.0 for rule in config.weak_limits}, weak_words=0, flat_sentences=1_000_000_000)


def _rules_in(laid: DataFrame, config: checks.Config, spans: DataFrame) -> DataFrame:
    """spans (chapter_number, unit, from, to) with rules: those that have a hit in the span, sorted."""
    hits = checks.placed(checks.all_hits(laid, strict(config)), laid).select("chapter_number", "start", "end", "rule_id")
    held = spans.join(hits.hint("merge"), "chapter_number").filter((F.col("start") < F.col("to")) & (F.col("from") < F.col("end")))
    return held.groupBy("unit").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def _same_names(edits: DataFrame, forms: DataFrame | None) -> DataFrame:
    """The units (unit, before, edit) of which one text has a protected form as whole words that the other hasn't.

    Texts meet forms by the first word of a form, whatever the number of forms."""
    if forms is None:
        return edits.select("unit").limit(0)
    known = forms.select(F.trim("form").alias("form")).filter("form <> ''").distinct().withColumn("key", F.explode(people.known_by(F.array("form"))))
    words = edits.withColumn("key", F.explode(people.asked_for(F.concat_ws(" ", "before", "edit"))))
    met = words.join(known, "key")
    return met.filter(findings._edged(F.col("before"), F.col("form")) != findings._edged(F.col("edit"), F.col("form"))).select("unit").distinct()


def _sections(**parts: Column) -> Column:
    return F.concat_ws("\n\n", *(F.concat(F.lit(f"{name}:\n"), text) for name, text in parts.items()))


def rewritten(found: DataFrame, chapters: DataFrame, config: checks.Config, own: Judges, forms: DataFrame | None, terms: list[str], names: list[str]) -> DataFrame:
    """found with the edits of flagged passages that stand, as findings; where one doesn't, its notes are tagged with why.

    An edit must be readable and new, pass this library's own checks (length, quotes, paragraphs, names, no rule broken
    in the passage that wasn't before), and a checker must find every fact kept.

    Units and what is said of them grow with the book, and their tables are far smaller than their rows: joins sort them and broadcast none."""
    target = F.lit(False)
    for prefix in TARGETS:
        target = target | F.col("rule_id").startswith(prefix)
    notes = found.filter(target & F.col("start").isNotNull())
    unit = F.concat_ws(":", F.col("chapter_number").cast("string"), F.col("start").cast("string"))
    units = written(findings.rewrite_units(chapters, notes, own.rewrites).withColumn("unit", unit))
    listed = notes.alias("f").join(units.alias("u").hint("merge"), (F.col("f.chapter_number") == F.col("u.chapter_number")) & (F.col("u.start") <= F.col("f.start")) & (F.col("f.start") < F.col("u.end")))
    said = listed.groupBy("u.unit").agg(F.array_sort(F.collect_list(F.struct("f.rule_ord", "f.turn", "f.start", "f.end", "f.message"))).alias("n"), F.array_sort(F.collect_set("f.rule_id")).alias("target_rules"))
    said = said.select("unit", F.transform("n", lambda x: x["message"]).alias("notes"), "target_rules")
    paras = matches(chapters, regions.BLOCK).select("chapter_number", F.col("k").cast("long").alias("para"), "text")
    near = judges.around_units(paras, units).join(chapters.select("chapter_number", "content").hint("merge"), "chapter_number").join(said.hint("merge"), "unit")
    near = near.withColumn("passage", between(F.col("content"), F.struct("start", "end")))
    bullets = F.array_join(F.transform("notes", lambda x: F.concat(F.lit("- "), x)), "\n")
    head = F.concat(F.lit(TASKS["writer"] + "\n\n"), _book(names, "CAST"), _book(terms, "BOOK TERMS"))
    prompt = F.concat(head, _sections(BEFORE=F.col("before"), PASSAGE=F.col("passage"), AFTER=F.col("after"), NOTES=bullets))
    draft = F.from_json(F.nullif(F.regexp_extract("reply", r"(?s)\{.*\}", 0), F.lit("")), "purpose string, facts array<string>, cuts array<string>, edit string")
    drafts = ask_once(near.withColumn("prompt", prompt), own.writer, own.store, "writer").withColumn("draft", draft)
    edit = strip(F.coalesce("draft.edit", F.lit("")))
    flat = lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " "))
    first = F.when(F.col("reply").isNull(), "writer_failed").when(F.col("edit") == "", "writer_unreadable").when(flat(F.col("edit")) == flat(F.col("passage")), "unchanged").otherwise(
        judges.edit_problem(F.col("passage"), F.col("edit"), own.length_band)
    )
    drafts = written(drafts.withColumn("edit", edit).withColumn("problem", first).drop("prompt", "reply"))
    # Names, then the rules of the chapter with the edit in its place: each such chapter is one of its own.
    other = _same_names(drafts.filter("problem is null").select("unit", F.col("passage").alias("before"), "edit"), forms).withColumn("other_names", F.lit(True))
    open_ = drafts.filter("problem is null").join(other.hint("merge"), "unit", "left_anti")
    whole = F.concat(F.substring("content", F.lit(1), F.col("start").cast("int")), F.col("edit"), F.substr("content", F.col("end").cast("int") + 1))
    edited = open_.select(F.col("unit").alias("chapter_number"), "unit", whole.alias("content"), F.col("start").alias("from"), (F.col("start") + F.length("edit")).alias("to"))
    after = _rules_in(regions.kept(edited.select("chapter_number", "content")), config, edited.select("chapter_number", "unit", "from", "to"))
    touched = regions.kept(chapters.join(units.select("chapter_number").distinct().hint("merge"), "chapter_number", "left_semi"))
    before = _rules_in(touched, config, units.select("chapter_number", "unit", F.col("start").alias("from"), F.col("end").alias("to")))
    none = F.array().cast("array<string>")
    new = after.join(before.withColumnRenamed("rules", "old").hint("merge"), "unit", "left").filter(F.size(judges.new_rules(F.coalesce("old", none), F.col("rules"))) > 0).select("unit", F.lit(True).alias("new_rules"))
    gated = drafts.join(other.hint("merge"), "unit", "left").join(new.hint("merge"), "unit", "left")
    gated = written(gated.withColumn("problem", F.coalesce("problem", F.when(F.col("other_names"), "names"), F.when(F.col("new_rules"), "new_problem"))))
    check = F.concat(F.lit(TASKS["checker"] + "\n\n"), _sections(BEFORE=F.col("before"), ORIGINAL=F.col("passage"), EDITED=F.col("edit"), AFTER=F.col("after")))
    asked = ask_once(gated.filter("problem is null").select("unit", check.alias("prompt")), own.checker, own.store, "checker")
    against = F.when(F.col("reply").isNull(), F.array(F.lit("checker_failed"))).otherwise(judges.continuity_problems(F.col("reply")))
    told = F.from_json(F.nullif(F.regexp_extract("reply", r"(?s)\{.*\}", 0), F.lit("")), judges.CONTINUITY)
    verdicts = asked.select("unit", against.alias("against"), F.to_json(judges.literal_facts(told)).alias("kept_facts"), F.to_json(judges.wording(told)).alias("wording"))
    final = written(gated.join(verdicts.hint("merge"), "unit", "left").withColumn("reasons", F.when(F.col("problem").isNotNull(), F.array("problem")).otherwise(F.col("against"))))
    purpose = F.trim(F.coalesce("draft.purpose", F.lit("")))
    meta = F.map_from_entries(F.array(*(F.struct(F.lit(k), F.coalesce(v, F.lit(""))) for k, v in {
        "rewrite_checked": F.lit("true"), "rewrite_original": F.col("passage"), "purpose": purpose, "cuts": F.to_json("draft.cuts"), "facts": F.col("kept_facts"), "wording": F.col("wording"),
        "notes": F.to_json("notes"), "target_rules": F.to_json("target_rules"),
    }.items())))
    message = F.concat(F.lit("Passage edit"), F.when(purpose != "", F.concat(F.lit(": "), purpose)).otherwise("."))
    good = final.filter(F.size("reasons") == 0)
    edits = _rows(good, REWRITE, "rewrite.passage", "rewrite", "llm", severity=F.lit("suggestion"), excerpt=F.col("passage"), message=message, suggestion=F.col("edit"), metadata=meta)
    bad = final.filter(F.size("reasons") > 0).select("chapter_number", F.col("start").alias("__from"), F.col("end").alias("__to"), F.to_json("reasons").alias("__why"), F.nullif("edit", F.lit("")).alias("__edit"))
    # A unit is a few paragraphs of one chapter, and a chapter has at most a handful: its rejects are one array that its notes meet.
    rejects = bad.groupBy("chapter_number").agg(F.collect_list(F.struct("__from", "__to", "__why", "__edit")).alias("__rejects"))
    mine = F.get(F.filter("__rejects", lambda r: (r["__from"] <= F.col("start")) & (F.col("start") < r["__to"])), F.lit(0))
    tagged = found.join(rejects.hint("merge"), "chapter_number", "left").withColumn("__r", F.when(target, mine))
    tagged = tagged.withColumn("metadata", _tag("rewrite_rejected", F.col("__r")["__why"])).withColumn("metadata", _tag("rewrite_rejected_edit", F.col("__r")["__edit"]))
    return tagged.select(*found.columns).unionByName(_in_place(edits, touched), allowMissingColumns=True)


def judged(laid: DataFrame, chapters: DataFrame, found: DataFrame, config: checks.Config, own: Judges, skip_rules: list[str], forms: DataFrame | None, cast: DataFrame | None) -> DataFrame:
    """found (findings in their places, close repeats too) after all models were asked, close repeats and skipped rules left out."""
    own = own if own.store else replace(own, store=f"{shared_dir(chapters.sparkSession)}/quillspark-replies")
    # Prompts have a fixed number of lines of the book.
    terms = [r["form"] for r in forms.select("form").limit(judges.BOOK_LINES).collect()] if forms is not None else []
    names = [f"{r['name']}: {r['pronouns']}" if r["pronouns"] else r["name"] for r in cast.select("name", "pronouns").limit(judges.BOOK_LINES).collect()] if cast is not None else []
    out = found.withColumn("metadata", F.lit(None).cast(META)).withColumn("confidence", F.lit(None).cast("double")) if "metadata" not in found.columns else found
    out = written(out)
    parts = []
    if own.chapter:
        parts.append(copy_judged(chapters, out, own, terms, names))
    if own.garbled:
        parts.append(garbled(chapters, own, terms, names))
    if own.hollow:
        parts.append(hollow(chapters, regions.sentences(laid), own))
    for rows in parts:
        out = out.unionByName(_in_place(rows, laid), allowMissingColumns=True)
    out = reviewed(written(out), chapters, own, terms, names)
    out = findings.skipping(out.filter(F.col("rule_id") != "echo.local_repeat"), skip_rules)
    if own.writer and own.checker and own.rewrites > 0:
        protected = [x for x in (forms.select("form") if forms is not None else None, cast.select(F.col("name").alias("form")) if cast is not None else None) if x is not None]
        both = protected[0] if len(protected) == 1 else protected[0].unionByName(protected[1]) if protected else None
        out = rewritten(written(out), chapters, config, own, both, terms, names)
    return people.garbled_by_cast(written(out), cast)
