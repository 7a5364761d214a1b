"""The findings relation: union, ids, context filters, duplicates, rollups, edits and what judges are asked."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.intervals import Kept
from ..functions.text import between, clip, gaps_between, let, matches, none_of, outside, within
from . import messages
from .regions import BLOCK, non_prose, paragraphs

SEVERITIES = ["critical", "error", "warning", "suggestion", "info"]
ENGINES = {"deterministic": "det", "typesafe": "ts", "llm": "llm"}
ENGINE_RANK = {"deterministic": 3, "typesafe": 2, "llm": 1}
#: rule prefix, category, severity: fixed values.
RULES = [
    ("mech.double_space", "grammar", "error"), ("mech.trailing_ws", "grammar", "error"), ("mech.space_before_punct", "grammar", "error"),
    ("mech.", "grammar", "warning"), ("style.", "style", "suggestion"), ("anachronism.", "style", "suggestion"), ("word.", "wordiness", "suggestion"),
    ("echo.", "echo", "suggestion"), ("rhythm.flat_scene", "rhythm", "warning"), ("rhythm.", "rhythm", "suggestion"), ("weak.", "weakener", "suggestion"),
    ("guide.banned", "style", "warning"), ("guide.", "style", "suggestion"), ("canon.", "style", "warning"), ("hollow.", "hollow", "suggestion"),
]
NOTES = ["echo", "rhythm", "weakener", "hollow"]


def _of_rule(rule: Column, at: int) -> Column:
    out = F.lit(None).cast("string")
    for row in reversed(RULES):
        out = F.when(rule.startswith(row[0]), row[at]).otherwise(out)
    return out


def of_hits(hits: DataFrame, engine: str = "deterministic", keep: Iterable[str] = ()) -> DataFrame:
    """Hits of rules as findings, with the columns keep.

    What a hit says is its note, else its rule's message. Order within a chapter: rule_ord, turn (0 where hits have none), then start, end and rule id."""
    rule = F.col("rule_id")
    given = lambda c, kind="string": F.col(c) if c in hits.columns else F.lit(None).cast(kind)
    old, new = given("text"), given("replacement")
    return hits.select(
        "chapter_number", "rule_ord", F.coalesce(given("turn", "int"), F.lit(0)).alias("turn"), "rule_id", _of_rule(rule, 1).alias("category"), _of_rule(rule, 2).alias("severity"),
        F.lit(engine).alias("engine"), "start", "end", old.alias("excerpt"), new.alias("replacement"), new.isNotNull().alias("applyable"),
        F.coalesce(given("note"), given("message"), messages.message(rule, old, new)).alias("message"), messages.suggestion(rule, old, new).alias("suggestion"), *keep,
    )


def _order(findings: DataFrame) -> list[str]:
    """The order in which a chapter's findings are told."""
    return [c for c in ("rule_ord", "turn", "start", "end", "rule_id", "excerpt", "message") if c in findings.columns]


def with_ids(findings: DataFrame) -> DataFrame:
    """id: engine, chapter and a sequence that starts at 1 for each engine of each chapter, in the order of the findings."""
    seq = F.row_number().over(Window.partitionBy("chapter_number", "engine").orderBy(*_order(findings)))
    prefix = F.lit(None).cast("string")
    for engine, short in ENGINES.items():
        prefix = F.when(F.col("engine") == engine, short).otherwise(prefix)
    number = F.col("chapter_number").cast("string")
    padded = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    ordinal = F.when(F.length(seq.cast("string")) < 4, F.lpad(seq.cast("string"), 4, "0")).otherwise(seq.cast("string"))
    return findings.withColumn("id", F.concat(prefix, F.lit("-c"), padded, F.lit("-"), ordinal))


def distinct_forms(forms: DataFrame) -> DataFrame:
    """forms: form, nth.  Each spelling once, in its first form; letter case folds by lower case."""
    bare = forms.select(F.trim("form").alias("form"), "nth").filter("form <> ''")
    return bare.groupBy(F.lower("form").alias("folded")).agg(F.min(F.struct("nth", "form")).alias("f")).select("f.form", "f.nth", "folded")


def _edged(text: Column, form: Column) -> Column:
    """Whether a form stands in a text as whole words, in any case."""
    return F.regexp_like(text, F.concat(F.lit(r"(?iU)(?<!\w)\Q"), F.replace(form, F.lit("\\E"), F.lit("")), F.lit(r"\E(?!\w)")))


def without_protected(findings: DataFrame, forms: DataFrame) -> DataFrame:
    """Findings whose excerpt is no protected form of the glossary, and whose replacement keeps each form, as whole words, that the excerpt has; an echo of a word within a form goes too.

    forms: form.  A glossary is small; whether it is broadcast Spark decides by its size."""
    whole = forms.select(F.trim("form").alias("__form")).filter("__form <> ''").distinct()
    flat = lambda x: F.lower(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    folded = whole.select(flat(F.col("__form")).alias("__f")).distinct()
    rest = findings.join(folded, flat(F.coalesce("excerpt", F.lit(""))) == F.col("__f"), "left_anti")
    words = whole.select(F.explode(F.regexp_extract_all("__form", F.lit("[A-Za-z']+"), F.lit(0))).alias("__w")).select(F.lower("__w").alias("__w")).distinct()
    if "word" in findings.columns:
        rest = rest.join(words, (F.col("rule_id") == "echo.local_repeat") & (F.lower("word") == F.col("__w")), "left_anti")
    lost = (F.coalesce("replacement", F.lit("")) != "") & _edged(F.col("excerpt"), F.col("__form")) & ~_edged(F.col("replacement"), F.col("__form"))
    return rest.join(whole, lost, "left_anti")


def skipping(findings: DataFrame, prefixes: list[str]) -> DataFrame:
    """Findings but for those of rules that start with one of the prefixes."""
    out = findings
    for prefix in prefixes:
        out = out.filter(~F.col("rule_id").startswith(prefix))
    return out


def same_message(message: Column) -> Column:
    """The message in lower case with single spaces, by which notes without a place are told apart."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(message, F.lit("")), r"(?U)\s+", " ")))


def _fold(rows: pd.DataFrame | pa.Table) -> list[int]:
    """The places of the rows that stay, of one chapter and category in order."""
    kept, index, said = [], Kept(), {}
    columns = (list(rows[c]) if isinstance(rows, pd.DataFrame) else rows[c].to_pylist() for c in ("start", "end", "engine", "said"))
    for place, (start, end, engine, text) in enumerate(zip(*columns)):
        span = None if pd.isna(start) or pd.isna(end) else (int(start), int(end))
        i = said.get(text) if span is None else index.first(span)
        if i is None:
            i = len(kept)
            kept.append((place, engine, span))
        elif ENGINE_RANK.get(engine, 0) > ENGINE_RANK.get(kept[i][1], 0):
            if kept[i][2] is not None:
                index.remove(i, kept[i][2])
            kept[i] = (place, engine, span)
        else:
            continue
        if span is None:
            said[text] = i
        else:
            index.add(i, span)
    return [place for place, _, _ in kept]


def _folded(held: list[pa.RecordBatch]) -> pa.Table:
    """The rows that stay of whole groups, which stand in order; said goes."""
    table = pa.Table.from_batches(held)
    stay, begin = [], 0
    keys = list(zip(table["chapter_number"].to_pylist(), table["category"].to_pylist()))
    for end in [*(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]:
        stay += [begin + i for i in _fold(table.slice(begin, end - begin))] if end - begin > 1 else [begin]
        begin = end
    return table.drop_columns("said").take(pa.array(stay, pa.int64()))


def _fold_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Folds the groups of a sorted partition, which may go over from batch to batch: the last one is held until another begins."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column("chapter_number").to_pylist(), batch.column("category").to_pylist()))
        last = len(keys) - 1
        while last and keys[last - 1] == keys[-1]:
            last -= 1
        if last:
            held.append(batch.slice(0, last))
        if held and (last or keys[0] != key):
            yield from _folded(held).to_batches()
            held = []
        held.append(batch.slice(last))
        key = keys[-1]
    if held:
        yield from _folded(held).to_batches()


def dedupe(findings: DataFrame) -> DataFrame:
    """Of findings of one chapter and category that overlap by half or contain each other, the first; a later one of a higher engine takes its place.

    Two without a place are the same if their messages are; one with a place and
    one without are never.  Each step depends on what was kept before, so that a
    group, the findings of one category of one chapter, is folded in order; what
    was kept is looked up by its place, so that a fold is about linear.  Groups are
    many and small: a task sorts its own and folds them in one pass."""
    said = findings.withColumn("said", same_message(F.col("message")) if "message" in findings.columns else F.lit(""))
    order = (F.col(c).asc_nulls_last() for c in _order(findings))
    dealt = said.repartition("chapter_number", "category").sortWithinPartitions("chapter_number", "category", *order)
    return dealt.mapInArrow(_fold_groups, findings.schema)


def buckets(findings: DataFrame) -> DataFrame:
    return findings.withColumn("bucket", F.when(F.col("category").isin(NOTES), "note").otherwise("action"))


def summary(findings: DataFrame) -> DataFrame:
    """Counts by severity, category and engine, and the total, by grouping sets: facet, value, n."""
    sets = findings.groupingSets([["severity"], ["category"], ["engine"], []], "severity", "category", "engine").agg(
        F.count("*").alias("n"), F.grouping_id("severity", "category", "engine").alias("g")
    )
    facet = F.when(F.col("g") == 3, "severity").when(F.col("g") == 5, "category").when(F.col("g") == 6, "engine").otherwise("total")
    return sets.select(facet.alias("facet"), F.coalesce("severity", "category", "engine", F.lit("")).alias("value"), "n")


def chapter_rollup(findings: DataFrame) -> DataFrame:
    """Per chapter the ids of its action list, in the order of the findings, as one string, and how many."""
    action = buckets(findings).filter("bucket = 'action'").withColumn("f", F.struct(F.length("id").alias("size"), "id"))
    return action.groupBy("chapter_number").agg(F.count("*").alias("n"), F.concat_ws(",", F.transform(F.sort_array(F.collect_list("f")), lambda x: x["id"])).alias("finding_ids"))


def top_findings(findings: DataFrame, limit: int = 50) -> DataFrame:
    """The first findings by severity, category, chapter, start and id."""
    rank = F.lit(len(SEVERITIES))
    for i, s in enumerate(SEVERITIES):
        rank = F.when(F.col("severity") == s, i).otherwise(rank)
    return findings.orderBy(rank, "category", "chapter_number", "start", "id").limit(limit)


EDIT = "struct<rank:int,rule_id:string,start:bigint,end:bigint,replacement:string,excerpt:string>"


def apply_edits(chapters: DataFrame, findings: DataFrame) -> DataFrame:
    """chapter_number, content with all safe edits pasted, applied (their number).

    Of overlapping edits the more severe stays, then that of the first rule id,
    then the first; an edit whose text isn't in its place is left out.  A
    chapter's edits are one array, which meets its text once."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)).cast("int")
    edit = F.struct(F.when(rank == 0, 9).otherwise(rank).alias("rank"), "rule_id", "start", "end", "replacement", "excerpt")
    safe = findings.filter((F.col("engine") == "deterministic") & F.col("applyable") & F.col("replacement").isNotNull())
    edits = safe.groupBy("chapter_number").agg(F.sort_array(F.collect_list(edit)).alias("edits"))
    c = F.col("content")

    def keep(kept: Column, x: Column) -> Column:
        free = ~F.exists(kept, lambda k: (x["start"] < k["end"]) & (k["start"] < x["end"]))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    true = F.filter(F.coalesce("edits", none_of(EDIT)), lambda x: between(c, x) == x["excerpt"])
    kept = let(true, lambda t: F.aggregate(t.cast(f"array<{EDIT}>"), none_of(EDIT), keep))
    in_place = F.array_sort(F.transform("kept", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["replacement"].alias("new"))))
    pasted = let(in_place, lambda e: F.concat_ws("", F.flatten(F.zip_with(
        gaps_between(e, F.lit(0), F.length(c)), e, lambda gap, x: F.array(between(c, gap), F.coalesce(x["new"], F.lit("")))
    ))))
    rows = chapters.join(edits, "chapter_number", "left").withColumn("kept", kept)
    return rows.select("chapter_number", pasted.alias("content"), F.size("kept").cast("long").alias("applied"))


#: Fixed patterns: verbs that disagree with their pronouns, and how a paragraph ends that is none the worse.
AGREEMENT = r"(?i)\b(?:they\s+was|he\s+were|she\s+were|it\s+were|i\s+is|we\s+is|you\s+is|he\s+don't|she\s+don't|it\s+don't)\b"
TERMINAL = r"""[.?!]["')\]]*$"""


def judge_candidates(chapters: DataFrame, findings: DataFrame, limit: int = 8, reserved: int = 2) -> DataFrame:
    """What a chapter's judge is shown: the first missing predicates, fragments and disagreements, the other missing predicates, then echoes and wordy spans; one of equal spans.

    chapter_number, nth, start, end, source, text."""
    skip = non_prose(chapters)
    paras = paragraphs(chapters)
    body = F.regexp_replace("text", r"^\s+|\s+$", "")
    odd = paras.filter(((F.length(body) > 40) & ~body.rlike(TERMINAL)) | F.col("text").rlike(AGREEMENT))
    rows = odd.select("chapter_number", "start", "end", F.lit("heuristic").alias("source"), F.lit(1).alias("phase"), F.lit(0).alias("rule_ord"))
    # The findings are read once: what isn't asked about is told by its source.
    source = F.when(F.col("rule_id") == "mech.missing_predicate", "missing_predicate").when(F.col("category").isin("echo", "wordiness"), F.col("category"))
    nth = F.row_number().over(Window.partitionBy("chapter_number", "source").orderBy("start", "end"))
    flagged = findings.withColumn("source", source).filter("source is not null").select("chapter_number", "start", "end", "source", "rule_ord")
    bare = F.col("source") == "missing_predicate"
    phase = F.when(~bare, 3).when(nth <= reserved, 0).otherwise(2)
    more = flagged.withColumn("phase", phase).withColumn("rule_ord", F.when(bare, 0).otherwise(F.col("rule_ord")))
    rows = outside(rows.unionByName(more), skip)
    first = F.row_number().over(Window.partitionBy("chapter_number", "start", "end").orderBy("phase", "rule_ord"))
    nth = F.row_number().over(Window.partitionBy("chapter_number").orderBy("phase", "rule_ord", "start", "end"))
    rows = rows.withColumn("__first", first).filter("__first = 1").withColumn("nth", nth).filter(F.col("nth") <= limit)
    text = F.substr("content", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return rows.join(chapters.select("chapter_number", "content"), "chapter_number").select("chapter_number", F.col("nth").cast("long").alias("nth"), "start", "end", "source", clip(text).alias("text"))


def rewrite_units(chapters: DataFrame, hits: DataFrame, limit: int = 8) -> DataFrame:
    """Flagged paragraphs, neighbours in pairs; of each chapter those with most hits: chapter_number, first, last (paragraphs), start, end, hits."""
    of_chapter = Window.partitionBy("chapter_number")
    blocks = matches(chapters, BLOCK).select("chapter_number", "start", "end", "text", F.col("k").cast("long").alias("para"), F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    prose = blocks.filter(F.col("text").rlike("[A-Za-z0-9']") & ~F.regexp_replace("text", r"^\s+", "").startswith("#")).drop("text")
    per = within(hits.select("chapter_number", "start", "end"), prose, ["para", "p_start", "p_end"], "inner").groupBy("chapter_number", "para", "p_start", "p_end").agg(F.count("*").alias("n"))
    order = of_chapter.orderBy("para")
    island = per.withColumn("island", F.col("para") - F.row_number().over(order))
    unit = F.floor((F.row_number().over(Window.partitionBy("chapter_number", "island").orderBy("para")) - 1) / 2)
    units = island.withColumn("unit", unit).groupBy("chapter_number", "island", "unit").agg(
        F.min("para").alias("first"), F.max("para").alias("last"), F.min("p_start").alias("start"), F.max("p_end").alias("end"), F.sum("n").alias("hits")
    )
    rank = F.row_number().over(of_chapter.orderBy(F.desc("hits"), "start"))
    return units.withColumn("__r", rank).filter(F.col("__r") <= limit).select("chapter_number", "first", "last", "start", "end", "hits")


def _anchor(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of chapter_number, content and excerpts as a row for each excerpt; excerpts themselves aren't copied."""
    for batch in batches:
        number, contents, excerpts = (batch.column(i) for i in range(3))
        counts = [n or 0 for n in pc.list_value_length(excerpts).to_pylist()]
        told = excerpts.flatten()
        left, nth, start, end = iter(told.to_pylist()), [], [], []
        for content, count in zip(contents.to_pylist(), counts):
            at = 0
            for k, excerpt in enumerate(islice(left, count), 1):
                found = content.find(excerpt, at) if content and excerpt else -1
                at = found + len(excerpt) if found >= 0 else at
                nth.append(k)
                start.append(found if found >= 0 else None)
                end.append(at if found >= 0 else None)
        of = pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64())
        columns = [number.take(of), pa.array(nth, pa.int32()), told, pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["chapter_number", "n", "excerpt", "start", "end"])


def anchored(replies: DataFrame) -> DataFrame:
    """Model replies in order, each excerpt searched from where the last one was found.

    replies: chapter_number, content, excerpts (array).  Returns chapter_number, n, excerpt, start, end (null if it isn't there).

    Each search goes on in the text from where the last one ended, so that a text whose excerpts are found is read once: a
    fold over columns would copy what it has found, and count code points from the text's start, at every step."""
    number = replies.schema["chapter_number"].dataType.simpleString()
    rows = replies.select("chapter_number", "content", "excerpts").filter(F.size("excerpts") > 0)
    return rows.mapInArrow(_anchor, f"chapter_number {number}, n int, excerpt string, start int, end int")
