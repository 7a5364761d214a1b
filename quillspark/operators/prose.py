"""Rules on sentences: rhythm, scene variety, weak words and hollow shapes."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import within
from . import parses
from .lexical import folded
from .regions import SPACE, WORD


def _of_chapter():
    return Window.partitionBy("chapter_number")


#: Fixed patterns and words.
QUALIFIER = (
    r"(?i)\b(?:very|really|quite|rather|somewhat|slightly|fairly|pretty much|a (?:bit|little)|kind of|sort of|just|almost|nearly|barely)\b"
)
FILTER = (
    r"\b(he|she|they|i|we|you|[A-Z][a-z]+)\s+(?:could\s+)?"
    r"(saw|see|heard|hear|felt|feel|noticed|watched|realized|realised|wondered|seemed|smelled|smelt|sensed)\b"
)
NOT_NAMES = ["The", "A", "An", "It", "This", "That", "Then", "When", "There", "But", "And"]
TAG_VERBS = "said|asked|replied|whispered|muttered|murmured|shouted|called|answered|snapped|added|told|says|asks"
TAG_ADVERB = rf"(?i)\b(?:{TAG_VERBS})\s+([a-z]+ly)\b|\b([a-z]+ly)\s+(?:{TAG_VERBS})\b"
NOT_ADVERBS = (
    "only early likely family holy ugly lonely friendly daily belly rely reply supply apply fly july italy ally bully "
    "jelly silly lovely elderly orderly hourly weekly monthly yearly nightly costly deadly lively chilly curly surly "
    "burly sly wily oily"
).split()
QUOTED = '"[^"]*"|“[^”]*”'
TAIL = r',\s+(?:an?|the|one|its|their)\s+[^,.;!?"“”]{3,60}[.;]\s*$'
NARROW = (
    r"(?i)\b\w+'s\s+(?:idea|version|notion)\s+of\b|\bused\s+the\s+\w+\s+to\s+(?:become|turn|grow)\b"
    r"|\b(?:filled|answered|met)\s+the\s+(?:silence|quiet|hush|knock|pause|gap)\b|,\s+an?\s+\w+\s+(?:rather\s+than|with\s+no|without)\s"
)

#: What a scene of full variety reaches, and the limits below which it is flat.
TARGET_SPREAD, TARGET_MEAN, TARGET_MULTI = 0.55, 16.0, 0.45
FLAT_VARIETY, MIN_SENTENCES = 62, 20
WEAK_LIMITS = {"weak.qualifier": 3.0, "weak.filter_word": 3.0, "weak.tag_adverb": 1.0}
MIN_SCENE_WORDS = 300


def shapes(sentences: DataFrame) -> DataFrame:
    """The sentences with words (count) and opener (the first word, in lower case, or empty); where a parser gave their tokens also with subject_first and clauses, for these."""
    if "words" in sentences.columns:
        return sentences
    rows = sentences.withColumns({"words": F.regexp_count("text", F.lit(WORD)).cast("long"), "opener": F.lower(F.regexp_extract("text", WORD, 0))})
    if "tokens" not in sentences.columns:
        return rows
    return rows.withColumns({"subject_first": parses.subject_first(F.col("tokens")), "clauses": parses.clauses(F.col("tokens"))}).drop("tokens")


def measured(sentences: DataFrame) -> DataFrame:
    """shapes of the sentences with their weak words and without their text, for rules that all read them."""
    rows = shapes(sentences)
    return _with_weak(rows, *(c for c in rows.columns if c != "text"))


def opener_runs(sentences: DataFrame, at_least: int = 3) -> DataFrame:
    """Runs of sentences of a scene that open alike; dialogue breaks a run, as does a sentence without a word."""
    key = F.when(~F.col("dialogue") & (F.col("opener") != ""), F.col("opener"))
    return _runs(shapes(sentences).withColumn("key", key), at_least).withColumnRenamed("key", "opener")


#: Words that a sentence of a run of one shape has at most, and how many such sentences are a run.
SHORT_WORDS, SHAPE_RUN = 14, 4


def shape_runs(sentences: DataFrame, at_least: int = SHAPE_RUN, short: int = SHORT_WORDS) -> DataFrame:
    """Runs of short sentences that open with subject and verb; none without a parser."""
    rows = shapes(sentences)
    plain = F.col("subject_first") & (F.col("words") <= short) if "subject_first" in rows.columns else F.lit(False)
    return _runs(rows.withColumn("key", F.when(~F.col("dialogue") & plain, "plain")), at_least)


def _runs(rows: DataFrame, at_least: int) -> DataFrame:
    """Runs of sentences of a scene with one key, which a null breaks: chapter_number, start, end, key, sentences."""
    order = _of_chapter().orderBy("idx")
    same = (F.col("key") == F.lag("key").over(order)) & (F.col("scene") == F.lag("scene").over(order))
    rows = rows.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter("key is not null")
    return (
        rows.groupBy("chapter_number", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("key").alias("key"), F.count("*").alias("sentences"))
        .filter(F.col("sentences") >= at_least).drop("run")
    )


def scene_metrics(sentences: DataFrame) -> DataFrame:
    """Per scene with narration: sentences, mean length, spread (population deviation by mean), the commonest opener with its share, variety.

    Numbers are not rounded, but for variety, which is half to even.  Where a parser gave tokens there are also subject_share
    and multi_share (sentences of several clauses), and variety has five parts; else three."""
    told = shapes(sentences).filter(~F.col("dialogue")).drop("text")
    # The sentences are dealt out by scene once; the counts of openers and all that follows stay there.
    of_opener = Window.partitionBy("chapter_number", "scene", "opener")
    counted = told.repartition("chapter_number", "scene").withColumns({"uses": F.count("*").over(of_opener), "met": F.min("idx").over(of_opener)})
    top = F.max(F.when(F.col("opener") != "", F.struct("uses", (-F.col("met")).alias("earliest"), "opener")))
    base = counted.groupBy("chapter_number", "scene").agg(
        F.count("*").alias("narration"), F.avg("words").alias("mean_words"), F.stddev_pop("words").alias("deviation"), F.min("start").alias("start"), F.max("end").alias("end"), top.alias("top"),
        *((F.avg(F.col("subject_first").cast("double")).alias("subject_share"), F.avg((F.col("clauses") > 1).cast("double")).alias("multi_share")) if (parsed := "clauses" in told.columns) else ()),
    )
    rows = base.withColumns({
        "spread": F.when(F.col("mean_words") > 0, F.col("deviation") / F.col("mean_words")).otherwise(0.0),
        "top_share": F.coalesce("top.uses", F.lit(0)) / F.col("narration"),
        "top_opener": F.coalesce("top.opener", F.lit("")),
    })
    parts = (
        F.least(F.col("spread") / TARGET_SPREAD, F.lit(1.0)) + F.least(F.col("mean_words") / TARGET_MEAN, F.lit(1.0))
        + (1.0 - F.least(F.greatest(F.col("top_share") - 0.1, F.lit(0.0)) / 0.3, F.lit(1.0)))
    )
    count, shares = 3, []
    if parsed:
        count, shares = 5, ["subject_share", "multi_share"]
        parts = parts + (1.0 - F.least(F.greatest(F.col("subject_share") - 0.4, F.lit(0.0)) / 0.4, F.lit(1.0))) + F.least(F.col("multi_share") / TARGET_MULTI, F.lit(1.0))
    return rows.select("chapter_number", "scene", "narration", "mean_words", "spread", "top_opener", "top_share", F.bround(100 * parts / count, 0).cast("long").alias("variety"), "start", "end", *shares)


def scene_profiles(sentences: DataFrame, scenes: DataFrame) -> DataFrame:
    """Every scene, empty ones too: chapter_number, scene, start, end, words, sentences, narration."""
    counts = shapes(sentences).groupBy("chapter_number", "scene").agg(
        F.sum("words").alias("words"), F.count("*").alias("sentences"), F.count_if(~F.col("dialogue")).alias("narration")
    )
    return scenes.join(counts, ["chapter_number", "scene"], "left").fillna(0, ["words", "sentences", "narration"])


def flat_scenes(sentences: DataFrame, limit: int = FLAT_VARIETY, at_least: int = MIN_SENTENCES) -> DataFrame:
    return scene_metrics(sentences).filter((F.col("narration") >= at_least) & (F.col("variety") < limit))


WEAK = "struct<rule_id:string,start:bigint,end:bigint,word:string,own:string>"


def _asked(pattern: str) -> re.Pattern:
    """A fixed pattern for Python, with the white space of ASCII."""
    return re.compile(pattern.replace(r"\s", f"[{SPACE}]"))


_QUALIFIER, _FILTER, _TAG, _QUOTED = _asked(QUALIFIER.removeprefix("(?i)")), _asked(FILTER), _asked(TAG_ADVERB.removeprefix("(?i)")), re.compile(QUOTED)


def _weak_of(text: str, base: int, dialogue: bool) -> list[tuple[str, int, int, str, str]]:
    """The weak words of a sentence that starts at base: rule_id, start, end, word (in lower case), own (as it stands)."""
    if dialogue:
        # Text within quotes becomes blank, so that offsets stay; a tag never spans a quote as it has no line break in it.
        tags = (m.span(1 if m.group(1) else 2) for m in _TAG.finditer(folded(_QUOTED.sub(lambda m: "\0" * len(m.group()), text))))
        found = [("weak.tag_adverb", *x) for x in tags if text[slice(*x)].lower() not in NOT_ADVERBS]
    else:
        found = [("weak.qualifier", *m.span()) for m in _QUALIFIER.finditer(folded(text))]
        found += [("weak.filter_word", *m.span(2)) for m in _FILTER.finditer(text) if m.group(1) not in NOT_NAMES]
    return [(rule, base + a, base + b, text[a:b].lower(), text[a:b]) for rule, a, b in found]


def _weak_rows(batches: Iterable[pa.RecordBatch], carried: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_weak_of(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("text", "start", "dialogue")))]
        offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
        columns = list(zip(*(x for f in found for x in f))) or [()] * 5
        fields = [pa.array(c, kind) for c, kind in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
        weak = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["rule_id", "start", "end", "word", "own"]))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), weak], [*carried, "weak"])


def _with_weak(sentences: DataFrame, *carried: str) -> DataFrame:
    """The columns carried of each sentence, and weak: its weak words as an array."""
    kinds = {f.name: f.dataType.simpleString() for f in sentences.schema.fields}
    asked = sentences.select(*dict.fromkeys([*carried, "text", "start", "dialogue"]))
    return asked.mapInArrow(partial(_weak_rows, carried=list(carried)), ", ".join(f"`{c}` {kinds[c]}" for c in carried) + f", weak array<{WEAK}>")


def weak_words(sentences: DataFrame) -> DataFrame:
    """All weak words, before any limit: chapter_number, scene, rule_id, start, end, word."""
    return _with_weak(sentences, "chapter_number", "scene").select("chapter_number", "scene", F.inline("weak"))


def _of_rule(rule: str) -> Callable[[Column], Column]:
    return lambda x: x["rule_id"] == rule


def dense_weak_words(sentences: DataFrame, limits: dict[str, float] | None = None, min_words: int = MIN_SCENE_WORDS) -> DataFrame:
    """The weak words of scenes that are long enough and have more of a rule's words per 1,000 than its limit."""
    limits = limits or WEAK_LIMITS
    of_scene = Window.partitionBy("chapter_number", "scene")
    found = (sentences if "weak" in sentences.columns else _with_weak(shapes(sentences), "chapter_number", "scene", "words")).select("chapter_number", "scene", "words", "weak")
    totals = {"scene_words": F.sum("words").over(of_scene)}
    for i, rule in enumerate(limits):
        totals[f"n{i}"] = F.sum(F.size(F.filter("weak", _of_rule(rule)))).over(of_scene)
    rows = found.withColumns(totals).filter((F.col("scene_words") >= min_words) & (F.size("weak") > 0))
    rate = lambda i: 1000 * F.col(f"n{i}") / F.col("scene_words")
    many = F.transform(F.filter(F.array(*(F.struct(F.lit(rule).alias("rule_id"), rate(i).alias("rate"), F.lit(float(limit)).alias("limit")) for i, (rule, limit) in enumerate(limits.items()))), lambda r: r["rate"] > r["limit"]), lambda r: F.struct(r["rule_id"], r["rate"]))
    rates = rows.withColumn("rates", F.map_from_entries(many)).select("chapter_number", "scene", "rates", F.inline("weak"))
    return rates.withColumn("rate", F.element_at("rates", F.col("rule_id"))).filter("rate is not null").select("chapter_number", "scene", "rule_id", "start", "end", "word", "own", "rate")


def hollow_shapes(sentences: DataFrame) -> DataFrame:
    """Narration that has a hollow shape: narrow before tail, and before mind, which a parser's tokens tell."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    pattern = F.when(flat.rlike(NARROW), "narrow").when(flat.rlike(TAIL), "tail")
    if "tokens" in sentences.columns:
        pattern = pattern.when(parses.mind_subject(F.col("tokens")), "mind")
    return sentences.filter(~F.col("dialogue")).withColumn("pattern", pattern).filter("pattern is not null").select("chapter_number", "start", "end", "pattern")


def positions(hits: DataFrame, sentences: DataFrame, scenes: DataFrame) -> DataFrame:
    """hits with scene, sentence_start and sentence_end; the end falls back to the first sentence's."""
    spans = sentences.select("chapter_number", "start", "end", F.col("start").alias("sentence_start"), F.col("end").alias("__first_end"))
    placed = within(within(hits, scenes, ["scene"]), spans, ["sentence_start", "__first_end"])
    last = placed.withColumn("__start", F.col("start")).withColumn("start", F.greatest(F.col("end") - 1, F.col("start")))
    ends = sentences.select("chapter_number", "start", "end", F.col("end").alias("__last_end"))
    out = within(last, ends, ["__last_end"]).withColumn("start", F.col("__start")).withColumn("sentence_end", F.coalesce("__last_end", "__first_end"))
    return out.drop("__start", "__first_end", "__last_end")
