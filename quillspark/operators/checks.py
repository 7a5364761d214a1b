"""All rules on a set of chapters: the registry, the settings, and findings with their places."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import partial
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import flat_excerpt, strip
from . import echoes, findings, lexical, parses, prose, regions
from .cast import pronoun_hits
from .messages import WEAK, filled, rounded

if TYPE_CHECKING:
    from .editors import Judges
    from .parses import Parser


@dataclass(frozen=True)
class Config:
    """What is checked, and the limits; and how a parser is loaded (parses.Parser), without which some rules find nothing."""

    parser: Callable[[], Parser] | None = None
    missing_predicates: bool = True
    min_tokens: int = 5
    shape_run: int = prose.SHAPE_RUN
    short_words: int = prose.SHORT_WORDS

    wordiness: bool = True
    rhythm: bool = True
    weakeners: bool = True
    echo_window: int = 40
    echo_at_least: int = 3
    phrase_sizes: tuple[int, ...] = (4, 3)
    phrase_gap: int = 2
    opener_run: int = 3
    flat_variety: int = prose.FLAT_VARIETY
    flat_sentences: int = prose.MIN_SENTENCES
    weak_words: int = prose.MIN_SCENE_WORDS
    weak_limits: dict[str, float] = field(default_factory=lambda: dict(prose.WEAK_LIMITS))
    banned: tuple[str, ...] = ()
    pet_words: dict[str, int] = field(default_factory=dict)
    spellings: dict[str, str] = field(default_factory=dict)


MECHANICS = [lexical.double_space, lexical.trailing_space, lexical.space_before_punctuation, lexical.repeated_punctuation]
#: The order in which rules give their findings: lexical ones up to 6, then echoes, rhythm, weak words, the guide's and, at the end, the cast's.
ORDER = {"echo.local_repeat": 7, "echo.phrase_dup": 8, "rhythm.same_opener_run": 9, "rhythm.flat_scene": 10, "weak": 11, "guide": 12, "canon": 20}


def rules(config: Config) -> list[lexical.Rule]:
    """The lexical rules in their order; a rule that is off gives nothing but keeps its number."""
    return [*MECHANICS, lexical.em_dash, lexical.earth_timeline, lexical.wordiness if config.wordiness else lexical.Rule()]


def _as_hits(rows: DataFrame, order: int, rule: str | None = None, **given: Column | str) -> DataFrame:
    """rows with start and end as hits of one rule; text, word, turn and note where they are given."""
    none = F.lit(None).cast("string")
    values = {"text": none, "replacement": none, "turn": F.lit(0), "note": none, "word": none} | given
    return rows.select("chapter_number", F.lit(order).alias("rule_ord"), F.lit(rule).alias("rule_id") if rule else F.col("rule_id"), "start", "end", *(F.col(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in values.items()))


def all_hits(laid: DataFrame, config: Config | None = None) -> DataFrame:
    """The hits of every rule: chapter_number, rule_ord, rule_id, start, end, text, replacement, turn, note, word (of an echo)."""
    config = config or Config()
    word = F.lit(None).cast("string").alias("word")
    out = lexical.hits(laid, *rules(config)).withColumn("word", word)
    near = echoes.close_repeats(laid, config.echo_window, config.echo_at_least)
    note = filled("Word '{word}' repeats {n} times within {window} content words.", word=F.col("word"), n=F.col("n"), window=F.lit(config.echo_window))
    out = out.unionByName(_as_hits(near, ORDER["echo.local_repeat"], "echo.local_repeat", word="word", note=note))
    note = filled("Phrase '{phrase}' appears twice in close proximity within the same paragraph — likely a polish-pass stutter.", phrase=F.col("phrase"))
    out = out.unionByName(_as_hits(echoes.phrase_repeats(laid, config.phrase_sizes, config.phrase_gap), ORDER["echo.phrase_dup"], "echo.phrase_dup", text="excerpt", note=note))
    if config.missing_predicates and "whole" in laid.columns:
        # They follow the mechanical rules.
        bare = parses.missing_predicates(laid, config.min_tokens)
        out = out.unionByName(_as_hits(bare, len(MECHANICS) - 1, "mech.missing_predicate", text="text", turn=F.lit(2)))
    if config.rhythm or config.weakeners:
        # Three rules read the sentences, which are measured once.
        told = written(prose.measured(regions.sentences(laid)))
    if config.rhythm:
        note = filled("{n} sentences in a row start with “{opener}”.", n=F.col("sentences"), opener=F.col("opener"))
        out = out.unionByName(_as_hits(prose.opener_runs(told, config.opener_run), ORDER["rhythm.same_opener_run"], "rhythm.same_opener_run", note=note))
        if "parsed" in laid.columns:
            note = filled("{n} short sentences in a row, each opening subject-then-verb.", n=F.col("sentences"))
            runs = prose.shape_runs(told, config.shape_run, config.short_words)
            out = out.unionByName(_as_hits(runs, ORDER["rhythm.same_opener_run"], "rhythm.shape_run", turn=F.lit(1), note=note))
        share = F.concat(F.bround(100 * F.bround(F.col("subject_share"), 2), 0).cast("int").cast("string"), F.lit("%")) if "parsed" in laid.columns else F.lit("n/a")
        note = filled(
            "Scene {scene} reads flat: variety {variety}/100 (limit {limit}). Average {mean} words; {share} of sentences open subject-then-verb.",
            scene=F.col("scene"), variety=F.col("variety"), limit=F.lit(config.flat_variety), mean=rounded(F.col("mean_words")), share=share,
        )
        out = out.unionByName(_as_hits(prose.flat_scenes(told, config.flat_variety, config.flat_sentences), ORDER["rhythm.flat_scene"], "rhythm.flat_scene", turn=F.col("scene").cast("int"), note=note))
    if config.weakeners:
        dense = prose.dense_weak_words(told, config.weak_limits, config.weak_words)
        out = out.unionByName(_as_hits(dense, ORDER["weak"], text="own", turn=_weak_turn(config), note=_weak_note(config)))
    guide = [rule(setting) for rule, setting in ((lexical.banned, list(config.banned)), (lexical.pet_words, config.pet_words), (lexical.house_spelling, config.spellings)) if setting]
    if guide:
        out = out.unionByName(lexical.hits(laid, *guide).withColumn("rule_ord", F.lit(ORDER["guide"]) + F.col("rule_ord")).withColumn("word", word))
    return out


def _weak_turn(config: Config) -> Column:
    """Weak words are told scene by scene, then rule by rule."""
    of = F.array(*map(F.lit, sorted(config.weak_limits)))
    return (F.col("scene") * len(config.weak_limits) + F.array_position(of, F.col("rule_id"))).cast("int")


def _weak_note(config: Config) -> Column:
    out = F.lit(None).cast("string")
    for rule, limit in config.weak_limits.items():
        text = WEAK[rule] + f" Scene {{scene}}: {{rate}} per 1,000 words (limit {limit:g})."
        out = F.when(F.col("rule_id") == rule, filled(text, word=F.col("own"), scene=F.col("scene"), rate=rounded(F.col("rate")))).otherwise(out)
    return out


def _stops(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's sentence marks and line ends stand, and its line ends alone."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = points == 10
    return np.flatnonzero(ends | (points == 46) | (points == 33) | (points == 63)), np.flatnonzero(ends)


def _widened(text: str, stops: np.ndarray, start: int, end: int) -> tuple[int, int]:
    """The span of text.enclosing: the sentence or line round a span, less the spaces before it."""
    before, after = np.searchsorted(stops, start) - 1, np.searchsorted(stops, end)
    begin = int(stops[before]) + 1 if before >= 0 else 0
    stop = int(stops[after]) if after < len(stops) else len(text)
    stop += stop < len(text) and text[stop] != "\n"
    while begin < stop and text[begin] in " \t":
        begin += 1
    return begin, stop


def _held(at: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of the span that holds each point, -1 where none does; spans are in order and overlap none of each other."""
    last = np.searchsorted(starts, at, "right") - 1
    return np.where((last >= 0) & (at < np.append(ends, -1)[last]), last, -1)


def _found_at(batches: Iterable[pa.RecordBatch], fields: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of a chapter with its hits as a row for each hit, in its place; see placed."""
    for batch in batches:
        of = {name: batch.column(name) for name in batch.schema.names}
        counts = pc.list_value_length(of["hits"]).to_numpy(zero_copy_only=False)
        hits = of["hits"].flatten()
        own = {f: hits.field(f) for f in fields}
        rules, texts = own["rule_id"].to_pylist(), own["text"].to_pylist()
        known = np.asarray(pc.and_(own["start"].is_valid(), own["end"].is_valid()).to_numpy(zero_copy_only=False), bool)
        start, end = (np.array(pc.fill_null(own[f], 0).to_numpy(zero_copy_only=False), np.int64) for f in ("start", "end"))
        places = {name: np.full(len(rules), -1, np.int64) for name in PLACE}
        spans = [of[name].to_pylist() for name in ("scene_starts", "scene_ends", "told_starts", "told_ends")]
        begin = 0
        for text, count, *bounds in zip(of["content"].to_pylist(), counts.tolist(), *spans):
            rows = slice(begin, begin + count)
            begin += count
            stops, line_ends = _stops(text)
            for i in range(rows.start, rows.stop):
                if known[i]:
                    echo = rules[i] == "echo.local_repeat"
                    if echo:
                        start[i], end[i] = _widened(text, stops, int(start[i]), int(end[i]))
                    if echo or texts[i] is None or rules[i].startswith("rhythm."):
                        texts[i] = text[start[i] : end[i]]
                elif rules[i] == "echo.local_repeat" or rules[i].startswith("rhythm."):
                    texts[i] = None
            first, last = start[rows], np.maximum(end[rows] - 1, start[rows])
            scene_starts, scene_ends, told_starts, told_ends = (np.array(x, np.int64) for x in bounds)
            places["line_start"][rows] = np.searchsorted(line_ends, first) + 1
            places["line_end"][rows] = np.searchsorted(line_ends, last) + 1
            scene, told, told_last = _held(first, scene_starts, scene_ends), _held(first, told_starts, told_ends), _held(last, told_starts, told_ends)
            places["scene"][rows] = np.where(scene >= 0, scene + 1, -1)
            places["sentence_start"][rows] = np.where(told >= 0, np.append(told_starts, -1)[told], -1)
            places["sentence_end"][rows] = np.append(told_ends, -1)[np.where(told_last >= 0, told_last, told)]
        own |= {"start": pa.array(start, pa.int64(), mask=~known), "end": pa.array(end, pa.int64(), mask=~known), "text": pa.array(texts, own["text"].type)}
        numbers = of["chapter_number"].take(pa.array(np.repeat(np.arange(len(counts)), counts), pa.int64()))
        columns = [numbers, *(own[f] for f in fields), *(pa.array(places[name], pa.int64(), mask=~known | (places[name] < 0)) for name in PLACE)]
        yield pa.RecordBatch.from_arrays(columns, ["chapter_number", *fields, *PLACE])


def placed(hits: DataFrame, laid: DataFrame) -> DataFrame:
    """hits (chapter_number, start, end, rule_id, text and more) with line_start, line_end, scene, sentence_start, sentence_end and their text.

    The hits of a chapter are one array that meets its text once, where lines, scenes and sentences are looked up by bisection.
    An echo's place is its whole sentence; a run's or a scene's text is flattened and cut; hits without a place keep none.

    Arrays of hits are many times the size of the table that they come from, by which Spark would have them broadcast
    through the driver, and a chapter's part of the work isn't told by the size of its hits: both sides are sorted."""
    carried = [c for c in hits.columns if c not in ("chapter_number", "text")] + ["text"]
    # The plan of all rules is large: it ends here, so that what follows isn't planned together with it.
    grouped = written(hits).groupBy("chapter_number").agg(F.collect_list(F.struct(*carried)).alias("hits"))
    scenes, sentences = F.col("scenes"), regions.told(laid)
    texts = laid.select(
        "chapter_number", "content", scenes["start"].alias("scene_starts"), scenes["end"].alias("scene_ends"), sentences["start"].alias("told_starts"), sentences["end"].alias("told_ends"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in hits.schema.fields} | {"start": "bigint", "end": "bigint"}
    schema = ", ".join(f"`{name}` {kind}" for name, kind in [("chapter_number", kinds["chapter_number"]), *((c, kinds[c]) for c in carried), *((c, "bigint") for c in PLACE)])
    found = texts.join(grouped.hint("merge"), "chapter_number").mapInArrow(partial(_found_at, fields=carried), schema)
    said = F.when(F.col("rule_id").startswith("rhythm."), flat_excerpt(F.col("text"))).when(F.col("rule_id") == "echo.local_repeat", strip(F.col("text"))).otherwise(F.col("text"))
    return found.withColumn("text", said)


PLACE = ["line_start", "line_end", "scene", "sentence_start", "sentence_end"]


def check(
    chapters: DataFrame, config: Config | None = None, skip_rules: list[str] | None = None, forms: DataFrame | None = None, cast: DataFrame | None = None, judges: Judges | None = None,
) -> DataFrame:
    """The findings of every rule on chapters, with ids, messages and places: those of rules that start with skip_rules and those against the glossary's forms (form) are left out, and of duplicates one stays.

    Close repeats of a word only serve what judges are asked: they go first, before they can stand in for others.
    With judges, models add and review findings (see editors), and findings have confidence and metadata (JSON).
    What contradicts the cast (name, pronouns) comes last.  Findings are numbered before duplicates go, so that numbers have gaps."""
    config, skip = config or Config(), skip_rules or []
    # Every rule and every place reads the chapters: they are made once.
    laid = regions.kept(parses.with_parses(regions.laid_out(chapters), config.parser) if config.parser else chapters)
    chapters = laid.select(*chapters.columns)
    out = as_findings(placed(all_hits(laid, config), laid))
    if forms is not None:
        out = findings.without_protected(out, forms)
    if judges is None:
        out = findings.skipping(out.filter(F.col("rule_id") != "echo.local_repeat"), skip)
    else:
        from .editors import judged

        out = judged(laid, chapters, out, config, judges, skip, forms, cast)
        out = out.withColumn("metadata", F.to_json("metadata"))
    out = out.drop("word")
    if cast is not None:
        out = out.unionByName(findings.of_hits(pronoun_hits(chapters, cast, ORDER["canon"])), allowMissingColumns=True)
    if forms is not None:
        out = findings.without_protected(out, forms)
    return findings.dedupe(findings.with_ids(findings.skipping(out, skip)))


def as_findings(hits: DataFrame) -> DataFrame:
    """Placed hits as findings with word and places."""
    rows = hits.select("*", *(F.col(c).alias(f"__{c}") for c in PLACE)).drop(*PLACE)
    return findings.of_hits(rows, keep=["word", *(f"__{c}" for c in PLACE)]).withColumnsRenamed({f"__{c}": c for c in PLACE})
