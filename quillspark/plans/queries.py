"""One query for each operator, over whole tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import repair
from ..functions.tables import shared_dir, written
from ..functions.text import line_at, matches, truncate_middle
from ..operators import cast, checks, echoes, editors, findings, lexical, prose, regions
from . import report
from .corpus import chapters, raw_chapters

BANNED = ["was is", "the the", "of and"]
PET_WORDS = {"with": 20, "from": 3}
SPELLINGS = {"grey": "gray"}
FORMS = ["shadow", "in order to", "of  of", "very"]
CAST = [("Garrick Vale", "he/him"), ("Mara", "she/her"), ("Mara Quill", "they/them"), ("Of Stone", "he/him"), ("Lee Vale", "she/her")]
#: What op repair_gates changes in a sentence, and into what.
REPAIRS = [(" the ", " "), ("it ", "its "), (" and ", " but "), (" of", " of it"), ("e", "e")]

Query = Callable[[SparkSession, str], DataFrame]


def _hits(rows: DataFrame) -> DataFrame:
    return rows.select("chapter_number", "start", "end", "rule_id", "text", "replacement")


def _lexical(*rules: lexical.Rule) -> Query:
    """A query of rules on chapters that are laid out."""
    return lambda spark, sf_dir: _hits(lexical.hits(laid(spark, sf_dir), *rules))


def laid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.laid_out(chapters(spark, sf_dir))


def kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters laid out and told, as a table, for queries that read them many times."""
    return regions.kept(chapters(spark, sf_dir))


LEXICAL = [lexical.double_space, lexical.trailing_space, lexical.space_before_punctuation, lexical.repeated_punctuation, lexical.em_dash, lexical.wordiness]


def all_findings(c: DataFrame) -> DataFrame:
    """The findings of the plain lexical rules, with ids."""
    return findings.with_ids(findings.of_hits(lexical.hits(c, *LEXICAL)))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.sentences(laid(spark, sf_dir))


def _findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_findings(laid(spark, sf_dir))


def echo_local_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return echoes.close_repeats(regions.laid_out(raw_chapters(spark, sf_dir)))


def echo_phrase_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return echoes.phrase_repeats(regions.laid_out(raw_chapters(spark, sf_dir))).drop("excerpt")


def chapter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.size(F.split("content", "\n", -1)).cast("long")
    return chapters(spark, sf_dir).select("chapter_number", "title", F.length("content").cast("long").alias("n_chars"), lines.alias("n_lines"))


def lexicon_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = spark.createDataFrame([(f,) for f in FORMS], "form string")
    return findings.without_protected(_findings(spark, sf_dir), forms).select("chapter_number", "rule_id", "start", "end")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = laid(spark, sf_dir)
    return prose.positions(lexical.hits(c, lexical.em_dash), regions.sentences(c), regions.scenes(c)).select("chapter_number", "start", "end", "scene", "sentence_start", "sentence_end")


def _placed(c: DataFrame, *prefixes: str) -> DataFrame:
    """The findings, in their places, of the rules that start with one of the prefixes."""
    wanted = F.lit(False)
    for prefix in prefixes:
        wanted = wanted | F.col("rule_id").startswith(prefix)
    return findings.of_hits(checks.placed(checks.all_hits(c, CONFIG).filter(wanted), c))


def judge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kept(spark, sf_dir)
    return findings.judge_candidates(c, _placed(c, "word.", "echo."))


def rewrite_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kept(spark, sf_dir)
    return findings.rewrite_units(c, _placed(c, "echo.", "rhythm.", "weak."))


def anchor_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every text, searched in order."""
    c = raw_chapters(spark, sf_dir)
    told = F.filter(F.split("content", r"(?<=[.!?])\s+", -1), lambda x: x != "")
    return findings.anchored(c.select("chapter_number", "content", told.alias("excerpts")))


def scene_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prose.scene_metrics(_sentences(spark, sf_dir)).drop("start", "end")


#: The settings of the queries that run every rule.
CONFIG = checks.Config(banned=tuple(BANNED), pet_words=PET_WORDS, spellings=SPELLINGS)


def all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's findings, before any filter."""
    return checks.all_hits(kept(spark, sf_dir), CONFIG).select("chapter_number", "rule_ord", "rule_id", "start", "end", "replacement", "word")


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = kept(spark, sf_dir)
    found = checks.placed(checks.all_hits(c, CONFIG), c)
    # No place is told by -1 here, so that the columns are whole numbers in either engine.
    return found.select("chapter_number", "rule_id", "start", "end", F.col("text").alias("excerpt"), *(F.coalesce(x, F.lit(-1)).cast("long").alias(x) for x in checks.PLACE))


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = laid(spark, sf_dir)
    found = lexical.hits(c, lexical.double_space).join(c.select("chapter_number", "content"), "chapter_number")
    return found.select("chapter_number", "start", line_at(F.col("content"), F.col("start")).cast("long").alias("line"))


def check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule with the cast, in one call."""
    found = checks.check(chapters(spark, sf_dir), CONFIG, ["guide."], cast=_cast(spark))
    return found.select("id", "chapter_number", "rule_id", *(F.coalesce(x, F.lit(-1)).cast("long").alias(x) for x in ("start", "end", *checks.PLACE)))


def findings_said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule's findings with what they say, before any filter, in their order."""
    c = kept(spark, sf_dir)
    found = findings.with_ids(checks.as_findings(checks.placed(checks.all_hits(c, CONFIG), c)))
    return found.select("id", "chapter_number", "rule_id", "message", F.coalesce("suggestion", F.lit("")).alias("suggestion"))


def plain_writer(prompt: str) -> str:
    """Edits a passage by leaving out "very"; a stand-in for a model."""
    passage = prompt.partition("PASSAGE:\n")[2].partition("\n\nAFTER:\n")[0]
    return json.dumps({"purpose": "plain", "edit": passage.replace(" very ", " ")})


def plain_checker(prompt: str) -> str:
    """Finds a fact lost in every third edit, by its length; a stand-in for a model."""
    edited = prompt.partition("EDITED:\n")[2].partition("\n\nAFTER:\n")[0]
    return json.dumps({"facts": [{"fact": "it", "status": "kept" if len(edited) % 3 else "lost"}]})


def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of flagged passages: those that stand with the new text, and the notes of the others with why."""
    laid_ = kept(spark, sf_dir)
    c = laid_.select("chapter_number", "chapter_path", "title", "content")
    found = checks.as_findings(checks.placed(checks.all_hits(laid_, CONFIG).filter("rule_id <> 'echo.local_repeat'"), laid_)).withColumn("metadata", F.lit(None).cast(editors.META))
    own = editors.Judges(writer=plain_writer, checker=plain_checker, store=f"{shared_dir(spark)}/replies-{uuid.uuid4().hex}")
    out = editors.rewritten(written(found), c, CONFIG, own, spark.createDataFrame([("garrick",), ("of",)], "form string"), [], [])
    said = F.when(F.col("rule_id") == "rewrite.passage", F.col("suggestion")).otherwise(F.try_element_at("metadata", F.lit("rewrite_rejected")))
    return out.select("chapter_number", "rule_id", "start", "end", said.alias("said")).filter("said is not null")


def _cast(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAST, "name string, pronouns string")


def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of each of whose names the last word is a number: a large cast."""
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"), F.lit("she/her").alias("pronouns"))
    return cast.members(rows).select("name", F.array_join("tokens", "|").alias("tokens"), F.col("family").cast("long").alias("family"))


def repair_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every text against the same line with a change, chosen by the chapter's number."""
    c = raw_chapters(spark, sf_dir)
    line = c.select("chapter_number", F.posexplode(F.split("content", "\n", -1)).alias("k", "old"))
    which = F.pmod(F.col("chapter_number"), F.lit(len(REPAIRS)))
    new = F.coalesce(*(F.when(which == i, F.replace("old", F.lit(a), F.lit(b))) for i, (a, b) in enumerate(REPAIRS)))
    rows = line.withColumn("new", new)
    old, new = F.col("old"), F.col("new")
    d = F.col("d")
    return rows.withColumn("d", repair.difference(old, new)).select(
        "chapter_number", "k", d["removed"].alias("removed"), d["added"].alias("added"), repair.is_single_repair(old, new, d).alias("single"),
        repair.is_pure_deletion(old, new, d).alias("deletion"), F.array_join(F.transform(repair.families(new), lambda x: x.cast("string")), ",").alias("families"),
    )


QUERIES: dict[str, Query] = {
    "echo_local_repeat": echo_local_repeat,
    "chapter_scan": chapter_scan,
    "match_offsets": lambda s, d: matches(chapters(s, d), " {2,}").select("chapter_number", "k", "start", "end"),
    "non_prose_spans": lambda s, d: regions.non_prose(chapters(s, d)),
    "scene_spans": lambda s, d: regions.scenes(chapters(s, d)),
    "quote_spans": lambda s, d: regions.quotes(chapters(s, d)),
    "paragraphs": lambda s, d: regions.paragraphs(chapters(s, d)).select("chapter_number", "start", "end"),
    "sentences_fallback": lambda s, d: _sentences(s, d),
    "mech_double_space": _lexical(lexical.double_space),
    "mech_trailing_ws": _lexical(lexical.trailing_space),
    "mech_space_before_punct": _lexical(lexical.space_before_punctuation),
    "mech_repeated_punct": _lexical(lexical.repeated_punctuation),
    "style_em_dash": _lexical(lexical.em_dash),
    "anachronism": _lexical(lexical.earth_timeline),
    "wordiness": _lexical(lexical.wordiness),
    "echo_phrase_dup": echo_phrase_dup,
    "rhythm_opener_run": lambda s, d: prose.opener_runs(_sentences(s, d)),
    "scene_metrics": scene_metrics,
    "rhythm_flat_scene": lambda s, d: prose.flat_scenes(_sentences(s, d)).select("chapter_number", "scene", "variety", "start", "end"),
    "weakeners": lambda s, d: prose.dense_weak_words(_sentences(s, d)).drop("rate", "own"),
    "guide_banned": _lexical(lexical.banned(BANNED)),
    "guide_pet_word": _lexical(lexical.pet_words(PET_WORDS)),
    "guide_spelling": _lexical(lexical.house_spelling(SPELLINGS)),
    "hollow_shapes": lambda s, d: prose.hollow_shapes(_sentences(s, d)),
    "lexicon_filter": lexicon_filter,
    "canon_pronoun_prose": lambda s, d: cast.pronoun_clashes(chapters(s, d), _cast(s)),
    "name_tokens": name_tokens,
    "repair_gates": repair_gates,
    "finding_ids": lambda s, d: _findings(s, d).select("id", "chapter_number", "rule_id", "start", "end"),
    "positions": positions,
    "summary_grouping_sets": lambda s, d: findings.summary(_findings(s, d)),
    "report_summary": lambda s, d: report.full_summary(findings.buckets(_findings(s, d)).filter("bucket = 'action'"), chapters(s, d)),
    "report_chapters": lambda s, d: report.chapter_rows(chapters(s, d), _findings(s, d)).withColumn("finding_ids", F.array_join("finding_ids", ",")),
    "chapter_rollup": lambda s, d: findings.chapter_rollup(_findings(s, d)),
    "terminal_topk": lambda s, d: findings.top_findings(_findings(s, d)).select("id", "severity", "category", "chapter_number", "start"),
    "judge_candidates": judge_candidates,
    "rewrite_units": rewrite_units,
    "truncate_middle": lambda s, d: raw_chapters(s, d).select("chapter_number", truncate_middle(F.col("content"), 2000).alias("content")),
    "apply_edits": lambda s, d: findings.apply_edits(chapters(s, d), _findings(s, d)),
    "dedupe": lambda s, d: findings.dedupe(_findings(s, d)).select("id", "chapter_number", "rule_id", "start", "end"),
    "anchor_cursor": anchor_cursor,
    "all_rules": all_rules,
    "locations": locations,
    "line_numbers": line_numbers,
    "check": check,
    "findings_said": findings_said,
    "rewrites": rewrites,
}
