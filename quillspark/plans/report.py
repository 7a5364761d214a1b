"""The report of a run: its head, its action list, notes and chapters as tables; how they are written, and what is wrong with them."""

from __future__ import annotations

import itertools
import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import files_of, shared_dir
from ..operators import prose, regions
from ..operators.findings import ENGINES, SEVERITIES, buckets, summary
from ..sources.files import publish

FIELDS = ["id", "category", "severity", "engine", "rule_id", "chapter_number", "start", "end", "excerpt", "replacement", "applyable"]
#: The counts that a summary has even where they are 0, fixed values.
ZERO_SEVERITIES = ["error", "warning", "suggestion", "info"]
#: The keys of a report, fixed values: findings, may_look and chapters are tables of their own.
HEAD_KEYS = [
    "version", "mode", "generated_at", "manuscript_path", "manuscript_name", "story_slug", "chapter_number", "summary", "warnings", "typesafe_enabled", "llm_enabled", "apply",
]
TABLES = ["findings", "may_look", "chapters"]


def full_summary(findings: DataFrame, chapters: DataFrame) -> DataFrame:
    """facet, value, n: the counts by severity, category and engine (those that are always told with 0), total, applied_count and chapters_scanned."""
    spark = findings.sparkSession
    always = [("severity", s) for s in ZERO_SEVERITIES] + [("engine", e) for e in ENGINES] + [("total", "")]
    counted = spark.createDataFrame(always, "facet string, value string").join(summary(findings), ["facet", "value"], "full").withColumn("n", F.coalesce("n", F.lit(0)))
    applied = F.count_if(F.col("applied")) if "applied" in findings.columns else F.lit(0)
    extra = findings.agg(applied.cast("long").alias("n")).select(F.lit("applied_count").alias("facet"), F.lit("").alias("value"), "n")
    scanned = chapters.agg(F.count("*").alias("n")).select(F.lit("chapters_scanned").alias("facet"), F.lit("").alias("value"), "n")
    return counted.select("facet", "value", "n").unionByName(extra).unionByName(scanned)


def chapter_rows(chapters: DataFrame, findings: DataFrame) -> DataFrame:
    """chapter_number, chapter_path, title, finding_ids (of the action list, in order): every chapter has a row."""
    action = buckets(findings).filter("bucket = 'action'").groupBy("chapter_number").agg(F.sort_array(F.collect_list(F.struct(F.length("id").alias("size"), "id"))).alias("ids"))
    ids = F.coalesce(F.transform("ids", lambda x: x["id"]), F.array().cast("array<string>"))
    return chapters.select("chapter_number", "chapter_path", "title").join(action, "chapter_number", "left").select("chapter_number", "chapter_path", "title", ids.alias("finding_ids"))


def head(findings: DataFrame, chapters: DataFrame, mode: str = "analyze", path: str = "", name: str = "", slug: str = "", version: str = "1", chapter_number: int | None = None, warnings: list[str] | None = None, **flags: bool) -> DataFrame:
    """One row of HEAD_KEYS. The summary has a few dozen counts, however long the run is."""
    counts = full_summary(findings, chapters).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.concat_ws(".", "facet", F.nullif("value", F.lit(""))), "n")))).alias("c"))
    of = lambda facet: F.transform_keys(F.map_filter("c", lambda k, v: k.startswith(f"{facet}.")), lambda k, v: F.substr(k, F.lit(len(facet) + 2)))
    said = F.struct(
        F.col("c")["total"].alias("total_findings"), of("severity").alias("by_severity"), of("category").alias("by_category"), of("engine").alias("by_engine"),
        F.col("c")["applied_count"].alias("applied_count"), F.col("c")["chapters_scanned"].alias("chapters_scanned"),
    )
    values: dict[str, Column] = {
        "version": F.lit(version), "mode": F.lit(mode), "generated_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "manuscript_path": F.lit(path),
        "manuscript_name": F.lit(name), "story_slug": F.lit(slug), "chapter_number": F.lit(chapter_number).cast("long"), "summary": said,
        "warnings": F.array(*map(F.lit, warnings or [])).cast("array<string>"), **{k: F.lit(flags.get(k, False)) for k in ("typesafe_enabled", "llm_enabled", "apply")},
    }
    return counts.select(*(values[k].alias(k) for k in HEAD_KEYS))


def location(findings: DataFrame, chapters: DataFrame) -> DataFrame:
    """findings with location (as a report has it) and the other fields of a finding; what they lack is null."""
    given = lambda c, kind: F.col(c) if c in findings.columns else F.lit(None).cast(kind)
    place = F.struct(
        "chapter_number", "chapter_path", *(given(c, "long").alias(c) for c in ("line_start", "line_end")), F.col("start").alias("char_start"), F.col("end").alias("char_end"),
        F.coalesce("excerpt", F.lit("")).alias("excerpt"), *(given(c, "long").alias(c) for c in ("scene", "sentence_start", "sentence_end")),
    )
    named = findings.join(chapters.select("chapter_number", "chapter_path"), "chapter_number", "left").withColumn("location", place)
    meta = F.from_json("metadata", "map<string,string>") if "metadata" in findings.columns and findings.schema["metadata"].dataType.typeName() == "string" else given("metadata", "map<string,string>")
    return named.select("chapter_number", "id", F.struct(
        "id", "category", "severity", given("message", "string").alias("message"), "location", "engine", given("suggestion", "string").alias("suggestion"), "rule_id", "applyable",
        "replacement", given("confidence", "double").alias("confidence"), F.coalesce(meta, F.create_map().cast("map<string,string>")).alias("metadata"),
    ).alias("finding"))


def scene_lists(laid: DataFrame) -> DataFrame:
    """chapter_number, scenes: the profile of every scene, with the numbers of its rhythm where it has narration."""
    told = regions.sentences(laid)
    rhythm = prose.scene_metrics(told).select("chapter_number", "scene", F.struct(
        F.round("mean_words", 1).alias("narration_words_mean"), F.round("spread", 2).alias("length_spread"), "top_opener", F.round("top_share", 2).alias("top_opener_share"), "variety",
    ).alias("rhythm"))
    rows = prose.scene_profiles(told, regions.scenes(laid)).join(rhythm, ["chapter_number", "scene"], "left")
    one = F.struct("scene", F.col("start").alias("char_start"), F.col("end").alias("char_end"), "words", "sentences", F.col("narration").alias("narration_sentences"), "rhythm")
    return rows.groupBy("chapter_number").agg(F.array_sort(F.collect_list(one)).alias("scenes"))


def report_path(spark: SparkSession, folder: str, mode: str, chapter_number: int | None = None, stamp: datetime | None = None) -> str:
    """Where a report goes: one chapter's over its last one, a book's under the time, with a number where that is taken."""
    if mode == "companion":
        return f"{folder}/companion-ch{chapter_number or 0:03d}.json"
    base = f"{folder}/analyze-{(stamp or datetime.now(timezone.utc)):%Y%m%d-%H%M%S}"
    for n in itertools.count(1):
        path = f"{base}.json" if n == 1 else f"{base}-{n}.json"
        files, where = files_of(spark, path)
        if not files.exists(where):
            return path


def write_file(paths: list[str], findings: DataFrame, chapters: DataFrame, laid: DataFrame | None = None, **given) -> list[str]:
    """The report as one JSON file, under each of paths: all of them, or on an error those that were there.

    Its lists are written by tasks, sorted by chapter and id, and copied one after another into the file: nothing of them is held in memory."""
    spark = findings.sparkSession
    every = buckets(findings)
    listed = location(every.filter("bucket = 'action'"), chapters), location(every.filter("bucket = 'note'"), chapters)
    rows = chapter_rows(chapters, findings)
    if laid is not None:
        rows = rows.join(scene_lists(laid), "chapter_number", "left")
    text = lambda column: F.concat(F.lit(","), F.to_json(column, {"ignoreNullFields": "false"})).alias("value")
    parts = {
        **{name: df.orderBy("chapter_number", F.length("id"), "id").select(text("finding")) for name, df in zip(("findings", "may_look"), listed)},
        "chapters": rows.orderBy("chapter_number").select(text(F.struct(*rows.columns))),
    }
    top = head(every.filter("bucket = 'action'"), chapters, **given)
    said = json.loads(top.select(F.to_json(F.struct(*top.columns), {"ignoreNullFields": "false"})).first()[0])
    files, staged = files_of(spark, f"{shared_dir(spark)}/quillspark-report-{uuid.uuid4().hex}")
    try:
        for name, lines in parts.items():
            lines.write.text(f"{staged.toString()}/{name}")

        def put(stream) -> None:
            out = lambda x: stream.write(bytearray(x, "utf-8"))
            out(json.dumps(said, indent=2, ensure_ascii=False).rstrip("}").rstrip())
            for name in TABLES:
                out(f',\n  "{name}": [\n')
                first = True
                for part in sorted((s for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(staged, name)) if s.getPath().getName().startswith("part-") and s.getLen()), key=lambda s: s.getPath().getName()):
                    source = files.open(part.getPath())
                    # The first row of all has no comma before it.
                    source.seek(1 if first else 0)
                    first = False
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, stream, 1 << 20, False)
                    source.close()
                out("  ]")
            out("\n}\n")

        publish(spark, paths, put)
    finally:
        files.delete(staged, True)
    return paths


def write(folder: str, findings: DataFrame, chapters: DataFrame, **given) -> str:
    """Writes head, findings, may_look and chapters as JSON lines below folder: all of them, or on an error what was there stays.

    The parts are written beside the folder; the old folder steps aside and goes when the new one is in its place."""
    spark = findings.sparkSession
    listed = buckets(findings).select("bucket", *(c for c in FIELDS if c in findings.columns))
    parts = {
        "head": head(buckets(findings).filter("bucket = 'action'"), chapters, **given), "chapters": chapter_rows(chapters, findings),
        "findings": listed.filter("bucket = 'action'").drop("bucket"), "may_look": listed.filter("bucket = 'note'").drop("bucket"),
    }
    files, final = files_of(spark, folder.rstrip("/"))
    staged, old = (spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}-{uuid.uuid4().hex}") for _ in range(2))
    aside = False
    try:
        for name, rows in parts.items():
            rows.write.json(f"{staged.toString()}/{name}")
        if files.exists(final):
            aside = files.rename(final, old)
        if not files.rename(staged, final):
            raise OSError(f"{folder} can't be written")
    except BaseException:
        if aside:
            files.rename(old, final)
        files.delete(staged, True)
        raise
    files.delete(old, True)
    return folder


def by_kind(findings: DataFrame) -> DataFrame:
    """severity, category, n and ids (in their order), the most severe first: how a terminal shows findings in groups."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.lit(0)), F.lit(len(SEVERITIES) + 1))
    rows = findings.groupBy("severity", "category").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("chapter_number", F.length("id").alias("size"), "id"))).alias("l"))
    return rows.orderBy(rank, "category").select("severity", "category", "n", F.transform("l", lambda x: x["id"]).alias("ids"))


def report(chapters: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each chapter: its path and title, its action list and notes, and the counts of the action list by severity and engine.

    One row a chapter, not one for the run, so that a report grows with no task's memory."""
    rows = buckets(findings).withColumn("f", F.struct(*FIELDS))
    listed = rows.groupBy("chapter_number").agg(
        F.sort_array(F.collect_list(F.when(F.col("bucket") == "action", F.col("f")))).alias("findings"),
        F.sort_array(F.collect_list(F.when(F.col("bucket") == "note", F.col("f")))).alias("notes"),
    )

    def counts(field: str, keys) -> F.Column:
        pairs = [x for k in keys for x in (F.lit(k), F.size(F.filter("findings", _has(field, k))))]
        return F.create_map(*pairs)

    out = chapters.select("chapter_number", "chapter_path", "title").join(listed, "chapter_number", "left")
    for name in ("findings", "notes"):
        out = out.withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out.withColumns({"total": F.size("findings"), "by_severity": counts("severity", SEVERITIES), "by_engine": counts("engine", ENGINES)})


def _has(field: str, value: str):
    return lambda x: x[field] == value


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select("chapter_number", F.to_json(F.struct(*rows.columns)).alias("json"))


def problems(findings: DataFrame, listed: DataFrame) -> DataFrame:
    """What breaks the schema of an action list: ids that repeat, required values that are missing, echoes among the findings, edits without the text that they replace, and listed ids without a finding.  problem, id.

    listed: id."""
    twice = findings.groupBy("id").count().filter("count > 1").select(F.lit("repeated id").alias("problem"), "id")
    empty = findings.filter(F.col("id").isNull() | F.col("rule_id").isNull() | F.col("severity").isNull() | F.col("category").isNull()).select(F.lit("missing value").alias("problem"), "id")
    echo = findings.filter(F.col("rule_id").isin("echo.local_repeat", "echo.phrase_dup")).select(F.lit("echo among findings").alias("problem"), "id")
    bare = findings.filter(F.col("applyable") & (F.coalesce("excerpt", F.lit("")) == "")).select(F.lit("edit without its text").alias("problem"), "id")
    lost = listed.select("id").join(findings.select("id"), "id", "left_anti").select(F.lit("no such finding").alias("problem"), "id")
    return twice.unionByName(empty).unionByName(echo).unionByName(bare).unionByName(lost)


def missing_keys(head_rows: DataFrame) -> list[str]:
    return sorted(set(HEAD_KEYS) - set(head_rows.columns))
