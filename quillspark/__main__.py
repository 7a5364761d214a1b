"""python -m quillspark analyze BOOK | companion CHAPTER | init FOLDER: checks that end in a report file, and the settings' template."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.tables import written
from .operators import cast as people
from .operators import checks, findings, regions
from .plans import report
from .sources import discovery, files, settings


def forms_of(glossary: DataFrame) -> DataFrame:
    """form: the terms of a glossary and their aliases, each once."""
    every = F.concat(F.array("term"), F.coalesce("aliases", F.array().cast("array<string>")))
    return glossary.select(F.posexplode(every).alias("nth", "form")).transform(findings.distinct_forms).select("form")


def run(spark: SparkSession, mode: str, path: str, reports: str, skip: list[str], apply: str | None) -> tuple[str, DataFrame]:
    """The report's path and the findings."""
    found = (discovery.one_chapter if mode == "companion" else discovery.book)(spark, path)
    config = settings.load(spark, path)
    forms, cast = forms_of(discovery.glossary_of(spark, path)), discovery.cast_of(spark, path)
    told = checks.check(found.chapters, config, skip, forms, cast.select("name", "pronouns"))
    if mode == "analyze":
        # Notes on the cast's own files come first, as those of chapter 0.
        told = people.file_findings(cast).unionByName(told, allowMissingColumns=True)
    told = written(told)
    chapters = found.chapters
    if apply:
        edited = findings.apply_edits(chapters, told).join(chapters.select("chapter_number", "chapter_path"), "chapter_number")
        files.write_texts(edited.select(F.element_at(F.split("chapter_path", "/"), -1).alias("name"), F.col("content").alias("text")), apply)
    where = report.report_path(spark, reports, mode, found.chapter_number)
    notices = discovery.notices(spark, found.story_dir, forms.count(), config.parser is not None)
    report.write_file([where], told, chapters, regions.laid_out(chapters), mode=mode, path=path, name=found.name, slug=found.slug, chapter_number=found.chapter_number, warnings=notices, apply=bool(apply))
    return where, told


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillspark", description=__doc__)
    parser.add_argument("mode", choices=["analyze", "companion", "init"])
    parser.add_argument("path")
    parser.add_argument("--reports", default="reports", help="folder of reports")
    parser.add_argument("--skip", action="append", default=[], help="leave out rules that start so")
    parser.add_argument("--apply", help="new folder for the chapters with safe edits pasted")
    given = parser.parse_args(argv)
    spark = SparkSession.builder.appName("quillspark").getOrCreate()
    try:
        if given.mode == "init":
            print(settings.save(spark, given.path))
            return 0
        where, told = run(spark, given.mode, given.path, given.reports, given.skip, given.apply)
    except (FileNotFoundError, FileExistsError, ValueError) as error:
        print(error, file=sys.stderr)
        return 1
    for row in findings.top_findings(told).collect():
        print(f"{row['severity']:<10} {row['id']} {row['rule_id']} line {row['line_start'] or '-'}: {row['message']}")
    print(where)
    return 0


if __name__ == "__main__":
    sys.exit(main())
