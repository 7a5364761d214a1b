"""What lies round a chapter or a book: its chapters, its glossary and its cast, found through Spark's own file systems."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..functions.tables import files_of
from . import chapters

#: How a chapter's file is named, folders that name no story, where glossary and cast stand below a story, and how far up they are looked for.
CHAPTER_FILE = re.compile(r"^chapter-(\d+)\.md$", re.IGNORECASE)
GENERIC = ["chapters"]
GLOSSARY, CHARACTERS, MOST_PARENTS = "canon/style/worldbuilding-glossary.json", "canon/characters", 8


@dataclass(frozen=True)
class Found:
    """Chapters (as sources.chapters gives them), the folder of their story, its slug and a name to show."""

    chapters: DataFrame
    story_dir: str
    slug: str
    name: str
    chapter_number: int | None = None


def _chapter_names(files, where) -> list[str]:
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isFile() and CHAPTER_FILE.match(s.getPath().getName()))


def _story(where):
    """A folder, or the first above it whose name says something."""
    while where.getName().lower() in GENERIC and where.getParent() is not None:
        where = where.getParent()
    return where


def slug_of(name: str) -> str:
    return re.sub(r"[^\w\-]", "-", name.lower()).strip("-") or "manuscript"


def one_chapter(spark: SparkSession, path: str) -> Found:
    """A single chapter-NNN.md file."""
    files, where = files_of(spark, path)
    if not files.exists(where):
        raise FileNotFoundError(f"Path does not exist: {path}")
    match = CHAPTER_FILE.match(where.getName())
    if not files.getFileStatus(where).isFile() or not match:
        raise ValueError(f"A single chapter-NNN.md file is needed, not {path}")
    story = _story(where.getParent())
    return Found(chapters.from_markdown(spark, where.toString()), story.toString(), slug_of(story.getName()), f"{story.getName()} · Chapter {int(match.group(1))}", int(match.group(1)))


def book(spark: SparkSession, path: str) -> Found:
    """The chapter files of a folder, or of the folder "chapters" below it; two files of one number are an error."""
    files, where = files_of(spark, path)
    if not files.exists(where):
        raise FileNotFoundError(f"Path does not exist: {path}")
    if files.getFileStatus(where).isFile():
        raise ValueError(f"A folder of chapters is needed, not the file {path}")
    names = _chapter_names(files, where)
    below = spark._jvm.org.apache.hadoop.fs.Path(where, "chapters")
    if not names and files.exists(below):
        where, names = below, _chapter_names(files, below)
    if not names:
        raise FileNotFoundError(f"No chapter-*.md files found in {path}")
    numbers = [int(CHAPTER_FILE.match(n).group(1)) for n in names]
    if len(set(numbers)) < len(numbers):
        raise ValueError(f"Two files have one chapter number: {names}")
    story = _story(where)
    return Found(chapters.from_markdown(spark, where.toString()), story.toString(), slug_of(story.getName()), story.getName())


def above(spark: SparkSession, start: str, relative: str) -> str | None:
    """The first path with that relative name in a file's folder, or in the MOST_PARENTS folders above it."""
    files, where = files_of(spark, start)
    if files.exists(where) and files.getFileStatus(where).isFile():
        where = where.getParent()
    for _ in range(MOST_PARENTS + 1):
        candidate = spark._jvm.org.apache.hadoop.fs.Path(where, relative)
        if files.exists(candidate):
            return candidate.toString()
        where = where.getParent()
        if where is None:
            return None
    return None


def glossary_of(spark: SparkSession, start: str) -> DataFrame:
    """The glossary (term, definition, aliases) of the story that a path is in; empty if there is none."""
    path = above(spark, start, GLOSSARY)
    return chapters.glossary(spark, path) if path else spark.createDataFrame([], chapters.GLOSSARY)


def cast_of(spark: SparkSession, start: str) -> DataFrame:
    """The character files of the story that a path is in; empty if there are none."""
    path = above(spark, start, CHARACTERS)
    if path is None:
        return spark.createDataFrame([], chapters.CAST).drop("_corrupt_record")
    return chapters.cast(spark, path)


def notices(spark: SparkSession, story_dir: str, terms: int, parser: bool = False) -> list[str]:
    """What a run says beside its findings: how many terms the book's lexicon has, or that it lacks one; and that rules of a parser had none."""
    out = []
    files, where = files_of(spark, story_dir)
    in_stories = where.getParent() is not None and where.getParent().getName().lower() == "stories"
    if terms:
        out.append(f"Book lexicon: {terms} terms.")
    elif in_stories or files.exists(spark._jvm.org.apache.hadoop.fs.Path(where, "canon")):
        out.append("No worldbuilding glossary found for this story.")
    if not parser:
        out.append("No parser: missing predicates, same-shape runs and shares of subjects and clauses are left out.")
    return out
