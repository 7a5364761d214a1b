"""Regions of a chapter: what is not prose, scenes, quotes, paragraphs and sentences.

All are arrays in the chapter's own row, so that a chapter is read once, in
one place; the functions that give rows explode them.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from ..functions.text import MATCH, SPAN, between, gaps_between, let, pieces, spans, strip

#: Fixed patterns.
QUOTE = '"[^"]*"'
#: A paragraph within a prose segment ends at a line that is blank but for spaces.  Possessive: Java recurses on plain groups; Python reads it alike.
PARAGRAPH = r"[^\n][^\n]*+(?:\n(?![ \t\r]*\n)[^\n]*+)*+"
#: A run of lines that are not empty.
BLOCK = r"[^\n]++(?:\n[^\n]++)*+"
SENTENCE_GAP = r"(?<=[.!?])[\"”’)]*\s+"
WORD = "[A-Za-z0-9']+"

#: What isn't prose, for Python, and the white space of ASCII.
_FRONTMATTER = re.compile(r"(?s)\ufeff?---\r?\n.*?\r?\n---\r?\n?")
_CUTS = [re.compile(r) for r in (r"(?ms)^```[^\n]*\n.*?^```[ \t]*\r?\n?", r"(?m)^#{1,6}[ \t]+.*$")]
_BREAK, _QUOTE, _PARAGRAPH = re.compile(r"(?m)^---[ \t]*$"), re.compile(QUOTE), re.compile(PARAGRAPH)
SPACE = " \t\n\x0b\f\r"
#: A sentence mark and the gap behind it.
_GAP = re.compile(rf"[.!?][\"”’)]*[{SPACE}]+")
Spans = list[tuple[int, int]]


def _gaps(cuts: Spans, begin: int, stop: int) -> Spans:
    """What lies between sorted cuts, from begin to stop."""
    return list(zip([begin, *(b for _, b in cuts)], [*(a for a, _ in cuts), stop]))


def _regions_of(text: str) -> tuple[int, Spans, Spans, Spans]:
    """body, quotes, skip and scenes of a text; see laid_out."""
    front = _FRONTMATTER.match(text)
    body = front.end() if front else 0
    breaks = [m.span() for m in _BREAK.finditer(text)]
    cuts = sorted([(0, body)] * bool(body) + breaks + [m.span() for r in _CUTS for m in r.finditer(text)])
    skip = []
    for start, end in cuts:
        if skip and start <= skip[-1][1]:
            skip[-1] = (skip[-1][0], max(skip[-1][1], end))
        else:
            skip.append((start, end))
    parts = _gaps([x for x in breaks if x[0] >= body], body, len(text))
    scenes = [(a, b) for a, b in parts if text[a:b].strip(SPACE)] or parts[-1:]
    return body, [m.span() for m in _QUOTE.finditer(text)], skip, scenes


def _sentences_in(text: str, skip: Spans) -> list[tuple[int, int, str]]:
    """The prose sentences of a text in order, as sentence_spans has them."""
    out = []
    for a, b in _gaps(skip, 0, len(text)):
        for paragraph in _PARAGRAPH.finditer(text[a:b]) if b > a else ():
            told, at = paragraph.group(), 0
            for end in [*(m.end() for m in _GAP.finditer(told)), len(told)]:
                piece = told[at:end]
                if full := piece.strip(SPACE):
                    start = a + paragraph.start() + at + len(piece) - len(piece.lstrip(SPACE))
                    out.append((start, start + len(full), full))
                at = end
    return out


def _lists(rows: list[list[tuple]], *more: pa.DataType) -> pa.ListArray:
    """Lists of spans (start, end and what else they carry) as an Arrow array."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    columns = list(zip(*(x for r in rows for x in r))) or [()] * (2 + len(more))
    fields = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), *more))]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "end", "text"][: len(fields)]))


def _lay_out(batches: Iterable[pa.RecordBatch], with_told: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            texts = [t or "" for t in part.column("content").to_pylist()]
            bodies, quotes, skips, scenes = zip(*map(_regions_of, texts))
            made = {"body": pa.array(bodies, pa.int64()), "quotes": _lists(quotes), "skip": _lists(skips), "scenes": _lists(scenes)}
            if with_told:
                made["told"] = _lists([_sentences_in(t, s) for t, s in zip(texts, skips)], pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*part.schema.names, *made])


def laid_out(chapters: DataFrame, with_told: bool = False) -> DataFrame:
    """chapters with body (the end of the frontmatter), skip (spans of frontmatter, fences, headings and breaks, merged), quotes and scenes; with_told, also the sentences (told).

    A scene is what lies between breaks after the frontmatter; blank ones don't
    count, but there is always one.  An opening quote without a partner is no span."""
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chapters.schema.fields)
    made = f"body long, quotes array<{SPAN}>, skip array<{SPAN}>, scenes array<{SPAN}>" + (f", told array<{MATCH}>" if with_told else "")
    return chapters.mapInArrow(partial(_lay_out, with_told=with_told), f"{own}, {made}")


def _laid(chapters: DataFrame) -> DataFrame:
    return chapters if "scenes" in chapters.columns else laid_out(chapters)


def non_prose(chapters: DataFrame) -> DataFrame:
    """chapter_number, start, end of frontmatter, code fences, headings and scene breaks, merged."""
    return _laid(chapters).select("chapter_number", F.inline("skip"))


def quotes(chapters: DataFrame) -> DataFrame:
    return _laid(chapters).select("chapter_number", F.inline("quotes"))


def scenes(chapters: DataFrame) -> DataFrame:
    """chapter_number, scene (from 1), start, end."""
    rows = _laid(chapters).select("chapter_number", F.posexplode("scenes").alias("k", "s"))
    return rows.select("chapter_number", (F.col("k") + 1).cast("long").alias("scene"), "s.*")


def _scene_at(start: Column, all_scenes: Column) -> Column:
    """The number of the scene that holds a position; the first if none does."""
    numbered = F.transform(all_scenes, lambda s, i: F.when((s["start"] <= start) & (start < s["end"]), (i + 1).cast("long")))
    return F.coalesce(F.get(F.filter(numbered, lambda n: n.isNotNull()), F.lit(0)), F.lit(1).cast("long"))


def paragraphs(chapters: DataFrame) -> DataFrame:
    """chapter_number, start, end, text: split at blank lines anywhere in the chapter; blank ones don't count."""
    c = F.col("content")
    cut = F.transform(pieces(c, r"\n\s*\n"), lambda p: F.struct(p["at"].alias("start"), (p["at"] + F.length(p["g"])).alias("end"), p["g"].alias("text")))
    return chapters.select("chapter_number", F.inline(F.filter(cut, lambda p: p["text"].rlike(r"\S"))))


def prose_segments(content: Column, skip: Column) -> Column:
    """The complement of what is not prose: an array of start, end."""
    return F.filter(gaps_between(skip, F.lit(0), F.length(content)), lambda x: x["end"] > x["start"])


def _sentences_of(paragraph: Column) -> Column:
    """The sentences of a paragraph (start, end, text), as spans of the chapter: closing quotes stay with the sentence before them."""
    cut = pieces(paragraph["text"], SENTENCE_GAP)
    raw = lambda p: F.concat(p["g"], F.coalesce(F.regexp_replace(p["m"], r"\s+$", ""), F.lit("")))

    def bare(p: Column) -> Column:
        return let(raw(p), lambda r: F.struct((paragraph["start"] + p["at"] + F.length(F.regexp_extract(r, r"^\s*", 0))).alias("start"), strip(r).alias("text")))

    full = F.filter(F.transform(cut, bare), lambda s: s["text"] != "")
    return F.transform(full, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), s["text"].alias("text")))


def paragraph_spans(content: Column, skip: Column) -> Column:
    """The paragraphs of a chapter's prose in order: an array of start, end, text."""
    of_segment = lambda x: F.filter(spans(between(content, x), PARAGRAPH, base=x["start"]), lambda p: p["text"].rlike(r"\S"))
    return F.flatten(F.transform(prose_segments(content, skip), of_segment))


def sentence_spans(content: Column, skip: Column) -> Column:
    """The prose sentences of a chapter in order: an array of start, end, text."""
    return F.flatten(F.transform(paragraph_spans(content, skip), _sentences_of))


def told(chapters: DataFrame) -> Column:
    """The sentences of chapters that are laid out: those of a parser if they have them (parses.with_parses), else by rule."""
    for known in ("parsed", "told"):
        if known in chapters.columns:
            return F.col(known)
    return sentence_spans(F.col("content"), F.col("skip"))


def kept(chapters: DataFrame) -> DataFrame:
    """chapters laid out, with their sentences, as a table: for what reads them many times."""
    if "scenes" not in chapters.columns:
        return written(laid_out(chapters, with_told=True))
    return written(chapters.withColumn("told", told(chapters)) if not {"parsed", "told"} & set(chapters.columns) else chapters)


def sentences(chapters: DataFrame) -> DataFrame:
    """chapter_number, idx (from 0), start, end, scene, dialogue, text of each prose sentence, and its tokens where a parser gave them.

    A sentence with a double quote counts as dialogue."""
    laid = chapters if "scenes" in chapters.columns else laid_out(chapters, with_told=True)
    rows = laid.select("chapter_number", "scenes", F.posexplode(told(laid)).alias("idx", "s")).select("chapter_number", F.col("idx").cast("long"), "s.*", "scenes")
    more = [c for c in ("tokens",) if c in rows.columns]
    return rows.select("chapter_number", "idx", "start", "end", _scene_at(F.col("start"), F.col("scenes")).alias("scene"), F.col("text").rlike('["“”]').alias("dialogue"), "text", *more)
