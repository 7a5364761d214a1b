"""Echoes: words repeated within a window of words, and phrases repeated within a paragraph."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip

WORD = "[A-Za-z']+"
#: Words that never count as an echo, fixed values.
STOP_WORDS = (
    "a an the and but or is was were are be been being have has had do does did will would shall should may might must "
    "can could to of in for on with at by from as into through during before after above below between out off over "
    "under again further then once here there when where why how all each every both few more most other some such no "
    "nor not only own same so than too very just because about up it its he she they them his her their him my your we "
    "me i you that this those these what which who whom if while until also still even back said says am yet against "
    "down away our whose now"
).split()
STOP = frozenset(STOP_WORDS)


def _tokens(text: str | None, skip: list[dict] | None, base: int = 0) -> list[tuple[int, int, str]]:
    """start, end and word (lower case) of the words that meet no span of skip; spans are in order and overlap none of each other."""
    out, spans, k = [], skip or [], 0
    for m in re.finditer(WORD, text or ""):
        start, end = m.start() + base, m.end() + base
        while k < len(spans) and spans[k]["end"] <= start:
            k += 1
        if k == len(spans) or spans[k]["start"] >= end:
            out.append((start, end, m.group().lower()))
    return out


def _content(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Words take more room than their text: a few chapters at a time.
        for part in (batch.slice(at, 100) for at in range(0, batch.num_rows, 100)):
            rows, words = [], []
            for row, (text, skip) in enumerate(zip(part.column("content").to_pylist(), part.column("skip").to_pylist())):
                own = [(i, *w) for i, w in enumerate((w for w in _tokens(text, skip) if len(w[2]) >= 3 and w[2] not in STOP), 1)]
                rows += [row] * len(own)
                words += own
            columns = [list(x) for x in zip(*words)] if words else [[], [], [], []]
            numbers = part.column("chapter_number").take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([numbers, *(pa.array(x, pa.int64()) for x in columns[:3]), pa.array(columns[3], pa.string())], names=["chapter_number", "i", "start", "end", "word"])


def content_words(chapters: DataFrame) -> DataFrame:
    """Of chapters that are laid out: chapter_number, i (ordinal), start, end, word: words of three letters or more that are not stop words."""
    number = chapters.schema["chapter_number"].dataType.simpleString()
    return chapters.select("chapter_number", "content", "skip").mapInArrow(_content, f"chapter_number {number}, i long, start long, `end` long, word string")


def local_repeats(words: DataFrame, window: int = 40, at_least: int = 3) -> DataFrame:
    """The word at which its count within the last ``window`` words first reaches at_least, once in each cluster of its uses.

    A cluster ends when no use is left in the window."""
    of_word = Window.partitionBy("chapter_number", "word").orderBy("i")
    gap = F.col("i") - F.lag("i").over(of_word)
    counted = words.withColumn("n", F.count("*").over(of_word.rangeBetween(-(window - 1), 0))).withColumn("fresh", F.when(gap <= window, 0).otherwise(1))
    clustered = counted.withColumn("cluster", F.sum("fresh").over(of_word.rowsBetween(Window.unboundedPreceding, 0)))
    reached = clustered.filter(F.col("n") >= at_least)
    first = F.row_number().over(Window.partitionBy("chapter_number", "word", "cluster").orderBy("i"))
    return reached.withColumn("__first", first).filter("__first = 1").select("chapter_number", "i", "start", "end", "word", "n")


def _words_of(batch: pa.RecordBatch, least: int) -> tuple[list[str], pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words of least letters of a batch of chapters that meet no span of skip, all chapters at a time.

    The texts, the words (lower case), their chapters' rows, starts and ends within all texts, and where in these each text begins."""
    texts = [t or "" for t in batch.column("content").to_pylist()]
    whole = "\n".join(texts)
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    letter = ((points | 32) - 97 < 26) | (points == 39)
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    words = pc.ascii_lower(pa.array(re.findall(WORD, whole), pa.string()))
    keep = ends - starts >= least
    skip = batch.column("skip")
    if len(spans := skip.flatten()):
        of = np.repeat(base, pc.fill_null(pc.list_value_length(skip), 0).to_numpy(zero_copy_only=False))
        begin, stop = (spans.field(f).to_numpy(zero_copy_only=False) + of for f in ("start", "end"))
        # The last span that begins before a word ends is the only one that the word may meet.
        last = np.searchsorted(begin, ends) - 1
        keep &= (last < 0) | (stop[last] <= starts)
    starts, ends = starts[keep], ends[keep]
    return texts, words.filter(pa.array(keep)), np.searchsorted(base, starts, "right") - 1, starts, ends, base


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few chapters at a time: words take more room than their text."""
    for batch in batches:
        yield from (batch.slice(at, 200) for at in range(0, batch.num_rows, 200))


def _ids(words: pa.Array) -> np.ndarray:
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _close_of(batches: Iterable[pa.RecordBatch], window: int, at_least: int) -> Iterator[pa.RecordBatch]:
    """local_repeats on sorted arrays of a few chapters' words; the use at which a count first reaches at_least is that very count."""
    for part in _parts(batches):
        _, words, rows, starts, ends, base = _words_of(part, 3)
        content = pc.invert(pc.is_in(words, value_set=pa.array(STOP_WORDS)))
        words, keep = words.filter(content), content.to_numpy(zero_copy_only=False)
        rows, starts, ends = rows[keep], starts[keep], ends[keep]
        i = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
        order = np.lexsort((i, _ids(words), rows))
        of, at = np.stack([rows, _ids(words)])[:, order], i[order]
        same = lambda by: np.append(np.zeros(min(by, len(at)), bool), (of[:, by:] == of[:, : len(at) - min(by, len(at))]).all(0))
        back = lambda by: at - np.append(np.zeros(min(by, len(at)), np.int64), at[: len(at) - min(by, len(at))])
        cluster = np.cumsum(~(same(1) & (back(1) <= window)))
        reached = np.flatnonzero(same(at_least - 1) & (back(at_least - 1) < window))
        first = reached[np.unique(cluster[reached], return_index=True)[1]]
        found = np.sort(order[first])
        columns = [i[found], starts[found] - base[rows[found]], ends[found] - base[rows[found]]]
        yield pa.RecordBatch.from_arrays(
            [part.column("chapter_number").take(pa.array(rows[found])), *(pa.array(c, pa.int64()) for c in columns), words.take(pa.array(found)), pa.array(np.full(len(found), at_least), pa.int64())],
            ["chapter_number", "i", "start", "end", "word", "n"],
        )


def close_repeats(chapters: DataFrame, window: int = 40, at_least: int = 3) -> DataFrame:
    """local_repeats of the content words of chapters that are laid out, in one pass over each: its words aren't shuffled."""
    number = chapters.schema["chapter_number"].dataType.simpleString()
    search = partial(_close_of, window=window, at_least=at_least)
    return chapters.select("chapter_number", "content", "skip").mapInArrow(search, f"chapter_number {number}, i long, start long, `end` long, word string, n long")


def phrase_repeats(chapters: DataFrame, sizes: tuple[int, ...] = (4, 3), max_gap: int = 2) -> DataFrame:
    """The best close repeat of each paragraph of chapters that are laid out: the longest phrase, then the smallest gap, then the phrase met first.

    chapter_number, para (its start), phrase, gap, start, end (of both uses together), excerpt (the paragraph)."""
    number = chapters.schema["chapter_number"].dataType.simpleString()
    search = partial(_repeats, sizes=sizes, max_gap=max_gap)
    found = chapters.select("chapter_number", "content", "skip").mapInArrow(search, f"chapter_number {number}, para long, phrase string, gap long, start long, `end` long, body string")
    return found.select("chapter_number", "para", "phrase", "gap", "start", "end", strip(F.col("body")).alias("excerpt"))


#: What parts paragraphs, with the white space of ASCII.
_BREAK, _START = re.compile(r"\n[ \t\n\x0b\f\r]*\n"), re.match("", "")


def _repeats(batches: Iterable[pa.RecordBatch], sizes: tuple[int, ...], max_gap: int) -> Iterator[pa.RecordBatch]:
    """The paragraphs in which words follow themselves closely are found by comparing all words at each distance; the best repeat is looked for in these alone."""
    for part in _parts(batches):
        texts, words, _, starts, ends, base = _words_of(part, 1)
        breaks = [(a + b.start(), a + b.end(), row) for row, (a, t) in enumerate(zip(base.tolist(), texts)) for b in (_START, *_BREAK.finditer(t))]
        begins = np.array([b for _, b, _ in breaks], np.int64)
        of, ids, n = np.searchsorted(begins, starts, "right") - 1, _ids(words), min(sizes)
        maybe = np.zeros(len(breaks), bool)
        for apart in range(1, max(sizes) + max_gap + 1):
            if len(ids) >= apart + n:
                same = (ids[apart:] == ids[:-apart]) & (of[apart:] == of[:-apart])
                run = np.logical_and.reduce([same[j : len(same) - n + 1 + j] for j in range(n)])
                maybe[of[np.flatnonzero(run)]] = True
        found = []
        for p in np.flatnonzero(maybe).tolist():
            a, b = np.searchsorted(of, [p, p + 1])
            own = words.slice(a, b - a).to_pylist()
            if (best := _best_repeat(own, sizes, max_gap)) is not None:
                size, gap, first, last = best
                _, at, row = breaks[p]
                stop = breaks[p + 1][0] if p + 1 < len(breaks) and breaks[p + 1][2] == row else base[row] + len(texts[row])
                zero = int(base[row])
                found.append((row, at - zero, " ".join(own[first : first + size]), gap, int(starts[a + first]) - zero, int(ends[a + last + size - 1]) - zero, texts[row][at - zero : stop - zero]))
        rows, *columns = [list(x) for x in zip(*found)] if found else [[]] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        numbers = part.column("chapter_number").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([numbers, *map(pa.array, columns, kinds)], names=["chapter_number", "para", "phrase", "gap", "start", "end", "body"])


def _best_repeat(words: list[str], sizes: tuple[int, ...], max_gap: int) -> tuple[int, int, int, int] | None:
    """Size, gap and the places of both uses of a paragraph's best repeat: of two uses that follow each other."""
    best = None
    for n in sizes:
        met, last = {}, {}
        for p, gram in enumerate(zip(*(words[j:] for j in range(n)))):
            before = last.get(gram)
            last[gram] = p
            if before is None:
                met[gram] = p
            elif p - before - n <= max_gap and any(len(w) > 2 and w not in STOP for w in gram):
                rank = (-n, p - before - n, met[gram], before)
                best = rank if best is None else min(best, rank)
    return None if best is None else (-best[0], best[1], best[3], best[3] - best[0] + best[1])
