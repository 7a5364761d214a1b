"""Text functions on columns: matches with code-point offsets, and scalars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


SPAN = "struct<start:bigint,end:bigint>"
MATCH = "struct<start:bigint,end:bigint,text:string>"
#: Numbers that one fold adds up; what it holds is copied at each step, so that longer arrays are cut in runs, and runs of runs.
RUN, LEVELS = 32, 2


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _fold(sizes: Column) -> Column:
    zero = F.struct(F.lit(0).cast("long").alias("at"), none_of("bigint").alias("out"))
    step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    return F.aggregate(sizes, zero, step, lambda acc: acc["out"])


def running(sizes: Column, levels: int = LEVELS) -> Column:
    """The sum of what stands before each number of an array."""
    # What is used more than once is bound by let: written out it would be computed, and planned, each time.
    return let(sizes, lambda n: _running(n, levels)) if levels else _fold(sizes)


def _running(sizes: Column, levels: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(sizes), F.lit(RUN)), lambda i: F.slice(sizes, i, RUN))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, n: a + n)
    shifted = lambda x, at: F.transform(_fold(x), lambda o: o + at)
    cut = let(runs, lambda r: F.flatten(F.zip_with(r, running(F.transform(r, total), levels - 1), shifted)))
    return F.when(F.size(sizes) <= RUN, _fold(sizes)).otherwise(cut)


def pieces(text: Column, regex: str, group: int = 0) -> Column:
    """A text cut at every leftmost non-overlapping match: an array of at (0-based code points), g (what precedes a match), m (the match) and t (a group of it).

    The last piece has no match.  Java's own match positions count UTF-16
    units; summing the lengths of the pieces gives code points."""
    found = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    zipped = F.arrays_zip(F.split(text, regex, -1).alias("g"), found.alias("m"), *([F.regexp_extract_all(text, F.lit(regex), F.lit(group)).alias("t")] if group else []))
    size = lambda p: (F.length(p["g"]) + F.coalesce(F.length(p["m"]), F.lit(0))).cast("long")

    def made(p: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), p["g"].alias("g"), p["m"].alias("m"), p["t" if group else "m"].alias("t"))

    return let(zipped, lambda z: let(F.transform(z, size), lambda n: F.zip_with(z, running(n), made)))


def spans(text: Column, regex: str, group: int = 0, base: Column | int = 0) -> Column:
    """Every leftmost non-overlapping match, in order: an array of start, end (end exclusive) and text; start and end are shifted by base.

    With a group, text is that group of each match while start and end are the match's."""
    shift = base if isinstance(base, Column) else F.lit(base).cast("long")
    every = lambda g: F.regexp_extract_all(text, F.lit(regex), F.lit(g))

    def placed(found: Column) -> Column:
        # What precedes each match; most texts have none, and are not cut.
        cut = F.zip_with(F.slice(F.split(text, regex, -1), 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).cast("long").alias("g"), F.length(m).cast("long").alias("m")))
        start = lambda z: let(running(F.transform(z, lambda p: p["g"] + p["m"])), lambda n: F.zip_with(z, n, lambda p, at: F.struct((at + p["g"] + shift).alias("start"), (at + p["g"] + p["m"] + shift).alias("end"))))
        made = F.zip_with(let(cut, start), every(group) if group else found, lambda p, t: F.struct(p["start"].alias("start"), p["end"].alias("end"), t.alias("text")))
        return F.when(F.size(found) == 0, none_of(MATCH)).otherwise(made)

    return let(every(0), placed)


def bounds(array: Column) -> Column:
    """start and end alone."""
    return F.transform(array, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))


def meets_any(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of others."""
    return F.exists(others, lambda o: (span["start"] < o["end"]) & (o["start"] < span["end"]))


def starts_in_any(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] <= span["start"]) & (span["start"] < o["end"]))


def covered_by_any(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] <= span["start"]) & (span["end"] <= o["end"]))


def gaps_between(cuts: Column, begin: Column, stop: Column) -> Column:
    """What lies between sorted cuts, from begin to stop: an array of start and end, empty pieces included."""
    starts = F.concat(F.array(begin.cast("long")), F.transform(cuts, lambda c: c["end"]))
    ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(stop.cast("long")))
    return F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end")))


def between(text: Column, span: Column) -> Column:
    return F.substr(text, span["start"].cast("int") + 1, (span["end"] - span["start"]).cast("int"))


def matches(df: DataFrame, regex: str, keys: Sequence[str] = ("chapter_number",), text: str = "content", base: str | None = None, group: int = 0) -> DataFrame:
    """A row for each match: keys, k (its ordinal), start, end and text, as spans() gives them. Nothing is shuffled."""
    found = spans(F.col(text), regex, group, F.col(base) if base else 0)
    return df.select(*keys, F.posexplode(found).alias("k", "m")).select(*keys, "k", "m.*")


def as_of(rows: DataFrame, at: str, **spans: DataFrame) -> DataFrame:
    """rows with a column for each of spans: the last of its chapter that starts at or before the point, as a struct; null if there is none.

    rows and spans have chapter_number; spans have start and what else they carry.  Points and starts are sorted together,
    chapter by chapter, and what was met last is carried along: the work grows with rows and spans, not with their product."""
    kinds = {name: ", ".join(f"`{f.name}`: {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "chapter_number") for name, df in spans.items()}
    empty = {name: F.lit(None).cast(f"struct<{kind}>").alias(name) for name, kind in kinds.items()}
    every = rows.select("chapter_number", F.col(at).cast("long").alias("__at"), F.lit(1).alias("__asks"), F.struct(*rows.columns).alias("__row"), *empty.values())
    row = F.lit(None).cast(every.schema["__row"].dataType).alias("__row")
    for name, df in spans.items():
        own = F.struct(*(c for c in df.columns if c != "chapter_number")).alias(name)
        every = every.unionByName(df.select("chapter_number", F.col("start").cast("long").alias("__at"), F.lit(0).alias("__asks"), row, *(own if n == name else e for n, e in empty.items())))
    before = Window.partitionBy("chapter_number").orderBy("__at", "__asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumns({name: F.last(name, ignorenulls=True).over(before) for name in spans}).filter("__asks = 1").select("__row.*", *spans)


def outside(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows whose span overlaps none of the spans of their chapter, which overlap none of each other."""
    last = as_of(rows.withColumn("__last", F.col("end") - 1), "__last", __span=spans.select("chapter_number", "start", "end"))
    return last.filter(~F.coalesce(F.col("__span.end") > F.col("start"), F.lit(False))).select(*rows.columns)


def within(rows: DataFrame, spans: DataFrame, carry: Sequence[str], how: str = "left") -> DataFrame:
    """rows with the columns ``carry`` of the span of their chapter that holds their first character; the spans overlap none of each other."""
    found = as_of(rows, "start", __span=spans.select("chapter_number", "start", "end", *carry))
    holds = F.col("start") < F.col("__span.end")
    if how == "inner":
        found = found.filter(holds)
    return found.select(*rows.columns, *(F.when(holds, F.col(f"__span.{c}")).alias(c) for c in carry))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def keep_initial(original: Column, replacement: Column) -> Column:
    """The replacement, with a capital if the original starts with one."""
    head = F.substring(original, 1, 1)
    capital = (head == F.upper(head)) & (head != F.lower(head))
    return F.when(capital, F.concat(F.upper(F.substring(replacement, 1, 1)), F.substr(replacement, F.lit(2)))).otherwise(replacement)


def match_case(original: Column, replacement: Column) -> Column:
    """The replacement in capitals, with an initial capital, or as it is: like the original."""
    shouted = (original == F.upper(original)) & (original != F.lower(original)) & (F.length(original) > 1)
    return F.when(shouted, F.upper(replacement)).otherwise(keep_initial(original, replacement))


def truncate_middle(text: Column, limit: int = 12_000) -> Column:
    """Head and tail with a mark between them, of limit characters together, where the text is longer."""
    mark = "\n…\n"
    left = (limit - len(mark)) // 2
    right = limit - len(mark) - left
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, left), F.lit(mark), F.right(text, F.lit(right)))).otherwise(text)


def clip(text: Column, limit: int = 600) -> Column:
    """The stripped text, cut to limit characters with an ellipsis."""
    body = strip(text)
    return F.when(F.length(body) > limit, F.concat(F.regexp_replace(F.substring(body, 1, limit - 1), r"\s+$", ""), F.lit("…"))).otherwise(body)


def line_at(text: Column, offset: Column) -> Column:
    """The 1-based number of the line that holds a code point."""
    return F.regexp_count(F.substring(text, F.lit(1), F.least(offset, F.length(text)).cast("int")), F.lit("\n")) + 1


def enclosing(text: Column, span: Column) -> Column:
    """The sentence or line round a span (start, end): up to the stop or line end before it, less spaces, and to the one after it."""
    before = F.regexp_extract(F.substring(text, F.lit(1), span["start"].cast("int")), r"[^.!?\n]*\z", 0)
    after = F.regexp_extract(F.substr(text, span["end"].cast("int") + 1), r"\A[^.!?\n]*[.!?]?", 0)
    whole = F.struct((span["start"] - F.length(before)).alias("start"), (span["end"] + F.length(after)).alias("end"))
    lead = lambda w: F.length(F.regexp_extract(between(text, w), r"\A[ \t]*", 0))
    return let(whole, lambda w: F.struct((w["start"] + lead(w)).alias("start"), w["end"].alias("end")))


def context(text: Column, span: Column, chars: int = 500) -> Column:
    """What stands up to so many characters round a span, with it."""
    start = F.greatest(span["start"] - chars, F.lit(0))
    return F.substr(text, start.cast("int") + 1, (span["end"] + chars - start).cast("int"))


def flat_excerpt(text: Column, limit: int = 160) -> Column:
    """One line of at most limit characters, cut with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit - 1), F.lit("…"))).otherwise(flat)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[^\w-]", "-")


def counts_line(counts: Column) -> Column:
    """A map of counts as "k=v, k=v", in the order of its keys."""
    return F.concat_ws(", ", F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))


def phrase_span(text: Column, phrase: Column) -> Column:
    """The first place of a phrase whose words may be parted by any white space: start and end, null if it isn't there."""
    words = F.transform(F.filter(F.split(phrase, r"(?U)\s+", -1), lambda w: w != ""), lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("")), F.lit("\\E")))
    found = F.regexp_substr(text, F.concat(F.lit("(?iU)"), F.array_join(words, "\\s+")))
    at = F.call_function("locate", found, text)
    return F.when((F.size(words) > 0) & (found != ""), F.struct((at - 1).cast("long").alias("start"), (at - 1 + F.length(found)).cast("long").alias("end")))
