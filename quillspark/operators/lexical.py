"""Lexical rules.

A rule is a few patterns, and what their matches mean: columns of the match's
text, of the pattern's number and of how often it is met in the chapter give
rule_id, replacement (null where nothing may be pasted), turn (by which a
rule's hits are told before their start) and note (where the hit's message has
more in it than its text).  The matches of any number of rules are found in one
pass over a chapter; matches that meet what isn't prose, where that is known,
are none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import keep_initial, match_case

#: Letters that are those of ASCII in another case, but that lower case doesn't tell, or not in one letter.
ODD = re.compile("[ſıİ]")


@dataclass(frozen=True)
class Pattern:
    """A regular expression of Python; if folded, in lower case and laid on texts in lower case, where literals are found fast.

    A text without any of needs (in lower case) isn't searched.  With every_case, texts that have ODD letters are searched as they are."""

    regex: str
    folded: bool = False
    needs: tuple[str, ...] = ()
    every_case: bool = False
    #: More matches than these must be in a chapter for any to count.
    limit: int = 0


def _nothing(kind: str) -> Callable[[Column, Column, Column], Column]:
    return lambda text, k, uses: F.lit(None).cast(kind)


@dataclass(frozen=True)
class Rule:
    patterns: tuple[Pattern, ...] = ()
    rule_id: str | Callable[[Column, Column, Column], Column] = ""
    replacement: Callable[[Column, Column, Column], Column] = _nothing("string")
    turn: Callable[[Column, Column, Column], Column] = lambda text, k, uses: F.lit(0)
    note: Callable[[Column, Column, Column], Column] = _nothing("string")
    #: Whether hits that start within quotes count.
    quoted: bool = True
    #: A chapter that has this has no hits.
    unless: Pattern | None = None


#: Terms of Earth's history, and words that show that a text is set on Earth.
EARTH_TERMS = [
    "pre-cambrian", "precambrian", "cambrian", "ordovician", "silurian", "devonian", "carboniferous", "permian",
    "triassic", "jurassic", "cretaceous", "paleogene", "neogene", "pleistocene", "holocene", "mesozoic", "paleozoic",
    "cenozoic", "archean", "proterozoic", "telephone pole", "telephone poles", "roman empire", "victorian era",
    "medieval europe",
]
EARTH_CUES = r"(?i)\b(?:Earth|Terra|Sol\s+system|United\s+States|London|Paris|Rome|Tokyo)\b"

#: Wordy phrase, replacement, rule; of overlapping matches that of the earlier phrase counts.
WORDY = [
    ("in order to", "to", "word.in_order_to"),
    ("due to the fact that", "because", "word.due_to_the_fact"),
    ("due to the fact", "because", "word.due_to_the_fact"),
    ("a large number of", "many", "word.small_map"),
    ("a number of", "several", "word.small_map"),
    ("at this point in time", "now", "word.small_map"),
    ("in spite of the fact that", "although", "word.small_map"),
    ("for the purpose of", "to", "word.small_map"),
    ("in the event that", "if", "word.small_map"),
    ("with regard to", "about", "word.small_map"),
    ("in light of the fact that", "because", "word.small_map"),
    ("it is important to note that", "", "word.small_map"),
    ("make a decision", "decide", "word.small_map"),
    ("take into consideration", "consider", "word.small_map"),
    ("has the ability to", "can", "word.small_map"),
    ("prior to", "before", "word.small_map"),
    ("subsequent to", "after", "word.small_map"),
    ("in close proximity to", "near", "word.small_map"),
]


def folded(text: str) -> str:
    """The text in lower case, of the same length."""
    return text.lower() if text.isascii() else text.replace("İ", "i").lower()


class _Search:
    def __init__(self, pattern: Pattern) -> None:
        self.of = pattern
        self.fast = re.compile(pattern.regex)
        self.slow = re.compile(pattern.regex, re.IGNORECASE)

    def spans(self, text: str, low: str, odd: bool) -> list[tuple[int, int]]:
        if self.of.needs and not any(n in low for n in self.of.needs):
            return []
        if not self.of.folded:
            return [m.span() for m in self.fast.finditer(text)]
        return [m.span() for m in (self.slow.finditer(text) if odd and self.of.every_case else self.fast.finditer(low))]


def _ends(spans: list[dict] | None) -> tuple[list[int], list[int]]:
    return [s["start"] for s in spans or []], [s["end"] for s in spans or []]


def _found(batches: Iterable[pa.RecordBatch], rules: list[tuple[tuple[Pattern, ...], bool, Pattern | None]]) -> Iterator[pa.RecordBatch]:
    """The matches of each rule's patterns; skip and quotes are in order and overlap none of each other."""
    searches = [([_Search(p) for p in patterns], quoted, unless and _Search(unless)) for patterns, quoted, unless in rules]
    for batch in batches:
        for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
            rows, found = [], []
            given = [part.column(name).to_pylist() if name in part.schema.names else [None] * part.num_rows for name in ("content", "skip", "quotes")]
            for row, (text, skip, quotes) in enumerate(zip(*given)):
                if not text:
                    continue
                low, odd = folded(text), not text.isascii() and ODD.search(text) is not None
                (starts, ends), (opens, closes) = _ends(skip), _ends(quotes)
                for i, (patterns, quoted, unless) in enumerate(searches):
                    own = []
                    for k, search in enumerate(patterns):
                        spans = search.spans(text, low, odd)
                        if starts:
                            spans = [(a, b) for a, b in spans if not (j := bisect_left(starts, b)) or ends[j - 1] <= a]
                        if opens and not quoted:
                            spans = [(a, b) for a, b in spans if not (j := bisect_right(opens, a)) or closes[j - 1] <= a]
                        if len(spans) > search.of.limit:
                            own += [(i, k, a, b, text[a:b], len(spans)) for a, b in spans]
                    if own and not (unless and unless.spans(text, low, odd)):
                        found += own
                        rows += [row] * len(own)
            columns = [list(x) for x in zip(*found)] if found else [[]] * 6
            numbers = part.column("chapter_number").take(pa.array(rows, pa.int64()))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, *map(pa.array, columns, kinds)], ["chapter_number", "rule_ord", "k", "start", "end", "text", "uses"])


#: Two spaces or more within a line: not its indent, nor at its end.
double_space = Rule((Pattern(r"  (?<=[^\n ]  ) *(?=[^\n\r ])"),), "mech.double_space", lambda text, k, uses: F.lit(" "))
trailing_space = Rule((Pattern(r"[ \t](?<![ \t][ \t])[ \t]*+(?=\r?\n|\Z)"),), "mech.trailing_ws", lambda text, k, uses: F.lit(""))
space_before_punctuation = Rule((Pattern(r" [,:;](?<=\w..)"),), "mech.space_before_punct", lambda text, k, uses: F.substr(text, F.lit(2)), quoted=False)
repeated_punctuation = Rule((Pattern("!!+"), Pattern(r"\?\?+")), "mech.repeated_punct", turn=lambda text, k, uses: k)
em_dash = Rule((Pattern("—|--(?<!---)(?!-)"),), "style.em_dash")


def _place_in(words: list[str]) -> Callable[[Column, Column, Column], Column]:
    return lambda text, k, uses: F.array_position(F.array(*map(F.lit, words)), F.lower(text))


def _either(words: list[str], left: str, right: str) -> Pattern:
    return Pattern(rf"{left}(?:{'|'.join(map(re.escape, words))}){right}", folded=True, needs=tuple(words))


#: One term matches within another: the second pattern is for it.
earth_timeline = Rule(
    tuple(_either(terms, "(?<![a-z])", "(?![a-z])") for terms in ([t for t in EARTH_TERMS if t != "cambrian"], ["cambrian"])), "anachronism.earth_timeline", turn=_place_in(EARTH_TERMS),
    unless=Pattern(EARTH_CUES.removeprefix("(?i)").lower().replace(r"\s", r"[ \t\n\x0b\f\r]"), folded=True),
)


def _wordy(at: int) -> Callable[[Column], Column]:
    known = F.create_map(*(F.lit(x) for row in WORDY for x in (row[0], row[at])))
    return lambda text: F.element_at(known, F.lower(text))


#: Of phrases that overlap only those count that come first in the list; as these begin alike, alternatives in that order do it in one pass.
wordiness = Rule(
    (_either([p for p, _, _ in WORDY], r"\b", r"\b"),), lambda text, k, uses: _wordy(2)(text),
    lambda text, k, uses: F.when(_wordy(1)(text) == "", "").otherwise(keep_initial(text, _wordy(1)(text))), _place_in([p for p, _, _ in WORDY]), quoted=False,
)


def phrase(words: str, limit: int = 0) -> Pattern:
    """A phrase as whole words, whose words may be parted by any white space, in any case."""
    first, *more = (re.escape(w) for w in words.split())
    if not words.isascii():
        return Pattern(rf"(?i)(?<!\w)" + r"\s+".join([first, *more]) + r"(?!\w)", limit=limit)
    # What a text is searched for stands first: only then what is before it is looked at.
    first = first.lower()
    return Pattern(rf"{first}(?<!\w{first})" + "".join(rf"\s+{w.lower()}" for w in more) + r"(?!\w)", folded=True, every_case=True, limit=limit)


def _one_of(values: list[str]) -> Callable[[Column], Column]:
    return lambda k: F.get(F.array(*map(F.lit, values)), k)


def banned(phrases: list[str]) -> Rule:
    return Rule(tuple(phrase(p) for p in phrases if p.strip()), "guide.banned", turn=lambda text, k, uses: k)


def pet_words(limits: dict[str, int]) -> Rule:
    """All uses of a phrase in a chapter that uses it more often than its limit."""
    own = {p: n for p, n in limits.items() if p.strip()}
    if not own:
        return Rule()

    def note(text: Column, k: Column, uses: Column) -> Column:
        return F.concat(_one_of([f"“{p}” appears " for p in own])(k), uses.cast("string"), _one_of([f" times in this chapter (limit {n})." for n in own.values()])(k))

    return Rule(tuple(phrase(p, n) for p, n in own.items()), "guide.pet_word", turn=lambda text, k, uses: k, note=note)


def house_spelling(spellings: dict[str, str]) -> Rule:
    own = {w: r for w, r in spellings.items() if w.strip()}
    if not own:
        return Rule()
    return Rule(tuple(map(phrase, own)), "guide.spelling", lambda text, k, uses: match_case(text, _one_of(list(own.values()))(k)), lambda text, k, uses: k)


def hits(chapters: DataFrame, *rules: Rule) -> DataFrame:
    """chapter_number, rule_ord (of the rules as given), and the hits of each; what regions.laid_out has found, if it has, is left out.

    A hit that is as its replacement would have it is none."""
    known = [c for c in ("skip", "quotes") if c in chapters.columns]
    number = chapters.schema["chapter_number"].dataType.simpleString()
    search = partial(_found, rules=[(r.patterns, r.quoted, r.unless) for r in rules])
    found = chapters.select("chapter_number", "content", *known).mapInArrow(search, f"chapter_number {number}, rule_ord int, k int, start long, `end` long, text string, uses long")
    given = [F.col(c) for c in ("text", "k", "uses")]

    def told(name: str, kind: str) -> Column:
        out = F.lit(None).cast(kind)
        for i, rule in enumerate(rules):
            value = getattr(rule, name)
            out = F.when(F.col("rule_ord") == i, F.lit(value) if isinstance(value, str) else value(*given).cast(kind)).otherwise(out)
        return out.alias(name)

    rows = found.select("chapter_number", "rule_ord", "start", "end", told("rule_id", "string"), "text", told("replacement", "string"), told("turn", "int"), told("note", "string"))
    return rows.filter(F.coalesce(F.col("text") != F.col("replacement"), F.lit(True)))
