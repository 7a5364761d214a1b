"""What a finding says and suggests, by its rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The message of each rule whose hits don't say it themselves. {old} is the text of the hit, {new} its replacement, {mark} its first character.
MESSAGES = {
    "mech.double_space": "Collapse multiple spaces to one.",
    "mech.trailing_ws": "Strip trailing whitespace.",
    "mech.space_before_punct": "Remove space before '{new}'.",
    "mech.repeated_punct": "Repeated '{mark}' punctuation may be intentional fiction intensity.",
    "mech.missing_predicate": "Main clause may be missing a finite verb (predicate).",
    "style.em_dash": "Em dash or double hyphen found. Prefer a period or parentheses for this project.",
    "anachronism.earth_timeline": (
        "Earth timeline/culture label '{old}' appears in prose that does not establish an Earth setting. Prefer in-world chronology or a local simile."
    ),
    "guide.banned": "“{old}” is on this book's banned list.",
    "guide.spelling": "House spelling: “{new}”.",
}
#: Wordy phrases with and without a replacement.
PREFER, DROP = "Prefer '{new}' over '{old}'.", "Consider dropping '{old}'."
#: What is suggested where nothing can be pasted; {mark} as above.
SUGGESTIONS = {
    "mech.repeated_punct": "{mark}",
    "style.em_dash": "(rewrite with a period or parentheses)",
    "anachronism.earth_timeline": "Replace with world-local time/material language, or mark the setting as Earth if intentional.",
    "rhythm.flat_scene": "(rework: mix lengths, openings, and clause structure)",
    "rhythm.same_opener_run": "(vary sentence openings and structure)",
    "rhythm.shape_run": "(vary sentence openings and structure)",
    "weak.qualifier": "(cut or replace with something concrete)",
    "weak.filter_word": "(cut or replace with something concrete)",
    "weak.tag_adverb": "(cut or replace with something concrete)",
    "guide.banned": "(per the book's style guide)",
    "guide.pet_word": "(per the book's style guide)",
}
#: What a weak word does.
WEAK = {
    "weak.qualifier": "Qualifier “{word}” softens the line.",
    "weak.filter_word": "Filter word “{word}” puts the reader one step back.",
    "weak.tag_adverb": "Adverb “{word}” on a dialogue tag; let the line carry it.",
}


def filled(pattern: str, **values: Column) -> Column:
    """A pattern with its {names} replaced by columns."""
    parts, rest = [], pattern
    while rest:
        head, brace, tail = rest.partition("{")
        if head:
            parts.append(F.lit(head))
        name, _, rest = tail.partition("}") if brace else ("", "", "")
        if name:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def rounded(value: Column, digits: int = 1) -> Column:
    """A number with so many digits, half to even on what the double holds."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def _by_rule(rule: Column, texts: dict[str, str], values: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in texts.items():
        out = F.when(rule == name, filled(pattern, **values)).otherwise(out)
    return out


def message(rule: Column, old: Column, new: Column) -> Column:
    values = {"old": old, "new": new, "mark": F.substring(old, 1, 1)}
    wordy = F.when(F.coalesce(new, F.lit("")) == "", filled(DROP, **values)).otherwise(filled(PREFER, **values))
    return F.when(rule.startswith("word."), wordy).otherwise(_by_rule(rule, MESSAGES, values))


def suggestion(rule: Column, old: Column, new: Column) -> Column:
    """The replacement where there is one; else what the rule asks for, null where it asks for nothing."""
    return F.coalesce(new, _by_rule(rule, SUGGESTIONS, {"mark": F.substring(old, 1, 1)}))
