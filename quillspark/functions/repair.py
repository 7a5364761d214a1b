"""What separates a suggestion from the text that it would replace, and whether a program may paste it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

#: Pronouns by family, fixed values.
FAMILIES = [
    ["it", "its", "it's"],
    ["i", "me", "my", "mine", "myself"],
    ["you", "your", "yours", "yourself", "yourselves"],
    ["he", "him", "his", "himself"],
    ["she", "her", "hers", "herself"],
    ["we", "us", "our", "ours", "ourselves"],
    ["they", "them", "their", "theirs", "themself", "themselves"],
]
#: A message that says that a person or gender is guessed, fixed value.
GUESS = r"(?i)pronoun|gender|referring to|instead of ['\"](?:him|her|he|she)\b"
#: A swap that is longer than this on both sides, or that shares nothing with a text longer than LONE, is a rewrite.
SWAP, LONE = 12, 24
WORD = "[A-Za-z']+"


def family(word: Column) -> Column:
    """The number of a pronoun's family, null for other words."""
    known = F.create_map(*(F.lit(x) for i, words in enumerate(FAMILIES) for w in words for x in (w, i)))
    return F.try_element_at(known, F.lower(word))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def families(text: Column) -> Column:
    """The families that a text's words are of, sorted."""
    # Only pronouns are looked up: what is looked up is compared with every key.
    pronouns = F.array_intersect(F.transform(words(text), F.lower), F.array(*(F.lit(w) for of in FAMILIES for w in of)))
    return F.array_sort(F.array_distinct(F.transform(pronouns, family)))


def _alike(a: Column, b: Column) -> Column:
    """How many characters two texts have in common from their starts.

    The first half of what is left is compared as a whole, and what follows goes on in the half where they part: the work is linear, and no
    character is a value of its own."""
    # Null if either text is: least passes over nulls.
    shorter = F.when(a.isNotNull() & b.isNotNull(), F.least(F.length(a), F.length(b)))

    def step(acc: Column, n: Column) -> Column:
        head = lambda x: F.substr(acc[x], F.lit(1), n)
        tail = lambda x: F.substr(acc[x], n + 1)
        state = lambda at, x, y: F.struct(at.alias("at"), x.alias("a"), y.alias("b"))
        long = (F.length(acc["a"]) >= n) & (F.length(acc["b"]) >= n)
        return F.when(long & (head("a") == head("b")), state(acc["at"] + n, tail("a"), tail("b"))).otherwise(state(acc["at"], head("a"), head("b")))

    def found(short: Column) -> Column:
        powers = F.transform(F.sequence(F.length(F.bin(short)) - 1, F.lit(0)), lambda i: F.call_function("shiftleft", F.lit(1), i))
        return F.aggregate(powers, F.struct(F.lit(0).alias("at"), a.alias("a"), b.alias("b")), step, lambda acc: acc["at"])

    return F.when(a == b, F.length(a)).otherwise(let(shorter, found))


def difference(old: Column, new: Column) -> Column:
    """prefix and suffix (the lengths of what is alike at both ends), removed and added (what lies between them)."""

    def cut(prefix: Column) -> Column:
        rest = lambda text: F.reverse(F.substr(text, prefix + 1))
        suffix = let(F.struct(rest(old).alias("old"), rest(new).alias("new")), lambda r: _alike(r["old"], r["new"]))
        middle = lambda text, n: F.substr(text, prefix + 1, F.length(text) - prefix - n)
        return let(suffix, lambda n: F.struct(prefix.alias("prefix"), n.alias("suffix"), middle(old, n).alias("removed"), middle(new, n).alias("added")))

    return let(_alike(old, new), cut)


def _changed(old: Column, new: Column) -> Column:
    return F.coalesce((old != "") & (new != "") & (old != new), F.lit(False))


def is_single_repair(old: Column, new: Column, apart: Column | None = None) -> Column:
    """One insertion, one deletion or one short swap; apart is their difference, where it is known."""

    def short(d: Column) -> Column:
        rewrite = (F.length(d["removed"]) > SWAP) & (F.length(d["added"]) > SWAP)
        return ~rewrite & ~((d["prefix"] + d["suffix"] == 0) & (F.length(old) > LONE))

    return _changed(old, new) & (let(difference(old, new), short) if apart is None else short(apart))


def is_pure_deletion(old: Column, new: Column, apart: Column | None = None) -> Column:
    """Text is removed and no word is new; apart is their difference, where it is known."""
    removed = lambda d: d["removed"].rlike(r"(?U)\S") & (F.size(words(d["added"])) == 0)
    return _changed(old, new) & (let(difference(old, new), removed) if apart is None else removed(apart))


def is_one_word_grammar(old: Column, new: Column) -> Column:
    """An ending added to one word, or one pronoun for another of its family."""

    def tweak(d: Column) -> Column:
        bare = F.size(words(d["removed"])) == 0
        ending = bare & F.lower(d["added"]).isin("s", "'s", "'")
        one = (F.size(words(old)) == 1) & (F.size(words(new)) == 1)
        kin = family(F.get(words(old), F.lit(0))) == family(F.get(words(new), F.lit(0)))
        return ending | (bare & (F.size(words(d["added"])) == 1) & one & F.coalesce(kin, F.lit(False)))

    return _changed(old, new) & let(difference(old, new), tweak)


def is_safe_to_paste(old: Column, new: Column) -> Column:
    return is_pure_deletion(old, new) | is_one_word_grammar(old, new)


def is_pronoun_guess(old: Column, new: Column, message: Column) -> Column:
    """The person or gender is swapped, or the message says so of some suggestion."""
    swapped = families(old) != families(new)
    said = (new != "") & F.coalesce(message, F.lit("")).rlike(GUESS)
    return ~is_one_word_grammar(old, new) & (swapped | said)


def occurs_once(text: Column, excerpt: Column) -> Column:
    return (F.length(excerpt) > 0) & (F.length(text) - F.length(F.replace(text, excerpt, F.lit(""))) == F.length(excerpt))
