"""The cast of a book: names, pronouns, and what contradicts them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.repair import families, family, is_pronoun_guess, is_safe_to_paste, occurs_once
from ..functions.tables import written
from ..functions.text import between, strip
from .findings import of_hits, with_ids
from .messages import filled

#: The families that files are held to, what contradicts each, and first names that are ordinary words.
HE, SHE = 3, 4
PRONOUNS_AGAINST = {HE: r"(?i)\b(she|her|hers|herself)\b", SHE: r"(?i)\b(he|him|his|himself)\b"}
NOUNS_AGAINST = {HE: ["girl", "woman", "lady", "lass"], SHE: ["boy", "man", "lad"]}
SHORT_WORDS = ["an", "or", "of", "to", "in", "on", "at"]
#: Fixed patterns of J9: what stands before a gendered noun, and the verbs that tie it to a name.
DETERMINER = r"\b(?:the|a|an|that|this)"
ADJECTIVES = r"(?:[A-Za-z'-]+\s+){0,2}"
LINKS = r"(?:is|was|became|seemed|looked\s+like|remained)"

PROSE_FIELDS = ["backstory", "arc_summary", "dialogue_voice", "physical_description"]
LIST_FIELDS = ["history", "voice_wildcards"]


def members(cast: DataFrame) -> DataFrame:
    """cast: name, pronouns.  Each with its family (null if the label names none) and tokens: the name, and its first and last word where no one else has it.

    First names of a letter or that are ordinary words, and last names of fewer than four letters, are no tokens."""
    parts = F.filter(F.split("name", r"\s+", -1), lambda p: p != "")
    rows = cast.select("name", "pronouns", parts.alias("parts")).withColumns({
        "first": F.get("parts", F.lit(0)), "last": F.when(F.size("parts") > 1, F.try_element_at("parts", F.lit(-1))), "family": family(strip(F.get(F.split("pronouns", "/", -1), F.lit(0)))),
    })
    firsts = rows.filter("first is not null").groupBy(F.lower("first").alias("f")).agg(F.count("*").alias("same_first"))
    lasts = rows.filter("last is not null").groupBy(F.lower("last").alias("l")).agg(F.count("*").alias("same_last"))
    counted = rows.join(firsts, F.lower("first") == F.col("f"), "left").join(lasts, F.lower("last") == F.col("l"), "left")
    first = F.when((F.col("same_first") == 1) & (F.length("first") >= 2) & ~F.lower("first").isin(SHORT_WORDS), F.col("first"))
    last = F.when((F.col("same_last") == 1) & (F.length("last") >= 4), F.col("last"))
    return counted.select("name", "pronouns", "family", F.array_compact(F.array("name", first, last)).alias("tokens"))


def _quoted(token: Column) -> Column:
    return F.concat(F.lit(r"\Q"), F.replace(token, F.lit(r"\E"), F.lit("")), F.lit(r"\E"))


def patterns(cast_members: DataFrame) -> DataFrame:
    """name, pronouns, family, tokens, named (a pattern of the tokens)."""
    any_token = F.concat(F.lit("(?:"), F.array_join(F.transform("tokens", _quoted), "|"), F.lit(")"))
    return cast_members.select("name", "pronouns", "family", "tokens", F.concat(F.lit(r"(?iU)(?<!\w)"), any_token, F.lit(r"(?!\w)")).alias("named"))


def plain_sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+", -1), strip), lambda s: s != "")


def _tied_to(token: Column, noun: Column) -> list[Column]:
    """The patterns of nouns (their first group) that describe the bearer of a token: two kinds of apposition and a link verb."""
    said = F.concat(F.lit(DETERMINER + r"\s+" + ADJECTIVES + r"\b("), noun, F.lit(")"))
    name, head = _quoted(token), F.lit("(?iU)")
    return [
        F.concat(head, F.lit(r"\b"), name, F.lit(r"(?:'s)?\s*,\s*"), said, F.lit(r"\b")),
        F.concat(head, F.lit(r"\b"), name, F.lit(rf"\s+{LINKS}\s+"), said, F.lit(r"\b")),
        F.concat(head, said, F.lit(r"\s*,?\s+"), name, F.lit(r"\b")),
    ]


def _keys(text: Column) -> Column:
    """The words of a text in lower case, each once, by which names are looked up."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), F.lower))


def asked_for(text: Column) -> Column:
    """The keys by which a text is looked up among names; the empty one stands for names without a word."""
    return F.concat(_keys(text), F.array(F.lit("")))


def known_by(tokens: Column | str) -> Column:
    """The keys under which someone's tokens are known: their first words."""
    return F.array_distinct(F.transform(tokens, lambda t: F.coalesce(F.get(_keys(t), F.lit(0)), F.lit(""))))


def tied_sentences(chapters: DataFrame, cast: DataFrame) -> DataFrame:
    """Sentences that tie a gendered noun to someone of the other family, each once a chapter: chapter_number, k (the sentence's number), name, pronouns, sentence, nouns (that do so, in lower case, each once).

    A sentence with such a noun at all is looked up by its words among the first words of the members' tokens, an
    equal join whatever the size of the cast; only then patterns are tried.  Tokens without a word are met by every sentence."""
    nouns = "|".join(re.escape(n) for nouns in NOUNS_AGAINST.values() for n in nouns)
    told = chapters.select("chapter_number", F.posexplode(plain_sentences(F.col("content"))).alias("k", "sentence")).filter(F.col("sentence").rlike(rf"(?iU)\b(?:{nouns})\b"))
    once = told.groupBy("chapter_number", "sentence").agg(F.min("k").alias("k"))
    words = once.withColumn("key", F.explode(asked_for(F.col("sentence"))))
    noun = F.coalesce(*(F.when(F.col("family") == number, "|".join(nouns)) for number, nouns in NOUNS_AGAINST.items()))
    people = members(cast).withColumn("noun", noun).filter("noun is not null")
    known = people.withColumn("key", F.explode(known_by("tokens")))
    met = words.join(known, "key").select("chapter_number", "k", "sentence", "name", "pronouns", "tokens", "noun").distinct()
    found = F.flatten(F.transform("tokens", lambda t: F.flatten(F.array(*(F.regexp_extract_all("sentence", p, F.lit(1)) for p in _tied_to(t, F.col("noun")))))))
    rows = met.withColumn("nouns", F.array_distinct(F.transform(found, F.lower)))
    return rows.filter(F.size("nouns") > 0).select("chapter_number", "k", "name", "pronouns", "sentence", "nouns")


def pronoun_clashes(chapters: DataFrame, cast: DataFrame) -> DataFrame:
    """chapter_number, name, sentence of the sentences that contradict someone's pronouns; each once a chapter."""
    return tied_sentences(chapters, cast).select("chapter_number", "name", "sentence")


#: What a finding of the cast says, fixed value.
CLASH = "{name} is {pronouns} in the character file, but this sentence also says {nouns}."


def pronoun_hits(chapters: DataFrame, cast: DataFrame, order: int) -> DataFrame:
    """pronoun_clashes as hits without a place: sentence by sentence, then in the order of the names."""
    rows = tied_sentences(chapters, cast)
    note = filled(CLASH, name=F.col("name"), pronouns=F.col("pronouns"), nouns=F.array_join("nouns", ", "))
    shown = F.when(F.length("sentence") > 280, F.concat(F.substring("sentence", 1, 279), F.lit("…"))).otherwise(F.col("sentence"))
    none = F.lit(None)
    return rows.select(
        "chapter_number", F.lit(order).alias("rule_ord"), F.lit("canon.pronoun_prose").alias("rule_id"), none.cast("long").alias("start"), none.cast("long").alias("end"), shown.alias("text"),
        none.cast("string").alias("replacement"), F.col("k").cast("int").alias("turn"), note.alias("note"),
    )


def file_clashes(cast: DataFrame) -> DataFrame:
    """Character files that contradict their own pronouns line: name, pronouns, sentence (the first such, of 220 characters at most), clashing (its first four words against)."""
    texts = [F.array(strip(F.col(c))) for c in PROSE_FIELDS if c in cast.columns] + [F.transform(F.col(c), strip) for c in LIST_FIELDS if c in cast.columns]
    if "voice_observations" in cast.columns:
        texts.append(F.transform("voice_observations", lambda x: strip(x["note"])))
    chunks = F.filter(F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in texts)), lambda x: F.coalesce(x, F.lit("")) != "")
    number = family(strip(F.get(F.split("pronouns", "/", -1), F.lit(0))))
    against = lambda s: F.coalesce(*(F.when(F.col("__f") == k, F.concat(F.regexp_extract_all(s, F.lit(PRONOUNS_AGAINST[k]), F.lit(0)), F.regexp_extract_all(s, F.lit(rf"(?i)\b({'|'.join(NOUNS_AGAINST[k])})\b"), F.lit(0)))) for k in PRONOUNS_AGAINST))
    rows = cast.filter(F.trim("name") != "").withColumn("__f", number).filter(F.col("__f").isin(*PRONOUNS_AGAINST))
    first = F.get(F.filter(plain_sentences(F.array_join(chunks, "\n")), lambda s: F.size(against(s)) > 0), F.lit(0))
    found = rows.select("name", "pronouns", "__f", first.alias("sentence")).filter("sentence is not null")
    shown = F.when(F.length("sentence") > 220, F.concat(F.regexp_replace(F.substring("sentence", 1, 219), r"\s+$", ""), F.lit("…"))).otherwise(F.col("sentence"))
    return found.select("name", "pronouns", shown.alias("sentence"), F.slice(against(F.col("sentence")), 1, 4).alias("clashing"))


#: What a finding of a character file says, fixed value.
FILE_CLASH = "{name}'s character file says {pronouns}, but the file also uses {words}."


def file_findings(cast: DataFrame) -> DataFrame:
    """file_clashes as findings of chapter 0, numbered in the order of the files' names; they come before those of chapters."""
    rows = file_clashes(cast)
    note = filled(FILE_CLASH, name=F.col("name"), pronouns=F.col("pronouns"), words=F.array_join("clashing", ", "))
    none = F.lit(None)
    hits = rows.select(
        F.lit(0).cast("long").alias("chapter_number"), F.lit(0).alias("rule_ord"), F.lit("canon.pronoun_file").alias("rule_id"), none.cast("long").alias("start"), none.cast("long").alias("end"),
        F.col("sentence").alias("text"), none.cast("string").alias("replacement"), note.alias("note"),
    )
    return with_ids(of_hits(hits))


def garbled_by_cast(findings: DataFrame, cast: DataFrame | None) -> DataFrame:
    """findings of garbled text (excerpt, replacement, message) that the cast lets pass; a pronoun note that does is never pasted.

    Without a cast a guess of person or gender goes.  With one, a note goes that
    erases a name, and a guess stays only if the text names one member and the
    new pronoun is of that member's family, which the old text had none of."""
    said = [F.nullif(F.col(c), F.lit("")) for c in ("suggestion", "replacement") if c in findings.columns]
    old, new = F.coalesce("excerpt", F.lit("")), strip(F.coalesce(*said, F.lit("")))
    guess = is_pronoun_guess(old, new, F.col("message"))
    if cast is None:
        return findings.filter((F.col("rule_id") != "llm.garbled") | ~guess)
    # Rows are numbered in a table, so that what is said of each finds it; texts meet names by their words, whatever the size of the cast.
    rows = written(findings.withColumn("__row", F.monotonically_increasing_id()))
    garbled = F.col("rule_id") == "llm.garbled"
    asked = rows.filter(garbled).select("__row", old.alias("old"), new.alias("new")).withColumn("key", F.explode(asked_for(F.col("old"))))
    known = patterns(members(cast)).withColumn("key", F.explode(known_by("tokens"))).select("key", "name", "family", "named")
    named = asked.join(known, "key").filter(F.regexp_like("old", F.col("named"))).dropDuplicates(["__row", "name"])
    erased = F.max((F.col("new") != "") & ~F.regexp_like("new", F.col("named")))
    told = named.groupBy("__row").agg(F.count("*").alias("__n"), F.max("family").alias("__family"), erased.alias("__erased"))
    met = rows.join(told, "__row", "left").withColumn("__guess", garbled & guess)
    owned = (F.col("__n") == 1) & F.array_contains(families(new), F.col("__family")) & ~F.array_contains(families(old), F.col("__family"))
    kept = met.filter(~garbled | (~F.coalesce("__erased", F.lit(False)) & (~F.col("__guess") | F.coalesce(owned, F.lit(False)))))
    armed = F.when(F.col("__guess"), F.lit(False)).otherwise(F.col("applyable"))
    pasted = F.when(F.col("__guess"), F.lit(None).cast("string")).otherwise(F.col("replacement"))
    return kept.withColumns({"applyable": armed, "replacement": pasted}).select(*findings.columns)


def mark_safe_repairs(findings: DataFrame, chapters: DataFrame) -> DataFrame:
    """findings whose suggestion is pasted only if the excerpt stands in its place, once in the chapter, and the change is safe."""
    own = chapters.select("chapter_number", F.col("content").alias("__content"))
    new = strip(F.coalesce("suggestion", F.lit("")))
    anchored = F.coalesce(between(F.col("__content"), F.struct("start", "end")) == F.col("excerpt"), F.lit(False))
    safe = anchored & occurs_once(F.col("__content"), F.col("excerpt")) & is_safe_to_paste(F.col("excerpt"), new)
    rows = findings.join(own, "chapter_number", "left").withColumn("__safe", F.coalesce(safe, F.lit(False)))
    return rows.withColumns({"applyable": F.col("__safe"), "replacement": F.when(F.col("__safe"), new)}).drop("__content", "__safe")
