"""Sentences and shapes from a linguistic parser that a caller brings.

A parser is loaded once in each Python worker and is given the texts of a batch
together; what it says of a text is sentences with tokens, as arrays in the
chapter's own row.  All that is asked of the trees is column expressions on
these arrays: the head of each token is its place in the sentence, and a walk up
a tree is a few doublings of the heads.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..functions.tables import written
from ..functions.text import let, meets_any, starts_in_any, strip
from . import regions

TOKEN = "struct<start:int,text:string,lemma:string,pos:string,tag:string,dep:string,head:int,alpha:boolean,punct:boolean,space:boolean>"
SENTENCE = f"struct<start:bigint,end:bigint,text:string,tokens:array<{TOKEN}>>"
#: A parser: texts to, for each, its sentences as (start, end, tokens); a token is a dict of TOKEN, start and head counted within the sentence's text and tokens.
Parser = Callable[[list[str]], "list[list[tuple[int, int, list[dict]]]]"]

#: Penn tags and dependencies that tell a predicate.
FINITE, CLEAR, PAST_LIKE = ["VBZ", "VBD", "VBP", "MD", "VB"], ["VBZ", "VBD", "VBP", "MD"], ["VBD", "VBN", "VBZ", "VBP"]
HELPERS, SUBJECTS, ASIDE = ["aux", "auxpass", "cop"], ["nsubj", "nsubjpass"], ["advcl", "relcl"]
OPENING_SUBJECTS, CLAUSES = ["nsubj", "nsubjpass", "expl", "csubj"], ["advcl", "ccomp", "relcl", "acl", "csubj"]
#: Fixed patterns: how a sentence ends that is looked at, and what is left of a quote.
PERIOD, ELLIPSIS, QUOTE_JUNK = r"""\.["'”’)\]]*$""", r"(?:\.\.\.|…)\s*$", r"""^["'“”]+$"""
#: Verbs of mind, what may be had, and who may.
MIND_VERBS = [
    "decide", "want", "know", "refuse", "consider", "remember", "forgive", "agree", "insist", "wait", "listen", "watch", "believe", "hope", "care", "mind", "prefer",
    "expect", "trust", "doubt", "admit", "pretend", "judge", "forget", "notice", "wonder", "intend", "hesitate", "argue", "accept", "ask", "answer", "have",
]
HAVE_OBJECTS = ["opinion", "manner", "patience", "memory", "mood", "temper", "sense", "appetite", "intention", "idea", "conscience", "preference"]
PEOPLE = [
    "man", "woman", "people", "person", "crew", "girl", "boy", "child", "mother", "father", "officer", "captain", "guard", "pilot", "delegate", "sergeant", "clerk",
    "soldier", "doctor", "stranger", "friend", "dog", "wolf", "horse", "cat", "bird",
]
#: A walk up a tree ends after so many steps (a power of two); a subject's verb follows within so many tokens.
STEPS, SUBJECT_GAP = 32, 3

_loaded: dict[tuple[str, str], Parser] = {}


def _parser(load: Callable[[], Parser]) -> Parser:
    """One for each Python worker."""
    key = (load.__module__, load.__qualname__)
    if key not in _loaded:
        _loaded[key] = load()
    return _loaded[key]


def _parsed(parser: Parser, texts: list[str]) -> list[list | None]:
    """What the parser says of each text; None of one that it can't parse, which costs the others nothing."""
    try:
        return list(parser(texts))
    except Exception:  # noqa: BLE001  a parser is a guest
        if len(texts) == 1:
            return [None]
        return [_parsed(parser, [t])[0] for t in texts]


def _rows(batches, load, kinds):
    parser = _parser(load)
    for batch in batches:
        contents, paras = batch.column("content").to_pylist(), batch.column("paras").to_pylist()
        parts = [(i, p["start"], c[p["start"] : p["end"]]) for i, (c, spans) in enumerate(zip(contents, paras)) for p in spans]
        told, whole = [[] for _ in contents], []
        for (i, base, text), found in zip(parts, _parsed(parser, [t for _, _, t in parts])):
            told[i] += [_sentence(text, base, *s) for s in found or []]
        for text, found in zip(contents, _parsed(parser, contents)):
            whole.append([_sentence(text, 0, *s) for s in found or []])
        kept = [batch.column(c) for c in batch.schema.names if c != "paras"]
        names = [c for c in batch.schema.names if c != "paras"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array([[s for s in x if s["text"].strip()] for x in told], type=kinds), pa.array(whole, type=kinds)], names=[*names, "parsed", "whole"])


def _sentence(text: str, base: int, start: int, end: int, tokens: list[dict]) -> dict:
    return {"start": base + start, "end": base + end, "text": text[start:end], "tokens": tokens}


def with_parses(laid: DataFrame, load: Callable[[], Parser]) -> DataFrame:
    """Chapters that are laid out with parsed (the sentences of their paragraphs, each parsed by itself) and whole (those of the chapter as one text). A table: parsing is dear."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = laid.withColumn("paras", F.transform(regions.paragraph_spans(F.col("content"), F.col("skip")), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"))))
    kind = _parse_datatype_string(f"array<{SENTENCE}>")
    schema = StructType(laid.schema.fields).add("parsed", kind).add("whole", kind)
    out = written(rows.mapInArrow(partial(_rows, load=load, kinds=to_arrow_type(kind)), schema))
    # A sentence is what is left of it without the white space round it.
    lead = lambda s: F.length(F.regexp_extract(s["text"], r"^\s*", 0))

    def bare(s: Column) -> Column:
        return let(strip(s["text"]), lambda t: F.struct((s["start"] + lead(s)).alias("start"), (s["start"] + lead(s) + F.length(t)).alias("end"), t.alias("text"), s["tokens"].alias("tokens")))

    return out.withColumn("parsed", F.transform("parsed", bare))


def _heads(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t["head"])


def _reached(marked: Column, heads: Column, steps: int) -> Column:
    """For each token whether one that is marked stands up to so many steps (a power of two) above it."""
    at = lambda array, i: F.coalesce(F.get(array, i), F.lit(False))
    state = F.struct(F.transform(heads, lambda h: at(marked, h)).alias("met"), heads.alias("jump"))
    while steps > 1:
        # Names are bound in each step, so that nothing is computed twice.
        state = let(state, lambda s: F.struct(
            F.zip_with(s["met"], s["jump"], lambda m, j: m | at(s["met"], j)).alias("met"), F.transform(s["jump"], lambda j: F.coalesce(F.get(s["jump"], j), j)).alias("jump")
        ))
        steps //= 2
    return state["met"]


def _of(value: Column, words: list[str]) -> Column:
    return F.coalesce(value.isin(words), F.lit(False))


def _verb(t: Column) -> Column:
    return _of(t["pos"], ["VERB", "AUX"])


def _root_at(tokens: Column) -> Column:
    """The place of the token that is its own head."""
    return F.get(F.filter(F.transform(tokens, lambda t, i: F.when(t["head"] == i, i)), lambda i: i.isNotNull()), F.lit(0))


def _children(tokens: Column, at: Column) -> Column:
    return F.filter(tokens, lambda t, i: (t["head"] == at) & (i != at))


def has_predicate(tokens: Column) -> Column:
    """Whether a sentence's main clause has a finite verb.

    The root is finite or has a finite helper; or some clear finite verb stands outside adverbial and relative clauses; or a
    participle has a subject of its own, or hangs on a nominal root without a mark: what parsers often take past tenses for."""
    finite = lambda t: _verb(t) & _of(t["tag"], FINITE)

    def told(root: Column) -> Column:
        r = F.get(tokens, root)
        own = finite(r) | F.exists(_children(tokens, root), lambda c: _of(c["dep"], HELPERS) & finite(c))
        aside = F.transform(tokens, lambda t: _of(t["dep"], ASIDE))
        off = let(aside, lambda a: F.zip_with(a, _reached(a, _heads(tokens), STEPS), lambda x, y: x | y))
        clear = lambda t: _of(t["tag"], CLEAR) & _verb(t)
        subject = lambda i: F.exists(_children(tokens, i), lambda c: _of(c["dep"], SUBJECTS))
        # Most sentences end here: the dear walk is for the others.
        other = let(off, lambda o: F.exists(F.transform(tokens, lambda t, i: ~F.get(o, i) & (clear(t) | (_of(t["pos"], ["VERB"]) & _of(t["tag"], ["VBN"]) & subject(i)))), lambda x: x))
        hung = F.exists(F.transform(tokens, lambda t, i: (t["head"] == root) & (i != root) & _of(t["dep"], ["acl"]) & _of(t["tag"], PAST_LIKE) & ~F.exists(_children(tokens, i), lambda c: _of(c["dep"], ["mark"]))), lambda x: x)
        return F.when(own, True).when(other, True).otherwise(_of(r["pos"], ["NOUN", "PROPN"]) & hung)

    return let(_root_at(tokens), told)


def missing_predicates(parsed: DataFrame, min_tokens: int = 5, skip_dialogue: bool = True, require_period: bool = True) -> DataFrame:
    """Sentences without a finite verb: chapter_number, start, end, text (stripped), root_text, root_pos, root_tag.

    Passed over: what isn't prose, short sentences, those of which four fifths are quoted, trailing ellipses, those without a period, and leftovers of quotes."""
    rows = parsed.select("chapter_number", "skip", "quotes", F.inline("whole"))
    rows = rows.withColumns({"text": strip(F.col("text")), "alpha": F.size(F.filter("tokens", lambda t: F.coalesce(t["alpha"], F.lit(False))))})
    span = F.struct("start", "end")
    inside = F.size(F.filter("tokens", lambda t: starts_in_any(F.struct((F.col("start") + t["start"]).alias("start")), F.col("quotes"))))
    period = F.col("text").rlike(PERIOD)
    soft = F.col("text").rlike(ELLIPSIS) & (~period | (F.col("alpha") < 12))
    kept = ~meets_any(span, F.col("skip")) & (F.col("text") != "") & (F.col("alpha") >= min_tokens) & ~soft & ~F.col("text").rlike(QUOTE_JUNK)
    if skip_dialogue:
        kept = kept & (inside < 0.8 * F.size("tokens"))
    if require_period:
        kept = kept & period
    found = rows.filter(kept).filter(~F.coalesce(has_predicate(F.col("tokens")), F.lit(False)))
    root = F.get("tokens", _root_at(F.col("tokens")))
    return found.withColumn("root", root).select("chapter_number", "start", "end", "text", *(F.col(f"root.{c}").alias(f"root_{c}") for c in ("text", "pos", "tag")))


def subject_first(tokens: Column) -> Column:
    """Whether a sentence opens with its subject and the main verb follows close."""

    def told(root: Column) -> Column:
        r = F.get(tokens, root)
        subjects = F.filter(F.transform(tokens, lambda t, i: F.when((t["head"] == root) & (i != root) & _of(t["dep"], OPENING_SUBJECTS), i)), lambda i: i.isNotNull())
        words = F.filter(F.transform(tokens, lambda t, i: F.when(~F.coalesce(t["punct"], F.lit(False)) & ~F.coalesce(t["space"], F.lit(False)), i)), lambda i: i.isNotNull())

        def close(subject: Column) -> Column:
            own = F.transform(tokens, lambda t, i: i == subject)
            under = F.zip_with(own, _reached(own, _heads(tokens), 2 * STEPS), lambda a, b: a | b)
            edges = F.filter(F.transform(under, lambda u, i: F.when(u, i)), lambda i: i.isNotNull())
            return let(edges, lambda e: (F.array_min(e) == F.get(words, F.lit(0))) & (root - F.array_max(e)).between(0, SUBJECT_GAP))

        return F.when(_verb(r) & (F.size(subjects) > 0), let(F.get(subjects, F.lit(0)), close)).otherwise(F.lit(False))

    return F.coalesce(let(_root_at(tokens), told), F.lit(False))


def clauses(tokens: Column) -> Column:
    return 1 + F.size(F.filter(tokens, lambda t: _of(t["dep"], CLAUSES) | (_of(t["dep"], ["conj"]) & _verb(t))))


def opener_kind(tokens: Column) -> Column:
    """What a sentence opens with: subject, adverb, preposition, verb, subordinate, conjunction or other."""
    first = F.get(F.filter(tokens, lambda t: ~F.coalesce(t["punct"], F.lit(False)) & ~F.coalesce(t["space"], F.lit(False))), F.lit(0))

    def kind(t: Column) -> Column:
        above = F.get(tokens, t["head"])
        return (
            F.when(_of(t["dep"], OPENING_SUBJECTS) | _of(above["dep"], OPENING_SUBJECTS), "subject").when(t["pos"] == "ADV", "adverb").when((t["pos"] == "ADP") | (t["dep"] == "prep"), "preposition")
            .when(_verb(t), "verb").when((t["pos"] == "SCONJ") | (t["dep"] == "mark"), "subordinate").when(t["pos"] == "CCONJ", "conjunction").otherwise("other")
        )

    return F.coalesce(let(first, kind), F.lit("other"))


def mind_subject(tokens: Column) -> Column:
    """Whether a thing decides, wants or knows: a verb of mind with a noun that is nobody as its subject; to have counts with an opinion and its like."""

    def told(root: Column) -> Column:
        r, children = F.get(tokens, root), _children(tokens, root)
        thing = F.exists(children, lambda c: (c["dep"] == "nsubj") & (c["pos"] == "NOUN") & ~_of(F.lower(c["lemma"]), PEOPLE))
        had = F.get(F.filter(children, lambda c: c["dep"] == "dobj"), F.lit(0))
        return _of(r["lemma"], MIND_VERBS) & thing & ((r["lemma"] != "have") | _of(F.lower(had["lemma"]), HAVE_OBJECTS))

    return F.coalesce(let(_root_at(tokens), told), F.lit(False))
