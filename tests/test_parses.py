"""What is asked of a parser's trees, with trees made by hand and a parser made of a word list."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quillspark.operators import checks, parses, prose, regions
from quillspark.sources.chapters import from_table

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def tree(*tokens):
    """Tokens from (text, pos, tag, dep, head)."""
    out, at = [], 0
    for text, pos, tag, dep, head in tokens:
        out.append({"start": at, "text": text, "lemma": text.lower(), "pos": pos, "tag": tag, "dep": dep, "head": head, "alpha": text.isalpha(), "punct": pos == "PUNCT", "space": False})
        at += len(text) + 1
    return out


def asked(spark, trees, column):
    rows = spark.createDataFrame(list(enumerate(trees)), f"i int, tokens array<{parses.TOKEN}>")
    return [r.v for r in rows.orderBy("i").select(column(F.col("tokens")).alias("v")).collect()]


SAT = tree(("The", "DET", "DT", "det", 1), ("cat", "NOUN", "NN", "nsubj", 2), ("sat", "VERB", "VBD", "ROOT", 2))
#: A noun, as he lifted it.
LIFTED = tree(("chatter", "NOUN", "NN", "ROOT", 0), ("as", "SCONJ", "IN", "mark", 3), ("he", "PRON", "PRP", "nsubj", 3), ("lifted", "VERB", "VBD", "advcl", 0))
HANGING = [("track", "NOUN", "NN", "ROOT", 0), ("skidded", "VERB", "VBN", "acl", 0)]


def chain(steps):
    """A finite verb so many steps below an adverbial clause."""
    return tree(("stone", "NOUN", "NN", "ROOT", 0), ("falling", "VERB", "VBG", "advcl", 0), *((f"x{i}", "NOUN", "NN", "dep", i + 1) for i in range(steps - 1)), ("said", "VERB", "VBD", "ccomp", steps))


@pytest.fixture(scope="module")
def predicates(spark):
    trees = {
        "finite root": SAT, "aside": LIFTED, "helper": tree(("door", "NOUN", "NN", "nsubjpass", 2), ("was", "AUX", "VBD", "auxpass", 2), ("opened", "VERB", "VBN", "ROOT", 2)),
        "participle with a subject": tree(("pop", "NOUN", "NN", "nsubj", 1), ("echoed", "VERB", "VBN", "ROOT", 1)), "hanging": tree(*HANGING),
        "hanging with a mark": tree(*HANGING, ("while", "SCONJ", "IN", "mark", 1)), "imperative": tree(("Go", "VERB", "VB", "ROOT", 0)), "infinitive below": tree(("plan", "NOUN", "NN", "ROOT", 0), ("go", "VERB", "VB", "acl", 0)),
        "relative": tree(("man", "NOUN", "NN", "ROOT", 0), ("who", "PRON", "WP", "nsubj", 2), ("ran", "VERB", "VBD", "relcl", 0)), "below aside": chain(3), "thirty-two below": chain(32), "beyond the walk": chain(33), "nothing": [],
    }
    return dict(zip(trees, asked(spark, list(trees.values()), parses.has_predicate)))


@pytest.mark.parametrize("name, want", [
    ("finite root", True), ("aside", False), ("helper", True), ("participle with a subject", True), ("hanging", True), ("hanging with a mark", False), ("imperative", True), ("infinitive below", False),
    ("relative", False), ("below aside", False), ("thirty-two below", False), ("beyond the walk", True),
])
def test_predicates(predicates, name, want):
    assert bool(predicates[name]) is want


def test_shapes_of_trees(spark):
    late = tree(("The", "DET", "DT", "det", 1), ("cat", "NOUN", "NN", "nsubj", 5), ("a", "X", "X", "advmod", 5), ("b", "X", "X", "advmod", 5), ("c", "X", "X", "advmod", 5), ("sat", "VERB", "VBD", "ROOT", 5))
    led = tree(("Then", "ADV", "RB", "advmod", 2), ("cats", "NOUN", "NNS", "nsubj", 2), ("sat", "VERB", "VBD", "ROOT", 2), ("and", "CCONJ", "CC", "cc", 2), ("ran", "VERB", "VBD", "conj", 2), ("when", "ADV", "WRB", "advmod", 6), ("fed", "VERB", "VBN", "advcl", 4))
    quoted = tree(('"', "PUNCT", "``", "punct", 3), ("The", "DET", "DT", "det", 2), ("cat", "NOUN", "NN", "nsubj", 3), ("sat", "VERB", "VBD", "ROOT", 3))
    trees = [SAT, late, led, quoted, LIFTED, []]
    assert asked(spark, trees, parses.subject_first) == [True, False, False, True, False, False]
    assert asked(spark, trees, parses.clauses) == [1, 1, 3, 1, 2, 1]
    assert asked(spark, trees, parses.opener_kind) == ["subject", "subject", "adverb", "subject", "other", "other"]
    wants = tree(("door", "NOUN", "NN", "nsubj", 1), ("want", "VERB", "VBD", "ROOT", 1), ("rain", "NOUN", "NN", "dobj", 1))
    has = [tree((who, "NOUN", "NN", "nsubj", 1), ("have", "VERB", "VBD", "ROOT", 1), (what, "NOUN", "NN", "dobj", 1)) for who, what in (("door", "opinion"), ("door", "lock"), ("woman", "opinion"))]
    assert asked(spark, [wants, *has, SAT], parses.mind_subject) == [True, True, False, False, False]


def load():
    """Sentences end at stops; verbs are of a list, a word before the verb is its subject, all else hangs on the root; each load leaves a mark."""

    def parse(texts):
        import re

        verbs = {"sat", "ran", "stood", "left", "waited", "want", "was"}
        out = []
        for text in texts:
            if "unreadable" in text:
                raise ValueError
            found = []
            for m in re.finditer(r"[^.!?]+[.!?]*[\"”]*\s*", text):
                words = list(re.finditer(r"\w+|[^\w\s]", m.group()))
                at = next((i for i, w in enumerate(words) if w.group() in verbs), 0)
                found.append((m.start(), m.end(), [{
                    "start": w.start(), "text": w.group(), "lemma": w.group().lower(), "pos": "VERB" if w.group() in verbs else "NOUN" if w.group().isalpha() else "PUNCT", "tag": "VBD" if w.group() in verbs else "NN",
                    "dep": "ROOT" if i == at else "nsubj" if i == at - 1 else "det" if i < at else "dep", "head": at if i >= at - 1 else at - 1, "alpha": w.group().isalpha(), "punct": not w.group().isalpha(), "space": False,
                } for i, w in enumerate(words)]))
            out.append(found)
        return out

    return parse


TEXT = (
    "---\ntitle: a cold rough morning on stone.\n---\nThe cat sat. The dog ran. The man stood. The woman left early today.\n\nA rough chatter of cold stones. Cold stones. \"A rough chatter of cold stones.\" A rough chatter of cold stones...\n\n"
    "The lamp want rain now."
)


def test_rules_with_a_parser(spark):
    c = from_table(spark.createDataFrame([(1, TEXT), (2, "An unreadable text of cold stones. The cat sat.")], "doc_id long, text string"))
    rows = checks.check(c, checks.Config(parser=load), ["echo."]).orderBy("id").collect()
    assert [(r.chapter_number, r.rule_id, r.excerpt, r.message) for r in rows] == [
        (1, "mech.missing_predicate", "A rough chatter of cold stones.", "Main clause may be missing a finite verb (predicate)."),
        (1, "rhythm.same_opener_run", "The cat sat. The dog ran. The man stood. The woman left early today.", "4 sentences in a row start with “the”."),
    ]
    assert TEXT[rows[0].start : rows[0].end].strip() == rows[0].excerpt
    # The run of one shape stands where that of one opener does: of one place and category the first stays.
    laid = parses.with_parses(regions.laid_out(c), load)
    told = regions.sentences(laid)
    assert [(r.start, r.sentences) for r in prose.shape_runs(told).collect()] == [(TEXT.index("The cat"), 4)]
    metrics = prose.scene_metrics(told).filter("chapter_number = 1").first()
    assert metrics.subject_share == 5 / 8 and metrics.multi_share == 0.0 and metrics.narration == 8
    assert [r.pattern for r in prose.hollow_shapes(told).collect()] == ["mind"]
    assert checks.all_hits(laid).filter("chapter_number = 2").count() == 0


def test_without_a_parser_nothing_is_told(spark):
    laid = regions.laid_out(from_table(spark.createDataFrame([(1, TEXT)], "doc_id long, text string")))
    told = regions.sentences(laid)
    assert prose.shape_runs(told).count() == 0 and "subject_share" not in prose.scene_metrics(told).columns and checks.all_hits(laid).filter("rule_id = 'mech.missing_predicate'").count() == 0
