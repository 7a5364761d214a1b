"""Personal data: base patterns as seeds, then bootstrapped contextual extraction.

The base patterns find emails, addresses, cards and phone numbers.  Their
matches, and tokens that are secrets by their shape alone, are the seed
instances; the words round them induce lexical patterns.
Spark scores the graph of patterns and instances in turns: a pattern is as
good as the share of its instances that are known to be of a kind, an instance
as good as its patterns together say, until no more is found.  Confident patterns
discover tokens that look like identifiers but that are no seeds.

Defined results: a null text is empty; it has no spans, and base_sha256 is
that of the empty string.  Repeated rows and rows with a null id are searched
one by one.  Spans of one kind never overlap; spans of two kinds may.  A token
with equal confidence for two kinds is of the kind listed first.  Columns
other than id and text are neither read nor returned.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settled, small_join, table

#: The kinds of the base patterns, as listed; secrets are the method's own.
BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
SECRET = KINDS.index("secret")
#: Each takes a whole run at once, so that a long run is read once, whether it has a match or not.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+@?")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"\S+")
#: Shapes of secrets, fixed values: long hexadecimal keys and the prefixes that some services give their keys.
_SECRET = re.compile(r"(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|[rs]k_(?:live|test)_[0-9A-Za-z]{16,}|xox[abpr]-[0-9A-Za-z-]{10,}")
#: What may be discovered: a run without white space that has a digit, an @ or an underscore, or a capital after a small letter.
_ODD = re.compile(r"[0-9@_]|[a-z][A-Z]")
MIN_TOKEN, MAX_TOKEN = 6, 200
_EDGE = "\"'`.,;:!?()[]{}<>*#$%&|="
_WORD = re.compile(r"[^\W\d_]+|[^\w\s]+")

#: Turns end when one finds nothing new; there are so many at most.
ROUNDS = 10
#: A pattern is trusted if it has met so many different known instances, and is at least so good.
MIN_SUPPORT = 3
MIN_PATTERN = 0.6
MIN_INSTANCE = 0.8
CONTEXT_CHARS = 60

OCCURRENCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "base array<struct<kind:int,start:long,end:long>>, found array<struct<start:long,end:long,kind:int,instance:string,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str):
    end = 0
    for m in _LOCAL.finditer(text):
        start = max(m.start(), end)
        if m.end() - 1 > start and text[m.end() - 1] == "@" and (domain := _DOMAIN.match(text, m.end())):
            end = domain.end()
            yield start, end


def _addresses(text: str):
    """Of a chain of numbers with full stops between them, each four in turn."""
    for m in _NUMBERS.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of each base match, ordered."""
    out = []
    if "@" in text:
        out += [(0, *span) for span in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, *span) for span in _addresses(text)]
        for m in CARD.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def context_patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns round a span: the one and two words before it, and the pair of the words on its two sides. Words that the window cuts don't count."""
    low, high = max(0, start - CONTEXT_CHARS), min(len(text), end + CONTEXT_CHARS)
    before = [m.group().lower() for m in _WORD.finditer(text, low, start) if m.start() > low or low == 0][-2:]
    after = [m.group().lower() for m in _WORD.finditer(text, end, high) if m.end() < high or high == len(text)][:1]
    out = []
    if before:
        out.append(f"1 {before[-1]}")
    if len(before) == 2:
        out.append(f"2 {before[0]} {before[1]}")
    if before and after:
        out.append(f"3 {before[-1]} _ {after[0]}")
    return out


def occurrences(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str, list[str]]]:
    """Seeds (with their kind) and tokens that may be discovered (kind -1); tokens of more than MAX_TOKEN characters are neither."""
    out = [(s, e, k, text[s:e].lower(), context_patterns(text, s, e)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    starts = np.array([s for s, _ in taken])
    reach = np.maximum.accumulate(np.array([e for _, e in taken])) if taken else starts
    for m in _RUN.finditer(text):
        token = m.group()
        if not _ODD.search(token):
            continue
        bare = token.strip(_EDGE)
        s = m.start() + token.find(bare)
        e = s + len(bare)
        if not MIN_TOKEN <= e - s <= MAX_TOKEN or not _ODD.search(bare):
            continue
        before = np.searchsorted(starts, e) - 1
        if before >= 0 and reach[before] > s:
            continue
        out.append((s, e, SECRET if _SECRET.fullmatch(bare) else -1, bare.lower(), context_patterns(text, s, e)))
    return out


def _scan(batches):
    for batch in batches:
        base_rows, found_rows = [], []
        for text in batch.column(2).to_pylist():
            base = base_spans(text) if text else []
            base_rows.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            found_rows.append([dict(zip(("start", "end", "kind", "instance", "patterns"), x)) for x in occurrences(text, base)] if text else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(base_rows, pa.list_(SPAN)), pa.array(found_rows, pa.list_(OCCURRENCE))],
            names=[*batch.schema.names[:2], "base", "found"],
        )


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """edges: pattern, instance, kind (-1: not known). Returns the instances discovered: instance, kind, confidence.

    Every turn re-estimates patterns from instances and instances from patterns; seeds keep confidence 1."""
    edges = settled(edges.distinct())
    seeds = edges.filter("kind >= 0").select("instance", "kind").distinct().withColumn("confidence", F.lit(1.0))
    unknown = edges.filter("kind < 0").select("pattern", "instance").distinct()
    totals = edges.groupBy("pattern").agg(F.countDistinct("instance").alias("total"))
    known, last = seeds, 0
    for _ in range(rounds):
        # A pattern that has met no seed can't gain trust; the first join drops it.
        good = settled(
            edges.select("pattern", "instance").distinct().join(known, "instance")
            .groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"), F.count("*").alias("support"))
            .filter(F.col("support") >= MIN_SUPPORT)
            .join(totals, "pattern")
            .withColumn("quality", F.col("mass") / (F.col("total") + 0.5))
            .filter(F.col("quality") >= MIN_PATTERN).select("pattern", "kind", "quality")
        )
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("quality"), F.lit(1e-6)))))
        found = settled(small_join(unknown, good, ["pattern"], "inner").groupBy("instance", "kind").agg((1 - doubt).alias("confidence")))
        known = seeds.unionByName(found.join(seeds.select("instance"), "instance", "left_anti"))
        sure = found.filter(F.col("confidence") >= MIN_INSTANCE).count()
        if sure == last:
            break
        last = sure
    best = found.filter(F.col("confidence") >= MIN_INSTANCE).groupBy("instance").agg(F.max(F.struct("confidence", (-F.col("kind")).alias("k"))).alias("b"))
    return best.select("instance", (-F.col("b.k")).alias("kind"), F.col("b.confidence").alias("confidence"))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def extract(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the id, base (array of kind, start, end), and discovered: the same, of secrets by shape and of the spans that only context tells."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(text))
    scanned = settled(rows.mapInArrow(_scan, f"__row long, __key {kind}, {SCHEMA}"))
    seen = scanned.select("__row", F.explode("found").alias("o")).select("__row", "o.*")
    edges = seen.select("instance", "kind", F.explode("patterns").alias("pattern"))
    new = settled(score_graph(edges).select("instance", "kind"))
    spans = (
        small_join(seen.filter("kind < 0").drop("kind"), new, ["instance"], "inner").select("__row", "kind", "start", "end")
        .unionByName(seen.filter(F.col("kind") == SECRET).select("__row", "kind", "start", "end"))
        .groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("discovered"))
    )
    none = F.expr("array()").cast("array<struct<kind:int,start:bigint,end:bigint>>")
    return scanned.join(spans, "__row", "left").select(F.col("__key").alias(key), "base", F.coalesce("discovered", none).alias("discovered"))


def _is(kind: int):
    return lambda x: x["kind"] == kind


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _is(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE_KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.sort_array("base")).cast("binary"), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "discovered"))).alias("spans"),
        F.size("discovered").cast("long").alias("n_discovered"),
    )
