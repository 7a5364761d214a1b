"""Spelling variants: words one edit apart, grouped under their frequent forms.

Words are near if they differ by one inserted, deleted or replaced character.
Such an edit leaves one half of a word intact, so that near words stand in one
block of the forward dictionary (words that begin alike) or of the reversed one
(words that end alike).  A block is named by the length of the shorter word
(each word takes part for its own length, and as the longer one for the length
below) and by the half that is shared.

A block with too many words is subdivided by the same argument: of the part
that isn't known to be shared, an edit again leaves one half intact, the first
(more of the beginning is shared) or the second (more of the end is).  When one
character is left, a block can't be larger than the alphabet allows.  Every
pair stands in one block at least, and only the first block that it can stand
in reports it, so that no pair is met twice and none is lost.

Blocks are runs of rows sorted by their names; within a run, words are compared
with what follows them, many runs at once, and only pairs that are verified
leave the task.  A word's form is its near word with the most occurrences if it has at
least ``factor`` times its own; forms are followed to the last, the root, by
pointer jumping: occurrences grow with each step, so that few rounds do.

Defined results: a null or empty text has no words; a null id counts as an
empty one where ids decide what is altered; repeated rows count each time.
Extra columns are neither read nor returned.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crcsql
from .common import discard, settled, small_batches, small_join, table

#: Runs of letters are words.
LETTERS = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, FACTOR = 5, 3, 2
#: One word in so many loses a character.
ALTERED = 97
#: Blocks of more words are subdivided.
CROWD = 256
CAPITALS = "".join(map(chr, range(ord("A"), ord("Z") + 1)))
#: Comparisons of characters that are held at a time.
CELLS = 4_000_000


def lower_ascii(word: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, CAPITALS, CAPITALS.lower()))


def altered(key: Column, word: Column, one_in: int = ALTERED) -> Column:
    """The word, less one character if the crc32 of "<key>:<word>" is divisible by one_in."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word)).cast("int")
    return F.when(F.pmod(h, F.lit(one_in)) == 0, F.concat(F.substring(word, F.lit(1), at), F.substr(word, at + 2))).otherwise(word)


def dictionary(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, one_in: int = ALTERED) -> DataFrame:
    """word, n: the distinct words of at least min_chars characters with at least min_count occurrences."""
    runs = docs.select(F.col(key).alias("key"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.select(altered(F.col("key"), lower_ascii(F.col("run")), one_in).alias("word"))
    return words.filter(F.char_length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """The two blocks of each row, each with half of what wasn't known to be shared.

    rows: word, n, size (of the shorter words), head, tail (characters shared at the beginning and at the end), under
    (pairs that share so many at the beginning are met elsewhere)."""
    half = F.floor((F.col("size") - F.col("head") - F.col("tail")) / 2).cast("int")
    more = F.col("head") + half
    first = F.struct(more.alias("head"), F.col("tail").alias("tail"), F.col("under").alias("under"))
    second = F.struct(F.col("head").alias("head"), (F.col("size") - more).alias("tail"), F.least("under", more).alias("under"))
    cut = rows.select("word", "n", "size", F.explode(F.array(first, second)).alias("b")).select("word", "n", "size", "b.*")
    named = F.xxhash64("size", "head", "tail", F.substring(F.col("word"), F.lit(1), F.col("head")), F.right(F.col("word"), F.col("tail")))
    return cut.withColumn("block", named)


def blocks_of(words: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, list[DataFrame]]:
    """words (word, n) in blocks: block, word, n, size, under; near words stand in one. Also the tables that it reads."""
    length = F.char_length("word")
    sizes = F.explode(F.array(length, length - 1))
    none = F.lit(0)
    rows = settled(_halves(words.select("word", "n", sizes.alias("size"), none.alias("head"), none.alias("tail"), F.lit(1 << 30).alias("under"))))
    ready, tables = None, [rows]
    while True:
        # A block in which one character isn't shared is as small as the alphabet makes it.
        open_ = rows.filter(F.col("size") - F.col("head") - F.col("tail") > 1)
        crowded = settled(open_.groupBy("block").count().filter(F.col("count") > crowd).select("block"))
        done = small_join(rows, crowded, ["block"], "left_anti").select("block", "word", "n", "size", "under")
        ready = done if ready is None else ready.unionByName(done)
        tables.append(crowded)
        if crowded.isEmpty():
            return ready, tables
        rows = settled(_halves(small_join(rows, crowded, ["block"], "left_semi")))
        tables.append(rows)


def _codes(words: list[str], width: int) -> np.ndarray:
    """A row of characters for each word, filled up with zeros."""
    out = np.zeros((len(words), width), dtype=np.uint32)
    lens = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    out[np.repeat(np.arange(len(words)), lens), np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)] = flat
    return out


def near(short: np.ndarray, long: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word of ``short`` (rows of characters) is one edit from that of ``long``, which has as many characters (same) or one more; and how many they share at the beginning."""
    apart = short != long
    shared = np.where(apart.any(axis=1), apart.argmax(axis=1), apart.shape[1])
    replaced = apart.sum(axis=1) == 1
    # With the next character of the longer word left out, the rest has to be the same.
    moved = short[:, :-1] != long[:, 1:]
    last = np.where(moved.any(axis=1), moved.shape[1] - 1 - moved[:, ::-1].argmax(axis=1), -1)
    return np.where(same, replaced, last < shared), shared


def links_in(run: np.ndarray, words: list[str], size: int, under: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (as two arrays of indexes) of near words of one run; all runs have shorter words of one size."""
    count = len(run)
    order = np.argsort([len(w) for w in words], kind="stable")
    order = order[np.argsort(run[order], kind="stable")]
    run, under = run[order], under[order]
    codes = _codes([words[i] for i in order], size + 1)
    if codes.size and codes.max() < 256:
        codes = codes.astype(np.uint8)
    whole = np.array([len(words[i]) for i in order]) == size
    left, right = [], []
    step, at = 1, np.arange(count)
    while True:
        at = at[at + step < count]
        # Of a run the shorter words come first: longer ones are met by shorter ones only.
        at = at[(run[at] == run[at + step]) & whole[at]]
        if not len(at):
            break
        for a in range(0, len(at), max(1, CELLS // (size + 1))):
            i = at[a : a + max(1, CELLS // (size + 1))]
            ok, shared = near(codes[i], codes[i + step], whole[i + step])
            i = i[ok & (shared < under[i])]
            left.append(order[i])
            right.append(order[i + step])
        step += 1
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([*left, empty]), np.concatenate([*right, empty])


def _links(batches):
    """Both directions of each link: word, other, other_n. Rows come sorted by block; batches are cut where a block ends."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
        if held is None or not held.num_rows:
            continue
        block = held.column("block").to_numpy()
        end = held.num_rows if batch is None else int(np.searchsorted(block, block[-1]))
        if not end or (batch is not None and end < 20_000):
            continue
        part, held = held.slice(0, end), held.slice(end)
        yield from _of_part(part)


def _of_part(part: pa.Table):
    block, size, under = (part.column(c).to_numpy() for c in ("block", "size", "under"))
    words, n = part.column("word").to_pylist(), part.column("n").to_numpy()
    run = np.concatenate(([0], np.cumsum(block[1:] != block[:-1])))
    several = np.bincount(run)[run] > 1
    for s in np.unique(size[several]):
        at = np.flatnonzero(several & (size == s))
        a, b = links_in(run[at], [words[i] for i in at], int(s), under[at])
        a, b = at[a], at[b]
        one, two = np.concatenate((a, b)), np.concatenate((b, a))
        if len(one):
            yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in one]), pa.array([words[i] for i in two]), pa.array(n[two])], names=["word", "other", "other_n"])


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """words: word, n.  Every ordered pair of near words: word, other, other_n."""
    small_batches(words.sparkSession)
    blocks, tables = blocks_of(words, crowd)
    dealt = blocks.repartition("block").sortWithinPartitions("block", "word")
    out = settled(dealt.mapInArrow(_links, "word string, other string, other_n long"))
    for done in tables:
        discard(done)
    return out


def with_roots(forms: DataFrame) -> DataFrame:
    """forms: word, form (occurrences grow along them). Each word with its root, the last form. The number of rounds grows with the logarithm of the longest chain."""
    roots = settled(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("went")))
    while not roots.filter("went").isEmpty():
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = roots.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went"))
        before, roots = roots, settled(moved)
        discard(before)
    return roots.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, factor: int = FACTOR, one_in: int = ALTERED, crowd: int = CROWD) -> DataFrame:
    """Per word of the dictionary: word, n, n_near (its near words), form and form_n (its most frequent near word, the least of equals, if it has factor times its occurrences), root (the last of its forms, or itself)."""
    words = settled(dictionary(docs, key, text, min_chars, min_count, one_in))
    best = F.min(F.struct((-F.col("other_n")).alias("n"), F.col("other").alias("word")))
    pairs = near_words(words, crowd)
    per = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    found = words.join(per, "word", "left").withColumn("often", -F.col("best.n") >= factor * F.col("n"))
    told = settled(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("often"), F.col("best.word")).alias("form"), F.when(F.col("often"), -F.col("best.n")).alias("form_n"),
    ))
    discard(pairs)
    discard(words)
    roots = with_roots(told.filter("form is not null").select("word", "form"))
    return told.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


_CUT = "substr(word, 1, i) || substr(word, i + 2)"
SQL = f"""WITH RECURSIVE {crcsql.TABLE},
taken AS (SELECT doc_id, translate(run, '{CAPITALS}', '{CAPITALS.lower()}') AS word
          FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{LETTERS}')) AS run FROM documents)),
per AS (SELECT doc_id, word, count(*) AS n FROM taken GROUP BY ALL),
hashed AS (SELECT word, n, {crcsql.crc32("concat(doc_id, ':', word)")} AS h FROM per, crc_table),
made AS (SELECT CASE WHEN h % {ALTERED} = 0 THEN {_CUT.replace("i", "(h % length(word))::INT")} ELSE word END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= {MIN_CHARS} GROUP BY word HAVING sum(n) >= {MIN_COUNT}),
less AS (SELECT word, n, i, {_CUT} AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
told AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {FACTOR} * n THEN other END AS form, CASE WHEN other_n >= {FACTOR} * n THEN other_n END AS form_n
         FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS place, 0 AS depth FROM told UNION ALL SELECT c.word, t.form, depth + 1 FROM chain c JOIN told t ON t.word = c.place WHERE t.form IS NOT NULL),
roots AS (SELECT word, last(place ORDER BY depth) AS root FROM chain GROUP BY word)
SELECT word, n, n_near::BIGINT AS n_near, form, form_n::BIGINT AS form_n, root FROM told JOIN roots USING (word)"""
