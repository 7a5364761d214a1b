"""N-gram Jaccard join with grouped prefixes.

Two texts link if the Jaccard similarity of their word-shingle sets reaches a
threshold.  Texts with equal sets are one class.  Shingles have a global order
(frequent ones last), and classes that link share one of the first few
shingles of each: their prefixes.  Classes with identical prefixes and sizes
collapse into one group.  Only groups are dealt to the buckets of prefix
shingles; pairs of groups are filtered by size and by what their prefixes have
in common; only the groups that survive are expanded, and their members
verified on the whole sets.

No bucket gives all its pairs.  Each group has a home, the fullest of its
buckets, and the work is dealt by homes in two rounds:

1. Within each home, groups that may link are tied into clusters, a row a
   group; the members of a cluster are verified together, and one link is
   given for each two components that meet.  Homes of too many words are
   dealt in units, each of which also meets the home's best-known class.
2. Buckets that still have several components in several units are left.  Two
   units meet if their groups share enough of such buckets for one pair of
   them to link; again only links leave the verification.

Every pair that may link is either verified or within one component already,
so the components are exact.

Words are runs of characters other than 0x20 and 0x09-0x0D, with A-Z in lower
case; a text with fewer words than a shingle is one shingle.  Shingles are
64-bit hashes.  Defined results: a null or empty text has an empty set and
links with nothing.  Rows with the same id are told apart by their texts;
null ids make rows of their own that never name a component unless all ids of
it are null.  Extra columns are neither read nor returned.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import discard, fresh, settled, small_batches, small_join, table
from .components import connected_components
from .textvec import Words, as_bytes, blocks, list_array, mix, windows

#: At most so many shingles, the most frequent, count as such; they decide the order only, never the result.
FREQUENT = 200_000
#: Shingles of a unit of a large home: what a task holds is two of them.
UNIT = 300_000
#: Sizes within one band differ by this factor at most.
BAND = 1.02
#: Texts with more copies than this are joined back to their rows apart from the others.
HOT_COPIES = 1000


def _local_counts(batches, k: int):
    """Shingles that several texts of a block share, with the number of those texts."""
    for batch in batches:
        texts = as_bytes(batch.column(0))
        for a, b in blocks(texts, 4_000_000):
            words = Words(texts[a:b])
            h = windows(words.hashes(), k)
            doc = words.doc[: len(h)]
            within = doc == words.doc[k - 1 :]
            h, doc = h[within], doc[within]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            h = h[new]
            head = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(head, len(h)))
            head, n = head[n >= 3], n[n >= 3]
            yield pa.RecordBatch.from_arrays([pa.array(h[head].view(np.int64)), pa.array(n)], names=["shingle", "n"])


class Order:
    """The frequent shingles (sorted) and how frequent each is: 1, 2 or 3."""

    def __init__(self, shingle: np.ndarray, n: np.ndarray):
        at = np.argsort(shingle)
        self.shingle = shingle[at]
        self.level = (1 + (n[at] >= 100) + (n[at] >= 10_000)).astype(np.uint64)
        self.few = np.zeros(1 << 20, dtype=bool)
        self.few[self.shingle >> np.uint64(44)] = True

    def rank(self, h: np.ndarray) -> np.ndarray:
        """Two bits for how frequent a shingle is, then its hash: the global order as one number."""
        out = h >> np.uint64(2)
        maybe = np.flatnonzero(self.few[h >> np.uint64(44)])
        if len(maybe):
            at = np.minimum(np.searchsorted(self.shingle, h[maybe]), len(self.shingle) - 1)
            hit = self.shingle[at] == h[maybe]
            out[maybe[hit]] |= self.level[at[hit]] << np.uint64(62)
        return out


def shingle_order(docs: DataFrame, text: str, k: int) -> Order:
    """Counted over all documents; FREQUENT shingles at most reach the driver."""
    rows = (
        docs.select(text).mapInArrow(partial(_local_counts, k=k), "shingle long, n long")
        .groupBy("shingle").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    )
    return Order(rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy())


def _sets(texts: list[bytes], k: int, order: Order):
    """For each text its distinct shingles in the global order."""
    words = Words(texts)
    h = words.hashes()
    rank = order.rank(windows(h, k))
    for first, n in zip(words.first, words.count):
        if n >= k:
            yield np.unique(rank[first : first + n - k + 1])
        elif n:
            yield windows(h[first : first + n], int(n)) >> np.uint64(2)
        else:
            yield np.zeros(0, dtype=np.uint64)


def _node(s: np.ndarray) -> int:
    """A number that tells a set from other sets."""
    return int(mix(mix(s).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(s))).view(np.int64)[0])


def prefix_length(n: int, percent: int) -> int:
    """Sets that link share a shingle among so many first ones of each."""
    return n - -(-percent * n // 100) + 1 if n else 0


def _classes(batches, k: int, percent: int, order: Order):
    """A row for each text; only the first of equal texts of a batch has the group and the prefix."""
    for batch in batches:
        texts = as_bytes(batch.column(1))
        seen: set[int] = set()
        for a, b in blocks(texts, 2_000_000):
            nodes, sizes, prefixes, groups = [], [], [], []
            for s in _sets(texts[a:b], k, order):
                nodes.append(_node(s))
                sizes.append(len(s))
                if nodes[-1] in seen or not len(s):
                    prefixes.append(None)
                    groups.append(None)
                    continue
                seen.add(nodes[-1])
                prefixes.append(s[: prefix_length(len(s), percent)])
                groups.append(_node(np.append(prefixes[-1], np.uint64(len(s)))))
            lens = np.array([0 if p is None else len(p) for p in prefixes])
            flat = np.concatenate([p for p in prefixes if p is not None] or [np.zeros(0, dtype=np.uint64)])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(a, b - a), pa.array(sizes, type=pa.int64()), pa.array(nodes, type=pa.int64()), pa.array(groups, type=pa.int64()),
                    list_array(flat.view(np.int64), lens, pa.int64()),
                ],
                names=[batch.schema.names[0], "n", "node", "grp", "prefix"],
            )


def _members(batches, k: int, order: Order):
    for batch in batches:
        texts = as_bytes(batch.column(0))
        seen: set[int] = set()
        for a, b in blocks(texts, 2_000_000):
            found = {}
            for s in _sets(texts[a:b], k, order):
                if (node := _node(s)) not in seen:
                    seen.add(node)
                    found[node] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), type=pa.int64()), pa.array(list(found.values()), type=pa.binary())], names=["node", "members"])


def _lists(column: pa.Array) -> list[np.ndarray]:
    if pa.types.is_binary(column.type):
        return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]
    flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    stop = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return [flat[a:b] for a, b in zip([0, *stop[:-1]], stop)]


def _runs(batches, key: str, columns: list[str], lists: str):
    """Of rows sorted by key, each run of one key: its columns as arrays, and the lists of its rows. One run is held at a time."""
    held, sets = None, []
    for batch in _and_end(batches):
        if batch is not None:
            new = [batch.column(c).to_numpy(zero_copy_only=False) for c in (key, *columns)]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            sets += _lists(batch.column(lists))
        if held is None or not len(held[0]):
            continue
        change = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
        at = 0
        for stop in [*change, len(held[0])] if batch is None else change:
            yield [x[at:stop] for x in held], sets[at:stop]
            at = stop
        held, sets = [x[at:] for x in held], sets[at:]


def _and_end(batches):
    yield from batches
    yield None


def _fit(n_a, n_b, percent: int):
    """Whether sets of these sizes may link."""
    return 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)


def _terms(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all sets in a row: each element as a small number, where each set starts, and the sets' order, those that share most first; and how often each number occurs."""
    sizes = np.array([len(s) for s in sets])
    _, term, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    at = np.cumsum(sizes) - sizes
    return term, at, np.argsort(-np.add.reduceat(df[term], at), kind="stable"), df


def clusters(n: np.ndarray, prefixes: list[np.ndarray], percent: int) -> np.ndarray:
    """A label for each group: groups of which a pair may link, directly or through others, have the same."""
    count = len(n)
    if count == 1:
        return np.zeros(1, dtype=np.int64)
    size = np.array([len(p) for p in prefixes])
    last = np.array([p[-1] for p in prefixes])
    label, left = np.arange(count), count
    term, at, order, df = _terms(prefixes)
    postings = np.repeat(np.arange(count), size)[np.argsort(term, kind="stable")]
    starts = np.cumsum(df) - df
    for i in order:
        if left == 1:
            break
        of = term[at[i] : at[i] + size[i]]
        span = df[of]
        shared = np.bincount(postings[np.arange(span.sum()) + np.repeat(starts[of] - np.cumsum(span) + span, span)], minlength=count)
        j = np.flatnonzero((shared > 0) & (label != label[i]) & _fit(n, n[i], percent))
        if not len(j):
            continue
        # Up to the end of the prefix that ends first everything in common is seen; beyond it no more than what is left.
        first = last[j] <= last[i]
        rest = np.where(first, np.minimum(n[j] - size[j], n[i] - np.searchsorted(prefixes[i], last[j], "right")), n[i] - size[i])
        j = j[(100 + percent) * (shared[j] + rest) >= percent * (n[i] + n[j])]
        if len(j):
            met = np.unique(label[j])
            label[np.isin(label, met)] = label[i]
            left -= len(met)
    return np.unique(label, return_inverse=True)[1]


def _filter_groups(batches, percent: int):
    """The groups of a unit that may link with another, each with the cell in which its cluster is verified."""
    for batch in _batched(_clusters_of_units(batches, percent), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in batch], names=["cell", "unit", "grp", "pivot"])


def _clusters_of_units(batches, percent: int):
    for (unit, grp, n, several, pivot), prefixes in _runs(batches, "unit", ["grp", "n", "several", "pivot"], "prefix"):
        label = clusters(n, prefixes, percent)
        keep = (np.bincount(label)[label] > 1) | several.astype(bool)
        cell = mix(unit.view(np.uint64) + mix(label.astype(np.uint64) + np.uint64(1))).view(np.int64)
        yield [x[keep] for x in (cell, unit, grp, pivot.astype(bool))]


def _batched(parts, rows: int):
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= rows:
            yield [np.concatenate(x) for x in zip(*held)]
            held, n = [], 0
    if n:
        yield [np.concatenate(x) for x in zip(*held)]


def links_of(sets: list[np.ndarray], component: np.ndarray, side: np.ndarray | None, percent: int) -> tuple[list[int], list[int]]:
    """Links that tie up what the pairs of different components that reach percent tie up; with side, only pairs across the two sides count."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    component = np.unique(component, return_inverse=True)[1]
    left = component.max() + 1
    a, b = [], []
    if left == 1:
        return a, b
    term, at, order, df = _terms(sets)
    own = np.zeros(len(df), dtype=bool)
    for i in order:
        if left == 1:
            break
        ok = (component != component[i]) & _fit(sizes, sizes[i], percent)
        if side is not None:
            ok &= side != side[i]
        j = np.flatnonzero(ok)
        if not len(j):
            continue
        mine = term[at[i] : at[i] + sizes[i]]
        own[mine] = True
        span = sizes[j]
        start = np.cumsum(span) - span
        shared = np.add.reduceat(own[term[np.arange(span.sum()) + np.repeat(at[j] - start, span)]].astype(np.int64), start)
        own[mine] = False
        j = j[100 * shared >= percent * (sizes[j] + sizes[i] - shared)]
        if len(j):
            met, one = np.unique(component[j], return_index=True)
            a += [int(i)] * len(met)
            b += j[one].tolist()
            component[np.isin(component, met)] = component[i]
            left -= len(met)
    return a, b


def _verify(batches, percent: int, across: bool):
    def found():
        for (_, side, node, component), sets in _runs(batches, "cell", ["side", "node", "component"], "members"):
            # A set may arrive more than once where ids repeat.
            _, one = np.unique(np.column_stack((side, node)), axis=0, return_index=True)
            node, sets = node[one], [sets[i] for i in one]
            a, b = links_of(sets, component[one], side[one] if across else None, percent)
            if a:
                yield node[a], node[b]

    for a, b in _batched(found(), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


class _Join:
    """The parts of one join that the two rounds share."""

    def __init__(self, docs: DataFrame, key: str, text: str, k: int, percent: int):
        self.docs, self.key, self.text, self.k, self.percent = docs, key, text, k, percent
        self.order = shingle_order(docs, text, k)

    def classes(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows (key, n, node), classes (node, n, grp, rep) and groups (grp, n, prefix, leader, several)."""
        kind = self.docs.schema[self.key].dataType.simpleString()
        rows = settled(self.docs.select(self.key, self.text).mapInArrow(
            partial(_classes, k=self.k, percent=self.percent, order=self.order), f"`{self.key}` {kind}, n long, node long, grp long, prefix array<long>",
        ))
        known = rows.filter("grp is not null")
        classes = settled(known.groupBy("node").agg(F.first("n").alias("n"), F.first("grp").alias("grp"), F.min(self.key).alias("rep")))
        groups = settled(known.groupBy("grp").agg(
            F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.min("node").alias("leader"), (F.min("node") < F.max("node")).alias("several")
        ))
        plain = settled(rows.select(self.key, "n", "node"))
        discard(rows)
        return plain, classes, groups

    def links(self, cells: DataFrame, across: bool) -> DataFrame:
        """cells (settled): cell, side, node, component, rep.  The links (a, b) between members of each cell, found on their whole sets."""
        named = cells.filter("rep is not null")
        ids = named.select(F.col("rep").alias(self.key)).distinct()
        members = partial(_members, k=self.k, order=self.order)
        texts = small_join(self.docs.select(self.key, self.text).filter(F.col(self.key).isNotNull()), ids, [self.key], "left_semi").select(self.text)
        dealt = small_join(texts.mapInArrow(members, "node long, members binary"), named.drop("rep"), ["node"], "inner")
        if nameless := cells.filter("rep is null").limit(1).count():
            others = self.docs.filter(F.col(self.key).isNull()).select(self.text).mapInArrow(members, "node long, members binary").dropDuplicates(["node"])
            dealt = dealt.unionByName(small_join(others, cells.filter("rep is null").drop("rep"), ["node"], "inner"))
        columns = ["cell", "side", "node", "component", "members"]
        out = settled(dealt.select(*columns).repartition("cell").sortWithinPartitions("cell").mapInArrow(partial(_verify, percent=self.percent, across=across), "a long, b long"))
        discard(cells)
        return out


def _buckets(groups: DataFrame) -> DataFrame:
    """token, grp, size (classes, at least) of the prefix shingles that more than one class has.

    All are counted by partial sums, so that no task gets a whole bucket to count.  The frequent ones, which Order marks by
    their highest bits, meet their counts by a table of at most FREQUENT rows; a bucket of others that is large all the same
    is the large side of a join by one row, which Spark splits."""
    tokens = groups.select("grp", F.when(F.col("several"), 2).otherwise(1).alias("w"), F.explode("prefix").alias("token"))
    frequent = F.shiftrightunsigned("token", 62) > 0
    counted = settled(tokens.groupBy("token").agg(F.sum("w").alias("size")).filter("size > 1"))
    often = tokens.filter(frequent).join(F.broadcast(counted.filter(frequent)), "token")
    rare = tokens.filter(~frequent).join(counted.filter(~frequent), "token")
    out = settled(often.select("token", "grp", "size").unionByName(rare.select("token", "grp", "size")))
    discard(counted)
    return out


def _units(classes: DataFrame, buckets: DataFrame, percent: int) -> DataFrame:
    """Classes that share a bucket, with home, step, unit and fame: node, n, grp, rep, home, step, unit, fame."""
    homes = buckets.groupBy("grp").agg(F.max(F.struct("size", "token"))["token"].alias("home"), F.avg(F.log("size")).alias("fame"))
    # Sets that are more than a step apart in size never link; a unit has sizes of one step.
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)))
    at_home = classes.join(homes, "grp").withColumn("step", step)
    of_home = Window.partitionBy("home")
    large = at_home.groupBy("home", "step").agg(F.sum("n").alias("words")).withColumn("all", F.sum("words").over(of_home)).filter(F.col("all") > UNIT)
    parts = large.select("home", "step", F.ceil(F.col("words") / UNIT).alias("parts"))
    dealt = at_home.join(parts, ["home", "step"], "left")
    unit = F.when(F.col("parts").isNull(), F.col("home")).otherwise(F.xxhash64("home", "step", F.pmod(F.xxhash64("node"), F.col("parts"))))
    return settled(dealt.select("node", "n", "grp", "rep", "home", "step", unit.alias("unit"), "fame"))


def _first_cells(units: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """The cells of round 1: the clusters of each unit; a unit of a large home has the best-known class of its sizes along."""
    none = F.lit(False)
    own = units.groupBy("unit", "grp").agg((F.count("*") > 1).alias("several")).withColumn("pivot", none)
    dealt = units.filter("unit <> home")
    best = dealt.groupBy("home", "step").agg(F.max(F.struct("fame", "grp"))["grp"].alias("grp"))
    pivots = dealt.select("home", "step", "unit").distinct().join(best, ["home", "step"]).select("unit", "grp", none.alias("several"), F.lit(True).alias("pivot"))
    rows = own.unionByName(pivots).join(groups.select("grp", "n", "prefix"), "grp").select("unit", "grp", "n", "several", "pivot", "prefix")
    kept = settled(rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(partial(_filter_groups, percent=percent), "cell long, unit long, grp long, pivot boolean"))
    members = kept.filter("not pivot").join(units.select("unit", "grp", "node", "rep"), ["unit", "grp"]).select("cell", "node", "rep")
    leaders = kept.filter("pivot").join(groups.select("grp", F.col("leader").alias("node")), "grp").join(units.select("node", "rep"), "node").select("cell", "node", "rep")
    out = settled(members.unionByName(leaders).select("cell", F.lit(0).alias("side"), "node", F.col("node").alias("component"), "rep"))
    discard(kept)
    return out


def _need(low1, high1, low2, high2, percent: int):
    """Sets that link have more prefix shingles in common than this / 100 / (100 + percent), whichever sizes they have: it is least at an end of both ranges."""
    return percent * F.least(*(F.least(x, y) * 100 - F.greatest(x, y) * percent for x in (low1, high1) for y in (low2, high2)))


def _second_cells(units: DataFrame, buckets: DataFrame, components: DataFrame, percent: int) -> DataFrame:
    """The cells of round 2: of two units, the groups of two sizes that share enough buckets, as long as these have several components.

    A unit's groups of about one size take part as one, a band, so that a pair of bands is as telling as a pair of groups."""
    labelled = units.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    band = F.xxhash64("unit", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BAND))))
    of_group = labelled.groupBy("unit", "grp").agg(F.first("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).withColumn("band", band)
    of_token = Window.partitionBy("token")
    dealt = buckets.select("token", "grp").join(of_group, "grp")
    span = [F.min("n").alias("n_low"), F.max("n").alias("n_high"), F.min("low").alias("low"), F.max("high").alias("high")]
    left = (F.min("low").over(of_token) < F.max("high").over(of_token)) & (F.min("unit").over(of_token) < F.max("unit").over(of_token))
    met = settled(dealt.groupBy("token", "unit", "band").agg(*span).withColumn("left", left).filter("left").drop("left"))
    one, two = (met.select("token", *(F.col(c).alias(f"{c}{i}") for c in ("unit", "band", "n_low", "n_high", "low", "high"))) for i in (1, 2))
    sizes = (100 * F.col("n_high1") >= percent * F.col("n_low2")) & (100 * F.col("n_high2") >= percent * F.col("n_low1"))
    apart = (F.least("low1", "low2") < F.greatest("high1", "high2")) & (F.col("unit1") != F.col("unit2")) & (F.col("band1") < F.col("band2"))
    pairs = settled(one.join(two, "token").filter(sizes & apart).select("token", *(f"{c}{i}" for i in (1, 2) for c in ("band", "n_low", "n_high"))))
    ends = [f(f"{c}{i}").alias(f"{c}{i}") for i in (1, 2) for c, f in (("n_low", F.min), ("n_high", F.max))]
    shared = pairs.groupBy("band1", "band2").agg(F.count("*").alias("shared"), *ends)
    enough = F.col("shared") * 100 * (100 + percent) > _need(*(F.col(f"{c}{i}") for i in (1, 2) for c in ("n_low", "n_high")), percent)
    cells = settled(shared.filter(enough).select("band1", "band2", F.xxhash64("band1", "band2").alias("cell")))
    side = lambda i, j: F.struct(F.lit(i - 1).alias("side"), F.col(f"band{i}").alias("band"), F.col(f"n_low{j}").alias("from"), F.col(f"n_high{j}").alias("to"))
    sides = small_join(pairs, cells, ["band1", "band2"], "inner").select("cell", "token", F.explode(F.array(side(1, 2), side(2, 1))).alias("s")).select("cell", "token", "s.*")
    asked = (
        sides.join(dealt.select("token", "band", "unit", "grp", "n"), ["token", "band"])
        .groupBy("cell", "side", "unit", "grp").agg(F.count("*").alias("shared"), F.first("n").alias("n"), F.min("from").alias("from"), F.max("to").alias("to"))
        .filter(F.col("shared") * 100 * (100 + percent) > _need(F.col("n"), F.col("n"), F.col("from"), F.col("to"), percent))
    )
    out = settled(asked.join(labelled.select("unit", "grp", "node", "component", "rep"), ["unit", "grp"]).select("cell", "side", "node", "component", "rep"))
    for done in (met, pairs, cells):
        discard(done)
    return out


def _labelled(join: _Join) -> DataFrame:
    """Per row: the id, n, node, and component (a node; null for an empty set)."""
    rows, classes, groups = join.classes()
    percent = join.percent
    buckets = _buckets(groups)
    units = _units(classes, buckets, percent)
    links = join.links(_first_cells(units, groups, percent), across=False)
    discard(groups)
    first = settled(connected_components(links))
    more = join.links(_second_cells(units, buckets, first, percent), across=True)
    final = settled(connected_components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)))
    # Nodes that link with nothing, most of all, are their own components: only rows of the others meet the table, and
    # rows of a text with many copies by a join of their own, which few names take part in.
    often = rows.filter("n > 0").groupBy("node").count().filter(F.col("count") > HOT_COPIES).select("node")
    hot = settled(often.join(final, "node"))
    full = rows.filter("n > 0")
    some = small_join(full, hot.select("node"), ["node"], "left_anti").join(final, "node", "left")
    many = small_join(full, hot, ["node"], "inner")
    named = some.unionByName(many).withColumn("component", F.coalesce("component", "node"))
    out = settled(named.unionByName(rows.filter("n = 0").withColumn("component", F.lit(None).cast("long"))).select(join.key, "n", "node", "component"))
    for done in (classes, buckets, units, links, more, first, rows, hot, final):
        discard(done)
    return out


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 3, percent: int = 90) -> DataFrame:
    """Per row of docs: the id, n_shingles and component_id (the smallest id that it reaches by links)."""
    small_batches(docs.sparkSession)
    rows = _labelled(_Join(docs, key, text, k, percent))
    # Most components are of one row, which needs no name but its own.
    names = rows.filter("component is not null").groupBy("component").agg(F.min(key).alias("least"), F.count("*").alias("rows")).filter("rows > 1")
    names = settled(names)
    large = names.filter(F.col("rows") > HOT_COPIES)
    some = small_join(rows, large.select("component"), ["component"], "left_anti").join(names.filter(F.col("rows") <= HOT_COPIES), "component", "left")
    out = some.unionByName(small_join(rows, large, ["component"], "inner"))
    return out.select(key, F.col("n").alias("n_shingles"), F.coalesce("least", key).alias("component_id"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))


def _with_node(batches, k: int, order: Order, at: int, name: str):
    for batch in batches:
        texts = as_bytes(batch.column(at))
        for a, b in blocks(texts, 2_000_000):
            nodes = [_node(s) if len(s) else None for s in _sets(texts[a:b], k, order)]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(nodes, type=pa.int64())], names=[*batch.schema.names, name])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """Pipeline stage: of documents linked by five-word shingles and a similarity of 0.8, one row stays: that of the smallest id.

    Null ids come last, rows of one id are told apart by their texts, and of
    rows with one id and one sequence of words the first met stays.  Documents
    with empty texts link with nothing and stay.  All columns are kept as they are."""
    small_batches(spark)
    join = _Join(docs, "doc_id", "text", 5, 80)
    rows = _labelled(join).filter("component is not null")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best")
    firsts = rows.groupBy("component").agg(best, F.count("*").alias("rows")).filter("rows > 1")
    met = settled(small_join(rows, firsts.select("component", "best"), ["component"], "inner"))
    stays = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("node") == F.col("best.node"))
    gone = settled(met.filter(~stays).select("doc_id", "node").distinct())
    twice = met.filter(stays).groupBy("doc_id", "node").count().filter("count > 1").select("doc_id", "node")
    ids = rows.agg(F.count("*").alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    if ids["rows"] == ids["ids"]:
        return small_join(docs, gone.select("doc_id"), ["doc_id"], "left_anti").select(*docs.columns)
    # Ids don't tell the rows apart: their texts have to be looked at once more.
    node, other, of = fresh(docs, "node"), fresh(docs, "other"), fresh(docs, "of")
    schema = StructType([*docs.schema.fields, StructField(node, LongType())])
    marked = docs.mapInArrow(partial(_with_node, k=join.k, order=join.order, at=docs.columns.index("text"), name=node), schema)
    same = F.col("doc_id").eqNullSafe(F.col(of)) & (F.col(node) == F.col(other))
    kept = marked.join(gone.toDF(of, other), same, "left_anti")
    twice = settled(twice).toDF(of, other)
    return kept.join(twice, same, "left_anti").unionByName(kept.join(twice, same, "left_semi").dropDuplicates(["doc_id", node])).select(*docs.columns)
