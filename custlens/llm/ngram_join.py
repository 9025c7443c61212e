"""Exact Jaccard join of word n-gram sets by vertical partitioning, and the groups that its links make.

1. Each text becomes its set of shingles (63-bit hashes). Equal sets (64 bits of their own) are one class; from here on
   classes are compared.
2. Shingles have one global order: by hash, with the most frequent ones (``HOT`` at most, counted over all documents)
   last. Of a set of n shingles the first ``n - ceil(t n) + 1`` are its prefix, and two sets that are similar
   enough share a shingle of both prefixes. Frequent passages are last, so they make no candidates.
3. Classes that share a prefix shingle are candidates; shingles of one prefix alone are left out once, before anything
   else. Most links are found by hubs: the classes of a shingle are not paired with each other but with its hub, the class
   whose prefix is the most widely shared, and each class only with the hub it meets most often, so that turn has no more
   pairs than classes. In later turns the classes outside a group's largest component are paired with the ``TRIES`` of
   ``HUBS`` members of it per shingle that they meet most often, until few of the pairs are links, ``HUB_TURNS`` turns
   at most. Classes that are in one component need no further comparison.
   What is left are pairs of classes of different components that share a shingle of their whole prefixes, and those
   are all compared, if their sizes allow it and their prefixes have as many shingles in common as similar sets must
   have. Two bounds are part of the join: no pair has more shingles in common than either class has with all others, and
   sets that differ in ``d`` shingles differ in ``d`` bits of their marks at most (a shingle flips one bit of 512), so a
   text just outside a large group is seldom paired with each of its members. So no link is lost that joins two components, whatever the hubs found, and copies of one text are never
   paired with one another.
4. A pair is verified by vertical partitioning: the global order is cut into ``FRAGMENTS`` fragments, each set into its
   segments, overlaps are counted per fragment and summed per pair. Only the texts of a pair are moved for that: a bitmap
   of ``FILTER_BITS`` bits keeps nearly all others where they are read.
5. Components of the links by contraction: each root hangs itself below its smallest neighbour, paths are halved
   until they are flat, and the links between the new roots go into the next round.

Defined cases: a null text and a text without words have no shingles and link with nothing, not even each other; a text
of fewer words than a shingle is one shingle; rows with equal texts link; rows that share a key but not a text are
documents of their own; ties cannot change a result, only which hub is taken; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.llm.common import column, documents, free_name, small_batches
from custlens.llm.textbytes import SPACED, Rolling, buffers, grams, lower_ascii, mixed, slices, words
from custlens.session import materialize

SHINGLE = 5
PERCENT = 75
FRAGMENTS = 8
# How many turns of hubs there are at most, how many hubs a shingle has after the first turn and how many of them a class
# tries; what they miss is compared at the end.
HUB_TURNS = 4
HUBS = 8
TRIES = 4
# Another turn follows only if one pair in so many was a link.
LEAST_GAIN = 8
# Only the order of the shingles depends on these two: how many frequent ones are put last, and how often one must
# stand in some thousand documents to be counted as possibly frequent.
HOT = 50_000
HOT_IN_BATCH = 4
FILTER_BITS = 1 << 26
# Columns of 64 bits, whose bits tell whether an odd number of the shingles of a set falls on them.
MARKS = [f"mark{i}" for i in range(8)]

_SALT, _SECOND = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def _shingles(data: np.ndarray, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash (63 bits) of the shingles of each text, sorted by row."""
    rows, starts, ends = words(data, places, SPACED)
    hashes = Rolling(data).hashes(starts, ends)
    values, inside = grams(hashes, rows, n)
    at, found = [rows[: len(values)][inside]], [values[inside]]
    counts = np.bincount(rows, minlength=len(places) - 1)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    for size in range(1, n):  # texts of fewer words: all of them are one shingle
        short = np.flatnonzero(counts == size)
        if len(short):
            total = np.full(len(short), np.uint64(size) * _SECOND)
            for i in range(size):
                total = mixed(total + hashes[firsts[short] + i])
            at.append(short)
            found.append(total)
    row, value = np.concatenate(at), np.concatenate(found)
    if n > 1:  # the short texts in between
        order = np.argsort(row, kind="stable")
        row, value = row[order], value[order]
    return row, value >> np.uint64(1)


def _distinct(row: np.ndarray, key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of the distinct keys of each row, sorted; ``row`` is sorted already. ``key`` is used up."""
    bounds = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))])
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a > 1:
            key[a:b].sort()
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def _prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-n * percent // 100) + 1


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


# A shingle's place in the global order: its hash, or this and its rank if it is a frequent one.
_LAST = np.uint64(1) << np.uint64(63)
_SLICE_BYTES = 1_000_000
_TABLE = np.uint64((1 << 20) - 1)


class _Sets:
    """Shingle sets of Arrow batches, as places in the global order."""

    def __init__(self, hot: list[int], n: int, percent: int):
        """``hot``: the frequent shingles, the most frequent last."""
        known = np.array(hot, np.uint64)
        order = np.argsort(known)
        self.known, self.ranks, self.n, self.percent = known[order], order.astype(np.uint64), n, percent
        self.table = np.zeros(int(_TABLE) + 1, dtype=bool)
        self.table[known & _TABLE] = True

    def _keys(self, value: np.ndarray) -> np.ndarray:
        if len(self.known):
            maybe = np.flatnonzero(self.table[value & _TABLE])
            at = np.minimum(np.searchsorted(self.known, value[maybe]), len(self.known) - 1)
            hit = self.known[at] == value[maybe]
            value[maybe[hit]] = _LAST | self.ranks[at[hit]]
        return value

    def _parts(self, texts: pa.Array):
        data, places = buffers(texts)
        for lo, hi in slices(places, _SLICE_BYTES):
            own = places[lo : hi + 1] - places[lo]
            yield hi - lo, *_shingles(lower_ascii(data[places[lo] : places[hi]]), own, self.n)

    def _sets(self, texts: pa.Array):
        for n, row, value in self._parts(texts):
            row, key = _distinct(row, self._keys(value), n)
            counts = np.bincount(row, minlength=n)
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(key ^ _SALT), dtype=np.uint64)])
            ends = np.cumsum(counts)
            digest = [pa.array(counts.astype(np.int64)), pa.array((sums[ends] - sums[ends - counts]).view(np.int64))]
            yield n, row, key, counts, digest

    def digests(self, texts: pa.Array) -> pa.Array:
        out = []
        for _, _, key, counts, digest in self._sets(texts):
            ends, bit = np.cumsum(counts), mixed(key ^ _SECOND)
            word, flip = (bit >> np.uint64(6)) % np.uint64(len(MARKS)), np.uint64(1) << (bit & np.uint64(63))
            for i in range(len(MARKS)):
                flips = np.where(word == i, flip, np.uint64(0))
                sums = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(flips)])
                digest.append(pa.array((sums[ends] ^ sums[ends - counts]).view(np.int64)))
            out.append(pa.StructArray.from_arrays(digest, ["n", "cid", *MARKS]))
        return _joined(out, pa.struct([*_DIGEST, *((m, pa.int64()) for m in MARKS)]))

    def prefixes(self, texts: pa.Array) -> pa.Array:
        out = []
        for n, row, key, counts, digest in self._sets(texts):
            place = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            taken = place < _prefix_length(counts, self.percent)[row]
            lists = _lists(key[taken], np.bincount(row[taken], minlength=n))
            out.append(pa.StructArray.from_arrays([*digest, lists], ["n", "cid", "prefix"]))
        return _joined(out, _PREFIX_TYPE)

    def segments(self, texts: pa.Array) -> pa.Array:
        out = []
        for n, row, key, _, digest in self._sets(texts):
            # Hashes are cut evenly into all fragments but the last, which has the frequent shingles.
            even = ((key >> np.uint64(31)).astype(np.int64) * (FRAGMENTS - 1)) >> 32
            fragment = np.where(key >= _LAST, FRAGMENTS - 1, even)
            counts = np.bincount(row * FRAGMENTS + fragment, minlength=n * FRAGMENTS)
            outer = pa.array(np.arange(n + 1, dtype=np.int32) * FRAGMENTS)
            lists = pa.ListArray.from_arrays(outer, _lists(key, counts))
            out.append(pa.StructArray.from_arrays([*digest, lists], ["n", "cid", "segments"]))
        return _joined(out, _SEGMENT_TYPE)

    def frequent(self, texts: pa.Array) -> pa.Array:
        """For the first row of a batch the shingles that stand often in a slice of it, for the others nothing."""
        pairs, held, size = [], [], 0
        for _, _, value in [*self._parts(texts), (0, None, None)]:
            if value is not None:
                held.append(value)
                size += len(value)
            if held and (value is None or size > 1_000_000):
                seen, counts = np.unique(np.concatenate(held), return_counts=True)
                often = counts >= HOT_IN_BATCH
                pairs += zip(seen[often].tolist(), counts[often].tolist())
                held, size = [], 0
        pairs = [{"shingle": s, "n": c} for s, c in pairs]
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("n", pa.int64())]))
        return pa.array([pairs] + [None] * (len(texts) - 1) if len(texts) else [], kind)


_DIGEST = [("n", pa.int64()), ("cid", pa.int64())]
_PREFIX_TYPE = pa.struct([*_DIGEST, ("prefix", pa.list_(pa.int64()))])
_SEGMENT_TYPE = pa.struct([*_DIGEST, ("segments", pa.list_(pa.list_(pa.int64())))])
_DIGEST_DDL = "n:bigint,cid:bigint"


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    if not parts:
        return pa.array([], kind)
    return pa.concat_arrays([p.cast(kind) for p in parts])


class Sets:
    """Columns made from a text column, for one global order."""

    def __init__(self, spark, hot: list[int] = (), n: int = SHINGLE, percent: int = PERCENT):
        self._shared = spark.sparkContext.broadcast(_Sets(list(hot), n, percent))

    def digests(self, text: Column) -> Column:
        shared = self._shared

        def digests(texts: pa.Array) -> pa.Array:
            return shared.value.digests(texts)

        marks = "".join(f",{m}:bigint" for m in MARKS)
        return arrow_udf(digests, f"struct<{_DIGEST_DDL}{marks}>")(text)

    def prefixes(self, text: Column) -> Column:
        shared = self._shared

        def prefixes(texts: pa.Array) -> pa.Array:
            return shared.value.prefixes(texts)

        return arrow_udf(prefixes, f"struct<{_DIGEST_DDL},prefix:array<bigint>>")(text)

    def segments(self, text: Column) -> Column:
        shared = self._shared

        def segments(texts: pa.Array) -> pa.Array:
            return shared.value.segments(texts)

        return arrow_udf(segments, f"struct<{_DIGEST_DDL},segments:array<array<bigint>>>")(text)

    def frequent(self, text: Column) -> Column:
        shared = self._shared

        def frequent(texts: pa.Array) -> pa.Array:
            return shared.value.frequent(texts)

        return arrow_udf(frequent, "array<struct<shingle:bigint,n:bigint>>")(text)


def hot_shingles(texts: DataFrame, n: int = SHINGLE, most: int = HOT) -> list[int]:
    """The most frequent shingles, the most frequent last; a bounded number, counted in all documents."""
    listed = texts.select(F.explode(Sets(texts.sparkSession, n=n).frequent(F.col("text"))).alias("s"))
    counts = listed.groupBy("s.shingle").agg(F.sum("s.n").alias("n"))
    with small_batches(texts.sparkSession):
        return [r["shingle"] for r in counts.orderBy(F.desc("n"), "shingle").limit(most).collect()][::-1]


def _needed(x: Column, y: Column, percent: int) -> Column:
    """How many shingles two sets of these sizes must have in common to be similar enough."""
    return F.ceil(F.lit(percent) * (x + y) / F.lit(100 + percent))


def _least_common(x: Column, y: Column, percent: int) -> Column:
    """How many shingles two prefixes must have in common if the sets are similar enough."""
    need = _needed(x, y, percent)
    length = lambda n: n - F.ceil(n * percent / 100) + 1
    return F.greatest(F.lit(1), F.least(length(x) - (x - need), length(y) - (y - need)))


def _marked(classes: DataFrame, name: str) -> DataFrame:
    return classes.select(F.col("cid").alias(name), F.col("n").alias(f"n_{name}"), *(F.col(m).alias(f"{m}_{name}") for m in MARKS))


def _may_link(percent: int) -> Column:
    """Whether the marks of ``a`` and ``b`` differ in no more bits than similar sets differ in shingles."""
    differ = [F.bit_count(F.col(f"{m}_a").bitwiseXOR(F.col(f"{m}_b"))) for m in MARKS]
    most = F.col("n_a") + F.col("n_b") - 2 * _needed(F.col("n_a"), F.col("n_b"), percent)
    return sum(differ[1:], differ[0]) <= most


def verified(pairs: DataFrame, segments: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Of the pairs ``a, b`` those that are similar enough: overlaps are counted per fragment and summed per pair.

    ``segments``: ``cid, fragment, n, segment``, and ``copies``, how often each of them stands there. Only those of the pairs
    move. A hub with many partners is split, as the joins are on two shuffled sides unless one is small.
    """
    side = lambda name: segments.join(
        pairs.select(F.col(name).alias("cid")).distinct(), "cid", "left_semi"
    ).select(
        F.col("cid").alias(name),
        F.col("fragment").alias(f"f_{name}"),
        F.col("segment").alias(f"seg_{name}"),
        F.col("n").alias(f"n_{name}"),
        F.col("copies").alias(f"c_{name}"),
    )
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("f_a = f_b")
    partial = F.size(F.array_intersect("seg_a", "seg_b")).cast("long")
    total = both.groupBy("a", "b").agg(
        F.sum(partial).alias("sum"), *(F.max(x).alias(x) for x in ("n_a", "n_b", "c_a", "c_b"))
    )
    total = total.withColumn("common", F.expr("sum div (c_a * c_b)"))
    similar = 100 * F.col("common") >= percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
    return total.where(similar).select("a", "b")


def contract(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``cid, root`` of every node, the same root for all that the links ``a, b`` connect.

    ``nodes`` has ``cid, root`` from earlier links, whose roots point to themselves.
    """
    state = nodes
    while True:
        of = lambda name: state.select(F.col("cid").alias(f"{name}_id"), F.col("root").alias(f"{name}_root"))
        crossing = (
            links.join(of("a"), F.col("a") == F.col("a_id"))
            .join(of("b"), F.col("b") == F.col("b_id"))
            .where("a_root != b_root")
            .select(F.greatest("a_root", "b_root").alias("high"), F.least("a_root", "b_root").alias("low"))
        )
        hung = materialize(crossing.groupBy("high").agg(F.min("low").alias("parent")), "hung-roots")
        if hung.isEmpty():
            return state
        # Parents are smaller than their children, so following them ends.
        while True:
            up = hung.select(F.col("high").alias("at"), F.col("parent").alias("above"))
            shorter = hung.join(up, F.col("parent") == F.col("at"), "left").select(
                "high", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")
            )
            shorter = materialize(shorter, "hung-roots")
            hung = shorter.select("high", "parent")
            if shorter.where("moved").isEmpty():
                break
        state = materialize(
            state.join(hung, F.col("root") == F.col("high"), "left").select("cid", F.coalesce("parent", "root").alias("root")),
            "roots",
        )


def _prepared(texts: DataFrame, sets: Sets) -> tuple[DataFrame, DataFrame]:
    """Written tables: documents, and their classes.

    A class is stood for by its smallest key; ``copies`` counts the rows that have this key and this set.
    """
    seen = texts.select("key", sets.digests(F.col("text")).alias("s")).select("key", "s.*")
    rows = materialize(seen, "shingle-rows")
    per_key = rows.where("n > 0").groupBy("cid", "n", "key", *MARKS).agg(F.count("*").alias("copies"))
    grouped = per_key.groupBy("cid", "n", *MARKS).agg(F.min(F.struct("key", "copies")).alias("r"))
    grouped = grouped.select("cid", "n", F.col("r.key").alias("rep"), "r.copies", *MARKS)
    return rows, materialize(grouped, "shingle-classes")


def _shared(texts: DataFrame, sets: Sets, classes: DataFrame) -> DataFrame:
    """Written: the prefix shingles that two classes or more have, and how many have them.

    Every shingle is moved once; those of one class alone go before anything is joined.
    """
    found = texts.select(sets.prefixes(F.col("text")).alias("s"))
    each = found.select("s.cid", F.explode("s.prefix").alias("token"))
    same = Window.partitionBy("token")
    ends = each.select("token", "cid", F.min("cid").over(same).alias("first"), F.max("cid").over(same).alias("last"))
    several = ends.where("first != last").select("token", "cid").distinct()
    several = several.withColumn("df", F.count("*").over(same))
    several = materialize(several, "several-tokens")
    return materialize(several.join(classes.select("cid", "n"), "cid"), "shared-tokens")


def _crossing(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """Written: the shared shingles that stand in more than one component, with the components and their sizes."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("size"))
    rooted = placed.select("token", "cid", "n").join(roots.join(sizes, "root"), "cid")
    same = Window.partitionBy("token")
    ends = rooted.withColumn("r1", F.min("root").over(same)).withColumn("r2", F.max("root").over(same))
    return materialize(ends.where("r1 != r2").drop("r1", "r2"), "rest-tokens")


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``texts`` whose keys are among those of ``wanted``, and few others: a bitmap has a bit of each.

    It is broadcast as words of 64 bits, ``FILTER_BITS / 64`` of them at most.
    """
    place = lambda name: F.xxhash64(name).bitwiseAND(F.lit(FILTER_BITS - 1))
    slot, bit = (lambda x: F.shiftright(x, 6)), (lambda x: F.expr("shiftleft(1L, cast({} % 64 as int))".format(x)))
    marked = wanted.select(place("rep").alias("place_w")).select(slot("place_w").alias("slot_w"), bit("place_w").alias("mark"))
    words = marked.groupBy("slot_w").agg(F.bit_or("mark").alias("marks"))
    placed = texts.withColumn("place_t", place("key"))
    met = (slot(F.col("place_t")) == F.col("slot_w")) & (F.col("marks").bitwiseAND(bit("place_t")) != 0)
    return placed.join(F.broadcast(words), met, "left_semi").drop("place_t")


def _segments(
    texts: DataFrame, sets: Sets, classes: DataFrame, pairs: DataFrame, known: DataFrame | None = None
) -> DataFrame:
    """Written segments of the classes in ``pairs``, without those ``known``.

    Their keys are a table of known size, broadcast if it is small.
    """
    cids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
    if known is not None:
        cids = cids.join(known.select("cid").distinct(), "cid", "left_anti")
    wanted = classes.join(cids, "cid").select(F.col("cid").alias("own"), "rep", "copies")
    wanted = materialize(wanted, "wanted-classes")
    if known is not None and wanted.isEmpty():
        return known.limit(0)
    texts = _only(texts, wanted)
    with small_batches(texts.sparkSession):
        cut = texts.join(wanted, F.col("key").eqNullSafe(F.col("rep"))).select(
            "own", "copies", sets.segments(F.col("text")).alias("s")
        )
        own = cut.where(F.col("s.cid") == F.col("own"))
        parts = own.select("s.cid", "copies", "s.n", F.posexplode("s.segments").alias("fragment", "segment"))
        return materialize(parts.where(F.size("segment") > 0), "segments")


def linked(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    n: int = SHINGLE,
    percent: int = PERCENT,
    hub_turns: int = HUB_TURNS,
) -> DataFrame:
    """One row per document: ``key, n_shingles, component_id``, the smallest key that its links reach."""
    spark = docs.sparkSession
    texts = docs.select(column(docs, key).alias("key"), column(docs, text).alias("text"))
    sets = Sets(spark, hot_shingles(texts, n), n, percent)

    with small_batches(spark):
        rows, classes = _prepared(texts, sets)
        shared = _shared(texts, sets, classes)
    placed = shared.withColumn("root", F.col("cid"))
    roots = classes.select("cid", F.col("cid").alias("root"))
    segments, tried = None, None
    for turn in range(hub_turns):
        pairs = _hub_pairs(placed, classes, turn, percent)
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "hub-pairs")
        number = pairs.count()
        if not number:
            break
        tried = pairs if tried is None else tried.unionByName(pairs)
        fresh = _segments(texts, sets, classes, pairs, segments)
        segments = fresh if segments is None else segments.unionByName(fresh)
        links = materialize(verified(pairs, segments, percent), "links")
        roots = contract(materialize(roots, "roots"), links)
        placed = _crossing(placed, roots)  # a shingle that has left this table stays in one component
        if LEAST_GAIN * links.count() < number:
            break
    pairs = _rest_pairs(placed, classes, percent)
    pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "rest-pairs")
    fresh = _segments(texts, sets, classes, pairs, segments)
    segments = fresh if segments is None else segments.unionByName(fresh)
    roots = contract(roots, materialize(verified(pairs, segments, percent), "links"))

    placed = classes.join(roots, "cid").select("cid", "rep", "root")
    least = placed.groupBy("root").agg(F.min("rep").alias("component"))
    named = placed.join(least, "root").select(F.col("cid").alias("own"), "component")
    joined = rows.join(named, (F.col("n") > 0) & (F.col("cid") == F.col("own")), "left")
    return joined.select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "key").alias("component_id")
    )


def _hub_pairs(placed: DataFrame, classes: DataFrame, turn: int, percent: int) -> DataFrame:
    """Each class with the hubs that it meets most often, if they are in different components and their sizes allow a link.

    The first hub of a shingle is the most central class. Later ones are drawn by a hash from the largest component, so
    only classes that are not in it yet are paired, and only if they meet the hub by as many shingles as similar prefixes
    have in common (in the first turn by a quarter); ``_rest_pairs`` finds what is missed here.
    """
    hubs, tries = (HUBS, TRIES) if turn else (1, 1)
    if turn:
        order = [F.desc("size"), F.xxhash64("cid", F.lit(turn)), "cid"]
    else:
        placed = placed.join(placed.groupBy("cid").agg(F.sum("df").alias("centre")), "cid")
        order = [F.desc("centre"), F.desc("cid")]
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("token").orderBy(*order)))
    hub = ranked.where(F.col("rank") <= hubs).select(
        "token", F.col("cid").alias("y"), F.col("n").alias("n_y"), F.col("root").alias("r_y")
    )
    fits = 100 * F.least("n", "n_y") >= percent * F.greatest("n", "n_y")
    both = placed.join(hub, "token").where((F.col("root") != F.col("r_y")) & fits)
    met = both.groupBy(F.col("cid").alias("x"), "y", "n", "n_y").agg(F.count("*").alias("common"))
    enough = (1 if turn else 4) * F.col("common") >= _least_common(F.col("n"), F.col("n_y"), percent)
    first = Window.partitionBy("x").orderBy(F.desc("common"), F.desc("y"))
    best = met.where(enough).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= tries)
    pairs = best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    return pairs.join(_marked(classes, "a"), "a").join(_marked(classes, "b"), "b").where(_may_link(percent)).select("a", "b")


def _rest_pairs(placed: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs of classes of different components that share enough prefix shingles and whose sizes allow a link.

    No pair has more shingles in common than either class has in ``placed``, and no link differs in more bits of its marks
    than in shingles: pairs that these two bounds exclude are not made.
    """
    counted = placed.select("token", "cid", "root", F.count("*").over(Window.partitionBy("cid")).alias("own"))
    side = lambda name: counted.select(
        "token", F.col("cid").alias(name), F.col("root").alias(f"r_{name}"), F.col("own").alias(f"own_{name}")
    ).join(_marked(classes, name), name)
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    least = _least_common(F.col("n_a"), F.col("n_b"), percent)
    reach = (F.least("own_a", "own_b") >= least) & _may_link(percent)
    met = side("a").join(side("b"), "token").where((F.col("a") < F.col("b")) & (F.col("r_a") != F.col("r_b")) & fits & reach)
    common = met.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("common"))
    return common.where(F.col("common") >= least).select("a", "b")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row left of each group of linked texts. Texts without words are all left.

    Rows are told apart by their key and a hash of their text; of a row that is repeated whole, one is left. What goes is
    a written table of known size, broadcast if it is small.
    """
    name, copy = free_name(docs, "row"), free_name(docs, "copy")
    row = F.struct(column(docs, key).alias("key"), F.xxhash64(column(docs, text)).alias("hash"))
    keyed = docs.withColumn(name, row)
    groups = materialize(linked(keyed, name, text).where("n_shingles > 0"), "near-copies")
    gone = groups.where(F.col(name) != F.col("component_id")).select(F.col(name).alias("gone"))
    gone = materialize(gone.distinct(), "gone-rows")
    left = keyed.join(gone, F.col(name) == F.col("gone"), "left_anti")
    again = groups.groupBy(name).agg(F.count("*").alias(copy)).where(F.col(copy) > 1).select(F.col(name).alias("again"))
    again = materialize(again, "repeated-rows")
    once = left.join(again, F.col(name) == F.col("again"), "left_anti")
    many = left.join(again, F.col(name) == F.col("again"), "left_semi").dropDuplicates([name])
    return once.unionByName(many).select(*(column(docs, c) for c in docs.columns))


def op7_ngram_join(spark, folder):
    return linked(documents(spark, folder).select("doc_id", "text"))
