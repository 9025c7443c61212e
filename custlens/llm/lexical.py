"""Ranked lexical search in a length-stratified index.

The length of a document enters a score only through its normaliser ``m``, a whole number. The index puts documents of equal
``m`` together, at most ``SEGMENT`` of them in a segment (a full stratum has many). A segment holds, for each term, its
postings by falling frequency ``tf``: since ``m`` is the same for all, the impact of a term is computed once per ``tf``, and the
impact at the highest ``tf`` bounds what the term can give any document of the segment. The sum of these bounds over an item's
terms bounds its scores there.

A search visits segments in the order of their bounds. First the ``SEEDS`` segments with the highest bounds of each item are scored; the
score at the last wanted rank is a threshold. Then every other segment is scored for the items whose bound reaches the
threshold, and for no others. Tasks raise their own threshold as they go and pass on only their best of each item. The result is exact.

Items are searched in blocks of at most ``BLOCK_WORDS`` words (save one longer item), which bounds what is broadcast; the
index holds the postings of a block's terms for all documents. Terms are compared by 64-bit hashes.

Defined cases: null and empty texts have no terms, are not counted and never found; rows are documents, so rows that
repeat an id are ranked one by one; equal scores go by ascending id, null first; a row of items that repeats another
wholly counts once; items without terms, and an empty table of either kind, give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from custlens.llm.common import column, documents
from custlens.llm.textbytes import ALNUM, Rolling, buffers, lower_ascii, slices, words
from custlens.session import materialize

FIRST = 10
SEGMENT, SEEDS = 1024, 16
BLOCK_WORDS = 400_000
# Postings put together in one go by a task: bounds its temporary arrays.
GATHERED = 500_000
# Fixed values of the score.
LEAST_M, SLOPE = 10, 90
TF_SCALE, TF_PART, M_PART = 1_000_000_000, 1000, 8
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def term_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: the first text, the row of each term in the slice, and its hash."""
    raw, places = buffers(texts)
    for lo, hi in slices(places):
        data, own = lower_ascii(raw[places[lo] : places[hi]]), places[lo : hi + 1] - places[lo]
        rows, starts, ends = words(data, own, ALNUM)
        yield lo, hi, rows, Rolling(data).hashes(starts, ends) if len(rows) else np.zeros(0, np.uint64)


def _vectors(vocabulary):
    """A function of a text: number of terms, and the terms of the vocabulary with their frequencies."""

    def vectors(texts: pa.Array) -> pa.Array:
        known: np.ndarray = vocabulary.value
        sizes, terms, tfs, cuts = [], [], [], [np.zeros(1, np.int64)]
        for lo, hi, rows, hashes in term_hashes(texts):
            sizes.append(np.bincount(rows, minlength=hi - lo))
            place = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            held = known[place] == hashes if len(known) else np.zeros(len(hashes), dtype=bool)
            pairs, tf = np.unique(rows[held] * len(known) + place[held], return_counts=True)
            terms.append(pairs % max(len(known), 1))
            tfs.append(tf)
            ends = np.searchsorted(pairs, np.arange(1, hi - lo + 1) * len(known))
            cuts.append(ends + cuts[-1][-1])
        gather = lambda parts, kind: np.concatenate([*parts, np.zeros(0)]).astype(kind)
        offsets = pa.array(np.concatenate(cuts).astype(np.int32))
        columns = [
            pa.array(gather(sizes, np.int64)),
            pa.ListArray.from_arrays(offsets, pa.array(gather(terms, np.int32))),
            pa.ListArray.from_arrays(offsets, pa.array(gather(tfs, np.int32))),
        ]
        return pa.StructArray.from_arrays(columns, ["n", "terms", "tfs"])

    return arrow_udf(vectors, "struct<n:bigint,terms:array<int>,tfs:array<int>>")


@dataclass
class Items:
    """A block of items: its vocabulary, and the terms of each item as places in it, one item after another."""

    keys: list
    vocabulary: np.ndarray
    terms: np.ndarray
    firsts: np.ndarray
    weights: np.ndarray | None = None


def _items(rows: list) -> Items:
    """``rows`` of (key, text); items without terms are left out."""
    keys, lists = [], []
    for lo, hi, of, hashes in term_hashes(pa.array([r[1] for r in rows], pa.string())):
        cuts = np.searchsorted(of, np.arange(hi - lo + 1))
        for i in range(hi - lo):
            if cuts[i + 1] > cuts[i]:
                keys.append(rows[lo + i][0])
                lists.append(np.unique(hashes[cuts[i] : cuts[i + 1]]))
    vocabulary = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint64)
    firsts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    terms = np.searchsorted(vocabulary, np.concatenate(lists)) if lists else np.zeros(0, np.int64)
    return Items(keys, vocabulary, terms, firsts)


def blocks(items: DataFrame, key: str, text: str, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items in blocks, each on the driver for its own search only."""
    rows = items.select(column(items, key).alias("key"), column(items, text).alias("text")).distinct()
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(TERM)))).first()[0] or 0
    n = 1 if total <= block_words else math.ceil(2 * total / block_words)
    for block in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == block)
        found = _items(sorted(map(tuple, part.collect()), key=str))
        if found.keys:
            yield found


def impacts(tfs: np.ndarray, m: int) -> np.ndarray:
    return (TF_SCALE * tfs) // (TF_PART * tfs + M_PART * m)


# -- index ----------------------------------------------------------------------------------------------------


def _segments(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Segments of rows (key, m, terms, tfs) that come ordered by ``m``."""
    for batch in batches:
        ms, keys = batch.column(1).to_numpy(), batch.column(0)
        offsets, terms = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy()
        tfs = batch.column(3).values.to_numpy()
        edges = np.flatnonzero(np.diff(ms)) + 1
        begins = [0, *edges.tolist()]
        for first, end in zip(begins, [*begins[1:], len(ms)]):
            for lo in range(first, end, size):
                hi = min(end, lo + size)
                a, b = offsets[lo], offsets[hi]
                if a == b:
                    continue
                place = np.repeat(np.arange(hi - lo), np.diff(offsets[lo : hi + 1]))
                term, tf = terms[a:b], tfs[a:b]
                order = np.lexsort((place, -tf, term))
                names, starts = np.unique(term[order], return_index=True)
                row = [
                    pa.array([int(ms[lo])], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), keys[lo:hi]),
                    *(
                        pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x.astype(np.int32)))
                        for x in (names, tf[order][starts], np.append(starts, b - a), tf[order], place[order])
                    ),
                ]
                yield pa.RecordBatch.from_arrays(row, ["m", "keys", "terms", "tops", "starts", "tfs", "places"])


@dataclass
class Index:
    """Segments, and what the corpus says: ``n_docs``, ``n_words`` and the frequency of each term of the vocabulary."""

    segments: DataFrame
    n_docs: int
    n_words: int
    frequencies: np.ndarray


def build(docs: DataFrame, vocabulary: np.ndarray, key: str = "doc_id", text: str = "text", segment: int = SEGMENT) -> Index:
    """The index of all documents, with postings for the terms of ``vocabulary`` (sorted hashes)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(column(docs, key).alias("key"), _vectors(shared)(column(docs, text)).alias("v"))
    rows = materialize(rows.select("key", "v.*").where("n > 0"), "lexical-vectors")
    n_docs, n_words = rows.agg(F.count("*"), F.sum("n")).first()
    frequencies = np.zeros(len(vocabulary), np.int64)
    if n_docs:
        counted = rows.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
        frequencies[counted["term"].to_numpy()] = counted["count"].to_numpy()
    m = F.expr(f"{LEAST_M} + ({SLOPE} * n * {n_docs}L) div {n_words or 1}L")
    ordered = rows.where(F.size("terms") > 0).select("key", m.cast("long").alias("m"), "terms", "tfs")
    # Range partitions split a stratum that is full, by the hash of its rows.
    ordered = ordered.withColumn("spread", F.xxhash64("key", F.rand(7)))
    ordered = ordered.repartitionByRange("m", "spread").sortWithinPartitions("m", "key").drop("spread")
    ints = ArrayType(IntegerType(), False)
    kind = StructType([StructField("m", LongType()), StructField("keys", ArrayType(rows.schema["key"].dataType))])
    for name in ("terms", "tops", "starts", "tfs", "places"):
        kind = kind.add(name, ints)
    cut = ordered.mapInArrow(lambda batches: _segments(batches, segment), kind)
    segments = materialize(cut.withColumn("segment", F.monotonically_increasing_id()), "lexical-index")
    return Index(segments, n_docs, n_words or 0, frequencies)


def weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in frequencies.tolist()], np.int64)


# -- search ---------------------------------------------------------------------------------------------------


def _gains(items: Items, m: int, terms: np.ndarray, tops: np.ndarray) -> np.ndarray:
    """Bound of the scores of each item in a segment."""
    most = np.zeros(len(items.vocabulary) + 1, np.int64)
    most[terms] = items.weights[terms] * impacts(tops.astype(np.int64), m)
    return np.add.reduceat(most[items.terms], items.firsts[:-1])


def _bounds(shared, seeds: int):
    """Segments with the highest bounds of each item, the best of one task."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        n = len(items.keys)
        tops = np.zeros((0, n), np.int64)
        ids = np.zeros((0, n), np.int64)
        for batch in batches:
            bounds, own = [], []
            for i, m in enumerate(batch.column(1).to_pylist()):
                term, top = (np.asarray(batch.column(c)[i].values) for c in (2, 3))
                bounds.append(_gains(items, m, term, top))
                own.append(np.full(n, batch.column(0)[i].as_py()))
            tops, ids = np.concatenate([tops, np.array(bounds).reshape(-1, n)]), np.concatenate([ids, np.array(own).reshape(-1, n)])
            order = np.argsort(-tops, axis=0, kind="stable")[:seeds]
            tops, ids = np.take_along_axis(tops, order, 0), np.take_along_axis(ids, order, 0)
        at, item = np.nonzero(tops)
        columns = [pa.array(item.astype(np.int32)), pa.array(ids[at, item]), pa.array(tops[at, item])]
        yield pa.RecordBatch.from_arrays(columns, ["item", "segment", "bound"])

    return best


def _merge(kept: list, more: list, first: int) -> list:
    return sorted([*kept, *more], key=lambda r: (-r[0], r[1] is not None, r[1] if r[1] is not None else 0))[:first]


def _scores(items: Items, m: int, size: int, arrays: tuple, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each wanted item and its scores of the documents of a segment; postings are put together some items at a time."""
    terms, starts, tfs, places = arrays
    levels, level = np.unique(tfs, return_inverse=True)
    counts = np.diff(starts)
    gains = np.repeat(items.weights[terms], counts) * impacts(levels.astype(np.int64), m)[level]
    spot = np.full(len(items.vocabulary), -1, np.int64)
    spot[terms] = np.arange(len(terms))
    sizes = np.diff(items.firsts)[wanted]
    owner = np.repeat(np.arange(len(wanted)), sizes)
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = spot[items.terms[np.repeat(items.firsts[:-1][wanted], sizes) + inside]]
    owner, at = owner[at >= 0], at[at >= 0]
    postings = counts[at]
    load = np.cumsum(np.bincount(owner, weights=postings, minlength=len(wanted)) + size)
    group = (load // GATHERED).astype(np.int64)
    for g in np.unique(group):
        members = np.flatnonzero(group == g)
        lo, hi = members[0], members[-1] + 1
        mine = (owner >= lo) & (owner < hi)
        n, first = postings[mine], starts[at[mine]]
        posting = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        total = np.zeros((hi - lo) * size, np.int64)
        np.add.at(total, np.repeat(owner[mine] - lo, n) * size + places[posting], gains[posting])
        for i, row in zip(range(lo, hi), total.reshape(-1, size)):
            yield int(wanted[i]), row


def _best(shared, floors: np.ndarray, first: int):
    """The best documents of each item in the segments of a task, none below its floor."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        floor, kept, key_type = floors.copy(), [[] for _ in items.keys], None
        for batch in batches:
            key_type = batch.schema.field("keys").type.value_type
            ms = batch.column("m").to_pylist()
            part = lambda name, i: np.asarray(batch.column(name)[i].values)  # noqa: B023, E731
            bounds = [_gains(items, m, part("terms", i), part("tops", i)) for i, m in enumerate(ms)]
            for i in sorted(range(len(ms)), key=lambda i: -int(bounds[i].max())):  # noqa: B023
                wanted = np.flatnonzero((bounds[i] >= floor) & (bounds[i] > 0))
                if not len(wanted):
                    continue
                keys = batch.column("keys")[i].values
                arrays = tuple(part(name, i) for name in ("terms", "starts", "tfs", "places"))
                for item, scores in _scores(items, ms[i], len(keys), arrays, wanted):
                    good = np.flatnonzero(scores >= max(1, floor[item]))
                    if len(good):
                        # Keys of a segment are in order, so of equal scores the first places come first.
                        good = good[np.argsort(-scores[good], kind="stable")[:first]]
                        names = keys.take(pa.array(good)).to_pylist()
                        kept[item] = _merge(kept[item], list(zip(scores[good].tolist(), names)), first)
                        if len(kept[item]) == first:
                            floor[item] = max(floor[item], kept[item][-1][0])
        rows = [(item, *row) for item, found in enumerate(kept) for row in found]
        if rows:
            item, score, key = zip(*rows)
            columns = [pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(key, key_type)]
            yield pa.RecordBatch.from_arrays(columns, ["item", "score", "key"])

    return best


def _ranked(found: DataFrame, first: int) -> DataFrame:
    order = W.partitionBy("item").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)


def search(index: Index, items: Items, first: int = FIRST, seeds: int = SEEDS) -> DataFrame:
    """``item`` (its place in ``items``), ``rank``, ``key`` and ``score`` of the best documents."""
    segments, spark = index.segments, index.segments.sparkSession
    items.weights = weights(index.n_docs, index.frequencies)
    shared = spark.sparkContext.broadcast(items)
    bounds = segments.select("segment", "m", "terms", "tops").mapInArrow(
        _bounds(shared, seeds), "item int, segment long, bound long"
    )
    order = W.partitionBy("item").orderBy(F.desc("bound"), "segment")
    top = bounds.withColumn("place", F.row_number().over(order)).where(F.col("place") <= seeds)
    parts = segments.drop("segment")
    kind = StructType([StructField("item", IntegerType()), StructField("score", LongType())])
    kind = kind.add("key", segments.schema["keys"].dataType.elementType)
    floors = np.zeros(len(items.keys), np.int64)
    seeded = segments.join(top.select("segment").distinct(), "segment", "left_semi").drop("segment")
    for row in _ranked(seeded.mapInArrow(_best(shared, floors, first), kind), first).where(F.col("rank") == first).collect():
        floors[row["item"]] = row["score"]
    return _ranked(parts.mapInArrow(_best(shared, floors, first), kind), first)


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    first: int = FIRST,
    block_words: int = BLOCK_WORDS,
    segment: int = SEGMENT,
    seeds: int = SEEDS,
) -> DataFrame:
    """The ``first`` best documents of each item: ``item_id, rank, doc_id, score`` (ids under these names)."""
    spark, item_type, key_type = docs.sparkSession, items.schema[item_key].dataType, docs.schema[key].dataType
    kind = StructType([StructField("item_id", item_type), StructField("rank", IntegerType())])
    kind = kind.add("doc_id", key_type).add("score", LongType())
    out = None
    for block in blocks(items, item_key, item_text, block_words):
        found = search(build(docs, block.vocabulary, key, text, segment), block, first, seeds)
        names = StructType([StructField("item", IntegerType()), StructField("item_id", item_type)])
        names = spark.createDataFrame(list(enumerate(block.keys)), names)
        rows = found.join(names, "item").select("item_id", "rank", F.col("key").alias("doc_id"), "score")
        out = rows if out is None else out.unionAll(rows)
    return spark.createDataFrame([], kind) if out is None else out


def op13_lexical_search(spark, folder):
    return ranked_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
corpus AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_words FROM sizes),
i AS (
  SELECT item, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term
  FROM (SELECT row_number() OVER () AS item, item_id, text FROM (SELECT DISTINCT item_id, text FROM benchmark))
  WHERE text IS NOT NULL),
postings AS (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM d)
  WHERE term IN (SELECT term FROM i) GROUP BY row, term),
terms AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM postings, corpus GROUP BY term),
scores AS (
  SELECT i.item, i.item_id, s.row, s.doc_id, CAST(sum(t.weight * ((1000000000 * p.tf)
           // (1000 * p.tf + 8 * (10 + (90 * s.n * c.n_docs) // c.n_words)))) AS BIGINT) AS score
  FROM i JOIN terms t ON i.term = t.term JOIN postings p ON p.term = i.term
         JOIN sizes s ON s.row = p.row, corpus c
  GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS rank
      FROM scores WHERE score > 0)
WHERE rank <= 10
"""
