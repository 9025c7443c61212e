"""Suffix-array dedup: find strings of ``size`` bytes that stand more than once, and cut them out.

Anchors bring together what may be equal. In each window of ``size`` bytes the least of its ``GRAM``-byte hashes is its
anchor; equal windows have equal anchors, and all windows of one anchor lie side by side, so they make one context of
``size`` bytes up to twice as many. Contexts are grouped by anchor:

* anchors that stand once are dropped, counted before anything else is moved,
* equal contexts are one from there on, counted with partial sums,
* the different contexts of one anchor are put one after another and their windows ranked by their first ``size`` bytes
  with prefix doubling. Ties are in order of position, so a window whose neighbour before it has the same rank is a later
  copy, and one whose neighbour after it has the same rank has a later copy. This replaces longest-previous-factor arrays: no
  previous or next smaller positions and no lengths are computed, as only reaching ``size`` counts,
* an anchor with more than ``CROWD`` different contexts is never put into one task. Its contexts are taken as texts of their own
  and go through the same steps with anchors of ``longer`` strings, which fewer of them share, until an anchor is a whole
  window: then all windows of an anchor are equal, and they are counted with partial sums.

``keep="first"`` leaves the first copy (by key, then by place), ``keep="none"`` removes all.

Defined cases: a null text is empty; a text shorter than ``size`` has no windows; rows that are equal in text are copies
of each other also if they share their key; rows are told apart by their key and a hash of their text, so a row repeated
whole counts twice and is removed whole; a string may overlap its own copy; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.llm.common import column, documents, small_batches
from custlens.llm.textbytes import Rolling, buffers, slices
from custlens.session import materialize

SIZE = 200
GRAM = 24
CROWD = 2000
# Bytes of contexts that are sorted at a time.
BATCH_BYTES = 1_500_000
_SLICE_BYTES = 1_000_000
_PLACE_BITS = np.uint64(31)
_PLACE = np.uint64((1 << 31) - 1)

ANCHORS = "array<struct<h:bigint,ctx:bigint,at:int,n:int>>"
_ANCHOR_TYPE = pa.list_(pa.struct([("h", pa.int64()), ("ctx", pa.int64()), ("at", pa.int32()), ("n", pa.int32())]))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def longer(gram: int, size: int) -> int:
    """The length of the anchors that part a crowd of anchors of ``gram`` bytes."""
    return min(size, 2 * gram + 8)


def _anchors(data: np.ndarray, places: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, anchor hash, context hash, first window (in its text) and number of windows of every context."""
    empty = np.zeros(0, np.int64)
    if len(data) < size:
        return empty, empty, empty, empty, empty
    rolling = Rolling(data)
    starts = np.arange(len(data) - gram + 1)
    hashes = rolling.hashes(starts, starts + gram)
    keys = (hashes >> _PLACE_BITS << _PLACE_BITS) | starts.astype(np.uint64)
    anchor = (_sliding_min(keys, size - gram + 1) & _PLACE).astype(np.int64)
    row = np.searchsorted(places, np.arange(len(anchor)), side="right") - 1
    valid = np.arange(len(anchor)) + size <= places[1:][row]
    edge = np.ones(len(anchor) + 1, dtype=bool)
    edge[1:-1] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1]) | (valid[1:] != valid[:-1])
    bounds = np.flatnonzero(edge)
    first, last = bounds[:-1], bounds[1:]
    first, last = first[valid[first]], last[valid[first]]
    contexts = rolling.hashes(first, last - 1 + size)
    rows = row[first]
    return rows, hashes[anchor[first]].view(np.int64), contexts.view(np.int64), first - places[rows], last - first


def _anchor_lists(size: int, gram: int):
    def anchors(texts: pa.Array) -> pa.Array:
        data, places = buffers(texts)
        out = []
        for lo, hi in slices(places, _SLICE_BYTES):
            own = places[lo : hi + 1] - places[lo]
            rows, h, ctx, at, n = _anchors(data[places[lo] : places[hi]], own, size, gram)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=hi - lo))]).astype(np.int32)
            columns = [pa.array(h), pa.array(ctx), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))]
            inner = pa.StructArray.from_arrays(columns, ["h", "ctx", "at", "n"])
            out.append(pa.ListArray.from_arrays(pa.array(offsets), inner).cast(_ANCHOR_TYPE))
        return pa.concat_arrays(out) if out else pa.array([], _ANCHOR_TYPE)

    return anchors


def _pieces(texts: pa.Array, ats: pa.Array, ends: pa.Array) -> pa.Array:
    out = []
    for text, firsts, lasts in zip(texts.to_pylist(), ats.to_pylist(), ends.to_pylist()):
        raw = text if isinstance(text, bytes) else (text or "").encode()
        out.append([raw[a:b] for a, b in zip(firsts, lasts)])
    return pa.array(out, pa.list_(pa.binary()))


# -- suffix arrays ------------------------------------------------------------------------------------------------


def window_ranks(data: np.ndarray, size: int) -> np.ndarray:
    """Rank of the ``size`` bytes from each position on among all of them, by doubling; ``data`` must be padded by ``size``."""
    n = len(data) - size
    rank, known = data.astype(np.int64), 1
    while known < size:
        step = min(known, size - known)
        # Known bytes from here and known bytes ending where the longer string ends; they may overlap.
        key = rank[: len(rank) - step] * np.int64(rank.max() + 1) + rank[step:]
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        known += step
    return rank[:n]


def copies(contexts: list[bytes], size: int, keep_first: bool) -> list[list[tuple[int, int]]]:
    """For each context, in order of first appearance, the ranges of windows that are (later) copies of others."""
    joined = np.frombuffer(b"".join(contexts) + bytes(size), np.uint8)
    lengths = np.array([len(c) for c in contexts])
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    counts = lengths - size + 1
    owner = np.repeat(np.arange(len(contexts)), counts)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    windows = begins[owner] + np.arange(len(owner)) - firsts[owner]
    rank = window_ranks(joined, size)[windows]
    suffixes = np.argsort(rank, kind="stable")  # ties by position
    ordered = rank[suffixes]
    previous = np.concatenate([[False], ordered[1:] == ordered[:-1]])  # the previous smaller position reaches size
    marked = np.zeros(len(owner), dtype=bool)
    marked[suffixes] = previous if keep_first else previous | np.concatenate([previous[1:], [False]])
    out: list[list[tuple[int, int]]] = [[] for _ in contexts]
    edges = np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8))
    for a, b in zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()):
        while a < b:  # a run may reach into the next context
            stop = min(b, int(firsts[owner[a] + 1]))
            out[owner[a]].append((a - int(firsts[owner[a]]), stop - int(firsts[owner[a]])))
            a = stop
    return out


def _sorted_groups(size: int, keep_first: bool):
    """Rows ``h, ctx, piece``, sorted by ``h`` and first appearance, to ``h, ctx, froms, tos``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        bytes_held = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bytes_held >= BATCH_BYTES and held[-1][0] != row[0]:
                    yield from done(held)
                    held, bytes_held = [], 0
                held.append(row)
                bytes_held += len(row[2])
        if held:
            yield from done(held)

    def done(held):
        rows = []
        for (h, ctx, _), spans in zip(held, copies([p for _, _, p in held], size, keep_first)):
            if spans:
                rows.append({"h": h, "ctx": ctx, "froms": [a for a, _ in spans], "tos": [b for _, b in spans]})
        ints = pa.list_(pa.int32())
        kind = pa.schema([("h", pa.int64()), ("ctx", pa.int64()), ("froms", ints), ("tos", ints)])
        yield pa.RecordBatch.from_pylist(rows, kind)

    return run


def _crowds(pieces: DataFrame, size: int, keep: str, crowd: int, gram: int) -> DataFrame:
    """The same answer for ``h, ctx, order, piece`` of crowded anchors, each piece taken as a text, by anchors of ``gram`` bytes."""
    found = spans(pieces.select(F.struct("order", "h", "ctx").alias("row"), F.col("piece").alias("text")), size, keep, crowd, gram)
    return found.select("row.h", "row.ctx", "froms", F.transform("tos", lambda to: to - size + 1).alias("tos"))


# -- the operator ------------------------------------------------------------------------------------------------


def spans(rows: DataFrame, size: int = SIZE, keep: str = "none", crowd: int = CROWD, gram: int = GRAM) -> DataFrame:
    """``row, froms, tos`` of the rows ``row, text`` that hold bytes to remove; ranges may touch and overlap."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    first, gram = keep == "first", min(gram, size)
    spark = rows.sparkSession
    with small_batches(spark):
        listed = arrow_udf(_anchor_lists(size, gram), ANCHORS)(F.col("text"))
        anchors = materialize(rows.select("row", F.explode(listed).alias("a")).select("row", "a.*"), "anchors")
        twice = anchors.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
        anchors = materialize(anchors.join(twice, "h"), "repeated-anchors")
        order = F.struct("row", "at")
        contexts = anchors.groupBy("h", "ctx").agg(
            F.count("*").alias("c"), F.min(order).alias("order"), F.max("n").alias("n")
        )
        contexts = materialize(contexts, "contexts")
        # Groups with several contexts, some of which are not known yet to be copies.
        groups = contexts.groupBy("h").agg(F.count("*").alias("d"), F.min("c").alias("least"))
        unsure = groups.where((F.col("d") > 1) & ((F.col("least") == 1) | F.lit(first))).select("h", "d")
        wanted = contexts.join(unsure, "h")
        by_row = wanted.groupBy(F.col("order.row").alias("row")).agg(
            F.collect_list(F.struct("h", "ctx", "d", "order", (F.col("order.at") + F.col("n") - 1 + size).alias("end"))).alias("c")
        )
        cut = arrow_udf(_pieces, "array<binary>")(F.col("text"), F.col("c.order.at"), F.col("c.end"))
        pieces = rows.join(by_row, "row").select(F.explode(F.arrays_zip(F.col("c"), cut.alias("piece"))).alias("z"))
        pieces = pieces.select("z.c.h", "z.c.ctx", "z.c.d", "z.c.order", "z.piece")
        pieces = materialize(pieces, "pieces")
        sorted_ = (
            (pieces.where(F.col("d") <= crowd) if gram < size else pieces)
            .repartition("h")
            .sortWithinPartitions("h", "order")
            .select("h", "ctx", "piece")
            .mapInArrow(_sorted_groups(size, first), "h long, ctx long, froms array<int>, tos array<int>")
        )
        crowded = pieces.where(F.col("d") > crowd)
        if gram < size and not crowded.isEmpty():
            sorted_ = sorted_.unionByName(_crowds(crowded, size, keep, crowd, longer(gram, size)))
        found = materialize(sorted_, "copied-windows")
    # The first of equal contexts is a copy only as far as found; the others, and with keep="none" all, are whole.
    known = contexts.where((F.col("c") > 1)).select("h", "ctx", F.col("order").alias("first"))
    whole = anchors.join(known, ["h", "ctx"])
    if first:
        whole = whole.where(F.struct("row", "at") != F.col("first"))
    whole = whole.select("row", F.col("at").alias("from"), (F.col("at") + F.col("n") - 1 + size).alias("to"))
    part = anchors if not first else anchors.join(contexts.select("h", "ctx", F.col("order").alias("o")), ["h", "ctx"]).where(
        F.struct("row", "at") == F.col("o")
    )
    part = part.join(found, ["h", "ctx"]).select("row", "at", F.explode(F.arrays_zip("froms", "tos")).alias("s"))
    part = part.select(
        "row", (F.col("at") + F.col("s.froms")).alias("from"), (F.col("at") + F.col("s.tos") - 1 + size).alias("to")
    )
    return (
        whole.unionByName(part)
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("s"))
        .select("row", F.col("s.from").alias("froms"), F.col("s.to").alias("tos"))
    )


def _merged(firsts: list[int], lasts: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in zip(firsts, lasts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _remains(texts: pa.Array, froms: pa.Array, tos: pa.Array) -> pa.Array:
    out = []
    for text, firsts, lasts in zip(texts.to_pylist(), froms.to_pylist(), tos.to_pylist()):
        raw, kept, at = (text or "").encode(), [], 0
        spans = _merged(firsts or [], lasts or [])
        for a, b in spans:
            kept.append(raw[at:a])
            at = b
        left = b"".join([*kept, raw[at:]])
        out.append({"n_bytes": len(raw), "n_spans": len(spans), "kept": left})
    return pa.array(out, pa.struct([("n_bytes", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())]))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: ``key, n_bytes, n_spans, kept`` (the bytes that are left)."""
    row = F.struct(column(docs, key).alias("key"), F.xxhash64(column(docs, text)).alias("hash"))
    rows = docs.select(row.alias("row"), column(docs, key).alias("key"), column(docs, text).alias("text"))
    found = spans(rows.select("row", "text"), **options)
    left = arrow_udf(_remains, "struct<n_bytes:bigint,n_spans:bigint,kept:binary>")
    joined = rows.join(found, "row", "left")
    return joined.select(F.col("key").alias(key), left(F.col("text"), F.col("froms"), F.col("tos")).alias("r")).select(key, "r.*")


def op3_suffix_dedup(spark, folder):
    rows = dedup(documents(spark, folder).select("doc_id", "text"))
    return rows.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
