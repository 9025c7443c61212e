"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items make one automaton that accepts every run of words of one item. The words of a document are
streamed through it; the automaton keeps the longest run of the last words that some item holds. Whenever that run
reaches a window (``window`` words, or a whole item that is shorter), the words of the window are hit.

Only words that stand in runs of word pairs known from the items are streamed: elsewhere the longest match is shorter
than two words, which the pair table says without the automaton.

The automaton is broadcast. Its size is bounded by ``SHARD_WORDS`` words of items; more items make more shards, which
are scanned one after another, each adding to the spans found so far.

Defined cases: a null or empty text has no words and no hits; an item without words has no window; items that share
a window all count; equal item ids count once; a null item id is ignored in the list but its windows hit; an empty
table of items hits nothing. Rows are kept as they are, whatever other columns they have.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.llm.automaton import SuffixAutomaton
from custlens.llm.common import column, documents, free_name
from custlens.llm.textbytes import ALNUM, Rolling, buffers, lower_ascii, slices, words

WINDOW = 10
SHARD_WORDS = 400_000
# Limits beyond which clean_text drops a whole document instead of cutting the spans out.
MOST_COVERAGE = 0.5

KIND = "struct<n_words:bigint,starts:array<int>,ends:array<int>,froms:array<int>,tos:array<int>,items:array<string>>"


class ItemAutomaton:
    """The windows of some items, ready to be found in streams of word hashes."""

    def __init__(self, items: list[tuple[str | None, list[int]]], window: int):
        self.window = window
        vocabulary = np.unique(np.array([h for _, hashes in items for h in hashes], np.uint64))
        self.vocabulary = vocabulary
        ids = [(name, np.searchsorted(vocabulary, np.array(h, np.uint64)).tolist()) for name, h in items]
        self.shortest = min((min(window, len(w)) for _, w in ids if w), default=window)
        pairs = [a * len(vocabulary) + b for _, w in ids for a, b in zip(w, w[1:])]
        self.pairs = np.unique(np.array(pairs, np.int64))
        automaton = SuffixAutomaton()
        for _, symbols in ids:
            automaton.add(symbols)
        self.automaton = automaton
        # By state: items that hold the window; by state: lengths and names of whole short items.
        self.windows: dict[int, set] = {}
        self.whole: dict[int, dict[int, set]] = {}
        for name, symbols in ids:
            state = matched = 0
            for symbol in symbols:
                state, matched = automaton.step(state, matched, symbol)
                if matched >= window:
                    self.windows.setdefault(self._holding(state, window), set()).add(name)
            if 0 < len(symbols) < window:
                home = self._holding(state, len(symbols))
                self.whole.setdefault(home, {}).setdefault(len(symbols), set()).add(name)

    def _holding(self, state: int, length: int) -> int:
        """The state of the last ``length`` symbols of what ``state`` stands for."""
        link, lengths = self.automaton.link, self.automaton.length
        while lengths[link[state]] >= length:
            state = link[state]
        return state

    def candidates(self, hashes: np.ndarray, rows: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Stretches of words, as first word and item word ids, that are long enough to hold a window."""
        if not len(self.vocabulary) or not len(hashes):
            return []
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == hashes
        if self.shortest == 1:
            joined = known[:-1] & known[1:] & (rows[:-1] == rows[1:])
        else:
            pair = place[:-1] * len(self.vocabulary) + place[1:]
            spot = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined = known[:-1] & known[1:] & (rows[:-1] == rows[1:]) & (self.pairs[spot] == pair)
        edges = np.diff(np.concatenate([[False], joined, [False]]).astype(np.int8))
        firsts, lasts = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        long = lasts - firsts + 1 >= self.shortest
        out = [(int(a), place[a : b + 1]) for a, b in zip(firsts[long], lasts[long])]
        if self.shortest == 1:  # single words that stand between unknown ones
            alone = known & ~np.concatenate([[False], joined]) & ~np.concatenate([joined, [False]])
            out += [(int(a), place[a : a + 1]) for a in np.flatnonzero(alone)]
        return out

    def hits(self, symbols: np.ndarray) -> tuple[list[tuple[int, int]], set]:
        """Ranges of words that windows cover, and the items whose windows occur."""
        window, link = self.window, self.automaton.link
        ranges: list[tuple[int, int]] = []
        found: set = set()
        state = matched = 0
        for i, symbol in enumerate(symbols.tolist()):
            state, matched = self.automaton.step(state, matched, symbol)
            size = 0
            if matched >= window:
                found |= self.windows[self._holding(state, window)]
                size = window
            up = state if self.whole else 0
            while up:
                for length, names in self.whole.get(up, {}).items():
                    if length <= matched:
                        found |= names
                        size = max(size, length)
                up = link[up]
            if size:
                ranges.append((i + 1 - size, i + 1))
        return ranges, found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def item_words(texts: list[str | None]) -> list[list[int]]:
    raw, places = buffers(pa.array(texts, pa.string()))
    raw = lower_ascii(raw)
    rows, starts, ends = words(raw, places, ALNUM)
    hashes = Rolling(raw).hashes(starts, ends)
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    return [hashes[a:b].tolist() for a, b in zip(cuts, cuts[1:])]


def _scanner(shared, first: bool):
    """Spans of one shard, added to those of the shards before."""

    def scan(texts: pa.Array, sofar: pa.Array | None) -> pa.Array:
        known: ItemAutomaton = shared.value
        before = sofar.to_pylist() if sofar is not None else [None] * len(texts)
        raw, places = buffers(texts)
        out = []
        for lo, hi in slices(places):
            part, own = lower_ascii(raw[places[lo] : places[hi]]), places[lo : hi + 1] - places[lo]
            rows, starts, ends = words(part, own, ALNUM)
            counts = np.bincount(rows, minlength=hi - lo)
            firsts = np.concatenate([[0], np.cumsum(counts)])
            spans: dict[int, list] = {}
            names: dict[int, set] = {}
            for a, symbols in known.candidates(Rolling(part).hashes(starts, ends), rows):
                ranges, found = known.hits(symbols)
                if ranges:
                    row = int(rows[a])
                    spans.setdefault(row, []).extend((a + x, a + y) for x, y in ranges)
                    names.setdefault(row, set()).update(found)
            for row in range(hi - lo):
                old = before[lo + row] or {"starts": [], "ends": [], "items": []}
                mine = [(x - firsts[row], y - firsts[row]) for x, y in spans.get(row, [])]
                merged = _merged(list(zip(old["starts"], old["ends"])) + mine)
                base, shift = own[row], firsts[row]
                out.append(
                    {
                        "n_words": int(counts[row]),
                        "starts": [int(x) for x, _ in merged],
                        "ends": [int(y) for _, y in merged],
                        "froms": [int(starts[shift + x] - base) for x, _ in merged],
                        "tos": [int(ends[shift + y - 1] - base) for _, y in merged],
                        "items": sorted(set(old["items"]) | {n for n in names.get(row, ()) if n is not None}),
                    }
                )
        kinds = [("n_words", pa.int64())]
        kinds += [(n, pa.list_(pa.int32())) for n in ("starts", "ends", "froms", "tos")]
        return pa.array(out, pa.struct([*kinds, ("items", pa.list_(pa.string()))]))

    if first:

        @arrow_udf(KIND)
        def scan_first(texts: pa.Array) -> pa.Array:
            return scan(texts, None)

        return scan_first

    @arrow_udf(KIND)
    def scan_more(texts: pa.Array, sofar: pa.Array) -> pa.Array:
        return scan(texts, sofar)

    return scan_more


def _shards(items: DataFrame, key: str, text: str, window: int, shard_words: int):
    """Automata of the items, one shard at a time; each shard has a bounded number of words, save one longer item."""
    rows = items.select(column(items, key).cast("string").alias("key"), column(items, text).alias("text"))
    total = rows.agg(F.sum(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))).first()[0] or 0
    n = max(1, math.ceil(2 * total / shard_words)) if total > shard_words else 1
    for shard in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("key", "text"), F.lit(n)) == shard)
        got = part.collect()
        yield ItemAutomaton(list(zip([r["key"] for r in got], item_words([r["text"] for r in got]))), window)


def find(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
) -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: the merged hits of each document.

    It holds ``n_words``, hit words ``starts`` / ``ends``, the same as bytes ``froms`` / ``tos`` and ``items``.
    """
    name = free_name(docs, "hits")
    out = docs
    for shard in _shards(items, item_key, item_text, window, shard_words):
        shared = docs.sparkSession.sparkContext.broadcast(shard)
        if name in out.columns:
            out = out.withColumn(name, _scanner(shared, False)(column(docs, text), F.col(name)))
        else:
            out = out.withColumn(name, _scanner(shared, True)(column(docs, text)))
    return out, name


def hit_words(hits: Column) -> Column:
    pairs = F.arrays_zip(hits["starts"], hits["ends"])
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])


def _without(texts: pa.Array, froms: pa.Array, tos: pa.Array) -> pa.Array:
    out = []
    for text, a, b in zip(texts.to_pylist(), froms.to_pylist(), tos.to_pylist()):
        if text is not None and a:
            raw, kept, at = text.encode(), [], 0
            for first, last in zip(a, b):
                kept.append(raw[at:first])
                at = last
            text = b"".join([*kept, raw[at:]]).decode()
        out.append(text)
    return pa.array(out, pa.string())


def decontaminate(
    docs: DataFrame, items: DataFrame, text: str = "text", most_coverage: float = MOST_COVERAGE, **options
) -> DataFrame:
    """``docs`` without the hit spans; a document hit on more than ``most_coverage`` of its words goes entirely."""
    found, name = find(docs, items, text, **options)
    hits = F.col(name)
    kept = found.where(hit_words(hits) <= F.lit(most_coverage) * hits["n_words"])
    cut = F.when(F.size(hits["starts"]) > 0, arrow_udf(_without, "string")(column(docs, text), hits["froms"], hits["tos"]))
    cut = cut.otherwise(column(docs, text))
    return kept.select(*(column(docs, c) if c != text else cut.alias(text) for c in docs.columns))


def op6_decontamination(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    found, name = find(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))
    hits = F.col(name)
    listed = F.array_join(F.array_sort(hits["items"]), ",")
    return found.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        hit_words(hits).alias("n_hit"),
        F.size(hits["items"]).cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (F.size(hits["starts"]) > 0).alias("contaminated"),
    )




OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k + 1 : k + n], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(len(w) - n + 1)) AS k
        FROM (SELECT item_id, w, least(10, len(w)) AS n FROM i) WHERE n > 0)),
hits AS (
  SELECT g.doc_id, g.n, g.k, x.item_id
  FROM (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS g
        FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS k
              FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)) g
  JOIN windows x ON g.n = x.n AND g.g = x.g),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items,
         string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS listed
  FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
