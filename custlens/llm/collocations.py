"""Phrase collocations by prefix-free parsing.

The words of a text are cut into chunks where their content says so: a window of ``OVERLAP`` words whose hash is a multiple
of ``SPACING`` ends one chunk and begins the next, so neighbours share that window and equal passages give equal
chunks wherever they stand. The distinct chunks of a language are its dictionary, each with its frequency in the parse.
Phrases are counted inside distinct chunks, weighted by that frequency. A phrase of up to ``OVERLAP + 1`` words that
begins before the shared window lies whole in its chunk; one that begins inside it belongs to the next chunk. So every
occurrence counts once.

Phrases are counted by length. A phrase can only be frequent if both phrases that lack its first or its last word are; the frequent phrases
of one length become a bitmap of ``FILTER_BITS`` bits, whatever their number, which says without misses which longer phrases to
count. The few that it lets through wrongly are counted and then dropped.

Defined cases: a null or empty text has no words; a null language is ``und``; repeated rows count as often as they
stand there; an empty table gives an empty result; other columns are ignored; a text without any cutting window is
cut every ``LONGEST`` words. Scores are exact: products are decimals of 38 digits. Ties rank by count, then by the
phrase in byte order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from custlens.llm.common import column, documents
from custlens.llm.textbytes import Rolling, buffers, grams, lower_ascii, mixed, slices, words
from custlens.session import materialize

LEAST, MOST_WORDS, FIRST = 100, 5, 2000
OVERLAP = MOST_WORDS - 1
SPACING, LONGEST = 32, 512
FILTER_BITS = 1 << 26
PARTS = 64

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?\n\x0b\x0c\r"]] = True
_INSIDE = ~_ENDS
_INSIDE[[0x20, 0x09]] = False
# In a chunk: a space between words of one piece, a line feed where a piece ends.
SPACE, BREAK = 0x20, 0x0A
_CHUNK_WORD = np.ones(256, dtype=bool)
_CHUNK_WORD[[SPACE, BREAK]] = False
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _normal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words with one byte after each, and where each begins; ``breaks`` says where a piece begins."""
    sizes = ends - starts + 1
    places = np.concatenate([[0], np.cumsum(sizes)])
    source = np.arange(places[-1]) + np.repeat(starts - places[:-1], sizes)
    out = data[np.minimum(source, len(data) - 1)]
    out[places[1:-1] - 1] = np.where(breaks[1:], BREAK, SPACE)
    return out, places


def chunks(texts: pa.Array) -> Iterator[tuple[int, bytes, int]]:
    """Row, chunk and number of words that begin in it before the window shared with the next chunk."""
    raw, places = buffers(texts)
    for lo, hi in slices(places):
        data, own = lower_ascii(raw[places[lo] : places[hi]]), places[lo : hi + 1] - places[lo]
        rows, starts, ends = words(data, own, _INSIDE)
        if not len(rows):
            continue
        seen = np.concatenate([[0], np.cumsum(_ENDS[data], dtype=np.int64)])
        new = np.concatenate([[True], rows[1:] != rows[:-1]])
        breaks = new | np.concatenate([[True], seen[starts[1:]] > seen[ends[:-1]]])
        symbols = Rolling(data).hashes(starts, ends) + breaks.astype(np.uint64) * _SALT
        windows, whole = grams(symbols, rows, OVERLAP)
        cut = new.copy()
        cut[: len(windows)] |= whole & (windows % np.uint64(SPACING) == 0)
        firsts = np.flatnonzero(cut)
        gaps = np.diff(np.append(firsts, len(rows)))
        parts = -(-gaps // LONGEST)  # most are one
        turn = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        firsts = np.repeat(firsts, parts) + turn * LONGEST
        nexts = np.append(firsts[1:], len(rows))
        last_of_row = np.searchsorted(rows, rows[firsts], side="right")
        lasts = np.minimum(nexts + OVERLAP, last_of_row)
        text, begins = _normal(data, starts, ends, breaks)
        text = text.tobytes()
        owned = (nexts - firsts).tolist()
        for row, a, b, n in zip((rows[firsts] + lo).tolist(), begins[firsts].tolist(), (begins[lasts] - 1).tolist(), owned):
            yield row, text[a:b], n


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(0).to_pylist()
        found = Counter((langs[row], chunk, n) for row, chunk, n in chunks(batch.column(1)))
        if found:
            lang, chunk, own = zip(*found)
            columns = [pa.array(lang), pa.array(chunk, pa.binary()).cast(pa.string()), pa.array(own, pa.int64())]
            columns.append(pa.array(list(found.values()), pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "own", "times"])


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The distinct chunks of each language: ``lang, chunk, own, times``."""
    rows = docs.select(F.coalesce(column(docs, lang), F.lit("und")).alias("lang"), column(docs, text).alias("text"))
    parsed = rows.mapInArrow(_parse, "lang string, chunk string, own long, times long")
    return parsed.groupBy("lang", "chunk", "own").agg(F.sum("times").alias("times"))


def _salts(langs: pa.Array) -> np.ndarray:
    """A number for each language, to be mixed into the hashes of its phrases."""
    raw, places = buffers(langs.cast(pa.string()))
    return mixed(Rolling(raw).hashes(places[:-1], places[1:]))


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    places = _places(keys)
    return (bits[places >> 6] >> (places & 63).astype(np.uint64)) & np.uint64(1) == 1


def _counter(size: int, shared):
    """Weighted counts of the phrases of ``size`` words whose two shorter phrases the bitmap knows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, places = buffers(batch.column(1))
            rows, starts, ends = words(raw, places, _CHUNK_WORD)
            if len(rows) < size:
                continue
            salts, langs = _salts(batch.column(0)), batch.column(0).to_pylist()
            own, times = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            hashes, salt = Rolling(raw), salts[rows]
            first = np.searchsorted(rows, np.arange(len(places) - 1))
            n = len(rows) - size + 1
            taken = (np.arange(n) - first[rows[:n]]) < own[rows[:n]]
            if size > 1:
                joined = (rows[1:] == rows[:-1]) & (raw[ends[:-1]] == SPACE)
                short = n + 1
                whole = np.ones(short, dtype=bool)
                for k in range(size - 2):
                    whole &= joined[k : k + short]
                known = np.zeros(short, dtype=bool)
                at = np.flatnonzero(whole)
                known[at] = _known(shared.value, hashes.hashes(starts[at], ends[at + size - 2]) ^ salt[at])
                taken &= known[:-1] & known[1:] & joined[size - 2 :]
            at = np.flatnonzero(taken)
            if not len(at):
                continue
            keys = hashes.hashes(starts[at], ends[at + size - 1]) ^ salt[at]
            _, one, group = np.unique(keys, return_index=True, return_inverse=True)
            sums = np.zeros(len(one), np.int64)
            np.add.at(sums, group, times[rows[at]])
            text, one = raw.tobytes(), at[one]
            phrases = [text[a:b] for a, b in zip(starts[one].tolist(), ends[one + size - 1].tolist())]
            columns = [pa.array([langs[r] for r in rows[one].tolist()], pa.string())]
            columns += [pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "a"])

    return count


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, places = buffers(batch.column(1))
        bits = np.unique(_places(Rolling(raw).hashes(places[:-1], places[1:]) ^ _salts(batch.column(0))))
        if len(bits):
            slots, firsts = np.unique(bits >> 6, return_index=True)
            marks = np.bitwise_or.reduceat(np.uint64(1) << (bits & 63).astype(np.uint64), firsts)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(marks.view(np.int64))], ["slot", "marks"])


def _bitmap(phrases: DataFrame) -> np.ndarray:
    """One bit for each frequent phrase, in ``FILTER_BITS / 64`` numbers."""
    marked = phrases.select("lang", "phrase").mapInArrow(_marks, "slot long, marks long")
    got = marked.groupBy("slot").agg(F.bit_or("marks").alias("marks")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[got["slot"].to_numpy()] = got["marks"].to_numpy().view(np.uint64)
    return bits


def frequent(parsed: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> DataFrame:
    """Every phrase of up to ``most_words`` words with its count ``a``, if that is ``least`` or more."""
    context, levels, bits = parsed.sparkSession.sparkContext, [], None
    for size in range(1, most_words + 1):
        counted = parsed.mapInArrow(_counter(size, context.broadcast(bits)), "lang string, phrase string, a long")
        level = counted.groupBy("lang", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
        level = materialize(level.withColumn("words", F.lit(size)), f"phrases-{size}")
        levels.append(level)
        bits = _bitmap(level)
        if not bits.any():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionAll(level)
    return out


def score(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Candidates that no longer one of the same count holds, with their lowest-scoring cut."""
    candidates = phrases.where("words > 1")
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("count"))
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, length(left) + 2)"))
    lefts = parts.select("lang", F.col("part").alias("left"), F.col("count").alias("l"))
    rights = parts.select("lang", F.col("part").alias("right"), F.col("count").alias("r"))
    cuts = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"]).join(totals, "lang")
    wide = "cast({} as decimal(19, 0)) * cast({} as decimal(19, 0))"
    cuts = cuts.withColumn("score", F.expr(f"({wide.format('1000 * a', 'n')}) div ({wide.format('l', 'r')})"))
    lowest = cuts.groupBy("lang", "phrase", "a", "words", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # A longer phrase of the same count goes through one that is longer by a word and has that count too.
    longer = candidates.where("words > 2").select("lang", "a", "phrase", "words")
    tail = F.expr("substring(phrase, length(substring_index(phrase, ' ', 1)) + 2)")
    both = F.array(F.expr("substring_index(phrase, ' ', words - 1)"), tail)
    held = longer.select("lang", "a", F.explode(both).alias("phrase")).distinct()
    return lowest.join(held, ["lang", "phrase", "a"], "left_anti").select(
        "lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, first: int = FIRST, most_words: int = MOST_WORDS
) -> DataFrame:
    """The ``first`` best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    if not 2 <= most_words <= MOST_WORDS:
        raise ValueError(f"phrases have 2 to {MOST_WORDS} words: longer ones need a wider overlap of the chunks")
    parsed = materialize(dictionary(docs, text, lang), "phrases-dictionary")
    totals = parsed.groupBy("lang").agg(F.sum(F.col("own") * F.col("times")).alias("n"))
    scored = score(frequent(parsed, least, most_words), totals)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language may have most of the phrases: the best of each part first, then the best of those.
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    best = scored.withColumn("rank", F.row_number().over(W.partitionBy("lang", part).orderBy(*order)))
    best = best.where(F.col("rank") <= first)
    ranked = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)))
    ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, folder):
    return collocations(documents(spark, folder))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
        FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
counts AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT c.*, j, array_to_string(string_split(phrase, ' ')[1 : j], ' ') AS first_part,
         array_to_string(string_split(phrase, ' ')[j + 1 :], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS j FROM counts WHERE k > 1) c),
scored AS (
  SELECT c.lang, c.phrase, c.k, c.a, x.a AS l, y.a AS r, n, c.j,
         CAST((CAST(1000 AS HUGEINT) * c.a * n) // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = c.first_part
              JOIN counts y ON y.lang = c.lang AND y.phrase = c.rest JOIN totals t ON t.lang = c.lang),
lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM counts x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.a >= 100 * c.a
                             AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""
