"""Language identification by cross-parsing.

For each language a suffix automaton of labelled text accepts every run of characters that stands in that text. A
document is cut greedily into phrases, each the longest match that the automaton allows from there on; text of the same
language needs few phrases. The phrases are normalised by the length of the document and the logarithm of the length
of the labelled text, and the language needing fewest wins.

Fitted on a bounded sample: of every language the rows with the smallest hash of their id, of each text the first
``TEXT_CHARS`` characters, up to ``LANGUAGE_CHARS`` characters together (less where more than ``LANGUAGES_AT_FULL``
languages share the bound on the tables that are broadcast). Every text is parsed whole. It is parsed in pieces of
``PIECE`` characters at a time, all pieces of a batch side by side, so a phrase ends where a piece ends.

Characters are lower-cased; everything but letters is one space. Every letter of the samples is a symbol: the
commonest have a column in the tables, transitions by others are looked up in a sorted list.

Defined cases: a null text, an empty text and one without a letter that some sample holds are ``und`` with score 0; no labelled rows at all
make every text ``und``; a null language teaches nothing; ties go to the language that comes first by code point; the
table may be empty, and other columns are neither read nor changed.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.llm.automaton import SuffixAutomaton
from custlens.llm.common import column, documents, free_name, held_out

TEXT_CHARS = 4000
LANGUAGE_CHARS = 30_000
LANGUAGES_AT_FULL = 16
SAMPLE_ROWS = 60
SYMBOLS = 64
PIECE = 256
SLICE_CHARS = 1_000_000
RADIX = 1 << 21  # more than there are characters
KIND = "struct<lang:string,score:double>"
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower case (if that is one character), and whether it is a letter."""
    points = [chr(i) for i in range(0x110000)]
    letters = np.array([c.isalpha() for c in points])
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in np.flatnonzero(letters).tolist():
        small = points[i].lower()
        if len(small) == 1:
            lower[i] = ord(small)
    return lower, letters


def folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, each run of other characters one space; where texts start; their letters."""
    lower, letters = _folding()
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    places = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    letter = letters[points]
    out = np.where(letter, lower[points], 32)
    kept = letter.copy()
    if len(points):
        first = np.zeros(len(points), dtype=bool)
        first[places[:-1][places[:-1] < len(points)]] = True
        kept[1:] |= letter[:-1] & ~first[1:]  # the first of a run of others, unless a text begins with it
    at = np.concatenate([[0], np.cumsum(kept)])
    counts = np.concatenate([[0], np.cumsum(letter)])
    return out[kept], at[places], counts[places[1:]] - counts[places[:-1]]


class Languages:
    """Transition tables of one automaton per language, over a shared alphabet."""

    def __init__(self, texts: dict[str, list[str]]):
        self.names = sorted(texts)
        room = LANGUAGE_CHARS * min(1.0, LANGUAGES_AT_FULL / max(1, len(self.names)))
        streams = []
        for name in self.names:
            points, places, _ = folded(texts[name])
            rows, size = [], 0
            for a, b in zip(places, places[1:]):
                if size + b - a <= room or not rows:
                    rows.append(points[a:b][: int(room)])
                    size += b - a
            streams.append(rows)
        self.symbol = np.zeros(0x110000, np.uint8)
        self.tables: list[np.ndarray] = []
        self.rare: list[tuple[np.ndarray, np.ndarray]] = []
        self.bits: list[float] = []
        if not streams:
            return
        seen, counts = np.unique(np.concatenate([r for rows in streams for r in rows] or [[]]), return_counts=True)
        alphabet = seen[np.argsort(-counts, kind="stable")].astype(np.int64)
        self.symbol = self.symbol.astype(np.min_scalar_type(len(alphabet)))
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)  # 0: any other character, matched by no text
        for rows in streams:
            automaton = SuffixAutomaton()
            for row in rows:
                automaton.add(self.symbol[row].tolist())
            table = np.zeros((len(automaton.next), SYMBOLS), np.int32)
            rest = {}
            for state, following in enumerate(automaton.next):
                for symbol, target in following.items():
                    if symbol < SYMBOLS:
                        table[state, symbol] = target * SYMBOLS
                    else:
                        rest[state * SYMBOLS * RADIX + symbol] = target * SYMBOLS
            self.tables.append(table.reshape(-1))
            self.rare.append((np.array(sorted(rest), np.int64), np.array([rest[k] for k in sorted(rest)], np.int32)))
            self.bits.append(float(np.log2(2 + sum(len(r) for r in rows))))

    def _step(self, row: int, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """States that follow, times ``SYMBOLS``; 0 where none does."""
        far = np.flatnonzero(symbol >= SYMBOLS)
        if not len(far):
            return self.tables[row][state + symbol]
        following = self.tables[row][state + np.where(symbol < SYMBOLS, symbol, 0)]
        keys, targets = self.rare[row]
        if len(keys):
            wanted = state[far].astype(np.int64) * RADIX + symbol[far]
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            following[far] = np.where(keys[at] == wanted, targets[at], 0)
        return following

    def phrases(self, points: np.ndarray, places: np.ndarray) -> np.ndarray:
        """``[language, text]``: phrases that each text is cut into."""
        sizes = np.diff(places)
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        firsts = np.concatenate([[0], np.cumsum(pieces)])
        begins = places[:-1][owner] + (np.arange(len(owner)) - firsts[owner]) * PIECE
        lengths = np.minimum(PIECE, places[1:][owner] - begins)
        order = np.argsort(-lengths, kind="stable")
        begins, lengths, owner = begins[order], lengths[order], owner[order]
        symbols = self.symbol[points].astype(np.int32)
        out = np.zeros((len(self.tables), len(sizes)), np.int64)
        # The pieces still running at each step are the first ones, as they are sorted by length.
        running = np.searchsorted(-lengths, -np.arange(1, PIECE + 1), side="right")
        for row in range(len(self.tables)):
            state = np.zeros(len(owner), np.int32)
            count = np.zeros(len(owner), np.int32)
            for i in range(int(lengths[0]) if len(lengths) else 0):
                n = running[i]
                symbol = symbols[begins[:n] + i]
                following = self._step(row, state[:n], symbol)
                ends = following == 0
                count[:n] += ends & (state[:n] > 0)
                again = self._step(row, np.zeros(n, np.int32), symbol)
                count[:n] += ends & (again == 0)
                state[:n] = np.where(ends, again, following)
            count += state > 0
            out[row] = np.bincount(owner, count, minlength=len(sizes))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        points, places, letters = folded([t or "" for t in texts])
        if not self.tables:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = np.concatenate([[0], np.cumsum((points != 32) & (self.symbol[points] > 0))])
        letters = np.minimum(letters, known[places[1:]] - known[places[:-1]])
        costs = self.phrases(points, places) * np.array(self.bits)[:, None] / np.maximum(1, np.diff(places))
        best = costs.argmin(axis=0)
        least = costs[best, np.arange(len(texts))]
        rest = costs.copy()
        rest[best, np.arange(len(texts))] = np.inf
        second = rest.min(axis=0) if len(self.tables) > 1 else np.full(len(texts), np.inf)
        # The share of the runner-up in both costs: 0.5 where they are equal, towards 1 where the winner is far ahead.
        ratio = least / np.maximum(second, 1e-9)
        score = np.where(letters > 0, 1 / (1 + ratio), 0.0)
        names = [self.names[b] if n else UNKNOWN for b, n in zip(best.tolist(), letters.tolist())]
        return names, np.clip(score, 0, 1).tolist()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS):
    """Automata from a bounded sample of each language; held-out rows are never used."""
    labelled = docs.select(
        column(docs, key).alias("key"), column(docs, text).alias("text"), column(docs, lang).alias("lang")
    ).where(F.col("lang").isNotNull() & (F.length("text") > 0))
    labelled = labelled.withColumn("text", F.substring("text", 1, TEXT_CHARS))
    usable = labelled.where(~held_out(F.col("key")))
    hashed = usable.withColumn("order", F.xxhash64("key", "text"))
    first = F.row_number().over(W.partitionBy("lang").orderBy("order", "key"))
    got = hashed.withColumn("place", first).where(F.col("place") <= rows).select("lang", "place", "text").collect()
    texts: dict[str, list[str]] = {}
    for row in sorted(got, key=lambda r: (r["lang"], r["place"])):
        texts.setdefault(row["lang"], []).append(row["text"])
    return Languages(texts)


def identifier(spark, model: Languages):
    """A function of a text column: the language and the score."""
    shared = spark.sparkContext.broadcast(model)

    def identify(texts: pa.Array) -> pa.Array:
        names, scores, part, size = [], [], [], 0
        for value in [*texts.to_pylist(), False]:
            if value is not False:
                part.append(value)
                size += len(value or "")
            if part and (size >= SLICE_CHARS or value is False):
                got = shared.value.predict(part)
                names += got[0]
                scores += got[1]
                part, size = [], 0
        columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
        return pa.StructArray.from_arrays(columns, names=["lang", "score"])

    return arrow_udf(identify, KIND)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, str]:
    """``docs`` with one more column, whose name is returned: the struct ``lang, score``."""
    name = free_name(docs, "language")
    found = identifier(docs.sparkSession, fit(docs, key, text, lang))
    return docs.withColumn(name, found(column(docs, text))), name


def op5_language(spark, folder):
    docs = documents(spark, folder)
    found, name = identify(docs)
    return found.select(
        "doc_id",
        F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
        F.col(name)["lang"].alias("lang_pred"),
        F.col(name)["score"].alias("score"),
    )
