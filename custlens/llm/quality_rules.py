"""Weak supervision: rules vote on quality or abstain, and expectation-maximisation weighs them.

Each rule looks at the signals of one document and votes good (1), bad (-1) or abstains (0). No labels are used.
Two classes are assumed, and in each class a rule that votes has its own chance to vote good. EM estimates those chances and the share of good documents from the counts of vote patterns, of which there are 3 ** rules at most
(59,049), so what the driver gets does not grow with the table. The posterior of a document's pattern is its quality.

Defined cases: a null or empty text has no words, all signals are 0, and rules that divide by words abstain; equal
rows get equal results; an empty table gives an empty result; columns other than the key and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.llm.common import column, documents
from custlens.llm.textbytes import SPACED, Rolling, buffers, grams, slices, words
from custlens.session import materialize

ROUNDS = 100
KEEP_FROM = 0.5
MIN_WORDS = 50

SIGNALS = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words n_lines n_capitals n_letters n_marks n_distinct"
    " n_odd_words n_plain_words"
).split()
KIND = "struct<" + ",".join(f"{s}:bigint" for s in SIGNALS) + ">"

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
# Last bytes of words of running text: letters, digits, everything beyond ASCII, and light punctuation.
_CLOSING = np.zeros(256, dtype=bool)
_CLOSING[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CLOSING[[ord(c) for c in ".,;:?"]] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[65:91] = True
_LETTER = _CAPITAL.copy()
_LETTER[97:123] = True


def _counted(mask: np.ndarray, places: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return sums[places[1:]] - sums[places[:-1]]


def _distinct_in_rows(rows: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (h[1:] != h[:-1])
    return np.bincount(r[new], minlength=n)


def _repeated(rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which (row, hash) pairs stand more than once."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    same = (r[1:] == r[:-1]) & (h[1:] == h[:-1])
    out = np.zeros(len(r), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _signals(data: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
    n = len(places) - 1
    rows, starts, ends = words(data, places, SPACED)
    rolling = Rolling(data)
    hashes = rolling.hashes(starts, ends)
    out = {"n_words": np.bincount(rows, minlength=n)}
    out["word_chars"] = _counted(SPACED[data] & ((data & 0xC0) != 0x80), places)
    out["n_symbols"] = _counted(_SYMBOLS[data], places)
    out["n_capitals"] = _counted(_CAPITAL[data], places)
    out["n_letters"] = _counted(_LETTER[data], places)
    out["n_marks"] = _counted(data == 33, places)
    out["n_distinct"] = _distinct_in_rows(rows, hashes, n)

    sums = np.concatenate([[0], np.cumsum(_SYMBOLS[data], dtype=np.int64)])
    out["n_odd_words"] = np.bincount(rows[sums[ends] > sums[starts]], minlength=n)
    out["n_plain_words"] = np.bincount(rows[_CLOSING[data[ends - 1]]], minlength=n)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.unique(np.concatenate([places[:-1], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.concatenate([line_starts[1:], [len(data)]]) if len(line_starts) else line_starts
    line_rows = np.searchsorted(places, line_starts, side="right") - 1
    # The break that ends a line does not belong to it.
    ended = (line_ends > line_starts) & (data[np.maximum(line_ends, 1) - 1] == 10) if len(data) else line_ends > 0
    line_ends = line_ends - ended
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    own, line_hashes = line_rows[wordy], rolling.hashes(line_starts[wordy], line_ends[wordy])
    out["n_lines"] = np.bincount(own, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - _distinct_in_rows(own, line_hashes, n)

    triples, inside = grams(hashes, rows, 3)
    covered = np.zeros(len(rows), dtype=bool)
    if len(triples):
        at = np.flatnonzero(inside)
        at = at[_repeated(rows[at], triples[at])]
        for i in range(3):
            covered[at + i] = True
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)
    return out


def signals(texts: pa.Array) -> pa.Array:
    data, places = buffers(texts)
    parts = [
        _signals(data[places[lo] : places[hi]], places[lo : hi + 1] - places[lo]) for lo, hi in slices(places)
    ] or [{s: np.zeros(0, np.int64) for s in SIGNALS}]
    columns = [pa.array(np.concatenate([p[s] for p in parts]).astype(np.int64)) for s in SIGNALS]
    return pa.StructArray.from_arrays(columns, names=SIGNALS)


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """Votes from the signal columns. Comparisons are on whole numbers, so nothing divides by zero."""
    w, c = F.col("n_words"), F.col
    some = w > 0
    return {
        "length": _vote(w < MIN_WORDS, w >= 100),
        "word_length": _vote(
            some & ((2 * c("word_chars") < 5 * w) | (c("word_chars") > 15 * w)),
            some & c("word_chars").between(3 * w, 11 * w),
        ),
        "symbols": _vote(some & (10 * c("n_symbols") > w), some & (50 * c("n_symbols") <= w)),
        "odd_words": _vote(some & (5 * c("n_odd_words") > w), some & (25 * c("n_odd_words") <= w)),
        "plain_words": _vote(some & (10 * c("n_plain_words") < 7 * w), some & (10 * c("n_plain_words") >= 9 * w)),
        "same_lines": _vote(10 * c("n_dup_lines") > 3 * c("n_lines"), (c("n_lines") > 1) & (c("n_dup_lines") == 0)),
        "same_words": _vote(some & (10 * c("n_repeat_words") > 3 * w), some & (20 * c("n_repeat_words") <= w)),
        "capitals": _vote(
            some & (2 * c("n_capitals") > c("n_letters")), (c("n_letters") > 0) & (8 * c("n_capitals") < c("n_letters"))
        ),
        "marks": _vote(some & (5 * c("n_marks") > w), some & (50 * c("n_marks") <= w)),
        "variety": _vote((w >= 20) & (5 * c("n_distinct") < w), (w >= 20) & (2 * c("n_distinct") > w)),
    }


def estimate(votes: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Posterior chance of each pattern to be good, and ``[class, rule]``: the chance that a vote is good, by EM.

    It starts from rules that mostly agree with quality. An abstention says nothing. Every rule keeps ten pseudo-votes
    of its start, so no chance is zero, and stays at least as likely to vote good in the good class as in the bad
    one: a rule can become useless but not turn against itself, which also keeps the classes from swapping.
    """
    start = np.array([[0.4] * votes.shape[1], [0.98] * votes.shape[1]])
    chances, good, total = start.copy(), 0.85, counts.sum()
    up, down = (votes == 1).astype(float), (votes == -1).astype(float)
    posterior = np.full(len(votes), good)
    for _ in range(rounds):
        logs = up @ np.log(chances).T + down @ np.log(1 - chances).T + np.log([1 - good, good])
        posterior = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -700, 700)))
        for side, weight in enumerate((counts * (1 - posterior), counts * posterior)):
            chances[side] = (weight @ up + 10 * start[side]) / (weight @ (up + down) + 10)
        chances[0] = np.minimum(chances[0], chances[1])
        good = float(np.clip(((counts * posterior).sum() + 1) / (total + 2), 0.01, 0.99))
    return posterior, chances


def weigh(docs: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: the key, its signals, one vote per rule, and ``posterior``."""
    spark = docs.sparkSession
    found = docs.select(column(docs, key).alias(key), arrow_udf(signals, KIND)(column(docs, text)).alias("signals"))
    voting = rules()
    code = sum(((F.col(f"vote_{name}") + 1) * 3**i for i, name in enumerate(voting)), F.lit(0))
    voted = (
        found.select(key, "signals.*")
        .select(key, *SIGNALS, *(vote.alias(f"vote_{name}") for name, vote in voting.items()))
        .withColumn("pattern", code.cast("int"))
    )
    voted = materialize(voted, "rule-votes")
    patterns = voted.groupBy("pattern").count().collect()  # 3 ** rules rows at most
    numbers = np.array([r["pattern"] for r in patterns], dtype=np.int64)
    votes = np.stack([numbers // 3**i % 3 - 1 for i in range(len(voting))], axis=1)
    posterior, _ = estimate(votes, np.array([r["count"] for r in patterns], dtype=float), rounds)
    table = pd.DataFrame({"pattern": numbers.astype(np.int32), "posterior": posterior.astype(float)})
    table = spark.createDataFrame(table, "pattern int, posterior double")
    return voted.join(F.broadcast(table), "pattern").drop("pattern")


def op1_quality_rules(spark, folder):
    rows = weigh(documents(spark, folder))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "doc_id",
        *SIGNALS[:5],
        failed.alias("base_failed"),
        (~failed & (F.col("posterior") >= KEEP_FROM)).alias("kept"),
        "posterior",
    )
