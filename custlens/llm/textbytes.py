"""Texts of an Arrow batch as one byte buffer, cut into words and hashed without a Python loop per word.

Texts are UTF-8. The two word patterns of the operators only exclude ASCII characters, so cutting the bytes
gives the same words as cutting the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes looked at in one go: bounds the temporary arrays of a task, never the length of a text.
SLICE_BYTES = 2_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0x2545F4914F6CDD1D)
_ODD_INVERSE = np.uint64(pow(0x2545F4914F6CDD1D, -1, 2**64))


def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


LETTERS = _letters(7)


def _table(excluded: list[tuple[int, int]]) -> np.ndarray:
    keep = np.ones(256, dtype=bool)
    for first, last in excluded:
        keep[first : last + 1] = False
    return keep


# [^\x20\x09-\x0D]+
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, on lower-cased bytes
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and where each text starts in them (one more entry than texts). A null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    places = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :]
    places = places.astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[places[0] : places[-1]]
    return raw, places - places[0]


def slices(places: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``limit`` bytes; a longer text comes alone."""
    first, n = 0, len(places) - 1
    while first < n:
        last = int(np.searchsorted(places, places[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def mixed(values: np.ndarray) -> np.ndarray:
    """A well spread 64-bit number for each 64-bit number."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any ranges of one byte buffer."""

    def __init__(self, data: np.ndarray):
        letters = LETTERS[data]
        letters *= _powers(_ODD, len(data))[:-1]
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters, out=self._sums[1:])
        self._back = _powers(_ODD_INVERSE, len(data))

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums = self._sums[ends] - self._sums[starts]
        sums *= self._back[starts]
        return mixed(sums + (ends - starts).astype(np.uint64) * _MIX)


def words(data: np.ndarray, places: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of each word of the texts at ``places``; ``kept`` marks the bytes of words."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kept[data]
    starts = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    ends = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    # A text may end in a word and the next begin with one: cut there.
    borders = places[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]
    borders = np.unique(borders[inside[borders] & inside[borders + 1]])
    if len(borders):
        starts = np.sort(np.concatenate([starts, borders]))
        ends = np.sort(np.concatenate([ends, borders]))
    rows = np.searchsorted(places, starts, side="right") - 1
    return rows, starts, ends


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` consecutive words from each word on, and whether they lie in one text."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, dtype=bool)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out *= _ODD
        out += hashes[i : i + size]
    return mixed(out), rows[:size] == rows[n - 1 :]
