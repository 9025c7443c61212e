"""Exact quantiles of many columns at once, by radix selection.

The bits of a double, with the sign turned, sort like the double. A pass over the rows counts them by the next ``BITS`` bits of
this key, for every column and group at once; the counts say which prefixes hold the wanted ranks, and the next pass
looks at those only. Once few rows are left, a last pass fetches their distinct values. Tasks send counts of prefixes, never rows, so
nothing is sorted, no task holds a column, and any distribution ends after ``64 / BITS`` passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

BITS = 16
# Rows in the prefixes that are left at which their values are fetched; bounds what the driver gets.
GATHER = 100_000
_SIGN = np.uint64(1 << 63)


def sort_keys(values: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; both zeros are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | _SIGN)


def key_value(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else ~key & (1 << 64) - 1
    return float(np.uint64(bits).view(np.float64))


def _groups(batch: pa.RecordBatch, by: int) -> tuple[np.ndarray, list[tuple]]:
    """Group of each row, and the values of each group, for the first ``by`` columns."""
    codes = np.zeros(batch.num_rows, np.int64)
    for i in range(by):
        encoded = batch.column(i).dictionary_encode(null_encoding="encode")
        codes = codes * max(1, len(encoded.dictionary)) + encoded.indices.to_numpy(zero_copy_only=False)
    _, firsts, places = np.unique(codes, return_index=True, return_inverse=True)
    columns = [batch.column(i).take(pa.array(firsts)).to_pylist() for i in range(by)]
    return places, list(zip(*columns)) if by else [()] * len(firsts)


def _counter(by: int, columns: int, depth: int, wanted: dict | None, whole: bool, schema: pa.Schema):
    """Counts by the bits down to ``depth`` (or ``whole`` keys) of the rows whose prefix is wanted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, groups = _groups(batch, by)
            out: list[tuple] = []
            for feature in range(columns):
                values = batch.column(by + feature).to_numpy(zero_copy_only=False)
                real = ~np.isnan(values)  # nulls come as NaN
                keys, homes = sort_keys(values[real]), places[real]
                for home, group in enumerate(groups):
                    own = keys[homes == home] if len(groups) > 1 else keys
                    if wanted is not None:
                        kept = wanted.get((group, feature))
                        if kept is None:
                            continue
                        own = own[np.isin(own >> np.uint64(64 - BITS * depth), kept)]
                    shift = 0 if whole else 64 - BITS * (depth + 1)
                    slots, counts = np.unique(own >> np.uint64(shift), return_counts=True)
                    out += [(*group, feature, slot, n) for slot, n in zip(slots.view(np.int64).tolist(), counts.tolist())]
            if out:
                columns_out = [pa.array(c, f.type) for c, f in zip(zip(*out), schema)]
                yield pa.RecordBatch.from_arrays(columns_out, schema=schema)

    return count


def quantile_rows(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), gather: int = GATHER
) -> list[tuple]:
    """``(*by, feature, probability, value)``, as ``exact_quantiles`` returns it."""
    by, columns = list(by), list(columns)
    rows = df.select(*by, *(F.col(c).cast("double").alias(f"value_{i}") for i, c in enumerate(columns)))
    kind = StructType([df.select(*by).schema[c] for c in by])
    for name in ("feature", "slot", "n"):
        kind = kind.add(name, LongType())
    schema = pa.schema([(f.name, _arrow_type(f)) for f in kind])

    def counts(depth: int, wanted: dict | None, whole: bool) -> dict[tuple, dict[int, int]]:
        counted = rows.mapInArrow(_counter(len(by), len(columns), depth, wanted, whole, schema), kind)
        found: dict[tuple, dict[int, int]] = {}
        for *group, feature, slot, n in counted.groupBy(*by, "feature", "slot").agg(F.sum("n")).collect():
            found.setdefault((tuple(group), feature), {})[slot % (1 << 64)] = n
        return found

    # Where each rank is: the prefix found so far and the rows before it.
    places: dict[tuple, dict[int, tuple[int, int]]] = {}
    positions: dict[tuple, list[float]] = {}
    found, depth, whole = counts(0, None, False), 1, False
    for cell, slots in found.items():
        total = sum(slots.values())
        positions[cell] = [(total - 1) * float(p) for p in probabilities]
        ranks = {int(r) for x in positions[cell] for r in (math.floor(x), math.ceil(x))}
        places[cell] = _located({r: (0, 0) for r in ranks}, slots, None)
    while places and depth * BITS < 64 and not whole:
        wanted = {cell: np.array(sorted({p for p, _ in at.values()}), np.uint64) for cell, at in places.items()}
        left = sum(found[cell][int(p)] for cell, prefixes in wanted.items() for p in prefixes)
        whole = left <= gather
        found = counts(depth, wanted, whole)
        step = 64 - BITS * depth if whole else BITS
        for cell, at in places.items():
            places[cell] = _located(at, found[cell], step)
        depth += 1
    out = []
    for (group, feature), at in places.items():
        for p, x in zip(probabilities, positions[group, feature]):
            low, high = (key_value(at[int(r)][0]) for r in (math.floor(x), math.ceil(x)))
            out.append((*group, columns[feature], float(p), low + (x - math.floor(x)) * (high - low)))
    return out


def _located(at: dict[int, tuple[int, int]], slots: dict[int, int], step: int | None) -> dict[int, tuple[int, int]]:
    """Ranks moved on from their prefix to one that is ``step`` bits longer (the first one, without ``step``)."""
    out, last, passed, order = {}, None, 0, sorted(slots)
    spot = 0
    for rank in sorted(at):
        prefix, before = at[rank]
        if prefix != last or last is None:
            last, passed = prefix, before
            spot = 0 if step is None else next(i for i, s in enumerate(order) if s >> step == prefix)
        while passed + slots[order[spot]] <= rank:
            passed += slots[order[spot]]
            spot += 1
        out[rank] = (order[spot], passed)
    return out


def _arrow_type(field: StructField) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(field.dataType)


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], by: Sequence[str] = (), gather: int = GATHER
) -> DataFrame:
    """Rows ``(*by, feature, probability, value)`` with linearly interpolated exact quantiles.

    Runs at once, two to four passes over ``df``, so materialise it first when it is costly. Nulls and NaN are no values;
    a column without values has no rows. ``by`` must be labels with few levels: the driver gets up to ``2 ** BITS`` counts per
    level and column, and at most ``gather`` values.
    """
    kind = StructType([df.select(*by).schema[c] for c in by])
    kind = kind.add("feature", StringType()).add("probability", DoubleType()).add("value", DoubleType())
    return df.sparkSession.createDataFrame(quantile_rows(df, columns, probabilities, by, gather), kind)


def collect_quantiles(
    df: DataFrame, columns: Sequence[str], probabilities: Sequence[float], gather: int = GATHER
) -> dict[str, list[float | None]]:
    """The quantiles as ``{column: [value per probability]}``; None for a column without values."""
    if not columns:
        return {}
    found = {(name, p): value for name, p, value in quantile_rows(df, columns, probabilities, gather=gather)}
    return {c: [found.get((c, float(p))) for p in probabilities] for c in columns}
