"""K-means for several numbers of clusters and several starts at once, on rows that stay in the tasks' memory.

All fits are one Spark job, as in ``boosting``: the tasks of a barrier stage hold their rows, and each pass over them serves every
fit that has not ended yet. What moves between tasks are sums per centre, never rows. Starts are drawn by k-means++, and the first
``k`` centres of a start serve as the start of ``k`` clusters.

Draws hang on the values of a row and not on its place, so a rerun over the same partitions repeats them.

Defined cases: null vectors are left out; no rows raise ``ValueError``; with fewer different rows than clusters, the missing clusters
stay without rows; a cluster that loses its rows keeps its centre.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.operators.boosting import ROWS_PER_TASK, Team, sparse_rows, training_rows, vector_parts

# A fit has ended when no centre moves further, as in Spark's own.
TOLERANCE = 1e-4
# Rows whose distances are computed in one go.
ROWS_AT_ONCE = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers, well mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Block:
    """Some rows of vectors, held as entries or, if most are not zero, as a matrix."""

    def __init__(self, n: int, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, size: int):
        self.n, self.size = n, size
        self.matrix = None
        self.rows, self.slots, self.values = rows.astype(np.int32), slots.astype(np.int32), values
        self.keys = np.zeros(n, np.uint64)
        np.add.at(self.keys, rows, _mixed(values.view(np.uint64) + (slots.astype(np.uint64) + np.uint64(1)) * _ODD))
        if 2 * len(values) > n * size:
            self.matrix = self.dense()
            self.rows = self.slots = self.values = None

    def dense(self) -> np.ndarray:
        if self.matrix is not None:
            return self.matrix
        out = np.zeros((self.n, self.size))
        out[self.rows, self.slots] = self.values
        return out


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, centres by points; a centre that is not there (NaN) is infinitely far."""
    missing = np.isnan(centres).any(axis=1)
    centres = np.where(missing[:, None], 0.0, centres)
    out = centres @ points.T
    out *= -2
    out += (centres * centres).sum(axis=1)[:, None]
    out += (points * points).sum(axis=1)
    np.maximum(out, 0, out=out)
    out[missing] = np.inf
    return out


def _nearest(far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and value of the least along the first axis, the first on a tie."""
    least, place = far[0].copy(), np.zeros(far.shape[1:], np.int8 if len(far) < 128 else np.int32)
    for i in range(1, len(far)):
        closer = far[i] < least
        place[closer] = i
        np.minimum(least, far[i], out=least)
    return place, least


class _Trainer:
    def __init__(self, team: Team, blocks: list[_Block], size: int, options: dict):
        self.team, self.blocks, self.size, self.o = team, blocks, size, options
        sums = np.zeros(size + 1)
        for block in blocks:
            sums += np.append(block.dense().sum(axis=0), block.n)
        sums = team.total(sums)
        self.n, self.middle = sums[-1], sums[:-1] / sums[-1]
        # Equal rows of a task are told apart by how many of them came before.
        keys = np.concatenate([*(b.keys for b in blocks), np.zeros(0, np.uint64)])
        order = np.argsort(keys, kind="stable")
        first = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])[: len(keys)]
        begins = np.flatnonzero(first)
        before = np.zeros(len(keys), np.uint64)
        before[order] = (np.arange(len(keys)) - np.repeat(begins, np.diff(np.append(begins, len(keys))))).astype(np.uint64)
        keys = _mixed(keys + before * _ODD + np.uint64(team.place))
        cuts = np.cumsum([b.n for b in blocks])[:-1]
        for block, part in zip(blocks, np.split(keys, cuts) if blocks else []):
            block.keys = part

    def points(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows, moved so that their mean is zero, and their keys."""
        for block in self.blocks:
            dense = block.dense()
            for lo in range(0, block.n, ROWS_AT_ONCE):
                yield dense[lo : lo + ROWS_AT_ONCE] - self.middle, block.keys[lo : lo + ROWS_AT_ONCE]

    def starts(self, n: int, k: int) -> np.ndarray:
        """``n`` starts of ``k`` centres; rows are drawn by their squared distance, as the least of exponential draws."""
        centres = np.full((n, k, self.size), np.nan)
        for turn in range(k):
            found = np.full((n, 1 + self.size), np.inf)
            for points, keys in self.points():
                if turn:
                    far = distances(points, centres[:, :turn].reshape(-1, self.size)).reshape(n, turn, -1).min(axis=1)
                    # What rounding leaves between equal rows is no distance.
                    far[far < 1e-12 * (1 + (points * points).sum(axis=1))] = 0.0
                for start in range(n):
                    salt = _mixed(np.array([self.o["seed"] + start], np.uint64) * _ODD + np.uint64(turn))
                    draw = -np.log((_mixed(keys ^ salt) >> np.uint64(11)).astype(float) / 2**53 + 2**-54)
                    if turn:
                        with np.errstate(divide="ignore", invalid="ignore"):
                            draw = np.where(far[start] > 0, draw / far[start], np.inf)
                    at = int(draw.argmin())
                    if draw[at] < found[start, 0]:
                        found[start, 0], found[start, 1:] = draw[at], points[at]
            every = np.concatenate(self.team.gather(found[None]))
            for start, best in enumerate(every[:, :, 0].argmin(axis=0)):
                if np.isfinite(every[best, start, 0]):
                    centres[start, turn] = every[best, start, 1:]
        return centres

    def passed(self, groups: list[np.ndarray], sums: bool) -> list[np.ndarray]:
        """Per group of fits ``(fits, k, slots)``: sums, count and cost of each cluster, over all tasks."""
        width = self.size + 2 if sums else 1
        out = [np.zeros((*g.shape[:2], width)) for g in groups]
        # Centres of a group lie by place and then by fit.
        centres = np.concatenate([g.transpose(1, 0, 2).reshape(-1, self.size) for g in groups])
        cuts = np.cumsum([0] + [g.shape[0] * g.shape[1] for g in groups])
        for points, _ in self.points():
            far = distances(points, centres)
            for g, total, a, b in zip(groups, out, cuts, cuts[1:]):
                fits, k = g.shape[:2]
                place, least = _nearest(far[a:b].reshape(k, fits, -1))
                if not sums:
                    total[:, 0, 0] += least.sum(axis=1)
                    continue
                for i in range(k):
                    own = (place == i).astype(float)
                    total[:, i, : self.size] += own @ points
                    total[:, i, self.size] += own.sum(axis=1)
        flat = self.team.total(np.concatenate([t.ravel() for t in out]))
        return [part.reshape(t.shape) for part, t in zip(np.split(flat, np.cumsum([t.size for t in out])[:-1]), out)]

    def run(self) -> dict:
        ks, n = self.o["ks"], self.o["starts"]
        first = self.starts(n, max(ks))
        centres = {k: first[:, :k].copy() for k in ks}
        active = {k: np.arange(n) for k in ks}
        for _ in range(self.o["maxIter"]):
            left = [k for k in ks if len(active[k])]
            if not left:
                break
            sums = self.passed([centres[k][active[k]] for k in left], True)
            for k, total in zip(left, sums):
                old, count = centres[k][active[k]], total[:, :, self.size : self.size + 1]
                new = np.where(count > 0, total[:, :, : self.size] / np.maximum(count, 1), old)
                moved = np.nan_to_num(((new - old) ** 2).sum(axis=2)).max(axis=1)
                centres[k][active[k]] = new
                active[k] = active[k][moved > TOLERANCE**2]
        costs = self.passed([centres[k] for k in ks], False)
        out = {}
        for k, cost in zip(ks, costs):
            best = int(cost[:, 0, 0].argmin())
            kept = centres[k][best] + self.middle
            kept = kept[~np.isnan(kept).any(axis=1)]
            out[str(k)] = {"centres": kept.tolist(), "cost": float(cost[best, 0, 0])}
        return out


def _learn(options: dict, size: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [
            _Block(batch.num_rows, *sparse_rows(*(batch.column(i) for i in (1, 2, 3))), size)
            for batch in batches
            if batch.num_rows
        ]
        team = Team()
        state = _Trainer(team, blocks, size, options).run()
        if team.place == 0:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(state)])], ["state"])

    return learn


def fit_all(
    df: DataFrame,
    ks: Sequence[int],
    starts: int = 1,
    max_iter: int = 100,
    seed: int = 42,
    features: str = "features",
    rows_per_task: int = ROWS_PER_TASK,
) -> dict[int, "Centres"]:
    """For every ``k`` the cheapest of ``starts`` fits."""
    options = {"ks": [int(k) for k in ks], "starts": starts, "maxIter": max_iter, "seed": seed}
    vectors = df.select(F.lit(0.0).alias("none"), features)
    rows, size = training_rows(vectors, "none", features, rows_per_task)
    state = json.loads(rows.mapInArrow(_learn(options, size), "state string", barrier=True).collect()[0]["state"])
    return {
        k: Centres(state[str(k)]["centres"], state[str(k)]["cost"])._set(featuresCol=features) for k in options["ks"]
    }


class Centres(Model, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the number of the nearest centre, the first on a tie, as ``cluster``."""

    centres = Param(Params._dummy(), "centres", "one list of slots per cluster")
    cost = Param(Params._dummy(), "cost", "summed squared distance of the training rows", TypeConverters.toFloat)

    def __init__(self, centres: Sequence = (), cost: float = 0.0):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="cluster")
        self._set(centres=[list(c) for c in centres], cost=cost)

    def clusterCenters(self) -> list[np.ndarray]:
        return [np.array(c) for c in self.getOrDefault("centres")]

    @property
    def summary(self) -> SimpleNamespace:
        return SimpleNamespace(trainingCost=self.getOrDefault("cost"), k=len(self.getOrDefault("centres")))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        centres = np.array(self.getOrDefault("centres"))
        middle = centres.mean(axis=0)

        @arrow_udf("int")
        def nearest(kinds: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
            rows, slots, entries = sparse_rows(kinds, indices, values)
            out = np.zeros(len(kinds), np.int32)
            for lo in range(0, len(kinds), ROWS_AT_ONCE):
                hi = min(len(kinds), lo + ROWS_AT_ONCE)
                a, b = np.searchsorted(rows, [lo, hi])
                points = np.zeros((hi - lo, centres.shape[1]))
                points[rows[a:b] - lo, slots[a:b]] = entries[a:b]
                out[lo:hi] = _nearest(distances(points - middle, centres - middle))[0]
            return pa.array(out)

        return dataset.withColumn(self.getPredictionCol(), nearest(*vector_parts(self.getFeaturesCol())))
