"""A perceptron with hidden layers, trained on data that stays in the tasks' memory.

One fit is one Spark job, as in ``boosting``: the tasks of a barrier stage hold their rows as sparse entries, compute the gradient of
their share, add the gradients up and take the same Adam step. Unlike Spark's own network it offers ``relu`` and ``tanh``, weight decay and a
learning rate.

Defined cases: rows with a null label or vector are left out; a training set without rows raises ``ValueError``; the
penalty leaves the shifts alone and, as the loss, is an average over the rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from custlens.operators.boosting import ROWS_PER_TASK, Team, sparse_rows, training_rows, vector_parts

# Rows whose answers are computed in one go.
ROWS_AT_ONCE = 4096
# A block of rows is multiplied as a matrix while it has at most so many cells per entry: multiplying a cell costs less than gathering
# the weights of an entry.
CELLS_PER_ENTRY = 32
# Steps without a gain of TOLERANCE in the loss that end the training.
PATIENCE, TOLERANCE = 10, 1e-4

ACTIVATIONS = {
    "relu": (lambda x: np.maximum(x, 0), lambda y: (y > 0).astype(float)),
    "tanh": (np.tanh, lambda y: 1 - y * y),
}


class Entries:
    """Sparse rows, multiplied with matrices from either side."""

    def __init__(self, n: int, rows: np.ndarray, slots: np.ndarray, values: np.ndarray, size: int):
        self.n, self.size = n, size
        self.rows, self.slots, self.values = rows, slots, values
        self.filled = n * size <= CELLS_PER_ENTRY * len(values)
        self.by_slot = None if self.filled else np.argsort(slots, kind="stable")

    def matrix(self) -> np.ndarray:
        out = np.zeros((self.n, self.size))
        out[self.rows, self.slots] = self.values
        return out

    @staticmethod
    def _sums(groups: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
        """Sums of the parts by group; groups come in order."""
        out = np.zeros((n, parts.shape[1]))
        if len(groups):
            firsts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
            out[groups[firsts]] = np.add.reduceat(parts, firsts)
        return out

    def times(self, matrix: np.ndarray) -> np.ndarray:
        if self.filled:
            return self.matrix() @ matrix
        return self._sums(self.rows, self.values[:, None] * matrix[self.slots], self.n)

    def turned_times(self, matrix: np.ndarray) -> np.ndarray:
        if self.filled:
            return self.matrix().T @ matrix
        at = self.by_slot
        return self._sums(self.slots[at], self.values[at, None] * matrix[self.rows[at]], self.size)


def _start(layers: list[int], seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    out = []
    for a, b in zip(layers, layers[1:]):
        bound = np.sqrt(6 / (a + b))
        out += [rng.uniform(-bound, bound, (a, b)), np.zeros(b)]
    return out


def answers(weights: list[np.ndarray], inputs, activation: str) -> list[np.ndarray]:
    """Output of each layer; the last one holds logits. ``inputs`` are ``Entries`` or a matrix."""
    act = ACTIVATIONS[activation][0]
    first = inputs.times(weights[0]) if isinstance(inputs, Entries) else inputs @ weights[0]
    out = [first + weights[1]]
    for w, shift in zip(weights[2::2], weights[3::2]):
        out[-1] = act(out[-1])
        out.append(out[-1] @ w + shift)
    return out


def gradients(weights: list[np.ndarray], inputs: Entries, labels: np.ndarray, activation: str) -> tuple[float, list[np.ndarray]]:
    """Summed logistic loss and its gradients."""
    slope = ACTIVATIONS[activation][1]
    layers = answers(weights, inputs, activation)
    logits = layers[-1][:, 0]
    loss = np.logaddexp(0, np.where(labels == 1, -logits, logits)).sum()
    back = (1 / (1 + np.exp(-logits)) - labels)[:, None]
    grads: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        grads.insert(0, back.sum(axis=0))
        grads.insert(0, layers[i - 1].T @ back if i else inputs.turned_times(back))
        if i:
            back = (back @ weights[2 * i].T) * slope(layers[i - 1])
    return float(loss), grads


def _learn(options: dict, size: int):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = []
        for batch in batches:
            rows, slots, values = sparse_rows(*(batch.column(i) for i in (1, 2, 3)))
            labels = batch.column(0).to_numpy()
            for lo in range(0, len(labels), ROWS_AT_ONCE):
                hi = min(len(labels), lo + ROWS_AT_ONCE)
                a, b = np.searchsorted(rows, [lo, hi])
                shares.append((Entries(hi - lo, rows[a:b] - lo, slots[a:b], values[a:b], size), labels[lo:hi]))
        team = Team()
        n = float(team.total(np.array([float(sum(len(y) for _, y in shares))]))[0])
        weights = _start([size, *options["hidden"], 1], options["seed"])
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
        cuts = np.cumsum([w.size for w in weights])
        best, calm = np.inf, 0
        for step in range(1, options["maxIter"] + 1):
            own, loss = np.zeros(cuts[-1]), 0.0
            for x, y in shares:
                part, grads = gradients(weights, x, y, options["activation"])
                loss += part
                own += np.concatenate([g.ravel() for g in grads])
            total = team.total(np.append(own, loss))
            loss = total[-1] / n + options["decay"] / 2 / n * sum((w * w).sum() for w in weights[::2])
            calm = 0 if loss < best - TOLERANCE else calm + 1
            best = min(best, loss)
            if calm >= PATIENCE:
                break
            for i, (w, g) in enumerate(zip(weights, np.split(total[:-1], cuts[:-1]))):
                g = g.reshape(w.shape) / n + (options["decay"] / n * w if i % 2 == 0 else 0)
                m, v = moments[i]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= options["rate"] * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        if team.place == 0:
            state = json.dumps([w.tolist() for w in weights])
            yield pa.RecordBatch.from_arrays([pa.array([state])], ["state"])

    return learn


class Network(Estimator, HasFeaturesCol, HasLabelCol, HasMaxIter, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Perceptron for labels 0 and 1: ``hidden`` layer sizes, ``activation`` (relu, tanh), ``decay``, learning ``rate``."""

    hidden = Param(Params._dummy(), "hidden", "sizes of the hidden layers", TypeConverters.toListInt)
    activation = Param(Params._dummy(), "activation", "relu or tanh", TypeConverters.toString)
    decay = Param(Params._dummy(), "decay", "weight decay", TypeConverters.toFloat)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    rowsPerTask = Param(Params._dummy(), "rowsPerTask", "rows that a task should hold", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self, *, hidden=None, activation=None, decay=None, rate=None, maxIter=None, rowsPerTask=None,
        featuresCol=None, labelCol=None, seed=None,
    ):
        super().__init__()
        self._setDefault(
            hidden=[100], activation="relu", decay=1e-4, rate=1e-3, maxIter=500, rowsPerTask=ROWS_PER_TASK,
            featuresCol="features", labelCol="label", seed=42,
        )
        self._set(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _fit(self, dataset: DataFrame) -> "FittedNetwork":
        options = {name: self.getOrDefault(name) for name in ("hidden", "activation", "decay", "rate", "maxIter", "seed")}
        if options["activation"] not in ACTIVATIONS:
            raise ValueError(f"unknown activation {options['activation']}")
        rows, size = training_rows(dataset, self.getLabelCol(), self.getFeaturesCol(), self.getOrDefault("rowsPerTask"))
        state = rows.mapInArrow(_learn(options, size), "state string", barrier=True).collect()[0]["state"]
        return FittedNetwork(state, options["activation"])._set(featuresCol=self.getFeaturesCol())


class FittedNetwork(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``."""

    state = Param(Params._dummy(), "state", "the weights as JSON", TypeConverters.toString)
    activation = Param(Params._dummy(), "activation", "relu or tanh", TypeConverters.toString)

    def __init__(self, state: str = "", activation: str = "relu"):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(state=state, activation=activation)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = [np.array(w) for w in json.loads(self.getOrDefault("state"))]
        activation = self.getOrDefault("activation")

        @arrow_udf("double")
        def score(kinds: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
            rows, slots, entries = sparse_rows(kinds, indices, values)
            out = [np.zeros(0)]
            for lo in range(0, len(kinds), ROWS_AT_ONCE):
                hi = min(len(kinds), lo + ROWS_AT_ONCE)
                a, b = np.searchsorted(rows, [lo, hi])
                x = Entries(hi - lo, rows[a:b] - lo, slots[a:b], entries[a:b], len(weights[0]))
                out.append(1 / (1 + np.exp(-answers(weights, x, activation)[-1][:, 0])))
            return pa.array(np.concatenate(out))

        chance = score(*vector_parts(self.getFeaturesCol()))
        out = dataset.withColumn("probability", array_to_vector(F.array(1 - chance, chance)))
        return out.withColumn("prediction", (F.get(F.unwrap_udt("probability")["values"], F.lit(1)) > 0.5).cast("double"))
