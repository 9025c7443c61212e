"""Gradient boosting of histogram trees on data that stays in the tasks' memory.

One fit is one Spark job. Its tasks run side by side in a barrier stage; each bins its share of the rows once and keeps the codes: a
column of a byte or two a row for a slot that is mostly filled, the codes that are not zero for the others. Per round of a tree the tasks add up their histograms (``allGather``) and all find the
same splits, so nothing but histograms moves and no job is started per level. A round splits every leaf of a level; with
``leaves`` the tree takes the best leaf of all each time (leaf-wise growth). Only the smaller child of a split is counted; its
sibling is the difference to the parent. The logistic loss is followed by Newton steps.

The number of tasks grows with the rows (``rowsPerTask``) and their entries (``ENTRIES_PER_TASK``) up to the slots of the cluster,
which then hold the rows together. Adding up between tasks takes about a second per round (the barrier's own pace), which is why a
task holds many rows; one task alone waits for nobody. A lost executor restarts the stage from the training table. Draws depend on the seed and on
the partitioning.

Defined cases: rows with a null label or vector are left out; one class alone gives a constant model; a training set without rows
raises ``ValueError``; slots without spread are never split.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

# Rows that a task of the other iterative fits (k-means, the network) should hold; trees need less time for a row.
ROWS_PER_TASK = 250_000
TREE_ROWS_PER_TASK = 1_000_000
# Entries that a task of trees should hold, before they are binned at 16 bytes each.
ENTRIES_PER_TASK = 12_000_000
# A slot that so large a share of a task's rows fill is held as a column.
FILLED = 0.25
FEW_SPLITS = 16
# Cells (leaves x bins) counted and sent in one go.
CELLS = 1 << 20
# Points that a task sends per slot to find the bins, as a multiple of the bins.
SUMMARY = 8
LEAST_GAIN = 1e-9


def sparse_rows(kinds: pa.Array, indices: pa.Array, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of every entry of vectors that is not zero; ``kinds`` is 1 for dense vectors."""
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    entries = values.flatten().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    slots = np.arange(len(entries)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    sparse = (kinds.to_numpy(zero_copy_only=False) == 0)[rows]
    slots[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    keep = entries != 0
    return rows[keep], slots[keep], entries[keep]


def vector_parts(column: str) -> list:
    vector = F.unwrap_udt(F.col(column))
    return [vector["type"].cast("int").alias("kind"), vector["indices"].alias("indices"), vector["values"].alias("values")]


def training_rows(
    dataset: DataFrame, label: str, features: str, rows_per_task: int, entries_per_task: int | None = None
) -> tuple[DataFrame, int]:
    """Labels and parts of the vectors, dealt evenly to as many tasks as hold them, and the size of a vector."""
    rows = dataset.select(F.col(label).cast("double").alias("label"), *vector_parts(features))
    rows = rows.where("label is not null and values is not null")
    sizes = dataset.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    vector = F.unwrap_udt(F.col(features))
    filled = F.size(vector["values"])
    found = sizes.agg(F.count("*"), F.max(F.coalesce(vector["size"], filled)), F.sum(filled)).first()
    if not found[0]:
        raise ValueError("no training rows")
    slots = dataset.sparkSession.sparkContext.defaultParallelism
    tasks = max(-(-found[0] // rows_per_task), -(-found[2] // entries_per_task) if entries_per_task else 1)
    return rows.repartition(max(1, min(slots, tasks))), found[1]


# -- inside the tasks -----------------------------------------------------------------------------------------


class Team:
    """The tasks of the stage, which add up arrays."""

    def __init__(self):
        self.context = BarrierTaskContext.get()
        self.size, self.place = len(self.context.getTaskInfos()), self.context.partitionId()

    def gather(self, array: np.ndarray) -> list[np.ndarray]:
        if self.size == 1:
            return [array]
        text = base64.b64encode(zlib.compress(np.ascontiguousarray(array).tobytes(), 1)).decode()
        got = self.context.allGather(text)
        return [np.frombuffer(zlib.decompress(base64.b64decode(t)), array.dtype).reshape(-1, *array.shape[1:]) for t in got]

    def total(self, array: np.ndarray) -> np.ndarray:
        return sum(self.gather(array.reshape(1, -1))).reshape(array.shape)


def _by_slot(slots: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each slot that has entries, and their places in order."""
    if not len(slots):
        return []
    # Numbers of 16 bits are sorted in linear time.
    order = np.argsort(slots.astype(np.uint16) if slots.max() < 1 << 16 else slots, kind="stable")
    cuts = np.concatenate([[0], np.cumsum(np.bincount(slots))])
    return [(slot, order[cuts[slot] : cuts[slot + 1]]) for slot in np.flatnonzero(np.diff(cuts)).tolist()]


def _summary(slots: np.ndarray, values: np.ndarray, points: int) -> np.ndarray:
    """Rows (slot, value, count) of the distinct values per slot, at most about ``points`` of them."""
    return _summaries(_by_slot(slots), values, points)


def _summaries(places: list[tuple[int, np.ndarray]], values: np.ndarray, points: int) -> np.ndarray:
    out = []
    for slot, at in places:
        value, weight = np.unique(values[at], return_counts=True)
        if len(value) > points:
            passed = np.cumsum(weight)
            place = np.unique(np.searchsorted(passed, np.linspace(0, passed[-1], points + 1)[1:]))
            weight, value = np.diff(np.concatenate([[0], passed[place]])), value[place]
        out.append(np.stack([np.full(len(value), slot), value, weight], axis=1))
    return np.concatenate(out) if out else np.zeros((0, 3))


@dataclass
class _Bins:
    """Edges of all slots one after another; a value is in the bin of the first edge that it does not pass."""

    edges: np.ndarray  # the last edge of each slot is infinite
    firsts: np.ndarray
    slots: np.ndarray  # of each bin
    zero: np.ndarray  # bin of zero, by slot


def _bins(summary: np.ndarray, size: int, rows: int, most: int) -> _Bins:
    edges, firsts = [], [0]
    order = np.lexsort((summary[:, 1], summary[:, 0]))
    summary = summary[order]
    cuts = np.searchsorted(summary[:, 0], np.arange(size + 1))
    for slot in range(size):
        part = summary[cuts[slot] : cuts[slot + 1]]
        rest = rows - part[:, 2].sum()
        values, weights = part[:, 1], part[:, 2]
        if rest > 0:
            values, weights = np.append(values, 0.0), np.append(weights, rest)
        values, place = np.unique(values, return_inverse=True)
        weights = np.bincount(place, weights)
        middles = (values[1:] + values[:-1]) / 2
        if len(values) > most:
            passed = np.cumsum(weights)[:-1]
            middles = middles[np.unique(np.searchsorted(passed, np.arange(1, most) * (rows / most)).clip(0, len(middles) - 1))]
        edges.append(np.append(middles, np.inf))
        firsts.append(firsts[-1] + len(edges[-1]))
    firsts = np.array(firsts)
    zero = np.array([np.searchsorted(e, 0.0) for e in edges], np.int64)
    return _Bins(np.concatenate(edges), firsts, np.repeat(np.arange(size), np.diff(firsts)), zero)


class _Trainer:
    """One task's rows, and the trees that all tasks grow in step."""

    def __init__(self, team: Team, options: dict, size: int, labels: np.ndarray, rows, slots, values):
        self.team, self.o, self.size, self.labels = team, options, size, labels
        n = len(labels)
        self.rows_total, ones = (int(x) for x in team.total(np.array([n, labels.sum()])))
        own = _by_slot(slots)
        summary = np.concatenate(team.gather(_summaries(own, values, SUMMARY * options["bins"])))
        self.bins = _bins(summary, size, self.rows_total, options["bins"])
        # Filled slots are columns of codes that count from the slot's first bin; others keep what is not in zero's bin.
        self.columns: dict[int, np.ndarray] = {}
        sparse_rows_, sparse_codes, lengths = [], [], np.zeros(size, np.int64)
        for slot, at in own:
            first, last, zero = self.bins.firsts[slot], self.bins.firsts[slot + 1], self.bins.zero[slot]
            if last - first < 2:
                continue
            code = np.searchsorted(self.bins.edges[first:last], values[at])
            if len(at) >= FILLED * n:
                column = np.full(n, zero, np.min_scalar_type(int(last - first - 1)))
                column[rows[at]] = code
                self.columns[slot] = column
            else:
                off = code != zero
                sparse_rows_.append(rows[at[off]].astype(np.int32))
                sparse_codes.append((first + code[off]).astype(np.int32))
                lengths[slot] = len(sparse_codes[-1])
        self.rows = np.concatenate([*sparse_rows_, np.zeros(0, np.int32)])
        self.codes = np.concatenate([*sparse_codes, np.zeros(0, np.int32)])
        self.places = np.concatenate([[0], np.cumsum(lengths)])
        draw = np.random.default_rng([options["seed"], 1, team.place]).random(n)
        self.held = draw < options["heldOut"] if options["patience"] else np.zeros(n, dtype=bool)
        share = ones / max(1, self.rows_total)
        self.prior = float(np.log(share / (1 - share))) if 0 < share < 1 else (20.0 if share else -20.0)
        self.one_class = not 0 < share < 1

    # Histograms have three layers: gradients, curvatures (both given in ``layers``) and counts.

    def _counted(self, leaf_of: np.ndarray, used: np.ndarray, leaves: list[int], layers: np.ndarray) -> np.ndarray:
        """Histogram ``(leaf, layer, bin)`` of some leaves over all tasks."""
        k, out = len(self.bins.edges), []
        step = max(1, CELLS // max(1, k))
        for lo in range(0, len(leaves), step):
            group = leaves[lo : lo + step]
            spot = np.full(int(leaf_of.max(initial=0)) + 2, -1, np.int64)
            spot[[g for g in group if g < len(spot)]] = [i for i, g in enumerate(group) if g < len(spot)]
            home = np.where(used, spot[leaf_of], -1)
            chosen = np.flatnonzero(home >= 0)
            place = home.take(chosen)
            weights = [layers[0].take(chosen), layers[1].take(chosen), None]  # without weights the rows are counted
            hist = np.zeros((len(group), 3, k + 1))
            for layer, weight in enumerate(weights):
                hist[:, layer, k] = np.bincount(place, weight, len(group))
            for slot, column in self.columns.items():
                a, b = self.bins.firsts[slot], self.bins.firsts[slot + 1]
                cell = place * (b - a) + column.take(chosen)
                for layer, weight in enumerate(weights):
                    hist[:, layer, a:b] = np.bincount(cell, weight, len(group) * (b - a)).reshape(len(group), b - a)
            if len(self.rows):
                at = home.take(self.rows)
                take = np.flatnonzero(at >= 0)
                cell, rows = at.take(take) * k + self.codes.take(take), self.rows.take(take)
                for layer in range(3):
                    weight = layers[layer].take(rows) if layer < 2 else None
                    hist[:, layer, :k] += np.bincount(cell, weight, len(group) * k).reshape(len(group), k)
            hist = self.team.total(hist)
            # Zeros that no column has are what is left of a leaf's total.
            starts = self.bins.firsts[:-1]
            sums = np.add.reduceat(hist[:, :, :k], starts, axis=2)
            hist[:, :, starts + self.bins.zero] += hist[:, :, k:] - sums
            out.append(hist[:, :, :k])
        return np.concatenate(out)

    def _splits(self, hist: np.ndarray, rng: np.random.Generator) -> list[tuple]:
        """Best (gain, bin, left sums, totals) of each leaf."""
        o, starts = self.o, self.bins.firsts
        passed = np.cumsum(hist, axis=2)
        before = np.concatenate([np.zeros((*hist.shape[:2], 1)), passed], axis=2)[:, :, starts[:-1]]
        left = passed - before[:, :, self.bins.slots]
        total = hist[:, :, starts[0] : starts[1]].sum(axis=2)
        right = total[:, :, None] - left
        worth = lambda s: s[:, 0] ** 2 / (s[:, 1] + o["l2"] + 1e-12)
        gain = worth(left) + worth(right) - worth(total[:, :, None])
        ok = (left[:, 2] >= o["leastRows"] - 0.5) & (right[:, 2] >= o["leastRows"] - 0.5)
        ok[:, starts[1:] - 1] = False
        if o["subset"] < 1:
            tried = max(1, int(np.ceil(o["subset"] * self.size)))
            places = rng.random((len(hist), self.size)).argsort(axis=1).argsort(axis=1)
            ok &= (places < tried)[:, self.bins.slots]
        gain = np.where(ok, gain, -1.0)
        best = gain.argmax(axis=1)
        each = np.arange(len(hist))
        return list(zip(gain[each, best].tolist(), best.tolist(), left[each, :, best], total))

    def _moved(self, leaf_of: np.ndarray, splits: dict[int, tuple[int, int, int]]) -> np.ndarray:
        """Leaf of each row after splits: leaf -> (bin, left leaf, right leaf)."""
        if len(splits) > FEW_SPLITS:  # then one sort costs less than a look at all rows for each of them
            top = int(leaf_of.max(initial=0))
            order = np.argsort(leaf_of.astype(np.uint16) if top < 1 << 16 else leaf_of, kind="stable")
            cuts = np.concatenate([[0], np.cumsum(np.bincount(leaf_of, minlength=max(top, max(splits)) + 1))])
        moved = leaf_of.copy()
        for leaf, (cut, left, right) in splits.items():
            own = order[cuts[leaf] : cuts[leaf + 1]] if len(splits) > FEW_SPLITS else np.flatnonzero(leaf_of == leaf)
            slot = int(self.bins.slots[cut])
            first = self.bins.firsts[slot]
            if slot in self.columns:
                moved[own] = np.where(self.columns[slot][own] <= cut - first, left, right)
                continue
            moved[own] = left if first + self.bins.zero[slot] <= cut else right
            a, b = self.places[slot], self.places[slot + 1]
            here = a + np.flatnonzero(leaf_of[self.rows[a:b]] == leaf)
            moved[self.rows[here]] = np.where(self.codes[here] <= cut, left, right)
        return moved

    def _tree(self, turn: int, scores: np.ndarray) -> tuple[list[list], np.ndarray]:
        o = self.o
        chance = 1 / (1 + np.exp(-scores))
        layers = np.stack([self.labels - chance, chance * (1 - chance)])
        used = ~self.held
        if o["subsample"] < 1:
            used &= np.random.default_rng([o["seed"], 2, turn, self.team.place]).random(len(scores)) < o["subsample"]
        rng = np.random.default_rng([o["seed"], 3, turn])  # the same in every task
        if o["leaves"]:
            return self._leaf_wise(used, layers, rng)
        # A node is [slot, threshold, left, right, value, gain]; slot -1 is a leaf.
        nodes: list[list] = [[-1, 0.0, -1, -1, 0.0, 0.0]]
        leaf_of = np.zeros(len(scores), np.int64)
        hist = {0: self._counted(leaf_of, used, [0], layers)[0]}
        found = {0: self._splits(hist[0][None], rng)[0]}
        depth = {0: 0}
        nodes[0][4] = self._value(found[0][3])
        while found:
            ready = [i for i, split in found.items() if split[0] > LEAST_GAIN and (not o["depth"] or depth[i] < o["depth"])]
            if not ready:
                break
            splits, small, pairs = {}, [], []
            for i in ready:
                gain, at, left, total = found.pop(i)
                a, b = len(nodes), len(nodes) + 1
                nodes[i][:4] = [int(self.bins.slots[at]), float(self.bins.edges[at]), a, b]
                nodes[i][5] = gain
                for sums in (left, total - left):
                    nodes.append([-1, 0.0, -1, -1, self._value(sums), 0.0])
                depth[a] = depth[b] = depth[i] + 1
                splits[i] = (at, a, b)
                if not o["depth"] or depth[a] < o["depth"]:
                    few, many = (a, b) if left[2] <= total[2] - left[2] else (b, a)
                    small.append(few)
                    pairs.append((i, few, many))
            leaf_of = self._moved(leaf_of, splits)
            found = self._children(hist, pairs, small, leaf_of, used, layers, rng)
        return nodes, leaf_of

    def _value(self, sums: np.ndarray) -> float:
        return float(self.o["rate"] * sums[0] / (sums[1] + self.o["l2"] + 1e-12))

    def _children(self, hist: dict, pairs: list, small: list[int], leaf_of, used, layers, rng) -> dict[int, tuple]:
        """Best splits of new leaves ``(parent, smaller, larger)``, of which the ``small`` ones are counted."""
        if not small:
            return {}
        for (i, few, many), counted in zip(pairs, self._counted(leaf_of, used, small, layers)):
            hist[few] = counted
            hist[many] = hist.pop(i) - counted
        fresh, out = sorted(x for pair in pairs for x in pair[1:]), {}
        step = max(1, CELLS // len(self.bins.edges))
        for lo in range(0, len(fresh), step):
            group = fresh[lo : lo + step]
            out.update(zip(group, self._splits(np.stack([hist[x] for x in group]), rng)))
        return out

    def _leaf_wise(self, used: np.ndarray, layers: np.ndarray, rng: np.random.Generator) -> tuple[list[list], np.ndarray]:
        """The tree that always splits its best leaf, in a round per level and not per leaf.

        A round splits all leaves that may come next, and then the tree takes the best of what is known until it asks for
        a leaf that is not split yet. Splits that it never takes are given up in the end.
        """
        leaf_of = np.zeros(len(used), np.int64)
        hist = {0: self._counted(leaf_of, used, [0], layers)[0]}
        found = {0: self._splits(hist[0][None], rng)[0]}
        depth, children = {0: 0}, {}
        while True:
            nodes, places, wanted = self._taken(found, children)
            if not wanted:
                break
            splits, small, pairs = {}, [], []
            for i in wanted:
                _, at, left, total = found[i]
                a, b = len(depth), len(depth) + 1
                depth[a] = depth[b] = depth[i] + 1
                children[i] = a, b
                splits[i] = (at, a, b)
                if not self.o["depth"] or depth[a] < self.o["depth"]:
                    few, many = (a, b) if left[2] <= total[2] - left[2] else (b, a)
                    small.append(few)
                    pairs.append((i, few, many))
            leaf_of = self._moved(leaf_of, splits)
            found.update(self._children(hist, pairs, small, leaf_of, used, layers, rng))
        final = np.zeros(len(depth), np.int64)
        for i in sorted(children):  # parents come before their children
            for child in children[i]:
                final[child] = places.get(child, final[i])
        return nodes, final[leaf_of]

    def _taken(self, found: dict, children: dict) -> tuple[list[list], dict[int, int], list[int]]:
        """Nodes of the tree as far as splits are known, the place of each of its leaves among them, and the leaves to split next."""
        nodes, places, leaves = [[-1, 0.0, -1, -1, self._value(found[0][3]), 0.0]], {0: 0}, 1
        open_ = {0} if found[0][0] > LEAST_GAIN else set()
        while open_ and leaves < self.o["leaves"]:
            order = sorted(open_, key=lambda i: (-found[i][0], places[i]))
            i = order[0]
            if i not in children:
                return nodes, places, [x for x in order if x not in children][: self.o["leaves"] - leaves]
            gain, at, left, total = found[i]
            a, b = len(nodes), len(nodes) + 1
            nodes[places[i]][:4] = [int(self.bins.slots[at]), float(self.bins.edges[at]), a, b]
            nodes[places[i]][5] = gain
            for child, place, sums in zip(children[i], (a, b), (left, total - left)):
                nodes.append([-1, 0.0, -1, -1, self._value(sums), 0.0])
                places[child] = place
                if child in found and found[child][0] > LEAST_GAIN:
                    open_.add(child)
            open_.remove(i)
            leaves += 1
        return nodes, places, []


    def run(self) -> dict:
        trees, gains = [], np.zeros(self.size)
        scores = np.full(len(self.labels), self.prior)
        best, best_size = np.inf, 0
        for turn in range(0 if self.one_class else self.o["trees"]):
            nodes, leaf_of = self._tree(turn, scores)
            scores += np.array([node[4] for node in nodes])[leaf_of]
            trees.append(nodes)
            if self.o["patience"]:
                margin = np.where(self.labels == 1, scores, -scores)[self.held]
                loss, n = self.team.total(np.array([np.logaddexp(0, -margin).sum(), self.held.sum()]))
                if loss < best - 1e-7 * n:
                    best, best_size = loss, len(trees)
                elif len(trees) - best_size >= self.o["patience"]:
                    trees = trees[:best_size]
                    break
        for nodes in trees:
            own = np.zeros(self.size)
            for node in nodes:
                if node[0] >= 0:
                    own[node[0]] += node[5]
            if own.sum() > 0:
                gains += own / own.sum()
        importances = gains / gains.sum() if gains.sum() > 0 else gains
        return {"prior": self.prior, "trees": [[node[:5] for node in t] for t in trees], "importances": importances.tolist()}


def _grow(options: dict, size: int):
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, rows, slots, values, n = [], [], [], [], 0
        for batch in batches:
            r, s, v = sparse_rows(*(batch.column(i) for i in (1, 2, 3)))
            labels.append(batch.column(0).to_numpy())
            rows.append((r + n).astype(np.int32))
            slots.append(s.astype(np.int32))
            values.append(v)
            n += batch.num_rows

        def joined(parts: list, kind: type) -> np.ndarray:
            whole = np.concatenate([*parts, np.zeros(0, kind)])
            parts.clear()
            return whole

        team = Team()
        trainer = _Trainer(
            team, options, size, joined(labels, float), joined(rows, np.int32), joined(slots, np.int32), joined(values, float)
        )
        state = trainer.run()
        if team.place == 0:
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(state)])], ["state"])

    return grow


# -- stages ---------------------------------------------------------------------------------------------------


class HistogramBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for labels 0 and 1.

    ``depth`` 0 sets no bound on the depth, ``leaves`` above 0 grows leaf by leaf up to that many, ``subsample`` and
    ``subset`` are the shares of rows per tree and of features per split, ``leastRows`` the least rows of a leaf. With ``patience`` the
    rows of a ``heldOut`` share are not trained on and end the boosting after so many trees without gain.
    """

    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "greatest depth", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "greatest number of leaves", TypeConverters.toInt)
    rate = Param(Params._dummy(), "rate", "learning rate", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "most bins per slot", TypeConverters.toInt)
    subsample = Param(Params._dummy(), "subsample", "share of rows per tree", TypeConverters.toFloat)
    subset = Param(Params._dummy(), "subset", "share of features per split", TypeConverters.toFloat)
    leastRows = Param(Params._dummy(), "leastRows", "least rows of a leaf", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "penalty on leaf values", TypeConverters.toFloat)
    patience = Param(Params._dummy(), "patience", "trees without gain before the end", TypeConverters.toInt)
    heldOut = Param(Params._dummy(), "heldOut", "share of rows that judge the end", TypeConverters.toFloat)
    rowsPerTask = Param(Params._dummy(), "rowsPerTask", "rows that a task should hold", TypeConverters.toInt)

    @keyword_only
    def __init__(
        self,
        *,
        trees=100,
        depth=3,
        leaves=0,
        rate=0.1,
        bins=255,
        subsample=1.0,
        subset=1.0,
        leastRows=1,
        l2=0.0,
        patience=0,
        heldOut=0.1,
        rowsPerTask=TREE_ROWS_PER_TASK,
        featuresCol="features",
        labelCol="label",
        seed=42,
    ):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(
            trees=100, depth=3, leaves=0, rate=0.1, bins=255, subsample=1.0, subset=1.0, leastRows=1, l2=0.0, patience=0,
            heldOut=0.1, rowsPerTask=TREE_ROWS_PER_TASK, featuresCol="features", labelCol="label", seed=42,
        )

    def _fit(self, dataset: DataFrame) -> "BoostedTrees":
        names = "trees depth leaves rate bins subsample subset leastRows l2 patience heldOut seed".split()
        options = {name: self.getOrDefault(name) for name in names}
        rows, size = training_rows(
            dataset, self.getLabelCol(), self.getFeaturesCol(), self.getOrDefault("rowsPerTask"), ENTRIES_PER_TASK
        )
        grown = rows.mapInArrow(_grow(options, size), "state string", barrier=True).collect()
        model = BoostedTrees(grown[0]["state"], size)
        return model._set(featuresCol=self.getFeaturesCol())


class BoostedTrees(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``probability`` and ``prediction``."""

    state = Param(Params._dummy(), "state", "the trees as JSON", TypeConverters.toString)
    size = Param(Params._dummy(), "size", "slots of the features", TypeConverters.toInt)

    def __init__(self, state: str = "", size: int = 0):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(state=state, size=size)

    @property
    def _state(self) -> dict:
        return json.loads(self.getOrDefault("state"))

    @property
    def featureImportances(self):
        return Vectors.dense(self._state["importances"])

    @property
    def getNumTrees(self) -> int:
        return len(self._state["trees"])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        score = _scorer(self._state, self.getOrDefault("size"))(*vector_parts(self.getFeaturesCol()))
        out = dataset.withColumn("probability", array_to_vector(F.array(1 - score, score)))
        return out.withColumn("prediction", (F.get(F.unwrap_udt("probability")["values"], F.lit(1)) > 0.5).cast("double"))


def _scorer(state: dict, size: int):
    """A function of a vector's parts: the probability of class 1."""
    places = np.concatenate([[0], np.cumsum([len(t) for t in state["trees"]])]).astype(np.int64)
    flat = np.array([node for t in state["trees"] for node in t], float).reshape(-1, 5)
    base = np.repeat(places[:-1], np.diff(places))
    slot, edge, value = flat[:, 0].astype(np.int64), flat[:, 1], flat[:, 4]
    self_ = np.arange(len(flat))
    left = np.where(slot < 0, self_, flat[:, 2].astype(np.int64) + base)
    right = np.where(slot < 0, self_, flat[:, 3].astype(np.int64) + base)
    used = np.unique(slot[slot >= 0])
    spot = np.full(size + 1, -1, np.int64)
    spot[used] = np.arange(len(used))
    column = np.where(slot < 0, 0, spot[slot])
    prior, roots = state["prior"], places[:-1]

    @arrow_udf("double")
    def score(kinds: pa.Array, indices: pa.Array, values: pa.Array) -> pa.Array:
        out = np.full(len(kinds), prior)
        if len(roots):
            rows, slots, entries = sparse_rows(kinds, indices, values)
            here = spot[slots]
            rows, here, entries = rows[here >= 0], here[here >= 0], entries[here >= 0]
            for lo in range(0, len(kinds), 1000):
                hi = min(len(kinds), lo + 1000)
                a, b = np.searchsorted(rows, [lo, hi])
                x = np.zeros((hi - lo, max(1, len(used))))
                x[rows[a:b] - lo, here[a:b]] = entries[a:b]
                node = np.broadcast_to(roots, (hi - lo, len(roots))).copy()
                each = np.arange(hi - lo)[:, None]
                while True:
                    moved = np.where(x[each, column[node]] <= edge[node], left[node], right[node])
                    if (moved == node).all():
                        break
                    node = moved
                out[lo:hi] += value[node].sum(axis=1)
        return pa.array(1 / (1 + np.exp(-out)))

    return score
