"""Boosted trees and the network: against brute force, planted structure, and one task against several."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql.types import DoubleType, StructField, StructType

from custlens.operators import boosting as bo, network as nw
from custlens.operators.boosting import BoostedTrees, HistogramBoosting
from custlens.operators.models import classifier
from custlens.operators.network import FittedNetwork, Network
from custlens.session import scratch_path

KIND = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])


def frame(spark, x, y, sparse=False):
    def vector(row):
        at = np.flatnonzero(row)
        return Vectors.sparse(len(row), at.tolist(), row[at].tolist()) if sparse else Vectors.dense(row)

    return spark.createDataFrame([(float(b), vector(a)) for a, b in zip(x, y)], KIND)


def planted(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)), 2)
    x[rng.random(x.shape) < 0.4] = 0
    y = ((x[:, 0] > 0.2) ^ (x[:, 1] > 0)).astype(int)  # an interaction: no single feature tells
    return x, y


def chances(model, df):
    return np.array([r["probability"][1] for r in model.transform(df).select("probability").collect()])


def brute_tree(x, g, h, depth, least=1):
    """Value of each row under greedy splits between neighbouring values, by the gain of Newton steps."""
    worth = lambda a: g[a].sum() ** 2 / (h[a].sum() + 1e-12)

    def grow(at, left):
        best = (bo.LEAST_GAIN, None)
        for slot in range(x.shape[1]) if left else []:
            values = np.unique(x[at, slot])
            for cut in (values[1:] + values[:-1]) / 2:
                a, b = at[x[at, slot] <= cut], at[x[at, slot] > cut]
                gain = worth(a) + worth(b) - worth(at)
                if min(len(a), len(b)) >= least and gain > best[0] + 1e-12:
                    best = (gain, (a, b))
        if best[1] is None:
            return {int(i): g[at].sum() / (h[at].sum() + 1e-12) for i in at}
        return grow(best[1][0], left - 1) | grow(best[1][1], left - 1)

    found = grow(np.arange(len(x)), depth)
    return np.array([found[i] for i in range(len(x))])


@pytest.mark.parametrize("sparse, least", [(False, 1), (True, 15)])
def test_trees_against_brute_force(spark, sparse, least):
    x, y = planted(150, 3)
    prior = np.log(y.mean() / (1 - y.mean()))
    score = np.full(len(y), prior)
    for _ in range(3):
        p = 1 / (1 + np.exp(-score))
        score += 0.5 * brute_tree(x, y - p, p * (1 - p), 3, least)
    df = frame(spark, x, y, sparse)
    model = HistogramBoosting(trees=3, depth=3, rate=0.5, leastRows=least, bins=1000).fit(df)
    assert np.allclose(chances(model, df), 1 / (1 + np.exp(-score)))


def test_tasks_grow_the_same_trees(spark):
    x, y = planted(300, 5)
    df = frame(spark, x, y, sparse=True)
    settings = {"trees": 2, "depth": 2, "bins": 400}
    one = HistogramBoosting(**settings).fit(df)
    three = HistogramBoosting(**settings, rowsPerTask=100).fit(df)
    assert np.allclose(chances(one, df), chances(three, df))
    network = {"hidden": [3], "maxIter": 3, "rate": 0.1}
    one, three = Network(**network).fit(df), Network(**network, rowsPerTask=100).fit(df)
    assert np.allclose(chances(one, df), chances(three, df))


def test_leaf_wise_growth_and_early_end(spark):
    x, y = planted(600, 7)
    unsure = np.random.default_rng(5).random(len(y)) < 0.1
    df, fresh = frame(spark, x, np.where(unsure, 1 - y, y)), planted(400, 8)
    model = HistogramBoosting(trees=60, depth=0, leaves=6, leastRows=5, rate=0.3).fit(df)
    sizes = [sum(node[0] < 0 for node in tree) for tree in model._state["trees"]]
    assert max(sizes) == 6 and model.getNumTrees == 60
    right = (chances(model, frame(spark, *fresh)) > 0.5) == fresh[1]
    assert right.mean() > 0.93
    clean = HistogramBoosting(trees=10, depth=0, leaves=6, leastRows=5, rate=0.3).fit(frame(spark, x, y))
    assert clean.featureImportances.toArray()[:2].sum() > 0.8
    noise = np.random.default_rng(1).integers(0, 2, len(y))
    short = HistogramBoosting(trees=200, depth=4, patience=3, heldOut=0.3, rate=0.5).fit(frame(spark, x, noise))
    assert short.getNumTrees < 30


def test_leaf_wise_growth_takes_rounds_by_level():
    """The tree of always splitting the best leaf, with far fewer sums over the tasks than leaves."""

    class Alone:
        size, place, sums = 1, 0, 0

        def gather(self, array):
            return [array]

        def total(self, array):
            self.sums += 1
            return array

    rng = np.random.default_rng(8)
    n, size = 3000, 4
    x = rng.normal(size=(n, size))
    labels = (np.sin(3 * x[:, 0]) + x[:, 1] * x[:, 2] + rng.normal(size=n) > 0).astype(float)
    rows, slots = np.nonzero(x)
    options = dict(trees=1, depth=0, leaves=24, rate=0.1, bins=64, subsample=1.0, subset=1.0, leastRows=5, l2=0.0,
                   patience=0, heldOut=0.1, seed=1)
    team = Alone()
    trainer = bo._Trainer(team, options, size, labels, rows, slots, x[rows, slots])
    team.sums = 0
    nodes, leaf_of = trainer._tree(0, np.zeros(n))
    assert team.sums <= 14
    # By hand: split the best leaf again and again, each on its own.
    layers = np.stack([labels - 0.5, np.full(n, 0.25), np.ones(n)])
    used, found, own, made = np.ones(n, bool), {}, np.zeros(n, np.int64), 1
    best = lambda leaf: trainer._splits(trainer._counted(own, used, [leaf], layers), rng)[0]
    found[0] = best(0)
    gains = []
    while made < 2 * 24 - 1:
        leaf = min(found, key=lambda i: (-found[i][0], i))
        gain, at, _, _ = found.pop(leaf)
        own = trainer._moved(own, {leaf: (at, made, made + 1)})
        gains.append(gain)
        for child in (made, made + 1):
            found[child] = best(child)
        made += 2
    assert sorted(node[5] for node in nodes)[-23:] == pytest.approx(sorted(gains), rel=1e-6)
    assert (leaf_of == own).all()


def test_few_bins_and_shares(spark):
    x, y = planted(600, 9)
    df = frame(spark, x, y)
    model = HistogramBoosting(trees=40, depth=4, bins=16, subsample=0.7, subset=0.5, seed=3).fit(df)
    again = HistogramBoosting(trees=40, depth=4, bins=16, subsample=0.7, subset=0.5, seed=3).fit(df)
    assert np.array_equal(chances(model, df), chances(again, df))
    assert ((chances(model, df) > 0.5) == y).mean() > 0.9
    edges = {node[1] for tree in model._state["trees"] for node in tree if node[0] == 2}
    assert len(edges) <= 15


def test_bins_hold_equal_shares():
    rng = np.random.default_rng(2)
    values = rng.normal(size=5000)
    summary = bo._summary(np.zeros(5000, int), values, 8 * 32)
    assert len(summary) <= 8 * 32 and summary[:, 2].sum() == 5000
    bins = bo._bins(summary, 1, 5000, 32)
    counts = np.bincount(np.searchsorted(bins.edges, values), minlength=32)
    assert len(bins.edges) == 32 and counts.min() > 100 and counts.max() < 220


def test_corner_cases(spark):
    x, y = planted(80, 1)
    ones = HistogramBoosting(trees=3).fit(frame(spark, x, np.ones(80)))
    assert (chances(ones, frame(spark, x, y)) > 0.99).all()
    flat = HistogramBoosting(trees=3).fit(frame(spark, np.ones((80, 2)), y))
    assert np.allclose(chances(flat, frame(spark, x[:, :2], y)), y.mean())
    holes = frame(spark, x, y).unionByName(spark.createDataFrame([(None, Vectors.dense([1, 2, 3, 4])), (1.0, None)], KIND))
    model, same = HistogramBoosting(trees=3).fit(holes), HistogramBoosting(trees=3).fit(frame(spark, x, y))
    assert np.allclose(chances(model, frame(spark, x, y)), chances(same, frame(spark, x, y)))
    for estimator in (HistogramBoosting(), Network()):
        with pytest.raises(ValueError):
            estimator.fit(frame(spark, x, y).limit(0))
    assert model.transform(frame(spark, x, y).limit(0)).count() == 0
    path = scratch_path(spark, "trees")
    model.write().save(path)
    assert np.array_equal(chances(BoostedTrees.load(path), frame(spark, x, y)), chances(model, frame(spark, x, y)))
    dense, sparse = frame(spark, x, y), frame(spark, x, y, sparse=True)
    assert np.array_equal(chances(model, dense.unionByName(sparse))[:80], chances(model, sparse))


def test_preset_differs_by_growth(spark):
    x, y = planted(900, 2)
    df = frame(spark, x, np.where(np.random.default_rng(2).random(900) < 0.3, 1 - y, y))
    tree = lambda m: m._state["trees"][0]
    level, leaf = classifier("Gradient Boosting", trees=2).fit(df), classifier("HistGradientBoosting", trees=2).fit(df)
    assert len(tree(level)) <= 15 and len(tree(leaf)) > 15


# -- network --------------------------------------------------------------------------------------------------


def test_filled_blocks_multiply_as_matrices():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 6)) * (rng.random((50, 6)) < 0.5)
    rows, slots = np.nonzero(x)
    few = nw.Entries(50, rows, slots, x[rows, slots], 6)
    wide = nw.Entries(50, rows, slots, x[rows, slots], 6 * 200)
    assert few.filled and not wide.filled
    right, back = rng.normal(size=(6, 3)), rng.normal(size=(50, 3))
    long = np.zeros((6 * 200, 3))
    long[:6] = right
    np.testing.assert_allclose(few.times(right), wide.times(long))
    np.testing.assert_allclose(few.turned_times(back), wide.turned_times(back)[:6])


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_gradients_by_differences(activation):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(20, 5)) * (rng.random((20, 5)) < 0.6)
    y = rng.integers(0, 2, 20).astype(float)
    rows, slots = np.nonzero(x)
    entries = nw.Entries(20, rows, slots, x[rows, slots], 5)
    weights = [w + rng.normal(scale=0.1, size=w.shape) for w in nw._start([5, 4, 3, 1], 1)]
    assert np.allclose(nw.answers(weights, entries, activation)[-1], nw.answers(weights, x, activation)[-1])
    _, grads = nw.gradients(weights, entries, y, activation)
    for w, g in zip(weights, grads):
        for at in list(np.ndindex(w.shape))[:6]:
            w[at] += 1e-6
            above = nw.gradients(weights, entries, y, activation)[0]
            w[at] -= 2e-6
            below = nw.gradients(weights, entries, y, activation)[0]
            w[at] += 1e-6
            assert np.isclose(g[at], (above - below) / 2e-6, atol=1e-4)


@pytest.mark.parametrize("activation", ["relu", "tanh"])
def test_network_recovers_xor(spark, activation):
    rng = np.random.default_rng(4)
    x = rng.choice([-1.0, 1.0], (200, 2)) + rng.normal(scale=0.1, size=(200, 2))
    y = (x[:, 0] * x[:, 1] < 0).astype(int)
    df = frame(spark, x, y)
    model = Network(hidden=[8, 4], activation=activation, rate=0.03, decay=1e-4).fit(df)
    assert ((chances(model, df) > 0.5) == y).mean() > 0.97
    heavy = Network(hidden=[8, 4], activation=activation, rate=0.03, decay=500.0).fit(df)
    assert np.ptp(chances(heavy, df)) < 0.2
    path = scratch_path(spark, "network")
    model.write().save(path)
    assert np.array_equal(chances(FittedNetwork.load(path), df), chances(model, df))
    with pytest.raises(ValueError):
        Network(activation="step").fit(df)


class _Alone:
    """A team of one task."""

    size, place = 1, 0

    def gather(self, array):
        return [array]

    def total(self, array):
        return array


def _trainer(x, labels, **options):
    rows, slots = np.nonzero(x)
    options = dict(trees=1, depth=3, leaves=0, rate=0.1, bins=64, subsample=1.0, subset=1.0, leastRows=1, l2=0.0,
                   patience=0, heldOut=0.1, seed=1) | options
    return bo._Trainer(_Alone(), options, x.shape[1], labels, rows, slots, x[rows, slots])


def test_rows_are_held_in_few_bytes():
    """A task's rows as codes: a byte a row for filled slots and eight bytes an entry for the others, zeros left out."""
    rng = np.random.default_rng(4)
    n = 2000
    x = np.concatenate([rng.normal(size=(n, 5)), np.eye(30)[rng.integers(0, 30, n)]], axis=1)
    trainer = _trainer(x, (x[:, 0] > 0).astype(float))
    held = sum(c.nbytes for c in trainer.columns.values()) + trainer.rows.nbytes + trainer.codes.nbytes
    assert held <= (5 + 8) * n  # 144 bytes a row before


def test_columns_and_entries_count_alike():
    """Histograms and moves of many leaves against plain numpy, with filled and sparse slots and rows left out."""
    rng = np.random.default_rng(5)
    n = 600
    x = np.round(rng.normal(size=(n, 4)), 1)
    x[:, 2:][rng.random((n, 2)) < 0.9] = 0
    trainer = _trainer(x, (x[:, 0] > 0).astype(float))
    assert sorted(trainer.columns) == [0, 1]
    leaf_of, used = rng.integers(0, 20, n), rng.random(n) < 0.8
    layers = np.stack([rng.normal(size=n), rng.random(n)])
    hist = trainer._counted(leaf_of, used, [3, 19], layers)
    bins = trainer.bins
    for slot in range(4):
        a, b = bins.firsts[slot], bins.firsts[slot + 1]
        code = np.searchsorted(bins.edges[a:b], x[:, slot])
        for place, leaf in enumerate((3, 19)):
            own = used & (leaf_of == leaf)
            for layer, weight in enumerate([*layers, np.ones(n)]):
                assert np.allclose(hist[place, layer, a:b], np.bincount(code[own], weight[own], b - a))
    for few in (2, 20):  # looked up one by one, and after one sort
        cuts = {leaf: int(rng.integers(0, len(bins.edges))) for leaf in range(few)}
        moved = trainer._moved(leaf_of, {leaf: (cut, 100 + leaf, 200 + leaf) for leaf, cut in cuts.items()})
        for leaf, cut in cuts.items():
            own, slot = leaf_of == leaf, bins.slots[cut]
            left = x[own, slot] <= bins.edges[cut]
            assert (moved[own] == np.where(left, 100 + leaf, 200 + leaf)).all()
        assert (moved[leaf_of >= few] == leaf_of[leaf_of >= few]).all()
