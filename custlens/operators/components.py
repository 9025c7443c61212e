"""Leading principal components of wide sparse vectors by block subspace iteration.

A pass multiplies the covariance with a block of ``m`` directions as ``X'(XQ)``: tasks keep one sum per filled slot and direction, Spark adds
these up by slot, and the driver sees ``slots x m`` numbers, never ``slots x slots``. Between passes the block is
rotated to the directions that the covariance itself prefers inside it (Rayleigh and Ritz), so components are always uncorrelated
and come by falling variance. The block doubles until it keeps the share of variance asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCAModel
from pyspark.ml.linalg import DenseMatrix, DenseVector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from custlens.operators.boosting import sparse_rows, vector_parts
from custlens.operators.network import ROWS_AT_ONCE, Entries
from custlens.session import materialize

FIRST_BLOCK = 16
# Directions beyond those wanted, which make the wanted ones settle faster.
SPARE = 8
# Greatest residual of a wanted direction, as a share of the first variance; variances then err by its square.
TOLERANCE, PASSES = 1e-5, 200


def components_for(ratios: list[float], target: float) -> int:
    """Smallest number of leading components whose variance shares add up to ``target``."""
    total = 0.0
    for count, share in enumerate(ratios, start=1):
        total += share
        if total >= target:
            return count
    return len(ratios)


def leading_components(
    df: DataFrame, column: str, target: float | None = None, components: int | None = None, seed: int = 42
) -> tuple[np.ndarray, np.ndarray]:
    """Directions (slots x kept, unit length) and shares of variance: ``components`` of them, or as many as keep ``target``.

    Null vectors are left out. Without rows there is nothing to fit and ``ValueError`` is raised; with no variance at all one
    direction of share 0 comes back. A direction's sign makes its largest entry positive.
    """
    summary = df.where(F.col(column).isNotNull()).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col(column)).alias("s")
    )
    found = summary.first()["s"]
    n = found["count"]
    if not n:
        raise ValueError("no rows")
    mean, total = found["mean"].toArray(), float(found["variance"].toArray().sum())
    size = len(mean)
    if total <= 0:
        return np.eye(size, 1), np.zeros(1)
    rows = materialize(df.where(F.col(column).isNotNull()).select(*vector_parts(column)), "sparse_rows")
    rng = np.random.default_rng(seed)
    wanted = components or FIRST_BLOCK
    block = np.zeros((size, 0))
    while True:
        width = min(size, wanted + SPARE)
        block = np.hstack([block, rng.normal(size=(size, width - block.shape[1]))])
        block, variances = _settle(rows, block, mean, n, min(wanted, size))
        shares = np.clip(variances / total, 0, None)
        if components or width == size or shares[:wanted].sum() >= target:
            keep = min(components or components_for(list(shares), target), size)
            signs = np.sign(block[np.abs(block).argmax(axis=0), np.arange(block.shape[1])])
            return (block * signs)[:, :keep], shares[:keep]
        wanted *= 2


def _settle(rows: DataFrame, block: np.ndarray, mean: np.ndarray, n: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The block after as many passes as its ``wanted`` first directions need, and the variance along each direction."""
    block = np.linalg.qr(block)[0]
    for _ in range(PASSES):
        image = (_product(rows, block) - n * np.outer(mean, mean @ block)) / max(n - 1, 1)
        inner = block.T @ image
        variances, turn = np.linalg.eigh((inner + inner.T) / 2)
        variances, turn = variances[::-1], turn[:, ::-1]
        block, image = block @ turn, image @ turn
        rest = np.linalg.norm(image - block * variances, axis=0)
        if rest[:wanted].max() <= TOLERANCE * max(variances[0], 1e-300) or block.shape[1] == len(mean):
            break
        block = np.linalg.qr(image)[0]
    return block, variances


def _product(rows: DataFrame, block: np.ndarray) -> np.ndarray:
    """X'(X block), added up by slot."""
    size, width = block.shape
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ways, own = shared.value, np.zeros((size, width))
        for batch in batches:
            places, slots, values = sparse_rows(*(batch.column(i) for i in range(3)))
            for low in range(0, batch.num_rows, ROWS_AT_ONCE):
                high = min(batch.num_rows, low + ROWS_AT_ONCE)
                a, b = np.searchsorted(places, [low, high])
                part = Entries(high - low, places[a:b] - low, slots[a:b], values[a:b], size)
                own += part.turned_times(part.times(ways))
        filled = np.flatnonzero(np.abs(own).sum(axis=1))
        columns = [pa.array(filled.astype("int32"))] + [pa.array(own[filled, j]) for j in range(width)]
        yield pa.RecordBatch.from_arrays(columns, ["slot", *(f"w{j}" for j in range(width))])

    schema = "slot int, " + ", ".join(f"w{j} double" for j in range(width))
    sums = rows.mapInArrow(multiply, schema).groupBy("slot").agg(*(F.sum(f"w{j}").alias(f"w{j}") for j in range(width)))
    got, out = sums.toPandas(), np.zeros((size, width))
    out[got["slot"].to_numpy()] = got.drop(columns="slot").to_numpy()
    shared.unpersist()
    return out


def as_model(df: DataFrame, ways: np.ndarray, shares: np.ndarray) -> PCAModel:
    """A Spark model that projects on the kept directions only."""
    from pyspark.ml.common import _py2java

    context = df.sparkSession.sparkContext
    matrix = _py2java(context, DenseMatrix(*ways.shape, ways.ravel(order="F").tolist()))
    java = context._jvm.org.apache.spark.ml.feature.PCAModel
    uid = f"pca_{np.random.default_rng().integers(2**40):x}"
    return PCAModel(java(uid, matrix, _py2java(context, DenseVector(shares.tolist()))))._set(k=ways.shape[1])
