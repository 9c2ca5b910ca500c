"""Principal components of wide vectors (J9) by randomised subspace iteration.

The covariance matrix is never formed. A basis of ``k`` and a few more directions is multiplied by the centred rows and back,
as a product per task whose results (width x directions) are added up in two steps; the driver orthogonalises that narrow
matrix. After ``rounds`` such products the leading directions of the basis are the components. Memory on the driver and in a
task is some width x directions numbers, whatever the number of rows.

Signs are fixed: the entry of a component that is largest in size is positive (ties: the first).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import spread

MORE = 8  # directions beyond those asked for
ROUNDS = 12
ROWS = 256  # multiplied at once
FIRST = 16  # components tried first when a share of the variance is asked for


@dataclass
class Components:
    """``axes`` is (width, k), unit columns; ``variances`` those along them; ``total`` the variance of all columns."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    total: float

    def first(self, k: int) -> "Components":
        return Components(self.mean, self.axes[:, :k], self.variances[:k], self.total)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.column(0).slice(at, ROWS)
            yield part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _added(rows: DataFrame, of_block, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of ``of_block(rows of a block)`` over all rows, added up in two steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for block in _blocks(batches):
            one = of_block(block)
            total = one if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["s"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0):
                one = row.values.to_numpy()
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["s"])

    few = max(1, int(rows.rdd.getNumPartitions() ** 0.5))
    got = rows.mapInArrow(run, "s array<double>").repartition(few).mapInArrow(add, "s array<double>").toLocalIterator()
    out = np.zeros(int(np.prod(shape)))
    for r in got:
        out += np.array(r["s"])
    return out.reshape(shape)


def components(df: DataFrame, col: str, k: int | None = None, variance: float | None = None, most: int | None = None, rounds: int = ROUNDS,
               seed: int = 0) -> Components:
    """The first ``k`` components of the vectors in ``col`` (a vector or array column without nulls), or the fewest that
    reach the share ``variance`` (``most`` at most)."""
    if k is None and variance is None:
        raise ValueError("pca needs k or variance")
    array = F.col(f"`{col}`") if df.schema[col].dataType.typeName() == "array" else vector_to_array(F.col(f"`{col}`"))
    rows = spread(df.select(array.cast("array<double>").alias("x")))
    first = rows.first()
    if first is None:
        raise ValueError("pca needs rows")
    width = len(first["x"])
    sums = _added(rows, lambda x: np.concatenate([[len(x)], x.sum(0)]), (width + 1,))
    n, mean = sums[0], sums[1:] / sums[0]
    total = float(_added(rows, lambda x: np.array([((x - mean) ** 2).sum()]), (1,))[0] / n)
    wanted = min(width, k if k is not None else FIRST)
    limit = min(width, most or width)
    while True:
        directions = min(width, wanted + MORE)
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, directions)))[0]
        for _ in range(rounds):
            sent = df.sparkSession.sparkContext.broadcast((mean, basis))
            basis = np.linalg.qr(_added(rows, _round_trip(sent), (width, directions)))[0]
        sent = df.sparkSession.sparkContext.broadcast((mean, basis))
        small = _added(rows, _inner(sent), (directions, directions)) / n
        values, turn = np.linalg.eigh(small)
        order = np.argsort(-values)[:wanted]
        axes, values = basis @ turn[:, order], np.maximum(values[order], 0)
        axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
        found = Components(mean, axes, values, total)
        if k is not None:
            return found
        share = np.cumsum(values) / total if total else np.ones(len(values))
        enough = np.flatnonzero(share >= variance - 1e-12)
        if len(enough):
            return found.first(int(enough[0]) + 1)
        if wanted >= limit:
            return found.first(limit)
        wanted = min(limit, wanted * 2)


def _round_trip(sent):
    def product(x: np.ndarray) -> np.ndarray:
        mean, basis = sent.value
        z = x - mean
        return z.T @ (z @ basis)

    return product


def _inner(sent):
    def product(x: np.ndarray) -> np.ndarray:
        mean, basis = sent.value
        y = (x - mean) @ basis
        return y.T @ y

    return product


def project(df: DataFrame, col: str, found: Components, out: str = "pca") -> DataFrame:
    """``df`` with the coordinates of the centred vectors along the components, as a vector column."""
    sent = df.sparkSession.sparkContext.broadcast(found)
    is_array = df.schema[col].dataType.typeName() == "array"

    @F.pandas_udf("array<double>")
    def along(x: pd.Series) -> pd.Series:
        c = sent.value
        flat = np.concatenate([np.asarray(v, np.float64) for v in x]).reshape(len(x), -1) if len(x) else np.zeros((0, len(c.mean)))
        return pd.Series(list((flat - c.mean) @ c.axes), dtype=object)

    x = F.col(f"`{col}`") if is_array else vector_to_array(F.col(f"`{col}`"))
    return df.withColumn(out, array_to_vector(along(x.cast("array<double>"))))
