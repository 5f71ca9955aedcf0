"""Leading time-lagged components of any number of features, by block iteration.

The slowest components solve ``Ct v = s C0 v`` with the symmetric covariances of rows
and of rows a lag apart. Neither matrix is ever formed: a pass over the pairs of rows
multiplies a thin block by both at once. The search space grows by the residuals of the
best components so far, kept orthonormal under ``C0`` (which whitens without a square
root of it), and is cut back to its best directions when it has become wide. So the
driver holds some ``MOST`` blocks of the number of features, and a task one more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import ship_code

#: Spare directions of a block, blocks that the search space holds at most, and those that are left of them.
SPARE, MOST, LEFT = 10, 16, 4
#: The most passes, and the relative residual that ends them.
MAX_PASSES, TOLERANCE = 200, 1e-7
#: Share of a direction's size under ``C0`` below which it adds nothing to the space.
LEAST = 1e-12
#: Values of a slice of rows that is multiplied at once.
SLICE = 1 << 22


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _summed(pairs: DataFrame, partial) -> np.ndarray:
    """The sum over all rows of ``partial(now, later)``; tasks' sums are added up in Spark, by place."""

    def run(batches):
        total = None
        for batch in batches:
            if not len(batch):
                continue
            now, later = _matrix(batch.column(0)), _matrix(batch.column(1))
            step = max(1, SLICE // now.shape[1])
            for low in range(0, len(now), step):
                part = partial(now[low : low + step], later[low : low + step])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    ship_code(pairs.sparkSession)
    sums = pairs.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    return sums.sort_values("at")["v"].to_numpy()


def _even(square: np.ndarray) -> np.ndarray:
    return (square + square.T) / 2


def leading(pairs: DataFrame, n: int, k: int, n_components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, speeds (falling) and components, a column each and of size 1 under ``C0``, of ``n`` pairs (``now``, ``later``).

    Fewer components are returned if the features have a smaller rank; ``RuntimeError``
    if they don't settle in ``MAX_PASSES`` passes. ``pairs`` is read once a pass, so it
    should be a written table.
    """
    rows = pairs.select("now", "later")
    mean = _summed(rows, lambda x, y: x.sum(0) + y.sum(0)) / (2 * n)
    # Squares about the mean, so that a large mean costs no digits.
    variance = _summed(rows, lambda x, y: ((x - mean) ** 2).sum(0) + ((y - mean) ** 2).sum(0)) / (2 * n)
    scale = np.sqrt(variance)
    scale = np.where(scale > 1e-15, scale, 1.0)

    def images(block: np.ndarray) -> np.ndarray:
        def both(x, y):
            x, y = (x - mean) / scale, (y - mean) / scale
            a, b = x @ block, y @ block
            return np.stack([x.T @ a + y.T @ b, x.T @ b + y.T @ a])

        return _summed(rows, both).reshape(2, k, -1) / (2 * n)

    width = min(k, n_components + SPARE)
    # From the range of C0, in which all residuals lie, too.
    block = images(np.random.default_rng(0).normal(size=(k, width)))[0]
    basis = c0 = ct = np.empty((k, 0))
    for _ in range(MAX_PASSES):
        block = np.linalg.qr(block)[0]
        by0, byt = images(block)
        size = np.einsum("ij,ij->j", block, by0).max()
        for _ in range(2):
            shift = c0.T @ block
            block, by0, byt = block - basis @ shift, by0 - c0 @ shift, byt - ct @ shift
        values, turn = np.linalg.eigh(_even(block.T @ by0))
        new = values > max(size, 0) * LEAST
        turn = turn[:, new] / np.sqrt(values[new])
        basis, c0, ct = (np.hstack([old, x @ turn]) for old, x in ((basis, block), (c0, by0), (ct, byt)))
        speeds, turn = np.linalg.eigh(_even(basis.T @ ct))
        speeds, turn = speeds[::-1], turn[:, ::-1]
        best = turn[:, :width]
        image = c0 @ best
        residual = ct @ best - image * speeds[:width]
        errors = np.linalg.norm(residual, axis=0)[:n_components] / np.maximum(np.linalg.norm(image, axis=0)[:n_components], 1e-300)
        if not new.any() or basis.shape[1] >= k or (len(errors) == n_components and (errors <= TOLERANCE).all()):
            return mean, speeds[:n_components], (basis @ best[:, :n_components]) / scale[:, None]
        if basis.shape[1] + width > MOST * width:
            kept = turn[:, : LEFT * width]
            basis, c0, ct = basis @ kept, c0 @ kept, ct @ kept
        block = residual
    raise RuntimeError(f"the components didn't settle in {MAX_PASSES} passes; ask for fewer or other ones")
