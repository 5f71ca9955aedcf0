"""Nearest images in cells of any shape: the lattice is reduced once a frame, images are found in columns."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.geometry import Vector
from orrery.session import ship_code

CELL = tuple(f"{v}_{c}" for v in "abc" for c in "xyz")
#: The reduced lattice's vectors and the inverse of their matrix, by row.
LATTICE = tuple(f"{kind}{i}{j}" for kind in ("r", "i") for i in range(3) for j in range(3))


def reduced(cells: np.ndarray) -> np.ndarray:
    """Bases (n, 3, 3) of the same lattices that no sum or difference of vectors shortens (Minkowski's conditions in three dimensions)."""
    out = cells.astype(np.float64).copy()
    square = lambda v: (v * v).sum(1)
    while True:
        before = (out * out).sum()
        for k, j in ((1, 0), (2, 0), (2, 1), (0, 1), (0, 2), (1, 2)):
            turns = np.rint((out[:, k] * out[:, j]).sum(1) / np.maximum(square(out[:, j]), 1e-300))
            shorter = out[:, k] - turns[:, None] * out[:, j]
            better = square(shorter) < square(out[:, k]) * (1 - 1e-12)
            out[better, k] = shorter[better]
        for k in range(3):
            i, j = (x for x in range(3) if x != k)
            for p, q in ((1, 1), (1, -1), (-1, 1), (-1, -1)):
                shorter = out[:, k] + p * out[:, i] + q * out[:, j]
                better = square(shorter) < square(out[:, k]) * (1 - 1e-12)
                out[better, k] = shorter[better]
        if not (out * out).sum() < before * (1 - 1e-12):
            return out


def with_lattice(frames: DataFrame) -> DataFrame:
    """Adds ``LATTICE`` to frames with ``CELL``; null for a cell that is null or flat."""
    spark = frames.sparkSession
    ship_code(spark)
    kind = dict(frames.dtypes)["frame"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = np.stack([batch.column(i + 1).to_numpy(zero_copy_only=False) for i in range(9)], 1).astype(np.float64).reshape(-1, 3, 3)
            volume = np.abs(np.linalg.det(np.nan_to_num(cells)))
            good = np.isfinite(cells).all((1, 2)) & (volume > 1e-12)
            told = np.full((len(cells), 18), np.nan)
            if good.any():
                basis = reduced(cells[good])
                told[good] = np.concatenate([basis.reshape(-1, 9), np.linalg.inv(basis).reshape(-1, 9)], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(told[:, i].copy(), from_pandas=True) for i in range(18))], ["frame", *LATTICE])

    own = frames.groupBy("frame").agg(*[F.first(F.col(c).cast("double")).alias(c) for c in CELL])
    return frames.join(own.mapInArrow(run, f"frame {kind}, " + ", ".join(f"{c} double" for c in LATTICE)), "frame")


def nearest_image(d: Vector, prefix: str = "") -> Vector:
    """The shortest of a difference's images in the lattice of columns ``LATTICE``; without one as it is.

    The difference is brought near zero by its rounded fractions; in a reduced lattice the
    nearest vector is then among the 27 around.
    """
    r = [[F.col(f"{prefix}r{i}{j}") for j in range(3)] for i in range(3)]
    inv = [[F.col(f"{prefix}i{i}{j}") for j in range(3)] for i in range(3)]
    turns = [F.rint(d[0] * inv[0][k] + d[1] * inv[1][k] + d[2] * inv[2][k]) for k in range(3)]
    near = F.struct(*[(d[c] - turns[0] * r[0][c] - turns[1] * r[1][c] - turns[2] * r[2][c]).alias(n) for c, n in enumerate("xyz")])

    def image(step: tuple[int, int, int], at: Column) -> Column:
        v = [at[n] + sum((float(s) * r[k][c] for k, s in enumerate(step) if s), F.lit(0.0)) for c, n in enumerate("xyz")]
        return F.struct((v[0] * v[0] + v[1] * v[1] + v[2] * v[2]).alias("l"), *[x.alias(n) for x, n in zip(v, "xyz", strict=True)])

    best = F.element_at(F.transform(F.array(near), lambda at: F.array_min(F.array(*[image(s, at) for s in product((-1, 0, 1), repeat=3)]))), 1)
    return tuple(F.when(r[0][0].isNull(), d[c]).otherwise(best[n]) for c, n in enumerate("xyz"))
