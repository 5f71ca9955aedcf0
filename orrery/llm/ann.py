"""Nearest neighbours by a block matrix join with int8 tiles.

Each vector is rounded to int8 under a scale of its own. A tile's int8 products
approximate the inner products, and the rounding residuals bound the error
(``|q.v - q'.v'| <= |q'||v - v'| + |q - q'||v|``). A pair survives if its upper bound
reaches the k-th best lower bound of its query in the tile; survivors are computed
again in double precision and the tiles are merged by heaps. No pair that belongs
to the result can be lost, so the recall is 1.

Defined results: vectors that are null, zero, hold a null or non-finite component
or differ in length from most take no part, neither do null ids; a row with the
query's own id is no candidate; a repeated id is one query (its least vector), and as a
candidate counts as often as it occurs; ties go to the smaller id; an empty table gives an
empty table; columns beyond the id and the vector are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ship_code
from orrery.llm.vectors import search, usable


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 values and each row's scale."""
    scale = np.abs(x).max(1, keepdims=True) / 127
    scale[scale == 0] = 1
    return np.rint(x / scale).astype(np.int8), scale


def best_of_tile(q_ids, q, v_ids, v, k):
    """The ``k`` best candidates of each query in one tile."""
    q8, q_scale = quantise(q)
    v8, v_scale = quantise(v)
    exact = np.float32 if q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # int8 sums stay whole
    v_t = np.ascontiguousarray(v8.astype(exact).T)
    v_norm = np.linalg.norm(v, axis=1) * (1 + 1e-9)
    v_left = np.linalg.norm(v - v8 * v_scale, axis=1) * (1 + 1e-9)
    near = q8 * q_scale
    q_norm = np.linalg.norm(near, axis=1) * (1 + 1e-9)
    q_left = np.linalg.norm(q - near, axis=1) * (1 + 1e-9)
    rounding = 4 * (q.shape[1] + 4) * np.finfo(float).eps
    out = ([], [], [])
    for low in range(0, len(q_ids), 128):
        part = slice(low, low + 128)
        about = (q8[part].astype(exact) @ v_t).astype(np.float64) * q_scale[part] * v_scale[None, :, 0]
        # What double precision itself may be off grows with the norms and the dimensions.
        error = q_norm[part, None] * v_left[None, :] + q_left[part, None] * v_norm[None, :] + rounding * q_norm[part, None] * v_norm[None, :]
        own = q_ids[part, None] == v_ids[None, :]
        about[own] = -np.inf
        # Bounds beyond double precision are none: such a pair always survives.
        lower = np.nan_to_num(about - error, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        cut = np.partition(lower, len(v_ids) - k, axis=1)[:, len(v_ids) - k] if len(v_ids) > k else np.full(len(about), -np.inf)
        row, col = np.nonzero(~(about + error < cut[:, None]) & ~own)
        score = np.zeros(len(row))
        for dim in range(q.shape[1]):  # in the order of the components, as a plain loop would
            score += q[low + row, dim] * v[col, dim]
        order = np.lexsort((v_ids[col], -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row)
        kept = np.arange(len(row)) - first < k
        out[0].append(q_ids[low + row[kept]])
        out[1].append(v_ids[col[kept]])
        out[2].append(score[kept])
    return tuple(np.concatenate(x) for x in out)


def nearest(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest: ``query_id``, ``rank``, ``vec_id``, ``score`` (inner product).

    ``is_query`` is a condition on ``id``.
    """
    if k < 1:
        raise ValueError("k must be positive")
    ship_code(df.sparkSession)
    return search(usable(df, id_col, vector_col, allow_zero=False), is_query, k, "double", best_of_tile)


def every_nth(n: int) -> Column:
    return F.col("id") % n == 0
