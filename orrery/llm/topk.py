"""Exact top-k search by columnar branch-and-bound.

A tile keeps its vectors dimension by dimension. For a query, the scores of all
candidates grow block of dimensions by block, heaviest query mass first. What the
remaining dimensions can still add is at most the product of the remaining norms;
candidates whose upper bound falls below the k-th best lower bound are cut and the
survivors compacted, until the last block leaves exact integer scores.

Components are turned into ``floor(scale * x)``. Vectors whose squares add up to
``EXACT`` or more, for which the bounds are not exact, are scored with Python's
unbounded integers. Defined results: as in the nearest neighbour search, but zero
vectors take part; a score among the best that doesn't fit a long, or a component
whose ``scale * x`` is not finite, raises ``ValueError``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import ship_code
from orrery.llm.vectors import search, usable

#: Dimensions of a block.
BLOCK_DIMS = 8
#: Sums of whole numbers below this are exact in double precision.
EXACT = 2.0**53


def unbounded(own: np.ndarray, others: np.ndarray) -> list[int]:
    """Inner products of whole numbers of any size."""
    if not (np.isfinite(own).all() and np.isfinite(others).all()):
        raise ValueError("a component times the scale is not finite")
    mine = [int(x) for x in own]
    return [sum(a * int(b) for a, b in zip(mine, row, strict=True)) for row in others.tolist()]


def best_of_tile(q_ids, q, v_ids, v, k):
    """The ``k`` best candidates of each query in one tile, by whole-number scores."""
    with np.errstate(over="ignore"):
        small_q, small_v = (q**2).sum(1) < EXACT, (v**2).sum(1) < EXACT
    whole_q, whole_v = q, v
    q, v = (np.where(small[:, None], x, 0).astype(np.int64) for small, x in ((small_q, q), (small_v, v)))
    n, d = v.shape
    columns = np.ascontiguousarray(v.T)
    blocks = [np.arange(i, min(i + BLOCK_DIMS, d)) for i in range(0, d, BLOCK_DIMS)]
    mass = np.stack([(columns[b].astype(np.float64) ** 2).sum(0) for b in blocks])
    out = ([], [], [])
    for i in range(len(q_ids)):
        own = q[i]
        weight = np.array([(own[b].astype(np.float64) ** 2).sum() for b in blocks])
        order = np.argsort(-weight, kind="stable")
        others = v_ids != q_ids[i]
        left = np.flatnonzero(others & small_v & small_q[i])
        score, rest, q_rest = np.zeros(len(left), np.int64), mass.sum(0)[left], weight.sum()
        for step, b in enumerate(order.tolist()):
            dims = blocks[b]
            part = columns[dims] if len(left) == n else columns[np.ix_(dims, left)]
            score += own[dims] @ part
            rest, q_rest = rest - mass[b][left], q_rest - weight[b]
            if step + 1 < len(order) and len(left) > k:
                slack = np.sqrt(np.maximum(rest, 0) * max(q_rest, 0.0)) * (1 + 1e-9) + 1
                lower = score - slack
                cut = np.partition(lower, len(left) - k)[len(left) - k]
                alive = score + slack >= cut
                if alive.sum() < 0.8 * len(left):
                    left, score, rest = left[alive], score[alive], rest[alive]
        if len(left) > k:
            cut = np.partition(score, len(left) - k)[len(left) - k]
            alive = score >= cut
            left, score = left[alive], score[alive]
        large = np.flatnonzero(others & ~(small_v & small_q[i]))
        if len(large):
            left, score = _with_large(left, score, large, unbounded(whole_q[i], whole_v[large]), v_ids, k)
        best = np.lexsort((v_ids[left], -score))[:k]
        out[0].append(np.full(len(best), q_ids[i]))
        out[1].append(v_ids[left[best]])
        out[2].append(score[best])
    return tuple(np.concatenate(x) for x in out)


def _with_large(left, score, large, scores, v_ids, k):
    """The best ``k`` of both kinds of candidates; ``ValueError`` if one's score is no long."""
    found = [*zip(score.tolist(), left.tolist(), strict=True), *zip(scores, large.tolist(), strict=True)]
    best = sorted(found, key=lambda x: (-x[0], v_ids[x[1]]))[:k]
    if any(not -(2**63) < s < 2**63 for s, _ in best):
        raise ValueError("a score does not fit a long")
    return np.array([i for _, i in best], np.int64), np.array([s for s, _ in best], np.int64)


def exact_top(df: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` highest integer inner products: ``query_id``, ``rank``, ``vec_id``, ``score``."""
    if k < 1:
        raise ValueError("k must be positive")
    ship_code(df.sparkSession)
    vectors = usable(df, id_col, vector_col, allow_zero=True)
    # From 2^53 on a double is whole, and floor would saturate at a long's range.
    floor = lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)
    whole = vectors.select("id", F.transform("v", floor).alias("v"))
    return search(whole, is_query, k, "long", best_of_tile)
