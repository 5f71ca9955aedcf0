"""What the two vector searches share: usable vectors, tiles, and merging by heaps."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import staged

#: Queries and vectors of a tile, about.
TILE_QUERIES, TILE_VECTORS = 1_024, 16_384


def usable(df: DataFrame, id_col: str, vector_col: str, allow_zero: bool) -> DataFrame:
    """(``id``, ``v``) of the vectors that take part.

    Left out: null ids, null vectors, those with a null or non-finite component,
    zero vectors unless allowed, and vectors of another length than most.
    """
    v = F.col(vector_col).cast("array<double>")
    sizes = df.filter(F.col(vector_col).isNotNull()).groupBy(F.size(v).alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dimension = sizes[0]["d"] if sizes else 0
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    out = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull())
    out = out.filter((F.size("v") == dimension) & (F.size("v") > 0) & ~bad)
    return out if allow_zero else out.filter(F.exists("v", lambda x: x != 0))


def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a tile's side, in the order of the ids."""
    ids = table.column("id").to_numpy()
    flat = table.column("v").combine_chunks()
    values = (flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], values.reshape(len(ids), -1)[order] if len(ids) else np.empty((0, 0))


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int,
    kind: str,
    kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]],
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the best ``k`` of each query.

    Queries and vectors are dealt by hash into blocks of a fixed size; each pair of
    blocks is a tile and one group, whose kernel returns at most ``k`` candidates a
    query. Tiles are merged by a heap of ``k`` a query. Of a query id that occurs with
    several vectors the least one, component by component, is the query.
    """
    vectors = staged(vectors, "vectors")
    queries = vectors.filter(is_query).groupBy("id").agg(F.min("v").alias("v"))
    n_v = max(1, -(-vectors.count() // TILE_VECTORS))
    n_q = max(1, -(-queries.count() // TILE_QUERIES))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(n_q))).withColumn("vb", every(n_v))
    # By row, not by id: a repeated id is spread like any other rows.
    right = vectors.withColumn("vb", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_v))).withColumn("qb", every(n_q))
    schema = f"query_id long, vec_id long, score {kind}"
    arrow = pa.float64() if kind == "double" else pa.int64()

    def tile(own: pa.Table, other: pa.Table) -> pa.Table:
        q_ids, q = matrix(own)
        v_ids, v = matrix(other)
        if len(q_ids) and len(v_ids):
            a, b, s = kernel(q_ids, q, v_ids, v, k)
        else:
            a = b = s = np.empty(0, np.int64)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, arrow)], ["query_id", "vec_id", "score"])

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(tile, schema)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap = None, []
        rows: list[tuple] = []

        def finish() -> None:
            rows.extend((now, r, -v, s) for r, (s, v) in enumerate(sorted(heap, reverse=True), 1))
            heap.clear()

        def taken() -> pa.RecordBatch:
            part = list(zip(*rows, strict=True)) or [()] * 4
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.int64()), pa.array(part[3], arrow)], ["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for q, v, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if q != now:
                    finish()
                    now = q
                if len(heap) < k:
                    heapq.heappush(heap, (s, -v))
                else:
                    heapq.heappushpop(heap, (s, -v))
            if len(rows) > 50_000:
                yield taken()
        finish()
        yield taken()

    # Sorted, so that one query's heap is held at a time.
    dealt = found.repartition("query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(merge, f"query_id long, rank int, vec_id long, score {kind}")
