"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from orrery.session import scratch_path, scratch_root, staged
from orrery.session import ship_code as _ship_code

__all__ = [
    "DOC_COLUMNS", "read_table", "scratch_path", "scratch_root", "ship_code", "staged",
    "fnv_mix", "release", "slices_by_bytes", "slices_by_chars", "unique_key", "worker_cache",
]

#: The columns of ``documents``; stages of the pipeline return exactly these.
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: Rows of an Arrow batch: whole texts are long, and a batch is held several times over.
BATCH_ROWS = 1_000
_BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def ship_code(spark: SparkSession) -> None:
    """Makes the package importable in workers, and batches small enough for long texts."""
    _ship_code(spark)
    now = int(spark.conf.get(_BATCH_SETTING, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(_BATCH_SETTING, str(BATCH_ROWS))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fnv_mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of ``x`` under ``seed``."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(seed & 0xFFFFFFFFFFFFFFFF) * _GOLD + _GOLD
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def slices_by_chars(column: pa.Array, limit: int):
    """Split a string column into (start, stop) runs of about ``limit`` characters.

    A text longer than the limit gets a run of its own, whole.
    """
    yield from _slices(pc.fill_null(pc.utf8_length(column), 0).to_pylist(), limit)


def slices_by_bytes(column: pa.Array, limit: int):
    """The same for the bytes of a binary column."""
    yield from _slices(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit)


def _slices(sizes: list[int], limit: int):
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


_KEPT: dict = {}


def worker_cache(key, make):
    """What a Python worker keeps between batches: one thing at a time, the last asked for.

    Workers are used again by later stages; without this, each stage's words would
    stay in memory beside the next one's.
    """
    if key not in _KEPT:
        _KEPT.clear()
        release()
        _KEPT[key] = make()
    return _KEPT[key]


def unique_key(name: str) -> tuple[str, str]:
    """A key of ``worker_cache`` that no other model shares, whatever driver and worker were used for before."""
    return name, uuid.uuid4().hex


def release() -> None:
    """Gives the memory that a worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # only glibc has it
        pass
