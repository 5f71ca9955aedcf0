"""The floating-point policy: compute in double, cast at the edge.

The default is a setting of the session, so concurrent sessions don't meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTING = "orrery.default.dtype"
KINDS = {"float32": "float", "float64": "double"}


def set_default_dtype(spark: SparkSession, dtype: str) -> None:
    if dtype not in KINDS:
        raise ValueError("dtype must be float32 or float64")
    spark.conf.set(SETTING, dtype)


def get_default_dtype(spark: SparkSession) -> str:
    return spark.conf.get(SETTING, "float32")


def as_dtype(df: DataFrame, dtype: str | None = None) -> DataFrame:
    """All floating-point columns, and arrays of such, in one type: the given or the default."""
    dtype = dtype or get_default_dtype(df.sparkSession)
    if dtype not in KINDS:
        raise ValueError("dtype must be float32 or float64")
    kind = KINDS[dtype]
    casts = {c: kind for c, t in df.dtypes if t in ("float", "double")} | {c: f"array<{kind}>" for c, t in df.dtypes if t in ("array<float>", "array<double>")}
    return df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}) if casts else df
