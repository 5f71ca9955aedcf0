"""The driver's contract and the floating-point policy."""

import pytest

import __spark_entry__ as entry
from orrery.functions import dtype


def test_every_oracle_has_a_query():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 70 and all(map(callable, queries.values()))


def test_entry(spark):
    assert entry.entry(spark).count() == 21


def test_dtype(spark):
    df = spark.createDataFrame([(1, 1.5, [2.5])], "a int, b double, c array<double>")
    assert dtype.as_dtype(df).dtypes == [("a", "int"), ("b", "float"), ("c", "array<float>")]
    dtype.set_default_dtype(spark, "float64")
    try:
        assert dtype.as_dtype(df).dtypes == df.dtypes
        assert dtype.as_dtype(df, "float32").dtypes[1] == ("b", "float")
    finally:
        dtype.set_default_dtype(spark, "float32")
    for bad in (lambda: dtype.set_default_dtype(spark, "int8"), lambda: dtype.as_dtype(df, "x")):
        with pytest.raises(ValueError):
            bad()
