"""Free-energy surfaces from two-dimensional histograms."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.session import staged

# Fixed value: the gas constant in kJ/mol/K.
GAS_CONSTANT = 8.314462618e-3
DEFAULT_TEMPERATURE = 298.15


def with_bin(df: DataFrame, column: str, low: float, high: float, bins: int, name: str) -> DataFrame:
    """Adds the bin of a value among equal bins; the last one is closed, outside is null.

    The index is corrected against the edges themselves, ``low + k * (high - low) / bins``,
    so that a value on an edge falls into the bin above.
    """
    width = (high - low) / bins
    x, k = F.col(column), F.col(name)
    df = df.withColumn(name, F.when(x.between(low, high), F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int")))
    df = df.withColumn(name, F.when((k > 0) & (x < low + k * width), k - 1).otherwise(k))
    return df.withColumn(name, F.when((k < bins - 1) & (x >= low + (k + 1) * width), k + 1).otherwise(k))


def free_energy(
    samples: DataFrame,
    x: str,
    y: str,
    bins: int | tuple[int, int] = 50,
    temperature_k: float = DEFAULT_TEMPERATURE,
    min_probability: float = 1e-12,
    ranges: tuple[tuple[float, float], tuple[float, float]] | None = None,
) -> DataFrame:
    """One row a cell: ``bx``, ``by``, its edges, ``n``, ``density``, ``observed``, ``free_energy``.

    ``-RT ln(density)`` with the least at 0; cells whose density is not above
    ``min_probability`` have none. Samples are counted by cell before the shuffle; the
    grid has as many rows as cells.
    """
    nx, ny = (bins, bins) if isinstance(bins, int) else bins
    if temperature_k <= 0 or min_probability <= 0:
        raise ValueError("temperature and min_probability must be positive")
    if nx < 1 or ny < 1:
        raise ValueError("bins must be positive")
    spark = samples.sparkSession
    xy = samples.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    if ranges is None:
        low = xy.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.count("*")).first()
        if low[4] < 2:
            raise ValueError("at least two samples are needed")
        ranges = tuple((a - 0.5, b + 0.5) if a == b else (a, b) for a, b in ((low[0], low[1]), (low[2], low[3])))
    (x0, x1), (y0, y1) = ((float(a), float(b)) for a, b in ranges)
    if x1 <= x0 or y1 <= y0:
        raise ValueError("ranges must not be empty")
    binned = with_bin(with_bin(xy, "x", x0, x1, nx, "bx"), "y", y0, y1, ny, "by")
    counts = binned.select("bx", "by").dropna().groupBy("bx", "by").agg(F.count("*").alias("n"))
    counts = staged(counts, "cell-counts")
    total, largest = counts.agg(F.sum("n"), F.max("n")).first()
    if not total:
        raise ValueError("no cell was sampled")
    wx, wy = (x1 - x0) / nx, (y1 - y0) / ny
    grid = spark.range(nx * ny).select(F.floor(F.col("id") / ny).cast("int").alias("bx"), (F.col("id") % ny).cast("int").alias("by"))
    cells = grid.join(counts, ["bx", "by"], "left")
    cells = cells.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("density", F.col("n") / F.lit(total * wx * wy))
    cells = cells.withColumn("observed", F.col("density") > min_probability)
    rt = GAS_CONSTANT * temperature_k
    raw = F.when(F.col("observed"), -rt * F.ln(F.greatest("density", F.lit(min_probability))))
    cells = cells.withColumn("raw", raw)
    top = largest / (total * wx * wy)
    if top <= min_probability:
        raise ValueError("no cell is above min_probability")
    least = -rt * math.log(top)
    return cells.select(
        "bx", "by",
        (x0 + F.col("bx") * wx).alias("x_lo"), (x0 + (F.col("bx") + 1) * wx).alias("x_hi"),
        (y0 + F.col("by") * wy).alias("y_lo"), (y0 + (F.col("by") + 1) * wy).alias("y_hi"),
        "n", "density", "observed", F.greatest(F.col("raw") - F.lit(least), F.when(F.col("observed"), F.lit(0.0))).alias("free_energy"),
    )


def free_energy_of_projection(projection: DataFrame, features: str, x_index: int = 0, y_index: int = 1, **options) -> DataFrame:
    """The surface of two components of an array column."""
    if x_index < 0 or y_index < 0:
        raise ValueError("component numbers must not be negative")
    xy = projection.select(F.get(features, F.lit(x_index)).alias("x"), F.get(features, F.lit(y_index)).alias("y"))
    return free_energy(xy, "x", "y", **options)
