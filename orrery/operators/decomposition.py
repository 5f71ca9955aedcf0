"""Features, principal components and time-lagged components.

A feature table has ``frame`` and ``features array<double>``. Fitting takes one
aggregation pass: every task sums its rows' outer products with numpy, and one small
row a task is added up. Only the moments, a matrix of the number of features, reach
the driver. Components of more than ``MAX_FEATURES`` features are iterated for
(time-lagged ones in ``lagged``): a pass over the rows multiplies a thin block by their
covariance, so what reaches the driver is as wide as the components asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.geometry import dihedral, point
from orrery.operators.lagged import leading
from orrery.session import ship_code, staged

#: Features whose square reaches the driver; principal components of more are iterated for.
MAX_FEATURES = 4_000
#: The iteration's spare directions, its most passes, and the relative change of the variances that ends it.
SPARE, MAX_PASSES, TOLERANCE = 10, 60, 1e-8


@dataclass(frozen=True)
class Projection:
    """A fitted linear projection."""

    mean: np.ndarray
    scale: np.ndarray
    components: np.ndarray
    explained_variance_ratio: np.ndarray


def _matrix(column) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def width(features: DataFrame, column: str = "features") -> int:
    """The number of features; ``ValueError`` if rows differ, or there are too few rows."""
    sizes = features.agg(F.min(F.size(column)), F.max(F.size(column)), F.count("*")).first()
    if not sizes[2] or sizes[2] < 2:
        raise ValueError("at least two rows are needed")
    if sizes[0] != sizes[1] or sizes[0] < 1:
        raise ValueError("rows have different or no features")
    return sizes[0]


def moments(rows: DataFrame, columns: list[str]) -> tuple[int, list[np.ndarray], dict[tuple[str, str], np.ndarray]]:
    """Count, sums, and summed outer products of array columns over all rows."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]

    def partial(batches):
        n, sums, outer = 0, None, None
        for batch in batches:
            data = {c: _matrix(batch.column(i)) for i, c in enumerate(columns)}
            if not len(batch):
                continue
            s = [data[c].sum(0) for c in columns]
            o = [data[a].T @ data[b] for a, b in pairs]
            n += len(batch)
            sums = s if sums is None else [x + y for x, y in zip(sums, s, strict=True)]
            outer = o if outer is None else [x + y for x, y in zip(outer, o, strict=True)]
        if n:
            flat = np.concatenate([*sums, *[x.ravel() for x in outer]])
            # By place, so that the sums of tasks are added up in Spark.
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat) + 1)), pa.array(np.concatenate([[float(n)], flat]))], ["at", "v"])

    ship_code(rows.sparkSession)
    totals = rows.select(*columns).mapInArrow(partial, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas().sort_values("at")["v"].to_numpy()
    n = int(totals[0]) if len(totals) else 0
    if not n:
        raise ValueError("no rows")
    k = rows.select(F.size(columns[0])).first()[0]
    sums = [totals[1 + i * k : 1 + (i + 1) * k] for i in range(len(columns))]
    start = 1 + len(columns) * k
    outer = {p: totals[start + i * k * k : start + (i + 1) * k * k].reshape(k, k) for i, p in enumerate(pairs)}
    return n, sums, outer


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Each column turned so that its largest loading is positive."""
    at = np.abs(vectors).argmax(0)
    return vectors * np.sign(vectors[at, np.arange(vectors.shape[1])])


def fit_pca(features: DataFrame, n_components: int = 2, standardize: bool = True, column: str = "features") -> Projection:
    """Principal components; standardising divides by the population deviation (1 where it is 0).

    Beyond ``MAX_FEATURES`` features the components are iterated for; ``RuntimeError`` if
    they don't settle.
    """
    k = width(features, column)
    if not 1 <= n_components <= k:
        raise ValueError(f"n_components must lie between 1 and {k}")
    if k > MAX_FEATURES:
        return _iterated_pca(features, k, n_components, standardize, column)
    n, (total,), outer = moments(features, [column])
    mean = total / n
    covariance = outer[column, column] / n - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(covariance), 0)) if standardize else np.ones(k)
    scale = np.where(scale > 1e-15, scale, 1.0)
    values, vectors = np.linalg.eigh(covariance / np.outer(scale, scale))
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), _signed(vectors[:, order])
    return Projection(mean, scale, vectors[:, :n_components].T, values[:n_components] / max(values.sum(), 1e-300))


def _summed_by_place(rows: DataFrame, partial) -> np.ndarray:
    """The sum over all tasks of ``partial``'s arrays (one a task), added up in Spark."""

    def run(batches):
        total = None
        for batch in batches:
            if len(batch):
                part = partial(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    ship_code(rows.sparkSession)
    sums = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    return sums.sort_values("at")["v"].to_numpy()


def _iterated_pca(features: DataFrame, k: int, n_components: int, standardize: bool, column: str) -> Projection:
    """Subspace iteration with Rayleigh-Ritz values; each pass reads the rows once."""
    rows = features.select(column)
    n = rows.count()
    mean = _summed_by_place(rows, lambda x: x.sum(0)) / n
    # Squares about the mean, so that a large mean costs no digits.
    variance = _summed_by_place(rows, lambda x: ((x - mean) ** 2).sum(0)) / n
    scale = np.sqrt(variance) if standardize else np.ones(k)
    scale = np.where(scale > 1e-15, scale, 1.0)
    total = (variance / scale**2).sum()
    width_ = min(k, n_components + SPARE)
    block = np.linalg.qr(np.random.default_rng(0).normal(size=(k, width_)))[0]
    before = None
    for _ in range(MAX_PASSES):
        def multiply(x, block=block):
            z = (x - mean) / scale
            return z.T @ (z @ block)

        image = _summed_by_place(rows, multiply).reshape(k, width_) / n
        values, turn = np.linalg.eigh(block.T @ image)
        values, vectors = values[::-1], block @ turn[:, ::-1]
        top = values[:n_components]
        if before is not None and (np.abs(top - before) <= TOLERANCE * max(values[0], 1e-300)).all():
            shares = np.maximum(top, 0) / max(total, 1e-300)
            return Projection(mean, scale, _signed(vectors[:, :n_components]).T, shares)
        before, block = top, np.linalg.qr(image)[0]
    raise RuntimeError(f"the components didn't settle in {MAX_PASSES} passes; ask for fewer or other ones")


def explained_variance(model: Projection, spark) -> DataFrame:
    """``component`` from 1, ``ratio``, ``cumulative``."""
    rows = spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(model.explained_variance_ratio)], "component int, ratio double")
    return rows.withColumn("cumulative", F.sum("ratio").over(Window.partitionBy(F.lit(0)).orderBy("component")))


def project(features: DataFrame, model: Projection, column: str = "features") -> DataFrame:
    """Replaces the features by their projection (null stays null); ``ValueError`` if the numbers differ."""
    found = features.select(F.size(column)).first()
    if found is not None and found[0] != len(model.mean):
        raise ValueError(f"{found[0]} features, but the model has {len(model.mean)}")
    weights = (model.components / model.scale[None, :]).T
    shift = model.mean @ weights
    at = features.columns.index(column)
    schema = T.StructType([T.StructField(f.name, T.ArrayType(T.DoubleType()) if f.name == column else f.dataType) for f in features.schema])

    def run(batches):
        for batch in batches:
            told = batch.column(at)
            there = np.asarray(told.is_valid())
            values = np.full((len(batch), weights.shape[1]), np.nan)
            values[there] = _matrix(told.filter(pa.array(there))).reshape(-1, len(weights)) @ weights - shift
            rows = pa.array([v if ok else None for v, ok in zip(values, there, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([rows if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    ship_code(features.sparkSession)
    return features.mapInArrow(run, schema)


def lag_pairs(features: DataFrame, lag: int, column: str = "features", partition: list[str] | None = None) -> DataFrame:
    """``frame``, ``now``, ``later``: rows ``lag`` apart within a trajectory."""
    if lag < 1:
        raise ValueError("lag must be positive")
    over = Window.partitionBy(*(partition or [F.lit(0)])).orderBy("frame")
    return features.withColumn("later", F.lead(column, lag).over(over)).filter("later is not null").select(*(partition or []), "frame", F.col(column).alias("now"), "later")


def fit_tica(features: DataFrame, lag: int = 1, n_components: int = 2, column: str = "features", partition: list[str] | None = None, max_features: int = MAX_FEATURES) -> Projection:
    """Time-lagged components: reversible, mean removed, scaled as a kinetic map.

    Up to ``max_features`` features both covariances are solved on the driver. Beyond,
    the components are iterated for over a written table of the pairs; the shares of
    variance, which need all speeds, are then NaN.
    """
    k = width(features, column)
    if not 1 <= n_components <= k:
        raise ValueError(f"n_components must lie between 1 and {k}")
    pairs = lag_pairs(features, lag, column, partition)
    if pairs.isEmpty():
        raise ValueError("lag is not shorter than the trajectory")
    if k > max_features:
        pairs = staged(pairs.select("now", "later"), "lag-pairs")
        mean, speeds, axes = leading(pairs, pairs.count(), k, n_components)
        return Projection(mean, np.ones(k), (_signed(axes) * speeds).T, np.full(len(speeds), np.nan))
    n, (a, b), outer = moments(pairs, ["now", "later"])
    mean = (a + b) / (2 * n)
    c0 = (outer["now", "now"] + outer["later", "later"]) / (2 * n) - np.outer(mean, mean)
    ct = (outer["now", "later"] + outer["now", "later"].T) / (2 * n) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(c0)
    kept = values > max(values.max(), 0) * 1e-10
    white = vectors[:, kept] / np.sqrt(values[kept])
    speeds, turned = np.linalg.eigh(white.T @ ct @ white)
    order = np.argsort(-speeds)
    speeds, axes = speeds[order], white @ turned[:, order]
    axes = _signed(axes)[:, :n_components] * speeds[None, :n_components]
    ratio = speeds**2 / max((speeds**2).sum(), 1e-300)
    return Projection(mean, np.ones(k), axes.T, ratio[:n_components])


def backbone_torsions(frames: DataFrame, atoms: DataFrame, sincos: bool = True) -> DataFrame:
    """``frame``, ``features``: phi and psi of the backbone, as cos and sin blocks or as radians.

    Blocks are cos(phi), sin(phi), cos(psi), sin(psi) (or phi, psi), each in the
    residues' order. ``ValueError`` if there is no torsion.
    """
    angles = torsion_table(frames, atoms)
    if angles.isEmpty():
        raise ValueError("no backbone torsion")
    if sincos:
        blocks = F.array(F.struct(F.lit(0).alias("b"), F.cos("angle").alias("v")), F.struct(F.lit(1).alias("b"), F.sin("angle").alias("v")))
        rows = angles.select("frame", "kind", "resid", F.explode(blocks).alias("p")).select("frame", (F.when(F.col("kind") == "phi", 0).otherwise(2) + F.col("p.b")).alias("b"), "resid", F.col("p.v").alias("v"))
    else:
        rows = angles.select("frame", F.when(F.col("kind") == "phi", 0).otherwise(1).alias("b"), "resid", F.col("angle").alias("v"))
    return rows.groupBy("frame").agg(F.transform(F.sort_array(F.collect_list(F.struct("b", "resid", "v"))), lambda p: p["v"]).alias("features"))


def torsion_quads(atoms: DataFrame) -> DataFrame:
    """``kind``, ``resid`` and the four atoms of each phi and psi within a chain."""
    own = atoms.groupBy("chain", "resid").pivot("name", ["N", "CA", "C"]).agg(F.first("atom")).dropna()
    near = Window.partitionBy("chain").orderBy("resid")
    own = own.withColumn("pc", F.when(F.lag("resid").over(near) == F.col("resid") - 1, F.lag("C").over(near)))
    own = own.withColumn("nn", F.when(F.lead("resid").over(near) == F.col("resid") + 1, F.lead("N").over(near)))
    phi = own.filter("pc is not null").select(F.lit("phi").alias("kind"), "resid", F.array("pc", "N", "CA", "C").alias("quad"))
    psi = own.filter("nn is not null").select(F.lit("psi").alias("kind"), "resid", F.array("N", "CA", "C", "nn").alias("quad"))
    return phi.union(psi)


def torsion_table(frames: DataFrame, atoms: DataFrame) -> DataFrame:
    """``frame``, ``kind``, ``resid``, ``angle`` in radians."""
    quads = torsion_quads(atoms).select("kind", "resid", F.posexplode("quad").alias("at", "atom"))
    placed = frames.join(quads, "atom").groupBy("frame", "kind", "resid").agg(
        *[F.max(F.when(F.col("at") == i, F.col(c))).alias(f"p{i}{c}") for i in range(4) for c in "xyz"]
    )
    return placed.select("frame", "kind", "resid", dihedral(*[point(f"p{i}") for i in range(4)]).alias("angle"))


def ramachandran(angles: DataFrame) -> DataFrame:
    """``frame``, ``resid``, ``phi_deg``, ``psi_deg`` of residues that have both."""
    phi = angles.filter("kind = 'phi'").select("frame", "resid", F.degrees("angle").alias("phi_deg"))
    psi = angles.filter("kind = 'psi'").select("frame", "resid", F.degrees("angle").alias("psi_deg"))
    return phi.join(psi, ["frame", "resid"])
