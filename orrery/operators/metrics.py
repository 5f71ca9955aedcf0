"""Fluctuations, correlations and sizes of trajectories."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.geometry import superposition_rmsd
from orrery.operators.frames import of_selection

#: Atoms whose square of sums fits a task (32 MB); more are summed pair by pair.
SQUARE_ATOMS = 2_048


def _spread() -> Column:
    """Mean square distance from the mean point (population)."""
    return F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))


def rmsf(frames: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``atom`` (and ``by``), ``rmsf_nm``: fluctuation about the mean position; nothing is aligned."""
    return frames.groupBy(*(by or []), "atom").agg(_spread().alias("rmsf_nm"))


def radius_of_gyration(frames: DataFrame) -> DataFrame:
    """``frame``, ``rg_nm``, without masses."""
    return frames.groupBy("frame").agg(_spread().alias("rg_nm"))


def average_rmsf(replicas: DataFrame) -> DataFrame:
    """``pos``, ``rmsf_nm``, ``sem_nm``, ``n`` of ``replica``, ``pos``, ``rmsf_nm``.

    The mean of squares, and its standard error carried over to the root: null for
    one replica, 0 where the average is 0. Replicas must have the same positions.
    """
    check_replicas(replicas)
    square = F.col("rmsf_nm") * F.col("rmsf_nm")
    stats = replicas.groupBy("pos").agg(F.sqrt(F.avg(square)).alias("rmsf_nm"), F.stddev_samp(square).alias("sd"), F.count("*").alias("n"))
    sem = F.when(F.col("n") < 2, F.lit(None)).when(F.col("rmsf_nm") > 0, F.col("sd") / F.sqrt("n") / (2 * F.when(F.col("rmsf_nm") > 0, F.col("rmsf_nm")))).otherwise(0.0)
    return stats.select("pos", "rmsf_nm", sem.cast("double").alias("sem_nm"), "n")


def check_replicas(replicas: DataFrame) -> None:
    sizes = replicas.groupBy("replica").count().agg(F.count_distinct("count"), F.count("*")).first()
    if not sizes[1]:
        raise ValueError("no replicas")
    if sizes[0] != 1:
        raise ValueError("replicas have different numbers of positions")


def delta_rmsf(a: DataFrame, b: DataFrame, alignment: DataFrame | None = None) -> DataFrame:
    """``pos``, ``delta_rmsf_nm`` (b less a), ``sem_nm`` of two sets of replicas.

    ``alignment`` (``pos``, ``pos_a``, ``pos_b``) says which positions belong together;
    without it the sets must have the same positions. The error adds in quadrature
    and is null unless both sides have two replicas.
    """
    mean_a, mean_b = average_rmsf(a), average_rmsf(b)
    if alignment is None:
        if mean_a.count() != mean_b.count():
            raise ValueError("different numbers of positions need an alignment")
        joined = mean_a.alias("a").join(mean_b.alias("b"), "pos")
    else:
        joined = alignment.join(mean_a.withColumnRenamed("pos", "pos_a").alias("a"), "pos_a").join(mean_b.withColumnRenamed("pos", "pos_b").alias("b"), "pos_b")
    sem = F.sqrt(F.col("a.sem_nm") * F.col("a.sem_nm") + F.col("b.sem_nm") * F.col("b.sem_nm"))
    return joined.select("pos", (F.col("b.rmsf_nm") - F.col("a.rmsf_nm")).alias("delta_rmsf_nm"), sem.alias("sem_nm"))


def segment_signs(df: DataFrame, value: str = "delta_rmsf_nm", order: str = "pos") -> DataFrame:
    """Adds ``positive``: whether the midpoint to the next row lies above 0 (null for the last)."""
    if df.limit(2).count() < 2:
        raise ValueError("at least two positions are needed")
    after = F.lead(value).over(Window.partitionBy(F.lit(0)).orderBy(order))
    return df.withColumn("positive", (F.col(value) + after) / 2 > 0)


def correlations(frames: DataFrame) -> DataFrame:
    """``i``, ``j``, ``correlation``: the cross-correlation of atoms' displacements.

    Each task adds up its frames' outer products and sends one square of sums; with
    more than ``SQUARE_ATOMS`` atoms the pairs of a frame are made in its row and folded
    by pair. Atoms that some frames lack count over the frames they share. Not a number
    becomes 0, the diagonal is 1.
    """
    if frames.select("frame").distinct().limit(2).count() < 2:
        raise ValueError("at least two frames are needed")
    means = frames.groupBy("atom").agg(*[F.avg(c).alias(f"m{c}") for c in "xyz"])
    centred = frames.join(means, "atom").select("frame", F.struct("atom", *[(F.col(c) - F.col(f"m{c}")).cast("double").alias(c) for c in "xyz"]).alias("p"))
    wide = centred.groupBy("frame").agg(F.sort_array(F.collect_list("p")).alias("p"))
    atoms = means.select("atom").limit(SQUARE_ATOMS + 1).toPandas()["atom"].to_numpy()
    if len(atoms) <= SQUARE_ATOMS:
        sums = _summed_products(wide, np.sort(atoms), frames.schema["atom"].dataType.simpleString())
    else:
        left = wide.select("p", F.posexplode("p").alias("at", "a"))
        pairs = left.select("a", F.explode(F.slice("p", F.col("at") + 1, F.size("p") - F.col("at"))).alias("b"))
        product = F.col("a.x") * F.col("b.x") + F.col("a.y") * F.col("b.y") + F.col("a.z") * F.col("b.z")
        sums = pairs.groupBy(F.col("a.atom").alias("i"), F.col("b.atom").alias("j")).agg(F.avg(product).alias("c"))
    own = sums.filter("i = j").select(F.col("i").alias("k"), F.sqrt(F.greatest("c", F.lit(0.0))).alias("s"))
    both = sums.join(own.select(F.col("k").alias("i"), F.col("s").alias("si")), "i").join(own.select(F.col("k").alias("j"), F.col("s").alias("sj")), "j")
    value = F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.coalesce(F.try_divide(F.col("c"), F.col("si") * F.col("sj")), F.lit(0.0)))
    upper = both.select("i", "j", value.alias("correlation"))
    return upper.union(upper.filter("i < j").select(F.col("j"), F.col("i"), "correlation"))


def _summed_products(wide: DataFrame, atoms: np.ndarray, kind: str) -> DataFrame:
    """``i``, ``j`` (``i <= j``), ``c``: the mean inner product of two atoms' displacements."""
    n = len(atoms)

    def partial(batches):
        total, shared = np.zeros((n, n)), np.zeros((n, n))
        seen = False
        for batch in batches:
            for start in range(0, len(batch), 1_000):
                points = batch.column(0).slice(start, 1_000)
                flat, lengths = points.flatten(), pc.list_value_length(points).to_numpy()
                row, at = np.repeat(np.arange(len(points)), lengths), np.searchsorted(atoms, flat.field("atom").to_numpy())
                there = np.zeros((len(points), n))
                there[row, at] = 1
                shared += there.T @ there
                for c in "xyz":
                    x = np.zeros((len(points), n))
                    x[row, at] = flat.field(c).to_numpy()
                    total += x.T @ x
                seen = True
        if seen:
            i, j = np.triu_indices(n)
            yield pa.RecordBatch.from_arrays([pa.array(atoms[i]), pa.array(atoms[j]), pa.array(total[i, j]), pa.array(shared[i, j])], ["i", "j", "s", "n"])

    parts = wide.select("p").mapInArrow(partial, f"i {kind}, j {kind}, s double, n double")
    return parts.groupBy("i", "j").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).filter("n > 0").select("i", "j", (F.col("s") / F.col("n")).alias("c"))


def rmsd(frames: DataFrame, reference_frame: int = 0, atoms: DataFrame | None = None, selection: str | None = None) -> DataFrame:
    """``frame``, ``rmsd_nm``: the least RMSD to a frame over rigid motions."""
    if selection is not None:
        frames = of_selection(frames, atoms, selection)
    fixed = frames.filter(F.col("frame") == reference_frame).select("atom", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    if fixed.isEmpty():
        raise ValueError(f"no frame {reference_frame}")
    both = frames.join(fixed, "atom")
    sums = [F.sum(F.col(a) * F.col(f"q{b}")).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"]
    means = [F.avg(c).alias(f"m{c}") for c in ("x", "y", "z", "qx", "qy", "qz")]
    squares = [F.sum(sum((F.col(f"{q}{c}") * F.col(f"{q}{c}") for c in "xyz"), F.lit(0.0))).alias(f"g{q or 'p'}") for q in ("", "q")]
    stats = both.groupBy("frame").agg(F.count("*").cast("double").alias("n"), *means, *sums, *squares)
    n = F.col("n")
    s = [[F.col(f"s{a}{b}") - n * F.col(f"m{a}") * F.col(f"mq{b}") for b in "xyz"] for a in "xyz"]
    gp = F.col("gp") - n * sum((F.col(f"m{c}") * F.col(f"m{c}") for c in "xyz"), F.lit(0.0))
    gq = F.col("gq") - n * sum((F.col(f"mq{c}") * F.col(f"mq{c}") for c in "xyz"), F.lit(0.0))
    # The sums are columns of their own, else the expression would be copied many times.
    named = stats.select("frame", "n", gp.alias("gp"), gq.alias("gq"), *[s[i][j].alias(f"c{i}{j}") for i in range(3) for j in range(3)])
    value = superposition_rmsd([[F.col(f"c{i}{j}") for j in range(3)] for i in range(3)], F.col("gp"), F.col("gq"), n)
    value = F.when(F.col("frame") == reference_frame, 0.0).otherwise(value)
    return named.select("frame", value.alias("rmsd_nm"))


def aggregate_units(values: DataFrame, how: str = "sum", value: str = "value_nm2") -> DataFrame:
    """Per frame: the ``sum`` or ``mean`` of a per-unit value, or all units (``none``)."""
    if how == "none":
        return values
    if how not in ("sum", "mean"):
        raise ValueError(f"unknown aggregate {how!r}")
    return values.groupBy("frame").agg((F.sum if how == "sum" else F.avg)(value).alias(value))
