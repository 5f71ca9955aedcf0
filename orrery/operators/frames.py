"""Frames of trajectories: slicing, selecting, joining and aligning.

A trajectory is the table ``frames`` (``traj_id`` where there are several, ``frame``,
``time_ps``, ``atom``, ``x``, ``y``, ``z`` in nanometres) with the table ``atoms``
(``atom``, ``name``, ``element``, ``resid``, ``resseq``, ``resname``, ``chain``). The
number of a frame is a column, never a position. ``atoms`` describes one topology,
whose size the caller knows; joins with it are left to the optimizer's threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.selection import IONS, compile_selection, is_water, select_atoms

#: Frame numbers that are counted together.
PLACE_BUCKET = 1 << 16


def frame_count(frames: DataFrame) -> int:
    """One more than the last frame's number; 0 if there is none."""
    last = frames.agg(F.max("frame")).first()[0]
    return 0 if last is None else last + 1


def check_range(start: int, stop: int | None, stride: int) -> None:
    if stride < 1:
        raise ValueError("stride must be at least 1")
    if start < 0:
        raise ValueError("start must not be negative")
    if stop is not None and stop <= start:
        raise ValueError("stop must be greater than start")


def frame_range(frames: DataFrame, start: int = 0, stop: int | None = None, stride: int = 1) -> DataFrame:
    """The raw frames ``range(start, stop, stride)``; a start past the end gives none."""
    check_range(start, stop, stride)
    kept = frames.filter(F.col("frame") >= start)
    if stop is not None:
        kept = kept.filter(F.col("frame") < stop)
    return kept if stride == 1 else kept.filter((F.col("frame") - start) % stride == 0)


def slice_frames(frames: DataFrame, start: int | None = None, stop: int | None = None, stride: int | None = None) -> DataFrame:
    """Python's slice of the frames, renumbered from 0: negative numbers count from the end."""
    if stride == 0:
        raise ValueError("stride must not be 0")
    n = frame_count(frames)
    first, last, step = slice(start, stop, stride).indices(n)
    count = len(range(first, last, step))
    at = (F.col("frame") - first) / step
    kept = frames.filter(((F.col("frame") - first) % abs(step) == 0) & at.between(0, count - 1))
    return kept.withColumn("frame", at.cast("long"))


def subsample_frames(frames: DataFrame, n: int) -> DataFrame:
    """``n`` frames spread evenly from the first to the last, with their numbers."""
    total = frame_count(frames)
    if n < 1 or n > total:
        raise ValueError(f"n must lie between 1 and {total}")
    if n == total:
        return frames
    # The i-th is floor(i * (total - 1) / (n - 1)); a frame is kept if some i gives it.
    if n == 1:
        return frames.filter("frame = 0")
    step = (total - 1) / (n - 1)
    i = F.ceil(F.col("frame") / step)
    near = [F.floor((i + d) * F.lit(float(total - 1)) / F.lit(float(n - 1))) == F.col("frame") for d in (-1, 0, 1)]
    inside = [(i + d).between(0, n - 1) for d in (-1, 0, 1)]
    return frames.filter((near[0] & inside[0]) | (near[1] & inside[1]) | (near[2] & inside[2]))


def frame_places(frames: DataFrame) -> DataFrame:
    """``frame`` (and ``traj_id`` if there) and ``frame_place``: how many of the trajectory's frames lie before it.

    Frames are numbered within buckets of their number; only the buckets' sizes are
    added up in one window, a row for ``PLACE_BUCKET`` frames.
    """
    keys = [c for c in ("traj_id",) if c in frames.columns]
    own = frames.select(*keys, "frame").filter("frame is not null").distinct().withColumn("frame_bucket", F.floor(F.col("frame") / PLACE_BUCKET))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("frame_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy(*keys, "frame_bucket").agg(F.count("*").alias("n")).withColumn("frame_place", F.coalesce(F.sum("n").over(before), F.lit(0)))
    within = Window.partitionBy(*keys, "frame_bucket").orderBy("frame")
    numbered = own.withColumn("n_before", F.row_number().over(within) - 1)
    # A trajectory without an id is one of its own.
    same = F.lit(True)
    for c in [*keys, "frame_bucket"]:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    both = numbered.alias("a").join(sizes.alias("b"), same)
    return both.select(*[f"a.{c}" for c in keys], "a.frame", (F.col("b.frame_place") + F.col("a.n_before")).alias("frame_place"))


def frame_times(frames: DataFrame, timestep_ps: float | None = None) -> DataFrame:
    """Sets ``time_ps``: the frame's place times ``timestep_ps`` if given, else the file's time, else the place.

    Places count the frames there are, so those of a strided load are 0, 1, 2 and so on,
    in each trajectory where there is a ``traj_id``. Rows without a frame are left out.
    """
    if timestep_ps is None and frames.filter("time_ps is null").isEmpty():
        return frames
    places = frame_places(frames)
    place = F.col("frame_place").cast("double")
    time = F.coalesce(F.col("time_ps"), place) if timestep_ps is None else place * timestep_ps
    names = frames.columns if "time_ps" in frames.columns else [*frames.columns, "time_ps"]
    same = F.col("f.frame") == F.col("p.frame")
    if "traj_id" in frames.columns:
        same = same & F.col("f.traj_id").eqNullSafe(F.col("p.traj_id"))
    both = frames.alias("f").join(places.alias("p"), same)
    return both.select(*[time.alias(c) if c == "time_ps" else F.col(f"f.{c}") for c in names])


def with_units(df: DataFrame) -> DataFrame:
    """Adds ``time_ns`` and, for each column in nm, one in angstrom."""
    if "time_ps" in df.columns:
        df = df.withColumn("time_ns", F.col("time_ps") / 1000)
    for c in [c for c in df.columns if c.endswith("_nm")]:
        df = df.withColumn(f"{c[:-3]}_angstrom", F.col(c) * 10)
    return df


def of_selection(frames: DataFrame, atoms: DataFrame, selection: str) -> DataFrame:
    """The rows of the selected atoms."""
    return frames.join(select_atoms(atoms, selection).select("atom"), "atom", "left_semi")


def residue_ids(df: DataFrame, atoms: DataFrame) -> DataFrame:
    """Adds each atom's ``resseq``."""
    return df.join(atoms.select("atom", "resseq"), "atom")


def strip_solvent(atoms: DataFrame, keep_ions: bool = False) -> DataFrame:
    """The atoms that are neither water nor, unless kept, ions; ``ValueError`` if none is left."""
    kept = atoms.filter(~is_water() if keep_ions else ~is_water() & ~F.col("resname").isin(IONS))
    if kept.isEmpty():
        raise ValueError("no atoms left")
    return kept


def extract_chain(atoms: DataFrame, chain: int) -> DataFrame:
    """The atoms of one chain, counted from 0; ``ValueError`` if there is no such chain."""
    kept = atoms.filter(F.col("chain") == chain)
    if chain < 0 or kept.isEmpty():
        raise ValueError(f"no chain {chain}")
    return kept


def of_chains(atoms: DataFrame, chain_ids: list[str], column: str = "chain_id") -> DataFrame:
    return atoms.filter(F.col(column).isin(list(chain_ids)))


def merge_trajectories(parts: list[DataFrame]) -> DataFrame:
    """Trajectories one after the other, frames renumbered through."""
    if len(parts) < 2:
        raise ValueError("at least two trajectories are needed")
    offset, out = 0, None
    for part in parts:
        moved = part.withColumn("frame", F.col("frame") + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += frame_count(part)
    return out


def moving_average(df: DataFrame, value: str, window: int, order: str = "frame", partition: list[str] | None = None) -> DataFrame:
    """Adds ``{value}_mean``: the centred average, over the rows there are at the ends."""
    if window < 1:
        raise ValueError("window must be positive")
    over = Window.partitionBy(*(partition or [F.lit(0)])).orderBy(order).rowsBetween(-(window // 2), window - window // 2 - 1)
    return df.withColumn(f"{value}_mean", F.avg(value).over(over))


def alignments(frames: DataFrame, atoms: DataFrame, selection: str = "name CA", reference_frame: int = 0) -> DataFrame:
    """Each frame's rigid motion onto the reference: ``frame``, ``cx cy cz`` (its centre), ``rx ry rz`` (the reference's), ``r`` (9 numbers)."""
    chosen = of_selection(frames, atoms, selection)
    fixed = chosen.filter(F.col("frame") == reference_frame).select("atom", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    if fixed.isEmpty():
        raise ValueError(f"no frame {reference_frame}")
    both = chosen.join(fixed, "atom")
    sums = [F.sum(F.col(a) * F.col(f"q{b}")).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"]
    means = [F.avg(c).alias(f"m{c}") for c in ("x", "y", "z", "qx", "qy", "qz")]
    stats = both.groupBy("frame").agg(F.count("*").alias("n"), *means, *sums)

    def rotate(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch]).to_pandas()
            n = t["n"].to_numpy(float)
            h = np.empty((len(t), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    h[:, i, j] = t[f"s{a}{b}"] - n * t[f"m{a}"] * t[f"mq{b}"]
            u, _, vt = np.linalg.svd(h)
            sign = np.sign(np.linalg.det(u @ vt))
            u[:, :, 2] *= sign[:, None]
            r = u @ vt
            yield pa.RecordBatch.from_arrays(
                [batch.column("frame"), *[pa.array(t[f"m{c}"]) for c in ("x", "y", "z", "qx", "qy", "qz")], pa.array(list(r.reshape(-1, 9)), pa.list_(pa.float64()))],
                ["frame", "cx", "cy", "cz", "rx", "ry", "rz", "r"],
            )

    # One small row a frame meets Python; coordinates don't.
    return stats.mapInArrow(rotate, "frame long, cx double, cy double, cz double, rx double, ry double, rz double, r array<double>")


def align(frames: DataFrame, atoms: DataFrame, selection: str = "name CA", reference_frame: int = 0) -> DataFrame:
    """All atoms, each frame moved onto the reference by its selected atoms."""
    moved = frames.join(alignments(frames, atoms, selection, reference_frame), "frame")
    d = [F.col(c) - F.col(f"c{c}") for c in "xyz"]
    new = {c: d[0] * F.get("r", F.lit(j)) + d[1] * F.get("r", F.lit(3 + j)) + d[2] * F.get("r", F.lit(6 + j)) + F.col(f"r{c}") for j, c in enumerate("xyz")}
    return moved.withColumns(new).select(*frames.columns)


__all__ = [
    "align", "alignments", "check_range", "compile_selection", "extract_chain", "frame_count", "frame_range", "frame_times",
    "merge_trajectories", "moving_average", "of_chains", "of_selection", "residue_ids", "slice_frames",
    "strip_solvent", "subsample_frames", "with_units",
]
