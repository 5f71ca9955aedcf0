"""Trajectories at rest: Parquet sorted by frame, and the text formats PDB and GRO.

A trajectory is ingested once. Files are range-partitioned by frame, so the frame
range of a load reaches the scan as pushed filters and prunes row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.functions.selection import select_atoms
from orrery.operators.frames import frame_range


def write_trajectory(frames: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Stores frames by ``traj_id`` (if there) and frame."""
    keys = ["traj_id", "frame"] if "traj_id" in frames.columns else ["frame"]
    frames.repartitionByRange(*keys).sortWithinPartitions(*keys, "atom").write.mode(mode).parquet(path)


def load_trajectory(spark: SparkSession, path: str | list[str], atoms: DataFrame | None = None, start: int = 0, stop: int | None = None, stride: int = 1, atom_selection: str | None = None) -> DataFrame:
    """The raw frames ``range(start, stop, stride)`` of the selected atoms.

    A stop past the end takes what there is, a start past the end gives no frame.
    """
    frames = frame_range(spark.read.parquet(*([path] if isinstance(path, str) else path)), start, stop, stride)
    if atom_selection is not None:
        if atoms is None:
            raise ValueError("a selection needs the atoms")
        frames = frames.join(select_atoms(atoms, atom_selection).select("atom"), "atom", "left_semi")
    return frames


def load_trajectories(spark: SparkSession, paths: list[str], atoms: list[DataFrame | None] | None = None, **options) -> DataFrame:
    """Several trajectories as one table, ``traj_id`` counting the paths; one scan a path, all in parallel."""
    if not paths:
        raise ValueError("no paths")
    if atoms is not None and len(atoms) != len(paths):
        raise ValueError("as many topologies as paths are needed")
    out = None
    for i, path in enumerate(paths):
        own = load_trajectory(spark, path, atoms[i] if atoms else None, **options).withColumn("traj_id", F.lit(i))
        out = own if out is None else out.unionByName(own)
    return out


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(``path``, ``at``, ``value``): a text file's lines in order; a file is one row first."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return whole.select("path", F.posexplode(F.split("text", "\r?\n")).alias("at", "value"))


def _field(start: int, length: int):
    return F.trim(F.substring("value", start, length))


def read_pdb(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``frames`` and ``atoms`` of a PDB file; each model is a frame, coordinates become nm."""
    lines = _numbered(spark, path)
    order = Window.partitionBy("path").orderBy("at")
    model = F.greatest(F.sum(F.startswith("value", F.lit("MODEL")).cast("int")).over(order) - 1, F.lit(0))
    lines = lines.withColumn("frame", model.cast("long")).filter(F.startswith("value", F.lit("ATOM  ")) | F.startswith("value", F.lit("HETATM")))
    name, element = _field(13, 4), _field(77, 2)
    rows = lines.select(
        "path", "frame", "at", name.alias("name"),
        F.when(element != "", F.upper(element)).otherwise(F.upper(F.substring(F.regexp_replace(name, "^[0-9]+", ""), 1, 1))).alias("element"),
        _field(18, 3).alias("resname"), _field(22, 1).alias("chain_id"), _field(23, 4).cast("int").alias("resseq"),
        *[(_field(31 + 8 * i, 8).cast("double") / 10).alias(c) for i, c in enumerate("xyz")],
    )
    within = Window.partitionBy("path", "frame").orderBy("at")
    rows = rows.withColumn("atom", (F.row_number().over(within) - 1).cast("int"))
    first = rows.filter("frame = 0")
    for number, columns in (("resid", ("chain_id", "resseq", "resname")), ("chain", ("chain_id",))):
        key = F.concat_ws("|", *columns)
        changed = F.coalesce(key != F.lag(key).over(within), F.lit(False)).cast("int")
        first = first.withColumn("changed", changed).withColumn(number, F.sum("changed").over(within).cast("int")).drop("changed")
    frames = rows.select("frame", F.col("frame").cast("double").alias("time_ps"), "atom", "x", "y", "z")
    return frames, first.select("atom", "name", "element", "resid", "resseq", "resname", "chain", "chain_id")


def read_gro(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``frames`` and ``atoms`` of a one-frame GRO file; nm already."""
    lines = _numbered(spark, path).filter((F.col("at") >= 2) & (F.length("value") >= 44))
    within = Window.partitionBy("path").orderBy("at")
    name = _field(11, 5)
    rows = lines.select("path", "at", (F.row_number().over(within) - 1).cast("int").alias("atom"), name.alias("name"), F.upper(F.substring(F.regexp_replace(name, "^[0-9]+", ""), 1, 1)).alias("element"), _field(6, 5).alias("resname"), _field(1, 5).cast("int").alias("resseq"), *[_field(21 + 8 * i, 8).cast("double").alias(c) for i, c in enumerate("xyz")])
    changed = F.coalesce((F.concat_ws("|", "resseq", "resname") != F.lag(F.concat_ws("|", "resseq", "resname")).over(within)), F.lit(False))
    atoms = rows.withColumn("resid", F.sum(changed.cast("int")).over(within).cast("int")).withColumn("chain", F.lit(0))
    return rows.select(F.lit(0).cast("long").alias("frame"), F.lit(0.0).alias("time_ps"), "atom", "x", "y", "z"), atoms.select("atom", "name", "element", "resid", "resseq", "resname", "chain")
