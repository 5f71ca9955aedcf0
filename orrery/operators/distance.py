"""Distances, contacts and hydrogen bonds."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.geometry import angle, minimum_image, minus, norm, point
from orrery.operators.lattice import CELL, nearest_image, with_lattice
from orrery.operators.neighbours import BOX, pairs_within
from orrery.session import staged

SCHEMES = ("closest-heavy", "closest", "ca", "sidechain-heavy")


def _difference(a: str, b: str, periodic: bool, has_box: bool) -> Column:
    d = minus(point(f"{b}."), point(f"{a}."))
    if periodic and has_box:
        d = minimum_image(d, tuple(F.col(f"{a}.{c}") for c in BOX))
    return norm(d)


def pair_distances(frames: DataFrame, pairs: DataFrame, periodic: bool = True) -> DataFrame:
    """``frame``, ``i``, ``j``, ``distance_nm`` of the pairs (``i``, ``j``).

    Nearest images count where the frames have a cell: a rectangular one
    (``box_x box_y box_z``) or three vectors (``a_x`` to ``c_z``), whatever their skew.
    ``ValueError`` if a pair names an atom that no frame has.
    """
    named = pairs.select(F.explode(F.array("i", "j")).alias("atom")).distinct()
    missing = named.join(frames.select("atom").distinct(), "atom", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a pair names an atom that is not there")
    boxed = set(BOX) <= set(frames.columns)
    columns = ["frame", "atom", "x", "y", "z", *(BOX if boxed else ())]
    if periodic and set(CELL) <= set(frames.columns):
        ends = with_lattice(frames.select("frame", "atom", "x", "y", "z", *CELL))
        a = ends.join(pairs.distinct(), F.col("atom") == F.col("i")).alias("a")
        b = ends.select("frame", "atom", "x", "y", "z").alias("b")
        both = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.j") == F.col("b.atom")))
        return both.select(F.col("a.frame").alias("frame"), "i", "j", norm(nearest_image(minus(point("b."), point("a.")), "a.")).alias("distance_nm"))
    a = frames.select(*columns).join(pairs.distinct(), F.col("atom") == F.col("i")).alias("a")
    b = frames.select(*columns).alias("b")
    both = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.j") == F.col("b.atom")))
    return both.select(F.col("a.frame").alias("frame"), F.col("a.i").alias("i"), F.col("a.j").alias("j"), _difference("a", "b", periodic, boxed).alias("distance_nm"))


def all_pairs(atoms: DataFrame) -> DataFrame:
    """(``i``, ``j``, ``pos_i``, ``pos_j``) of all atoms ``i < j``; positions count within the selection.

    The pairs are those of one topology's selection, whose square the caller asks for.
    """
    everyone = F.sort_array(F.collect_list("atom"))
    wide = atoms.agg(everyone.alias("all"))
    first = wide.select("all", F.posexplode("all").alias("pos_i", "i"))
    rest = F.slice("all", F.col("pos_i") + 2, F.greatest(F.size("all") - F.col("pos_i") - 1, F.lit(0)))
    return first.select("i", "pos_i", F.posexplode(rest).alias("gap", "j")).select("i", "j", "pos_i", (F.col("pos_i") + F.col("gap") + 1).alias("pos_j"))


def ca_distance_features(frames: DataFrame, atoms: DataFrame, periodic: bool = False) -> DataFrame:
    """``frame``, ``features``: the distances of all pairs of selected atoms, in the order of (i, j)."""
    if atoms.limit(2).count() < 2:
        raise ValueError("at least two atoms are needed")
    d = pair_distances(frames, all_pairs(atoms).select("i", "j"), periodic)
    ordered = F.sort_array(F.collect_list(F.struct("i", "j", "distance_nm")))
    return d.groupBy("frame").agg(F.transform(ordered, lambda p: p["distance_nm"]).alias("features"))


def minimum_distance(frames: DataFrame, group1: DataFrame, group2: DataFrame, periodic: bool = True) -> DataFrame:
    """``frame``, ``i``, ``j``, ``distance_nm``: the closest pair of two groups of atoms in each frame.

    Of equal distances the pair that comes first by (i, j) counts.
    """
    boxed = set(BOX) <= set(frames.columns)
    columns = ["frame", "atom", "x", "y", "z", *(BOX if boxed else ())]
    a = frames.select(*columns).join(group1.select("atom"), "atom", "left_semi").alias("a")
    b = frames.select(*columns).join(group2.select("atom"), "atom", "left_semi").alias("b")
    both = a.join(b, F.col("a.frame") == F.col("b.frame"))
    best = F.struct(_difference("a", "b", periodic, boxed).alias("d"), F.col("a.atom").alias("i"), F.col("b.atom").alias("j"))
    found = both.groupBy(F.col("a.frame").alias("frame")).agg(F.min(best).alias("best"))
    return found.select("frame", F.col("best.i").alias("i"), F.col("best.j").alias("j"), F.col("best.d").alias("distance_nm"))


def scheme_atoms(atoms: DataFrame, scheme: str) -> DataFrame:
    if scheme not in SCHEMES:
        raise ValueError(f"unknown scheme {scheme!r}; known: {', '.join(SCHEMES)}")
    if scheme == "ca":
        return atoms.filter("name = 'CA'")
    if scheme == "closest":
        return atoms
    heavy = atoms.filter("element <> 'H'")
    return heavy if scheme == "closest-heavy" else heavy.filter(~F.col("name").isin("N", "CA", "C", "O"))


def contacts(frames: DataFrame, atoms: DataFrame, scheme: str = "closest-heavy", residue_pairs: DataFrame | None = None, separation: int = 3, periodic: bool = True) -> DataFrame:
    """``frame``, ``ri``, ``rj``, ``distance_nm``: each residue pair's least atom distance.

    Without ``residue_pairs`` (``ri``, ``rj``) all pairs at least ``separation`` apart.
    The pairs of atoms are joined within a frame and reduced to their least before
    they are shuffled on.
    """
    boxed = set(BOX) <= set(frames.columns)
    columns = ["frame", "atom", "x", "y", "z", *(BOX if boxed else ())]
    own = frames.select(*columns).join(scheme_atoms(atoms, scheme).select("atom", "resid"), "atom")
    if residue_pairs is None:
        a, b = own.alias("a"), own.alias("b")
        both = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("b.resid") - F.col("a.resid") >= separation))
    else:
        a = own.join(residue_pairs.select("ri", "rj"), F.col("resid") == F.col("ri")).alias("a")
        b = own.alias("b")
        both = a.join(b, (F.col("a.frame") == F.col("b.frame")) & (F.col("a.rj") == F.col("b.resid")))
    d = both.select(F.col("a.frame").alias("frame"), F.col("a.resid").alias("ri"), F.col("b.resid").alias("rj"), _difference("a", "b", periodic, boxed).alias("d"))
    return d.groupBy("frame", "ri", "rj").agg(F.min("d").alias("distance_nm"))


def contacts_within(frames: DataFrame, atoms: DataFrame, cutoff_nm: float = 0.45, scheme: str = "closest-heavy", separation: int = 3, periodic: bool = True) -> DataFrame:
    """``frame``, ``ri``, ``rj``, ``distance_nm`` of the residue pairs nearer than the cutoff, at least ``separation`` apart.

    The same rows as those of ``contacts`` below the cutoff, by cell lists: only atoms of
    neighbouring cells meet.
    """
    boxed = set(BOX) <= set(frames.columns)
    columns = ["frame", "x", "y", "z", *(BOX if boxed else ())]
    own = frames.select("atom", *columns).join(scheme_atoms(atoms, scheme).select("atom", "resid"), "atom").select("resid", *columns)
    near = pairs_within(own, own, cutoff_nm, periodic).filter(F.col("b.resid") - F.col("a.resid") >= separation)
    return near.groupBy("frame", F.col("a.resid").alias("ri"), F.col("b.resid").alias("rj")).agg(F.min("d").alias("distance_nm"))


def contact_frequency(distances: DataFrame, cutoff_nm: float = 0.45) -> DataFrame:
    """``ri``, ``rj``, ``frequency``: the share of frames closer than the cutoff."""
    if cutoff_nm <= 0:
        raise ValueError("cutoff must be positive")
    return distances.groupBy("ri", "rj").agg(F.avg((F.col("distance_nm") < cutoff_nm).cast("double")).alias("frequency"))


def contact_matrix(frequency: DataFrame) -> DataFrame:
    """Both halves of a symmetric matrix."""
    return frequency.union(frequency.filter("ri <> rj").select(F.col("rj").alias("ri"), F.col("ri").alias("rj"), "frequency"))


def native_contacts(frames: DataFrame, atoms: DataFrame, cutoff_nm: float = 0.45, reference_frame: int = 0, scheme: str = "closest-heavy", separation: int = 3, periodic: bool = True) -> DataFrame:
    """``frame``, ``q``: the share of the reference frame's contacts that each frame has.

    The contacts are found in the reference frame alone; only their pairs are measured
    in the others.
    """
    if cutoff_nm <= 0:
        raise ValueError("cutoff must be positive")
    fixed = frames.filter(F.col("frame") == reference_frame)
    if fixed.isEmpty():
        raise ValueError(f"no frame {reference_frame}")
    native = contacts(fixed, atoms, scheme, None, separation, periodic).filter(F.col("distance_nm") < cutoff_nm).select("ri", "rj")
    if native.isEmpty():
        raise ValueError("no native contacts")
    found = contacts(frames, atoms, scheme, native, separation, periodic)
    return found.groupBy("frame").agg(F.avg((F.col("distance_nm") < cutoff_nm).cast("double")).alias("q"))


def bonded_triplets(atoms: DataFrame, bonds: DataFrame) -> DataFrame:
    """(``d``, ``h``, ``a``): donor N-H and O-H bonds with every other N or O as acceptor."""
    both = bonds.select(F.col("a").alias("d"), F.col("b").alias("h")).union(bonds.select("b", "a"))
    donors = both.join(atoms.filter(F.col("element").isin("N", "O")).select(F.col("atom").alias("d")), "d").join(atoms.filter("element = 'H'").select(F.col("atom").alias("h")), "h")
    acceptors = atoms.filter(F.col("element").isin("N", "O")).select(F.col("atom").alias("a"))
    # One topology's donors by its acceptors: as many rows as candidate bonds are asked for.
    return donors.join(acceptors, F.col("a") != F.col("d")).select("d", "h", "a")


def _triplet_geometry(frames: DataFrame, triplets: DataFrame, periodic: bool) -> DataFrame:
    boxed = periodic and set(BOX) <= set(frames.columns)
    f = frames.select("frame", "atom", "x", "y", "z", *(BOX if boxed else ()))
    d = f.join(triplets, F.col("atom") == F.col("d")).alias("pd")
    h, a = f.alias("ph"), f.alias("pa")
    both = d.join(h, (F.col("pd.frame") == F.col("ph.frame")) & (F.col("pd.h") == F.col("ph.atom"))).join(a, (F.col("pd.frame") == F.col("pa.frame")) & (F.col("pd.a") == F.col("pa.atom")))

    def between(start: str, end: str):
        step = minus(point(f"{end}."), point(f"{start}."))
        return minimum_image(step, tuple(F.col(f"pd.{c}") for c in BOX)) if boxed else step

    to_d, to_a = between("ph", "pd"), between("ph", "pa")
    d_to_h, d_to_a = between("pd", "ph"), between("pd", "pa")
    return both.select(
        F.col("pd.frame").alias("frame"), F.col("pd.d").alias("d"), F.col("pd.h").alias("h"), F.col("pd.a").alias("a"),
        norm(to_a).alias("distance_nm"), F.degrees(angle(to_d, to_a)).alias("angle_deg"),
        norm(d_to_a).alias("da_nm"), F.degrees(angle(d_to_h, d_to_a)).alias("hda_deg"),
    )


def hydrogen_bonds(frames: DataFrame, atoms: DataFrame, bonds: DataFrame, method: str = "baker_hubbard", freq: float = 0.1, distance_cutoff_nm: float = 0.25, angle_cutoff_deg: float = 120.0, periodic: bool = True) -> DataFrame:
    """``frame``, ``d``, ``h``, ``a``, ``present`` of the bonds that occur; nearest images where the frames have a cell.

    ``baker_hubbard``: candidates have H-A below 0.25 nm and D-H-A above 120 degrees in
    more than a share ``freq`` of the frames; present are those within the given
    cutoffs (inclusive). ``wernet_nilsson``: bonds inside the cone
    ``D-A < 0.33 - 0.000044 * angle(H-D-A)^2`` nm in any frame.
    """
    if not 0 <= freq <= 1:
        raise ValueError("freq must lie in [0, 1]")
    if distance_cutoff_nm <= 0:
        raise ValueError("the distance cutoff must be positive")
    if not 0 < angle_cutoff_deg <= 180:
        raise ValueError("the angle cutoff must lie in (0, 180]")
    if method == "baker_hubbard":
        counts = (F.col("distance_nm") < 0.25) & (F.col("angle_deg") > 120.0)
        enough = F.col("share") > freq
        present = (F.col("distance_nm") <= distance_cutoff_nm) & (F.col("angle_deg") >= angle_cutoff_deg)
    elif method == "wernet_nilsson":
        counts = present = F.col("da_nm") < 0.33 - 0.000044 * F.col("hda_deg") * F.col("hda_deg")
        enough = F.col("share") > 0
    else:
        raise ValueError(f"unknown method {method!r}")
    # All candidates are only added up; what is shuffled on and measured again are the few that occur.
    shares = _triplet_geometry(frames, bonded_triplets(atoms, bonds), periodic).groupBy("d", "h", "a").agg(F.avg(counts.cast("double")).alias("share"))
    found = staged(shares.filter(enough).select("d", "h", "a"), "hydrogen-bonds")
    return _triplet_geometry(frames, found, periodic).select("frame", "d", "h", "a", present.alias("present"))


def bond_counts(presence: DataFrame, frames: DataFrame) -> DataFrame:
    """``frame``, ``n``: the bonds of every frame, those without any too."""
    counts = presence.filter("present").groupBy("frame").agg(F.count("*").alias("n"))
    return frames.select("frame").distinct().join(counts, "frame", "left").select("frame", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def bond_occupancy(presence: DataFrame) -> DataFrame:
    """``d``, ``h``, ``a``, ``occupancy``: each bond's share of the frames."""
    return presence.groupBy("d", "h", "a").agg(F.avg(F.col("present").cast("double")).alias("occupancy"))


def bond_labels(occupancy: DataFrame, atoms: DataFrame) -> DataFrame:
    """Adds ``label``: ``ALA1:N-H ... GLY5:O``."""
    def names(p):
        return atoms.select(F.col("atom").alias(p), F.col("resname").alias(f"{p}_res"), F.col("resseq").alias(f"{p}_seq"), F.col("name").alias(f"{p}_name"))

    out = occupancy
    for p in ("d", "h", "a"):
        out = out.join(names(p), p)
    label = F.format_string("%s%d:%s-%s ... %s%d:%s", "d_res", "d_seq", "d_name", "h_name", "a_res", "a_seq", "a_name")
    return out.select(*occupancy.columns, label.alias("label"))


def top_bonds(occupancy: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` bonds of highest occupancy; of equal ones the last by (d, h, a) first."""
    if n < 1:
        raise ValueError("n must be positive")
    return occupancy.orderBy(F.desc("occupancy"), F.desc("d"), F.desc("h"), F.desc("a")).limit(n)


