"""Solvent-accessible surfaces, by cell lists, and secondary structure.

Surfaces are joins and an aggregate. Secondary structure is grouped by frame; its kernel sees
one frame's backbone, as much as the topology has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators.neighbours import pairs_within
from orrery.session import ship_code

# Van der Waals radii in nm.
RADII = {"H": 0.12, "C": 0.17, "N": 0.155, "O": 0.152, "F": 0.147, "P": 0.18, "S": 0.18, "CL": 0.175, "NA": 0.227, "K": 0.275, "MG": 0.173, "ZN": 0.139, "CA": 0.231}
DEFAULT_RADIUS = 0.17


def sphere(n: int) -> np.ndarray:
    """``n`` points spread over the unit sphere by the golden angle."""
    i = np.arange(n)
    z = 1 - (2 * i + 1) / n
    turn = i * np.pi * (3 - 5**0.5)
    r = np.sqrt(1 - z * z)
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], 1)


def covered_points(apart: np.ndarray, own: np.ndarray, other: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Bit sets (64 to a word) of the points of spheres of radius ``own`` that lie inside spheres of radius ``other``, ``apart`` away."""
    words = -(-len(points) // 64)
    out = np.empty((len(own), words), np.int64)
    for i in range(0, len(own), 2_000):
        d = [apart[i : i + 2_000, k, None] - own[i : i + 2_000, None] * points[None, :, k] for k in range(3)]
        inside = np.zeros((len(d[0]), words * 64), bool)
        inside[:, : len(points)] = d[0] * d[0] + d[1] * d[1] + d[2] * d[2] < (other[i : i + 2_000] * other[i : i + 2_000])[:, None]
        out[i : i + 2_000] = np.packbits(inside, axis=1, bitorder="little").view("<i8")
    return out


def sasa(frames: DataFrame, atoms: DataFrame, mode: str = "residue", probe_nm: float = 0.14, n_sphere_points: int = 960) -> DataFrame:
    """``frame``, ``unit_id``, ``value_nm2`` by atom or residue.

    Atoms meet their neighbours by cell lists; each pair gives the set of the first
    atom's sphere points that the second covers, sets are united in an aggregate with
    partial results, and the share of points outside counts. Atoms that are not among
    ``atoms`` cover nothing; a null coordinate has no surface and covers nothing.
    """
    if mode not in ("atom", "residue"):
        raise ValueError(f"mode must be atom or residue, not {mode!r}")
    reach = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in RADII.items() for x in pair]), F.upper("element")), F.lit(DEFAULT_RADIUS)) + probe_nm
    rows = frames.join(atoms.select("atom", "resid", reach.alias("reach")), "atom").select("frame", "atom", "resid", "x", "y", "z", "reach")
    widest = 2 * (max(*RADII.values(), DEFAULT_RADIUS) + probe_nm)
    near = pairs_within(rows, rows.select("frame", "atom", "x", "y", "z", "reach"), widest)
    same = F.col("a.atom") == F.col("b.atom")  # keeps atoms without neighbours
    near = near.filter(same | (F.col("d") < F.col("a.reach") + F.col("b.reach")))
    apart = [(F.col(f"b.{c}") - F.col(f"a.{c}")).cast("double").alias(f"d{c}") for c in "xyz"]
    near = near.select("frame", F.col("a.atom").cast("long").alias("atom"), F.col("a.resid").cast("long").alias("resid"), F.col("a.reach").alias("own"), F.when(same, 0.0).otherwise(F.col("b.reach")).alias("other"), *apart)
    words = [f"w{i}" for i in range(-(-n_sphere_points // 64))]

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = sphere(n_sphere_points)
        for batch in batches:
            own, other = (batch.column(i).to_numpy() for i in (3, 4))
            found = covered_points(np.stack([batch.column(i).to_numpy() for i in (5, 6, 7)], 1), own, other, points)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array(found[:, i].copy()) for i in range(len(words)))], ["frame", "atom", "resid", "own", *words])

    ship_code(rows.sparkSession)
    kind = dict(near.dtypes)["frame"]
    sets = near.mapInArrow(masks, f"frame {kind}, atom long, resid long, own double, " + ", ".join(f"{w} long" for w in words))
    united = sets.groupBy("frame", "atom", "resid", "own").agg(*[F.bit_or(w).alias(w) for w in words])
    hidden = sum((F.bit_count(w) for w in words), F.lit(0))
    area = F.lit(4 * np.pi) * F.col("own") * F.col("own") * (F.lit(n_sphere_points) - hidden) / F.lit(float(n_sphere_points))
    unit = "atom" if mode == "atom" else "resid"
    return united.select("frame", F.col(unit).alias("unit_id"), area.alias("area")).groupBy("frame", "unit_id").agg(F.sum("area").alias("value_nm2"))


def kabsch_sander(n: np.ndarray, ca: np.ndarray, c: np.ndarray, o: np.ndarray, chain: np.ndarray, proline: np.ndarray) -> list[str]:
    """One letter a residue (H B E G I T S or blank) from backbone atoms, by hydrogen-bond patterns."""
    m = len(ca)
    h = n.copy()
    has_h = np.zeros(m, bool)
    for i in range(1, m):
        if chain[i] == chain[i - 1] and not proline[i]:
            v = c[i - 1] - o[i - 1]
            h[i] = n[i] + 0.1 * v / max(np.linalg.norm(v), 1e-9)
            has_h[i] = True
    dist = lambda a, b: np.maximum(np.sqrt(((a[:, None] - b[None]) ** 2).sum(2)), 1e-6)
    # Energy of the bond from donor i (rows) to acceptor j (columns), kcal/mol.
    energy = 2.7888 * (1 / dist(n, o) + 1 / dist(h, c) - 1 / dist(h, o) - 1 / dist(n, c))
    bond = (energy < -0.5) & has_h[:, None] & (dist(ca, ca) < 0.9)
    index = np.arange(m)
    bond &= (index[:, None] != index[None, :]) & (index[:, None] != index[None, :] + 1)
    hb = lambda acceptor, donor: 0 <= acceptor < m and 0 <= donor < m and bond[donor, acceptor]
    joined = lambda i, j: 0 <= i <= j < m and chain[i] == chain[j]
    turn = {k: [joined(i, i + k) and hb(i, i + k) for i in range(m)] for k in (3, 4, 5)}
    out = [" "] * m
    partners: list[list[int]] = [[] for _ in range(m)]
    for i in range(1, m - 1):
        if not joined(i - 1, i + 1):
            continue
        for j in range(i + 3, m - 1):
            if not joined(j - 1, j + 1):
                continue
            parallel = (hb(i - 1, j) and hb(j, i + 1)) or (hb(j - 1, i) and hb(i, j + 1))
            anti = (hb(i, j) and hb(j, i)) or (hb(i - 1, j + 1) and hb(j - 1, i + 1))
            if parallel or anti:
                partners[i].append(j)
                partners[j].append(i)
    for i in range(m):
        if partners[i]:
            ladder = any(abs(p - q) <= 1 for k in (i - 1, i + 1) if 0 <= k < m for p in partners[i] for q in partners[k])
            out[i] = "E" if ladder else "B"
    for k, letter, over in ((4, "H", " EBGITS"), (3, "G", " TS"), (5, "I", " TS")):
        for i in range(1, m):
            if turn[k][i - 1] and turn[k][i]:
                span = range(i, min(i + k, m))
                if k == 4 or all(out[x] in (*over, letter) for x in span):
                    for x in span:
                        out[x] = letter
    for k in (3, 4, 5):
        for i in range(m):
            if turn[k][i]:
                for x in range(i + 1, min(i + k, m)):
                    if out[x] == " ":
                        out[x] = "T"
    for i in range(2, m - 2):
        if out[i] == " " and joined(i - 2, i + 2):
            a, b = ca[i] - ca[i - 2], ca[i + 2] - ca[i]
            cosine = a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-12)
            if np.degrees(np.arccos(np.clip(cosine, -1, 1))) > 70:
                out[i] = "S"
    return out


SIMPLE = {"H": "H", "G": "H", "I": "H", "E": "E", "B": "E", "T": "C", "S": "C", " ": "C"}


def dssp(frames: DataFrame, atoms: DataFrame, simplified: bool = True) -> DataFrame:
    """``frame``, ``resid``, ``code``: secondary structure; ``NA`` where a residue lacks a backbone atom."""
    backbone = atoms.filter(F.col("name").isin("N", "CA", "C", "O")).select("atom", "name", "resid", "chain", "resname")
    rows = frames.join(backbone, "atom").select("frame", "resid", "name", "chain", "resname", "x", "y", "z")

    def kernel(table: pa.Table) -> pa.Table:
        t = table.to_pandas().drop_duplicates(["resid", "name"])
        wide = t.pivot(index="resid", columns="name", values=["x", "y", "z"]).sort_index()
        info = t.groupby("resid").first()
        points = {a: np.stack([wide[(c, a)].to_numpy(float) if (c, a) in wide else np.full(len(wide), np.nan) for c in "xyz"], 1) for a in ("N", "CA", "C", "O")}
        whole = ~np.isnan(np.concatenate([points[a] for a in points], 1)).any(1)
        codes = np.full(len(wide), "NA", object)
        if whole.any():
            own = info.loc[wide.index[whole]]
            found = kabsch_sander(*[points[a][whole] for a in ("N", "CA", "C", "O")], own["chain"].to_numpy(), (own["resname"] == "PRO").to_numpy())
            codes[whole] = [SIMPLE[x] if simplified else x for x in found]
        frame = table.column("frame")[0].as_py()
        return pa.table([pa.array([frame] * len(wide), pa.int64()), pa.array(wide.index.to_numpy(), pa.int64()), pa.array(codes.tolist(), pa.string())], ["frame", "resid", "code"])

    ship_code(rows.sparkSession)
    return rows.groupBy("frame").applyInArrow(kernel, "frame long, resid long, code string")


def code_frequency(codes: DataFrame, simplified: bool = True) -> DataFrame:
    """``resid``, ``code``, ``frequency``: every residue with every class, H E C or those that occur."""
    # Eight classes at most.
    classes = list("HEC") if simplified else sorted(r["code"] for r in codes.select("code").distinct().collect())
    totals = codes.groupBy("resid").agg(F.count("*").alias("total"))
    counts = codes.groupBy("resid", "code").agg(F.count("*").alias("n"))
    full = totals.withColumn("code", F.explode(F.array(*[F.lit(x) for x in classes]))).join(counts, ["resid", "code"], "left")
    return full.select("resid", "code", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("frequency"))
