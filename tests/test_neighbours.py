from itertools import product

import numpy as np
import pytest

from orrery.operators import distance as ds
from orrery.operators.lattice import CELL, LATTICE, reduced, with_lattice
from orrery.operators.neighbours import pairs_within


def table(spark, xyz, box=None):
    rows = [(f, a, *map(float, xyz[f, a]), *(box or ())) for f in range(xyz.shape[0]) for a in range(xyz.shape[1])]
    return spark.createDataFrame(rows, "frame long, atom int, x double, y double, z double" + (", box_x double, box_y double, box_z double" if box else ""))


@pytest.mark.parametrize("box", [None, (1.0, 0.7, 0.3), (2.0, 0.0, 1.1)])
def test_pairs_equal_all_pairs(spark, box):
    """Cells that wrap over three, two and one, an edge without a cell, and no cell at all."""
    xyz = np.random.default_rng(4).uniform(-1.5, 1.5, (2, 60, 3))
    df = table(spark, xyz, box)
    got = sorted((r[0], r[1], r[2]) for r in pairs_within(df, df, 0.3).filter("a.atom <> b.atom").select("frame", "a.atom", "b.atom").collect())
    want = []
    for f, i, j in product(range(2), range(60), range(60)):
        d = xyz[f, j] - xyz[f, i]
        for k in range(3):
            if box and box[k]:
                d[k] -= box[k] * np.rint(d[k] / box[k])
        if i != j and np.sqrt((d * d).sum()) < 0.3:
            want.append((f, i, j))
    assert got == want
    with pytest.raises(ValueError):
        pairs_within(df, df, 0)


def test_rows_grow_with_the_atoms(spark):
    """At one density, eight times the atoms meet about eight times the rows, not 64 times."""
    rng = np.random.default_rng(5)
    met = []
    for edge in (1.0, 2.0):
        df = table(spark, rng.uniform(0, edge, (1, int(200 * edge**3), 3)))
        met.append(pairs_within(df, df, 0.2).count())
    assert met[1] < 12 * met[0]


def test_null_coordinates(spark):
    df = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, None, 0.0, 0.0), (0, 2, 0.1, 0.0, 0.0)], "frame long, atom int, x double, y double, z double")
    assert sorted(tuple(r) for r in pairs_within(df, df, 1.0).select("a.atom", "b.atom").collect()) == [(0, 0), (0, 2), (2, 0), (2, 2)]
    assert pairs_within(df.limit(0), df, 1.0).count() == 0


def test_reduced_lattices():
    """In a reduced lattice the nearest image is among the 27 around the rounded one."""
    rng = np.random.default_rng(1)
    cells = rng.normal(0, 1, (100, 3, 3))
    cells[::3, 0] *= 5
    cells[::7, 2] *= 0.1
    cells[::5, 1] += 7 * cells[::5, 0]
    few, many = (np.array(list(product(range(-k, k + 1), repeat=3))) for k in (1, 4))
    for cell, old in zip(reduced(cells), cells, strict=True):
        turns = cell @ np.linalg.inv(old)
        assert np.allclose(turns, np.rint(turns), atol=1e-6) and np.isclose(abs(np.linalg.det(turns)), 1)
        d = rng.normal(0, 3, (20, 3))
        d -= np.rint(d @ np.linalg.inv(cell)) @ cell
        assert np.allclose(*(np.linalg.norm(d[:, None] + (s @ cell)[None], axis=2).min(1) for s in (few, many)))


def test_cells_by_frame(spark):
    rows = [(0, 0, 0.0, 0.0, 0.0, *np.eye(3).ravel().tolist()), (0, 1, 0.9, 0.0, 0.0, *np.eye(3).ravel().tolist()), (1, 0, 0.0, 0.0, 0.0, *[None] * 9), (1, 1, 0.9, 0.0, 0.0, *[None] * 9), (2, 0, 0.0, 0.0, 0.0, *[0.0] * 9), (2, 1, 0.9, 0.0, 0.0, *[0.0] * 9)]
    df = spark.createDataFrame(rows, "frame long, atom int, x double, y double, z double, " + ", ".join(f"{c} double" for c in CELL))
    got = ds.pair_distances(df, spark.createDataFrame([(0, 1)], "i int, j int")).orderBy("frame").collect()
    assert [r.distance_nm for r in got] == pytest.approx([0.1, 0.9, 0.9])
    assert with_lattice(df).filter("frame > 0").select(*LATTICE).distinct().count() == 1


def test_contacts_within(spark):
    xyz = np.random.default_rng(6).uniform(0, 1, (3, 30, 3))
    df = table(spark, xyz, (1.0, 1.0, 1.0))
    atoms = spark.createDataFrame([(i, "CA" if i % 3 else "N", "C", i // 3) for i in range(30)], "atom int, name string, element string, resid int")
    whole = ds.contacts(df, atoms).filter("distance_nm < 0.3")
    got = ds.contacts_within(df, atoms, 0.3)
    key = lambda rows: sorted((r.frame, r.ri, r.rj, round(r.distance_nm, 9)) for r in rows.collect())
    assert key(got) == key(whole) != []
