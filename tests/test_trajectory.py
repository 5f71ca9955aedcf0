"""Trajectory operators on small inputs whose answers are known."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import selection
from orrery.operators import decomposition as dc
from orrery.operators import distance as ds
from orrery.operators import fes, frames, lagged, metrics, surface
from orrery.session import staged
from orrery.sources import trajectory

FRAMES = "frame long, time_ps double, atom int, x double, y double, z double"
ATOMS = "atom int, name string, element string, resid int, resseq int, resname string, chain int"


def make(spark, xyz, step=10.0):
    rows = [(f, f * step, a, *map(float, p)) for f, ps in enumerate(xyz) for a, p in enumerate(ps)]
    return spark.createDataFrame(rows, FRAMES)


def chain_atoms(spark, n):
    return spark.createDataFrame([(i, "CA", "C", i, i + 1, "ALA", 0) for i in range(n)], ATOMS)


@pytest.fixture(scope="module")
def two(spark):
    return make(spark, [[(0, 0, 0), (x, 0, 0)] for x in (1.0, 1.1, 0.9)])


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(3)
    base = np.arange(12)[:, None] * np.array([0.38, 0.05, 0.0])
    return base[None] + rng.normal(scale=0.1, size=(20, 12, 3))


def kabsch(a, b):
    a, b = a - a.mean(0), b - b.mean(0)
    u, s, vt = np.linalg.svd(a.T @ b)
    s[2] *= np.sign(np.linalg.det(u @ vt))
    return math.sqrt(max(0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a)))


def test_rmsf_and_units(spark, two):
    got = {r["atom"]: r["rmsf_nm"] for r in metrics.rmsf(two).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(math.sqrt(0.02 / 3))
    last = frames.with_units(frames.frame_times(two)).orderBy(F.desc("frame")).first()
    assert last["time_ns"] == pytest.approx(0.02)
    # Places, not raw numbers: of every second frame the last is the second.
    strided = frames.frame_times(frames.frame_range(two, 0, None, 2), 5.0)
    assert sorted({(r["frame"], r["time_ps"]) for r in strided.collect()}) == [(0, 0.0), (2, 5.0)] and strided.columns == two.columns
    untimed = frames.frame_times(frames.frame_range(two, 1).withColumn("time_ps", F.lit(None).cast("double")))
    assert sorted({(r["frame"], r["time_ps"]) for r in untimed.collect()}) == [(1, 0.0), (2, 1.0)]
    assert {r["resseq"] for r in frames.residue_ids(two, chain_atoms(spark, 2)).collect()} == {1, 2}


def test_rmsd_equals_svd_and_any_partitioning(spark, cloud):
    df = make(spark, cloud)
    for parts in (1, 7):
        got = {r["frame"]: r["rmsd_nm"] for r in metrics.rmsd(df.repartition(parts)).collect()}
        assert got[0] == 0
        for f in range(1, len(cloud)):
            assert got[f] == pytest.approx(kabsch(cloud[f], cloud[0]), abs=1e-7)
    with pytest.raises(ValueError):
        metrics.rmsd(df, 99)


def test_alignment_minimises_the_distance(spark, cloud):
    turned = cloud @ np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]]) + 5
    turned[0] = cloud[0]
    out = frames.align(make(spark, turned), chain_atoms(spark, 12)).toPandas().sort_values(["frame", "atom"])
    xyz = out[["x", "y", "z"]].to_numpy().reshape(turned.shape)
    for f in range(len(cloud)):
        assert np.sqrt(((xyz[f] - cloud[0]) ** 2).sum(1).mean()) == pytest.approx(kabsch(cloud[f], cloud[0]), abs=1e-6)


def test_correlations(spark, monkeypatch):
    off = [0, 0.02, -0.02, 0.04, -0.04]
    df = make(spark, [[(1 + o, 0, 0), (2 + o, 0, 0), (3 - o, 0, 0), (4, 0, 0)] for o in off], 100.0)
    got = {(r["i"], r["j"]): r["correlation"] for r in metrics.correlations(df).collect()}
    assert got[0, 1] > 0.99 and got[0, 2] < -0.99 and all(got[i, i] == 1 for i in range(4)) and got[0, 3] == 0 and len(got) == 16
    with pytest.raises(ValueError):
        metrics.correlations(df.filter("frame = 0"))
    # Both ways of summing agree, for atoms that some frames lack too.
    rng = np.random.default_rng(4)
    gaps = make(spark, rng.normal(size=(30, 6, 3))).filter("not (frame % 4 = 1 and atom = 2)")
    square = {(r["i"], r["j"]): r["correlation"] for r in metrics.correlations(gaps).collect()}
    monkeypatch.setattr(metrics, "SQUARE_ATOMS", 3)
    folded = {(r["i"], r["j"]): r["correlation"] for r in metrics.correlations(gaps).collect()}
    assert square.keys() == folded.keys() and len(square) == 36
    assert all(square[k] == pytest.approx(folded[k], abs=1e-12) for k in square)


def test_replicas(spark):
    rows = [(r, p, 1.0 + 0.1 * r + p) for r in range(3) for p in range(4)]
    a = spark.createDataFrame(rows, "replica int, pos int, rmsf_nm double")
    got = {r["pos"]: r for r in metrics.average_rmsf(a).collect()}
    own = np.array([1.0, 1.1, 1.2]) ** 2
    assert got[0]["rmsf_nm"] == pytest.approx(math.sqrt(own.mean()))
    assert got[0]["sem_nm"] == pytest.approx(own.std(ddof=1) / math.sqrt(3) / (2 * math.sqrt(own.mean())))
    one = metrics.average_rmsf(a.filter("replica = 0")).collect()
    assert all(r["sem_nm"] is None for r in one)
    delta = metrics.delta_rmsf(a.filter("replica = 0"), a).collect()
    assert all(r["sem_nm"] is None for r in delta) and len(delta) == 4
    with pytest.raises(ValueError):
        metrics.average_rmsf(a.filter("replica > 0 or pos > 1"))
    with pytest.raises(ValueError):
        metrics.average_rmsf(a.limit(0))
    with pytest.raises(ValueError):
        metrics.delta_rmsf(a, a.filter("pos < 2"))


def test_slicing(spark, cloud):
    df = make(spark, cloud)
    ids = lambda d: sorted({r["frame"] for r in d.select("frame").distinct().collect()})
    assert ids(frames.frame_range(df, 3, 12, 4)) == [3, 7, 11] and ids(frames.frame_range(df, 50)) == [] and ids(frames.frame_range(df, 18, 99)) == [18, 19]
    for bad in ((-1, None, 1), (0, 0, 1), (0, None, 0)):
        with pytest.raises(ValueError):
            frames.frame_range(df, *bad)
    for s in (slice(-5, None, 2), slice(None, None, -3), slice(2, -2, None), slice(30, 40, 1)):
        want = list(range(20))[s]
        out = frames.slice_frames(df, s.start, s.stop, s.step)
        assert ids(out) == list(range(len(want)))
        times = {r["frame"]: r["time_ps"] for r in out.collect()}
        assert [times[i] for i in range(len(want))] == [f * 10.0 for f in want]
    with pytest.raises(ValueError):
        frames.slice_frames(df, None, None, 0)
    for n in (1, 4, 7, 19, 20):
        assert ids(frames.subsample_frames(df, n)) == np.linspace(0, 19, n, dtype=int).tolist()
    with pytest.raises(ValueError):
        frames.subsample_frames(df, 21)
    assert ids(frames.merge_trajectories([df, df.filter("frame < 2")])) == list(range(22))
    with pytest.raises(ValueError):
        frames.merge_trajectories([df])


def test_moving_average(spark):
    x = np.arange(9.0) ** 2
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "frame long, v double")
    for w in (1, 3, 4, 5):
        got = [r["v_mean"] for r in frames.moving_average(df, "v", w).orderBy("frame").collect()]
        want = np.convolve(x, np.ones(w), "same") / np.convolve(np.ones(9), np.ones(w), "same")
        assert got == pytest.approx(want.tolist())


def test_selection(spark):
    rows = [(0, "N", "N", 0, 1, "ALA", 0), (1, "CA", "C", 0, 1, "ALA", 0), (2, "CB", "C", 0, 1, "ALA", 0), (3, "O", "O", 1, 2, "HOH", 1), (4, "CA", "CA", 2, 3, "CA", 1), (5, "CA", "C", 3, 4, "GLY", 1)]
    atoms = spark.createDataFrame(rows, ATOMS)
    pick = lambda s: sorted(r["atom"] for r in selection.select_atoms(atoms, s).collect())
    assert pick("name CA") == [1, 4, 5] and pick("protein and name CA") == [1, 5] and pick("backbone") == [0, 1, 5]
    assert pick("not water") == [0, 1, 2, 4, 5] and pick("resid 1 to 2 or index 0") == [0, 3, 4] and pick("resSeq 4") == [5]
    assert pick("(resname ALA HOH) and not (name N or sidechain)") == [1, 3]
    assert {r["atom"] for r in frames.strip_solvent(atoms).collect()} == {0, 1, 2, 5} and frames.strip_solvent(atoms, True).count() == 5
    assert frames.extract_chain(atoms, 1).count() == 3
    for bad in ("", "name", "resid x", "foo 1", "(all", "all all"):
        with pytest.raises(ValueError):
            selection.compile_selection(bad)
    for text, same in (("index < 3", "index 0 to 2"), ("index<=3 and resid != 1", "index 0 to 2"), ("index ge 1 && name == CA || index = 0", "name CA or index 0"), ("not index gt 1", "index 0 1"), ("name != CA CB", "index 0 3")):
        assert sorted(r["atom"] for r in atoms.filter(selection.compile_selection(text)).collect()) == sorted(r["atom"] for r in atoms.filter(selection.compile_selection(same)).collect()), text
    for bad in ("index <", "name < CA", "index < 1 2", "index < x", "name CA | name CB", "index == < 2"):
        with pytest.raises(ValueError):
            selection.compile_selection(bad)
    for bad in (lambda: pick("name ZZ"), lambda: frames.extract_chain(atoms, 7), lambda: frames.strip_solvent(atoms.filter("resname = 'HOH'"))):
        with pytest.raises(ValueError):
            bad()


def test_distances(spark, two):
    pairs = spark.createDataFrame([(0, 1), (0, 0)], "i int, j int")
    got = {(r["frame"], r["i"], r["j"]): r["distance_nm"] for r in ds.pair_distances(two, pairs).collect()}
    assert got[1, 0, 1] == pytest.approx(1.1) and got[0, 0, 0] == 0 and len(got) == 6
    assert ds.pair_distances(two, pairs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ds.pair_distances(two, spark.createDataFrame([(0, 9)], "i int, j int"))
    boxed = two.withColumn("box_x", F.lit(1.05)).withColumn("box_y", F.lit(9.0)).withColumn("box_z", F.lit(9.0))
    near = {r["frame"]: r["distance_nm"] for r in ds.pair_distances(boxed, pairs.filter("j = 1")).collect()}
    assert near[0] == pytest.approx(0.05) and near[2] == pytest.approx(0.15)
    assert {r["frame"]: r["distance_nm"] for r in ds.pair_distances(boxed, pairs.filter("j = 1"), periodic=False).collect()}[0] == pytest.approx(1.0)
    atoms = chain_atoms(spark, 2)
    assert ds.ca_distance_features(two, atoms).filter("frame = 2").first()["features"] == pytest.approx([0.9])
    with pytest.raises(ValueError):
        ds.ca_distance_features(two, atoms.limit(1))


def test_native_contacts(spark, cloud):
    df, atoms = make(spark, cloud), chain_atoms(spark, 12)
    got = {r["frame"]: r["q"] for r in ds.native_contacts(df, atoms, 1.3).collect()}
    far = lambda f: np.sqrt(((cloud[f][:, None] - cloud[f][None]) ** 2).sum(2))
    native = [(i, j) for i in range(12) for j in range(i + 3, 12) if far(0)[i, j] < 1.3]
    for f in range(20):
        assert got[f] == pytest.approx(np.mean([far(f)[p] < 1.3 for p in native]))
    for bad in (lambda: ds.native_contacts(df, atoms, 1.3, 99), lambda: ds.native_contacts(df, atoms, 0.01), lambda: ds.contacts(df, atoms, "x")):
        with pytest.raises(ValueError):
            bad()


def test_hydrogen_bonds(spark):
    atoms = spark.createDataFrame([(0, "N", "N", 0, 1, "DON", 0), (1, "H", "H", 0, 1, "DON", 0), (2, "O", "O", 1, 2, "ACC", 0)], ATOMS)
    df = make(spark, [[(0, 0, 0), (0.1, 0, 0), (x, 0, 0)] for x in (0.25, 0.45, 0.24)], 20.0)
    bonds = spark.createDataFrame([(0, 1)], "a int, b int")
    for method in ("baker_hubbard", "wernet_nilsson"):
        found = ds.hydrogen_bonds(df, atoms, bonds, method)
        assert [r["n"] for r in ds.bond_counts(found, df).orderBy("frame").collect()] == [1, 0, 1]
        occupancy = ds.bond_labels(ds.bond_occupancy(found), atoms).first()
        assert occupancy["occupancy"] == pytest.approx(2 / 3) and occupancy["label"] == "DON1:N-H ... ACC2:O"
    # The same bond over the cell's edge: the acceptor's nearest image counts, unless it's not wanted.
    across = make(spark, [[(0.05, 0, 0), (0.15, 0, 0), (0.05 + x - 2.0, 0, 0)] for x in (0.25, 0.45, 0.24)], 20.0)
    across = across.withColumn("box_x", F.lit(2.0)).withColumn("box_y", F.lit(3.0)).withColumn("box_z", F.lit(3.0))
    for method in ("baker_hubbard", "wernet_nilsson"):
        found = ds.hydrogen_bonds(across, atoms, bonds, method)
        assert [r["n"] for r in ds.bond_counts(found, across).orderBy("frame").collect()] == [1, 0, 1]
        assert ds.hydrogen_bonds(across, atoms, bonds, method, periodic=False).count() == 0
    for bad in ({"freq": 2}, {"distance_cutoff_nm": 0}, {"angle_cutoff_deg": 181}, {"method": "x"}):
        with pytest.raises(ValueError):
            ds.hydrogen_bonds(df, atoms, bonds, **bad)


def test_free_energy(spark):
    rng = np.random.default_rng(1)
    xy = rng.multivariate_normal([0, 0], [[1, 0.3], [0.3, 0.5]], 3000)
    xy = np.vstack([xy, [[1.0, 1.0]] * 50])
    df = spark.createDataFrame(xy.tolist(), "x double, y double")
    got = fes.free_energy(df, "x", "y", (20, 15), 310.15)
    rows = {(r["bx"], r["by"]): r for r in got.collect()}
    density, ex, ey = np.histogram2d(xy[:, 0], xy[:, 1], (20, 15), density=True)
    assert len(rows) == 300 and min(r["free_energy"] for r in rows.values() if r["observed"]) == 0
    best = density.max()
    for (i, j), r in rows.items():
        assert r["density"] == pytest.approx(density[i, j]) and r["x_lo"] == pytest.approx(ex[i])
        if density[i, j] > 0:
            assert r["free_energy"] == pytest.approx(-8.314462618e-3 * 310.15 * math.log(density[i, j] / best))
        else:
            assert r["free_energy"] is None and not r["observed"]
    for bad in ({"temperature_k": 0}, {"min_probability": 0}, {"bins": 0}, {"ranges": ((9.0, 9.5), (9.0, 9.5))}):
        with pytest.raises(ValueError):
            fes.free_energy(df, "x", "y", **bad)
    with pytest.raises(ValueError):
        fes.free_energy(df.limit(1), "x", "y")


def test_bins_on_edges(spark):
    x = np.repeat(np.arange(1, 51), 3).astype(float)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for n in (20, 25, 49, 50):
        got = fes.with_bin(df, "x", 1.0, 50.0, n, "b").groupBy("b").count().collect()
        want = np.histogram(x, n)[0]
        assert {r["b"]: r["count"] for r in got} == {i: c for i, c in enumerate(want) if c}


def test_components(spark):
    rng = np.random.default_rng(2)
    x = np.stack([np.linspace(-5, 5, 300), rng.normal(scale=0.02, size=300), rng.normal(size=300)], 1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame long, features array<double>").repartition(3)
    model = dc.fit_pca(df, 2, standardize=False)
    c = np.cov(x.T, bias=True)
    assert model.explained_variance_ratio == pytest.approx(np.linalg.eigvalsh(c)[::-1][:2] / np.trace(c))
    got = np.array([r["features"] for r in dc.project(df, model).orderBy("frame").collect()])
    assert got == pytest.approx((x - x.mean(0)) @ model.components.T, abs=1e-9)
    z = dc.fit_pca(df, 3)
    assert z.explained_variance_ratio.sum() == pytest.approx(1) and dc.explained_variance(z, spark).orderBy(F.desc("component")).first()["cumulative"] == pytest.approx(1)
    slow = np.zeros(400)
    for i in range(1, 400):
        slow[i] = 0.95 * slow[i - 1] + rng.normal()
    rows = spark.createDataFrame([(i, [float(s), float(rng.normal())]) for i, s in enumerate(slow)], "frame long, features array<double>")
    tica = dc.fit_tica(rows, 5, 2)
    first = np.array([r["features"][0] for r in dc.project(rows, tica).orderBy("frame").collect()])
    assert abs(np.corrcoef(first, slow)[0, 1]) > 0.95
    for bad in (lambda: dc.fit_pca(df, 4), lambda: dc.fit_tica(rows, 0), lambda: dc.fit_tica(rows, 400), lambda: dc.fit_pca(df.limit(1)), lambda: dc.project(rows, model).count()):
        with pytest.raises(ValueError):
            bad()


def slow_latents(rng, n, speeds):
    out = np.zeros((n, len(speeds)))
    for i in range(1, n):
        out[i] = speeds * out[i - 1] + rng.normal(size=len(speeds))
    return out


def test_tica_iterated_equals_dense(spark, monkeypatch):
    """200 features of full rank, in two trajectories, cut back on the way; then features of small rank."""
    rng = np.random.default_rng(11)
    x = np.vstack([slow_latents(rng, 1_500, 0.98 * 0.9 ** np.arange(200)) @ rng.normal(size=(200, 200)) / 14 for _ in range(2)]) + 30
    df = spark.createDataFrame([(i % 1_500, i // 1_500, v) for i, v in enumerate(x.tolist())], "frame long, traj int, features array<double>").repartition(4)
    whole = dc.fit_tica(df, 3, 3, partition=["traj"])
    monkeypatch.setattr(lagged, "MOST", 8)
    thin = dc.fit_tica(df, 3, 3, partition=["traj"], max_features=100)
    size = np.abs(whole.components).max()
    assert np.allclose(thin.mean, whole.mean) and np.allclose(thin.components, whole.components, atol=1e-4 * size)
    assert np.isnan(thin.explained_variance_ratio).all()
    few = df.withColumn("features", F.concat(F.slice("features", 1, 3), F.slice("features", 1, 3), F.array(F.lit(1.0))))
    thin, whole = (dc.fit_tica(few, 3, 3, partition=["traj"], max_features=m) for m in (2, 100))
    a, b = (np.array([r["features"] for r in dc.project(few, m).orderBy("traj", "frame").collect()]) for m in (thin, whole))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-6)


def test_tica_of_ten_thousand_features(spark):
    rng = np.random.default_rng(12)
    latents = slow_latents(rng, 400, np.array([0.97, 0.8, 0.5, 0.2, 0.1]))
    mix = rng.normal(size=(5, 10_000))
    small = spark.createDataFrame([(i, v) for i, v in enumerate(latents.tolist())], "frame long, features array<double>")
    wide = spark.createDataFrame([(i, v) for i, v in enumerate((latents @ mix).tolist())], "frame long, features array<double>").repartition(8)
    wide = staged(wide, "wide")
    a, b = (np.array([r["features"] for r in dc.project(t, dc.fit_tica(t, 2, 2)).orderBy("frame").collect()]) for t in (wide, small))
    assert np.allclose(np.abs(a), np.abs(b), atol=1e-6)


def test_many_features(spark, monkeypatch):
    """Iterated components equal those of the whole covariance; null rows stay null."""
    rng = np.random.default_rng(8)
    x = 50 + rng.normal(size=(300, 40)) @ np.diag(0.8 ** np.arange(40)) @ rng.normal(size=(40, 40))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame long, features array<double>").repartition(5)
    for standardize in (True, False):
        monkeypatch.setattr(dc, "MAX_FEATURES", 4_000)
        whole = dc.fit_pca(df, 3, standardize)
        monkeypatch.setattr(dc, "MAX_FEATURES", 10)
        thin = dc.fit_pca(df, 3, standardize)
        assert np.allclose(thin.explained_variance_ratio, whole.explained_variance_ratio, atol=1e-7)
        assert np.allclose(thin.components, whole.components, atol=1e-3) and np.allclose(thin.scale, whole.scale) and np.allclose(thin.mean, whole.mean)
    out = dc.project(df.unionByName(spark.createDataFrame([(999, None)], df.schema)), whole)
    got = {r["frame"]: r["features"] for r in out.collect()}
    assert got[999] is None and len(got) == 301 and np.allclose(got[7], whole.components @ (x[7] - whole.mean))


def test_torsions(spark):
    names = ["N", "CA", "C"]
    rng = np.random.default_rng(4)
    xyz = np.cumsum(rng.normal(scale=0.15, size=(2, 9, 3)), 1)
    atoms = spark.createDataFrame([(i, names[i % 3], names[i % 3][0], i // 3, i // 3 + 1, "ALA", 0) for i in range(9)], ATOMS)
    df = make(spark, xyz)
    wide = dc.backbone_torsions(df, atoms).orderBy("frame").collect()
    assert len(wide[0]["features"]) == 8
    angles = dc.torsion_table(df, atoms)
    assert angles.count() == 8 and dc.ramachandran(angles).count() == 2
    p = xyz[0][2:6]
    b = np.diff(p, axis=0)
    n1, n2 = np.cross(b[0], b[1]), np.cross(b[1], b[2])
    sign = math.copysign(1, b[0] @ n2)
    want = sign * math.acos(np.clip(n1 @ n2 / np.linalg.norm(n1) / np.linalg.norm(n2), -1, 1))
    got = angles.filter("frame = 0 and kind = 'phi' and resid = 1").first()["angle"]
    assert got == pytest.approx(want) and wide[0]["features"][0] == pytest.approx(math.cos(want))
    with pytest.raises(ValueError):
        dc.backbone_torsions(df, atoms.filter("resid = 0"))


def test_surface(spark):
    far = make(spark, [[(0, 0, 0), (5, 0, 0)]])
    atoms = chain_atoms(spark, 2)
    got = {r["unit_id"]: r["value_nm2"] for r in surface.sasa(far, atoms).collect()}
    assert got[0] == pytest.approx(4 * math.pi * 0.31**2) == got[1]
    near = surface.sasa(make(spark, [[(0, 0, 0), (0.2, 0, 0)]]), atoms, "atom", n_sphere_points=4000).filter("unit_id = 0").first()["value_nm2"]
    assert near == pytest.approx(2 * math.pi * 0.31 * (0.31 + 0.1), rel=0.01)
    assert metrics.aggregate_units(surface.sasa(far, atoms)).first()["value_nm2"] == pytest.approx(2 * got[0])
    with pytest.raises(ValueError):
        surface.sasa(far, atoms, "x")


def helix(n):
    """Backbone of an ideal alpha helix, by internal coordinates."""
    def place(a, b, c, r, theta, phi):
        theta, phi = math.radians(theta), math.radians(phi)
        bc = (c - b) / np.linalg.norm(c - b)
        m = np.cross(b - a, bc)
        m /= np.linalg.norm(m)
        return c + r * (-math.cos(theta) * bc + math.sin(theta) * (math.cos(phi) * np.cross(m, bc) + math.sin(phi) * m))

    out = [np.array([0.0, 0, 0]), np.array([0.1458, 0, 0]), np.array([0.2, 0.14, 0])]
    rows = []
    for i in range(n):
        nn, ca, c = out[3 * i : 3 * i + 3]
        n1 = place(nn, ca, c, 0.1329, 116.2, -47)
        ca1 = place(ca, c, n1, 0.1458, 121.7, 180)
        c1 = place(c, n1, ca1, 0.1525, 111.0, -57)
        o = place(nn, ca, c, 0.1231, 120.5, -47 + 180)
        rows += [nn, ca, c, o]
        out += [n1, ca1, c1]
    return np.array(rows)


def test_secondary_structure(spark):
    xyz = helix(14)
    names = ["N", "CA", "C", "O"]
    atoms = spark.createDataFrame([(i, names[i % 4], names[i % 4][0], i // 4, i // 4 + 1, "ALA", 0) for i in range(len(xyz))], ATOMS)
    codes = surface.dssp(make(spark, [xyz, xyz]), atoms)
    middle = {r["code"] for r in codes.filter("resid between 3 and 10").collect()}
    assert middle == {"H"}
    share = {(r["resid"], r["code"]): r["frequency"] for r in surface.code_frequency(codes).collect()}
    assert share[5, "H"] == 1 and share[5, "E"] == 0 and len(share) == 42


def test_files(spark, tmp_path, cloud):
    df, atoms = make(spark, cloud), chain_atoms(spark, 12)
    paths = [f"{tmp_path}/{i}" for i in range(2)]
    for p in paths:
        trajectory.write_trajectory(df, p)
    got = trajectory.load_trajectory(spark, paths[0], atoms, 2, 11, 3, "resid 0 to 3")
    assert sorted({(r["frame"], r["atom"]) for r in got.collect()}) == [(f, a) for f in (2, 5, 8) for a in range(4)]
    assert trajectory.load_trajectories(spark, paths, stride=10).groupBy("traj_id").count().collect()[0]["count"] == 24
    for bad in (lambda: trajectory.load_trajectories(spark, []), lambda: trajectory.load_trajectories(spark, paths, [atoms]), lambda: trajectory.load_trajectory(spark, paths[0], atom_selection="all")):
        with pytest.raises(ValueError):
            bad()
    pdb = "".join(f"MODEL {m}\nATOM      1  N   ALA A   7       1.000   2.000   3.000  1.00  0.00           N\nATOM      2  CA  GLY B   8      {m}1.000   2.000   3.000  1.00  0.00           C\nENDMDL\n" for m in (1, 2))
    (tmp_path / "a.pdb").write_text(pdb)
    f, a = trajectory.read_pdb(spark, f"{tmp_path}/a.pdb")
    assert {(r["frame"], r["atom"]): r["x"] for r in f.collect()}[1, 1] == pytest.approx(2.1)
    assert [(r["name"], r["resid"], r["resseq"], r["chain"], r["chain_id"]) for r in a.orderBy("atom").collect()] == [("N", 0, 7, 0, "A"), ("CA", 1, 8, 1, "B")]
    (tmp_path / "a.gro").write_text("t\n    2\n    1ALA      N    1   0.100   0.200   0.300\n    1ALA     CA    2   0.400   0.500   0.600\n   1.0   1.0   1.0\n")
    f, a = trajectory.read_gro(spark, f"{tmp_path}/a.gro")
    assert a.count() == 2 and f.filter("atom = 1").first()["z"] == pytest.approx(0.6)


def test_places_of_several_trajectories(spark, monkeypatch):
    rows = [(t, f, a, None) for t, numbers in (("a", range(0, 200, 10)), ("b", range(5, 90, 7)), (None, (3, 1))) for f in numbers for a in (0, 1)]
    df = spark.createDataFrame([*rows, ("a", None, 0, None)], "traj_id string, frame long, atom int, time_ps double")
    want = {(t, f): 2.0 * n for t, numbers in (("a", range(0, 200, 10)), ("b", range(5, 90, 7)), (None, (1, 3))) for n, f in enumerate(numbers)}
    for bucket in (16, 1 << 16):
        monkeypatch.setattr(frames, "PLACE_BUCKET", bucket)
        got = frames.frame_times(df, 2.0).collect()
        assert len(got) == len(rows) and {(r["traj_id"], r["frame"]): r["time_ps"] for r in got} == want
        alone = frames.frame_times(df.filter("traj_id = 'b'").drop("traj_id")).select("frame", "atom", "time_ps").collect()
        assert {r["frame"]: r["time_ps"] for r in alone} == {f: float(n) for n, f in enumerate(range(5, 90, 7))}
    assert frames.frame_times(df.limit(0), 1.0).count() == 0
