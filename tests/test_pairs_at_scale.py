"""All-pairs steps: several blocks, few rows shuffled, same results as brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import clustering as cl
from orrery.operators import fingerprints as fg


@pytest.fixture
def small_bits(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), [int(x)]) for i, x in enumerate(rng.integers(-(2**62), 2**62, 60))] + [(60, [0]), (61, [-1])]
    return rows, spark.createDataFrame(rows, "mol_id long, fp array<long>")


@pytest.mark.parametrize("metric", ["mcconnaughey", "tanimoto", "allbit"])
def test_fingerprint_pairs_are_unpacked_from_blocks(small_bits, metric, monkeypatch):
    rows, fps = small_bits
    monkeypatch.setattr(fg, "BLOCK", 16)
    looked_up = {(r.i, r.j): r.similarity for r in fg.pair_similarities(fps, 64, metric, digits=6).collect()}
    monkeypatch.setattr(fg, "LOOKED_UP", 0)
    found = fg.pair_similarities(fps, 64, metric, digits=6)
    direct = {(r.i, r.j): r.similarity for r in found.collect()}
    assert looked_up == direct and len(direct) == 62 * 61 // 2
    counts = fg.pair_counts(fps)
    own = {(r.i, r.j): (r.c, r.a, r.b) for r in counts.collect()}
    ones = {m: bin(x[0] & (2**64 - 1)) for m, x in rows}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        c = bin(a[0] & b[0] & (2**64 - 1)).count("1")
        assert own[j, i] == (c, ones[j].count("1"), ones[i].count("1"))
    assert "SortMergeJoin" not in counts._jdf.queryExecution().toString()


def test_packed_bits(spark):
    bits = [True] * 3 + [False] * 60 + [True] + [None, True]
    row = spark.createDataFrame([(bits,), (None,)], "b array<boolean>").select(fg.pack_bits(F.col("b"), 70).alias("w")).collect()
    assert row[0]["w"] == [7 - 2**63, 2] and row[1]["w"] == [0, 0]


@pytest.fixture
def small_blocks(monkeypatch):
    from orrery.operators import blocks

    monkeypatch.setattr(blocks, "ROWS", 40)
    monkeypatch.setattr(blocks, "TILE", 16)


def _points(n=150, seed=3):
    v = np.random.default_rng(seed).normal(size=(n, 4)) * 0.5
    v[7] = v[3]
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(2))
    return v, d


def _features(spark, v):
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "frame long, features array<double>")


def test_space_counts_sums_links(spark, small_blocks):
    v, d = _points()
    features = _features(spark, v)
    space, pairs = cl.feature_space(features), cl.feature_pairs(features)
    assert pairs.count() == 150 * 149 // 2
    n = {r.frame: r.n for r in cl.neighbour_counts(space, features, 0.5).collect()}
    assert n == {i: int((d[i] <= 0.5).sum()) for i in range(150)}
    labels = features.select("frame", (F.col("frame") % 3).alias("label"))
    assert sorted(cl.medoids(space, labels).collect()) == sorted(cl.medoids(pairs, labels).collect())
    for same in (lambda p: cl.dbscan(p, features, 0.4, 4), lambda p: cl.hierarchical(p, features, "single", 0.35)):
        assert sorted(same(space).collect()) == sorted(same(pairs).collect())


def test_greedy_of_more_edges_than_are_listed(spark, small_blocks, monkeypatch):
    v, _ = _points()
    features = _features(spark, v)
    listed = sorted(cl.gromos(cl.feature_pairs(features, 0.5), features, 0.5).collect())
    monkeypatch.setattr(cl, "LISTED", 30)
    monkeypatch.setattr(cl, "TRIED", 20)
    assert sorted(cl.gromos(cl.feature_space(features), features, 0.5).collect()) == listed


def test_rmsd_tile_equals_superposition(spark):
    from orrery.operators.blocks import least_rmsd

    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(6, 5, 3)), rng.normal(size=(7, 5, 3))
    b[0] = a[1] @ np.array([[0.0, 1, 0], [0, 0, 1], [1, 0, 0]]) + 3
    got = least_rmsd(a.reshape(6, 15), b.reshape(7, 15))
    for i, j in itertools.product(range(6), range(7)):
        p, q = a[i] - a[i].mean(0), b[j] - b[j].mean(0)
        w, s, t = np.linalg.svd(p.T @ q)
        s[2] *= np.sign(np.linalg.det(w @ t))
        assert math.isclose(got[i, j], math.sqrt(max(0, (p**2).sum() + (q**2).sum() - 2 * s.sum()) / 5), abs_tol=1e-6)


def test_butina_of_more_edges_than_are_listed(spark, small_bits, small_blocks, monkeypatch):
    _, fps = small_bits
    points = fps.select(F.col("mol_id").alias("frame"))
    near = fg.pair_similarities(fps, 64, "tanimoto", 0.35).select(F.col("j").alias("i"), F.col("i").alias("j"))
    listed = sorted(cl.butina(near, points).collect())
    monkeypatch.setattr(cl, "LISTED", 5)
    monkeypatch.setattr(cl, "TRIED", 10)
    assert sorted(fg.cluster(fps, 64, 0.35).select("cluster_id", F.col("mol_id").alias("frame"), "is_centroid", "size").collect()) == listed


def test_similarities_of_arrays(spark):
    from orrery.functions.similarity import METRICS, VALUES

    rows = [(c, a, b) for a in range(5) for b in range(5) for c in range(min(a, b) + 1)]
    df = spark.createDataFrame(rows, "c int, a int, b int")
    c, a, b = (np.array(x, float) for x in zip(*rows, strict=True))
    got = df.select("c", "a", "b", *[m(F.col("c"), F.col("a"), F.col("b"), F.lit(8)).alias(k) for k, m in METRICS.items()]).collect()
    for k in METRICS:
        assert {(r.c, r.a, r.b): r[k] for r in got} == dict(zip(rows, VALUES[k](c, a, b, 8).tolist(), strict=True))


def test_density_tree_from_spanning_forests(spark, small_blocks, monkeypatch):
    from orrery.operators import blocks

    v, _ = _points(230, 9)
    v = np.vstack([v, v[:12], v[:12], v[:12] + 6, np.full((8, 4), 9.0)])  # copies: ties
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "frame long, features array<double>")
    monkeypatch.setattr(blocks, "SQUARE", 24)
    for k in (1, 3, 5):
        want = {r.frame: r.label for r in cl.hdbscan(cl.feature_pairs(df), df, 5, k).collect()}
        monkeypatch.setattr(cl, "MAX_POINTS", 100)  # of points none is asked for
        space = cl.feature_space(df)
        assert {r.frame: r.label for r in cl.hdbscan(space, df, 5, k).collect()} == want and len(set(want.values())) > 2
        monkeypatch.setattr(cl, "FOREST_EDGES", 300)
        assert {r.frame: r.label for r in cl.hdbscan(space, df, 5, k).collect()} == want
        monkeypatch.undo()
        monkeypatch.setattr(blocks, "ROWS", 40)
        monkeypatch.setattr(blocks, "TILE", 16)
        monkeypatch.setattr(blocks, "SQUARE", 24)
    # Edges that leave a task are of the points and blocks, not of the pairs.
    core = df.select("frame", F.lit(0.0).alias("c"))
    space = cl.feature_space(df)
    assert space.spanning(core).count() <= len(v) * (len(v) // space.per + 2)


@pytest.mark.parametrize("linkage", ["average", "complete"])
def test_linkage_in_rounds_of_mutual_nearest(spark, small_blocks, monkeypatch, linkage):
    v, _ = _points(170, 21)
    v = np.vstack([v, v[:9], v[:9], v[40:44] + 1e-3])
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "frame long, features array<double>")
    pairs, space = cl.feature_pairs(df), cl.feature_space(df)
    got = lambda p, **how: {r.frame: r.label for r in cl.hierarchical(p, df, linkage, **how).collect()}
    wanted = [(how, got(pairs, **how)) for how in ({"distance_threshold": 0.9}, {"distance_threshold": None, "n_clusters": 12})]
    monkeypatch.setattr(cl, "MAX_POINTS", 100)  # of points none is asked for
    for linked in (6_000, 60):
        monkeypatch.setattr(cl, "LINKED", linked)
        for how, want in wanted:
            assert got(space, **how) == want and 3 < len(set(want.values())) < 150


@pytest.mark.parametrize("metric", ["tanimoto", "cosine"])
def test_search_keeps_the_best_in_blocks(small_bits, metric, monkeypatch):
    rows, fps = small_bits
    fps = fps.union(fps.selectExpr("mol_id + 100", "fp"))  # copies: ties
    query = fps.filter("mol_id % 3 = 0")
    monkeypatch.setattr(fg, "SEARCH_ROWS", 16)
    monkeypatch.setattr(fg, "SEARCH_QUERIES", 10)
    monkeypatch.setattr(fg, "SEARCH_TILE", 4)
    found = fg.top_similar(query, fps, 64, 5, metric)
    assert "NestedLoop" not in found._jdf.queryExecution().toString()  # no row a pair
    every: dict[int, list] = {}
    for r in fg.bulk_similarity(query, fps, 64, metric).collect():
        every.setdefault(r.query_id, []).append((-r.similarity, r.mol_id))
    want = {(q, n + 1, m, -s) for q, own in every.items() for n, (s, m) in enumerate(sorted(own)[:5])}
    assert {(r.query_id, r["rank"], r.mol_id, r.similarity) for r in found.collect()} == want


def test_nearness_by_rmsd_is_that_of_the_distances():
    from orrery.operators.blocks import least_rmsd, within_rmsd

    rng = np.random.default_rng(8)
    v = rng.normal(size=(150, 21)) * 0.1
    v[3] = v[4]
    v[5] = np.tile(v[5, :3], 7)
    v[6] = (v[7].reshape(7, 3) * [1, 1, -1]).ravel()
    v[8] = np.repeat(rng.normal(size=7), 3)
    v[9:60] = v[60] + rng.normal(size=(51, 21)) * 0.02
    d = least_rmsd(v, v)
    for cutoff in (0.001, 0.02, 0.05, 0.13, d[0, 1] - 1e-9, d[9, 10] + 1e-9, 1.0):
        assert (within_rmsd(v, v, cutoff) == (d <= cutoff)).all()


def test_greedy_rounds_of_frames_count_on(spark, small_blocks, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(160, 5, 3)) * 0.1
    rows = [(i, k, *map(float, p)) for i, x in enumerate(v) for k, p in enumerate(x)]
    frames = spark.createDataFrame(rows, "frame long, atom int, x double, y double, z double").cache()
    points = frames.select("frame").distinct()
    expected = sorted(cl.gromos(cl.rmsd_pairs(frames), points, 0.1).collect())
    monkeypatch.setattr(cl, "LISTED", 5)
    assert sorted(cl.gromos(cl.frame_space(frames), points, 0.1).collect()) == expected  # all tried at once
    monkeypatch.setattr(cl, "TRIED", 12)
    monkeypatch.setattr(cl, "TRIED_BITS", 3_000)
    told = []
    of = cl.Space.counts_of
    monkeypatch.setattr(cl.Space, "counts_of", lambda self, *a: told.append(1) or of(self, *a))
    assert sorted(cl.gromos(cl.frame_space(frames), points, 0.1).collect()) == expected and told


def test_similarities_of_short_fingerprints_are_written_small(spark, tmp_path):
    """All pairs by blocks of equal numbers of bits: equal to brute force, and few bits a row in files."""
    rng = np.random.default_rng(11)
    ids = rng.permutation(6_000)[:2_500] - 700
    words = rng.integers(0, 2**63, 2_500) | (rng.integers(0, 2, 2_500) << 5)
    words[:40], words[40:60], ids[1] = 0, -1, ids[0]
    fps = spark.createDataFrame([(int(i), [int(w)]) for i, w in zip(ids, words, strict=True)] + [(None, [3])], "mol_id long, fp array<bigint>")
    path = f"{tmp_path}/pairs"
    fg.pair_similarities(fps, 64, "cosine", digits=6).write.parquet(path)
    got = spark.read.parquet(path).toPandas().sort_values(["i", "j", "similarity"]).to_numpy()
    w = words.astype(np.uint64)
    a, c = np.bitwise_count(w).astype(float), np.bitwise_count(w[:, None] & w[None, :]).astype(float)
    i, j = np.nonzero(ids[:, None] > ids[None, :])
    root = np.sqrt(a[i] * a[j])
    wanted = np.column_stack([ids[i], ids[j], np.round(np.divide(c[i, j], root, out=np.zeros(len(i)), where=root > 0), 6)])
    wanted = wanted[np.lexsort(wanted.T[::-1])]
    assert got.shape == wanted.shape and np.allclose(got, wanted, atol=1.1e-6, rtol=0)
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 2 * len(got)
    some = fg.pair_similarities(fps.select(F.col("mol_id").cast("int"), "fp"), 64, "tanimoto", cutoff=0.55)
    assert some.dtypes[:2] == [("i", "int"), ("j", "int")]
    t = np.divide(c[i, j], a[i] + a[j] - c[i, j], out=np.zeros(len(i)), where=a[i] + a[j] > 0)
    assert some.count() == int((t >= 0.55).sum()) > 0


def _kabsch(a, b):
    """The least RMSD by singular values."""
    a, b = (p.reshape(-1, 3) - p.reshape(-1, 3).mean(0) for p in (a, b))
    u, s, v = np.linalg.svd(a.T @ b)
    s[2] *= np.sign(np.linalg.det(u @ v)) or 1
    return math.sqrt(max(0.0, ((a**2).sum() + (b**2).sum() - 2 * s.sum()) / len(a)))


def test_symmetric_distances_are_measured_once(spark, tmp_path):
    """Both ways of a pair leave one pass over the blocks, equal to brute force; odd points raise."""
    from orrery.plans import catalogue, inputs  # noqa: F401 - the second registers the query

    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 64)).astype(np.float32)
    v[9], v[11], v[12] = v[3], -v[3], 0
    rows = spark.createDataFrame([(i * 3 - 100, x.tolist(), 0) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = catalogue.queries()["symmetric_distances"](spark, str(tmp_path))
    got = {(r.i, r.j): r.d for r in found.collect()}
    assert len(got) == found.count() == 300 * 299
    for i, j in [(3, 9), (9, 3), (3, 11), (11, 3), (12, 7), *rng.integers(0, 300, (200, 2)).tolist()]:
        if i != j:
            assert got[i * 3 - 100, j * 3 - 100] == pytest.approx(_kabsch(v[i, :63].astype(float), v[j, :63].astype(float)), abs=1e-4)
    assert found._jdf.queryExecution().sparkPlan().toString().count("FlatMapGroupsInArrow") == 1
    frames = catalogue.virtual_trajectory(spark, str(tmp_path))
    with pytest.raises(ValueError, match="finite"):
        cl.rmsd_both_ways(frames.withColumn("x", F.when((F.col("frame") == 2) & (F.col("atom") == 5), F.lit(float("nan"))).otherwise(F.col("x"))))
    with pytest.raises(ValueError, match="frames"):
        cl.rmsd_both_ways(frames.withColumn("frame", F.when(F.col("frame") != 2, F.col("frame"))))
    with pytest.raises(Exception, match="finite"):
        cl.rmsd_both_ways(frames.withColumn("x", F.when(F.col("frame") == 2, F.col("x") * 1e200).otherwise(F.col("x")))).count()
