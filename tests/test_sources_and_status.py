"""Text sources, preparation, fingerprints, clustering and job status on small inputs."""

import datetime as dt
import math
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import similarity as sim
from orrery.operators import clustering as cl
from orrery.operators import fingerprints as fp
from orrery.operators import prep, status
from orrery.sources import text
from orrery.streaming import events


def test_xvg(spark, tmp_path):
    path = tmp_path / "a.xvg"
    path.write_text('# made by hand\n@ title "Pull force"\n@ subtitle "of group two"\n@ xaxis label "t / ns"\n@ yaxis label "F"\n@ xaxis ticklabel "none"\n@TYPE xy\n 0 0.5\n 1.0  1e-1\n')
    df = text.read_xvg(spark, str(path))
    assert df.columns == ["t / ns", "F"] and [tuple(r) for r in df.orderBy("t / ns").collect()] == [(0.0, 0.5), (1.0, 0.1)]
    assert df.schema[0].metadata["title"] == "Pull force"
    path.write_text("1 2 3\n4 5 6\n")
    assert text.read_xvg(spark, str(path), "float32").dtypes == [("Time", "float"), ("col_1", "float"), ("col_2", "float")]
    path.write_text('@ s0 legend "A b"\n@ s1 legend "C"\n1 2 3\n')
    assert text.read_xvg(spark, str(path)).columns == ["Time", "A b", "C"]
    path.write_text("# nothing\n")
    with pytest.raises(ValueError):
        text.read_xvg(spark, str(path))


def test_pqr_box_and_types(spark, tmp_path):
    path = tmp_path / "a.pqr"
    path.write_text("REMARK x\nATOM 1 CA ALA 1 0.0 0.0 0.0 0.1 1.0\nATOM 2 HA ALA 1 10.0 0.0 0.0 0.1 1.0\nHETATM 3 CA ALA 2 0.0 10.0 20.0 0.1 1.0\nATOM 4 short\nEND\n")
    atoms = text.read_pqr(spark, str(path))
    assert atoms.count() == 3
    box = prep.bounding_box(atoms).first().asDict()
    assert (box["x_lo"], box["x_hi"], box["z_hi"], box["x_fine"], box["x_coarse"], box["z_mid"]) == (-1, 11, 21, 72, 112, 10)
    assert [tuple(r) for r in prep.heavy_atom_keys(atoms).collect()] == [("CA", "ALA")]
    contacts = ET.fromstring(prep.contact_types_xml(atoms, atoms))
    assert [x.tag for x in contacts.find("combinations")] == ["molecule0", "molecule1"]
    assert [(x.findtext("atom").strip(), x.findtext("residue").strip()) for x in contacts.iter("contact")] == [("CA", "ALA")] * 2
    sizes = spark.createDataFrame([(72.0,), (1.0,), (1e6,)], "l double").select("l", prep.grid_size(F.col("l"), 0.5).alias("s")).collect()
    for r in sizes:
        want = [s for s in prep.grid_sizes() if s >= math.ceil(r["l"] / 0.5) + 1] or [prep.grid_sizes()[-1]]
        assert r["s"] == want[0]
    lines = [x.split() for x in prep.solver_input("m", box).splitlines()]
    told = {x[0]: x[1:] for x in lines if x[0] not in ("mol", "ion")}
    # 72, 72 and 82 angstrom by 0.75 need 97, 97 and 111 points or more.
    assert told["dime"] == ["97", "97", "129"] and told["fglen"] == ["72.0000", "72.0000", "82.0000"] and told["cgcent"] == ["5.0000", "5.0000", "10.0000"]
    assert [x[1:] for x in lines if x[0] == "ion"] == [["charge", "-1.00", "conc", "0.1500", "radius", "1.8150"], ["charge", "1.00", "conc", "0.1500", "radius", "1.8750"]]
    assert told["pdie"] == ["2.0000"] and told["calcenergy"] == ["total"] and told["print"] == ["elecEnergy", "1", "end"] and told["write"] == ["pot", "dx", "m"]
    assert open(prep.write_text("x\n", f"{tmp_path}/m.in")).read() == "x\n"
    top = ET.fromstring(prep.dynamics_xml(prep.Run((prep.Body("a&b", "a.xml", ("a.dx",)), prep.Body("c", "c.xml", is_protein=False)), prep.Solvent(7.8))))
    word = lambda path: top.findtext(path).strip()
    assert word("system/group/core/name") == "a&b" and word("system/solvent/debye_length") == "7.8" and word("system/solvent/desolvation_parameter") == "1.0"
    assert (word("max_n_steps"), word("n_trajectories_per_output"), word("n_steps_per_output"), word("trajectory_file")) == ("1000000", "10", "10", "trajectory")
    assert word("system/time_step_tolerances/minimum_core_reaction_dt") == "0.0" and [x.text.strip() for x in top.iter("is_protein")] == ["true", "false"]
    assert len(list(top.iter("electric_field"))) == 1 and word("system/solvent/solvent_radius") == "1.4"
    path.write_text("END\n")
    with pytest.raises(ValueError):
        text.read_pqr(spark, str(path))


def test_debye_length(spark, tmp_path):
    (tmp_path / "a.log").write_text("grid done\nDebye length: 7.625\n")
    (tmp_path / "b.log").write_text("got debye length 3.5\n")
    (tmp_path / "c.log").write_text("solver stopped\n")
    a, b, c = (str(tmp_path / f"{x}.log") for x in "abc")
    assert text.infer_debye_length(spark, a, b) == 7.625 and text.infer_debye_length(spark, str(tmp_path / "none.log"), c, b, a) == 3.5
    with pytest.raises(RuntimeError):
        text.infer_debye_length(spark, c)


def test_molecules(spark, tmp_path):
    (tmp_path / "m.smi").write_text("CC(=O)O vinegar\nC((C unbalanced\nC1CCNCC1 ring of six\n\n")
    got = {r["name"]: r["smiles"] for r in text.read_molecules(spark, f"{tmp_path}/m.smi").collect()}
    assert got == {"vinegar": "CC(=O)O", "ring of six": "C1CCNCC1"}
    (tmp_path / "m.sdf").write_text("one\n x\n\n 0 0\nM  END\n> <ID>\n7\n\n> <N>\nabc\n\n$$$$\nbroken\n$$$$\n")
    row = text.read_molecules(spark, f"{tmp_path}/m.sdf").collect()
    assert len(row) == 1 and row[0]["name"] == "one" and row[0]["fields"] == {"ID": "7", "N": "abc"}
    for path, several in (("a.mol2", False), ("a.mae", True)):
        with pytest.raises(TypeError):
            text.read_molecules(spark, path, several)


def test_results_and_directories(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"uncertainty": {"magnitude": 0.75}, "estimate": {"magnitude": -6.5}}')
    (tmp_path / "r" / "b.json").write_text('{"estimate": null, "uncertainty": null}')
    (tmp_path / "r" / "c.json").write_text("{broken")
    got = {r["path"][-6:]: (r["est"], r["unc"]) for r in text.read_results(spark, f"{tmp_path}/r").collect()}
    assert got == {"a.json": (-6.5, 0.75), "b.json": (None, None), "c.json": (None, None)}
    for d in ("x/1", "x/2"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "p.tpr").write_text("x")
    assert [r["workdir"][-3:] for r in text.find_directories(spark, f"{tmp_path}/x").collect()] == ["x/1", "x/2"]
    dumps = spark.createDataFrame([("   init-t = 5\n   nsteps = 1000\n   delta-t = 0.002\n",), ("nsteps = -1\ndt = 1",)], "d string")
    assert [r[0] for r in dumps.select(text.target_time(F.col("d"))).collect()] == [7.0, float("inf")]
    lines = spark.createDataFrame([(1, 1, "percent_complete: 10"), (2, 1, "percent_complete: 40.5"), (2, 2, "percent_complete: 41"), (2, 3, "x")], "mtime int, line_no int, value string")
    assert text.last_progress(lines).first()["percent"] == 41
    (tmp_path / "q").write_text("12|RUNNING|/a\n")
    assert tuple(text.read_queue(spark, f"{tmp_path}/q").first()) == ("12", "RUNNING", "/a")


def test_protonation(spark):
    rows = [("GLU", 12, "A", 8.1, 4.4), ("LYS", 31, "B", 5.5, 10.4), ("HIS", 40, "A", 7.9, 6.6), ("CYS", 77, "B", 6.2, 9.1), ("N+", 1, "A", 9.5, 7.9)]
    res = spark.createDataFrame(rows, "residue_type string, res_num int, chain_id string, pka double, model_pka double")
    got = {r["residue_type"]: r["v"] for r in prep.nonstandard(res, 7.0).select("residue_type", prep.variant_name(7.0).alias("v"), prep.residue_label()).collect()}
    assert got == {"GLU": "GLH", "LYS": "LYN", "HIS": "HIP", "CYS": "CYX"}
    top = spark.createDataFrame([("A", 12, "GLU"), ("A", 13, "GLY")], "chain_id string, res_num int, resname string")
    assert {r["res_num"]: r["variant"] for r in prep.protonation_variants(top, res).collect()} == {12: "GLH", 13: None}
    assert prep.unmatched_overrides(top, res).count() == 3


def bits(on, n=64):
    return [i in on for i in range(n)]


def test_similarities(spark):
    a, b = {0, 1, 2, 63}, {1, 2, 3, 4, 5}
    rows = spark.createDataFrame([(0, bits(a)), (1, bits(b)), (2, bits(set()))], "mol_id long, b array<boolean>").select("mol_id", fp.pack_bits(F.col("b"), 64).alias("fp"))
    c, na, nb, n = 2, 4, 5, 64
    want = {"tanimoto": c / 7, "dice": 4 / 9, "cosine": c / math.sqrt(20), "sokal": c / 12, "russel": c / n, "rogotgoldberg": c / 9 + 57 / (128 - 9), "allbit": (c + 57) / n, "kulczynski": (c / na + c / nb) / 2, "mcconnaughey": (c * 9 - 20) / 20, "asymmetric": c / 4, "braunblanquet": c / 5}
    assert want.keys() == sim.METRICS.keys()
    for metric, value in want.items():
        got = {(r["i"], r["j"]): r["similarity"] for r in fp.pair_similarities(rows, 64, metric.upper()).collect()}
        assert got[1, 0] == pytest.approx(value), metric
        assert len(got) == 3 and all(math.isfinite(v) for v in got.values())
    assert fp.top_similar(rows.filter("mol_id = 0"), rows, 64, 2).orderBy("rank").first()["mol_id"] == 0
    for bad in (lambda: fp.cluster(rows, 64, 0.5, "russel"), lambda: fp.cluster(rows, 64, 0.5, "x"), lambda: fp.check_kind("x"), lambda: fp.top_similar(rows, rows, 64, 0)):
        with pytest.raises(ValueError):
            bad()
    assert fp.check_kind("ECFP4") == "ecfp4"
    groups = fp.cluster(rows, 64, 0.2).collect()
    assert {r["mol_id"]: (r["cluster_id"], r["size"]) for r in groups} == {0: (0, 2), 1: (0, 2), 2: (1, 1)}
    assert fp.within_ranges(rows, {}).count() == 3 and fp.within_ranges(rows, {"mol_id": (1, 2)}).count() == 2


@pytest.fixture(scope="module")
def six(spark):
    rows = [(i, j, 0.1 if (i < 3) == (j < 3) and (i < 5) == (j < 5) else 0.5) for i in range(6) for j in range(i + 1, 6)]
    return spark.createDataFrame(rows, "i long, j long, d double"), spark.range(6).select(F.col("id").alias("frame"))


def labels(df):
    return {r["frame"]: r["label"] for r in df.collect()}


def test_clusterings(spark, six):
    pairs, points = six
    g = cl.gromos(pairs, points, 0.15)
    assert labels(g) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2} and {r["frame"] for r in g.filter("is_medoid").collect()} == {0, 3, 5}
    assert labels(cl.dbscan(pairs, points, 0.15, 1)) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
    assert labels(cl.dbscan(pairs, points, 0.15, 2)) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: -1}
    assert set(labels(cl.dbscan(pairs, points, 0.001, 10)).values()) == {-1}
    for linkage in ("single", "average", "complete"):
        assert labels(cl.hierarchical(pairs, points, linkage, 0.15)) == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 2}
        assert len(set(labels(cl.hierarchical(pairs, points, linkage, None, 2)).values())) == 2
    assert [tuple(r) for r in cl.populations(g).collect()] == [(0, 3), (1, 2), (2, 1)]
    assert {r["label"]: (r["medoid_frame"], r["size"]) for r in cl.medoids(pairs, g).collect()} == {0: (0, 3), 1: (3, 2), 2: (5, 1)}
    assert cl.gromos(pairs.limit(0), points.limit(0)).count() == 0
    cl.check_distances(pairs, 6)
    for bad in (lambda: cl.gromos(pairs, points, 0), lambda: cl.check_distances(pairs, 7), lambda: cl.check_distances(pairs.withColumn("d", F.lit(float("nan")))), lambda: cl.hierarchical(pairs, points, "x"), lambda: cl.dbscan(pairs, points, 0)):
        with pytest.raises(ValueError):
            bad()


def test_greedy_against_its_definition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    near = d <= 0.6
    left, want, k = set(range(60)), {}, 0
    while left:
        best = max(sorted(left), key=lambda i: sum(near[i, j] for j in left))
        members = [j for j in left if near[best, j]]
        want.update(dict.fromkeys(members, k))
        left -= set(members)
        k += 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame long, features array<double>")
    pairs = cl.feature_pairs(df, 0.6)
    assert labels(cl.gromos(pairs, df, 0.6)) == want
    core = near.sum(1) >= 5
    found = labels(cl.dbscan(pairs, df, 0.6, 5))
    assert {i for i in range(60) if found[i] < 0} == {i for i in range(60) if not core[near[i]].any()}


def test_density_tree(spark):
    rng = np.random.default_rng(6)
    x = np.vstack([rng.normal(c, 0.2, size=(25, 2)) for c in ((0, 0), (5, 5), (9, 0))] + [[[20.0, 20.0]]])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame long, features array<double>")
    got = labels(cl.hdbscan(cl.feature_pairs(df), df))
    groups = [{got[i] for i in range(25 * k, 25 * k + 25)} - {-1} for k in range(3)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 3 and got[75] == -1


def test_centres(spark):
    rng = np.random.default_rng(7)
    x = np.vstack([rng.normal(c, 0.3, size=(20, 2)) for c in ((0, 0), (5, 5), (10, 0))])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "frame long, features array<double>")
    for method in (cl.kmeans, cl.mini_batch_kmeans):
        assigned, centres = method(df, 3)
        own = labels(assigned)
        assert [len({own[i] for i in range(20 * k, 20 * k + 20)}) for k in range(3)] == [1, 1, 1]
        assert cl.inertia(assigned).first()["inertia"] < 25 and cl.feature_medoids(df, centres, assigned).count() == 3
    assigned, centres = cl.regular_space(df, 2.5)
    assert centres.count() == 3 and assigned.filter("d2 > 6.25").count() == 0
    for bad in (lambda: cl.kmeans(df, 0), lambda: cl.kmeans(df, 99), lambda: cl.regular_space(df, 0), lambda: cl.regular_space(df, 2.5, max_centres=2)):
        with pytest.raises(ValueError):
            bad()


def test_simulation_status(spark):
    sims = spark.createDataFrame([("a", 100.0, 100.0), ("b", 100.0, 5.0), ("c", 100.0, None), ("d", None, 1.0), ("e", 100.0, 1.0), ("f", float("inf"), 9e9)], "workdir string, target_ps double, current_ps double")
    jobs = spark.createDataFrame([("2", "R", "b"), ("1", "R", "b"), ("3", "PD", "c")], "job_id string, state string, workdir string")
    out = status.simulation_status(sims, jobs)
    assert {r["workdir"]: r["status"] for r in out.collect()} == {"a": "completed", "b": "error", "c": "active", "d": "error", "e": "failed", "f": "failed"}
    assert out.filter("workdir = 'b'").first()["job_ids"] == "1,2"
    assert status.simulation_status(sims, jobs, 4.0).filter("workdir = 'b'").first()["status"] == "completed"
    counts = status.status_counts(out.withColumn("workdir", F.lit("all")))
    total = counts.filter("workdir is null").first()
    assert (total["total"], total["completed"], total["failed"]) == (6, 1, 2)
    assert not status.fleet_report(counts).first()["done"] and not status.fleet_report(counts.limit(0)).first()["done"]
    done = status.status_counts(out.filter("status = 'completed'"))
    assert status.fleet_report(done).first()["done"] and status.fleet_report(done, False).first()["done"]
    assert status.restart_listing(out).count() == 2


def test_replicas(spark):
    reps = spark.createDataFrame([("t", 0, 1.0, 0.1), ("t", 1, None, None), ("t", 2, None, None), ("t", 3, 1.0, None), ("t", 4, None, None)], "transform string, replica long, est double, unc double")
    jobs = spark.createDataFrame([("t", 1), ("t", 4), ("t", 4)], "transform string, replica long")
    attempts = spark.createDataFrame([("t", 2, 1, 1), ("t", 2, 5, 2), ("t", 3, 9, 1), ("t", 3, 2, 5)], "transform string, replica long, n int, line_no int")
    out = status.replica_status(reps, jobs, attempts)
    assert {r["replica"]: r["status"] for r in out.collect()} == {0: "completed", 1: "active", 2: "abandoned", 3: "failed", 4: "error"}
    assert [tuple(r) for r in status.restart_groups(out).collect()] == [("t", "3")]
    churn = spark.createDataFrame([("t", 2)], "transform string, replica long")
    assert status.replica_status(reps, jobs, attempts, churn).filter("replica = 2").first()["status"] == "failed"


def test_queue(spark):
    now = dt.datetime(2024, 1, 1, 12, 0)
    queue = spark.createDataFrame([("7", "1", "R", "w")], "array_job_id string, task_id string, state string, workdir string")
    gone = spark.createDataFrame([("7", "1", "w", now), ("7", "2", "w", now), ("7", "2", "w", now), ("7", "3", "w", now - dt.timedelta(minutes=21)), ("7", "4.batch", "w", now), ("8", None, "w", now)], "array_job_id string, task_id string, workdir string, ts timestamp")
    out = status.with_preempted(queue, gone, F.lit(now))
    assert sorted((r["task_id"], r["state"]) for r in out.collect()) == [("1", "R"), ("2", "REQUEUING")]
    arrays = spark.createDataFrame([("7", "x")], "array_job_id string, transform string")
    assert [r["transform"] for r in status.resolve_transforms(queue.unionByName(queue.withColumn("array_job_id", F.lit("9"))), arrays).orderBy("array_job_id").collect()] == ["x", "__UNKNOWN__"]
    dirs = spark.createDataFrame([("x", "1"), ("x", "a"), ("y", "2")], "transform string, replica string")
    active = spark.createDataFrame([("x", "1"), ("x", "3")], "transform string, replica string")
    assert [tuple(r) for r in status.enumerate_work(dirs, active, arrays).collect()] == [("x", 1), ("x", 3)]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i % 5, i), "a" if i % 2 else "b", float(i)) for i in range(50)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double").write.parquet(f"{tmp_path}/e")
    q = events.windowed_means(events.stream_events(spark, f"{tmp_path}/e")).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    batch = events.windowed_means(spark.read.parquet(f"{tmp_path}/e"))
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, batch.collect()))


def test_last_progress_of_equal_lines(spark, tmp_path):
    """Rows of the same key: the first of the table, as one thread of the SQL's arg_max tells."""
    import duckdb
    import pandas as pd

    from orrery.plans import catalogue, inputs  # noqa: F401 - the second registers the query

    n = 2_000
    rows = pd.DataFrame({"l_orderkey": [i % 97 for i in range(n)], "l_linenumber": pd.array([1 + i % 7 for i in range(n)], "int32"), "l_quantity": [float(i % 50) for i in range(n)]})
    for at, quantity in ((300, -11.5), (301, 22.0), (900, 33.0), (1_999, 44.0)):
        rows.loc[at, ["l_orderkey", "l_linenumber", "l_quantity"]] = [97, 3, quantity]
    rows.to_parquet(tmp_path / "lineitem.parquet", row_group_size=250)
    with duckdb.connect(config={"threads": 1}) as c:
        c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
        told = c.execute(catalogue.oracle_sql()["last_progress"]).fetchall()
    assert [tuple(r) for r in catalogue.queries()["last_progress"](spark, str(tmp_path)).collect()] == told == [(-11.5,)]
