"""More registered queries: files written from the tables and read back, topologies, cells, bonds.

The files go to the session's scratch folder, so a query reads what its source would
read in earnest. Tables stand for trajectories as in the catalogue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import clustering as cl
from orrery.operators import decomposition as dc
from orrery.operators import distance as ds
from orrery.operators import frames, metrics, status, surface
from orrery.functions.dtype import as_dtype
from orrery.plans.catalogue import COLUMNS, FT, JOBS, PAIR_RMSD, RMSD, VT, _status, features, query, table, virtual_atoms, virtual_trajectory
from orrery.session import scratch_path
from orrery.sources import binary, text, trajectory


def _lines(df: DataFrame, label: str) -> str:
    """Writes a column of lines to files and gives their folder."""
    path = scratch_path(df.sparkSession, label)
    df.write.text(path)
    return path


@query("trajectory_load", f"WITH {VT} SELECT frame, atom, x, y, z FROM vt WHERE frame >= 20 AND frame < 300 AND (frame-20)%3 = 0 AND atom%3 = 1")
def _load(spark, d):
    path = scratch_path(spark, "trajectory")
    trajectory.write_trajectory(virtual_trajectory(spark, d), path)
    return trajectory.load_trajectory(spark, path, virtual_atoms(spark), 20, 300, 3, "name CA").select("frame", "atom", "x", "y", "z")


@query("trajectories_load", f"""WITH {VT} SELECT CAST(0 AS INTEGER) AS traj_id, frame, atom, x FROM vt WHERE replica < 5 AND frame%2 = 0
UNION ALL SELECT 1, frame, atom, x FROM vt WHERE replica >= 5 AND frame%2 = 0""")
def _loads(spark, d):
    vt, paths = virtual_trajectory(spark, d), []
    for part in ("replica < 5", "replica >= 5"):
        paths.append(scratch_path(spark, "trajectory"))
        trajectory.write_trajectory(vt.filter(part), paths[-1])
    return trajectory.load_trajectories(spark, paths, stride=2).select("traj_id", "frame", "atom", "x")


@query("xvg_read", "SELECT CAST(event_id AS DOUBLE) AS t, value, CAST(user_id AS DOUBLE) AS who FROM events WHERE value IS NOT NULL")
def _xvg(spark, d):
    rows = table(spark, d, "events").filter("value is not null")
    head = spark.createDataFrame([("# made from events",), ('@ xaxis label "t"',), ('@ s0 legend "value"',), ('@ s1 legend "who"',)], "line string")
    return text.read_xvg(spark, _lines(head.union(rows.select(F.concat_ws("  ", "event_id", "value", "user_id"))), "xvg"))


@query("pqr_read", """SELECT 'B' || substr(p_brand, 7) AS atom, upper(p_type) AS residue, CAST(p_partkey AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y, p_retailprice AS z,
CAST(-0.5 AS DOUBLE) AS charge, CAST(1.5 AS DOUBLE) AS radius FROM part""")
def _pqr(spark, d):
    rows = table(spark, d, "part")
    line = F.concat_ws("  ", F.lit("ATOM"), "p_partkey", F.concat(F.lit("B"), F.substring("p_brand", 7, 9)), F.upper(F.regexp_replace("p_type", " ", "_")), F.lit("1"), "p_partkey", "p_size", "p_retailprice", F.lit("-0.5"), F.lit("1.5"))
    lines = rows.select(line.alias("line")).union(spark.createDataFrame([("REMARK made from parts",), ("END",)], "line string"))
    out = text.read_pqr(spark, _lines(lines, "pqr"))
    return out.select("atom", F.regexp_replace("residue", "_", " ").alias("residue"), "x", "y", "z", "charge", "radius")


SMILES = ("CCO", "c1ccccc1O", "CC(=O)N", "C((C", "[NH4+]", "ClCCBr", "not/a,smiles")


@query("smiles_read", f"SELECT p_name || ' ' || p_partkey AS name, s[p_partkey%7+1] AS smiles FROM part, (SELECT {list(SMILES)} AS s) WHERE p_partkey%7 NOT IN (3, 6)")
def _smiles(spark, d):
    kind = F.get(F.array(*[F.lit(s) for s in SMILES]), (F.col("p_partkey") % 7).cast("int"))
    path = scratch_path(spark, "molecules") + ".smi"
    table(spark, d, "part").select(F.concat_ws(" ", kind, "p_name", "p_partkey")).write.text(path)
    return text.read_molecules(spark, path).select("name", "smiles")


@query("sdf_read", "SELECT p_name AS name, CAST(p_size AS VARCHAR) AS size, CAST(p_partkey AS VARCHAR) AS id FROM part WHERE p_partkey%5 <> 0")
def _sdf(spark, d):
    end = F.when(F.col("p_partkey") % 5 != 0, F.lit("M  END\n")).otherwise(F.lit(""))
    block = F.concat(F.col("p_name"), F.lit("\n  made\n\n  0  0\n"), end, F.lit("> <SIZE>\n"), F.col("p_size"), F.lit("\n\n> <ID>\n"), F.col("p_partkey"), F.lit("\n\n$$$$"))
    path = scratch_path(spark, "molecules") + ".sdf"
    table(spark, d, "part").select(block).write.text(path)
    out = text.read_molecules(spark, path)
    return out.select("name", F.col("fields")["SIZE"].alias("size"), F.col("fields")["ID"].alias("id"))


@query("results_read", "SELECT n_nationkey AS nation, CASE WHEN n_nationkey%4 > 0 THEN -n_regionkey-0.5::DOUBLE END AS est, CASE WHEN n_nationkey%4 > 0 THEN 0.25::DOUBLE END AS unc FROM nation")
def _results(spark, d):
    told = F.when(F.col("n_nationkey") % 4 == 0, F.lit('{"estimate": null}')).otherwise(F.concat(F.lit('{"estimate": {"magnitude": '), -F.col("n_regionkey") - 0.5, F.lit('}, "uncertainty": {"magnitude": 0.25}}')))
    path = scratch_path(spark, "results")
    # One file a nation; a result is a file.
    table(spark, d, "nation").select(told.alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    out = text.read_results(spark, f"{path}/*/*.txt")
    return out.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("nation"), "est", "unc")


@query("queue_read", "SELECT CAST(o_orderkey AS VARCHAR) AS job_id, o_orderstatus AS state, '/run/' || o_custkey AS workdir FROM orders")
def _queue(spark, d):
    line = F.concat_ws("|", "o_orderkey", "o_orderstatus", F.concat(F.lit("/run/"), "o_custkey"))
    return text.read_queue(spark, _lines(table(spark, d, "orders").select(line), "queue"))


@query("directories_found", "SELECT DISTINCT 'n_regionkey=' || n_regionkey AS name FROM nation")
def _directories(spark, d):
    path = scratch_path(spark, "directories")
    table(spark, d, "nation").select("n_name", "n_regionkey").write.partitionBy("n_regionkey").text(path)
    found = text.find_directories(spark, path, "*.txt")
    return found.select(F.substring_index("workdir", "/", -1).alias("name"))


@query("target_times", "SELECT c_custkey, CASE WHEN c_nationkey = 0 THEN 'infinity'::DOUBLE ELSE CASE WHEN c_custkey%2 = 0 THEN c_custkey ELSE 0 END + c_nationkey*0.25::DOUBLE END AS target_ps FROM customer")
def _targets(spark, d):
    steps = F.when(F.col("c_nationkey") == 0, F.lit(-1)).otherwise(F.col("c_nationkey"))
    start = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("   init-t = "), "c_custkey", F.lit("\n"))).otherwise("")
    dump = F.concat(start, F.lit("   nsteps = "), steps, F.lit("\n   delta-t = 0.25\n"))
    return table(spark, d, "customer").select("c_custkey", text.target_time(dump).alias("target_ps"))


@query("last_progress", "SELECT arg_max(l_quantity, l_orderkey*10+l_linenumber) AS percent FROM lineitem WHERE l_linenumber < 4")
def _progress(spark, d):
    told = F.when(F.col("l_linenumber") < 4, F.concat(F.lit("percent_complete: "), "l_quantity")).otherwise("still at work")
    # Several lines have the same key: the first of the table tells, as it does for one thread of arg_max.
    key = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    line = F.pmod(key, F.lit(10))
    lines = table(spark, d, "lineitem").select((key - line).alias("mtime"), line.alias("line_no"), told.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return text.last_progress(lines, ["file", "row"])


@query("tsv_written", "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def _tsv(spark, d):
    path = scratch_path(spark, "status")
    status.write_tsv(table(spark, d, "nation"), path)
    return spark.read.csv(path, sep="\t", header=True)


KINDS = ("ALA", "HOH", "NA", "SOL", "GLY", "CL")
TOPOLOGY = f"top AS (SELECT p_partkey AS atom, k[p_partkey%6+1] AS resname, CAST(p_size%4 AS INTEGER) AS chain, chr(CAST(65+p_size%4 AS INTEGER)) AS chain_id FROM part, (SELECT {list(KINDS)} AS k))"


def _topology(spark, d):
    chain = F.col("p_size") % 4
    kind = F.get(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % 6).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("atom"), kind.alias("resname"), chain.cast("int").alias("chain"), F.chr(F.lit(65) + chain).alias("chain_id"))


@query("strip_solvent", f"WITH {TOPOLOGY} SELECT atom, resname FROM top WHERE resname IN ('ALA', 'GLY')")
def _strip(spark, d):
    return frames.strip_solvent(_topology(spark, d)).select("atom", "resname")


@query("strip_water_only", f"WITH {TOPOLOGY} SELECT atom, resname FROM top WHERE resname NOT IN ('HOH', 'SOL')")
def _strip_water(spark, d):
    return frames.strip_solvent(_topology(spark, d), keep_ions=True).select("atom", "resname")


@query("extract_chain", f"WITH {TOPOLOGY} SELECT atom, chain FROM top WHERE chain = 2")
def _chain(spark, d):
    return frames.extract_chain(_topology(spark, d), 2).select("atom", "chain")


@query("chain_letters", f"WITH {TOPOLOGY} SELECT atom, chain_id FROM top WHERE chain_id IN ('A', 'D')")
def _letters(spark, d):
    return frames.of_chains(_topology(spark, d), ["A", "D"]).select("atom", "chain_id")


@query("atom_select_compared", f"WITH {VT} SELECT frame, atom FROM vt WHERE atom//3 < 5 AND atom >= 4 AND NOT (atom%3 = 0) AND atom <> 7 OR atom = 20")
def _compared(spark, d):
    chosen = "resid < 5 and index >= 4 and not element == N and index != 7 or (resSeq 7 and name != N CA)"
    return frames.of_selection(virtual_trajectory(spark, d), virtual_atoms(spark), chosen).select("frame", "atom")


@query("minimum_image_distances", f"""WITH {VT}, e AS (SELECT a.frame, a.atom AS i, b.atom AS j, a.x-b.x AS x, a.y-b.y AS y, a.z-b.z AS z FROM vt a JOIN vt b ON a.frame = b.frame AND b.atom = a.atom + 5)
SELECT frame, i, j, round(sqrt((x-0.3*round_even(x/0.3,0))^2+(y-0.4*round_even(y/0.4,0))^2+(z-0.5*round_even(z/0.5,0))^2),6) AS distance_nm FROM e""")
def _images(spark, d):
    boxed = virtual_trajectory(spark, d).withColumns({"box_x": F.lit(0.3), "box_y": F.lit(0.4), "box_z": F.lit(0.5)})
    pairs = spark.range(16).select(F.col("id").cast("int").alias("i"), (F.col("id") + 5).cast("int").alias("j"))
    return ds.pair_distances(boxed, pairs).select("frame", "i", "j", F.round("distance_nm", 6).alias("distance_nm"))


# Each residue of the virtual trajectory is a donor, its hydrogen and an acceptor; the cell has 0.6 nm.
BONDS = f"""WITH {VT}, q AS (SELECT n.frame, n.atom AS d, h.atom AS h, o.atom AS a, n.x-h.x AS ux, n.y-h.y AS uy, n.z-h.z AS uz, o.x-h.x AS vx, o.y-h.y AS vy, o.z-h.z AS vz
  FROM vt n JOIN vt h ON h.frame = n.frame AND n.atom%3 = 0 AND h.atom = n.atom+1 JOIN vt o ON o.frame = n.frame AND o.atom%3 <> 1 AND o.atom <> n.atom),
w AS (SELECT frame, d, h, a, ux-0.6*round_even(ux/0.6,0) AS ux, uy-0.6*round_even(uy/0.6,0) AS uy, uz-0.6*round_even(uz/0.6,0) AS uz,
  vx-0.6*round_even(vx/0.6,0) AS vx, vy-0.6*round_even(vy/0.6,0) AS vy, vz-0.6*round_even(vz/0.6,0) AS vz FROM q),
g AS (SELECT frame, d, h, a, sqrt(vx*vx+vy*vy+vz*vz) AS r, degrees(acos(greatest(-1.0, least(1.0, (ux*vx+uy*vy+uz*vz)/(sqrt(ux*ux+uy*uy+uz*uz)*sqrt(vx*vx+vy*vy+vz*vz)))))) AS deg FROM w),
k AS (SELECT d, h, a FROM g GROUP BY d, h, a HAVING avg(CASE WHEN r < 0.25 AND deg > 120 THEN 1.0 ELSE 0.0 END) > 0.06),
p AS (SELECT frame, d, h, a, r <= 0.22 AND deg >= 125 AS present FROM g JOIN k USING (d, h, a))"""


def _bond_presence(spark, d):
    boxed = virtual_trajectory(spark, d).withColumns({c: F.lit(0.6) for c in ds.BOX})
    atoms = virtual_atoms(spark).withColumns({c: F.get(F.array(F.lit("N"), F.lit("H"), F.lit("O")), F.col("atom") % 3) for c in ("name", "element")})
    bonds = atoms.filter("element = 'N'").select(F.col("atom").alias("a"), (F.col("atom") + 1).alias("b"))
    return boxed, atoms, ds.hydrogen_bonds(boxed, atoms, bonds, "baker_hubbard", 0.06, 0.22, 125.0)


@query("hydrogen_bond_counts", f"{BONDS} SELECT f.frame, count(p.d) AS n FROM (SELECT DISTINCT frame FROM vt) f LEFT JOIN p ON p.frame = f.frame AND p.present GROUP BY f.frame")
def _bond_counts(spark, d):
    boxed, _, presence = _bond_presence(spark, d)
    return ds.bond_counts(presence, boxed)


@query("hydrogen_bond_labels", f"""{BONDS} SELECT d, h, a, round(avg(CASE WHEN present THEN 1.0 ELSE 0.0 END),6) AS occupancy,
'ALA' || (d//3+1) || ':N-H ... ALA' || (a//3+1) || ':' || CASE WHEN a%3 = 0 THEN 'N' ELSE 'O' END AS label FROM p GROUP BY d, h, a""")
def _bond_labels(spark, d):
    _, atoms, presence = _bond_presence(spark, d)
    occupancy = ds.bond_occupancy(presence).select("d", "h", "a", F.round("occupancy", 6).alias("occupancy"))
    return ds.bond_labels(occupancy, atoms)


@query("hydrogen_bonds_cone", f"""WITH {VT}, q AS (SELECT n.frame, n.atom AS d, h.atom AS h, o.atom AS a, h.x-n.x AS ux, h.y-n.y AS uy, h.z-n.z AS uz, o.x-n.x AS vx, o.y-n.y AS vy, o.z-n.z AS vz
  FROM vt n JOIN vt h ON h.frame = n.frame AND n.atom%3 = 0 AND h.atom = n.atom+1 JOIN vt o ON o.frame = n.frame AND o.atom%3 <> 1 AND o.atom <> n.atom),
g AS (SELECT frame, d, h, a, sqrt(vx*vx+vy*vy+vz*vz) AS r, degrees(acos(greatest(-1.0, least(1.0, (ux*vx+uy*vy+uz*vz)/(sqrt(ux*ux+uy*uy+uz*uz)*sqrt(vx*vx+vy*vy+vz*vz)))))) AS deg FROM q)
SELECT frame, d, h, a FROM g WHERE r < 0.33 - 0.000044*deg*deg""")
def _cone(spark, d):
    vt = virtual_trajectory(spark, d)
    atoms = virtual_atoms(spark).withColumns({c: F.get(F.array(F.lit("N"), F.lit("H"), F.lit("O")), F.col("atom") % 3) for c in ("name", "element")})
    bonds = atoms.filter("element = 'N'").select(F.col("atom").alias("a"), (F.col("atom") + 1).alias("b"))
    return ds.hydrogen_bonds(vt, atoms, bonds, "wernet_nilsson").filter("present").select("frame", "d", "h", "a")


@query("aligned_residual", f"{RMSD} SELECT frame, round(sqrt(greatest(0.0,(ga+gb-2*l)/n)),4) AS rmsd_nm FROM l UNION ALL SELECT 0 AS frame, 0.0::DOUBLE AS rmsd_nm")
def _residual(spark, d):
    """What is left after the alignment is the least RMSD there is."""
    moved = frames.align(virtual_trajectory(spark, d), virtual_atoms(spark), "all")
    fixed = moved.filter("frame = 0").select("atom", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    square = sum(((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in "xyz"), F.lit(0.0))
    return moved.join(fixed, "atom").groupBy("frame").agg(F.round(F.sqrt(F.avg(square)), 4).alias("rmsd_nm"))


SCALED = f"""WITH {FT}, w AS (SELECT frame, unnest(range(64)) AS k, unnest(v) AS x FROM ft), m AS (SELECT k, avg(x) AS m, stddev_pop(x) AS s FROM w GROUP BY k),
z AS (SELECT frame, k, (x-m)/s AS z FROM w JOIN m USING (k))"""


@query("pca_norms", f"{SCALED} SELECT frame, round(sum(z*z),4) AS norm2 FROM z GROUP BY frame")
def _norms(spark, d):
    """All components together are a rotation, so they keep each scaled row's length."""
    rows = features(spark, d).select("frame", "features")
    square = F.aggregate("features", F.lit(0.0), lambda s, x: s + x * x)
    return dc.project(rows, dc.fit_pca(rows, 64)).select("frame", F.round(square, 4).alias("norm2"))


@query("pca_spectrum", f"""{SCALED}, c AS (SELECT a.k AS i, b.k AS j, avg(a.z*b.z) AS c FROM z a JOIN z b ON a.frame = b.frame GROUP BY 1, 2),
s AS (SELECT a.i, b.j, sum(a.c*b.c) AS c FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2)
SELECT CAST(64 AS BIGINT) AS n, round(sum(c.c*c.c)/4096,8) AS squares, round(sum(c.c*s.c)/262144,9) AS cubes, round(sum(s.c*s.c)/16777216,10) AS fourths FROM c JOIN s ON s.i = c.i AND s.j = c.j""")
def _spectrum(spark, d):
    """The shares' power sums are traces of the correlation matrix's powers."""
    shares = dc.explained_variance(dc.fit_pca(features(spark, d), 64), spark)
    r = F.col("ratio")
    return shares.agg(F.count("*").alias("n"), F.round(F.sum(r * r), 8).alias("squares"), F.round(F.sum(r * r * r), 9).alias("cubes"), F.round(F.sum(r * r * r * r), 10).alias("fourths"))


@query("unit_values_summed", "SELECT l_orderkey AS frame, round(sum(l_quantity),4) AS value_nm2 FROM lineitem GROUP BY 1")
def _units(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("unit_id"), F.col("l_quantity").alias("value_nm2"))
    return metrics.aggregate_units(rows, "sum").select("frame", F.round("value_nm2", 4).alias("value_nm2"))


@query("symmetric_distances", f"{PAIR_RMSD}, o AS (SELECT i0 AS i, j0 AS j, round(sqrt(greatest(0.0,(ga+gb-2*l)/n)),4) AS d FROM l) SELECT i, j, d FROM o UNION ALL SELECT j, i, d FROM o")
def _symmetric(spark, d):
    """Every distance both ways, with the check that all are there; each is measured once."""
    return cl.rmsd_both_ways(virtual_trajectory(spark, d), digits=4)


@query("fleet_done_total", f"WITH {JOBS} SELECT count(*) > 0 AND bool_and(status = 'completed') AS done FROM t")
def _done_total(spark, d):
    counts = status.status_counts(_status(spark, d).drop("workdir").withColumnRenamed("dir", "workdir"))
    return status.fleet_report(counts, every_directory=False)


@query("status_totals", f"WITH {JOBS} SELECT count(*) AS total, {COLUMNS} FROM t")
def _totals(spark, d):
    return status.status_counts(_status(spark, d)).filter("workdir is null").drop("workdir")


@query("restart_listing", f"""WITH {JOBS} SELECT 'would restart ' || t.workdir || ' (' || printf('%.1f', current_ps) || ' of 1000.0 ps)' AS line FROM t JOIN s USING (workdir) WHERE t.status = 'failed'""")
def _listing(spark, d):
    return status.restart_listing(_status(spark, d))


@query("float_policy", "SELECT vec_id, CAST(vec_id AS FLOAT) AS t, embedding FROM embeddings")
def _policy(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("vec_id").cast("double").alias("t"), F.col("embedding").cast("array<double>").alias("embedding"))
    return as_dtype(rows, "float32")


@query("xtc_read", f"WITH {VT} SELECT frame, atom, CAST(round_even(x*1000,0) AS BIGINT) AS x, CAST(round_even(y*1000,0) AS BIGINT) AS y, CAST(round_even(z*1000,0) AS BIGINT) AS z FROM vt WHERE frame >= 10 AND frame < 400 AND (frame-10)%7 = 0")
def _xtc(spark, d):
    """Compressed coordinates are thousandths of a nm; only the stride's frames are read back."""
    path = scratch_path(spark, "trajectory-xtc")
    binary.write_xtc(virtual_trajectory(spark, d), path)
    out = binary.load_binary(spark, f"{path}/*.xtc", 10, 400, 7)
    # A file's step is the frame that was written; frames count from 0 over all files.
    return out.select(F.col("step").alias("frame"), "atom", *[F.rint(F.col(c) * 1000).cast("long").alias(c) for c in "xyz"])


@query("dcd_read", f"WITH {VT} SELECT frame, atom, round(x,5) AS x, round(y,5) AS y, round(z,5) AS z FROM vt WHERE frame < 300 AND frame%3 = 0 AND atom IN (0, 4, 20)")
def _dcd(spark, d):
    path = scratch_path(spark, "trajectory-dcd")
    binary.write_dcd(virtual_trajectory(spark, d), path)
    out = binary.load_binary(spark, f"{path}/*.dcd", 0, 300, 3, keep=[0, 4, 20])
    return out.select(F.col("step").alias("frame"), "atom", *[F.round(c, 5).alias(c) for c in "xyz"])


@query("debye_lengths", """SELECT n_nationkey AS nation, CASE n_nationkey%4 WHEN 1 THEN n_regionkey+0.5::DOUBLE WHEN 2 THEN n_regionkey+0.25::DOUBLE WHEN 3 THEN 1.5::DOUBLE END AS debye_length,
(SELECT max(n_regionkey)+0.5::DOUBLE FROM nation WHERE n_nationkey = 1) AS inferred FROM nation""")
def _debye(spark, d):
    """A log a nation: none, the hyphen with a colon, the other form, and two statements of which the first counts."""
    key, value = F.col("n_nationkey") % 4, F.col("n_regionkey")
    told = F.when(key == 1, F.concat(F.lit("run\n  Debye-length: "), value + 0.5)).when(key == 2, F.concat(F.lit("Got debye length  "), value + 0.25)).when(key == 3, F.lit("x debye length 1.5\nDebye length: 2.5")).otherwise("nothing here")
    path = scratch_path(spark, "solver-logs")
    table(spark, d, "nation").select(told.alias("value"), "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(path)
    first = text.infer_debye_length(spark, f"{path}/none.txt", f"{path}/n_nationkey=0", f"{path}/n_nationkey=1", f"{path}/n_nationkey=2")
    out = text.debye_lengths(spark, f"{path}/*/*.txt")
    return out.select(F.regexp_extract("path", "n_nationkey=([0-9]+)", 1).cast("int").alias("nation"), "debye_length", F.lit(first).alias("inferred"))


SKEWED = ((0.3, 0.0, 0.0), (0.55, 0.35, 0.0), (-0.4, 0.5, 0.3))


@query("triclinic_distances", f"""WITH {VT}, c AS (SELECT {', '.join(f'{x}::DOUBLE AS {v}_{n}' for v, row in zip('abc', SKEWED, strict=True) for n, x in zip('xyz', row, strict=True))}),
e AS (SELECT a.frame, a.atom AS i, b.atom AS j, b.x-a.x AS x, b.y-a.y AS y, b.z-a.z AS z FROM vt a JOIN vt b ON a.frame = b.frame AND b.atom = a.atom + 5),
f3 AS (SELECT frame, i, j, x-k*c_x AS x, y-k*c_y AS y, z-k*c_z AS z FROM (SELECT *, round_even(z/c_z,0) AS k FROM e, c)),
f2 AS (SELECT frame, i, j, x-k*b_x AS x, y-k*b_y AS y, z FROM (SELECT *, round_even(y/b_y,0) AS k FROM f3, c)),
f1 AS (SELECT frame, i, j, x-k*a_x AS x, y, z FROM (SELECT *, round_even(x/a_x,0) AS k FROM f2, c)),
s AS (SELECT p, q, r FROM (SELECT unnest(range(-9, 10)) AS p), (SELECT unnest(range(-4, 5)) AS q), (SELECT unnest(range(-2, 3)) AS r))
SELECT frame, i, j, round(min(sqrt((x+p*a_x+q*b_x+r*c_x)^2+(y+p*a_y+q*b_y+r*c_y)^2+(z+p*a_z+q*b_z+r*c_z)^2)),6) AS distance_nm FROM f1, c, s GROUP BY frame, i, j""")
def _triclinic(spark, d):
    cell = {f"{v}_{n}": F.lit(x) for v, row in zip("abc", SKEWED, strict=True) for n, x in zip("xyz", row, strict=True)}
    pairs = spark.range(16).select(F.col("id").cast("int").alias("i"), (F.col("id") + 5).cast("int").alias("j"))
    return ds.pair_distances(virtual_trajectory(spark, d).withColumns(cell), pairs).select("frame", "i", "j", F.round("distance_nm", 6).alias("distance_nm"))


@query("contacts_by_cells", f"""WITH {VT}, e AS (SELECT a.frame, a.atom//3 AS ri, b.atom//3 AS rj, a.x-b.x AS x, a.y-b.y AS y, a.z-b.z AS z FROM vt a JOIN vt b ON a.frame = b.frame AND b.atom//3 - a.atom//3 >= 2),
m AS (SELECT frame, ri, rj, min(sqrt((x-0.5*round_even(x/0.5,0))^2+(y-0.6*round_even(y/0.6,0))^2+(z-0.7*round_even(z/0.7,0))^2)) AS d FROM e GROUP BY frame, ri, rj)
SELECT frame, CAST(ri AS INTEGER) AS ri, CAST(rj AS INTEGER) AS rj, round(d,6) AS distance_nm FROM m WHERE d < 0.1""")
def _by_cells(spark, d):
    boxed = virtual_trajectory(spark, d).withColumns({"box_x": F.lit(0.5), "box_y": F.lit(0.6), "box_z": F.lit(0.7)})
    return ds.contacts_within(boxed, virtual_atoms(spark), 0.1, "closest", 2).select("frame", "ri", "rj", F.round("distance_nm", 6).alias("distance_nm"))


@query("sasa_residues", f"""WITH {VT}, r AS (SELECT frame, atom, atom//3 AS resid, x, y, z, CASE WHEN atom%3 = 0 THEN 0.155 + 0.05 ELSE 0.17 + 0.05 END::DOUBLE AS reach FROM vt),
p AS (SELECT i, sqrt(1-z*z)*cos(i*pi()*(3-sqrt(5))) AS px, sqrt(1-z*z)*sin(i*pi()*(3-sqrt(5))) AS py, z AS pz FROM (SELECT i, 1-(2*i+1)/100.0::DOUBLE AS z FROM (SELECT unnest(range(100)) AS i))),
c AS (SELECT DISTINCT a.frame, a.atom, i FROM r a JOIN r b ON a.frame = b.frame AND a.atom <> b.atom, p
  WHERE ((b.x-a.x)-a.reach*px)*((b.x-a.x)-a.reach*px)+((b.y-a.y)-a.reach*py)*((b.y-a.y)-a.reach*py)+((b.z-a.z)-a.reach*pz)*((b.z-a.z)-a.reach*pz) < b.reach*b.reach),
n AS (SELECT frame, atom, count(*) AS hidden FROM c GROUP BY frame, atom)
SELECT r.frame, CAST(resid AS BIGINT) AS unit_id, round(sum(4*pi()*reach*reach*(100-coalesce(hidden,0))/100),6) AS value_nm2 FROM r LEFT JOIN n USING (frame, atom) GROUP BY r.frame, resid""")
def _sasa(spark, d):
    out = surface.sasa(virtual_trajectory(spark, d), virtual_atoms(spark), "residue", 0.05, 100)
    return out.select("frame", "unit_id", F.round("value_nm2", 6).alias("value_nm2"))
