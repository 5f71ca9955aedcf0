"""Registered queries of the trajectory engine and their SQL equivalents.

The driver's tables stand in for trajectories: a vector of ``embeddings`` is a frame
of 21 atoms (three components each), its label a replica; vectors are also feature
rows, and their signs fingerprints; orders and customers are jobs and directories.
Values are rounded on both sides, as sums depend on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.functions.similarity import METRICS
from orrery.operators import clustering as cl
from orrery.operators import decomposition as dc
from orrery.operators import distance as ds
from orrery.operators import fes, fingerprints, frames, lagged, metrics, prep, status
from orrery.session import staged
from orrery.sources.text import first_match
from orrery.streaming.events import windowed_means

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
N_ATOMS = 21


def query(name: str, sql: str | None = None):
    def keep(function: Query) -> Query:
        _QUERIES[name] = function
        if sql:
            _SQL[name] = sql
        return function

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def virtual_trajectory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``frames`` with ``replica``: a vector's first 63 components as 21 points."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("label").alias("replica"), F.col("vec_id").cast("double").alias("time_ps"), "embedding")
    points = F.transform(
        F.sequence(F.lit(0), F.lit(N_ATOMS - 1)),
        lambda k: F.struct(k.alias("atom"), *[F.get("embedding", 3 * k + i).cast("double").alias(c) for i, c in enumerate("xyz")]),
    )
    return rows.select("frame", "replica", "time_ps", F.inline(points))


def virtual_atoms(spark: SparkSession) -> DataFrame:
    """``atoms``: three atoms a residue, N, CA and C, in one chain."""
    k = F.col("id").cast("int")
    return spark.range(N_ATOMS).select(
        k.alias("atom"), F.get(F.array(F.lit("N"), F.lit("CA"), F.lit("C")), k % 3).alias("name"), F.get(F.array(F.lit("N"), F.lit("C"), F.lit("C")), k % 3).alias("element"),
        (k / 3).cast("int").alias("resid"), ((k / 3).cast("int") + 1).alias("resseq"), F.lit("ALA").alias("resname"), F.lit(0).alias("chain"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.col("vec_id").alias("frame"), F.col("label").alias("replica"), F.col("embedding").cast("array<double>").alias("features"))


def sign_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = F.transform("embedding", lambda x: x > 0)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("mol_id"), fingerprints.pack_bits(bits, 64).alias("fp"))


VT = """vt AS (SELECT vec_id AS frame, label AS replica, k AS atom, CAST(embedding[3*k+1] AS DOUBLE) AS x,
  CAST(embedding[3*k+2] AS DOUBLE) AS y, CAST(embedding[3*k+3] AS DOUBLE) AS z
  FROM embeddings, (SELECT CAST(unnest(range(21)) AS INTEGER) AS k))"""
FT = "ft AS (SELECT vec_id AS frame, label AS replica, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("rmsf_per_atom", f"WITH {VT} SELECT atom, round(sqrt(var_pop(x)+var_pop(y)+var_pop(z)),6) AS rmsf_nm FROM vt GROUP BY atom")
def _rmsf(spark, d):
    return metrics.rmsf(virtual_trajectory(spark, d)).select("atom", F.round("rmsf_nm", 6).alias("rmsf_nm"))


@query("radius_of_gyration", f"WITH {VT} SELECT frame, round(sqrt(var_pop(x)+var_pop(y)+var_pop(z)),6) AS rg_nm FROM vt GROUP BY frame")
def _rg(spark, d):
    return metrics.radius_of_gyration(virtual_trajectory(spark, d)).select("frame", F.round("rg_nm", 6).alias("rg_nm"))


REPLICAS = f"""WITH {VT}, r AS (SELECT replica, atom AS pos, sqrt(var_pop(x)+var_pop(y)+var_pop(z)) AS f FROM vt GROUP BY replica, atom),
m AS (SELECT replica < 5 AS first, pos, sqrt(avg(f*f)) AS f, stddev_samp(f*f)/sqrt(count(*)) AS s, count(*) AS n FROM r GROUP BY 1, 2),
a AS (SELECT first, pos, f, CASE WHEN n < 2 THEN NULL WHEN f > 0 THEN s/(2*f) ELSE 0 END AS sem, n FROM m)"""


def _replicas(spark, d):
    return metrics.rmsf(virtual_trajectory(spark, d), ["replica"]).withColumnRenamed("atom", "pos")


@query("rmsf_replica_average_sem", f"{REPLICAS.replace('replica < 5 AS first', 'true AS first')} SELECT pos, round(f,6) AS rmsf_nm, round(sem,6) AS sem_nm, n FROM a")
def _average(spark, d):
    return metrics.average_rmsf(_replicas(spark, d)).select("pos", F.round("rmsf_nm", 6).alias("rmsf_nm"), F.round("sem_nm", 6).alias("sem_nm"), "n")


@query("delta_rmsf", f"{REPLICAS} SELECT p.pos, round(q.f-p.f,6) AS delta_rmsf_nm, round(sqrt(p.sem*p.sem+q.sem*q.sem),6) AS sem_nm FROM a p JOIN a q USING (pos) WHERE p.first AND NOT q.first")
def _delta(spark, d):
    r = _replicas(spark, d)
    out = metrics.delta_rmsf(r.filter("replica < 5"), r.filter("replica >= 5"))
    return out.select("pos", F.round("delta_rmsf_nm", 6).alias("delta_rmsf_nm"), F.round("sem_nm", 6).alias("sem_nm"))


@query("delta_rmsf_aligned", f"{REPLICAS} SELECT CAST(p.pos AS INTEGER) AS pos, round(q.f-p.f,6) AS delta_rmsf_nm FROM a p JOIN a q ON q.pos = p.pos + 2 WHERE p.first AND NOT q.first")
def _delta_aligned(spark, d):
    r = _replicas(spark, d)
    pairs = spark.range(N_ATOMS - 2).select(F.col("id").cast("int").alias("pos"), F.col("id").cast("int").alias("pos_a"), (F.col("id") + 2).cast("int").alias("pos_b"))
    out = metrics.delta_rmsf(r.filter("replica < 5"), r.filter("replica >= 5"), pairs)
    return out.select("pos", F.round("delta_rmsf_nm", 6).alias("delta_rmsf_nm"))


@query("delta_rmsf_segments", f"""{REPLICAS}, dr AS (SELECT p.pos, q.f-p.f AS v FROM a p JOIN a q USING (pos) WHERE p.first AND NOT q.first)
SELECT pos, (v + lead(v) OVER (ORDER BY pos))/2 > 0 AS positive FROM dr""")
def _segments(spark, d):
    r = _replicas(spark, d)
    return metrics.segment_signs(metrics.delta_rmsf(r.filter("replica < 5"), r.filter("replica >= 5"))).select("pos", "positive")


@query("dccm_matrix", f"""WITH {VT}, m AS (SELECT atom, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM vt GROUP BY atom),
c AS (SELECT frame, atom, x-mx AS x, y-my AS y, z-mz AS z FROM vt JOIN m USING (atom)),
p AS (SELECT a.atom AS i, b.atom AS j, avg(a.x*b.x+a.y*b.y+a.z*b.z) AS c FROM c a JOIN c b USING (frame) GROUP BY 1, 2),
s AS (SELECT i AS k, sqrt(c) AS s FROM p WHERE i = j)
SELECT p.i, p.j, round(CASE WHEN p.i = p.j THEN 1.0 ELSE c/(a.s*b.s) END, 5) AS correlation FROM p JOIN s a ON a.k = p.i JOIN s b ON b.k = p.j""")
def _dccm(spark, d):
    return metrics.correlations(virtual_trajectory(spark, d)).select("i", "j", F.round("correlation", 5).alias("correlation"))


RMSD = f"""WITH {VT}, c AS (SELECT frame, atom, x-avg(x) OVER f AS x, y-avg(y) OVER f AS y, z-avg(z) OVER f AS z FROM vt WINDOW f AS (PARTITION BY frame)),
s AS (SELECT a.frame, sum(a.x*b.x) AS xx, sum(a.x*b.y) AS xy, sum(a.x*b.z) AS xz, sum(a.y*b.x) AS yx, sum(a.y*b.y) AS yy, sum(a.y*b.z) AS yz,
  sum(a.z*b.x) AS zx, sum(a.z*b.y) AS zy, sum(a.z*b.z) AS zz, sum(a.x*a.x+a.y*a.y+a.z*a.z) AS ga, sum(b.x*b.x+b.y*b.y+b.z*b.z) AS gb, count(*) AS n
  FROM c a JOIN c b ON a.atom = b.atom AND b.frame = 0 GROUP BY a.frame),
k AS (SELECT *, -2*(xx*xx+xy*xy+xz*xz+yx*yx+yy*yy+yz*yz+zx*zx+zy*zy+zz*zz) AS c2,
  8*(xx*yz*zy+yy*zx*xz+zz*xy*yx-xx*yy*zz-yz*zx*xy-zy*yx*xz) AS c1,
  xx+yy+zz AS a, yz-zy AS b, zx-xz AS c, xy-yx AS d, xx-yy-zz AS e, xy+yx AS f, zx+xz AS g, -xx+yy-zz AS h, yz+zy AS i, -xx-yy+zz AS j FROM s),
q AS (SELECT *, (a*e-b*b)*(h*j-i*i)-(a*f-c*b)*(f*j-g*i)+(a*g-d*b)*(f*i-g*h)+(b*f-c*e)*(c*j-d*i)-(b*g-d*e)*(c*i-d*h)+(c*g-d*f)*(c*g-d*f) AS c0 FROM k),
l AS (SELECT *, list_reduce(list_concat([(ga+gb)/2], list_transform(range(50), lambda t: 0.0::DOUBLE)), lambda l, t: l - (((l*l+c2)*l+c1)*l+c0)/((4*l*l+2*c2)*l+c1)) AS l FROM q WHERE frame <> 0)"""


@query("rmsd_to_reference", f"{RMSD} SELECT frame, round(sqrt(greatest(0.0,(ga+gb-2*l)/n)),5) AS rmsd_nm FROM l UNION ALL SELECT 0 AS frame, 0.0::DOUBLE AS rmsd_nm")
def _rmsd(spark, d):
    return metrics.rmsd(virtual_trajectory(spark, d)).select("frame", F.round("rmsd_nm", 5).alias("rmsd_nm"))


@query("rmsd_moving_average", f"""{RMSD}, r AS (SELECT frame, sqrt(greatest(0.0,(ga+gb-2*l)/n)) AS v FROM l UNION ALL SELECT 0, 0.0::DOUBLE)
SELECT frame, round(avg(v) OVER (ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING),5) AS rmsd_nm_mean FROM r""")
def _moving(spark, d):
    out = frames.moving_average(metrics.rmsd(virtual_trajectory(spark, d)), "rmsd_nm", 5)
    return out.select("frame", F.round("rmsd_nm_mean", 5).alias("rmsd_nm_mean"))


@query("event_moving_average", """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING),5) AS value_mean FROM events""")
def _event_moving(spark, d):
    out = frames.moving_average(table(spark, d, "events"), "value", 4, "event_id", ["user_id"])
    return out.select("event_id", F.round("value_mean", 5).alias("value_mean"))


@query("frame_slice_stride", f"WITH {VT} SELECT frame, atom, round(x,6) AS x FROM vt WHERE frame >= 10 AND frame < 200 AND (frame-10)%7 = 0")
def _stride(spark, d):
    return frames.frame_range(virtual_trajectory(spark, d), 10, 200, 7).select("frame", "atom", F.round("x", 6).alias("x"))


@query("frame_slice_negative", f"WITH {VT}, n AS (SELECT max(frame)+1 AS n FROM vt) SELECT CAST((frame-(n-50))/5 AS BIGINT) AS frame, atom, round(y,6) AS y FROM vt, n WHERE frame >= n-50 AND (frame-(n-50))%5 = 0")
def _negative(spark, d):
    return frames.slice_frames(virtual_trajectory(spark, d), -50, None, 5).select("frame", "atom", F.round("y", 6).alias("y"))


@query("subsample_frames", f"WITH {VT}, n AS (SELECT max(frame)+1 AS n FROM vt), k AS (SELECT CAST(floor(t*(n-1)::DOUBLE/36) AS BIGINT) AS frame FROM n, (SELECT unnest(range(37)) AS t)) SELECT frame, atom FROM vt WHERE frame IN (SELECT frame FROM k)")
def _subsample(spark, d):
    return frames.subsample_frames(virtual_trajectory(spark, d), 37).select("frame", "atom")


@query("atom_select", f"WITH {VT} SELECT frame, atom, CAST(atom//3+1 AS INTEGER) AS resseq FROM vt WHERE atom%3 = 1 AND atom//3 BETWEEN 1 AND 4")
def _select(spark, d):
    atoms = virtual_atoms(spark)
    chosen = frames.of_selection(virtual_trajectory(spark, d), atoms, "name CA and resid 1 to 4")
    return frames.residue_ids(chosen, atoms).select("frame", "atom", "resseq")


@query("merge_trajectories", f"WITH {VT} SELECT CASE WHEN part = 0 THEN frame ELSE frame + (SELECT max(frame)+1 FROM vt) END AS frame, atom FROM vt, (SELECT unnest([0,1]) AS part)")
def _merge(spark, d):
    vt = virtual_trajectory(spark, d)
    return frames.merge_trajectories([vt, vt]).select("frame", "atom")


@query("time_units", f"WITH {VT} SELECT DISTINCT frame, frame*2.5::DOUBLE AS time_ps, round(frame*2.5::DOUBLE/1000,6) AS time_ns FROM vt")
def _times(spark, d):
    out = frames.with_units(frames.frame_times(virtual_trajectory(spark, d), 2.5))
    return out.select("frame", "time_ps", F.round("time_ns", 6).alias("time_ns")).distinct()


@query("pair_distances", f"""WITH {VT} SELECT a.frame, a.atom AS i, b.atom AS j, round(sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2),6) AS distance_nm
FROM vt a JOIN vt b ON a.frame = b.frame AND b.atom = a.atom + 4""")
def _pairs(spark, d):
    pairs = spark.range(N_ATOMS - 4).select(F.col("id").cast("int").alias("i"), (F.col("id") + 4).cast("int").alias("j"))
    return ds.pair_distances(virtual_trajectory(spark, d), pairs).select("frame", "i", "j", F.round("distance_nm", 6).alias("distance_nm"))


@query("min_distance_groups", f"""WITH {VT}, p AS (SELECT a.frame, a.atom AS i, b.atom AS j, sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2) AS v FROM vt a JOIN vt b ON a.frame = b.frame WHERE a.atom < 6 AND b.atom >= 12)
SELECT frame, i, j, round(v,6) AS distance_nm FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY v, i, j) AS r FROM p) WHERE r = 1""")
def _minimum(spark, d):
    atoms = virtual_atoms(spark)
    out = ds.minimum_distance(virtual_trajectory(spark, d), atoms.filter("atom < 6"), atoms.filter("atom >= 12"))
    return out.select("frame", "i", "j", F.round("distance_nm", 6).alias("distance_nm"))


@query("ca_distance_features", f"""WITH {VT} SELECT a.frame, CAST(a.atom//3 AS INTEGER) AS pos_i, CAST(b.atom//3 AS INTEGER) AS pos_j, round(sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2),6) AS v
FROM vt a JOIN vt b ON a.frame = b.frame AND a.atom < b.atom WHERE a.atom%3 = 1 AND b.atom%3 = 1""")
def _ca(spark, d):
    atoms = virtual_atoms(spark).filter("name = 'CA'")
    wide = ds.ca_distance_features(virtual_trajectory(spark, d), atoms)
    order = ds.all_pairs(atoms).select("pos_i", "pos_j", (F.col("pos_i") * 7 - F.col("pos_i") * (F.col("pos_i") + 1) / 2 + F.col("pos_j") - F.col("pos_i") - 1).cast("int").alias("at"))
    return wide.select("frame", F.posexplode("features").alias("at", "v")).join(order, "at").select("frame", "pos_i", "pos_j", F.round("v", 6).alias("v"))


CONTACTS = f"""WITH {VT}, c AS (SELECT a.frame, a.atom//3 AS ri, b.atom//3 AS rj, min(sqrt((a.x-b.x)^2+(a.y-b.y)^2+(a.z-b.z)^2)) AS v
FROM vt a JOIN vt b ON a.frame = b.frame AND b.atom//3 - a.atom//3 >= 3 GROUP BY 1, 2, 3)"""


@query("residue_contacts", f"{CONTACTS} SELECT frame, CAST(ri AS INTEGER) AS ri, CAST(rj AS INTEGER) AS rj, round(v,6) AS distance_nm FROM c")
def _contacts(spark, d):
    out = ds.contacts(virtual_trajectory(spark, d), virtual_atoms(spark))
    return out.select("frame", "ri", "rj", F.round("distance_nm", 6).alias("distance_nm"))


@query("contact_frequency", f"{CONTACTS} SELECT CAST(ri AS INTEGER) AS ri, CAST(rj AS INTEGER) AS rj, round(avg(CASE WHEN v < 0.12 THEN 1.0 ELSE 0.0 END),6) AS frequency FROM c GROUP BY 1, 2")
def _frequency(spark, d):
    out = ds.contact_frequency(ds.contacts(virtual_trajectory(spark, d), virtual_atoms(spark)), 0.12)
    return out.select("ri", "rj", F.round("frequency", 6).alias("frequency"))


@query("contact_matrix", f"""{CONTACTS}, f AS (SELECT CAST(ri AS INTEGER) AS ri, CAST(rj AS INTEGER) AS rj, round(avg(CASE WHEN v < 0.12 THEN 1.0 ELSE 0.0 END),6) AS frequency FROM c GROUP BY 1, 2)
SELECT * FROM f UNION ALL SELECT rj, ri, frequency FROM f""")
def _matrix(spark, d):
    return ds.contact_matrix(_frequency(spark, d))


@query("native_contacts_q", f"""{CONTACTS}, nat AS (SELECT ri, rj FROM c WHERE frame = 0 AND v < 0.12)
SELECT frame, round(avg(CASE WHEN v < 0.12 THEN 1.0 ELSE 0.0 END),6) AS q FROM c JOIN nat USING (ri, rj) GROUP BY frame""")
def _native(spark, d):
    return ds.native_contacts(virtual_trajectory(spark, d), virtual_atoms(spark), 0.12).select("frame", F.round("q", 6).alias("q"))


@query("fes_2d", """WITH s AS (SELECT CAST(l_quantity AS DOUBLE) AS x, CAST(l_extendedprice AS DOUBLE) AS y FROM lineitem),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, count(*) AS total FROM s),
b AS (SELECT least(floor((x-x0)/((x1-x0)/20)),19) AS gx, least(floor((y-y0)/((y1-y0)/20)),19) AS gy, x, y, x0, y0, (x1-x0)/20 AS wx, (y1-y0)/20 AS wy FROM s, r),
d AS (SELECT CASE WHEN gx > 0 AND x < x0+gx*wx THEN gx-1 ELSE gx END AS gx, CASE WHEN gy > 0 AND y < y0+gy*wy THEN gy-1 ELSE gy END AS gy, x, y, x0, y0, wx, wy FROM b),
u AS (SELECT CAST(CASE WHEN gx < 19 AND x >= x0+(gx+1)*wx THEN gx+1 ELSE gx END AS INTEGER) AS bx, CAST(CASE WHEN gy < 19 AND y >= y0+(gy+1)*wy THEN gy+1 ELSE gy END AS INTEGER) AS by_ FROM d),
c AS (SELECT bx, by_, count(*) AS n FROM u GROUP BY 1, 2),
g AS (SELECT CAST(i AS INTEGER) AS bx, CAST(j AS INTEGER) AS by_ FROM (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j)),
f AS (SELECT g.bx, g.by_, coalesce(n,0) AS n, coalesce(n,0)/(total*((x1-x0)/20)*((y1-y0)/20)) AS p FROM g LEFT JOIN c USING (bx, by_), r),
e AS (SELECT *, CASE WHEN p > 1e-12 THEN -8.314462618e-3*298.15*ln(p) END AS raw FROM f)
SELECT bx, by_ AS "by", n, round(raw-(SELECT min(raw) FROM e),5) AS free_energy FROM e""")
def _fes(spark, d):
    out = fes.free_energy(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", 20)
    return out.select("bx", "by", "n", F.round("free_energy", 5).alias("free_energy"))


@query("fes_from_projection", """WITH s AS (SELECT CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
r AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM s),
u AS (SELECT CAST(least(floor((x-x0)/((x1-x0)/8)),7) AS INTEGER) AS bx, CAST(least(floor((y-y0)/((y1-y0)/6)),5) AS INTEGER) AS by_ FROM s, r),
c AS (SELECT bx, by_, count(*) AS n FROM u GROUP BY 1, 2), m AS (SELECT max(n) AS top FROM c)
SELECT bx, by_ AS "by", n, round(8.314462618e-3*310.15*ln(top::DOUBLE/n),5) AS free_energy FROM c, m""")
def _projection_fes(spark, d):
    out = fes.free_energy_of_projection(features(spark, d), "features", 0, 1, bins=(8, 6), temperature_k=310.15)
    return out.filter("observed").select("bx", "by", "n", F.round("free_energy", 5).alias("free_energy"))


@query("bounding_box_dime", f"""WITH {VT}, b AS (SELECT frame, min(x-0.15) AS lo, max(x+0.15) AS hi FROM vt GROUP BY frame),
s AS (SELECT DISTINCT c*(1 << n)+1 AS s FROM (SELECT unnest(range(1,7)) AS c), (SELECT unnest(range(1,12)) AS n))
SELECT frame, round(lo,6) AS x_lo, round(hi,6) AS x_hi, round((lo+hi)/2,6) AS x_mid, round(greatest(hi-lo+100,hi-lo+60),6) AS x_coarse,
CAST((SELECT min(s) FROM s WHERE s >= ceil((hi-lo+60)/0.5)+1) AS INTEGER) AS dime FROM b""")
def _box(spark, d):
    atoms = virtual_trajectory(spark, d).withColumn("radius", F.lit(0.15))
    out = prep.bounding_box(atoms, ["frame"]).withColumn("dime", prep.grid_size(F.col("x_fine"), 0.5))
    return out.select("frame", *[F.round(c, 6).alias(c) for c in ("x_lo", "x_hi", "x_mid", "x_coarse")], F.col("dime").cast("int").alias("dime"))


BITS = "fp AS (SELECT vec_id AS mol_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END)) AS DOUBLE) AS n FROM embeddings)"
COUNTS = f"WITH {BITS}, p AS (SELECT r.mol_id AS i, l.mol_id AS j, list_dot_product(CAST(r.b AS DOUBLE[]), CAST(l.b AS DOUBLE[])) AS c, r.n AS a, l.n AS b FROM fp r JOIN fp l ON l.mol_id < r.mol_id)"
METRIC_SQL = {
    "tanimoto": "c/nullif(a+b-c,0)", "dice": "2*c/nullif(a+b,0)", "cosine": "c/nullif(sqrt(a*b),0)", "sokal": "c/nullif(2*a+2*b-3*c,0)", "russel": "c/64",
    "rogotgoldberg": "coalesce(c/nullif(a+b,0),0)+coalesce((64-a-b+c)/nullif(128-a-b,0),0)", "allbit": "(64-a-b+2*c)/64",
    "kulczynski": "(c/nullif(a,0)+c/nullif(b,0))/2", "mcconnaughey": "(c*(a+b)-a*b)/nullif(a*b,0)", "asymmetric": "c/nullif(least(a,b),0)", "braunblanquet": "c/nullif(greatest(a,b),0)",
}


def _metric(name):
    def run(spark, d):
        return fingerprints.pair_similarities(sign_bits(spark, d), 64, name, digits=6)

    return run


for _name in METRICS:
    query(f"fingerprint_similarity_{_name}", f"{COUNTS} SELECT i, j, round(coalesce({METRIC_SQL[_name]},0),6) AS similarity FROM p")(_metric(_name))


@query("fingerprint_bulk_topk", f"""WITH {BITS}, s AS (SELECT q.mol_id AS query_id, f.mol_id, list_dot_product(CAST(q.b AS DOUBLE[]), CAST(f.b AS DOUBLE[])) AS c, q.n AS a, f.n AS b FROM fp q, fp f WHERE q.mol_id % 50 = 0),
t AS (SELECT query_id, mol_id, coalesce(c/nullif(a+b-c,0),0) AS v FROM s)
SELECT query_id, mol_id, round(v,6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY v DESC, mol_id) AS r FROM t) WHERE r <= 10""")
def _bulk(spark, d):
    fps = sign_bits(spark, d)
    return fingerprints.top_similar(fps.filter("mol_id % 50 = 0"), fps, 64, 10).select("query_id", "mol_id", F.round("similarity", 6).alias("similarity"), "rank")


@query("butina_clusters")
def _butina(spark, d):
    return fingerprints.cluster(sign_bits(spark, d), 64, 0.5)


DIST = f"WITH {FT}, p AS (SELECT a.frame AS i, b.frame AS j, list_distance(a.v, b.v) AS d FROM ft a JOIN ft b ON a.frame < b.frame), e AS (SELECT i, j, d FROM p UNION ALL SELECT j, i, d FROM p)"


def _space(spark, d):
    return cl.feature_space(features(spark, d))


@query("neighbor_counts", f"{DIST} SELECT f.frame, 1 + count(e.j) AS n FROM ft f LEFT JOIN e ON e.i = f.frame AND e.d <= 1.2 GROUP BY f.frame")
def _neighbours(spark, d):
    return cl.neighbour_counts(_space(spark, d), features(spark, d), 1.2)


@query("gromos_first_cluster", f"""{DIST}, n AS (SELECT i, count(*) AS n FROM e WHERE d <= 1.2 GROUP BY i), c AS (SELECT i FROM n ORDER BY n DESC, i LIMIT 1)
SELECT i AS frame, true AS is_medoid FROM c UNION ALL SELECT e.j, false FROM e JOIN c ON e.i = c.i WHERE e.d <= 1.2""")
def _gromos_first(spark, d):
    return cl.gromos(_space(spark, d), features(spark, d), 1.2).filter("label = 0").select("frame", "is_medoid")


@query("gromos_clusters")
def _gromos(spark, d):
    return cl.gromos(_space(spark, d), features(spark, d), 1.2)


@query("dbscan_flags", f"{DIST}, n AS (SELECT f.frame, 1 + count(e.j) AS n FROM ft f LEFT JOIN e ON e.i = f.frame AND e.d <= 1.16 GROUP BY f.frame) SELECT frame, n, n >= 5 AS core FROM n")
def _flags(spark, d):
    return cl.dbscan_flags(_space(spark, d), features(spark, d), 1.16, 5)


@query("dbscan_labels", f"""{DIST.replace('WITH', 'WITH RECURSIVE', 1)}, near AS MATERIALIZED (SELECT i, j FROM e WHERE d <= 1.16), n AS (SELECT f.frame, 1 + count(near.j) AS n FROM ft f LEFT JOIN near ON near.i = f.frame GROUP BY f.frame),
core AS MATERIALIZED (SELECT frame FROM n WHERE n >= 5), g AS MATERIALIZED (SELECT i, j FROM near WHERE i IN (SELECT frame FROM core) AND j IN (SELECT frame FROM core)),
w AS (SELECT frame, frame AS root FROM core UNION SELECT g.j, w.root FROM w JOIN g ON g.i = w.frame),
r AS (SELECT frame, min(root) AS root FROM w GROUP BY frame), l AS (SELECT frame, dense_rank() OVER (ORDER BY root) - 1 AS label FROM r),
b AS (SELECT near.i AS frame, min(l.label) AS label FROM near JOIN l ON l.frame = near.j GROUP BY near.i)
SELECT f.frame, coalesce(l.label, b.label, -1) AS label FROM ft f LEFT JOIN l USING (frame) LEFT JOIN b USING (frame)""")
def _dbscan(spark, d):
    return cl.dbscan(_space(spark, d), features(spark, d), 1.16, 5)


@query("hierarchical_average")
def _average_linkage(spark, d):
    return cl.hierarchical(_space(spark, d), features(spark, d), "average", 1.35)


@query("hierarchical_single", f"""{DIST.replace('WITH', 'WITH RECURSIVE', 1)}, g AS MATERIALIZED (SELECT i, j FROM e WHERE d <= 1.1), w AS (SELECT frame, frame AS root FROM ft UNION SELECT g.j, w.root FROM w JOIN g ON g.i = w.frame),
r AS (SELECT frame, min(root) AS root FROM w GROUP BY frame) SELECT frame, dense_rank() OVER (ORDER BY root) - 1 AS label FROM r""")
def _single(spark, d):
    return cl.hierarchical(_space(spark, d), features(spark, d).select("frame"), "single", 1.1)


@query("hdbscan_labels")
def _hdbscan(spark, d):
    return cl.hdbscan(_space(spark, d), features(spark, d))


@query("cluster_populations", "SELECT label, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 5")
def _populations(spark, d):
    return cl.populations(features(spark, d).withColumnRenamed("replica", "label"), 5)


@query("cluster_medoids", f"""{DIST}, t AS (SELECT e.i AS frame, a.replica AS label, sum(e.d) AS t FROM e JOIN ft a ON a.frame = e.i JOIN ft b ON b.frame = e.j WHERE a.replica = b.replica GROUP BY 1, 2)
SELECT label, frame AS medoid_frame, size FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(t,9), frame) AS r, count(*) OVER (PARTITION BY label) AS size FROM t) WHERE r = 1""")
def _medoids(spark, d):
    own = features(spark, d).withColumnRenamed("replica", "label")
    return cl.medoids(_space(spark, d), own.select("frame", "label"))


CENTRES = f"WITH {FT}, c AS (SELECT replica AS label, list_transform(range(64), lambda k: 0.0) AS z, list(v) AS vs FROM ft GROUP BY replica), m AS (SELECT label, k, avg(x) AS x FROM (SELECT replica AS label, unnest(range(64)) AS k, unnest(v) AS x FROM ft) GROUP BY 1, 2), cc AS (SELECT label, list(x ORDER BY k) AS c FROM m GROUP BY label), d AS (SELECT frame, label, list_distance(v, c)^2 AS d2 FROM ft, cc)"


def _label_centres(spark, d):
    means = features(spark, d).select(F.col("replica").alias("label"), F.posexplode("features").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("v"))
    return means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda p: p["v"]).alias("center"))


@query("sq_distances_to_centers", f"{CENTRES} SELECT frame, label, round(d2,6) AS d2 FROM d")
def _sq(spark, d):
    return cl.to_centres(features(spark, d), _label_centres(spark, d)).select("frame", "label", F.round("d2", 6).alias("d2"))


@query("nearest_center_inertia", f"{CENTRES} SELECT round(sum(m),4) AS inertia FROM (SELECT frame, min(d2) AS m FROM d GROUP BY frame)")
def _inertia(spark, d):
    return cl.inertia(cl.assign(features(spark, d), _label_centres(spark, d))).select(F.round("inertia", 4).alias("inertia"))


@query("feature_medoids", f"""{CENTRES}, a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY d2, label) AS r FROM d) WHERE r = 1)
SELECT label, frame AS medoid_frame FROM (SELECT label, frame, row_number() OVER (PARTITION BY label ORDER BY d2, frame) AS k FROM a) WHERE k = 1""")
def _feature_medoids(spark, d):
    rows, centres = features(spark, d), _label_centres(spark, d)
    return cl.feature_medoids(rows, centres, cl.assign(rows, centres))


@query("kmeans")
def _kmeans(spark, d):
    return cl.kmeans(features(spark, d), 8)[0]


@query("mini_batch_kmeans")
def _mini_batch(spark, d):
    return cl.mini_batch_kmeans(features(spark, d), 8, 256)[0]


@query("regular_space")
def _regular(spark, d):
    return cl.regular_space(features(spark, d), 1.3)[0]


PAIR_RMSD = f"""WITH {VT}, c AS (SELECT frame, atom, x-avg(x) OVER f AS x, y-avg(y) OVER f AS y, z-avg(z) OVER f AS z FROM vt WINDOW f AS (PARTITION BY frame)),
s AS (SELECT a.frame AS i0, b.frame AS j0, sum(a.x*b.x) AS xx, sum(a.x*b.y) AS xy, sum(a.x*b.z) AS xz, sum(a.y*b.x) AS yx, sum(a.y*b.y) AS yy, sum(a.y*b.z) AS yz,
  sum(a.z*b.x) AS zx, sum(a.z*b.y) AS zy, sum(a.z*b.z) AS zz, sum(a.x*a.x+a.y*a.y+a.z*a.z) AS ga, sum(b.x*b.x+b.y*b.y+b.z*b.z) AS gb, count(*) AS n
  FROM c a JOIN c b ON a.atom = b.atom AND a.frame < b.frame GROUP BY 1, 2),
{RMSD[RMSD.index("k AS (SELECT *"):].replace(" WHERE frame <> 0", "")}"""


@query("rmsd_matrix_pairs", f"{PAIR_RMSD} SELECT i0 AS i, j0 AS j, round(sqrt(greatest(0.0,(ga+gb-2*l)/n)),4) AS d FROM l")
def _matrix_rmsd(spark, d):
    return cl.rmsd_pairs(virtual_trajectory(spark, d), digits=4)


@query("rmsd_gromos")
def _rmsd_gromos(spark, d):
    vt = virtual_trajectory(spark, d)
    return cl.gromos(cl.frame_space(vt), vt.select("frame").distinct(), 0.22)


@query("aligned_rmsf")
def _aligned(spark, d):
    return metrics.rmsf(frames.align(virtual_trajectory(spark, d), virtual_atoms(spark)))


@query("pca_explained_variance")
def _pca(spark, d):
    return dc.explained_variance(dc.fit_pca(features(spark, d), 10), spark)


@query("pca_project")
def _project(spark, d):
    rows = features(spark, d)
    return dc.project(rows.select("frame", "features"), dc.fit_pca(rows, 2))


@query("tica_lag_pairs", f"""WITH {FT}, p AS (SELECT replica, frame, v AS now, lead(v, 3) OVER (PARTITION BY replica ORDER BY frame) AS later FROM ft)
SELECT replica, count(*) AS n, round(avg(list_dot_product(now, later)),7) AS product FROM p WHERE later IS NOT NULL GROUP BY replica""")
def _lags(spark, d):
    pairs = dc.lag_pairs(features(spark, d), 3, partition=["replica"])
    product = F.aggregate(F.zip_with("now", "later", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return pairs.groupBy("replica").agg(F.count("*").alias("n"), F.round(F.avg(product), 7).alias("product"))


@query("tica_project")
def _tica(spark, d):
    rows = features(spark, d)
    return dc.project(rows.select("frame", "features"), dc.fit_tica(rows, 3, 2, partition=["replica"]))


TICA_PLANE = f"""WITH {FT}, p AS (SELECT v, lead(v, 3) OVER (PARTITION BY replica ORDER BY frame) AS w FROM ft),
t AS (SELECT v[1] AS a, v[2] AS b, w[1] AS c, w[2] AS d FROM p WHERE w IS NOT NULL), m AS (SELECT avg(a+c)/2 AS m1, avg(b+d)/2 AS m2 FROM t),
e AS (SELECT a-m1 AS a, b-m2 AS b, c-m1 AS c, d-m2 AS d FROM t, m),
c AS (SELECT avg(a*a+c*c)/2 AS xx, avg(a*b+c*d)/2 AS xy, avg(b*b+d*d)/2 AS yy, avg(a*c) AS lxx, avg(a*d+b*c)/2 AS lxy, avg(b*d) AS lyy FROM e),
r AS (SELECT (yy*lxx-2*xy*lxy+xx*lyy)/(xx*yy-xy*xy)/2 AS h, (lxx*lyy-lxy*lxy)/(xx*yy-xy*xy) AS q FROM c),
s AS (SELECT 1 AS component, h+sqrt(h*h-q) AS speed FROM r UNION ALL SELECT 2, h-sqrt(h*h-q) FROM r)"""


@query("tica_speeds_iterated", f"{TICA_PLANE} SELECT component, round(speed, 7) AS speed FROM s")
def _tica_iterated(spark, d):
    plane = features(spark, d).withColumn("features", F.slice("features", 1, 2))
    pairs = staged(dc.lag_pairs(plane, 3, partition=["replica"]), "plane-pairs")
    speeds = lagged.leading(pairs, pairs.count(), 2, 2)[1]
    return spark.createDataFrame([(i, round(float(s), 7)) for i, s in enumerate(speeds, 1)], "component int, speed double")


@query("tica_explained_variance", f"{TICA_PLANE} SELECT component, round(speed*speed/sum(speed*speed) OVER (), 6) AS ratio, round(sum(speed*speed) OVER (ORDER BY component)/sum(speed*speed) OVER (), 6) AS cumulative FROM s")
def _tica_variance(spark, d):
    plane = features(spark, d).withColumn("features", F.slice("features", 1, 2))
    told = dc.explained_variance(dc.fit_tica(plane, 3, 2, partition=["replica"]), spark)
    return told.select("component", F.round("ratio", 6).alias("ratio"), F.round("cumulative", 6).alias("cumulative"))


DIHEDRAL = """WITH p AS (SELECT vec_id AS frame, CAST(embedding AS DOUBLE[]) AS e, CAST(unnest(range(18)) AS INTEGER) AS k FROM embeddings),
q AS (SELECT frame, k, e[3*k+4]-e[3*k+1] AS ux, e[3*k+5]-e[3*k+2] AS uy, e[3*k+6]-e[3*k+3] AS uz, e[3*k+7]-e[3*k+4] AS vx, e[3*k+8]-e[3*k+5] AS vy,
  e[3*k+9]-e[3*k+6] AS vz, e[3*k+10]-e[3*k+7] AS wx, e[3*k+11]-e[3*k+8] AS wy, e[3*k+12]-e[3*k+9] AS wz FROM p),
n AS (SELECT *, uy*vz-uz*vy AS ax, uz*vx-ux*vz AS ay, ux*vy-uy*vx AS az, vy*wz-vz*wy AS bx, vz*wx-vx*wz AS by_, vx*wy-vy*wx AS bz FROM q),
t AS (SELECT frame, k, atan2(sqrt(vx*vx+vy*vy+vz*vz)*(ux*bx+uy*by_+uz*bz), ax*bx+ay*by_+az*bz) AS angle FROM n)"""


@query("backbone_torsions", f"{DIHEDRAL} SELECT frame, CASE WHEN k%3 = 2 THEN 'phi' ELSE 'psi' END AS kind, CAST(CASE WHEN k%3 = 2 THEN (k+1)//3 ELSE k//3 END AS INTEGER) AS resid, round(cos(angle),5) AS cosine, round(sin(angle),5) AS sine FROM t WHERE k%3 <> 1")
def _torsions(spark, d):
    out = dc.torsion_table(virtual_trajectory(spark, d), virtual_atoms(spark))
    return out.select("frame", "kind", "resid", F.round(F.cos("angle"), 5).alias("cosine"), F.round(F.sin("angle"), 5).alias("sine"))


@query("ramachandran", f"""{DIHEDRAL}, a AS (SELECT frame, (k+1)//3 AS resid, angle FROM t WHERE k%3 = 2), b AS (SELECT frame, k//3 AS resid, angle FROM t WHERE k%3 = 0)
SELECT a.frame, CAST(a.resid AS INTEGER) AS resid, round(degrees(a.angle),3) AS phi_deg, round(degrees(b.angle),3) AS psi_deg FROM a JOIN b ON a.frame = b.frame AND a.resid = b.resid""")
def _ramachandran(spark, d):
    out = dc.ramachandran(dc.torsion_table(virtual_trajectory(spark, d), virtual_atoms(spark)))
    return out.select("frame", "resid", F.round("phi_deg", 3).alias("phi_deg"), F.round("psi_deg", 3).alias("psi_deg"))


@query("torsion_features", f"""{DIHEDRAL}, b AS (SELECT frame, CASE WHEN k%3 = 2 THEN 0 ELSE 2 END AS b, k, cos(angle) AS v FROM t WHERE k%3 <> 1
UNION ALL SELECT frame, CASE WHEN k%3 = 2 THEN 1 ELSE 3 END, k, sin(angle) FROM t WHERE k%3 <> 1)
SELECT frame, CAST(row_number() OVER (PARTITION BY frame ORDER BY b, k) - 1 AS INTEGER) AS "at", round(v,5) AS v FROM b""")
def _torsion_features(spark, d):
    wide = dc.backbone_torsions(virtual_trajectory(spark, d), virtual_atoms(spark))
    return wide.select("frame", F.posexplode("features").alias("at", "v")).select("frame", "at", F.round("v", 5).alias("v"))


@query("descriptor_range_filter", "SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 900 AND 1500")
def _range(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return fingerprints.within_ranges(rows, {"p_size": (10, 20), "p_retailprice": (900, 1500)})


@query("nonstandard_protonation", """WITH r AS (SELECT c_custkey AS res_num, CASE c_custkey%5 WHEN 0 THEN 'ASP' WHEN 1 THEN 'GLU' WHEN 2 THEN 'LYS' WHEN 3 THEN 'CYS' ELSE 'HIS' END AS residue_type, c_acctbal/1000 AS pka, c_nationkey/2.0 AS model_pka FROM customer)
SELECT res_num, residue_type, CASE WHEN pka > 7 THEN CASE residue_type WHEN 'ASP' THEN 'ASH' WHEN 'GLU' THEN 'GLH' WHEN 'HIS' THEN 'HIP' END ELSE CASE residue_type WHEN 'LYS' THEN 'LYN' WHEN 'CYS' THEN 'CYX' WHEN 'HIS' THEN 'HIE' END END AS variant
FROM r WHERE (pka > 7) <> (model_pka > 7)""")
def _protonation(spark, d):
    kinds = F.get(F.array(*[F.lit(x) for x in ("ASP", "GLU", "LYS", "CYS", "HIS")]), (F.col("c_custkey") % 5).cast("int"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("res_num"), kinds.alias("residue_type"), (F.col("c_acctbal") / 1000).alias("pka"), (F.col("c_nationkey") / 2.0).alias("model_pka"))
    return prep.nonstandard(rows, 7.0).select("res_num", "residue_type", prep.variant_name(7.0).alias("variant"))


KINDS = ("ASP", "GLU", "LYS", "CYS", "HIS")
# Customers are residues with a predicted and a model pKa; the distinct customers of orders by status are a topology.
RESIDUES = """kinds AS (SELECT ['ASP', 'GLU', 'LYS', 'CYS', 'HIS'] AS names),
r AS (SELECT CASE WHEN c_nationkey < 13 THEN 'A' ELSE 'B' END AS chain_id, c_custkey AS res_num, names[c_custkey%5+1] AS resname, c_acctbal/1000 AS pka, c_nationkey/2.0 AS model_pka FROM customer, kinds),
c AS (SELECT chain_id, res_num, resname, CASE WHEN pka > 7 THEN CASE resname WHEN 'ASP' THEN 'ASH' WHEN 'GLU' THEN 'GLH' WHEN 'HIS' THEN 'HIP' END
  ELSE CASE resname WHEN 'LYS' THEN 'LYN' WHEN 'CYS' THEN 'CYX' WHEN 'HIS' THEN 'HIE' END END AS variant FROM r WHERE (pka > 7) <> (model_pka > 7)),
t AS (SELECT DISTINCT CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'B' END AS chain_id, o_custkey AS res_num, names[o_custkey%5+1] AS resname FROM orders, kinds)"""


def _kind(key):
    return F.get(F.array(*[F.lit(x) for x in KINDS]), (F.col(key) % 5).cast("int"))


def _residues(spark, d):
    chain = F.when(F.col("c_nationkey") < 13, "A").otherwise("B")
    return table(spark, d, "customer").select(
        chain.alias("chain_id"), F.col("c_custkey").alias("res_num"), _kind("c_custkey").alias("residue_type"), (F.col("c_acctbal") / 1000).alias("pka"), (F.col("c_nationkey") / 2.0).alias("model_pka")
    )


def _topology(spark, d):
    chain = F.when(F.col("o_orderstatus") == "F", "A").otherwise("B")
    return table(spark, d, "orders").select(chain.alias("chain_id"), F.col("o_custkey").alias("res_num"), _kind("o_custkey").alias("resname")).distinct()


@query("protonation_overrides", f"WITH {RESIDUES} SELECT t.chain_id, t.res_num, t.resname, c.variant FROM t LEFT JOIN c USING (chain_id, res_num, resname)")
def _overrides(spark, d):
    return prep.protonation_variants(_topology(spark, d), _residues(spark, d)).select("chain_id", "res_num", "resname", "variant")


@query("unmatched_overrides", f"WITH {RESIDUES} SELECT c.chain_id, c.res_num, c.resname FROM c ANTI JOIN t USING (chain_id, res_num, resname)")
def _unmatched(spark, d):
    return prep.unmatched_overrides(_topology(spark, d), _residues(spark, d)).select("chain_id", "res_num", "resname")


JOBS = """j AS (SELECT CAST(o_custkey AS VARCHAR) AS workdir, CAST(o_orderkey AS VARCHAR) AS job_id FROM orders WHERE o_orderstatus = 'P'),
s AS (SELECT CAST(c_custkey AS VARCHAR) AS workdir, CASE WHEN c_custkey%11 = 0 THEN NULL ELSE 1000.0 END AS target_ps, c_acctbal AS current_ps, CAST(c_nationkey AS VARCHAR) AS dir FROM customer),
g AS (SELECT workdir, count(*) AS n_jobs, string_agg(job_id, ',' ORDER BY job_id) AS job_ids FROM j GROUP BY workdir),
t AS (SELECT s.workdir, s.dir, coalesce(n_jobs,0) AS n_jobs, coalesce(job_ids,'') AS job_ids, CASE WHEN target_ps IS NULL THEN 'error' WHEN current_ps+1e-3 >= target_ps THEN 'completed' WHEN coalesce(n_jobs,0) > 1 THEN 'error' WHEN n_jobs = 1 THEN 'active' ELSE 'failed' END AS status FROM s LEFT JOIN g USING (workdir))"""


def _status(spark, d):
    jobs = table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("workdir"), F.col("o_orderkey").cast("string").alias("job_id"))
    sims = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("workdir"), F.when(F.col("c_custkey") % 11 != 0, F.lit(1000.0)).alias("target_ps"), F.col("c_acctbal").alias("current_ps"), F.col("c_nationkey").cast("string").alias("dir"))
    return status.simulation_status(sims, jobs)


@query("status_report", f"WITH {JOBS} SELECT workdir, n_jobs, job_ids, status FROM t")
def _report(spark, d):
    return _status(spark, d).select("workdir", "n_jobs", "job_ids", "status")


COLUMNS = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("completed", "active", "failed", "error", "abandoned"))


@query("status_fleet_rollup", f"WITH {JOBS} SELECT dir, count(*) AS total, {COLUMNS} FROM t GROUP BY ROLLUP (dir)")
def _rollup(spark, d):
    return status.status_counts(_status(spark, d), "dir")


@query("fleet_done", f"WITH {JOBS} SELECT bool_and(status = 'completed') AS done FROM t")
def _done(spark, d):
    counts = status.status_counts(_status(spark, d).drop("workdir").withColumnRenamed("dir", "workdir"))
    return status.fleet_report(counts)


@query("restart_groups", f"WITH {JOBS} SELECT dir AS transform, string_agg(workdir, ',' ORDER BY workdir) AS replicas FROM t WHERE status = 'failed' GROUP BY dir")
def _restarts(spark, d):
    rows = _status(spark, d).select(F.col("dir").alias("transform"), F.col("workdir").alias("replica"), "status")
    return status.restart_groups(rows)


@query("latest_attempt", "SELECT l_suppkey AS transform, CAST(l_linenumber AS BIGINT) AS replica, arg_max(CAST(l_quantity AS BIGINT), l_orderkey*10000000+l_partkey) AS attempts FROM lineitem GROUP BY 1, 2")
def _latest(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("transform"), F.col("l_linenumber").cast("long").alias("replica"), F.col("l_quantity").cast("long").alias("n"), (F.col("l_orderkey") * 10_000_000 + F.col("l_partkey")).alias("line_no"))
    return status.latest_attempts(rows)


@query("replica_status", """WITH r AS (SELECT p_partkey AS transform, p_size AS replica, CASE WHEN p_size%3 > 0 THEN p_retailprice END AS est FROM part),
j AS (SELECT l_partkey AS transform, count(*) AS n FROM lineitem WHERE l_quantity < 3 GROUP BY 1), a AS (SELECT p_partkey AS transform, p_size AS replica, p_size%8 AS attempts FROM part)
SELECT r.transform, CAST(r.replica AS BIGINT) AS replica, CASE WHEN est IS NOT NULL THEN 'completed' WHEN coalesce(j.n,0) > 1 THEN 'error' WHEN j.n = 1 THEN 'active' WHEN a.attempts >= 5 THEN 'abandoned' ELSE 'failed' END AS status
FROM r LEFT JOIN j USING (transform) LEFT JOIN a ON a.transform = r.transform""")
def _replica_status(spark, d):
    parts = table(spark, d, "part").select(F.col("p_partkey").alias("transform"), F.col("p_size").cast("long").alias("replica"), F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice")).alias("est"))
    jobs = table(spark, d, "lineitem").filter("l_quantity < 3").select(F.col("l_partkey").alias("transform")).join(parts.select("transform", "replica"), "transform")
    attempts = parts.select("transform", "replica", (F.col("replica") % 8).alias("n"), F.lit(1).alias("line_no"))
    return status.replica_status(parts.withColumn("unc", F.col("est")), jobs, attempts).select("transform", "replica", "status")


@query("preempt_antijoin", """WITH m AS (SELECT max(ts) AS now FROM events), p AS (SELECT DISTINCT user_id AS array_job_id, event_type AS task_id FROM events, m WHERE ts >= now - INTERVAL 2000 MINUTE),
q AS (SELECT user_id AS array_job_id, event_type AS task_id FROM events WHERE value < 20)
SELECT array_job_id, task_id FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.array_job_id = p.array_job_id AND q.task_id = p.task_id)""")
def _preempted(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("array_job_id"), F.col("event_type").alias("task_id"), "ts", "value", F.lit("R").alias("state"), F.lit("w").alias("workdir"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    queue = events.filter("value < 20")
    return status.with_preempted(queue, events, now, 2000).filter("state = 'REQUEUING'").select("array_job_id", "task_id")


@query("work_enumeration", """WITH b AS (SELECT l_suppkey AS transform, l_linenumber AS replica FROM lineitem WHERE l_quantity < 5 UNION SELECT l_suppkey, CAST(l_tax*100 AS INTEGER) FROM lineitem WHERE l_quantity > 48)
SELECT transform, CAST(replica AS BIGINT) AS replica FROM b WHERE transform IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def _enumerate(spark, d):
    rows = table(spark, d, "lineitem")
    directories = rows.filter("l_quantity < 5").select(F.col("l_suppkey").alias("transform"), F.col("l_linenumber").alias("replica"))
    active = rows.filter("l_quantity > 48").select(F.col("l_suppkey").alias("transform"), F.round(F.col("l_tax") * 100).cast("int").alias("replica"))
    known = table(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("transform"))
    return status.enumerate_work(directories, active, known)


@query("resolve_transforms", "SELECT o_orderkey, coalesce(CAST(c_nationkey AS VARCHAR), '__UNKNOWN__') AS transform FROM orders LEFT JOIN (SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey")
def _resolve(spark, d):
    queue = table(spark, d, "orders").select(F.col("o_custkey").alias("array_job_id"), "o_orderkey")
    arrays = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("array_job_id"), F.col("c_nationkey").cast("string").alias("transform"))
    return status.resolve_transforms(queue, arrays).select("o_orderkey", "transform")


@query("first_match_text", r"""SELECT doc_id, coalesce(nullif(regexp_extract(text, 'License, (Version [0-9.]+[0-9])', 1), ''), nullif(regexp_extract(text, '(version [0-9])', 1), '')) AS found FROM documents""")
def _first(spark, d):
    return table(spark, d, "documents").select("doc_id", first_match(F.col("text"), ["License, (Version [0-9.]+[0-9])", "(version [0-9])"]).alias("found"))


@query("heavy_atom_keys", "SELECT p_brand AS atom, p_size AS residue FROM part WHERE NOT starts_with(upper(p_brand), 'H') GROUP BY 1, 2")
def _heavy(spark, d):
    return prep.heavy_atom_keys(table(spark, d, "part").select(F.col("p_brand").alias("atom"), F.col("p_size").alias("residue"), F.col("p_partkey").alias("line")))


@query("top_occupancy", "SELECT l_suppkey, round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END),6) AS occupancy FROM lineitem GROUP BY 1 ORDER BY round(avg(CASE WHEN l_quantity <= 10 THEN 1.0 ELSE 0.0 END),6) DESC, l_suppkey DESC LIMIT 7")
def _top(spark, d):
    rows = table(spark, d, "lineitem").select(F.lit(0).alias("d"), F.lit(0).alias("h"), F.col("l_suppkey").alias("a"), (F.col("l_quantity") <= 10).alias("present"))
    occupancy = ds.bond_occupancy(rows).withColumn("occupancy", F.round("occupancy", 6))
    return ds.top_bonds(occupancy, 7).select(F.col("a").alias("l_suppkey"), "occupancy")


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value),5) AS mean FROM events GROUP BY 1, 2")
def _windows(spark, d):
    out = windowed_means(table(spark, d, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("mean", 5).alias("mean"))
