"""Bit fingerprints: similarities of one with many and of all pairs, and clusters.

A fingerprint is an array of 64-bit words with a number of bits. Making one from a
molecule needs a chemistry library, which is optional.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.similarity import METRICS, NOT_CLUSTERABLE, VALUES, common_bits, set_bits, similarity
from orrery.operators.blocks import Space
from orrery.operators.clustering import butina
from orrery.session import ship_code, staged

#: Fingerprints of a block of the pairwise join; bytes of blocks that every task gets; pairs that a task makes, twice.
BLOCK, SEND_BYTES, TASK_PAIRS = 4_096, 256_000_000, 200_000_000
#: Rows, bytes and queries of a group of a search, at most; queries of a tile.
SEARCH_ROWS, SEARCH_BYTES, SEARCH_QUERIES, SEARCH_TILE = 32_768, 100_000_000, 8_192, 64
#: Fingerprints of a block of short ones, at most and (at most) at least; rows and columns of its tiles; tasks, at most.
DENSE, DENSE_LEAST, DENSE_ROWS, DENSE_COLUMNS, DENSE_TASKS = 8_192, 256, 128, 512, 10_000
#: Bits up to which the similarities of all counts are made beforehand.
LOOKED_UP = 80
# Names of fingerprint kinds, and their radius and bits.
KINDS = {
    "morgan": (2, 1024), "ecfp2": (1, 1024), "ecfp4": (2, 1024), "ecfp6": (3, 1024),
    "maccs": (None, 167), "rdkit": (None, 2048), "atom_pair": (None, 2048), "topological_torsion": (None, 2048),
}
# The descriptors that are computed by default.
DESCRIPTORS = ["MolWt", "MolLogP", "NumHAcceptors", "NumHDonors", "FractionCSP3", "NumRotatableBonds", "RingCount", "TPSA", "qed"]


def pack_bits(bits: Column, n_bits: int) -> Column:
    """An array of booleans as 64-bit words, the first bit lowest."""
    bits = F.coalesce(bits, F.array().cast("array<boolean>"))
    one = lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))
    # Each word is one fold, so the bits are made once a word instead of once a bit.
    words = [F.aggregate(F.transform(F.slice(bits, w + 1, min(64, n_bits - w)), one), F.lit(0).cast("long"), lambda t, x: t.bitwiseOR(x)) for w in range(0, n_bits, 64)]
    return F.array(*words)


def counted(fps: DataFrame) -> DataFrame:
    """Adds ``bits``: the number of set bits."""
    return fps.withColumn("bits", set_bits(F.col("fp")))


def bulk_similarity(query: DataFrame, fps: DataFrame, n_bits: int, metric: str = "tanimoto") -> DataFrame:
    """``query_id``, ``mol_id``, ``similarity`` of a few queries with many fingerprints.

    The queries are counted: up to ten thousand are sent to the tasks.
    """
    q = counted(query).select(F.col("mol_id").alias("query_id"), F.col("fp").alias("q_fp"), F.col("bits").alias("q_bits"))
    q = F.broadcast(q) if query.count() <= 10_000 else q
    both = counted(fps).crossJoin(q)
    value = similarity(metric, common_bits(F.col("q_fp"), F.col("fp")), F.col("q_bits"), F.col("bits"), F.lit(n_bits))
    return both.select("query_id", "mol_id", value.alias("similarity"))


def top_similar(query: DataFrame, fps: DataFrame, n_bits: int, k: int = 10, metric: str = "tanimoto") -> DataFrame:
    """The ``k`` most similar of each query, ties to the smaller id.

    Fingerprints of equal length and whole-numbered ids are dealt in blocks, which keep
    the best of each query; others are compared row by row.
    """
    from pyspark.sql import Window

    if k < 1:
        raise ValueError("k must be positive")
    if metric.lower() not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(METRICS))}")
    over = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "mol_id")
    found = _block_best(query, fps, n_bits, k, metric)
    found = bulk_similarity(query, fps, n_bits, metric) if found is None else found
    return found.withColumn("rank", F.row_number().over(over)).filter(F.col("rank") <= k)


def _block_best(query: DataFrame, fps: DataFrame, n_bits: int, k: int, metric: str) -> DataFrame | None:
    """``query_id``, ``mol_id``, ``similarity``: at least the ``k`` best of each query; nothing, if the rows don't suit.

    A group is a block of queries and one of fingerprints, gone through in tiles.
    """
    if any(d.schema["mol_id"].dataType.typeName() not in ("long", "integer") for d in (query, fps)):
        return None
    length = F.coalesce(F.when(~F.exists("fp", F.isnull), F.size("fp")), F.lit(-1))
    both = query.select("mol_id", "fp", F.lit(True).alias("asked")).union(fps.select("mol_id", "fp", F.lit(False).alias("asked")))
    both = staged(both.select(F.col("mol_id").cast("long").alias("mol_id"), F.col("fp").cast("array<bigint>").alias("fp"), "asked"), "searched")
    known = both.agg(F.count_if("asked").alias("queries"), F.count_if(~F.col("asked")).alias("n"), F.min(length).alias("low"), F.max(length).alias("high"), F.count_if(F.isnull("mol_id")).alias("unnamed")).first()
    if known["low"] != known["high"] or (known["high"] or 0) < 1 or known["unnamed"]:
        return None
    rows = max(SEARCH_TILE, min(SEARCH_ROWS, SEARCH_BYTES // (256 * known["high"])))
    nq, nf = (max(1, -(-known[c] // size)) for c, size in (("queries", SEARCH_QUERIES), ("n", rows)))
    nf = max(nf, min(32, -(-known["n"] // 1_024)))
    asked = F.col("asked")
    home = F.pmod(F.xxhash64("mol_id"), F.when(asked, F.lit(nq)).otherwise(F.lit(nf))).cast("int")
    every = F.sequence(F.lit(0), F.when(asked, F.lit(nf)).otherwise(F.lit(nq)) - 1)
    dealt = both.withColumn("home", home).withColumn("o", F.explode(every))
    dealt = dealt.select("mol_id", "fp", "asked", F.when(asked, F.col("home")).otherwise(F.col("o")).alias("bq"), F.when(asked, F.col("o")).otherwise(F.col("home")).alias("bf"))
    value = VALUES[metric.lower()]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked, ids = table.column("asked").to_numpy().astype(bool), table.column("mol_id").to_numpy()
        words = table.column("fp").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        bits = lambda w: np.unpackbits(np.ascontiguousarray(w).view(np.uint8), axis=1, bitorder="little").astype(np.float32)
        order = np.flatnonzero(~asked)
        order = order[np.argsort(ids[order], kind="stable")]  # so of equal values the first is that of the least id
        mols, whole, queries = ids[order], bits(words[order]), np.flatnonzero(asked)
        ones, out = whole.sum(1, dtype=float), []
        for at in range(0, len(queries) if len(mols) else 0, SEARCH_TILE):
            few = queries[at : at + SEARCH_TILE]
            own = bits(words[few])
            least = -value((own @ whole.T).astype(float), own.sum(1, dtype=float)[:, None], ones[None, :], n_bits)
            bound = np.partition(least, k - 1, axis=1)[:, k - 1] if k < len(mols) else np.full(len(few), np.inf)
            for i, row in enumerate(least):
                best = np.flatnonzero(row <= bound[i])
                best = best[np.argsort(row[best], kind="stable")][:k]
                out.append((np.full(len(best), ids[few[i]]), mols[best], -row[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(c) for c in columns], ["query_id", "mol_id", "similarity"])

    ship_code(fps.sparkSession)
    return dealt.groupBy("bq", "bf").applyInArrow(run, "query_id long, mol_id long, similarity double")


def _all_pairs(fps: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, Column]:
    """All pairs of different ids: the left's ``mol_id``, ``bits`` and columns of ``extra``, the right's ``r_id``, ``others_bits``; and the bits they share.

    A row meets half of the blocks, each of which is one row of arrays, and unpacks it: so pairs
    are made in the task and no row is shuffled once a block. ``extra`` has a row for each ``bits``.
    """
    own = staged(counted(fps).select("mol_id", "fp", "bits").filter("mol_id is not null"), "fingerprints")
    length = F.coalesce(F.size("fp"), F.lit(-1))
    known = own.agg(F.count("*").alias("n"), F.min(length).alias("low"), F.max(length).alias("high")).first()
    n, words = known["n"], known["high"] or 0
    blocks = max(1, -(-n // BLOCK))
    own = own.withColumn("home", F.pmod(F.xxhash64("mol_id"), F.lit(blocks)))
    if known["low"] == words and 0 < words <= 64:
        parts = {f"w{k}": F.get("fp", F.lit(k)) for k in range(words)}
        common = sum((F.bit_count(F.col(w).bitwiseAND(F.get(f"r_{w}", F.col("at")))) for w in list(parts)[1:]), F.bit_count(F.col("w0").bitwiseAND(F.get("r_w0", F.col("at")))))
    else:
        parts, common = {"fp": F.col("fp")}, common_bits(F.col("fp"), F.get("r_fp", F.col("at")))
    columns = {"mol_id": F.col("mol_id"), "bits": F.col("bits"), **parts}
    packed = own.groupBy(F.col("home").alias("other")).agg(F.collect_list(F.struct(*[c.alias(x) for x, c in columns.items()])).alias("all"))
    packed = packed.select("other", *[F.col(f"all.{x}").alias(f"r_{x}") for x in columns])
    packed = F.broadcast(packed) if n * (32 + 8 * max(words, 0)) <= SEND_BYTES else packed
    left = own.select("home", *[c.alias(x) for x, c in columns.items()]).repartition(int(max(min(64, -(-n // 256)), n * n // TASK_PAIRS, 1)))
    if extra is not None:
        left = left.join(F.broadcast(extra), "bits")
    # Of two blocks the one that lies less than half way round ahead is met, so each pair of blocks once.
    ahead = F.pmod(F.col("other") - F.col("home"), F.lit(blocks)) * 2
    once = (ahead < blocks) | ((ahead == blocks) & (F.col("home") < F.col("other")))
    both = left.join(packed, once).select("*", F.posexplode("r_mol_id").alias("at", "r_id")).withColumn("others_bits", F.get("r_bits", F.col("at")))
    return both.filter((F.col("home") != F.col("other")) | (F.col("mol_id") > F.col("r_id"))), common


def pair_counts(fps: DataFrame) -> DataFrame:
    """``i``, ``j``, ``c``, ``a``, ``b`` of all pairs ``j < i``, made block by block."""
    both, common = _all_pairs(fps)
    swap = F.col("mol_id") < F.col("r_id")
    a, b = F.when(swap, F.col("others_bits")).otherwise(F.col("bits")), F.when(swap, F.col("bits")).otherwise(F.col("others_bits"))
    return both.select(F.greatest("mol_id", "r_id").alias("i"), F.least("mol_id", "r_id").alias("j"), common.alias("c"), a.alias("a"), b.alias("b"))


def _values(fps: DataFrame, n_bits: int, metric: str, digits: int | None) -> DataFrame:
    """``bits``, ``value_of``: a row for each number of bits, the similarities by the other's number and the common bits."""
    side = n_bits + 1
    bits, other, c = (F.col("id") / (side * side)).cast("int"), (F.col("id") / side).cast("int") % side, (F.col("id") % side).cast("int")
    counts = fps.sparkSession.range(side**3).select("id", bits.alias("a"), other.alias("b"), c.alias("c"))
    value = similarity(metric, F.col("c"), F.col("a"), F.col("b"), F.lit(n_bits))
    value = value if digits is None else F.round(value, digits)
    ordered = F.sort_array(F.collect_list(F.struct("id", value.alias("value"))))
    return counts.groupBy(F.col("a").alias("bits")).agg(F.transform(ordered, lambda p: p["value"]).alias("value_of"))


def _blocks_by_bits(bits: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of the (ordered) numbers of bits: of one number where these are many, else of few; at most ``DENSE`` long."""
    least, out, start = min(DENSE, max(DENSE_LEAST, len(bits) // 48)), [], 0
    ends = np.append(np.flatnonzero(np.diff(bits)) + 1, len(bits)).tolist()
    for k, end in enumerate(ends):
        # A rare number goes with the next, if that is rare as well.
        if end - start < least and k + 1 < len(ends) and ends[k + 1] - end < least:
            continue
        parts = -(-(end - start) // DENSE)
        cuts = [start + (end - start) * m // parts for m in range(parts + 1)] if parts else []
        out += zip(cuts[:-1], cuts[1:], strict=True)
        start = end
    return out


def _dense_similarities(fps: DataFrame, n_bits: int, values: DataFrame, cutoff: float | None) -> DataFrame:
    """``i``, ``j``, ``similarity`` of all pairs ``j < i`` of short fingerprints, which every task gets.

    Fingerprints are ordered by their numbers of bits and a task goes through a pair of blocks, row by row:
    so it writes few different similarities and the same ids over and over, which files hold in few bits a row.
    """
    spark, side = fps.sparkSession, n_bits + 1
    kind = fps.schema["mol_id"].dataType.simpleString()
    own = counted(fps).filter("mol_id is not null").select(F.col("mol_id").cast("long").alias("mol_id"), "bits", F.col("fp").cast("array<bigint>").alias("fp")).toArrow().combine_chunks()
    ids, bits = own.column("mol_id").to_numpy(), own.column("bits").to_numpy().astype(np.int64)
    words = own.column("fp").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    order = np.lexsort((ids, bits))
    ids, bits, words = ids[order], bits[order], np.ascontiguousarray(words[order].T)
    ranges = _blocks_by_bits(bits)
    groups = sorted(((p, q) for k, p in enumerate(ranges) for q in ranges[k:]), key=lambda g: -(g[0][1] - g[0][0]) * (g[1][1] - g[1][0]))
    made = values.orderBy("bits").select(F.explode("value_of").alias("value")).toArrow().column("value").to_numpy()
    sent = spark.sparkContext.broadcast((ids, bits, words, made, groups))

    def one_way(rows: tuple[int, int], columns: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        ids, bits, words, made, _ = sent.value
        for y in range(columns[0], columns[1], DENSE_COLUMNS):
            q = slice(y, min(y + DENSE_COLUMNS, columns[1]))
            low, high = ids[q].min(), ids[q].max()
            for x in range(rows[0], rows[1], DENSE_ROWS):
                p = slice(x, min(x + DENSE_ROWS, rows[1]))
                if ids[p].max() <= low:
                    continue
                at = (bits[p, None] * side + bits[None, q]) * side
                for w in words:
                    at += np.bitwise_count(w[p, None] & w[None, q])
                value = made[at]
                keep = None if ids[p].min() > high else ids[p, None] > ids[None, q]
                if cutoff is not None:
                    keep = value >= cutoff if keep is None else keep & (value >= cutoff)
                if keep is None:
                    yield np.repeat(ids[p], q.stop - q.start), np.tile(ids[q], p.stop - p.start), value.ravel()
                else:
                    i, j = np.nonzero(keep)
                    yield ids[p][i], ids[q][j], value[i, j]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                a, b = sent.value[4][g]
                for rows, columns in ((a, b), (b, a)) if a != b else ((a, b),):
                    for i, j, value in one_way(rows, columns):
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(i).cast(held), pa.array(j).cast(held), pa.array(value)], ["i", "j", "similarity"])

    held = pa.int32() if kind == "int" else pa.int64()
    ship_code(spark)
    tasks = max(1, min(len(groups), DENSE_TASKS))
    return spark.range(0, len(groups), 1, tasks).mapInArrow(run, f"i {kind}, j {kind}, similarity double")


def pair_similarities(fps: DataFrame, n_bits: int, metric: str = "tanimoto", cutoff: float | None = None, digits: int | None = None) -> DataFrame:
    """``i``, ``j``, ``similarity`` of all pairs ``j < i`` (from a cutoff, if given), rounded if ``digits`` are.

    Short fingerprints have few counts: their similarities are made once and looked up.
    """
    value = similarity(metric, F.col("c"), F.col("a"), F.col("b"), F.lit(n_bits))
    length = F.coalesce(F.when(~F.exists("fp", F.isnull), F.size("fp")), F.lit(-1))
    named = counted(fps).filter("mol_id is not null")
    known = named.agg(F.max(F.coalesce("bits", F.lit(n_bits + 1))).alias("many"), F.count("*").alias("n"), F.min(length).alias("low"), F.max(length).alias("high")).first() if n_bits <= LOOKED_UP else None
    if known is not None and known["many"] is not None and known["many"] <= n_bits:
        made = staged(_values(fps, n_bits, metric, digits), "similarities")
        if known["low"] == known["high"] > 0 and fps.schema["mol_id"].dataType.typeName() in ("long", "integer") and known["n"] * (16 + 8 * known["high"]) <= SEND_BYTES:
            return _dense_similarities(fps, n_bits, made, cutoff)
        both, common = _all_pairs(fps, made)
        i, j = F.greatest("mol_id", "r_id"), F.least("mol_id", "r_id")
        found = both.select(i.alias("i"), j.alias("j"), F.get("value_of", F.col("others_bits") * (n_bits + 1) + common).alias("similarity"))
    else:
        value = value if digits is None else F.round(value, digits)
        found = pair_counts(fps).select("i", "j", value.alias("similarity"))
    return found if cutoff is None else found.filter(F.col("similarity") >= cutoff)


def condensed_index(i: Column, j: Column) -> Column:
    """The place of a pair ``j < i`` in the condensed triangle, ids counted from 0."""
    return (i * (i - 1) / 2).cast("long") + j


def bit_space(fps: DataFrame, n_bits: int, metric: str = "tanimoto") -> Space:
    """Fingerprints as points whose distance is the negative similarity."""
    value = VALUES[metric.lower()]

    def tile(a, b):
        return -value(a @ b.T, a.sum(1)[:, None], b.sum(1)[None, :], n_bits)

    one = lambda w: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.call_function("shiftrightunsigned", w, k).bitwiseAND(F.lit(1).cast("long")).cast("double"))
    return Space(fps.select(F.col("mol_id").alias("frame"), F.flatten(F.transform("fp", one)).alias("v")), tile)


def cluster(fps: DataFrame, n_bits: int, cutoff: float = 0.6, metric: str = "tanimoto") -> DataFrame:
    """``cluster_id``, ``mol_id``, ``is_centroid``, ``size``: Butina clusters of similarity ``cutoff``."""
    if metric.lower() not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    if metric.lower() in NOT_CLUSTERABLE:
        raise ValueError(f"{metric} makes no distance")
    points = fps.select(F.col("mol_id").alias("frame"))
    if cutoff > 0 and fps.schema["mol_id"].dataType.typeName() in ("long", "integer"):
        return butina(bit_space(fps, n_bits, metric), points, -cutoff).withColumnRenamed("frame", "mol_id")
    near = pair_similarities(fps, n_bits, metric, cutoff).select(F.col("j").alias("i"), F.col("i").alias("j"))
    return butina(near, points).withColumnRenamed("frame", "mol_id")


def within_ranges(df: DataFrame, ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """The rows whose every column lies in its range, ends included; no range, all rows."""
    kept = F.lit(True)
    for name, (low, high) in ranges.items():
        if name not in df.columns:
            raise KeyError(name)
        kept = kept & F.col(name).between(low, high)
    return df.filter(kept)


def _chemistry():
    try:
        import rdkit  # noqa: F401
    except ImportError as error:
        raise RuntimeError("this operator needs the optional chemistry library rdkit") from error


def check_kind(fp_type: str) -> str:
    """The kind's name in lower case; ``ValueError`` if unknown."""
    if fp_type.lower() not in KINDS:
        raise ValueError(f"unknown fingerprint {fp_type!r}; known: {', '.join(KINDS)}")
    return fp_type.lower()


def fingerprints(mols: DataFrame, fp_type: str = "morgan") -> DataFrame:
    """``mol_id``, ``fp`` of ``mol_id``, ``smiles``; needs the optional library."""
    kind = check_kind(fp_type)
    _chemistry()
    import pandas as pd

    radius, n_bits = KINDS[kind]

    @F.pandas_udf("array<bigint>")
    def make(smiles: pd.Series) -> pd.Series:
        from rdkit import Chem
        from rdkit.Chem import MACCSkeys, rdFingerprintGenerator as g

        if kind == "maccs":
            own = MACCSkeys.GenMACCSKeys
        elif radius is not None:
            own = g.GetMorganGenerator(radius=radius, fpSize=n_bits).GetFingerprint
        else:
            make = {"rdkit": g.GetRDKitFPGenerator, "atom_pair": g.GetAtomPairGenerator, "topological_torsion": g.GetTopologicalTorsionGenerator}[kind]
            own = make(fpSize=n_bits).GetFingerprint

        def words(s):
            mol = Chem.MolFromSmiles(s) if s is not None else None
            if mol is None:
                return None
            out = [0] * (-(-n_bits // 64))
            for bit in own(mol).GetOnBits():
                out[bit // 64] |= 1 << (bit % 64)
            return [w - (1 << 64) if w >> 63 else w for w in out]

        return smiles.map(words)

    return mols.select("mol_id", make("smiles").alias("fp")).filter("fp is not null")


def descriptors(mols: DataFrame, names: list[str] | None = None) -> DataFrame:
    """``mol_id`` and a column for each descriptor; needs the optional library."""
    names = names or DESCRIPTORS
    _chemistry()
    from rdkit.Chem import Descriptors

    known = dict(Descriptors._descList)
    if unknown := set(names) - set(known):
        raise KeyError(", ".join(sorted(unknown)))
    import pandas as pd

    @F.pandas_udf("array<double>")
    def make(smiles: pd.Series) -> pd.Series:
        from rdkit import Chem
        from rdkit.Chem import Descriptors

        own = dict(Descriptors._descList)
        mols = smiles.map(lambda s: Chem.MolFromSmiles(s) if s is not None else None)
        return mols.map(lambda m: None if m is None else [float(own[n](m)) for n in names])

    made = mols.select("mol_id", make("smiles").alias("d"))
    return made.select("mol_id", *[F.get("d", F.lit(i)).alias(n) for i, n in enumerate(names)])


def frameworks(mols: DataFrame, generic: bool = False) -> DataFrame:
    """``mol_id``, ``framework``: the Murcko scaffold's SMILES; needs the optional library."""
    _chemistry()
    import pandas as pd

    @F.pandas_udf("string")
    def make(smiles: pd.Series) -> pd.Series:
        from rdkit import Chem
        from rdkit.Chem.Scaffolds import MurckoScaffold as m

        def one(s):
            mol = Chem.MolFromSmiles(s) if s is not None else None
            if mol is None:
                return None
            core = m.GetScaffoldForMol(mol)
            return Chem.MolToSmiles(m.MakeScaffoldGeneric(core) if generic else core)

        return smiles.map(one)

    return mols.select("mol_id", make("smiles").alias("framework"))


def is_pains(mols: DataFrame) -> DataFrame:
    """``mol_id``, ``pains``; needs the optional library."""
    _chemistry()
    import pandas as pd

    @F.pandas_udf("boolean")
    def make(smiles: pd.Series) -> pd.Series:
        from rdkit import Chem
        from rdkit.Chem import FilterCatalog as c

        own = c.FilterCatalogParams()
        own.AddCatalog(c.FilterCatalogParams.FilterCatalogs.PAINS)
        catalog = c.FilterCatalog(own)
        mols = smiles.map(lambda s: Chem.MolFromSmiles(s) if s is not None else None)
        return mols.map(lambda m: None if m is None else catalog.HasMatch(m))

    return mols.select("mol_id", make("smiles").alias("pains"))
