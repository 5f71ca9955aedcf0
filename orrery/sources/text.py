"""Text inputs: energy tables, charges and radii, molecules, logs and job results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# How a solver's log states the Debye length, in order of preference.
DEBYE_PATTERNS = [
    r"[Dd]ebye[- ]length[:\s]+([0-9.]+)",
    r"[Gg]ot debye length\s+([0-9.]+)",
]
MOLECULE_SUFFIXES = (".sdf", ".sdfgz", ".mae", ".maegz", ".smi", ".smr")


def xvg_header(lines: list[str]) -> dict:
    """Title, axis labels and legends of the ``@`` lines."""
    found: dict = {"legends": {}}
    for line in lines:
        words = line.lstrip("@").split()
        quoted = re.search(r'"(.*)"', line)
        if not words or not quoted:
            continue
        if words[0] in ("title", "subtitle"):
            found[words[0]] = quoted.group(1)
        elif words[0] in ("xaxis", "yaxis") and len(words) > 1 and words[1] == "label":
            found[words[0][0] + "label"] = quoted.group(1)
        elif len(words) > 1 and words[1] == "legend" and re.fullmatch(r"s[0-9]+", words[0]):
            found["legends"][int(words[0][1:])] = quoted.group(1)
    return found


def read_xvg(spark: SparkSession, path: str, dtype: str = "float64") -> DataFrame:
    """The columns of an energy or time-series table, named by its header.

    The first is named by the x axis or ``Time``, others by their legend, else by the y
    axis if there are two columns, else ``col_1`` and so on. Title and labels are in the
    first field's metadata.
    """
    if dtype not in ("float32", "float64"):
        raise ValueError("dtype must be float32 or float64")
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> ''")
    # A header has a few lines.
    header = xvg_header([r["value"] for r in lines.filter(F.startswith("value", F.lit("@"))).collect()])
    data = lines.filter(~F.startswith("value", F.lit("@")) & ~F.startswith("value", F.lit("#"))).select(F.split("value", r"\s+").alias("f"))
    n = data.agg(F.max(F.size("f"))).first()[0]
    if not n:
        raise ValueError(f"{path} holds no data")
    names = [header.get("xlabel") or "Time"]
    for i in range(1, n):
        names.append(header["legends"].get(i - 1) or (header.get("ylabel") if n == 2 and header.get("ylabel") else f"col_{i}"))
    kind = "float" if dtype == "float32" else "double"
    told = {k: header[k] for k in ("title", "xlabel", "ylabel") if k in header}
    first = F.get("f", F.lit(0)).cast(kind).alias(names[0], metadata=told)
    return data.select(first, *[F.get("f", F.lit(i)).cast(kind).alias(name) for i, name in enumerate(names) if i])


def read_edr(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a binary energy file; needs the optional reader."""
    try:
        import panedr
    except ImportError as error:
        raise RuntimeError("this source needs the optional library panedr") from error
    return spark.createDataFrame(panedr.edr_to_df(path))


def read_pqr(spark: SparkSession, path: str) -> DataFrame:
    """``line``, ``atom``, ``residue``, ``x``, ``y``, ``z``, ``charge``, ``radius`` of the atoms of a PQR file."""
    whole = spark.read.text(path, wholetext=True)
    lines = whole.select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    atoms = lines.filter(F.startswith("value", F.lit("ATOM")) | F.startswith("value", F.lit("HETATM"))).select("line", F.split(F.trim("value"), r"\s+").alias("f")).filter(F.size("f") >= 10)
    if atoms.isEmpty():
        raise ValueError(f"{path} holds no atoms")
    from_end = lambda i: F.element_at("f", F.lit(i)).cast("double")
    return atoms.select("line", F.get("f", F.lit(2)).alias("atom"), F.get("f", F.lit(3)).alias("residue"), from_end(-5).alias("x"), from_end(-4).alias("y"), from_end(-3).alias("z"), from_end(-2).alias("charge"), from_end(-1).alias("radius"))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first group of the first pattern that matches anywhere; null if none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def debye_lengths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``path``, ``debye_length``: what each log states, null if it states none; a log is one row."""
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), first_match(F.col("value"), DEBYE_PATTERNS).alias("v"))
    return logs.select("path", F.expr("try_cast(v as double)").alias("debye_length"))


def infer_debye_length(spark: SparkSession, *logs: str) -> float:
    """The Debye length that the first log with one states; logs that aren't there are passed over."""
    for log in logs:
        try:
            found = debye_lengths(spark, log).filter("debye_length is not null").first()
        except Exception as error:  # a log that isn't there
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        if found:
            return found["debye_length"]
    raise RuntimeError("no log states a Debye length")


def read_molecules(spark: SparkSession, path: str, multithreaded: bool = False) -> DataFrame:
    """``name`` and ``smiles`` of a SMILES file, or ``name``, ``block`` and ``fields`` of an SDF.

    Entries that can't be read are left out; their order means nothing. ``TypeError`` for
    other kinds of file.
    """
    suffix = next((s for s in sorted(MOLECULE_SUFFIXES, key=len, reverse=True) if path.lower().endswith(s)), None)
    if suffix is None:
        raise TypeError(f"unknown kind of molecule file: {path}")
    if suffix.startswith(".mae"):
        if multithreaded:
            raise TypeError("maestro files can't be read by several threads")
        raise RuntimeError("maestro files need an optional library")
    if suffix in (".smi", ".smr"):
        words = spark.read.text(path).select(F.split(F.trim("value"), r"\s+", 2).alias("f")).filter(F.get("f", F.lit(0)) != "")
        rows = words.select(F.coalesce(F.get("f", F.lit(1)), F.lit("")).alias("name"), F.get("f", F.lit(0)).alias("smiles"))
        return rows.filter(looks_like_smiles(F.col("smiles")) & ~F.lower("smiles").isin("smiles"))
    blocks = spark.read.option("lineSep", "$$$$\n").text(path).filter(F.trim("value") != "")
    fields = F.regexp_extract_all("value", F.lit(r"(?m)^>\s*<([^>]+)>"), F.lit(1))
    values = F.regexp_extract_all("value", F.lit(r"(?m)^>\s*<[^>]+>.*\n([^\n]*)"), F.lit(1))
    rows = blocks.select(F.trim(F.get(F.split("value", "\n"), F.lit(0))).alias("name"), F.concat(F.substring_index("value", "M  END", 1), F.lit("M  END")).alias("block"), F.map_from_arrays(F.array_distinct(fields), F.slice(values, F.lit(1), F.greatest(F.size(F.array_distinct(fields)), F.lit(0)))).alias("fields"), F.contains("value", F.lit("M  END")).alias("whole"))
    return rows.filter("whole").drop("whole")


def looks_like_smiles(smiles: Column) -> Column:
    """A SMILES by its letters and brackets; whether it is chemistry needs a library."""
    body = F.regexp_replace(smiles, r"\[[^\]\[]+\]", "*")
    balanced = F.length(F.regexp_replace(body, r"[^(]", "")) == F.length(F.regexp_replace(body, r"[^)]", ""))
    return smiles.rlike(r"^(\[[^\]\[]+\]|Br|Cl|[BCNOPSFIbcnops*]|[-=#$:/\\.~()]|%[0-9]{2}|[0-9])+$") & balanced


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``est``, ``unc`` of job results; what can't be read is null."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    number = lambda p: F.get_json_object("value", p).try_cast("double")
    return text.select("path", number("$.estimate.magnitude").alias("est"), number("$.uncertainty.magnitude").alias("unc"))


def read_queue(spark: SparkSession, path: str) -> DataFrame:
    """``job_id``, ``state``, ``workdir`` of a queue listing with bars between."""
    return spark.read.csv(path, sep="|", schema="job_id string, state string, workdir string")


def find_directories(spark: SparkSession, root: str, pattern: str = "*.tpr") -> DataFrame:
    """The distinct directories below ``root`` that hold such a file; no file is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("workdir")).distinct().orderBy("workdir")


def target_time(dump: Column) -> Column:
    """A run's end in ps from its dumped input; without a step limit, infinite."""
    take = lambda name: F.nullif(F.regexp_extract(dump, rf"(?m)^\s*{name}\s*=\s*(\S+)", 1), F.lit("")).try_cast("double")
    steps = take("nsteps")
    return F.when(steps < 0, F.lit(float("inf"))).otherwise(F.coalesce(take("init-t"), take("init_t"), F.lit(0.0)) + steps * F.coalesce(take("delta-t"), take("dt")))


def last_progress(lines: DataFrame, place: Sequence[str] = ()) -> DataFrame:
    """``percent``: the last ``percent_complete`` of the newest progress file (``mtime``, ``line_no``, ``value``).

    Of lines with equal ``mtime`` and ``line_no`` the first by the columns ``place`` tells, if these are given; lines that lack one don't count.
    """
    value = F.regexp_extract("value", r"percent_complete:\s*([-+]?(?:[0-9.]+(?:[eE][-+]?[0-9]+)?|Infinity|NaN))", 1).try_cast("double")
    found = lines.filter(F.contains("value", F.lit("percent_complete:")) & F.col("mtime").isNotNull() & F.col("line_no").isNotNull())
    found = found.select(F.struct("mtime", "line_no").alias("at"), value.alias("percent"), *place)
    if not place:
        return found.agg(F.max_by("percent", "at").alias("percent"))
    # Few lines are the newest, so only these are compared by their places.
    newest = found.agg(F.max("at").alias("newest"))
    return found.join(F.broadcast(newest), F.col("at") == F.col("newest")).agg(F.min_by("percent", F.struct(*place)).alias("percent"))
