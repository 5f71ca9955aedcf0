"""System preparation: protonation, boxes, contact types and text inputs."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of residues by state.
PROTONATED = {"ASP": "ASH", "GLU": "GLH", "HIS": "HIP"}
DEPROTONATED = {"LYS": "LYN", "CYS": "CYX", "HIS": "HIE"}
# Charge and radius (angstrom) of the salt's ions.
IONS = ((-1, 1.815), (1, 1.875))


def nonstandard(residues: DataFrame, ph: float = 7.0) -> DataFrame:
    """The residues whose state at a pH differs from that of the model (strictly above counts as protonated)."""
    return residues.filter((F.col("pka") > ph) != (F.col("model_pka") > ph))


def residue_label() -> Column:
    return F.format_string("%3s %4d %s", "residue_type", "res_num", "chain_id")


def variant_name(ph: float) -> Column:
    """The name of a residue's state at a pH; null where there is none."""
    def named(names):
        return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), F.col("residue_type"))

    return F.when(F.col("pka") > ph, named(PROTONATED)).otherwise(named(DEPROTONATED))


def protonation_variants(topology: DataFrame, residues: DataFrame, ph: float = 7.0) -> DataFrame:
    """Each residue of ``topology`` (``chain_id``, ``res_num``, ``resname``) with its ``variant`` or null."""
    changed = nonstandard(residues, ph).select("chain_id", "res_num", F.col("residue_type").alias("resname"), variant_name(ph).alias("variant"))
    return topology.join(changed, ["chain_id", "res_num", "resname"], "left")


def unmatched_overrides(topology: DataFrame, residues: DataFrame, ph: float = 7.0) -> DataFrame:
    """The changed residues that the topology doesn't have."""
    changed = nonstandard(residues, ph).withColumnRenamed("residue_type", "resname")
    return changed.join(topology, ["chain_id", "res_num", "resname"], "left_anti")


def bounding_box(atoms: DataFrame, by: list[str] | None = None, fine_padding: float = 60.0, coarse_padding: float = 100.0) -> DataFrame:
    """Low and high ends of atoms blown up by their radii, the centre, and the two grid lengths on each axis."""
    ends = [f(F.col(c) + sign * F.col("radius")).alias(f"{c}_{name}") for c in "xyz" for f, sign, name in ((F.min, -1, "lo"), (F.max, 1, "hi"))]
    box = atoms.groupBy(*(by or [])).agg(*ends)
    for c in "xyz":
        span = F.col(f"{c}_hi") - F.col(f"{c}_lo")
        box = box.withColumn(f"{c}_mid", (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2).withColumn(f"{c}_fine", span + fine_padding)
        box = box.withColumn(f"{c}_coarse", F.greatest(span + coarse_padding, F.col(f"{c}_fine")))
    return box


def grid_sizes() -> list[int]:
    """The sizes ``c * 2^n + 1`` that the multigrid solver takes, c to 6 and n to 11."""
    return sorted({c * 2**n + 1 for c in range(1, 7) for n in range(1, 12)})


def grid_size(length: Column, spacing: float) -> Column:
    """The least size whose spacing is as fine as wanted, else the largest."""
    if spacing <= 0:
        raise ValueError("spacing must be positive")
    target = F.ceil(length / spacing) + 1
    sizes = F.array(*[F.lit(x) for x in grid_sizes()])
    return F.coalesce(F.array_min(F.filter(sizes, lambda s: s >= target)), F.lit(grid_sizes()[-1]))


def heavy_atom_keys(atoms: DataFrame) -> DataFrame:
    """``atom``, ``residue``: distinct names but hydrogens, in order of their first line."""
    heavy = atoms.filter(~F.upper("atom").startswith("H"))
    return heavy.groupBy("atom", "residue").agg(F.min("line").alias("first_line")).orderBy("first_line").select("atom", "residue")


def element(name: str, content: object) -> str:
    """An XML element: of a list of elements, one a line and further in; of anything else, its text."""
    if isinstance(content, list):
        inner = "\n".join(f"  {line}" for child in content for line in child.split("\n"))
        return f"<{name}>\n{inner}\n</{name}>"
    text = str(content).lower() if isinstance(content, bool) else str(content)
    return f"<{name}> {escape(text)} </{name}>"


def contact_types_xml(first: DataFrame, second: DataFrame) -> str:
    """The two molecules' contact types; as many rows as distinct atom names."""
    sides = []
    for i, atoms in enumerate((first, second)):
        rows = heavy_atom_keys(atoms).collect()
        sides.append(element(f"molecule{i}", [element("contact", [element("atom", r["atom"]), element("residue", r["residue"])]) for r in rows]))
    return element("contacts", [element("combinations", sides)]) + "\n"


def solver_input(
    name: str,
    box: dict[str, float],
    spacing: float = 0.75,
    ionic_strength: float = 0.15,
    temperature_k: float = 298.15,
    solvent_dielectric: float = 78.54,
    solute_dielectric: float = 2.0,
    solvent_radius: float = 1.4,
) -> str:
    """The electrostatics solver's input for one molecule, from a row of ``bounding_box`` (a dict); lengths in angstrom."""
    def size(length):
        target = -(-length // spacing) + 1
        return next((s for s in grid_sizes() if s >= target), grid_sizes()[-1])

    triple = lambda key: " ".join(f"{box[f'{c}_{key}']:.4f}" for c in "xyz")
    # Statements and their order are the solver's.
    steps: list[tuple[str, str]] = [
        ("mg-auto", ""), ("dime", " ".join(str(size(box[f"{c}_fine"])) for c in "xyz")),
        *((key, triple(of)) for key, of in (("cglen", "coarse"), ("fglen", "fine"), ("cgcent", "mid"), ("fgcent", "mid"))),
        ("mol", "1"), ("lpbe", ""), ("bcfl", "sdh"),
        *(("ion", f"charge {charge:.2f} conc {ionic_strength:.4f} radius {radius:.4f}") for charge, radius in IONS),
        ("pdie", f"{solute_dielectric:.4f}"), ("sdie", f"{solvent_dielectric:.4f}"), ("srfm", "smol"), ("chgm", "spl2"), ("sdens", "10.00"),
        ("srad", f"{solvent_radius:.4f}"), ("swin", "0.30"), ("temp", f"{temperature_k:.2f}"),
        ("calcenergy", "total"), ("calcforce", "no"), ("write", f"pot dx {name}"),
    ]
    lines = ["read", f"    mol pqr {name}.pqr", "end", "elec", *(f"    {key} {value}".rstrip() for key, value in steps), "end", "print elecEnergy 1 end", "quit", ""]
    return "\n".join(lines)


def write_text(text: str, path: str) -> str:
    """Writes one small input file where the solver is run; the path."""
    Path(path).write_text(text, encoding="utf-8")
    return path


@dataclass(frozen=True)
class Body:
    """A molecule of a Brownian-dynamics input."""

    name: str
    atoms: str
    grids: tuple[str, ...] = ()
    dielectric: float = 4.0
    is_protein: bool = True
    all_in_surface: bool = False


@dataclass(frozen=True)
class Solvent:
    debye_length: float
    dielectric: float = 78.0
    relative_viscosity: float = 1.0
    kt: float = 1.0
    desolvation: float = 1.0
    radius: float = 1.4


@dataclass(frozen=True)
class Run:
    """What a Brownian-dynamics run is told besides its bodies; least time steps of 0 leave them to the program."""

    bodies: tuple[Body, ...]
    solvent: Solvent
    n_trajectories: int = 100_000
    n_trajectories_per_output: int = 10
    max_n_steps: int = 1_000_000
    n_steps_per_output: int = 10
    n_threads: int = 1
    seed: int = 11111111
    reaction_file: str = "reactions.xml"
    output: str = "results.xml"
    trajectory_file: str = "trajectory"
    least_step: float = 0.0


def dynamics_xml(run: Run) -> str:
    """The input file of a Brownian-dynamics run."""
    water = run.solvent
    solvent = {
        "debye_length": water.debye_length, "dielectric": water.dielectric, "relative_viscosity": water.relative_viscosity, "kT": water.kt,
        "desolvation_parameter": water.desolvation, "solvent_radius": water.radius,
    }
    steps = {"minimum_core_dt": run.least_step, "minimum_core_reaction_dt": run.least_step}
    system = [element("reaction_file", run.reaction_file), element("solvent", [element(k, v) for k, v in solvent.items()]), element("time_step_tolerances", [element(k, v) for k, v in steps.items()])]
    for body in run.bodies:
        core = [element("name", body.name), element("all_in_surface", body.all_in_surface), element("is_protein", body.is_protein), element("atoms", body.atoms)]
        if body.grids:
            core.append(element("electric_field", [element("grid", g) for g in body.grids]))
        system.append(element("group", [element("name", body.name), element("core", [*core, element("dielectric", body.dielectric)])]))
    told = {
        "n_threads": run.n_threads, "seed": run.seed, "output": run.output, "n_trajectories": run.n_trajectories, "n_trajectories_per_output": run.n_trajectories_per_output,
        "max_n_steps": run.max_n_steps, "trajectory_file": run.trajectory_file, "n_steps_per_output": run.n_steps_per_output,
    }
    return element("top", [*(element(k, v) for k, v in told.items()), element("system", system)]) + "\n"
