"""Pairs of atoms within a cutoff by cell lists: rows grow with the atoms, not with their square."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.geometry import minimum_image, minus, norm, point

BOX = ("box_x", "box_y", "box_z")


def _cells(at: list[Column], count: list[Column | None]) -> Column:
    """The cells around a cell, each once; where ``count`` tells how many there are they wrap."""
    steps = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    wrap = lambda c, n: c if n is None else F.when(n > 0, F.pmod(c, F.greatest(n, F.lit(1)))).otherwise(c)
    return F.array_distinct(F.array(*[F.struct(*[wrap(c + s, n).alias(f"c{k}") for k, (c, s, n) in enumerate(zip(at, step, count, strict=True))]) for step in steps]))


def pairs_within(first: DataFrame, second: DataFrame, cutoff_nm: float, periodic: bool = True) -> DataFrame:
    """Structs ``a`` and ``b`` of the rows of two tables of one frame that are less than the cutoff apart, and ``d``.

    Both have ``frame``, ``x``, ``y``, ``z``. Space is cut into cells no smaller than the
    cutoff, and a row meets those of the 27 cells around it. Where the first table has a
    rectangular cell (``box_x box_y box_z``), nearest images count and cells wrap at
    its edges; a null or zero length doesn't. Rows with a null coordinate meet none.
    """
    if cutoff_nm <= 0:
        raise ValueError("the cutoff must be positive")
    boxed = periodic and set(BOX) <= set(first.columns) and set(BOX) <= set(second.columns)

    def placed(rows: DataFrame, name: str) -> tuple[DataFrame, list[Column | None]]:
        own = rows.select("frame", F.struct(*rows.columns).alias(name))
        if not boxed:
            return own.select("*", *[F.floor(F.col(f"{name}.{c}") / cutoff_nm).cast("long").alias(f"c{k}") for k, c in enumerate("xyz")]), [None] * 3
        counts, cells = [], []
        for k, (c, b) in enumerate(zip("xyz", BOX, strict=True)):
            x, size = F.col(f"{name}.{c}"), F.coalesce(F.col(f"{name}.{b}"), F.lit(0.0))
            n = F.when(size > 0, F.greatest(F.floor(size / cutoff_nm), F.lit(1))).otherwise(0).cast("long")
            turn = x / F.when(size > 0, size)
            cells.append(F.when(size > 0, F.least(F.floor((turn - F.floor(turn)) * n), n - 1)).otherwise(F.floor(x / cutoff_nm)).cast("long").alias(f"c{k}"))
            counts.append(n)
        return own.select("*", *cells), counts

    a, counts = placed(first, "a")
    b, _ = placed(second, "b")
    around = a.select("frame", "a", F.explode(_cells([F.col(f"c{k}") for k in range(3)], counts)).alias("c")).select("frame", "a", "c.*")
    met = around.join(b, ["frame", "c0", "c1", "c2"])
    step = minus(point("b."), point("a."))
    step = minimum_image(step, tuple(F.col(f"a.{c}") for c in BOX)) if boxed else step
    return met.select("frame", "a", "b", norm(step).alias("d")).filter(F.col("d") < cutoff_nm)
