"""Column expressions for vectors in three dimensions and rigid superposition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def point(prefix: str = "") -> Vector:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def minus(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def minimum_image(d: Vector, box: Vector) -> Vector:
    """The shortest of a difference's periodic images in a rectangular cell; no cell (null): as it is."""
    return tuple(F.when(length > 0, x - length * F.rint(x / F.when(length > 0, length))).otherwise(x) for x, length in zip(d, box, strict=True))


def angle(a: Vector, b: Vector) -> Column:
    """Radians between two vectors; null if one is zero."""
    cosine = F.try_divide(dot(a, b), norm(a) * norm(b))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def dihedral(p0: Vector, p1: Vector, p2: Vector, p3: Vector) -> Column:
    """The torsion of four points in radians, by ``atan2``."""
    b1, b2, b3 = minus(p1, p0), minus(p2, p1), minus(p3, p2)
    n1, n2 = cross(b1, b2), cross(b2, b3)
    return F.atan2(norm(b2) * dot(b1, n2), dot(n1, n2))


def superposition_rmsd(s: list[list[Column]], ga: Column, gb: Column, n: Column) -> Column:
    """The least RMSD over rigid motions, from centred cross sums.

    ``s[i][j]`` is the sum of a's i-th times b's j-th coordinate, ``ga`` and ``gb`` the
    sums of squares, ``n`` the number of points. The greatest root of the quartic of
    the quaternion method (Theobald 2005) is found by Newton's steps from above.
    """
    (xx, xy, xz), (yx, yy, yz), (zx, zy, zz) = s
    c2 = -2.0 * (xx * xx + yy * yy + zz * zz + xy * xy + yx * yx + xz * xz + zx * zx + yz * yz + zy * zy)
    c1 = 8.0 * (xx * yz * zy + yy * zx * xz + zz * xy * yx - xx * yy * zz - yz * zx * xy - zy * yx * xz)
    k = [
        [xx + yy + zz, yz - zy, zx - xz, xy - yx],
        [yz - zy, xx - yy - zz, xy + yx, zx + xz],
        [zx - xz, xy + yx, -xx + yy - zz, yz + zy],
        [xy - yx, zx + xz, yz + zy, -xx - yy + zz],
    ]

    def det2(r0, r1, i, j):
        return k[r0][i] * k[r1][j] - k[r0][j] * k[r1][i]

    # Laplace expansion along the first two rows.
    pairs = [((0, 1), (2, 3), 1), ((0, 2), (1, 3), -1), ((0, 3), (1, 2), 1), ((1, 2), (0, 3), 1), ((1, 3), (0, 2), -1), ((2, 3), (0, 1), 1)]
    c0 = None
    for top, bottom, sign in pairs:
        term = F.lit(float(sign)) * det2(0, 1, *top) * det2(2, 3, *bottom)
        c0 = term if c0 is None else c0 + term
    state = F.struct(((ga + gb) / 2).alias("l"), c2.alias("c2"), c1.alias("c1"), c0.alias("c0"))

    def newton(x: Column, _: Column) -> Column:
        top = ((x["l"] * x["l"] + x["c2"]) * x["l"] + x["c1"]) * x["l"] + x["c0"]
        slope = (4.0 * x["l"] * x["l"] + 2.0 * x["c2"]) * x["l"] + x["c1"]
        return F.struct((x["l"] - F.coalesce(F.try_divide(top, slope), F.lit(0.0))).alias("l"), x["c2"], x["c1"], x["c0"])

    root = F.aggregate(F.sequence(F.lit(1), F.lit(50)), state, newton, lambda x: x["l"])
    return F.sqrt(F.greatest(F.lit(0.0), (ga + gb - 2.0 * root) / n))
