"""Similarity of bit fingerprints from their counts.

``c`` is the number of common bits, ``a`` and ``b`` the numbers of set bits, ``n`` the
number of bits. Every quotient is 0 where its denominator is.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def common_bits(left: Column, right: Column) -> Column:
    """Set bits that two fingerprints (arrays of 64-bit words) share."""
    both = F.zip_with(left, right, lambda x, y: F.bit_count(x.bitwiseAND(y)))
    return F.aggregate(both, F.lit(0), lambda total, x: total + x)


def set_bits(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda total, x: total + F.bit_count(x))


def _rogot_goldberg(c, a, b, n):
    d = n - a - b + c
    return _ratio(c, a + b) + _ratio(d, 2 * n - a - b)


METRICS = {
    "tanimoto": lambda c, a, b, n: _ratio(c, a + b - c),
    "dice": lambda c, a, b, n: _ratio(2 * c, a + b),
    "cosine": lambda c, a, b, n: _ratio(c, F.sqrt((a * b).cast("double"))),
    "sokal": lambda c, a, b, n: _ratio(c, 2 * a + 2 * b - 3 * c),
    "russel": lambda c, a, b, n: _ratio(c, n),
    "rogotgoldberg": _rogot_goldberg,
    "allbit": lambda c, a, b, n: _ratio(n - a - b + 2 * c, n),
    "kulczynski": lambda c, a, b, n: F.when((a > 0) & (b > 0), (_ratio(c, a) + _ratio(c, b)) / 2).otherwise(0.0),
    "mcconnaughey": lambda c, a, b, n: _ratio(c * (a + b) - a * b, a * b),
    "asymmetric": lambda c, a, b, n: _ratio(c, F.least(a, b)),
    "braunblanquet": lambda c, a, b, n: _ratio(c, F.greatest(a, b)),
}


def _quotient(top, bottom):
    top, bottom = np.broadcast_arrays(np.asarray(top, float), np.asarray(bottom, float))
    return np.divide(top, bottom, out=np.zeros(top.shape), where=bottom != 0)


#: The same of arrays of counts, for tasks.
VALUES = {
    "tanimoto": lambda c, a, b, n: _quotient(c, a + b - c),
    "dice": lambda c, a, b, n: _quotient(2 * c, a + b),
    "cosine": lambda c, a, b, n: _quotient(c, np.sqrt(a * b)),
    "sokal": lambda c, a, b, n: _quotient(c, 2 * a + 2 * b - 3 * c),
    "russel": lambda c, a, b, n: _quotient(c, n),
    "rogotgoldberg": lambda c, a, b, n: _quotient(c, a + b) + _quotient(n - a - b + c, 2 * n - a - b),
    "allbit": lambda c, a, b, n: _quotient(n - a - b + 2 * c, n),
    "kulczynski": lambda c, a, b, n: np.where((a > 0) & (b > 0), (_quotient(c, a) + _quotient(c, b)) / 2, 0.0),
    "mcconnaughey": lambda c, a, b, n: _quotient(c * (a + b) - a * b, a * b),
    "asymmetric": lambda c, a, b, n: _quotient(c, np.minimum(a, b)),
    "braunblanquet": lambda c, a, b, n: _quotient(c, np.maximum(a, b)),
}
#: Metrics that make no distance for clustering.
NOT_CLUSTERABLE = frozenset({"russel"})


def similarity(metric: str, c: Column, a: Column, b: Column, n: Column) -> Column:
    """One metric's value; the name in any case, ``ValueError`` if unknown."""
    found = METRICS.get(metric.lower())
    if found is None:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(sorted(METRICS))}")
    return found(c, a, b, n)
