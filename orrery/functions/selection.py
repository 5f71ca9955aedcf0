"""Atom selections: a small language compiled to a column predicate over ``atoms``.

Grammar: ``all``, ``none``, ``protein``, ``water``, ``backbone``, ``sidechain``,
``name|resname|element A B ..``, ``resid|resSeq|index|chainid N ..|N to M``, a word of
these with ``== != < <= > >=`` (``eq ne lt le gt ge``) and one or more values, ``not``,
``and``, ``or`` and brackets. ``resid``, ``index`` and ``chainid`` count from 0;
``resSeq`` is the number in the file. With several values ``==`` is any of them and
``!=`` none; an order takes one number.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Residue and atom names by kind.
PROTEIN = [
    "ALA", "ARG", "ASN", "ASP", "ASH", "CYS", "CYX", "CYM", "GLN", "GLU", "GLH", "GLY", "HIS", "HID", "HIE", "HIP",
    "ILE", "LEU", "LYS", "LYN", "MET", "MSE", "PHE", "PRO", "SER", "THR", "TRP", "TYR", "VAL", "ACE", "NME", "NH2",
]
WATER = ["HOH", "H2O", "HHO", "OHH", "WAT", "SOL", "TIP", "TIP2", "TIP3", "TIP4", "T3P", "T4P"]
BACKBONE = ["N", "CA", "C", "O"]
IONS = ["NA", "CL", "K", "MG", "CA", "ZN", "CU", "FE"]

_TOKEN = re.compile(r"\(|\)|[<>=!]=|[<>]|&&|\|\||!|[^\s()<>=!&|]+|[=&|]")
_COMPARE = {"==": "==", "=": "==", "eq": "==", "!=": "!=", "ne": "!=", "<": "<", "lt": "<", "<=": "<=", "le": "<=", ">": ">", "gt": ">", ">=": ">=", "ge": ">="}
_NUMBERS = {"resid": "resid", "resseq": "resseq", "index": "atom", "chainid": "chain"}
_NAMES = {"name": "name", "resname": "resname", "element": "element"}


def is_protein() -> Column:
    return F.col("resname").isin(PROTEIN)


def is_water() -> Column:
    return F.col("resname").isin(WATER)


def compile_selection(text: str) -> Column:
    """The predicate of a selection; ``ValueError`` where it can't be read."""
    tokens = _TOKEN.findall(text)
    if not tokens:
        raise ValueError("empty selection")
    column, at = _either(tokens, 0)
    if at != len(tokens):
        raise ValueError(f"can't read {tokens[at]!r} in selection {text!r}")
    return column


def _either(tokens: list[str], at: int) -> tuple[Column, int]:
    column, at = _both(tokens, at)
    while at < len(tokens) and tokens[at].lower() in ("or", "||"):
        more, at = _both(tokens, at + 1)
        column = column | more
    return column, at


def _both(tokens: list[str], at: int) -> tuple[Column, int]:
    column, at = _one(tokens, at)
    while at < len(tokens) and tokens[at].lower() in ("and", "&&"):
        more, at = _one(tokens, at + 1)
        column = column & more
    return column, at


def _one(tokens: list[str], at: int) -> tuple[Column, int]:
    if at >= len(tokens):
        raise ValueError("selection ends too early")
    token = tokens[at].lower()
    if token in ("not", "!"):
        column, at = _one(tokens, at + 1)
        return ~column, at
    if token == "(":
        column, at = _either(tokens, at + 1)
        if at >= len(tokens) or tokens[at] != ")":
            raise ValueError("missing bracket in selection")
        return column, at + 1
    words = {
        "all": F.lit(True),
        "everything": F.lit(True),
        "none": F.lit(False),
        "protein": is_protein(),
        "water": is_water(),
        "waters": is_water(),
        "backbone": is_protein() & F.col("name").isin(BACKBONE),
        "sidechain": is_protein() & ~F.col("name").isin(BACKBONE) & (F.col("element") != "H"),
    }
    if token in words:
        return words[token], at + 1
    if token in _NAMES or token in _NUMBERS:
        at += 1
        sign = _COMPARE.get(tokens[at].lower()) if at < len(tokens) else None
        at += sign is not None
        values: list[str] = []
        while at < len(tokens) and tokens[at].lower() not in ("and", "or", "&&", "||", ")", "("):
            values.append(tokens[at])
            at += 1
        if not values or any(v in ("=", "&", "|", "!") or v in _COMPARE for v in values):
            raise ValueError(f"{token} needs a value")
        if sign in ("<", "<=", ">", ">="):
            if token in _NAMES or len(values) != 1:
                raise ValueError(f"{token} {sign} needs one number")
            return _ordered(F.col(_NUMBERS[token]), sign, values[0]), at
        column = F.col(_NAMES[token]).isin(values) if token in _NAMES else _numbers(F.col(_NUMBERS[token]), values)
        return (~column if sign == "!=" else column), at
    raise ValueError(f"unknown word {tokens[at]!r} in selection")


def _ordered(column: Column, sign: str, value: str) -> Column:
    try:
        number = float(value)
    except ValueError as error:
        raise ValueError(f"not a number in selection: {value}") from error
    return {"<": column < number, "<=": column <= number, ">": column > number, ">=": column >= number}[sign]


def _numbers(column: Column, values: list[str]) -> Column:
    found, i = [], 0
    try:
        while i < len(values):
            if i + 2 < len(values) and values[i + 1].lower() == "to":
                found.append(column.between(int(values[i]), int(values[i + 2])))
                i += 3
            else:
                found.append(column == int(values[i]))
                i += 1
    except ValueError as error:
        raise ValueError(f"not a number in selection: {values}") from error
    return reduce(lambda a, b: a | b, found)


def select_atoms(atoms: DataFrame, selection: str) -> DataFrame:
    """The atoms of a selection; ``ValueError`` if there are none."""
    chosen = atoms.filter(compile_selection(selection))
    if chosen.isEmpty():
        raise ValueError(f"selection {selection!r} matches no atom")
    return chosen
