"""Molecular formulas of SMILES strings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Valences that atoms outside brackets fill up with hydrogen.
VALENCES = {"B": (3,), "C": (4,), "N": (3, 5), "O": (2,), "P": (3, 5), "S": (2, 4, 6), "F": (1,), "Cl": (1,), "Br": (1,), "I": (1,)}

#: Bond symbols and their orders; an aromatic bond counts as a single one here.
BONDS = {"-": 1, "=": 2, "#": 3, "$": 4, ":": 1, "/": 1, "\\": 1}

_TOKEN = re.compile(r"(\[[^\[\]]*\])|(Br|Cl|[BCNOPSFIbcnops])|(%\d\d|\d)|([-=#$:/\\])|([().])")
_BRACKET = re.compile(r"\[\d*([A-Z][a-z]?|[a-z][a-z]?|\*)@{0,2}(?:[A-Z]{2}\d+)?(?:H(\d*))?(?:\+{1,4}|-{1,4}|[+-]\d+)?(?::\d+)?\]")
_AROMATIC = {"b", "c", "n", "o", "p", "s", "se", "as", "te", "si"}


def formula_of(smiles: str | None) -> str | None:
    """Hill formula of a SMILES, all its parts together, charge left out; null where the string cannot be read.

    Null for null or empty strings, unknown symbols, open branches or rings, bonds to
    nothing and atoms with more bonds than their valences allow. Atoms outside brackets
    get hydrogen up to their next valence; an aromatic one has one bond more than is
    written, if there is room. Isotopes count as their element. Whether aromatic rings
    have a Kekule structure is not tested.
    """
    if smiles is None or not (text := smiles.strip()):
        return None
    symbols: list[str] = []
    bonds: list[int] = []  # summed orders of an atom
    open_atom: list[bool] = []  # outside brackets, so hydrogen is implied
    count: Counter[str] = Counter()
    stack: list[int | None] = []
    rings: dict[int, tuple[int, int]] = {}
    last: int | None = None
    order = at = 0

    def join(a: int, b: int, n: int) -> None:
        bonds[a] += n
        bonds[b] += n

    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        at = m.end()
        bracket, atom, ring, bond, other = m.groups()
        if bracket or atom:
            if bracket:
                b = _BRACKET.fullmatch(bracket)
                if b is None or b[1] == "*" or (b[1][0].islower() and b[1] not in _AROMATIC):
                    return None
                atom = b[1]
                count["H"] += 0 if b[2] is None else int(b[2] or 1)
            count[atom[0].upper() + atom[1:]] += 1
            symbols.append(atom)
            bonds.append(0)
            open_atom.append(not bracket)
            if last is not None:
                join(last, len(symbols) - 1, order or 1)
            elif order:
                return None
            last, order = len(symbols) - 1, 0
        elif ring:
            number = int(ring.lstrip("%"))
            if last is None:
                return None
            if number in rings:
                start, n = rings.pop(number)
                if start == last or (n and order and n != order):
                    return None
                join(start, last, n or order or 1)
            else:
                rings[number] = (last, order)
            order = 0
        elif bond:
            if order:
                return None
            order = BONDS[bond]
        elif other == "(":
            if last is None or order:
                return None
            stack.append(last)
        elif other == ")":
            if not stack or order:
                return None
            last = stack.pop()
        else:
            if order or stack:
                return None
            last = None
    if stack or rings or order or not symbols:
        return None
    for symbol, n, free in zip(symbols, bonds, open_atom):
        if free:
            aromatic = symbol.islower()
            allowed = [v for v in VALENCES[symbol.upper() if aromatic else symbol] if v >= n]
            if not allowed:
                return None
            count["H"] += max(0, allowed[0] - n - aromatic)
    first = [e for e in ("C", "H") if count["C"] and count[e]]
    names = first + sorted(e for e, n in count.items() if n and e not in first)
    return "".join(e + (str(count[e]) if count[e] > 1 else "") for e in names)


def smiles_formula(smiles: Column) -> Column:
    """The formula of a SMILES column, see ``formula_of``; in Arrow batches."""

    def formulas(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([formula_of(t) for t in texts], dtype="object")

    return F.pandas_udf("string")(formulas)(smiles)
