"""Monomer text chemistry as native Spark expressions.

No UDF: every descriptor is a substring count written as
``(length(s) - length(replace(s, sub, ''))) / length(sub)``, which counts
non-overlapping occurrences left to right exactly like ``str.count``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import col

# ---- fixed values (polymer notation, valid-monomer alphabet, descriptor keys) ----
POLYMER_PATTERN = r"^\{(.+)\}\s*([\d.]+)\s*$"
VALID_SMILES_PATTERN = r"^[A-Za-z0-9@+\-\[\]\(\)=#/\\.%]+$"
DESC_KEYS = ["mw", "nN", "nO", "nCl", "nF", "nC", "n_ring", "n_amine", "n_acyl",
             "n_arom", "length"]
ATOM_MASS = {"C": 12.0, "N": 14.0, "O": 16.0, "Cl": 35.5, "F": 19.0}


def strip(c) -> Column:
    """Python ``str.strip()``: trims all whitespace, not only spaces."""
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def count_sub(s: Column, sub: str) -> Column:
    n = len(sub)
    removed = F.length(s) - F.length(F.replace(s, F.lit(sub), F.lit("")))
    return removed if n == 1 else removed / n


def count_digits(s: Column) -> Column:
    return F.length(s) - F.length(F.regexp_replace(s, r"[0-9]", ""))


def parse_monomer(c) -> tuple[Column, Column]:
    """``{SMILES}tag`` -> (base, tag); other text -> (itself, NULL).

    A tag that is not a number (``{X}1.2.3``) keeps the base and gives NULL.
    """
    c = col(c)
    t = strip(c)
    is_poly = t.rlike(POLYMER_PATTERN)
    base = F.when(is_poly, F.regexp_extract(t, POLYMER_PATTERN, 1)).otherwise(c)
    tag = F.when(is_poly, F.regexp_extract(t, POLYMER_PATTERN, 2).try_cast("double"))
    return base, tag


def descriptors(c) -> dict[str, Column]:
    """Eleven text descriptors of a monomer (on its base SMILES).

    NULL, blank or the text ``nan`` give zeros.
    """
    base, _ = parse_monomer(c)
    t = strip(base)
    empty = base.isNull() | (t == "") | (t == "nan")
    s = base
    nN = count_sub(s, "N") + count_sub(s, "n")
    nO = count_sub(s, "O") + count_sub(s, "o")
    nCl = count_sub(s, "Cl")
    nF = count_sub(s, "F")
    nC = count_sub(s, "C") + count_sub(s, "c") - nCl
    vals = {
        "mw": nC * ATOM_MASS["C"] + nN * ATOM_MASS["N"] + nO * ATOM_MASS["O"]
              + nCl * ATOM_MASS["Cl"] + nF * ATOM_MASS["F"],
        "nN": nN, "nO": nO, "nCl": nCl, "nF": nF, "nC": nC,
        "n_ring": F.floor(count_digits(s) / 2),
        "n_amine": nN,
        "n_acyl": count_sub(s, "C(=O)Cl") + count_sub(s, "C(=O)O"),
        "n_arom": count_sub(s, "c") + count_sub(s, "n") + count_sub(s, "o"),
        "length": F.length(s),
    }
    return {k: F.when(empty, F.lit(0.0)).otherwise(v.cast("double")) for k, v in vals.items()}


def is_valid_smiles(c) -> Column:
    """Length 2..120, no braces, at most two dots, allowed alphabet."""
    v = strip(col(c))
    n = F.length(v)
    ok = ((n >= 2) & (n <= 120) & ~v.contains("{") & ~v.contains("}")
          & (count_sub(v, ".") <= 2) & v.rlike(VALID_SMILES_PATTERN))
    return F.coalesce(ok, F.lit(False))


def is_acyl(c) -> Column:
    """Acyl chloride if it carries ``C(=O)Cl`` or ``C(Cl)=O``."""
    c = col(c)
    return c.contains("C(=O)Cl") | c.contains("C(Cl)=O")


def is_amine(c) -> Column:
    """Amine if it has N or n and is not an acyl chloride."""
    c = col(c)
    return (c.contains("N") | c.contains("n")) & ~is_acyl(c)
