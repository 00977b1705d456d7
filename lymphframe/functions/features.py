"""Variables of regions by name: counts of motifs, slices, their reference's, extended and North slices, planned over found starts."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lymphframe.functions.sequence import NORTH

#: Regions and where they begin and end, by names of starts; fwr4 ends with the sequence.
BOUNDS = {"fwr1": ("fr1", "cdr1"), "cdr1": ("cdr1", "fr2"), "fwr2": ("fr2", "cdr2"), "cdr2": ("cdr2", "fr3"), "fwr3": ("fr3", "cdr3"), "cdr3": ("cdr3", "cdr3_end"), "fwr4": ("cdr3_end", None)}
REGION = "(cdr[1-3]|fwr[1-4])"


@dataclass(frozen=True)
class Variable:
    """What a name asks for: its form, the regions it looks at, a pattern, and residues to the left and right."""

    form: str
    regions: tuple[str, ...]
    pattern: str = ""
    left: int = 0
    right: int = 0


def parse(name: str) -> Variable:
    """The variable of a name; ValueError for any other.

    count_<motif>, count_cdr_<motif>, count_fwr_<motif>, count_cdr<k>_<motif>, count_fwr<k>_<motif>: motifs
    are patterns without '_'; <region>_aa, _dna, _len, _aa_ref, _dna_ref; cdr<k>_aa_<left>_<right>_ext,
    numbers may be negative; cdr<k>_aa_north.
    """
    if m := re.fullmatch(r"count_(?:(cdr|fwr)([1-4]?)_)?([^_]+)", name):
        kind, k, pattern = m.groups()
        every = tuple(r for r in BOUNDS if kind and r.startswith(kind) and (not k or r.endswith(k)))
        if kind and not every:
            raise ValueError(f"no such region: {name}")
        try:
            re.compile(pattern)
        except re.error as e:
            raise ValueError(f"not a pattern: {name}") from e
        return Variable("count", every, pattern)
    if m := re.fullmatch(rf"{REGION}_(aa|dna|len)", name):
        return Variable(m[2], (m[1],))
    if m := re.fullmatch(rf"{REGION}_(aa|dna)_ref", name):
        return Variable(f"{m[2]}_ref", (m[1],))
    if m := re.fullmatch(r"(cdr[1-3])_aa_(-?\d+)_(-?\d+)_ext", name):
        return Variable("ext", (m[1],), "", int(m[2]), int(m[3]))
    if m := re.fullmatch(r"(cdr[1-3])_aa_north", name):
        return Variable("north", (m[1],))
    raise ValueError(f"unknown variable: {name}")


def _bounds(region: str, starts: Column, size: Column) -> tuple[Column, Column]:
    low, high = BOUNDS[region]
    return starts[low], size if high is None else starts[high]


def residues(region: str, aa: Column, starts: Column, left: Column | int = 0, right: Column | int = 0) -> Column:
    """Residues of a region, `left` and `right` more on either side; null if a bound is missing, in the wrong order or outside."""
    low, high = _bounds(region, starts, F.length(aa))
    a, b = low - left, high + right
    return F.when((low <= high) & (a >= 0) & (a < F.length(aa)) & (b > 0) & (b <= F.length(aa)), F.substr(aa, a + 1, F.greatest(b - a, F.lit(0))))


def bases(region: str, dna: Column, starts: Column) -> Column:
    """The letters of a region of a sequence in frame from its start."""
    low, high = _bounds(region, starts, F.floor(F.length(dna) / 3).cast("int"))
    return F.when(low <= high, F.substr(dna, 3 * low + 1, 3 * (high - low)))


def planned(names: list[str], heavy: bool) -> dict[str, Column]:
    """Columns of the named variables over aa, dna and starts, and ref_aa, ref_dna and ref_starts for `_ref`.

    starts: a struct of fr1, cdr1, fr2, cdr2, fr3, cdr3 and cdr3_end, places of residues from 0. What can't
    be told is null; counts over several regions leave out those that can't. heavy: which of the North
    definitions holds.
    """
    aa, dna, at = F.col("aa"), F.col("dna"), F.col("starts")
    out = {}
    for name in names:
        v = parse(name)
        region = v.regions[0] if v.regions else ""
        if v.form == "count":
            parts = [residues(r, aa, at) for r in v.regions] or [aa]
            out[name] = sum((F.coalesce(F.regexp_count(p, F.lit(v.pattern)), F.lit(0)) for p in parts), F.lit(0)).cast("long")
        elif v.form in ("aa", "ext"):
            out[name] = residues(region, aa, at, v.left, v.right)
        elif v.form == "north":
            out[name] = residues(region, aa, at, *NORTH["heavy" if heavy else "light", int(region[3])])
        elif v.form == "dna":
            out[name] = bases(region, dna, at)
        elif v.form == "len":
            out[name] = F.length(residues(region, aa, at)).cast("long")
        else:
            out[name] = residues(region, F.col("ref_aa"), F.col("ref_starts")) if v.form == "aa_ref" else bases(region, F.col("ref_dna"), F.col("ref_starts"))
    return out
