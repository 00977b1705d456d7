"""Which amino acids of a chain a request such as 'cdr3,var,share,donor,3-6' shows."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Regions by where they begin and end; the last ends before the residue that V..J shares with the constant region.
REGIONS = {
    "cdr1": ("cdr1", "fr2"),
    "cdr2": ("cdr2", "fr3"),
    "cdr3": ("cdr3", "cdr3_end"),
    "fwr1": ("fr1", "cdr1"),
    "fwr2": ("fr2", "cdr2"),
    "fwr3": ("fr3", "cdr3"),
    "fwr4": ("cdr3_end", "end"),
}
#: Categories whose positions are counted in bases and come as arrays.
BASES = ("var", "share", "donor", "donorn")
DEFAULT = "cdr3,var,share,donor"


def parse(request: str) -> list[str | tuple[int, int]]:
    """Categories and (first, last) ranges of a request; an unknown one is an error. An empty request shows nothing."""
    out: list[str | tuple[int, int]] = []
    for x in filter(None, request.split(",")):
        m = re.fullmatch(r"([0-9]+)-([0-9]+)", x)
        if m and int(m.group(1)) <= int(m.group(2)):
            out.append((int(m.group(1)), int(m.group(2))))
        elif not m and (x in REGIONS or x in BASES):
            out.append(x)
        else:
            raise ValueError(f"unknown amino category: {x}")
    return out


def needs(request: str) -> set[str]:
    """The columns that a request takes: region starts and arrays of bases."""
    return {c for x in parse(request) if isinstance(x, str) for c in (REGIONS[x] if x in REGIONS else (x,))}


def positions(request: str, at: dict[str, Column]) -> Column:
    """Sorted distinct 0-based amino acid positions; at: a column for each of needs(request).

    Starts are in amino acids, var, share, donor and donorn arrays of positions in bases. A region with
    a missing end, or ends the wrong way round, shows nothing; so does a missing array.
    """
    none = F.array().cast("array<int>")
    parts = []
    for x in parse(request):
        if isinstance(x, tuple):
            parts.append(F.sequence(F.lit(x[0]), F.lit(x[1])))
        elif x in REGIONS:
            a, b = (at[c].cast("int") for c in REGIONS[x])
            parts.append(F.coalesce(F.when(a < b, F.sequence(a, b - 1)), none))
        else:
            parts.append(F.coalesce(F.transform(at[x], lambda p: F.floor(p / 3).cast("int")), none))
    return F.sort_array(F.array_distinct(F.concat(*parts))) if parts else none


def shown(aa: Column, places: Column) -> Column:
    """The residues at those positions, in order; positions past the end show nothing."""
    return F.array_join(F.transform(places, lambda p: F.substr(aa, p + 1, F.lit(1))), "")
