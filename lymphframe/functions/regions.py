"""Where the regions of an antibody or receptor V segment begin, from its amino acids.

starts() slides weighted motifs over the places where a region may begin and takes the best one, per
chain type; region_starts() is a quicker look for conserved residues alone: the first cysteine of the
domain, the tryptophan that opens the second framework, and the last 'YYC', 'YFC' or 'YHC' before the
third loop. Starts are 0-based places in the amino-acid sequence, null where there is none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Landmarks of the frameworks, as patterns.
FIRST_CYSTEINE = "[A-Z]C[A-Z]{2}[ASTVFG]"
SECOND_FRAMEWORK = "W[A-Z][RKQFL]Q"
THIRD_END = "Y[YFHL]C"


def _at(aa: Column, pattern: str, start: Column | None = None) -> Column:
    """0-based place of the first match from start on; null without one."""
    s = F.lit(0) if start is None else start
    tail = F.substr(aa, s + 1)
    hit = F.regexp_substr(tail, F.lit(pattern))
    return F.when(hit.isNotNull(), s + F.position(hit, tail) - 1)


def region_starts(aa: Column) -> Column:
    """Struct of fr1, cdr1, fr2, cdr2, fr3, cdr3 starts."""
    cys = _at(aa, FIRST_CYSTEINE)
    fr2 = _at(aa, SECOND_FRAMEWORK, cys)
    end = _at(aa, THIRD_END, fr2)
    return F.struct(
        F.when(cys.isNotNull(), F.greatest(F.lit(0), cys - 21)).alias("fr1"), (cys + 5).alias("cdr1"), fr2.alias("fr2"), (fr2 + 14).alias("cdr2"), (fr2 + 22).alias("fr3"), (end + 2).alias("cdr3"),
    )


#: Residues of each place and what they weigh, '-' for a place where nothing counts.
FR1 = "QEDGK:150 VIQA:50 - LVM:100 - QE:250 - - - - - - - - - - - - - - - C:250 C:250"
FR1_IGH = "QEDGK:150 VIQA:50 - LVM:100 - QE:250 - - - - - - - - - - - - - - - C:500 C:250"
CDR1 = "V:50 T:30 LIVM:200 STR:80 C:250 - - SID:100"
FR2 = "LMVF:50 - W:250 Y:150 R:100 Q:250 - - G:110 KQ:60 GKA:40"
FR2_IGL = "LMVF:50 Y:250 W:250 Y:150 R:100 Q:250 - - G:110 KQ:60 GKA:40"
CDR2_IGH = "L:80 E:80 W:80 VMIL:40 GSA:40 -"
CDR2_TRA = "PL:15 QVETI:15 LF:20 L:35 LI:15 -"
FR3_IGKL = "G:100 - P:100 - R:100 F:100 - G:100"
FR3_IGH = "YN:600 Y:500 AN:400 - - FL:850 KQR:800 - RK:1000 FVAL:700"
FR3_TRA = "EVNK:50 TKAE:50 ES:50 NDS:50 GN:50 RGM:80 FYAI:50 ST:50 AV:50 TE:50 - ND:50"
FR3_TRB = "- - KED:50 GSQ:200 DEGS:200 IVLM:200 PS:100"
CDR3_ENDS = "LQPEDSAVYYC VEASQTGTYFC ATSGQASLYLC"


def motif(text: str) -> list[dict[str, int]]:
    """Weight of each residue at each place."""
    return [{} if part == "-" else dict.fromkeys(part.split(":")[0], int(part.split(":")[1])) for part in text.split()]


def shared_ends(text: str) -> list[dict[str, int]]:
    """A residue weighs the motifs that have it there, a glutamine one at most."""
    return [{c: 1 if c == "Q" else place.count(c) for c in place} for place in zip(*text.split())]


def best_place(aa: Column, places: list[dict[str, int]], low: Column, high: Column, first: bool = False) -> Column:
    """The start from low to high (ends included) at which the motif weighs most; the last one of equals, or the first."""
    last = F.least(high, F.length(aa) - len(places))

    def weight(j: Column) -> Column:
        out = F.lit(0)
        for k, place in enumerate(places):
            for w in sorted(set(place.values())):
                out = out + F.when(F.substr(aa, j + k + 1, F.lit(1)).isin([c for c in place if place[c] == w]), w).otherwise(0)
        return out

    sign = -1 if first else 1
    tried = F.transform(F.sequence(low, last), lambda j: F.struct(weight(j).alias("w"), (j * sign).alias("j")))
    return F.when(last >= low, F.array_max(tried)["j"] * sign)


def starts(aa: Column, chain: str) -> Column:
    """Struct of fr1, cdr1, fr2, cdr2, fr3, cdr3 starts of a V segment of one chain type: IGH, IGK, IGL, TRA or TRB."""
    light, heavy = chain in ("IGK", "IGL"), chain == "IGH"
    zero = lambda n: F.greatest(F.lit(0), n)
    found = best_place(aa, motif(FR1_IGH if heavy else FR1), F.lit(0), F.lit(25 if chain == "IGL" else 40))
    fr1 = found + (F.substr(aa, found + 1, F.lit(1)) == "C").cast("int")
    cdr1 = best_place(aa, motif(CDR1), F.lit(25), fr1 + 19) + (5 if light else 8)
    fr2 = best_place(aa, motif(FR2_IGL if chain == "IGL" else FR2), F.lit(40), F.lit(62 if heavy else 73)) + (-1 if heavy else 2 if light else 0)
    if heavy:
        cdr2 = best_place(aa, motif(CDR2_IGH), fr2 + 8, fr2 + 13) + 7
    elif chain == "TRA":
        cdr2 = best_place(aa, motif(CDR2_TRA), fr2 + 10, fr2 + 12) + 6
    else:
        cdr2 = fr2 + (15 if light else 17)
    cdr3 = best_place(aa, shared_ends(CDR3_ENDS), zero(F.length(aa) - 29), F.length(aa) - 11) + 11
    if light:
        fr3 = best_place(aa, motif(FR3_IGKL), zero(cdr3 - 35), cdr3 - 28)
    elif heavy:
        place = best_place(aa, motif(FR3_IGH), zero(cdr3 - 40), cdr3 - 30, first=True)
        fr3 = F.when(place >= 1, place - 1)
    elif chain == "TRA":
        fr3 = best_place(aa, motif(FR3_TRA), zero(cdr3 - 36), cdr3 - 33) + 1
    else:
        fr3 = best_place(aa, motif(FR3_TRB), zero(cdr3 - 38), cdr3 - 35)
    return F.struct(*(c.cast("int").alias(n) for c, n in ((fr1, "fr1"), (cdr1, "cdr1"), (fr2, "fr2"), (cdr2, "cdr2"), (fr3, "fr3"), (cdr3, "cdr3"))))


def region(aa: Column, begin: Column, end: Column) -> Column:
    """Residues from begin up to end; null if either is missing or they are the wrong way round."""
    return F.when(begin <= end, F.substr(aa, begin + 1, end - begin))
