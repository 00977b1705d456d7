"""Variables of regions against plain slices of the residues."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from lymphframe.functions import features as Q
from lymphframe.functions import regions as R
from lymphframe.functions import sequence as S

NORTH = {("heavy", "cdr1"): (3, 3), ("heavy", "cdr2"): (2, 3), ("light", "cdr1"): (0, 0), ("light", "cdr2"): (1, 0), ("heavy", "cdr3"): (-1, -1), ("light", "cdr3"): (-1, -1)}


def plain(name, aa, dna, at, ref_aa, ref_dna, ref_at, heavy):
    """One variable from strings and a dictionary of starts."""

    def bounds(region, at, size):
        low, high = Q.BOUNDS[region]
        return at[low], size if high is None else at[high]

    def cut(region, aa, at, left=0, right=0):
        a, b = bounds(region, at, len(aa))
        if a is None or b is None or a > b:
            return None
        a, b = a - left, b + right
        return aa[a:b] if 0 <= a < len(aa) and 0 < b <= len(aa) else None

    def letters(region, dna, at):
        a, b = bounds(region, at, len(dna) // 3)
        return None if a is None or b is None or a > b else dna[3 * a : 3 * b]

    if name.startswith("count_"):
        rest = name[6:]
        kind = re.match(r"(cdr|fwr)(\d?)_", rest)
        if not kind:
            return len(re.findall(rest, aa))
        found = [r for r in Q.BOUNDS if r.startswith(kind[1]) and kind[2] in ("", r[3])]
        return sum(len(re.findall(rest[len(kind[0]) :], cut(r, aa, at) or "")) for r in found)
    region, _, form = name.partition("_")
    if form == "aa_north":
        return cut(region, aa, at, *NORTH["heavy" if heavy else "light", region])
    if form.endswith("_ext"):
        return cut(region, aa, at, *map(int, form.split("_")[1:3]))
    return {"aa": lambda: cut(region, aa, at), "dna": lambda: letters(region, dna, at), "len": lambda: None if (x := cut(region, aa, at)) is None else len(x), "aa_ref": lambda: cut(region, ref_aa, ref_at), "dna_ref": lambda: letters(region, ref_dna, ref_at)}[form]()


def test_names():
    assert Q.parse("count_cdr_[ST]").regions == ("cdr1", "cdr2", "cdr3") and Q.parse("count_fwr4_S").regions == ("fwr4",) and Q.parse("count_S.").regions == ()
    assert Q.parse("cdr2_aa_-1_3_ext") == Q.Variable("ext", ("cdr2",), "", -1, 3)
    for bad in ("cdr4_aa", "count_cdr4_S", "count_[", "fwr1_aa_1_1_ext", "cdr1_aa_x_1_ext", "fwr2_aa_north", "cdr1", "count_cdr1_", "cdr1_len_ref"):
        with pytest.raises(ValueError):
            Q.parse(bad)


def test_odd_places(spark):
    names = ["cdr1_aa", "cdr1_dna", "cdr1_len", "fwr4_aa", "fwr4_dna", "cdr1_aa_3_0_ext", "cdr1_aa_0_5_ext", "cdr1_aa_-9_0_ext", "count_cdr_C", "count_fwr4_[A-Z]", "cdr3_aa_north"]
    aa = "ACDEFGHIKLMN"
    kinds = ["fr1", "cdr1", "fr2", "cdr2", "fr3", "cdr3", "cdr3_end"]
    cases = [(0, 2, 5, 6, 7, 8, 10), (0, 5, 2, 6, 7, 8, 12), (None, None, 5, 6, None, 9, 12), (0, 12, 12, 12, 12, 12, 12), (1, 1, 1, 1, 1, 1, 1)]
    rows = [(k, aa, "ACG" * len(aa), dict(zip(kinds, c))) for k, c in enumerate(cases)] + [(9, None, None, None)]
    df = spark.createDataFrame(rows, "id int, aa string, dna string, starts struct<" + ",".join(f"{k}:int" for k in kinds) + ">")
    got = {r.id: r for r in df.select("id", *(c.alias(n) for n, c in Q.planned(names, True).items())).collect()}
    for k, a, d, at in rows[:-1]:
        assert [got[k][n] for n in names] == [plain(n, a, d, at, None, None, None, True) for n in names]
    assert all(got[9][n] in (None, 0) for n in names)


def test_queries_for_every_chain_type(spark):
    from lymphframe.plans import more as P
    from lymphframe.sources import mapped as M

    sf = "/root/testdata/sf0.001"
    seq = F.concat(*(M.dna(F.concat("name", F.lit(t))) for t in ("", "a", "b", "c")))
    x = M.segments(spark, sf).select("name", seq.alias("dna")).withColumn("aa", S.translate(F.col("dna")))
    own = {}
    for chain in P.CHAINS:
        for r in x.select("name", "dna", "aa", R.starts(F.col("aa"), chain).alias("s")).collect():
            own[chain, r.name] = (r.aa, r.dna, r.s.asDict() | {"cdr3_end": len(r.aa) - 3})
    least = {}
    for _, n in own:
        least[len(n)] = min(n, least.get(len(n), n))
    for query, names in ((P.f07, P.COUNTED), (P.f09, P.SLICED), (P.f10, P.EXTENDED), (P.f11, P.NORTHERN)):
        got = query(spark, sf).collect()
        assert len(got) == len(own)
        for r in got:
            mine, ref = own[r.chain, r.name], own[r.chain, least[len(r.name)]]
            assert [r[n] for n in names] == [plain(n, *mine, *ref, r.chain in ("IGH", "TRB")) for n in names]
