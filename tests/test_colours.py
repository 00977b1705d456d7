from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lymphframe.functions import colours as Z
from lymphframe.functions.sequence import CODE
from lymphframe.operators import plots as P


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


def test_properties_and_codons(spark):
    assert one(spark, Z.by_property(F.col("aa")), aa="AGILPVFWYDERHKSTCMNQ*X-") == "11111122233444556677..."
    assert one(spark, Z.by_property(F.col("aa").cast("string")), aa=None) is None
    places = Z.synonym_places()
    by = defaultdict(list)
    for i, codon in enumerate(a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"):
        by[CODE[i]].append(codon)
    assert places == {c: k for v in by.values() for k, c in enumerate(sorted(v))}
    assert one(spark, Z.by_codon(F.col("s")), s="GCAGCCATGNNNTTTA") == "010.1"
    assert one(spark, Z.codons(F.col("s")), s="AC") == [] and one(spark, Z.codons(F.col("s")), s="") == []


def test_consensus_and_highlights_against_loops(spark):
    rng = random.Random(4)
    rows = []
    for g in range(12):
        n = rng.randint(1, 7)
        lead = "".join(rng.choice("ACGT") for _ in range(36))
        for k in range(n):
            s = list(lead)
            for _ in range(rng.randint(0, 6)):
                s[rng.randrange(36)] = rng.choice("ACGT")
            rows.append((g, f"{g}/{k}", "".join(s), lead[: rng.choice((36, 30, 31))]))
    x = spark.createDataFrame(rows, "g long, id string, seq string, ref string")
    con = Z.codon_consensus(x.withColumn("cdr3", F.substring("seq", 13, 12)), ["g"])
    want = {}
    for g in range(12):
        mine = [r[2][12:24] for r in rows if r[0] == g]
        want[g] = "".join(c if 2 * n > len(mine) else "XXX" for i in range(0, 12, 3) for c, n in [max(Counter(m[i : i + 3] for m in mine).items(), key=lambda t: t[1])])
    assert {r.g: r.consensus for r in con.collect()} == want
    shown = x.join(con, "g").select("id", Z.codon_highlights(F.col("seq"), F.col("ref"), F.lit(13), F.lit(12), F.col("consensus")).alias("shown"))
    got = {r.id: r.shown for r in shown.collect()}
    for g, name, seq, ref in rows:
        line = ""
        for i in range(0, 36, 3):
            differs = any(k < len(ref) and seq[k] != ref[k] for k in range(i, i + 3))
            if 12 <= i < 24 and seq[i : i + 3] != want[g][i - 12 : i - 9]:
                differs = True
            line += "+" if differs else "-"
        assert got[name] == line


def test_consensus_without_chains(spark):
    kind = "g long, cdr3 string"
    assert Z.codon_consensus(spark.createDataFrame([], kind), ["g"]).count() == 0
    got = Z.codon_consensus(spark.createDataFrame([(1, None), (1, "AAACCC"), (1, "AAA"), (2, "")], kind), ["g"]).collect()
    assert [tuple(r) for r in got] == [(1, "AAACCC")]
    assert one(spark, Z.codon_highlights(F.col("s"), F.col("s"), F.lit(1), F.lit(6), F.col("c").cast("string")), s="AAACCC", c=None) == "--"


def test_peer_colours_against_loops(spark):
    rng = random.Random(5)
    peers = [(g, p, a, rng.randint(1, 30)) for g in (1, 2) for p in range(1, 6) for a in rng.sample("ACDEF", 3)]
    chains = [(k, rng.randint(1, 3), "".join(rng.choice("ACDEF") for _ in range(rng.randint(0, 7)))) for k in range(60)]
    got = Z.peer_colours(spark.createDataFrame(chains, "id long, g long, aa string"), spark.createDataFrame(peers, "g long, pos long, residue string, n long"), "id", "g", 20)
    want = {}
    for k, g, aa in chains:
        line = ""
        for p, a in enumerate(aa, 1):
            here = {x[2]: x[3] for x in peers if x[:2] == (g, p)}
            rare = here and 100 * here.get(a, 0) <= 20 * sum(here.values())
            line += "k" if not rare else "b" if here.get(a) else "r"
        if aa:
            want[k] = line
    assert {r.id: r.colours for r in got.collect()} == want and {"k", "b", "r"} <= set("".join(want.values()))


def test_value_colours(spark):
    rows = [(1, "3"), (2, "7"), (3, "x"), (4, None), (5, "NaN"), (6, "Infinity"), (7, "100"), (8, "-1")]
    df = spark.createDataFrame(rows, "cell long, x string")
    got = {r.cell: r.colour for r in P.value_colour(df, "x", high=7).collect()}
    assert got == {1: "turbo-pre-128", 2: "turbo-pre-255", 3: "undefined", 4: "undefined", 5: "undefined", 6: "undefined", 7: "turbo-pre-255", 8: "turbo-pre-0"}
    same = spark.createDataFrame([(1, 5.0, 0), (2, 5.0, 0)], "x long, v double, lo int")
    r = P.value_colour(same, "v").collect()
    assert [t.colour for t in r] == ["turbo-pre-0"] * 2 and r[0].asDict().keys() == {"x", "v", "lo", "colour"}
    assert P.value_colour(df.limit(0), "x").count() == 0


def test_other_colours(spark):
    iso = lambda *c: one(spark, P.isotype_colour(F.array(*map(F.lit, c)).cast("array<string>"), ["IGHM", "IGHA"]))
    assert [iso("IGHM"), iso("IGHA", "IGHA"), iso("IGHA", "IGHM"), iso(), iso(None), iso("IGKC"), iso("IGHA", None)] == ["2", "1", "0", "0", "0", "0", "0"]
    assert one(spark, P.isotype_colour(F.array(F.lit("IGHM")), ["IGHM"], ["grey", "pink"])) == "pink"
    marks = [one(spark, P.mark_colour(F.lit(a), F.lit(b))) for a in (True, False) for b in (True, False)]
    assert marks == ["rgb(255,200,200)", "red", "rgb(200,200,255)", "blue"]
    assert one(spark, P.dataset_colour(F.col("i")), i=258) == "default-pre-2"
    given = lambda o, d, b, **k: one(spark, P.assigned_colour(F.lit(o), F.lit(d), F.lit(b), **k))
    assert given("o", "d", "b") == "b" and given("o", "d", None) == "black" and given("o", "d", "b", datasets={"d": "x"}) == "x"
    assert given("o", "d", "b", origins={"p": "y"}, datasets={"d": "x"}) == "black" and given("o", "d", "b", origins={"o": "y"}, datasets={"d": "x"}) == "y"


@pytest.mark.parametrize("symmetric", [False, True])
def test_axis_ranges(spark, symmetric):
    def wanted(v):
        low, high = min(v), max(v)
        near = low > 0 and high > low and low / (high - low) < 0.02
        return 0.0 if near else low * (0.98 if low > 0 else 1.02), high * (1.02 if high > 0 else 0.98)

    for xs, ys in [((1, 200), (5, 9)), ((-4, -2), (0, 3)), ((3, 3), (-1, 0)), ((0.5, 10), (7, 7))]:
        r = P.axis_ranges(spark.createDataFrame([(float(a), float(b)) for a, b in zip(xs, ys)], "px double, py double"), symmetric).first()
        (a, b), (c, d) = wanted(xs), wanted(ys)
        want = (min(a, c), max(b, d), min(a, c), max(b, d)) if symmetric else (a, b, c, d)
        assert all(math.isclose(g, w, abs_tol=1e-12) for g, w in zip(r, want))
    empty = P.xy_points(spark.createDataFrame([("a", "1"), ("-1", "2"), (None, "3"), ("0", "4")], "x string, y string"), "x", "y", log_x=True)
    assert empty.count() == 0 and P.axis_ranges(empty, symmetric).count() == 0
    some = P.xy_points(spark.createDataFrame([("100", "1"), ("-1", "2")], "x string, y string"), "x", "y", log_x=True).collect()
    assert [(r.px, r.py) for r in some] == [(2.0, 1.0)]
