"""Donor alleles, distances to them and chain columns against plain loops."""

from __future__ import annotations

import itertools
import random
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lymphframe.functions import sequence as S
from lymphframe.operators import alleles as Y
from lymphframe.operators import columns as L
from tests.test_operators import brute_components


def alleles(rows, trim=15, least=4, share=0.25):
    """{(donor, v_name, positions, letters): (cells, seq)} cell by cell."""
    groups = defaultdict(list)
    for donor, name, v, seq in rows:
        if seq is not None:
            groups[donor, name, v].append(seq)
    out = {}
    for (donor, name, v), seqs in groups.items():
        at = []
        for p in range(max(0, len(v) - trim)):
            seen = Counter(s[p] if p < len(s) else "-" for s in seqs)
            if any(b not in (v[p], "-") and n >= least and n >= share * len(seqs) for b, n in seen.items()):
                at.append(p)
        if not at:
            continue
        prints = Counter("".join(s[p] if p < len(s) else "-" for p in at) for s in seqs)
        for letters, n in prints.items():
            if n >= least and n >= share * len(seqs) and "-" not in letters and letters != "".join(v[p] for p in at):
                own = list(v)
                for p, b in zip(at, letters):
                    own[p] = b
                out[donor, name, tuple(at), letters] = (n, "".join(own))
    return out


def simulated(rng):
    """Donors with one to three alleles of a segment, mutated cells, rare letters, short and missing sequences."""
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = []
    for donor, name in itertools.product(("d1", "d2", None), ("V1", "V2")):
        v = word(60)
        kinds = [v]
        for _ in range(rng.randint(0, 2)):
            a = list(v)
            for p in rng.sample(range(60), 2):
                a[p] = rng.choice("ACGT")
            kinds.append("".join(a))
        for _ in range(rng.choice((3, 20, 60))):
            s = list(rng.choice(kinds) + word(20))
            for p in rng.sample(range(80), rng.randint(0, 3)):
                s[p] = rng.choice("ACGT")
            rows.append((donor, name, v, "".join(s)[: rng.choice((80, 80, 80, 30))]))
        rows.append((donor, name, v, None))
    return rows


def test_alleles_of_simulated_donors(spark):
    kind = "donor string, v_name string, v string, seq string"
    for seed in range(3):
        rows = simulated(random.Random(seed))
        df = spark.createDataFrame(rows, kind).selectExpr("*", "1 AS pos", "2 AS letters", "3 AS n")
        got = {(r.donor, r.v_name, tuple(r.positions), r.letters): (r.cells, r.seq) for r in Y.donor_alleles(df).collect()}
        assert got == alleles(rows)
    assert got and Y.donor_alleles(df.limit(0)).count() == 0


def plain_distance(seq, v, j, v_trim=15, j_trim=15):
    """(letters, residues), place by place."""
    z, letters = len(seq), 0
    for p in range(z):
        letters += p < len(v) - v_trim and seq[p] != v[p]
        letters += p >= z - (len(j) - j_trim) and seq[p] != j[len(j) - (z - p)]
    code = lambda c: S.CODE["TCAG".index(c[0]) * 16 + "TCAG".index(c[1]) * 4 + "TCAG".index(c[2])]
    aa = [code(seq[3 * k : 3 * k + 3]) for k in range(len(seq) // 3)]
    z, residues = 3 * len(aa) + 1, 0
    for p, r in enumerate(aa):
        if 3 * p + 3 <= len(v) - v_trim:
            residues += r != code(v[3 * p : 3 * p + 3])
        if 3 * p > z - (len(j) - j_trim) + 3:
            at = len(j) - (z - 3 * p)
            residues += r != code(j[at : at + 3])
    return letters, residues


def test_distances_place_by_place(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = []
    for k in range(60):
        v, j = word(rng.randint(20, 60)), word(rng.randint(16, 50))
        seq = list(v + word(rng.randint(0, 9)) + j)
        for p in rng.sample(range(len(seq)), 6):
            seq[p] = rng.choice("ACGT")
        rows.append((k, "".join(seq), v, j))
    df = spark.createDataFrame(rows, "id int, seq string, v string, j string")
    d, a = Y.distances(F.col("seq"), F.col("v"), F.col("j"))
    got = {r.id: (r.d, r.a) for r in df.select("id", d.alias("d"), a.alias("a")).collect()}
    assert got == {k: plain_distance(s, v, j) for k, s, v, j in rows}


def test_distances_of_long_sequences(spark):
    """Strings are translated once a row, not once a residue: these took minutes."""
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows = [(k, (v := word(1500)) + word(9) + (j := word(900)), v[:700] + word(800), j) for k in range(12)]
    df = spark.createDataFrame(rows, "id int, seq string, v string, j string")
    d, a = Y.distances(F.col("seq"), F.col("v"), F.col("j"))
    start = time.monotonic()
    got = {r.id: (r.d, r.a) for r in df.select("id", d.alias("d"), a.alias("a")).collect()}
    assert time.monotonic() - start < 30
    assert got == {k: plain_distance(s, v, j) for k, s, v, j in rows}


def test_distances_to_the_own_alleles(spark):
    v, j = "ACGTTGCA" * 8, "GGATCCTA" * 5
    own = v[:10] + "T" + v[11:30] + "A" + v[31:]
    rows = [(k, k // 2, "d1", "V1", v, j, (own if k % 2 else v) + "CC" + j) for k in range(40)] + [(50, 50, "d2", "V1", v, j, own + "CC" + j)]
    df = spark.createDataFrame(rows, "id int, exact int, donor string, v_name string, v string, j string, seq string")
    a = Y.donor_alleles(df)
    assert [(r.donor, r.seq) for r in a.collect()] == [("d1", own)]
    got = {r.exact: (r.dref, r.dref_max, r.dref_aa) for r in Y.donor_distances(df, a).collect()}
    away = plain_distance(own + "CC" + j, v, j)
    assert all(got[k] == (0, 0, 0) for k in range(20)) and got[50] == (2, 2, away[1])


def columns(chains, links):
    """{(exact, ix): class} by plain loops over links and pairs of chains."""
    by = defaultdict(list)
    for cl, e, ix, left, seq, size in chains:
        by[e].append((ix, left, seq, size, cl))
    diff = lambda a, b: sum(x != y for x, y in zip(a, b))
    name = lambda e, c: f"{e}:{c[0]}"
    edges = []
    for a, b in links:
        used = set()
        for left in (True, False):
            found = [(diff(c[2], d[2]), name(a, c), name(b, d)) for c in by[a] for d in by[b] if c[1] == d[1] == left and len(c[2]) == len(d[2]) and c[3] == d[3]]
            if found:
                edges.append(min(found)[1:])
                used |= set(min(found)[1:])
        if len(by[a]) >= 3 and len(by[b]) >= 3:
            edges += [(name(a, c), name(b, d)) for c in by[a] for d in by[b] if c[1] == d[1] and len(c[2]) == len(d[2]) and diff(c[2], d[2]) <= 10 and not {name(a, c), name(b, d)} & used]
    nodes = [(e, c) for e, cs in by.items() for c in cs]
    edges += [(name(*x), name(*y)) for x, y in itertools.combinations(nodes, 2) if x[1][4] == y[1][4] and x[1][1] == y[1][1] and x[1][2] == y[1][2]]
    label = brute_components(edges) if edges else {}
    return {(e, c[0]): label.get(name(e, c), name(e, c)) for e, c in nodes}


def same_partition(got, want):
    return len(set(got.items())) == len(want) and len({(got[k], want[k]) for k in want}) == len(set(got.values())) == len(set(want.values()))


def test_columns_of_swapped_and_further_chains(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    near = lambda s, k: "".join(rng.choice("ACGT") if p in set(rng.sample(range(len(s)), k)) else c for p, c in enumerate(s))
    chains, links = [], []
    for cl in range(6):
        heavy, light, third = word(60), word(50), word(55)
        for e in range(cl * 10, cl * 10 + 6):
            parts = [(True, near(heavy, 3), 9), (False, near(light, 2), 7)]
            parts += [(False, near(third, rng.choice((4, 20))), 5)] * (rng.random() < 0.6)
            if rng.random() < 0.3:
                parts = [(True, heavy, 9)] if rng.random() < 0.5 else parts[1:2]
            rng.shuffle(parts)
            chains += [(cl, e, ix, *p) for ix, p in enumerate(parts)]
        links += [(e, e + 1) for e in range(cl * 10, cl * 10 + 5) if rng.random() < 0.8]
    df = spark.createDataFrame(chains, "clonotype long, exact long, ix int, left boolean, seq string, cdr3_len int")
    got = {(r.exact, r.ix): (r.clonotype, r.col) for r in L.chain_columns(df, spark.createDataFrame(links, "src long, dst long")).collect()}
    assert same_partition(got, columns(chains, links))
    # columns count from 1 and heavy ones come first
    for cl in range(6):
        sides = sorted({(got[e, ix][1], left) for c, e, ix, left, *_ in chains if c == cl})
        assert [k for k, _ in sides] == list(range(1, len(sides) + 1)) and [s for _, s in sides] == sorted((s for _, s in sides), reverse=True)


def test_queries_on_the_mapped_chains(spark):
    from lymphframe.plans import structures as Q
    from lymphframe.sources import mapped as M

    sf = "/root/testdata/sf0.001"
    one = {}
    for r in sorted(M.donor_chains(spark, sf).collect(), key=lambda r: r.id):
        one.setdefault((r.donor, r.v_name, r.j_name, r.cdr3_len), (r.donor, r.v_name, r.v, r.seq))
    got = {(r.donor, r.v_name, tuple(map(int, r.positions.split(","))), r.letters): (r.cells, r.seq) for r in Q.r01f(spark, sf).collect()}
    assert got == alleles(list(one.values()))
    assert Q.f12a(spark, sf).count() == 25
