"""Annotation of sequences against plain local alignment and against known recombinations."""

from __future__ import annotations

import random
import re

from lymphframe.operators import annotate as X

HOW = X.Search()


def replay(contig, ref, got):
    """Score, mismatches and places that a CIGAR stands for."""
    score, start, end, ref_start, ref_end, wrong, cigar = got
    c = r = value = seen = 0
    r = ref_start
    for n, op in ((int(n), op) for n, op in re.findall(r"(\d+)([SMID])", cigar)):
        if op == "S":
            c += n
        elif op == "M":
            assert c >= start
            same = [contig[c + k] == ref[r + k] for k in range(n)]
            value += sum(HOW.match if s else HOW.mismatch for s in same)
            seen += n - sum(same)
            c, r = c + n, r + n
        else:
            value += HOW.gap_open + (n - 1) * HOW.gap_extend
            c, r = c + n * (op == "I"), r + n * (op == "D")
    assert c == len(contig) and r == ref_end and seen == wrong
    return value


def gotoh(contig, ref, low, high):
    """Best local score within a band, cell by cell with three states."""
    m, d, i = {}, {}, {}
    get = lambda t, c, r: t.get((c, r), -(10**9))
    top = 0
    for r in range(len(ref)):
        for c in range(r + low, r + high + 1):
            d[c, r] = max(max(get(m, c, r - 1), get(i, c, r - 1)) + HOW.gap_open, get(d, c, r - 1) + HOW.gap_extend)
            i[c, r] = max(max(get(m, c - 1, r), get(d, c - 1, r)) + HOW.gap_open, get(i, c - 1, r) + HOW.gap_extend)
            if 0 <= c < len(contig):
                m[c, r] = max(0, get(m, c - 1, r - 1), get(d, c - 1, r - 1), get(i, c - 1, r - 1)) + (HOW.match if contig[c] == ref[r] else HOW.mismatch)
                top = max(top, m[c, r])
    return top


def mutated(rng, s, k):
    s = list(s)
    for _ in range(k):
        at = rng.randrange(len(s))
        kind = rng.random()
        if kind < 0.7:
            s[at] = rng.choice("ACGT")
        elif kind < 0.85:
            del s[at : at + rng.randint(1, 3)]
        else:
            s[at:at] = [rng.choice("ACGT") for _ in range(rng.randint(1, 3))]
    return "".join(s)


def test_banded_extension_by_plain_states():
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    contigs, refs, bands = [], [], []
    for _ in range(60):
        ref = word(rng.randint(5, 40))
        lead = word(rng.randint(0, 12))
        contigs.append(lead + mutated(rng, ref, rng.randint(0, 5))[rng.randint(0, 3) :] + word(rng.randint(0, 9)))
        refs.append(ref)
        bands.append((len(lead) - rng.randint(0, 6), len(lead) + rng.randint(0, 6)))
    got = X.extended(contigs, refs, bands)
    for c, r, b, g in zip(contigs, refs, bands, got):
        assert g[0] == gotoh(c, r, *b)
        if g[0]:
            assert replay(c, r, g) == g[0]


def test_chains():
    assert X.chained([(0, 5, 4, 3), (10, 6, 3, 12), (14, 90, 5, 18), (20, 5, 2, 21)], 12) == (9, 5, 6)
    assert X.chained([(0, 5, 1, 0)], 12) == (1, 5, 5)
    # a run that steps back in the sequence isn't part of the chain
    assert X.chained([(0, 9, 3, 2), (4, 2, 2, 5)], 12)[0] == 3


SCHEMA = "id long, seq string"


def test_segments_in_order_and_strands(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    refs = {f"{k}{i}": word(n) for k, n in (("V", 120), ("J", 40), ("C", 90), ("U", 45)) for i in range(4)}
    turned = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    rows, truth = [], {}
    for k in range(40):
        pick = {t: f"{t}{rng.randrange(4)}" for t in "VJCU"}
        v, j, c, u = (refs[pick[t]] for t in "VJCU")
        body = mutated(rng, v[:110], 4)
        seq = u[20:] + body + word(9) + j[4:] + c[:50]
        rows.append((k, turned(seq) if k % 3 == 0 else seq.lower() if k % 5 == 0 else seq))
        truth[k] = {**pick, "strand": "-" if k % 3 == 0 else "+", "c_start": len(seq) - 50, "j_end": len(seq) - 50}
    rows += [(100, None), (101, ""), (102, "N" * 50), (103, word(200)), (104, refs["J1"] + refs["V2"]), (105, ("ACGT" * 40_000))]
    segments = spark.createDataFrame([(n, n[0], s) for n, s in refs.items()], "name string, kind string, seq string")
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS kind", "2 AS score", "3 AS word")
    got = {}
    for r in X.annotated(df, segments, both_strands=True).collect():
        assert (r.id, r.kind) not in got
        got[r.id, r.kind] = r
    for k, want in truth.items():
        for t in "VJCU":
            assert got[k, t].name == want[t] and got[k, t].strand == want["strand"]
        assert got[k, "C"].contig_start == want["c_start"] and abs(got[k, "J"].contig_end - want["j_end"]) <= 2
    # a J before V isn't in order
    assert (104, "V") in got and (104, "J") not in got
    assert not {i for i, _ in got} & {100, 101, 102, 103, 105}
    assert X.annotated(df.limit(0), segments).count() == 0 and X.annotated(df, segments.limit(0)).count() == 0


def test_large_index_is_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(X, "BROADCAST_WORDS", 10)
    rng = random.Random(6)
    v = "".join(rng.choice("ACGT") for _ in range(80))
    segments = spark.createDataFrame([("V1", "V", v)], "name string, kind string, seq string")
    got = X.annotated(spark.createDataFrame([(1, "AC" + v)], SCHEMA), segments).collect()
    assert [(r.name, r.contig_start, r.contig_end, r.cigar) for r in got] == [("V1", 2, 82, "2S80M")]


def test_query_finds_the_segments_that_contigs_were_made_of(spark):
    from lymphframe.plans import structures as Q
    from lymphframe.sources import mapped as M

    sf = "/root/testdata/sf0.001"
    truth = {r.id: r for r in M.contig_sequences(spark, sf).collect()}
    found = {(r.id, r.kind): r.name for r in Q.s29(spark, sf).collect()}
    right = sum(found.get((i, k)) == n for i, r in truth.items() for k, n in (("V", r.v_name), ("J", r.j_name), ("C", r.c_name)))
    assert right >= 0.99 * 3 * len(truth)
