from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import pytest

from lymphframe.operators import columns as L
from lymphframe.plans import structures

HEAVY = "clonotype long, col long, d string"


def by_pairs(rows):
    by = defaultdict(list)
    for c, k, d in rows:
        by[c, k].append(d)
    pairs = [p for v in by.values() for p in combinations(v, 2)]
    return len(pairs), sum(a != b for a, b in pairs)


def by_clonotype(rows):
    out = {}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        ds = [r[2] for r in mine]
        out[c] = (any(len({r[2] for r in mine if r[1] == k}) > 1 for k in {r[1] for r in mine}), "" in ds, any(d and ":" in d for d in ds))
    return out


def test_against_pairs(spark):
    rng = random.Random(8)
    rows = [(c, rng.randint(1, 2), rng.choice(("a", "b", "", "a:b", None))) for c in range(25) for _ in range(rng.randint(1, 6))]
    rows += [(100, 1, "a")] * 5 + [(101, 1, None)] * 2 + [(102, 1, "a"), (102, 2, "b"), (None, 1, "a"), (None, 1, "b")]
    df = spark.createDataFrame(rows, HEAVY)
    n, bad = by_pairs(rows)
    got = L.d_inconsistency(df).first()
    assert got.d_inconsistent_n == n and got.d_inconsistent_pct == pytest.approx(100 * bad / n, abs=0.0051)
    found = L.d_conditions(df).collect()
    assert {r.clonotype: tuple(r)[1:] for r in found} == by_clonotype(rows) and len(found) == 29


def test_none_and_one(spark):
    none, one = spark.createDataFrame([], HEAVY), spark.createDataFrame([(1, 1, "a")], HEAVY)
    assert [tuple(L.d_inconsistency(x).first()) for x in (none, one)] == [(0, None)] * 2
    assert L.d_conditions(none).count() == 0 and [tuple(r) for r in L.d_conditions(one).collect()] == [(1, False, False, False)]


def test_joined_clonotypes(spark):
    """The two queries against loops over the chains they are made of."""
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in structures.heavy_columns(spark, sf).collect()]
    n, bad = by_pairs(rows)
    got = structures.a36d(spark, sf).first()
    assert n > 0 and got.d_inconsistent_n == n and got.d_inconsistent_pct == pytest.approx(100 * bad / n, abs=0.0051)
    assert {r.clonotype: tuple(r)[1:] for r in structures.p12d(spark, sf).collect()} == by_clonotype(rows)
