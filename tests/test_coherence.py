"""The search for a penalty matrix against plain loops; like colours brought together."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np

from lymphframe.operators import coherence as H
from lymphframe.operators import plots as P

SCHEMA = "block string, donor string, light string, cdr3 string"


def chains(rng, n=120):
    bases = ["".join(rng.choice("ACDEFG") for _ in range(12)) for _ in range(4)]  # few residues, so that steps matter
    rows = []
    for _ in range(n):
        k = rng.randrange(4)
        s = list(bases[k])
        for p in rng.sample(range(12), rng.randint(0, 3)):
            s[p] = rng.choice("ACDEFG")
        rows.append(("V1" if k % 2 else "V2", f"d{rng.randrange(3)}", f"L{k}" if rng.random() < 0.95 else "L9", "".join(s)))
    return rows + rows[:5] + [("V1", "d1", "L1", None), ("V1", "d1", "L1", "AXB*"), ("V1", "d2", None, "A" * 12), (None, "d1", "L1", "C" * 12), (None, "d2", "L1", "C" * 12)]


def plain(rows, steps, seed=0):
    """One step after the other, all pairs each time."""
    rows = [r for r in rows if r[3] and set(r[3]) <= set(H.RESIDUES)]
    pairs = [(a, b) for a, b in itertools.combinations(rows, 2) if a[0] == b[0] and len(a[3]) == len(b[3]) and a[1] != b[1]]
    matrix, best, told = 10 * (1 - np.eye(20, dtype=int)), 0, []
    for step in range(1, steps + 1):
        p = H.proposal(seed, step, matrix)
        if p is None:
            continue
        same = n = 0
        for a, b in pairs:
            if sum(p[H.RESIDUES.index(x), H.RESIDUES.index(y)] for x, y in zip(a[3], b[3])) <= len(a[3]):
                n += 1
                same += a[2] == b[2]
        if n > best and same >= 0.75 * n:
            matrix, best = p, n
            told.append(n)
    return matrix, best, told


def test_search_step_by_step(spark):
    rows = chains(random.Random(1))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS size", "2 AS n")
    matrix, best, told = plain(rows, 70, 3)
    got = H.penalty_matrix(df, 70, 3)
    assert (got.matrix == matrix).all() and got.best == best and got.step == 70
    assert len(told) > 2 and told == sorted(told) and (got.matrix == got.matrix.T).all() and (np.diag(got.matrix) == 0).all()
    # stopped and taken up again, in other batches
    pairs = H.substitutions(df)
    half = H.climb(pairs, H.Search(seed=3), 17, 5)
    rest = H.climb(pairs, half, 53, 9)
    assert (rest.matrix == matrix).all() and rest.best == best


def test_pairs_of_copies_are_counted(spark):
    rows = [("V", "d1", "L1", "ACD")] * 30 + [("V", "d2", "L1", "ACE")] * 20 + [("V", "d2", "L2", "ACD")]
    got = sorted(tuple(r) for r in H.substitutions(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == sorted([(3, [2 * 20 + 3], True, 600), (3, [], False, 30)])
    assert H.penalty_matrix(spark.createDataFrame([], SCHEMA), 3).best == 0


def test_few_pairs_are_written(spark, monkeypatch):
    """Of a block's pairs only near ones are written; they are those that all pairs would leave, in tiles of any size."""
    rng = random.Random(6)
    rows = [("V1", f"d{k % 3}", f"L{k % 5}", "".join(rng.choice(H.RESIDUES) for _ in range(10))) for k in range(90)] + chains(rng, 60)
    df = spark.createDataFrame(rows, SCHEMA)
    plainly = lambda x: sorted((r["size"], tuple(r.subs), r.same, r.n) for r in x.collect())
    every = plainly(H.substitutions(df))
    monkeypatch.setattr(H, "TILE", 16)
    assert plainly(H.substitutions(df)) == every
    near = plainly(H.substitutions(df, 5))
    assert near == [r for r in every if 5 * len(r[1]) <= r[0]] and 0 < 3 * len(near) < len(every)
    matrix, best, _ = plain(rows, 40)
    got = H.penalty_matrix(df, 40)
    assert (got.matrix == matrix).all() and got.best == best


def test_like_colours_together(spark):
    rng = random.Random(2)
    rows = [(k, rng.choice((1, 1, 1, 3)), rng.choice(("red", "blue", "green", None)), *P.hex_place(k), rng.choice(("o1", "o2", None))) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, size int, colour string, x double, y double, part string").selectExpr("*", "1 AS k", "2 AS key")

    def plain(split):
        out = {r[0]: r[3:5] for r in rows if r[2] is None}
        groups = {}
        for r in rows:
            if r[2] is not None:
                groups.setdefault((r[1], r[5] if split else 0), []).append(r)
        for g in groups.values():
            places = sorted(g, key=lambda r: (math.floor(math.atan2(r[4], r[3]) * 1e9 + 0.5), r[0]))
            for r, p in zip(sorted(g, key=lambda r: (r[2], r[0])), places):
                out[r[0]] = p[3:5]
        return out

    for split in (False, True):
        got = P.relocated(df, "part" if split else None)
        assert got.columns == df.columns
        at = {r.id: (r.x, r.y) for r in got.collect()}
        assert at == plain(split) and sorted(at.values()) == sorted(r[3:5] for r in rows)
