"""Search for a penalty matrix of residues under which near heavy chains of different donors share their light chain.

Pairs of one V segment and CDR3 length are reduced to the substitutions they show; equal ones are
counted together and written once. A step changes two penalties of the matrix and counts the pairs of
high identity under it; proposals that would be tried on one matrix are counted together in one
aggregate, and the first that is better is taken, as if they were tried one by one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lymphframe.session import stage

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Penalties are in tenths; a pair counts if their sum is at most a tenth of its length, and a matrix if this share of its pairs has one light chain.
TENTHS, HIGHEST, LEAST_SHARE = 10, 80, 0.75
#: Rows of a tile's side in which pairs are compared.
TILE = 1024
PAIRS = pa.schema([("size", pa.int32()), ("subs", pa.list_(pa.int32())), ("same", pa.bool_()), ("n", pa.int64())])


@dataclass
class Search:
    """Where a search stands: it goes on from here with climb() as if it had never stopped."""

    matrix: np.ndarray = field(default_factory=lambda: TENTHS * (1 - np.eye(20, dtype=np.int64)))
    best: int = 0
    step: int = 0
    seed: int = 0


def proposal(seed: int, step: int, matrix: np.ndarray) -> np.ndarray | None:
    """The matrix that step tries: one penalty times, another by up to two, in tenths, HIGHEST at most; None if a pair of residues drawn is one residue. Step 1 is the matrix itself."""
    if step == 1:
        return matrix
    rng = np.random.default_rng([seed, step])
    times = 1 + rng.random()
    a, b, c, d = map(int, rng.integers(0, 20, 4))
    if a == b or c == d:
        return None
    out = matrix.astype(np.float64)
    for (i, j), by in (((a, b), times), ((c, d), 1 / times)):
        out[i, j] = out[j, i] = min(out[i, j] * by, HIGHEST)
    return np.floor(out + 0.5).astype(np.int64)


def _different(left: pa.Table, right: pa.Table, least: int) -> pa.Table:
    """substitutions() of the pairs of two tables, or of one if right is it; pairs that can't count at penalties of `least` or more are left out."""
    one = left is right
    letters = lambda t: np.array([[RESIDUES.index(c) for c in x] for x in t.column("cdr3").to_pylist()], np.int32).reshape(t.num_rows, -1)
    known: dict = {}
    names = lambda t, c: np.array([known.setdefault((c, x), len(known)) for x in t.column(c).to_pylist()], np.int64)
    a, b = letters(left), letters(right)
    (da, la), (db, lb) = ((names(t, "donor"), names(t, "light")) for t in (left, right))
    na, nb = (t.column("n").to_numpy() for t in (left, right))
    size, step = a.shape[1], max(1, (1 << 22) // max(1, b.size))
    out = []
    for at in range(0, len(a), step):
        apart = a[at : at + step, None, :] != b[None, :, :]
        counts = apart.sum(axis=2)
        keep = (counts * least <= size) & (da[at : at + step, None] != db[None, :])
        if one:
            keep &= np.arange(at, at + len(apart))[:, None] < np.arange(len(b))[None, :]
        i, j = np.nonzero(keep)
        x, y, off = a[at + i], b[j], apart[i, j]
        code = np.sort(np.where(off, np.minimum(x, y) * 20 + np.maximum(x, y), 400), axis=1)
        ends = np.concatenate([[0], np.cumsum(counts[i, j])]).astype(np.int32)
        subs = pa.ListArray.from_arrays(pa.array(ends), pa.array(code[code < 400].astype(np.int32)))
        out.append(pa.table({"size": pa.array(np.full(len(i), size, np.int32)), "subs": subs, "same": pa.array(la[at + i] == lb[j]), "n": pa.array(na[at + i] * nb[j])}))
    return pa.concat_tables(out)


def substitutions(chains: DataFrame, least: int = 0) -> DataFrame:
    """(size, subs, same, n): pairs of different donors in one block, by length, sorted substitutions (20 i + j, i < j) and whether the light chain is the same.

    chains: (block, donor, light, cdr3); CDR3s of one block and length are compared. Chains alike in all
    four are one row with a count, so a hot group of copies makes no pairs. Letters other than the
    twenty residues leave a chain out. least: pairs with more substitutions than could count where none
    costs less than this are left out. Blocks are compared in tiles of TILE by TILE rows.
    """
    x = chains.where(F.col("cdr3").rlike(f"^[{RESIDUES}]+$") & F.col("donor").isNotNull()).groupBy("block", "donor", "light", "cdr3").agg(F.count("*").alias("n"))
    x = x.select(F.coalesce(F.col("block").cast("string"), F.lit("")).alias("key"), F.col("block").isNull().alias("none"), "donor", "light", "cdr3", "n", F.length("cdr3").alias("len"))
    x = stage(x, "chains")
    tiles = x.groupBy("key", "none", "len").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    x = x.join(tiles, ["key", "none", "len"]).withColumn("tile", F.pmod(F.xxhash64("donor", "light", "cdr3"), F.col("tiles")).cast("int"))
    first = x.withColumn("p", F.col("tile")).withColumn("q", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)))
    second = x.withColumn("q", F.col("tile")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("tile")))).where("p < q")
    first, second = (t.select(*(F.col(c).alias(c) for c in ("key", "none", "len", "p", "q", "donor", "light", "cdr3", "n"))) for t in (first, second))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if a.num_rows and a.column("p")[0].as_py() == a.column("q")[0].as_py():
            return _different(a, a, least)
        return _different(a, b, least) if a.num_rows and b.num_rows else PAIRS.empty_table()

    tile = ["key", "none", "len", "p", "q"]
    rows = first.groupBy(*tile).cogroup(second.groupBy(*tile)).applyInArrow(run, "size int, subs array<int>, same boolean, n long")
    return rows.groupBy("size", "subs", "same").agg(F.sum("n").alias("n"))


def counted(pairs: DataFrame, matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(pairs with one light chain, all) of high identity under each matrix, in one aggregate."""

    def total(cost: Column) -> Column:
        return F.aggregate("subs", F.lit(0).cast("long"), lambda s, c: s + F.element_at(cost, c + 1).cast("long"))

    out = []
    for k, m in enumerate(matrices):
        near = total(F.lit(m.ravel().tolist())) <= F.col("size")
        out += [F.sum(F.when(near & F.col("same"), F.col("n")).otherwise(0)).alias(f"s{k}"), F.sum(F.when(near, F.col("n")).otherwise(0)).alias(f"n{k}")]
    r = pairs.agg(*out).first()
    return [(r[2 * k] or 0, r[2 * k + 1] or 0) for k in range(len(matrices))]


def climb(pairs: DataFrame | Callable[[int], DataFrame], search: Search, steps: int, together: int = 8) -> Search:
    """The search after so many more steps; the number of pairs of high identity never falls while their share of one light chain stays at LEAST_SHARE or more.

    pairs: substitutions(), or a function that gives those which can count where no penalty is less than a number.
    """
    matrix, best, step, end = search.matrix, search.best, search.step, search.step + steps
    while step < end:
        tried = [(s, p) for s in range(step + 1, min(end, step + together) + 1) if (p := proposal(search.seed, s, matrix)) is not None]
        last = min(end, step + together)
        least = min((int(p[~np.eye(20, dtype=bool)].min()) for _, p in tried), default=0)
        found = counted(pairs(least) if callable(pairs) else pairs, [p for _, p in tried]) if tried else []
        for (s, p), (same, n) in zip(tried, found):
            if n > best and same >= LEAST_SHARE * n:
                matrix, best, last = p, n, s
                break
        step = last
    return Search(matrix, best, step, search.seed)


def penalty_matrix(chains: DataFrame, steps: int, seed: int = 0) -> Search:
    """climb() from a matrix of ones.

    Most pairs differ too much to count under any matrix tried: those alone are written that can where
    penalties are half of one or more, and once more if a proposal has a lower one.
    """
    made: list = []

    def near(least: int) -> DataFrame:
        if not made or made[0] > least:
            bound = TENTHS // 2 if least >= TENTHS // 2 else least // 2
            made[:] = [bound, stage(substitutions(chains, bound), "pairs")]
        return made[1]

    return climb(near, Search(seed=seed), steps)
