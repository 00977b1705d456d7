from __future__ import annotations

import hashlib
import zlib

import duckdb
import pyarrow as pa
import pytest

from lymphframe.llm import merkle as K


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    values = [row[0], row[1], row[2], row[3], text]
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def walk(levels, i, sink, h):
    """Siblings of node i up the levels into sink; the top that h gives in its place."""
    for level in levels[:-1]:
        run = level[i // 16 * 16 : i // 16 * 16 + 16]
        sink += run[: i % 16] + run[i % 16 + 1 :]
        h = H(*run[: i % 16], h, *run[i % 16 + 1 :])
        i //= 16
    return h


def brute(rows):
    groups = {}
    for r in rows:
        hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        groups.setdefault(r[1], []).append((r[0], leaf(r, r[4]), leaf(r, low) if hit else None))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = [tree([x[1] for x in groups[n]]) for n in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, n in enumerate(names):
        for i, (doc, h, changed) in enumerate(groups[n]):
            sink = []
            folded = walk(top, k, sink2 := [], walk(trees[k], i, sink, changed or h))
            out.append((doc, h, trees[k][-1][0], top[-1][0], H(*sink, *sink2), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def run(spark, rows):
    df = K.proofs(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS i", "2 AS g", "3 AS leaf", "4 AS m", "5 AS path", "6 AS row", "7 AS part"))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(repr(tuple(r)) for r in df.collect())


def made(sizes):
    """Sources of given sizes, with nulls in all columns, capitals, letters of several bytes, repeated ids and rows."""
    rows, at = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            at += 1
            rows.append((at, s, None if at % 11 == 0 else "en", None if at % 13 == 0 else at, None if at % 7 == 0 else "" if at % 17 == 0 else f"Text ÄÉ {at} A" if at % 3 else f"text {at}"))
    return rows


SIZES = {"hot": 700, "b": 17, "c": 16, "Z": 1, "é": 3, None: 40, "": 2} | {f"s{k}": 1 + k % 3 for k in range(20)}


def test_against_plain_trees(spark):
    rows = made(SIZES)
    rows += [rows[0], rows[0], (5, "hot", "de", 1, "another"), (None, "hot", None, None, None), (None, "b", "x", 2, "Capital"), (99_000, "hot", "en", 300_000, "Aé" * 150_000)]
    got = run(spark, rows)
    assert got == brute(rows)
    verdicts = {r.rsplit(", ", 1)[1] for r in got}
    assert verdicts == {"True)", "False)"}  # tampering with capitals is found, all else holds


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 16}, {"a": 17}, {"a": 257}, {"a": 1, "b": 1}, {None: 1, "a": 300}, {f"s{k}": 1 for k in range(40)}])
def test_shapes(spark, sizes):
    rows = made(sizes)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_reference_sql_on_odd_rows():
    rows = made(SIZES)
    rows += [(5, "hot", "de", 1, "another"), (None, "hot", None, None, None)]
    db = duckdb.connect()
    kinds = [("doc_id", pa.int64()), ("source", pa.string()), ("lang", pa.string()), ("n_chars", pa.int64()), ("text", pa.string())]
    db.register("documents", pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(kinds)}))
    assert sorted(map(repr, db.sql(K.ORACLE).fetchall())) == brute(rows)


def test_numbers_come_without_one_task_for_a_hot_source(spark):
    """Rows of one source are numbered 0, 1, 2, ... over several partitions."""
    from lymphframe.operators.grouping import numbered_within

    rows = spark.range(0, 5000, 1, 8).selectExpr("id", "'x' AS g", "1 AS row", "2 AS part")
    out = numbered_within(rows, "g", ["id"], "i", "m")
    assert out.columns == ["id", "g", "row", "part", "i", "m"]
    assert all(r.i == r.id and r.m == 5000 and r.row == 1 and r.part == 2 for r in out.collect())
