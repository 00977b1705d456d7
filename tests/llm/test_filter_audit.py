from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest

from lymphframe.llm import filter_audit as A

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "A": len(words) < 100,
        "B": 100 * len(set(words)) < 80 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
        "E": doc_id is not None and least[text] is not None and doc_id > least[text],
    }


def brute(documents, labels):
    """Applies the filters one after the other to lists of documents, for each order."""
    least = {}
    for i, text, _ in documents:
        t = text or ""
        least[t] = min((x for x in (i, least.get(t)) if x is not None), default=None)
    tags = defaultdict(set)
    for i, q, t in labels:
        tags[i] |= {n for n, v in (("good", q), ("toxic", t)) if v == 1}
    parts = defaultdict(list)
    for i, text, lang in documents:
        parts[lang or ""].append((fails(text or "", i, least), tags[i] if i is not None else set()))
    out, sums = [], Counter()
    for part, rows in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left, gone = list(rows), []
            for step, f in enumerate(order, 1):
                now = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                alone = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                sums[part, f] += len(now)
                out.append([part, order, step, len(left), len(now), sum(r[0][f] for r in gone), alone, sum("good" in r[1] for r in now), sum("toxic" in r[1] for r in now)])
                gone += now
    return {tuple([*x, sums[x[0], x[1][x[2] - 1]]]) for x in out}


LONG = " ".join(f"w{i}" for i in range(120))
DOCUMENTS = [
    (1, LONG, "en"), (2, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (0, "short Text", "de"), (4, "short Text", "en"), (5, "", "en"), (6, None, "fr"), (7, None, None), (8, "a\u00a0b # c", ""),
    (9, "a b " * 200, "en"), (10, "A B " * 200 + "|", "en"), (11, LONG + " #", "fr"), (None, LONG, "en"), (None, "", None), (12, "x" * 300_000, "en"), (13, "word " * 60_000, "de"), (14, LONG.upper(), "en"), (14, "other", "en"),
    (15, " ".join(["a"] * 20 + [f"v{i}" for i in range(79)] + ["a"]), "en"), (16, "\x0b\x0c\t \r\n", "en"), (17, "ABCDEFGHIJ" + "é" * 90, "fr"), (18, "ABCDEFGHIJK" + "é" * 89, "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (5, None, 1), (6, 1, None), (7, 1, 1), (9, 0, 1), (9, 1, 0), (11, 1, 0), (None, 1, 1), (14, 1, 0), (99, 1, 1)]


def frames(spark, documents, labels):
    d = spark.createDataFrame(documents, "doc_id long, text string, lang string").selectExpr("*", "1 AS part", "2 AS n", "3 AS step", "4 AS mask", "5 AS id")
    return d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS lang", "1 AS tags")


def test_against_brute_force(spark):
    got = A.audit(A.masks(*frames(spark, DOCUMENTS, LABELS)))
    assert got.columns == COLUMNS
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) == 600 * 4 and set(rows) == brute(DOCUMENTS, LABELS)


def test_reference_sql_on_odd_rows(spark):
    d, y = frames(spark, DOCUMENTS, LABELS)
    db = duckdb.connect()
    db.register("documents", d.select("doc_id", "text", "lang").toArrow())
    db.register("labels", y.select("doc_id", "quality", "toxic").toArrow())
    assert set(db.sql(A.ORACLE).fetchall()) == brute(DOCUMENTS, LABELS)


def test_many_copies_and_many_parts(spark):
    documents = [(i, LONG if i % 3 else f"{LONG} {i}", f"l{i % 7}") for i in range(900)]
    rows = [tuple(r) for r in A.audit(A.masks(*frames(spark, documents, LABELS))).collect()]
    assert set(rows) == brute(documents, LABELS)


def test_empty_tables(spark):
    assert A.audit(A.masks(*frames(spark, [], []))).count() == 0
    assert {r.part for r in A.audit(A.masks(*frames(spark, DOCUMENTS[:3], []))).collect()} == {"en"}


def test_other_numbers_of_filters(spark):
    cells = spark.createDataFrame([("p", 3, 1, 5), ("p", 1, 0, 2), ("p", 0, 3, 4)], "part string, mask int, tags int, n long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in A.audit(cells, "xy").collect()}
    assert got == {("xy", 1): (4, 7, 0, 2, 5, 9), ("xy", 2): (4, 0, 5, 0, 0, 5), ("yx", 1): (6, 5, 0, 0, 5, 5), ("yx", 2): (4, 2, 5, 2, 0, 9)}
    with pytest.raises(ValueError):
        A.audit(cells, "abcdefgh")
