from __future__ import annotations

import random
import statistics
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lymphframe.functions import umis as U

CHAIN = "cell long, heavy boolean, umi long, validated_umis array<string>"


def test_variables(spark):
    kind = "barcode string, validated_umis array<string>, non_validated_umis array<string>, invalidated_umis array<string>"
    df = spark.createDataFrame([("AC-1", ["G", "T"], [], None), ("CC", None, ["A"], ["A", "C"])], kind)
    rows = [r.asDict() for r in df.select(*(U.umi_variable(v).alias(v) for v in U.VARIABLES)).collect()]
    assert rows[0] == {"nval": 2, "nnval": 0, "nival": 0, "valumis": "G,T", "nvalumis": "", "ivalumis": "", "valbcumis": "ACG,ACT", "nvalbcumis": "", "ivalbcumis": ""}
    assert rows[1] == {"nval": 0, "nnval": 1, "nival": 2, "valumis": "", "nvalumis": "A", "ivalumis": "A,C", "valbcumis": "", "nvalbcumis": "CCA", "ivalbcumis": "CCA,CCC"}
    with pytest.raises(ValueError):
        U.umi_variable("umis")


def test_qualities(spark):
    q = lambda text, at: spark.range(1).select(F.lit(text).alias("q")).select(U.quality_at(F.col("q").cast("string"), at).alias("x")).first().x
    assert [q("!I", 0), q("!I", 1), q("!I", 2), q("", 0), q(None, 0)] == [0, 40, None, None, None]
    with pytest.raises(ValueError):
        U.quality_at(F.col("q"), -1)


def test_validated_statistics_against_loops(spark):
    rng = random.Random(6)
    rows = [(c, k % 2 == 0, rng.randint(4, 9), ["A"] * rng.randint(0, 4)) for c in range(80) for k in range(rng.randint(1, 3))]
    got = U.validated_statistics(spark.createDataFrame(rows, CHAIN)).collect()
    cells = defaultdict(list)
    for c, _, _, v in rows:
        cells[c].append(len(v))
    two = [v for v in cells.values() if len(v) == 2]
    want = []
    for side in (True, False):
        mine = [r for r in rows if r[1] is side]
        want += [statistics.median(len(r[3]) for r in mine), 100 * sum(len(r[3]) for r in mine) / sum(r[2] for r in mine)]
    want.append(100 * sum(min(v) > 0 for v in two) / len(two))
    assert len(got) == 1 and list(got[0]) == pytest.approx(want)


def test_validated_statistics_without_a_row(spark):
    ok = [(1, True, 5, ["A"]), (2, False, 5, [])]
    assert U.validated_statistics(spark.createDataFrame(ok, CHAIN)).first().both_percent is None
    for rows in ([], ok[:1], [*ok, (3, True, 1, None)]):
        assert U.validated_statistics(spark.createDataFrame(rows, CHAIN)).count() == 0


def counted(rows):
    """The figures by plain loops over clonotypes and cells."""
    out = Counter()
    by = defaultdict(list)
    for r in rows:
        by[r[0]].append(r)
    for cells in by.values():
        n, freq = len(cells), Counter(r[1] for r in cells).most_common()
        own = freq[0][0] if len(freq) == 1 or freq[0][1] >= 10 * freq[1][1] else None
        alone = len(freq) == 1 or freq[0][1] >= 10 * freq[1][1]
        fake = n >= 10 and alone
        marked = [r for r in cells if r[3]]
        good = [r for r in cells if r[4] and r[2] in (2, 3)]
        if n >= 2:
            out["dubious"] += sum((alone and r[1] == own) or not r[4] for r in cells)
        out["marked"] += len(marked)
        out["marked_good"] += sum(r in marked for r in good) if len(freq) > 1 else 0
        if fake:
            out["fake"] += n - 1
            out["fake_marked"] += len(marked) - (len(marked) == n)
            out["good"] += 1
        elif n >= 10:
            out["good"] += len(good)
            out["good_marked"] += sum(bool(r[3]) for r in good)
    out["residual"] = out["fake"] - out["fake_marked"]
    return {k: out[k] for k in ("dubious", "marked", "marked_good", "fake", "fake_marked", "residual", "good", "good_marked")}


CELL = "clonotype long, dataset string, nchains long, marked boolean, b boolean"


def test_marking_statistics_against_loops(spark):
    rng = random.Random(7)
    rows = []
    for k in range(40):
        share, every = rng.choice((0.0, 0.05, 0.4)), rng.random() < 0.3
        rows += [(k, "y" if rng.random() < share else "x", rng.randint(1, 4), every or rng.random() < 0.3, rng.choice((True, True, False, None))) for _ in range(rng.choice((1, 2, 9, 10, 11, 25, 40)))]
    got = U.marking_statistics(spark.createDataFrame(rows, CELL)).first().asDict()
    want = counted(rows)
    assert got == want and all(want.values())


def test_marking_statistics_edges(spark):
    assert set(U.marking_statistics(spark.createDataFrame([], CELL)).first()) == {0}
    for n in (1, 2, 9, 10):
        rows = [(1, None if n == 2 else "x", 2, True, True)] * n
        assert U.marking_statistics(spark.createDataFrame(rows, CELL)).first().asDict() == counted(rows)
