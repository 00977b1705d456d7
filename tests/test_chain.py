"""The filter chain, amino requests, sequence patterns, layouts and peer groups on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lymphframe.functions import amino as A
from lymphframe.functions import conditions as C
from lymphframe.operators import filters as K
from lymphframe.operators import grouping as G
from lymphframe.operators import plots as P
from lymphframe.sources import convert, sinks
from lymphframe.sources import readers as R


def ran(spark, rows, steps, off=()):
    cells = spark.createDataFrame(rows, "cell long, g string, umi int")
    return {r.cell: r.filter for r in K.run_chain(cells, steps, off).collect()}


STEPS = [K.Step("LOW", "NLOW", "umi < 3"), K.Step("DUP", "NDUP", K.duplicated(["g"])), K.Step("CELL", "NCELL", "umi > 90")]
ROWS = [(1, "a", 1), (2, "a", 5), (3, "b", 6), (4, "b", 7), (5, None, 8), (6, None, 9), (7, "c", None), (8, "d", 99)]


def test_steps_see_what_is_left(spark):
    # 2 isn't a duplicate, as 1 is gone before; null groups and null values are never removed
    assert ran(spark, ROWS, STEPS) == {1: "LOW", 2: None, 3: "DUP", 4: "DUP", 5: None, 6: None, 7: None, 8: "CELL"}


def test_switches(spark):
    assert ran(spark, ROWS, STEPS, ["NLOW"]) == {1: "DUP", 2: "DUP", 3: "DUP", 4: "DUP", 5: None, 6: None, 7: None, 8: "CELL"}
    assert set(ran(spark, ROWS, STEPS, ["NALL"]).values()) == {None}
    assert ran(spark, ROWS, STEPS, ["NALL_CELL"])[8] == "CELL" and ran(spark, ROWS, STEPS, ["NALL_CELL"])[1] is None
    assert K.active(STEPS, ["NALL_CELL", "NCELL"]) == []
    with pytest.raises(ValueError, match="NNONE"):
        K.active(STEPS, ["NNONE"])


def test_empty_chain(spark):
    assert ran(spark, [], STEPS) == {}


def test_outdone_in_small_groups(spark):
    cells = spark.createDataFrame([(1, "a", 9, 9), (2, "a", 1, 1), (3, "b", 9, 9), (4, "b", 1, 1), (5, "b", 1, 1), (6, "b", 2, 2)], "cell long, g string, top int, umi int")
    # P(X >= 1) of 2 trials at 0.1 is 0.19, P(X >= 3) of 4 is 0.0037
    assert sorted(r.cell for r in K.outdone("g", "top", "umi", 2)(cells).collect()) == [4, 5, 6]


def test_contaminants(spark):
    rows = [(i, "A B", 2) for i in range(20)] + [(20, "A C", 2), (21, "D E", 2), (22, "A C X", 3), (23, None, 2)]
    cells = spark.createDataFrame(rows, "cell long, exact string, nchains int")
    assert [r.cell for r in K.contaminants("exact", "nchains")(cells).collect()] == [20]


def test_amino_requests(spark):
    row = spark.createDataFrame([("ABCDEFGHIJ", 1, 3, 5, 4, [0, 1, 17], None)], "aa string, fr1 int, cdr1 int, fr2 int, cdr2 int, var array<int>, share array<int>")

    def show(request):
        p = A.positions(request, {c: F.col(c) for c in A.needs(request)})
        r = row.select(p.alias("p"), A.shown(F.col("aa"), p).alias("s")).first()
        return r.p, r.s

    assert show("cdr1,8-12,fwr1") == ([1, 2, 3, 4, 8, 9, 10, 11, 12], "BCDEIJ")
    assert show("var,cdr1") == ([0, 3, 4, 5], "ADEF")
    assert show("fwr2") == ([], "") and show("share") == ([], "") and show("") == ([], "")
    assert A.needs(A.DEFAULT) == {"cdr3", "cdr3_end", "var", "share", "donor"}
    for wrong in ("cdr4", "5-3", "cdr1;var"):
        with pytest.raises(ValueError, match="unknown amino category"):
            A.parse(wrong)


def test_sequence_patterns(spark):
    names = ["CARPW", "CARPWW", "CQTWG", "CQTWX", "xDYIIDx", "a|b", "", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    match = lambda t: [r.s for r in df.where(C.sequence_pattern(t, F.col("s"))).collect()]
    assert match("CARPW") == ["CARPW"]
    assert match("CARPW|CQTWG~1") == ["CARPW", "CQTWG", "CQTWX"]
    assert match(".*DYIID.*") == ["xDYIIDx"]
    assert match("C(AR|QT)..?") == ["CARPW", "CQTWG", "CQTWX"]
    assert match("a[|]b") == ["a|b"]
    for wrong in ("", "C.R~2"):
        with pytest.raises(ValueError):
            C.sequence_pattern(wrong, F.col("s"))


def test_layout_round_trip(spark, tmp_path):
    rows = [(1, "b", 0.1 + 0.2, -1.0), (0, "a", 1e-7, 2.5)]
    df = spark.createDataFrame(rows, P.LAYOUT)
    P.save_layout(df, f"file://{tmp_path}/l")
    back = P.load_layout(df.select("dataset", "barcode"), f"file://{tmp_path}/l")
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    with pytest.raises(ValueError, match="2 cells, these data 1"):
        P.load_layout(df.select("dataset", "barcode").limit(1), f"file://{tmp_path}/l")
    other = spark.createDataFrame([(1, "b"), (0, "z")], "dataset long, barcode string")
    with pytest.raises(Exception, match="other data"):
        P.load_layout(other, f"file://{tmp_path}/l").collect()


def test_peer_groups(spark):
    s = spark.createDataFrame([("x", "TGTGCA"), ("x", "TGTTGT"), ("y", "GCA"), ("y", None)], "g string, seq string")
    g = sinks.peer_groups(s, "g", "seq")
    c = spark.createDataFrame([(1, "x"), (2, "z")], "id int, g string")
    assert sorted(r.line for r in sinks.peer_lines(c, g, ["id"], "g").collect()) == ["1,0,C,2", "1,1,A,1", "1,1,C,1"]
    assert sorted(r.line for r in sinks.peer_lines(c, g, ["id"], "g", readable=True).collect()) == ["1,0,C=2", "1,1,A=1:C=1"]


def test_numbering_within_groups(spark):
    hot = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("g"), (F.col("id") % 11).cast("string"))).alias("g"), (F.col("id") * 7919 % 3001).alias("v"))
    got = G.numbered_within(hot.repartition(9), "g", ["v"], "k")
    want = hot.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("v")).cast("long") - 1)
    assert got.columns == ["g", "v", "k"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert G.numbered_within(hot.limit(0), "g", ["v"], "k").count() == 0


def test_category_shades(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,), (None,), (None,)], "c string")
    assert sorted((r.c or "", r.shade) for r in P.category_shades(df, "c", 2).collect()) == [("", 0)] * 3 + [("a", 1)] * 2 + [("b", 2), ("c", 2)]


def test_inline_metadata(spark):
    rows = R.metadata_inline(spark, "bcr,donor;x:runs/a,d1;runs/b,d2").collect()
    assert [(r.dataset, r.path, r.donor, r.origin) for r in rows] == [("x", "runs/a", "d1", None), ("b", "runs/b", "d2", None)]
    with pytest.raises(ValueError, match="differs"):
        R.metadata_inline(spark, "bcr,donor;a")


def test_shrunk_annotations(spark):
    df = spark.createDataFrame([("b", "ACGT", "T", 3)], "barcode string, sequence string, aa_sequence string, more int")
    assert convert.shrunk(df).first().record == '{"barcode":"b","sequence":"ACGT","more":3}'
