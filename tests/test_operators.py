"""Brute-force checks of what SQL doesn't express, and of parsers and edge cases."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lymphframe.functions import align as A
from lymphframe.functions import conditions as C
from lymphframe.functions import regions as D
from lymphframe.functions import sequence as S
from lymphframe.functions import variables as V
from lymphframe.operators import clonotype as J
from lymphframe.operators import filters as K
from lymphframe.operators import grouping as G
from lymphframe.operators import plots as P
from lymphframe.operators import trees as T
from lymphframe.sources import readers as R
from lymphframe.operators.components import connected_components


def brute_components(edges):
    label = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            if label[a] != m or label[b] != m:
                label[a] = label[b] = m
                changed = True
    return label


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (130, 2))] + [(1000 + k, 1001 + k) for k in range(40)] + [(500, 500 + k) for k in range(1, 60)]
    rows = edges + edges[:5] + [(7, 7)]
    df = spark.createDataFrame(rows + [(None, 3)], "src long, dst long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == brute_components([e for e in edges if e[0] != e[1]])


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_linear_conditions():
    assert C.parse_linear("2*u1 - (IGHV3-7_g) ≥ 1.5") == ([(2.0, "u1"), (-1.0, "IGHV3-7_g")], ">=", 1.5)
    assert C.parse_linear("-x<3") == ([(-1.0, "x")], "<", 3.0)
    for bad in ("x", "x > y", "2** > 1", "> 3"):
        with pytest.raises(ValueError):
            C.parse_linear(bad)


def test_linear_ignores_what_is_no_number(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "x"), ("a", "NaN"), ("a", "Infinity"), ("b", ""), ("c", "5")], "g string, v string")
    got = {r.g for r in df.groupBy("g").agg(C.linear("v >= 1", ["v"], F.avg).alias("ok")).where("ok").collect()}
    assert got == {"a", "c"}
    with pytest.raises(ValueError):
        C.linear("w > 1", ["v"])


def test_predicates(spark):
    df = spark.createDataFrame([(1, "x", 5), (2, None, 7), (3, "y", None)], "id int, tag string, n int")
    ids = lambda t: [r.id for r in df.where(C.predicate(t, df.columns)).orderBy("id").collect()]
    assert ids("tag == 'x' || n > 6") == [1, 2] and ids("tag == ''") == [2] and ids("!(n + 1 >= 7)") == [1]
    for bad in ("min(n) > 1", "nosuch == 1", "n @ 1"):
        with pytest.raises(ValueError):
            C.predicate(bad, df.columns)


def test_definitions(spark):
    df = spark.createDataFrame([(4.0, "2"), (1.0, "z"), (3.0, "0")], "a double, b string")
    name, x = C.define("r:a / b + 1", df.columns)
    assert name == "r" and [r[0] for r in df.select(x).collect()] == [3.0, None, None]


def test_variable_names():
    f = frozenset({"CD19_ab"})
    assert V.parse("u2").chain == 2
    assert V.parse("gex_mean").suffix == "_mean" and V.parse("gex_cell").level == "cell"
    assert V.parse("CD19_ab_%", f).params == (("feature", "CD19_ab"),)
    assert dict(V.parse("cdr3_aa_1_-2_ext2").params)["right"] == "-2" and V.parse("cdr3_aa_1_-2_ext2").chain == 2
    assert V.parse("x:n_B").alias == "x" and V.parse("pe10").level == "cell-exact" and V.parse("count_cdr3_[ST]").level == "exact"
    with pytest.raises(ValueError):
        V.parse("no such thing")
    assert len(V.default_columns(2, False)) < len(V.default_columns(2, True))


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ATGGCATAAGG", "ATGGCTTAA"), ("", "A"), ("AC", "")], "a string, b string")
    r = df.select(S.translate(F.col("b")).alias("t"), S.hamming(F.col("a"), F.col("b")).alias("h"), S.differences(F.col("a"), F.col("b")).alias("d")).collect()
    assert [x.t for x in r][:1] == ["MA*"] and [x.h for x in r] == [1, 0, 0] and r[0].d == "5A,+2"
    assert spark.range(1).select(S.barcode_number(F.lit("ACGT"))).first()[0] == "0000000027"


def test_edit_scripts():
    def replay(a_len, b, script):
        marks = [(s[0], int(s[1:].partition(":")[0]), int(s[1:].partition(":")[2] or 1)) for s in filter(None, script.split("•"))]
        return len(b) + sum(k if m == "I" else -k if m == "D" else 0 for m, _, k in marks) == a_len

    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("ACGT"), rng.integers(0, 9))) for _ in "ab")
        n, script = A.edit_script(a, b)
        assert replay(len(a), b, script)
        total = sum(int(x or 1) for x in [s.partition(":")[2] if s[0] != "S" else "1" for s in filter(None, script.split("•"))])
        assert total == n
        import re

        ops = re.findall(r"(\d+)([MID])", A.cigar(a, b))
        assert sum(int(k) for k, c in ops if c in "MI") == len(a) and sum(int(k) for k, c in ops if c in "MD") == len(b)


def test_few_distinct_against_enumeration():
    for k, n in ((3, 4), (4, 3), (5, 5)):
        draws = list(itertools.product(range(n), repeat=k))
        for most in range(k + 1):
            assert J.few_distinct(k, most, n) == pytest.approx(sum(len(set(x)) <= most for x in draws) / len(draws))


def test_binomial_tail(spark):
    cases = [(5, 2), (20, 5), (3, 0), (4, 4), (4, 5), (900, 1), (900, 80), (900, 95), (900, 200), (30000, 10), (1, 1), (29_000, 2_900), (29_000, 3_050), (31_000, 3_100), (31_000, 3_250), (31_000, 2_950)]
    df = spark.createDataFrame(cases, "n long, k long").select("n", "k", K.binomial_tail(F.col("k"), F.col("n"), 0.1).alias("p"))
    for r in df.collect():
        want = sum(math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.1) + (r.n - i) * math.log(0.9)) for i in range(r.k, r.n + 1))
        assert r.p == pytest.approx(want, rel=1e-5, abs=1e-9)


def test_binomial_tail_of_a_hundred_million(spark):
    """Groups of any size take a fixed number of steps: near the mean, on both sides of it and far away."""
    n = 10**8
    for k in (10**7 - 9000, 10**7 - 3000, 10**7, 10**7 + 3000, 10**7 + 9000):
        i = np.arange(k, k + 80_000, dtype=np.float64)
        # terms follow one from the other; only the first needs the gamma function
        first = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(0.1) + (n - k) * math.log(0.9)
        want = math.exp(first) * (1 + np.exp(np.cumsum(np.log((n - i) / (i + 1) / 9))).sum())
        got = spark.range(1).select(K.binomial_tail(F.lit(k), F.lit(n), 0.1)).first()[0]
        assert got == pytest.approx(want, rel=1e-4)
    ends = spark.range(1).select(K.binomial_tail(F.lit(5), F.lit(n), 0.1), K.binomial_tail(F.lit(3 * 10**7), F.lit(n), 0.1)).first()
    assert ends[0] == pytest.approx(1) and ends[1] == pytest.approx(0, abs=1e-12)


def test_doublets_by_all_triples(spark):
    rng = np.random.default_rng(4)
    pure = {}
    for _ in range(150):
        keys = tuple(sorted({f"c{int(k)}" for k in rng.integers(0, 8, rng.integers(1, 5))}))
        pure[keys] = int(rng.choice([1, 2, 3, 9, 40, 300]))
    rows = [("+".join(k), n, list(k) + list(k[:1]) + [None]) for k, n in pure.items()] + [("none", 5, [])]
    near = lambda a, b: set(a) & set(b)
    want = set()
    for p0, n0 in pure.items():
        large = [p for p, n in pure.items() if p != p0 and near(p, p0) and 5 * n0 <= n]
        if any(not near(a, b) for a, b in itertools.combinations(large, 2)):
            want.add("+".join(p0))
    df = spark.createDataFrame(rows, "id string, n long, keys array<string>").selectExpr("*", "1 AS key", "2 AS most")
    got = [r.id for r in K.doublets(df).collect()]
    assert set(got) == want and len(got) == len(want) and 0 < len(want) < len(pure)


def test_chain_keeps_columns_of_any_name(spark):
    cells = spark.createDataFrame([(k, "g", 1, k % 3, k, "x") for k in range(12)], "cell int, exact string, bad int, n int, best int, low string")
    steps = [K.Step("DUP", "NDUP", K.duplicated(["n"])), K.Step("OUT", "NOUT", K.outdone("exact", "best", "bad", 50))]
    out = K.run_chain(cells, steps)
    assert out.columns == [*cells.columns, "filter"] and out.where("bad = 1 AND low = 'x'").count() == 12
    assert {r.filter for r in out.collect()} == {"DUP"}


def test_umi_filter_protects_one(spark):
    cells = spark.createDataFrame([(k, "g1", "d", 1 + k) for k in range(4)] + [(10, "g2", "d", 100), (11, "g2", "d", 2)], "cell int, exact string, dataset string, umi int")
    low = spark.createDataFrame([("d", 50.0)], "dataset string, umin double")
    assert sorted(r.cell for r in K.low_umis(cells, low, "exact", "dataset", "umi").collect()) == [0, 1, 2]


def test_fate(spark):
    cells = spark.createDataFrame([(k,) for k in range(6)], "cell int")
    kept, fate = K.drop(cells, None, cells.where("cell < 2"), "A")
    kept, fate = K.drop(kept, fate, cells.where("cell < 4"), "B")
    assert {(r.cell, r["filter"]) for r in fate.collect()} == {(0, "A"), (1, "A"), (2, "B"), (3, "B")} and kept.count() == 2


def tree_distance(edges, n):
    big = 1e9
    v = max(max(u, w) for u, w, _ in edges) + 1
    d = np.full((v, v), big)
    np.fill_diagonal(d, 0)
    for a, b, w in edges:
        d[a, b] = d[b, a] = w
    for k in range(v):
        d = np.minimum(d, d[:, [k]] + d[[k], :])
    return d[:n, :n]


def test_neighbour_joining_restores_additive_distances():
    tree = [(5, 0, 2.0), (5, 1, 3.0), (6, 5, 1.0), (6, 2, 4.0), (7, 6, 2.0), (7, 3, 1.0), (7, 4, 5.0)]
    d = tree_distance(tree, 5)
    e = T.neighbour_joining(d)
    assert len(e) == 7 and np.allclose(tree_distance(e, 5), d)
    assert T.neighbour_joining(np.zeros((1, 1))) == [] and len(T.neighbour_joining(np.zeros((2, 2)))) == 1


def test_newick():
    r = T.rooted([(2, 0, 1.0), (2, 1, 2.5)])
    assert T.newick(r, {0: "root", 1: "b"}) == "((b:2.50)I2:1.00)root;"
    assert T.text_tree(r, {0: "root", 1: "b"}).split("\n") == ["root", "  I2 [1.00]", "    b [2.50]"]


def test_trees_of_repeated_and_null_rows(spark):
    df = spark.createDataFrame([("g", "a", "ACGT"), ("g", "b", "ACGA"), ("g", "c", "ACGT"), ("g", "d", None), ("h", "x", "AAAA")], "g string, n string, s string")
    got = T.clonotype_trees(df, "g", "n", "s").collect()
    assert len(got) == 1 and got[0].length == 1.0


def test_hex_places_are_distinct_and_near():
    pts = [P.hex_place(k) for k in range(61)]
    for a, b in itertools.combinations(pts, 2):
        assert math.dist(a, b) > 0.99
    assert max(math.hypot(*p) for p in pts) < 4.01


def test_plot_helpers():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert P.inside(square, 1, 1) and not P.inside(square, 3, 1)
    assert P.ticks(0, 10) == [0, 2, 4, 6, 8, 10] and P.ticks(1, 1) == [1] and len(P.ticks(0.13, 0.92)) <= 6


def test_grouping_order_does_not_matter(spark):
    rows = [(k, "abc"[k % 3] * (1 + k % 4)) for k in range(24)]
    a = G.similarity_classes(spark.createDataFrame(rows, "id long, s string"), "id", [], G.ratio_near(0.6, "s"))
    b = G.similarity_classes(spark.createDataFrame(rows[::-1], "id long, s string"), "id", [], G.ratio_near(0.6, "s"))
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_ordinals_over_many_ranges(spark):
    rows = [(f"k{k:04d}", (k * 7) % 13) for k in range(500)]
    df = spark.createDataFrame(rows, "group_key string, n int").repartition(7)
    got = [(r.group_key, r.n) for r in G.ordinals(df).orderBy("group_id").collect()]
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert [r.group_id for r in G.ordinals(df).orderBy("group_id").collect()] == list(range(1, 501))
    assert G.ordinals(df.limit(0)).count() == 0


def test_scan_needs_both_sets(spark):
    from lymphframe.operators.scan import feature_scan

    counts = spark.createDataFrame([(1, "f", 4), (2, "f", 1), (2, "g", 3)], "cell int, feature string, count int")
    cells = spark.createDataFrame([(1,), (2,), (3,), (4,)], "cell int")
    got = {tuple(r) for r in feature_scan(counts, cells, F.col("cell") < 3, F.col("cell") >= 3, F.lit(True)).collect()}
    assert got == {("f", 2.5, 0.0, None), ("g", 1.5, 0.0, None)}
    for test, control in ((F.col("cell") > 9, F.col("cell") < 3), (F.col("cell") < 3, F.col("cell") > 9)):
        with pytest.raises(ValueError):
            feature_scan(counts, cells, test, control, F.lit(True))


@pytest.mark.parametrize("k", [3, 50])
def test_neighbours_against_brute_force(spark, k):
    from lymphframe.operators.neighbors import nearest, within

    rng = np.random.default_rng(k)
    v = rng.integers(-5, 6, (300, 3))
    rows = [(i, [int(x) for x in v[i]], i % 4 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<long>, mark boolean")
    d = ((v[:, None] - v[None, :]) ** 2).sum(2)
    want = {(q, c) for q in range(0, 300, 4) for _, c in sorted((d[q, c], c) for c in range(300) if c != q)[:k]}
    assert {(r.query, r.id) for r in nearest(df, "mark", k).collect()} == want
    got = {r.query: (r.n, r.marked) for r in within(df, "mark", 9).collect()}
    assert got == {q: (int((d[q] <= 9).sum()), int((d[q, ::4] <= 9).sum())) for q in range(0, 300, 4)}
    assert nearest(df.limit(0), "mark", k).count() == 0


@pytest.mark.parametrize("span", [3, 400])
def test_marked_among_nearest(spark, span):
    """n grows with the marks, far beyond 20; narrow values tie across the n-th place, ids reach both ends of a long."""
    from lymphframe.operators.neighbors import marked_among_nearest

    rng = np.random.default_rng(span)
    v = rng.integers(-span, span + 1, (300, 3))
    ids = [-(2**63), *range(-100, 198), 2**63 - 1]
    mark = rng.random(300) < 0.4
    rows = [(ids[i], [int(x) for x in v[i]], bool(mark[i])) for i in range(300)]
    df = spark.createDataFrame(rows + [(1000, None, True)], "id long, v array<long>, mark boolean")
    d, n = ((v[:, None] - v[None, :]) ** 2).sum(2), int(mark.sum())
    want = {ids[q]: (n, sum(bool(mark[c]) for _, c in sorted((d[q, c], c) for c in range(300))[:n])) for q in range(300) if mark[q]}
    got = marked_among_nearest(df).collect()
    assert {r.query: (r.n, r.marked) for r in got} == want and len(got) == n
    assert marked_among_nearest(df.limit(0)).count() == 0 and marked_among_nearest(df.where("NOT mark")).count() == 0


def plain_packing(radii, seed, quarter):
    """Every placed circle against every direction, without an index."""
    import random

    rng, placed, out = random.Random(seed), [], [(0.0, 0.0)] * len(radii)
    for i in sorted(range(len(radii)), key=lambda i: (-radii[i], i)):
        r, best = radii[i], None
        for _ in range(40):
            turn = rng.random() * (math.pi / 2 if quarter else 2 * math.pi)
            u, v = math.cos(turn), math.sin(turn)
            spans = []
            for x, y, q in placed:
                along, off, reach = x * u + y * v, abs(x * v - y * u), q + r
                if off < reach:
                    half = math.sqrt(reach * reach - off * off)
                    spans.append((along - half, along + half))
            at = r if quarter else 0.0
            for a, b in sorted(spans):
                at = b if a < at < b else at
            if not any(a < at < b for a, b in spans) and (best is None or at < best[0]):
                best = (at, at * u, at * v)
        out[i] = best[1:]
        placed.append((*best[1:], r))
    return out


@pytest.mark.parametrize("quarter", [False, True])
def test_indexed_packing_places_as_before(quarter):
    from lymphframe.operators.plots import pack_circles

    radii = [float(r) ** 0.5 for r in np.random.default_rng(3).zipf(1.8, 150).clip(1, 900)]
    assert np.allclose(pack_circles(radii, 5, quarter=quarter), plain_packing(radii, 5, quarter), atol=1e-9)
    assert pack_circles([]) == []


def test_every_cluster_gets_a_circle(spark):
    from lymphframe import plans
    from lymphframe.sources import mapped as M

    d = "/root/testdata/sf0.001"
    got = plans.queries()["v03_circle_packing"](spark, d).collect()
    want = {r.exact: r["count"] ** 0.5 for r in M.signatures(spark, d).groupBy("exact").count().collect()}
    assert len(want) > 40 and {r.exact: r.radius for r in got} == want and len(got) == len(want)
    x, y, q = (np.array([r[c] for r in got]) for c in ("x", "y", "radius"))
    gap = np.hypot(x[:, None] - x, y[:, None] - y) - q[:, None] - q
    np.fill_diagonal(gap, 0)
    assert gap.min() > -1e-6


def test_link_components_take_every_row(spark, tmp_path):
    from lymphframe import plans

    rng = np.random.default_rng(6)
    orders = [(o, int(c)) for o, c in enumerate(rng.integers(0, 150, 200))] + [(900, 901), (902, None)]
    lines = [(int(o), int(p)) for o, p in rng.integers(0, 150, (260, 2))] + [(900, 950), (903, 951)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = [(f"o{o}", f"c{c}") for o, c in orders if c is not None] + [(f"o{o}", f"p{p}") for o, p in lines]
    got = plans.queries()["g22_link_components"](spark, str(tmp_path)).collect()
    want = brute_components(edges)
    assert {r.node: r.root for r in got} == want and len(got) == len(want)
    assert max(list(want.values()).count(r) for r in set(want.values())) > len(want) / 2


def test_palette_has_every_shade(spark):
    from lymphframe import plans

    got = plans.queries()["v08_palette"](spark, "/root/testdata/sf0.001").collect()
    assert {r.shade: r.colour for r in got} == {k: P.turbo(k) for k in range(256)} and len(got) == 256


def test_packed_hamming_counts_letters(spark):
    import random

    r = random.Random(3)
    rows = [("".join(r.choice("ACGT") for _ in range(96)), "".join(r.choice("ACGT") for _ in range(96))) for _ in range(50)] + [("A" * 96, "T" * 96), ("ACGT" * 24, "ACGT" * 24), ("ACG", "ATG")]
    df = spark.createDataFrame(rows, "a string, b string")
    for row in df.select("a", "b", S.packed_hamming(S.packed(F.col("a"), 96), S.packed(F.col("b"), 96)).alias("d")).collect():
        assert row.d == sum(x != y for x, y in zip(row.a, row.b))


def test_places_and_polygons_as_columns(spark):
    x, y = P.hex_columns(F.col("id"))
    for row in spark.range(200).select("id", x.alias("x"), y.alias("y")).collect():
        assert (row.x, row.y) == pytest.approx(P.hex_place(row.id), abs=1e-9)
    shape = [(0.0, 0.0), (4.0, 1.0), (3.0, 5.0), (1.5, 2.0), (-1.0, 4.0)]
    grid = [(a / 3 + 0.01, b / 3 + 0.02) for a in range(-6, 16) for b in range(-3, 18)]
    for row in spark.createDataFrame(grid, "x double, y double").withColumn("in", P.inside_columns(shape, F.col("x"), F.col("y"))).collect():
        assert row["in"] == P.inside(shape, row.x, row.y)


def test_metrics(spark, tmp_path):
    (tmp_path / "m.csv").write_text('id,Cells,Share,Note\na,"1,234",12.5%,x\nb,7,,\n')
    got = {(r.id, r.metric): r.value for r in R.metrics(spark, str(tmp_path / "m.csv"), "id").collect()}
    assert got == {("a", "Cells"): 1234.0, ("a", "Share"): 0.125, ("a", "Note"): None, ("b", "Cells"): 7.0, ("b", "Share"): None, ("b", "Note"): None}


def slow_place(aa, places, low, high, first=False):
    tried = []
    for j in range(low, high + 1):
        if 0 <= j <= len(aa) - len(places):
            tried.append((sum(w for p, place in enumerate(places) for c, w in place.items() if aa[j + p] == c), -j if first else j))
    return abs(max(tried)[1]) if tried else None


def slow_starts(aa, chain):
    add = lambda x, n: None if x is None else x + n
    light = chain in ("IGK", "IGL")
    fr1 = slow_place(aa, D.motif(D.FR1_IGH if chain == "IGH" else D.FR1), 0, 25 if chain == "IGL" else 40)
    fr1 = add(fr1, int(aa[fr1] == "C")) if fr1 is not None else None
    cdr1 = None if fr1 is None else add(slow_place(aa, D.motif(D.CDR1), 25, fr1 + 19), 5 if light else 8)
    fr2 = add(slow_place(aa, D.motif(D.FR2_IGL if chain == "IGL" else D.FR2), 40, 62 if chain == "IGH" else 73), {"IGH": -1, "IGK": 2, "IGL": 2}.get(chain, 0))
    if fr2 is None:
        cdr2 = None
    elif chain == "IGH":
        cdr2 = add(slow_place(aa, D.motif(D.CDR2_IGH), fr2 + 8, fr2 + 13), 7)
    elif chain == "TRA":
        cdr2 = add(slow_place(aa, D.motif(D.CDR2_TRA), fr2 + 10, fr2 + 12), 6)
    else:
        cdr2 = fr2 + (15 if light else 17)
    ends = D.CDR3_ENDS.split()
    tried = []
    for j in range(max(0, len(aa) - 29), len(aa) - 10):
        score = 0
        for k in range(11):
            hits = [m for m in ends if m[k] == aa[j + k]]
            score += min(1, len(hits)) if aa[j + k] == "Q" else len(hits)
        tried.append((score, j + 11))
    cdr3 = max(tried)[1] if tried else None
    if cdr3 is None:
        fr3 = None
    elif light:
        fr3 = slow_place(aa, D.motif(D.FR3_IGKL), max(0, cdr3 - 35), cdr3 - 28)
    elif chain == "IGH":
        at = slow_place(aa, D.motif(D.FR3_IGH), max(0, cdr3 - 40), cdr3 - 30, first=True)
        fr3 = at - 1 if at else None
    elif chain == "TRA":
        fr3 = add(slow_place(aa, D.motif(D.FR3_TRA), max(0, cdr3 - 36), cdr3 - 33), 1)
    else:
        fr3 = slow_place(aa, D.motif(D.FR3_TRB), max(0, cdr3 - 38), cdr3 - 35)
    return fr1, cdr1, fr2, cdr2, fr3, cdr3


def test_region_starts_by_motifs(spark):
    import random

    r = random.Random(5)
    # a heavy V segment (IGHV3-23), a kappa one (IGKV1-39), and letters at random of several lengths
    heavy = "MEFGLSWLFLVAILKGVQCEVQLLESGGGLVQPGGSLRLSCAASGFTFSSYAMSWVRQAPGKGLEWVSAISGSGGSTYYADSVKGRFTISRDNSKNTLYLQMNSLRAEDTAVYYCAK"
    kappa = "MDMRVPAQLLGLLLLWLRGARCDIQMTQSPSSLSASVGDRVTITCRASQSISSYLNWYQQKPGKAPKLLIYAASSLQSGVPSRFSGSGSGTDFTLTISSLQPEDFATYYCQQSYSTP"
    texts = [heavy, kappa, "", "CAS"] + ["".join(r.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(n)) for n in (5, 11, 23, 45, 60, 90, 120, 120, 120)]
    df = spark.createDataFrame([(t,) for t in texts], "aa string")
    for chain in ("IGH", "IGK", "IGL", "TRA", "TRB"):
        got = {x.aa: tuple(x.s) for x in df.select("aa", D.starts(F.col("aa"), chain).alias("s")).collect()}
        assert got == {t: slow_starts(t, chain) for t in texts}
        if chain == "IGH":
            _, cdr1, fr2, cdr2, fr3, cdr3 = got[heavy]
            assert got[heavy][0] == heavy.index("EVQLLE") and heavy[cdr1:fr2] == "GFTFSSY" and heavy[fr2:].startswith("AMSWVRQ")
            assert cdr2 < fr3 < cdr3 and heavy[cdr3:] == "AK"
        if chain == "IGK":
            assert kappa[got[kappa][2] :].startswith("WYQQKPG") and got[kappa][0] == kappa.index("DIQMTQ")


def test_text_tree_and_clustal_by_example():
    from lymphframe.sources import sinks

    tree = [(0, 4, 1.0), (4, 1, 0.5), (4, 2, 2.25)]
    assert T.text_tree(tree, {0: "root", 1: "a", 2: "b"}) == "root\n  I4 [1.00]\n    a [0.50]\n    b [2.25]"
    assert sinks.clustal_text(["x", "long"], ["ACDK", "ACER"], True) == "CLUSTALW\n\n\nx      ACDK\nlong   ACER\n       **::\n"
    wide = sinks.clustal_text(["x", "y"], ["A" * 61, "A" * 60 + "C"], False).split("\n")
    assert wide[3] == "x   " + "A" * 60 and wide[5] == "    " + "*" * 60 and wide[7] == "x   A" and wide[9] == "     "


def test_previews(spark):
    from lymphframe.sources import sinks

    df = spark.createDataFrame([("a,b", 1), (None, 22)], "name string, n int")
    lines = lambda s: sorted(r.line for r in sinks.preview(df, ["name", "n"], s).collect())
    assert lines("csv") == sorted(["name,n", '"a,b",1', ",22"]) and lines("tsv") == sorted(["name\tn", "a,b\t1", "\t22"])
    assert lines("aligned") == sorted(["name  n", "a,b   1", "      22"])
