"""Grouping G00-G23, joins J01-J15, windows W01-W09, scan N01-N03."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lymphframe.functions import conditions as C
from lymphframe.functions import sequence as S
from lymphframe.operators import grouping as G
from lymphframe.operators.components import connected_components
from lymphframe.operators.neighbors import marked_among_nearest, nearest, within
from lymphframe.plans.functions import AA, amino
from lymphframe.plans.registry import query
from lymphframe.session import table
from lymphframe.sources import mapped as M

W = "WITH "


def keyed(name, value_sql, value, only_heavy, names=True, empty_alone=True):
    """A key of the ordered names of a cell's chains: all (False), the heavy (True) or the light ones ("light")."""
    pick = " FILTER (NOT heavy)" if only_heavy == "light" else " FILTER (heavy)" if only_heavy else ""
    own = "'#' || cell" if empty_alone else "''"
    sql = W + M.CHAIN + f", k AS (SELECT cell, coalesce(string_agg({value_sql}, '|' ORDER BY {value_sql}){pick}, '') AS key, count(*) AS size FROM chain GROUP BY cell), g AS (SELECT cell AS id, CASE WHEN key = '' THEN {own} ELSE key END AS group_key, size FROM k) SELECT id, group_key, CAST(sum(size) OVER (PARTITION BY group_key) AS BIGINT) AS group_n FROM g"

    def f(spark, d):
        c = M.chains_plain(spark, d)
        if names:
            part = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("v_name"), F.col("p_type").alias("j_name"), F.col("p_name").alias("name"), (F.col("p_size") % 5).alias("d"))
            c = c.join(part, "part")
        v = F.when(~F.col("heavy") if only_heavy == "light" else F.col("heavy"), value()) if only_heavy else value()
        k = c.groupBy("cell").agg(F.array_join(F.sort_array(F.collect_list(v)), "|").alias("key"), F.count("*").alias("size"))
        return G.keyed_groups(k, "cell", F.col("key"), F.col("size"), empty_alone)

    query(name, sql)(f)


@query("g00_each_alone", W + M.SIGNATURE + " SELECT cell AS group_key, nchains AS n, row_number() OVER (ORDER BY nchains DESC, cell) AS group_id FROM sig")
def g00(spark, d):
    return G.ordinals(M.signatures(spark, d).select(F.col("cell").alias("group_key"), F.col("nchains").alias("n")))


keyed("g01_vj_refname", "v_name || j_name", lambda: F.concat("v_name", "j_name"), False)
keyed("g02_vdj_refname", "v_name || coalesce(CASE WHEN heavy THEN CAST(part % 5 AS VARCHAR) END, 'null') || j_name", lambda: F.concat("v_name", F.coalesce(F.when(F.col("heavy"), (F.col("part") % 5).cast("string")), F.lit("null")), "j_name"), False)
keyed("g03_v_heavy_refname", "v_name", lambda: F.col("v_name"), True)
keyed("g04_vj_heavy_refname", "v_name || j_name", lambda: F.concat("v_name", "j_name"), True)
keyed("g05_vdj_heavy_refname", "v_name || CAST(part % 5 AS VARCHAR) || j_name", lambda: F.concat("v_name", (F.col("part") % 5).cast("string"), "j_name"), True)
keyed("g06_len", "CAST(heavy AS VARCHAR) || ':' || length(name)", lambda: F.concat(F.col("heavy").cast("string"), F.lit(":"), F.length("name").cast("string")), False)
keyed("g07_cdr3_len", "kind || length(name) // 3", lambda: F.concat("kind", F.floor(F.length("name") / 3).cast("string")), False)
keyed("g08_cdr3_heavy_len", "CAST(length(name) AS VARCHAR)", lambda: F.length("name").cast("string"), True, empty_alone=False)
keyed("g08_cdr3_light_len", "CAST(length(name) AS VARCHAR)", lambda: F.length("name").cast("string"), "light", empty_alone=False)

CLOSURE = """, reach AS (SELECT src AS a, src AS b FROM both_ UNION SELECT r.a, e.dst FROM reach r JOIN both_ e ON r.b = e.src), low AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
  SELECT i.id, coalesce(least(low.root, i.id), i.id) AS root FROM items i LEFT JOIN low ON low.a = i.id"""


def similar(name, items_sql, near_sql, items, block, near):
    sql = "WITH RECURSIVE " + items_sql + f", e AS (SELECT a.id AS src, b.id AS dst FROM items a JOIN items b ON a.id < b.id AND {near_sql}), both_ AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)" + CLOSURE
    query(name, sql)(lambda spark, d: G.similarity_classes(items(spark, d), "id", block, near()))


def named(spark, d):
    """Distinct sequences, their 96 letters packed as well, for comparison by the pair."""
    s = M.segments(spark, d)
    return s.select(F.col("name").alias("id"), "seq", F.length("name").alias("len"), *(c.alias(f"p{k}") for k, c in enumerate(S.packed(F.col("seq"), 96))))


def apart(a: str = "a.", b: str = "b."):
    """Differing letters of the sequences of two rows of named()."""
    return S.packed_hamming(*([F.col(f"{t}p{k}") for k in range(4)] for t in (a, b)))


def residues(spark, d):
    return amino(spark, d).select(F.col("name").alias("id"), "aa", F.length("name").alias("len"))


ITEMS = M.SEGMENT + ", items AS (SELECT name AS id, seq, length(name) AS len FROM seg)"
ITEMS_AA = AA + ", items AS (SELECT name AS id, aa, length(name) AS len FROM aa)"
similar("g09_heavy_identity", ITEMS, "a.len = b.len AND levenshtein(a.id, b.id) <= (1 - 0.6::DOUBLE) * greatest(a.len, b.len)", named, ["len"], lambda: G.ratio_near(0.6, "id"))
similar("g10_weighted_identity", ITEMS, "a.len = b.len AND list_sum(list_transform(range(1, 97), lambda i: CASE WHEN substr(a.seq, i, 1) = substr(b.seq, i, 1) THEN 0.0::DOUBLE WHEN substr(a.seq, i, 1) || substr(b.seq, i, 1) IN ('AG', 'GA', 'CT', 'TC') THEN 0.5 ELSE 1.0 END)) / 96 <= 0.52", named, ["len"],
        lambda: S.weighted_hamming(F.col("a.seq"), F.col("b.seq"), F.create_map(*(F.lit(x) for k in ("AG", "GA", "CT", "TC") for x in (k, 0.5)))) / 96 <= 0.52)
similar("g11_amino_identity", ITEMS_AA, "a.len = b.len AND levenshtein(a.aa, b.aa) <= (1 - 0.25::DOUBLE) * 32", residues, ["len"], lambda: G.ratio_near(0.25, "aa"))
similar("g12_cdr3_identity", ITEMS, "levenshtein(a.id, b.id) <= floor((1 - 0.7::DOUBLE) * least(a.len, b.len) + 1e-9) AND a.len = b.len", named, ["len"], lambda: G.bounded_near(0.7, "id"))
similar("g13_cdr3_amino_identity", ITEMS_AA, "a.len = b.len AND levenshtein(a.aa, b.aa) <= floor((1 - 0.2::DOUBLE) * 32 + 1e-9)", residues, ["len"], lambda: G.bounded_near(0.2, "aa"))


@query("g14_g18_group_conditions", W + M.MEMBER + " SELECT exact, count(*) AS n FROM mem GROUP BY exact HAVING count(*) >= 3 AND count(DISTINCT donor) >= 2 AND bool_or(tag = '1-URGENT') AND count(DISTINCT dataset) > 1 AND min(nchains) = 2")
def g14(spark, d):
    g = M.members(spark, d).groupBy("exact").agg(F.count("*").alias("n"), F.count_distinct("donor").alias("donors"), F.count_distinct("dataset").alias("datasets"), F.bool_or(F.col("tag") == "1-URGENT").alias("has"), F.min("nchains").alias("low"))
    return g.where("n >= 3 AND donors >= 2 AND has AND datasets > 1 AND low = 2").select("exact", "n")


HEAVY_LENGTH = W + M.SIGNATURE + ", g AS (SELECT s.exact, c.heavy, c.name, s.cell FROM sig s JOIN chain c USING (cell))"


def heavy_names(spark, d):
    """(exact, cell, heavy, cdr3): every chain of a group, a part's name standing for its CDR3."""
    name = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_name").alias("cdr3"))
    return M.chains_plain(spark, d).join(name, "part").join(M.signatures(spark, d).select("cell", "exact"), "cell").select("exact", "cell", "heavy", "cdr3")


@query("g16_varied_heavy_lengths", HEAVY_LENGTH.replace("WITH ", W + M.CHAIN + ", ", 1) + " SELECT exact, count(DISTINCT CASE WHEN heavy THEN length(name) END) AS lengths FROM g GROUP BY exact HAVING count(DISTINCT CASE WHEN heavy THEN length(name) END) <> 1")
def g16(spark, d):
    """Groups but those whose heavy CDR3s all have one length; a group without heavy chains stays."""
    g = heavy_names(spark, d).groupBy("exact").agg(F.count_distinct(F.when(F.col("heavy"), F.length("cdr3"))).alias("lengths"))
    return g.where("lengths <> 1")


@query("g17_group_with_cdr3", HEAVY_LENGTH.replace("WITH ", W + M.CHAIN + ", ", 1) + " SELECT exact, count(DISTINCT cell) AS n FROM g GROUP BY exact HAVING bool_or(name = (SELECT min(p_name) FROM part))")
def g17(spark, d):
    """Groups one of whose members has a given CDR3, here the least one of the table."""
    x = table(spark, d, "part").agg(F.min("p_name").alias("x"))
    g = heavy_names(spark, d).crossJoin(F.broadcast(x))  # one-row side
    return g.groupBy("exact").agg(F.count_distinct("cell").alias("n"), F.bool_or(F.col("cdr3") == F.col("x")).alias("has")).where("has").select("exact", "n")


@query("g19_group_donors", W + M.MEMBER + " SELECT exact FROM mem GROUP BY exact HAVING bool_or(donor = 'ASIA') AND bool_or(donor = 'EUROPE')")
def g19(spark, d):
    return M.members(spark, d).groupBy("exact").agg(F.collect_set("donor").alias("s")).where(F.array_contains("s", "ASIA") & F.array_contains("s", "EUROPE")).select("exact")


@query("g20_ordering", W + M.SIGNATURE + ", g AS (SELECT clono AS group_key, count(*) AS n FROM sig GROUP BY clono) SELECT group_key, n, row_number() OVER (ORDER BY n DESC, group_key) AS group_id FROM g")
def g20(spark, d):
    return G.ordinals(M.signatures(spark, d).groupBy(F.col("clono").alias("group_key")).agg(F.count("*").alias("n")))


@query("g22_connected_components", """WITH RECURSIVE e AS (SELECT a.c_custkey AS src, b.c_custkey AS dst FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey // 7 AND b.c_mktsegment = a.c_mktsegment AND b.c_custkey <> a.c_custkey),
  n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), up AS (SELECT node, node AS head FROM n UNION ALL SELECT up.node, e.dst FROM up JOIN e ON e.src = up.head) SELECT node, min(head) AS root FROM up GROUP BY node""")
def g22(spark, d):
    """Every customer is linked to the one at a seventh of its key if both are in one market segment."""
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    up = c.select(F.col("c_custkey").alias("dst"), "c_mktsegment")
    e = c.select(F.col("c_custkey").alias("src"), "c_mktsegment", F.floor(F.col("c_custkey") / 7).alias("dst")).join(up, ["dst", "c_mktsegment"])
    return connected_components(e.select("src", "dst"))


@query("g22_link_components")
def g22_links(spark, d):
    """Components of all customer-order and order-part links; most nodes meet in one giant component."""
    node = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    placed = table(spark, d, "orders").select(node("o", "o_orderkey").alias("src"), node("c", "o_custkey").alias("dst"))
    holds = table(spark, d, "lineitem").select(node("o", "l_orderkey").alias("src"), node("p", "l_partkey").alias("dst"))
    return connected_components(placed.union(holds))


@query("g23_group_stats", W + M.MEMBER + ", g AS (SELECT exact, count(*) AS n, CAST(sum(nchains) AS BIGINT) AS c FROM mem GROUP BY exact) SELECT n AS group_size, count(*) AS groups FROM g GROUP BY n")
def g23(spark, d):
    return M.members(spark, d).groupBy("exact").agg(F.count("*").alias("group_size")).groupBy("group_size").agg(F.count("*").alias("groups"))


# --- joins ---


@query("j01_exact_signatures", W + M.SIGNATURE + " SELECT exact, count(*) AS n_cells, max(nchains) AS n_chains FROM sig GROUP BY exact")
def j01(spark, d):
    return M.signatures(spark, d).groupBy("exact").agg(F.count("*").alias("n_cells"), F.max("nchains").alias("n_chains"))


similar("j03_join_basic", M.SEGMENT + ", items AS (SELECT name AS id, seq, length(name) AS len, substr(name, 1, 1) AS v FROM seg)", "a.len = b.len AND a.v = b.v AND hamming(a.id, b.id) <= (1 - 0.4::DOUBLE) * a.len",
        lambda spark, d: named(spark, d).withColumn("v", F.substring("id", 1, 1)), ["len", "v"], lambda: S.hamming(F.col("a.id"), F.col("b.id")) <= (1 - 0.4) * F.col("a.len"))


@query("j04_donor_constraint", W + M.MEMBER + " SELECT donor, exact, count(*) AS n FROM mem GROUP BY ALL HAVING count(*) > 1")
def j04(spark, d):
    """The donor is one more equality key of the join."""
    return M.members(spark, d).groupBy("donor", "exact").agg(F.count("*").alias("n")).where("n > 1")


@query("j06_nearest_top", W + M.SEGMENT + ", c AS (SELECT name, length(name) AS len FROM seg), p AS (SELECT a.name AS centre, b.name AS id, levenshtein(a.name, b.name) AS distance, row_number() OVER (PARTITION BY a.name ORDER BY levenshtein(a.name, b.name), b.name) AS k FROM c a JOIN c b ON a.len = b.len AND a.name <> b.name WHERE a.name LIKE 'red%') SELECT centre, id, distance FROM p WHERE k <= 3")
def j06(spark, d):
    n = named(spark, d)
    return G.nearest_groups(n, n.where(F.col("id").startswith("red")), "id", ["len"], F.levenshtein(F.col("a.id"), F.col("b.id")).cast("long"), top=3)


@query("j06_nearest_within", W + M.SEGMENT + " SELECT a.name AS centre, b.name AS id, levenshtein(a.name, b.name) AS distance FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name <> b.name WHERE a.name LIKE 'small%' AND levenshtein(a.name, b.name) <= 4")
def j06w(spark, d):
    n = named(spark, d)
    return G.nearest_groups(n, n.where(F.col("id").startswith("small")), "id", ["len"], F.levenshtein(F.col("a.id"), F.col("b.id")).cast("long"), within=4)


@query("j07_lookup_join", "SELECT d.doc_id, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j07(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query("j08_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def j08(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@query("j09_delete_and_renumber", W + M.SIGNATURE + ", g AS (SELECT exact, count(*) AS n FROM sig GROUP BY exact), k AS (SELECT exact, n FROM g WHERE n >= 3) SELECT exact, row_number() OVER (ORDER BY n DESC, exact) AS clonotype_id FROM k")
def j09(spark, d):
    g = M.signatures(spark, d).groupBy(F.col("exact").alias("group_key")).agg(F.count("*").alias("n")).where("n >= 3")
    return G.ordinals(g).select(F.col("group_key").alias("exact"), F.col("group_id").alias("clonotype_id"))


def pair_counts(spark, d, block, differ):
    """Pairs of cells within a block that differ in one more column, counted from group sizes, so no pair is made."""
    c = M.members(spark, d).groupBy(*block, differ).agg(F.count("*").alias("n"))
    t = c.groupBy(*block).agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    return t.select(*block, F.expr("(s * s - q) div 2").alias("pairs")).where("pairs > 0")


@query("j10_cross_donor_pairs", W + M.MEMBER + ", c AS (SELECT exact, donor, count(*) AS n FROM mem GROUP BY ALL), t AS (SELECT exact, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY exact) SELECT exact, CAST((s * s - q) // 2 AS BIGINT) AS pairs FROM t WHERE s * s > q")
def j10(spark, d):
    return pair_counts(spark, d, ["exact"], "donor")


@query("j11_same_donor_pairs", W + M.MEMBER + ", c AS (SELECT donor, nchains, exact, count(*) AS n FROM mem GROUP BY ALL), t AS (SELECT donor, nchains, sum(n) AS s, sum(n * n) AS q FROM c GROUP BY ALL) SELECT donor, nchains, CAST((s * s - q) // 2 AS BIGINT) AS pairs FROM t WHERE s * s > q")
def j11(spark, d):
    return pair_counts(spark, d, ["donor", "nchains"], "exact")


@query("j12_doublet_triples", W + M.PLAIN + """, h AS (SELECT cell, list_sort(list(DISTINCT part)) AS p FROM plain WHERE heavy GROUP BY cell), k AS (SELECT p[1] AS x, p[2] AS y, count(*) AS n0 FROM h WHERE len(p) = 2 GROUP BY ALL), s AS (SELECT p[1] AS part, count(*) AS n FROM h WHERE len(p) = 1 GROUP BY ALL)
  SELECT x, y, n0, a.n AS n1, b.n AS n2 FROM k JOIN s a ON x = a.part JOIN s b ON y = b.part""")
def j12(spark, d):
    """Signatures of two sequences, each of which another signature has alone, with the cells of all three; the two share none."""
    h = M.chains_plain(spark, d).where("heavy").groupBy("cell").agg(F.sort_array(F.collect_set("part")).alias("p"))
    sets = h.where(F.size("p") <= 2).groupBy("p").agg(F.count("*").alias("n"))
    k = sets.where(F.size("p") == 2).select(F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"), F.col("n").alias("n0"))
    s = sets.where(F.size("p") == 1).select(F.get("p", F.lit(0)).alias("part"), "n")
    return k.join(s.select(F.col("part").alias("x"), F.col("n").alias("n1")), "x").join(s.select(F.col("part").alias("y"), F.col("n").alias("n2")), "y").select("x", "y", "n0", "n1", "n2")


@query("j13_cross_donor_duplicates", W + M.MEMBER + " SELECT exact, count(DISTINCT donor) AS donors FROM mem WHERE nchains >= 3 GROUP BY exact HAVING count(DISTINCT donor) > 1")
def j13(spark, d):
    return M.members(spark, d).where("nchains >= 3").groupBy("exact").agg(F.count_distinct("donor").alias("donors")).where("donors > 1")


@query("j14_run_difference", W + M.SIGNATURE + ", a AS (SELECT cell, exact FROM sig WHERE nchains <= 4), b AS (SELECT cell, exact FROM sig WHERE nchains >= 2) SELECT 'only_first' AS side, cell, exact FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'only_second', cell, exact FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def j14(spark, d):
    s = M.signatures(spark, d)
    a, b = (s.where(c).select("cell", "exact") for c in ("nchains <= 4", "nchains >= 2"))
    return a.exceptAll(b).select(F.lit("only_first").alias("side"), "cell", "exact").union(b.exceptAll(a).select(F.lit("only_second"), "cell", "exact"))


@query("j15_pair_proximity", W + M.SEGMENT + " SELECT a.name AS n1, b.name AS n2 FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name < b.name AND substr(a.name, 1, 1) <> substr(b.name, 1, 1) WHERE hamming(a.seq, b.seq) <= 0.72::DOUBLE * 96")
def j15(spark, d):
    p = G.similar_pairs(named(spark, d), "id", ["len"], (F.substring("a.id", 1, 1) != F.substring("b.id", 1, 1)) & (apart() <= 0.72 * 96))
    return p.select(F.col("src").alias("n1"), F.col("dst").alias("n2"))


COHERENCE = W + M.SEGMENT + ", x AS (SELECT a.name AS n1, b.name AS n2, CAST(floor(10 * CAST(96 - hamming(a.seq, b.seq) AS DOUBLE) / 96) AS BIGINT) AS decile, substr(a.name, 1, 1) = substr(b.name, 1, 1) AS same FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name < b.name)"


def coherence(spark, d):
    """Identity decile and agreement of each pair of a block; counted where the pairs are made, none of them is shuffled."""
    a, b = named(spark, d).alias("a"), named(spark, d).alias("b")
    p = a.join(b, (F.col("a.len") == F.col("b.len")) & (F.col("a.id") < F.col("b.id")))
    return p.select(F.floor(10 * (96 - apart()).cast("double") / 96).alias("decile"), (F.substring("a.id", 1, 1) == F.substring("b.id", 1, 1)).alias("same"))


@query("a43_coherence_by_identity", COHERENCE + " SELECT decile, count(*) AS pairs, CAST(count(*) FILTER (same) AS DOUBLE) / count(*) AS coherence FROM x GROUP BY ROLLUP(decile)")
def a43(spark, d):
    return coherence(spark, d).rollup("decile").agg(F.count("*").alias("pairs"), (F.count_if("same").cast("double") / F.count("*")).alias("coherence"))


@query("a44_private_coherence", COHERENCE + " SELECT decile, count(*) AS pairs FROM x WHERE NOT same GROUP BY decile")
def a44(spark, d):
    return coherence(spark, d).where(~F.col("same")).groupBy("decile").agg(F.count("*").alias("pairs"))


@query("a45_cumulative_coherence", COHERENCE + ", u AS (SELECT unnest(range(0, decile + 1)) AS u, same FROM x) SELECT u, count(*) AS pairs, CAST(count(*) FILTER (same) AS DOUBLE) / count(*) AS coherence FROM u GROUP BY u")
def a45(spark, d):
    u = coherence(spark, d).select(F.explode(F.sequence(F.lit(0).cast("long"), "decile")).alias("u"), "same")
    return u.groupBy("u").agg(F.count("*").alias("pairs"), (F.count_if("same").cast("double") / F.count("*")).alias("coherence"))


# --- windows ---


@query("w01_ordinals", W + M.SIGNATURE + ", g AS (SELECT clono, exact, count(*) AS n FROM sig GROUP BY ALL) SELECT clono, exact, row_number() OVER (PARTITION BY clono ORDER BY n DESC, exact) AS exact_subclonotype_id FROM g")
def w01(spark, d):
    g = M.signatures(spark, d).groupBy("clono", "exact").agg(F.count("*").alias("n"))
    return g.select("clono", "exact", F.row_number().over(Window.partitionBy("clono").orderBy(F.desc("n"), "exact")).cast("long").alias("exact_subclonotype_id"))


@query("w02_exact_order", W + M.SIGNATURE + ", g AS (SELECT clono, exact, count(*) AS n, sum(umi) AS u FROM sig GROUP BY ALL) SELECT clono, exact, row_number() OVER (PARTITION BY clono ORDER BY exact DESC, n DESC, u DESC) AS place FROM g")
def w02(spark, d):
    g = M.signatures(spark, d).groupBy("clono", "exact").agg(F.count("*").alias("n"), F.sum("umi").alias("u"))
    return g.select("clono", "exact", F.row_number().over(Window.partitionBy("clono").orderBy(F.desc("exact"), F.desc("n"), F.desc("u"))).cast("long").alias("place"))


@query("w03_near_far", W + M.SEGMENT + " SELECT a.name, CAST(min(hamming(a.seq, b.seq)) AS BIGINT) AS near, CAST(max(hamming(a.seq, b.seq)) AS BIGINT) AS far FROM seg a LEFT JOIN seg b ON length(a.name) = length(b.name) AND a.name <> b.name GROUP BY a.name")
def w03(spark, d):
    n = named(spark, d)
    a, b = n.alias("a"), n.alias("b")
    x = a.join(b, (F.col("a.len") == F.col("b.len")) & (F.col("a.id") != F.col("b.id")), "left")
    h = F.when(F.col("b.seq").isNotNull(), apart())
    return x.groupBy(F.col("a.id").alias("name")).agg(F.min(h).alias("near"), F.max(h).alias("far"))


@query("w04_difference_to_nth", W + M.SEGMENT + ", r AS (SELECT name, seq, length(name) AS len, row_number() OVER (PARTITION BY length(name) ORDER BY name) AS k FROM seg) SELECT a.name, CAST(hamming(a.seq, b.seq) AS BIGINT) AS ndiff2vj FROM r a LEFT JOIN r b ON a.len = b.len AND b.k = 2")
def w04(spark, d):
    r = named(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("len").orderBy("id")))
    second = r.where("k = 2").select("len", F.col("seq").alias("s2"))
    return r.join(second, "len", "left").select(F.col("id").alias("name"), F.when(F.col("s2").isNotNull(), S.hamming(F.col("seq"), F.col("s2")).cast("long")).alias("ndiff2vj"))


similar("w05_hamming_groups", ITEMS, "a.len = b.len AND hamming(a.seq, b.seq) <= 66", named, ["len"], lambda: apart() <= 66)

VECTORS = "v AS (SELECT vec_id AS cell, label % 2 = 0 AS vdj, list_transform(embedding, lambda x: CAST(floor(1000 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings), p AS (SELECT a.cell AS a, b.cell AS b, b.vdj, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT) AS dist FROM v a JOIN v b ON a.vdj)"


def vectors(spark, d):
    """Every cell's vector in thousandths; the query set is the cells that the receptor data calls."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda e: F.floor(1000 * e))
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), x.alias("v"), (F.col("label") % 2 == 0).alias("mark"))


@query("w06_credibility", W + VECTORS + ", r AS (SELECT a, vdj, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM p WHERE a <> b) SELECT a AS cell, CAST(count(*) FILTER (vdj) AS DOUBLE) * 100 / count(*) AS cred FROM r WHERE k <= 20 GROUP BY a")
def w06(spark, d):
    r = nearest(vectors(spark, d), "mark", 20)
    return r.groupBy(F.col("query").alias("cell")).agg((F.count_if("mark").cast("double") * 100 / F.count("*")).alias("cred"))


@query("w06_credibility_n_nearest", W + VECTORS + ", n AS (SELECT count(*) AS n FROM v WHERE vdj AND v IS NOT NULL), r AS (SELECT a, vdj, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS k FROM p WHERE dist IS NOT NULL) SELECT a AS cell, CAST(count(*) FILTER (vdj) AS DOUBLE) * 100 / any_value(n) AS cred FROM r, n WHERE k <= n GROUP BY a")
def w06n(spark, d):
    """The reference's rule: as many neighbours as there are called cells, the cell itself among them."""
    r = marked_among_nearest(vectors(spark, d))
    return r.select(F.col("query").alias("cell"), F.try_divide(F.col("marked").cast("double") * 100, F.col("n").cast("double")).alias("cred"))


@query("w07_within_radius", W + VECTORS + " SELECT a AS cell, count(*) FILTER (dist <= 1000000) AS npe, CAST(count(*) FILTER (dist <= 1000000 AND vdj) AS DOUBLE) * 100 / nullif(count(*) FILTER (dist <= 1000000), 0) AS ppe FROM p GROUP BY a")
def w07(spark, d):
    r = within(vectors(spark, d), "mark", 1000000)
    return r.select(F.col("query").alias("cell"), F.col("n").alias("npe"), F.try_divide(F.col("marked").cast("double") * 100, F.col("n").cast("double")).alias("ppe"))


# --- scan ---

SCAN = W + M.MEMBER + ", " + M.FEATURE + """, s AS (SELECT DISTINCT f.cell, f.cell % 2 = 0 AS test FROM feat f), n AS (SELECT count(*) FILTER (test) AS nt, count(*) FILTER (NOT test) AS nc FROM s),
  a AS (SELECT feature, CAST(sum(CASE WHEN s.test THEN count ELSE 0 END) AS DOUBLE) / any_value(nt) AS test_mean, CAST(sum(CASE WHEN NOT s.test THEN count ELSE 0 END) AS DOUBLE) / any_value(nc) AS control_mean FROM feat JOIN s USING (cell), n GROUP BY feature)
  SELECT feature, test_mean, control_mean, test_mean / nullif(control_mean, 0) AS enrichment FROM a WHERE test_mean >= 0.9::DOUBLE * control_mean"""


@query("n01_feature_scan", SCAN)
def n01(spark, d):
    """Mean counts of a test and a control set, cells without a count being zero; features over a threshold."""
    from lymphframe.operators.scan import feature_scan

    f = M.features(spark, d)
    return feature_scan(f, f.select("cell").distinct(), F.col("cell") % 2 == 0, F.col("cell") % 2 == 1, C.linear("test_mean - 0.9*control_mean >= 0", ["test_mean", "control_mean"]))


@query("n02_scan_by_group", W + M.FEATURE + " SELECT feature, CAST(sum(CASE WHEN cell % 3 = 0 THEN count ELSE 0 END) AS DOUBLE) / count(DISTINCT CASE WHEN cell % 3 = 0 THEN cell END) AS test_mean, CAST(sum(CASE WHEN cell % 3 = 1 THEN count ELSE 0 END) AS DOUBLE) / count(DISTINCT CASE WHEN cell % 3 = 1 THEN cell END) AS control_mean FROM feat GROUP BY feature HAVING count(DISTINCT CASE WHEN cell % 3 = 0 THEN cell END) = (SELECT count(DISTINCT cell) FROM feat WHERE cell % 3 = 0)")
def n02(spark, d):
    from lymphframe.operators.scan import feature_scan

    f = M.features(spark, d)
    return feature_scan(f, f.select("cell").distinct(), F.col("cell") % 3 == 0, F.col("cell") % 3 == 1, F.lit(True)).drop("enrichment")
