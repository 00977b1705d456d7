"""The filters as one chain with switches, K05, K15, K18 and F30; requests P03; segment filters P10 and P11; metrics A49; S23, S25 and S28."""

from __future__ import annotations

from pyspark.sql import functions as F

from lymphframe.functions import amino as A
from lymphframe.functions import regions as R
from lymphframe.operators import filters as K
from lymphframe.operators import plots as P
from lymphframe.plans.functions import AA
from lymphframe.plans.more import REGIONS, long_amino
from lymphframe.plans.noise import TAIL
from lymphframe.plans.registry import query
from lymphframe.session import stage_path, table
from lymphframe.sources import convert
from lymphframe.sources import mapped as M
from lymphframe.sources import sinks

W = "WITH "


def steps(spark, d) -> list[K.Step]:
    """The chain's filters in their order; limits suit the mapped tables."""
    called = table(spark, d, "events").select(F.col("user_id").alias("cell")).distinct()
    return [
        K.Step("CELL", "NCELL", "status = 'P'"),
        K.Step("MAX_CONTIGS", "NMAX", "nchains > 6"),
        K.Step("BC_DUP", "NBC_DUP", K.duplicated(["exact", "barcode"])),
        K.Step("IMPROPER", "NIMPROPER", "nchains > 1 AND clono RLIKE ':.$'"),
        K.Step("UMI_RATIO", "NUMI_RATIO", K.outdone("exact", "top", "umi", 2)),
        K.Step("GEX", "NGEX", lambda cells: cells.join(called, "cell", "left_anti")),
        K.Step("SIGNATURE", "NSIG", K.contaminants("exact", "nchains")),
    ]


def chain_cells(spark, d):
    """Members with a made-up barcode that cells share, and the UMIs of their best chain."""
    best = M.chains_plain(spark, d).groupBy("cell").agg(F.max("umi").alias("top"))
    return M.members(spark, d).join(best, "cell").withColumn("barcode", F.col("cell") % 1000)


CHAIN_SQL = (
    W + M.MEMBER + ", x AS (SELECT cell, max(umi) AS top FROM plain GROUP BY cell), a0 AS (SELECT mem.*, x.top, CASE WHEN status = 'P' THEN 'CELL' WHEN nchains > 6 THEN 'MAX_CONTIGS' END AS filter FROM mem JOIN x USING (cell)), "
    "a1 AS (SELECT * REPLACE (CASE WHEN filter IS NULL AND count(*) FILTER (filter IS NULL) OVER (PARTITION BY exact, cell % 1000) > 1 THEN 'BC_DUP' ELSE filter END AS filter) FROM a0), "
    "a2 AS (SELECT * REPLACE (CASE WHEN filter IS NULL AND nchains > 1 AND length(clono) - position(':' IN clono) = 1 THEN 'IMPROPER' ELSE filter END AS filter) FROM a1), "
    "t AS (SELECT exact, max(top) AS t FROM a2 WHERE filter IS NULL GROUP BY exact), g AS (SELECT exact, count(*) AS n, count(*) FILTER (t >= 2 * umi) AS k FROM a2 JOIN t USING (exact) WHERE filter IS NULL GROUP BY exact), "
    "r AS (SELECT exact, t FROM g JOIN t USING (exact) WHERE n >= 2 AND k > 0 AND " + TAIL + " < 0.01), "
    "a3 AS (SELECT a2.* REPLACE (CASE WHEN filter IS NULL AND r.t >= 2 * umi THEN 'UMI_RATIO' ELSE filter END AS filter) FROM a2 LEFT JOIN r USING (exact)), "
    "a4 AS (SELECT * REPLACE (CASE WHEN filter IS NULL AND cell NOT IN (SELECT user_id FROM events WHERE user_id IS NOT NULL) THEN 'GEX' ELSE filter END AS filter) FROM a3), "
    "s AS (SELECT exact, string_split(exact, ' ') AS s, count(*) AS n FROM a4 WHERE filter IS NULL AND nchains = 2 GROUP BY exact), c AS (SELECT exact, n, unnest(list_distinct(s)) AS chain FROM s), "
    "o AS (SELECT p.exact, any_value(p.n) AS n, sum(q.n) AS others FROM c p JOIN c q ON p.chain = q.chain AND p.exact <> q.exact GROUP BY p.exact), "
    "a5 AS (SELECT * REPLACE (CASE WHEN filter IS NULL AND exact IN (SELECT exact FROM o WHERE others >= 20 * n) THEN 'SIGNATURE' ELSE filter END AS filter) FROM a4) "
)


@query("k18_filter_chain", CHAIN_SQL + "SELECT cell, filter FROM a5")
def k18c(spark, d):
    """What each cell fell to when all filters of the chain run in order."""
    return K.run_chain(chain_cells(spark, d), steps(spark, d)).select("cell", "filter")


@query("k18_all_but_cell", W + M.MEMBER + " SELECT cell, CASE WHEN status = 'P' THEN 'CELL' END AS filter FROM mem")
def k18b(spark, d):
    """NALL_CELL."""
    return K.run_chain(chain_cells(spark, d), steps(spark, d), ["NALL_CELL"]).select("cell", "filter")


@query("k18_fate_counts", CHAIN_SQL + "SELECT dataset, coalesce(filter, 'kept') AS fate, count(*) AS n FROM a5 GROUP BY ALL")
def k18f(spark, d):
    c = K.run_chain(chain_cells(spark, d), steps(spark, d))
    return c.groupBy("dataset", F.coalesce("filter", F.lit("kept")).alias("fate")).agg(F.count("*").alias("n"))


def whole_cells(spark, d):
    """Cells for the sixteen default filters: chains by side and V segment, barcodes of customers, clonotypes of market segment and least heavy chain."""
    v = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.substring("p_brand", -2, 1).alias("v"))
    c = M.chains_plain(spark, d).join(v, "part").select("cell", F.concat(F.when(F.col("heavy"), "H").otherwise("L"), "v").alias("key"), "umi")
    c = c.groupBy("cell", "key").agg(F.max("umi").alias("umi")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("key", "umi"))).alias("parts"), F.sum("umi").alias("umi"), F.max("umi").alias("top"), F.count("*").alias("nchains"))
    code = F.md5(F.col("o_custkey").cast("string").cast("binary"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), (F.col("o_orderstatus") != "P").alias("called"), F.concat(F.substring(code, 1, 3), F.lit("AAAAA"), F.substring(code, 4, 8)).alias("barcode"))
    x = M.cells(spark, d).select("cell", "dataset").join(o, "cell").join(c, "cell")
    keys = F.transform("parts", lambda p: p["key"])
    return x.select("cell", "dataset", "barcode", "called", "umi", "top", "nchains", "parts", F.array_join(keys, " ").alias("exact"), F.concat_ws("/", "dataset", F.col("parts")[0]["key"]).alias("clonotype"))


@query("k18_default_filters")
def k18w(spark, d):
    """What each cell falls to, and the clonotype of those that stay, when all default filters run in order."""
    called = table(spark, d, "events").select(F.col("user_id").alias("cell")).distinct()
    limits = K.Limits(cross=0.3, cross_umis=30, umi_ratio=3, weak_onesies=0.01, merge_onesies=0.001, baseline_cells=5)
    return K.run_chain(whole_cells(spark, d), K.default_filters(called, limits)).select("cell", "filter", "clonotype")


@query("k15_merged_onesies", W + M.SIGNATURE + ", g AS (SELECT exact, nchains, count(*) AS n FROM sig GROUP BY ALL), m AS (SELECT exact, unnest(list_distinct(string_split(exact, ' '))) AS chain FROM g WHERE nchains > 1), b AS (SELECT chain, min(exact) AS into_ FROM m GROUP BY chain) SELECT g.exact, CASE WHEN g.n >= 0.001 * (SELECT count(*) FROM sig) THEN coalesce(b.into_, g.exact) ELSE g.exact END AS clonotype FROM g LEFT JOIN b ON g.exact = b.chain WHERE g.nchains = 1")
def k15m(spark, d):
    """A single chain joins the least signature that has it, unless it is too rare for that."""
    s = M.signatures(spark, d)
    g = s.groupBy("exact", "nchains").agg(F.count("*").alias("n"))
    b = g.where("nchains > 1").select("exact", F.explode(F.array_distinct(F.split("exact", " "))).alias("chain")).groupBy("chain").agg(F.min("exact").alias("into"))
    one = g.where("nchains = 1").crossJoin(s.agg(F.count("*").alias("t"))).join(b, F.col("exact") == F.col("chain"), "left")  # one-row side
    return one.select("exact", F.when(F.col("n") >= 0.001 * F.col("t"), F.coalesce("into", "exact")).otherwise(F.col("exact")).alias("clonotype"))


REQUEST = "cdr1,fwr1,fwr2,var,120-123"


@query("p03_amino_request", REGIONS.split(" SELECT name, fr1")[0].rstrip() + ", reg AS (" + REGIONS[REGIONS.index("SELECT name, fr1"):] + """), v AS (SELECT substr(l.name, 1, 1) AS initial, i - 1 AS base FROM (SELECT name, substr(seq, 1, 24) AS seq FROM lng) l, unnest(range(1, 25)) t(i) GROUP BY ALL HAVING count(DISTINCT substr(l.seq, i, 1)) > 1),
  w AS (SELECT initial, list(base // 3) AS p FROM v GROUP BY initial), pl AS (SELECT res.name, res.aa, list_sort(list_distinct(list_concat(CASE WHEN cdr1 < fr2 THEN range(cdr1, fr2) ELSE [] END, CASE WHEN fr1 < cdr1 THEN range(fr1, cdr1) ELSE [] END, CASE WHEN fr2 < cdr2 THEN range(fr2, cdr2) ELSE [] END, coalesce(w.p, []), range(120, 124)))) AS p FROM res JOIN reg USING (name) LEFT JOIN w ON substr(res.name, 1, 1) = w.initial)
  SELECT name, array_to_string(p, ',') AS positions, array_to_string(list_transform(p, lambda i: substr(aa, i + 1, 1)), '') AS residues FROM pl""")
def p03r(spark, d):
    """Positions and residues of a request over kappa regions; the first 24 bases vary within names of one initial."""
    x = long_amino(spark, d).withColumn("initial", F.substring("name", 1, 1))
    raw = M.segments(spark, d).select(F.substring("name", 1, 1).alias("initial"), F.posexplode(F.split(F.substring(M.dna(F.col("name")), 1, 24), "")).alias("base", "letter")).where("letter <> ''")
    var = raw.groupBy("initial", "base").agg(F.count_distinct("letter").alias("k")).where("k > 1").groupBy("initial").agg(F.collect_list("base").alias("var"))
    x = x.join(var, "initial", "left").withColumn("s", R.starts(F.col("aa"), "IGK"))
    at = {c: F.col("var") if c == "var" else F.col(f"s.{c}") for c in A.needs(REQUEST)}
    x = x.withColumn("p", A.positions(REQUEST, at))
    return x.select("name", F.array_join(F.col("p").cast("array<string>"), ",").alias("positions"), A.shown(F.col("aa"), F.col("p")).alias("residues"))


@query("a49_clonotyping_metrics", W + M.MEMBER + ", g AS (SELECT exact, donor, count(*) AS n FROM mem GROUP BY ALL), k AS (SELECT exact, sum(n) AS n, sum(n * n) AS q, sum(n * (n - 1)) AS w, count(*) AS donors FROM g GROUP BY exact), z AS (SELECT donor, sum(n) AS n FROM g GROUP BY donor) SELECT CAST(sum(k.w) // 2 AS BIGINT) AS merges, CAST(sum(k.n * k.n - k.q) // 2 AS BIGINT) AS mixes, count(*) FILTER (donors > 1) AS mixed_clonotypes, count(*) FILTER (k.n > 1) AS clonotypes_of_two, (SELECT CAST((sum(n) * sum(n) - sum(n * n)) // 2 AS BIGINT) FROM z) AS cross_pairs FROM k")
def a49m(spark, d):
    """Pairs within and across donors from group sizes, no pair being made."""
    g = M.members(spark, d).groupBy("exact", "donor").agg(F.count("*").alias("n"))
    k = g.groupBy("exact").agg(F.sum("n").alias("n"), F.sum(F.expr("n * n")).alias("q"), F.sum(F.expr("n * (n - 1)")).alias("w"), F.count("*").alias("donors"))
    z = g.groupBy("donor").agg(F.sum("n").alias("n")).agg(F.expr("(sum(n) * sum(n) - sum(n * n)) div 2").alias("cross_pairs"))
    m = k.agg(F.expr("sum(w) div 2").alias("merges"), F.expr("sum(n * n - q) div 2").alias("mixes"), F.count_if(F.col("donors") > 1).alias("mixed_clonotypes"), F.count_if(F.col("n") > 1).alias("clonotypes_of_two"))
    return m.crossJoin(z)  # one-row sides


PEERS = W + AA + ", f AS (SELECT length(name) AS len, i - 1 AS pos, substr(aa, i, 1) AS residue, count(*) AS n FROM aa, unnest(range(1, 33)) t(i) GROUP BY ALL), m AS (SELECT name, length(name) AS len FROM seg)"


def peer_rows(spark, d):
    """Members and the residue counts of their peers: sequences of the same name length."""
    s = M.segments(spark, d).select("name", F.length("name").alias("len"), "seq")
    return s.select("name", "len"), sinks.peer_groups(s, "len", "seq")


@query("s23_peer_group_csv", PEERS + " SELECT name || ',' || pos || ',' || residue || ',' || n AS line FROM m JOIN f USING (len)")
def s23c(spark, d):
    m, g = peer_rows(spark, d)
    return sinks.peer_lines(m, g, ["name"], "len")


@query("s23_peer_group_readable", PEERS + " SELECT name || ',' || pos || ',' || string_agg(residue || '=' || n, ':' ORDER BY residue) AS line FROM m JOIN f USING (len) GROUP BY name, pos")
def s23r(spark, d):
    m, g = peer_rows(spark, d)
    return sinks.peer_lines(m, g, ["name"], "len", readable=True)


@query("s25_saved_layout", "SELECT o_orderkey % 7 AS dataset, CAST(o_orderkey AS VARCHAR) AS barcode, CAST(o_custkey AS DOUBLE) / 4 AS x, floor(o_totalprice) / 8 - 0.5 AS y FROM orders")
def s25(spark, d):
    """Places of cells, saved and given to the cells again."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 7).alias("dataset"), F.col("o_orderkey").cast("string").alias("barcode"), (F.col("o_custkey").cast("double") / 4).alias("x"), (F.floor("o_totalprice").cast("double") / 8 - 0.5).alias("y"))
    path = stage_path(spark, "layout.csv")
    P.save_layout(o, path)
    return P.load_layout(o.select("dataset", "barcode"), path)


@query("p10_segment_ids", "WITH t AS (SELECT l_orderkey AS cell, bool_or(l_partkey IN (3, 5, 8, 13)) AS has, bool_or(l_partkey = 21) AS barred FROM lineitem GROUP BY l_orderkey) SELECT cell FROM t WHERE has AND NOT barred")
def p10n(spark, d):
    """SEGN and NSEGN: cells with a segment of one of these ids and none of that; one pass over chains, no join."""
    t = M.chains_plain(spark, d).groupBy("cell").agg(F.bool_or(F.col("part").isin(3, 5, 8, 13)).alias("has"), F.bool_or(F.col("part") == 21).alias("barred"))
    return t.where("has AND NOT barred").select("cell")


@query("p11_sequence_and_dataset", W + M.MEMBER + ", k AS (SELECT exact FROM mem GROUP BY exact HAVING bool_or(dataset IN ('BUILDING', 'MACHINERY')) AND bool_or(cell IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_name = (SELECT min(p_name) FROM part)))) SELECT cell, exact FROM mem WHERE exact IN (SELECT exact FROM k)")
def p11s(spark, d):
    """VJ and DATASET keep whole clonotypes: one member with the sequence, one of a dataset."""
    part = table(spark, d, "part")
    least = part.agg(F.min("p_name").alias("p_name"))
    named = part.join(F.broadcast(least), "p_name", "left_semi").select(F.col("p_partkey").alias("part"))  # one-row side
    with_it = M.chains_plain(spark, d).join(named, "part", "left_semi").select("cell", F.lit(True).alias("has")).distinct()
    m = M.members(spark, d).select("cell", "exact", "dataset")
    k = m.join(with_it, "cell", "left").groupBy("exact").agg(F.bool_or(F.col("dataset").isin("BUILDING", "MACHINERY")).alias("in_set"), F.max("has").alias("has")).where("in_set AND has")
    return m.join(k, "exact", "left_semi").select("cell", "exact")


def contig_rows(spark, d):
    """Line items as contig annotations, their part's derived sequence being the contig."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    x = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    feature = lambda kind, name: F.struct(F.struct(F.lit("IGH").alias("chain"), F.col(name).alias("gene_name"), F.lit(kind).alias("region_type")).alias("feature"))
    return x.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-1")).alias("barcode"), F.concat(F.col("l_orderkey").cast("string"), F.lit("-1_contig_"), F.col("l_linenumber").cast("string")).alias("contig_name"),
        M.dna(F.col("p_name")).alias("sequence"), (F.col("l_linestatus") == "F").alias("is_cell"), F.lit(True).alias("high_confidence"), F.when(F.col("l_returnflag") != "N", True).alias("productive"), F.lit(None).cast("boolean").alias("full_length"),
        F.col("p_name").alias("cdr3"), F.lit(None).cast("string").alias("cdr3_seq"), F.floor("l_extendedprice").alias("read_count"), F.col("l_quantity").cast("long").alias("umi_count"), F.lit("x").alias("dataset"),
        F.array(feature("L-REGION+V-REGION", "p_brand"), feature("J-REGION", "p_type")).alias("annotations"),
    )


CONTIGS = "WITH f AS (SELECT l_orderkey || '-x' AS barcode, l_linestatus = 'F' AS is_cell, l_orderkey || '-x_contig_' || l_linenumber AS contig_id, p_brand AS v_gene, p_type AS j_gene, l_returnflag <> 'N' AS productive, p_name AS cdr3, CAST(floor(l_extendedprice) AS BIGINT) AS reads, CAST(l_quantity AS BIGINT) AS umis, " + M.DNA_SQL + " AS seq FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query("s28_filtered_from_json", CONTIGS + " SELECT barcode, is_cell, contig_id, TRUE AS high_confidence, 96 AS length, 'IGH' AS chain, v_gene, '' AS d_gene, j_gene, '' AS c_gene, FALSE AS full_length, productive, cdr3, '' AS cdr3_nt, reads, umis, '' AS raw_clonotype_id, '' AS raw_consensus_id, seq FROM f")
def s28f(spark, d):
    return convert.filtered_from_annotations(contig_rows(spark, d))


@query("s28_json_from_filtered", CONTIGS + """ SELECT '{"barcode":"' || barcode || '","contig_name":"' || contig_id || '","is_cell":' || is_cell || ',"high_confidence":true,"productive":' || productive || ',"read_count":' || reads || ',"umi_count":' || umis || ',"sequence":"' || seq || '","quals":"' || repeat(']', 96) || '"}' AS record FROM (SELECT * REPLACE (min(seq) OVER (PARTITION BY contig_id) AS seq) FROM f)""")
def s28j(spark, d):
    """The filtered table and its sequences, turned back into annotations; a contig that stands twice meets its one sequence."""
    f = convert.filtered_from_annotations(contig_rows(spark, d))
    return convert.annotations_from_filtered(f.drop("seq"), f.groupBy("contig_id").agg(F.min("seq").alias("seq")))
