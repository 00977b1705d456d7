"""Aggregations A01-A51, ordering O01-O09."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphframe.functions.stats import SUFFIXES, distinct_list, percent, rounded_median, run_lengths
from lymphframe.functions.umis import marking_statistics, validated_statistics
from lymphframe.plans.registry import query
from lymphframe.session import table
from lymphframe.sources import mapped as M

W = "WITH "
HALF = "CAST(floor({} + 0.5) AS BIGINT)"


@query("a01_rounded_median", W + M.MEMBER + " SELECT exact, CAST(floor(median(umi) + 0.5) AS BIGINT) AS u, CAST(floor(median(reads) + 0.5) AS BIGINT) AS r FROM mem GROUP BY exact")
def a01(spark: SparkSession, d: str) -> DataFrame:
    return M.members(spark, d).groupBy("exact").agg(rounded_median(F.col("umi")).alias("u"), rounded_median(F.col("reads")).alias("r"))


@query("a02_plain_median", W + M.MEMBER + " SELECT clono, median(CAST(reads AS DOUBLE) / umi) AS reads_per_umi FROM mem WHERE umi > 0 GROUP BY clono")
def a02(spark, d):
    return M.members(spark, d).where("umi > 0").groupBy("clono").agg(F.median(F.col("reads").cast("double") / F.col("umi")).alias("reads_per_umi"))


@query("a03_suffix_aggregates", W + M.PLAIN + """ SELECT cell, CAST(floor(CAST(sum(umi) AS DOUBLE) / count(umi) + 0.5) AS BIGINT) AS u_mean, CAST(sum(umi) AS BIGINT) AS u_sum, min(umi) AS u_min, max(umi) AS u_max,
  CAST(floor(median(umi) + 0.5) AS BIGINT) AS u FROM plain GROUP BY cell""")
def a03(spark, d):
    u = F.col("umi")
    return M.chains_plain(spark, d).groupBy("cell").agg(*(SUFFIXES[s](u).alias(f"u{s}") for s in ("_mean", "_sum", "_min", "_max", "")))


@query("a04_percent_of_sums", W + M.FEATURE + ", t AS (SELECT cell, CAST(sum(count) AS BIGINT) AS gex FROM feat GROUP BY cell) SELECT feature, floor(CAST(sum(count) AS DOUBLE) * 10000 / (SELECT sum(gex) FROM t) + 0.5) / 100 AS feature_percent FROM feat GROUP BY feature")
def a04(spark, d):
    f = M.features(spark, d)
    by = f.groupBy("feature").agg(F.sum("count").alias("n"))
    return by.crossJoin(F.broadcast(f.agg(F.sum("count").alias("gex")))).select("feature", percent(F.col("n"), F.col("gex")).alias("feature_percent"))  # a one-row side


@query("a05_percent_per_cell", W + M.FEATURE + " SELECT cell, feature, floor(CAST(count AS DOUBLE) * 10000 / nullif(sum(count) OVER (PARTITION BY cell), 0) + 0.5) / 100 AS pct FROM feat")
def a05(spark, d):
    return M.features(spark, d).select("cell", "feature", percent(F.col("count"), F.nullif(F.sum("count").over(Window.partitionBy("cell")), F.lit(0))).alias("pct"))


@query("a06_counts", W + M.MEMBER + " SELECT exact, clono, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY clono) AS BIGINT) AS clonotype_ncells FROM mem GROUP BY exact, clono")
def a06(spark, d):
    n = M.members(spark, d).groupBy("exact", "clono").agg(F.count("*").alias("n"))
    return n.withColumn("clonotype_ncells", F.sum("n").over(Window.partitionBy("clono")))


@query("a07_cells_of_name", W + M.MEMBER + " SELECT clono, count(*) FILTER (dataset = 'BUILDING' OR origin = 'BUILDING' OR donor = 'BUILDING' OR tag = 'BUILDING') AS n_building, count(*) FILTER (dataset = '1-URGENT' OR origin = '1-URGENT' OR donor = '1-URGENT' OR tag = '1-URGENT') AS n_urgent FROM mem GROUP BY clono")
def a07(spark, d):
    named = lambda v: F.count_if((F.col("dataset") == v) | (F.col("origin") == v) | (F.col("donor") == v) | (F.col("tag") == v))
    return M.members(spark, d).groupBy("clono").agg(named("BUILDING").alias("n_building"), named("1-URGENT").alias("n_urgent"))


@query("a08_top_datasets_and_rest", W + M.MEMBER + """, c AS (SELECT clono, dataset, count(*) AS n FROM mem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY clono ORDER BY n DESC, dataset) AS k FROM c)
  SELECT clono, CASE WHEN k <= 2 THEN 'n_' || dataset ELSE 'n_other' END AS field, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY ALL""")
def a08(spark, d):
    n = M.members(spark, d).groupBy("clono", "dataset").agg(F.count("*").alias("n"))
    k = F.row_number().over(Window.partitionBy("clono").orderBy(F.desc("n"), "dataset"))
    field = F.when(k <= 2, F.concat(F.lit("n_"), "dataset")).otherwise("n_other")
    return n.withColumn("field", field).groupBy("clono", "field").agg(F.sum("n").alias("n"))


@query("a09_distinct_lists", W + M.MEMBER + " SELECT exact, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, string_agg(DISTINCT donor, ',' ORDER BY donor) AS donors FROM mem GROUP BY exact")
def a09(spark, d):
    return M.members(spark, d).groupBy("exact").agg(*(distinct_list(F.col(c)).alias(f"{c}s") for c in ("dataset", "origin", "donor")))


@query("a10_chain_counts", W + M.SIGNATURE + " SELECT s.cell, s.nchains, count(DISTINCT p.kind || p.c_name) AS nchains_present FROM sig s JOIN plain p USING (cell) GROUP BY ALL")
def a10(spark, d):
    return M.chains_plain(spark, d).groupBy("cell").agg(F.count("*").alias("nchains"), F.countDistinct(F.concat("kind", "c_name")).alias("nchains_present"))


@query("a11_cluster_multiset", W + M.MEMBER + ", c AS (SELECT clono, status, count(*) AS n FROM mem GROUP BY ALL) SELECT clono, string_agg(status || CASE WHEN n > 1 THEN '*' || n ELSE '' END, ',' ORDER BY status) AS clust FROM c GROUP BY clono")
def a11(spark, d):
    n = M.members(spark, d).groupBy("clono", "status").agg(F.count("*").alias("n"))
    item = F.concat("status", F.when(F.col("n") > 1, F.concat(F.lit("*"), F.col("n").cast("string"))).otherwise(""))
    return n.groupBy("clono").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("status", item.alias("i")))), lambda s: s["i"]), ",").alias("clust"))


@query("a11_small_multiset", W + M.SIGNATURE + ", c AS (SELECT cell, kind, count(*) AS n FROM plain GROUP BY ALL) SELECT cell, string_agg(kind || CASE WHEN n > 1 THEN '*' || n ELSE '' END, ',' ORDER BY kind) AS clust FROM c GROUP BY cell")
def a11b(spark, d):
    return M.chains_plain(spark, d).groupBy("cell").agg(run_lengths(F.col("kind")).alias("clust"))


@query("a12_a13_conditional_counts", W + M.MEMBER + ", " + M.FEATURE + ", g AS (SELECT DISTINCT cell FROM feat) SELECT clono, count(*) FILTER (cell IN (SELECT cell FROM g)) AS n_gex, count(*) FILTER (status LIKE 'F%') AS n_b, count(*) FILTER (tag = '1-URGENT') AS mark FROM mem GROUP BY clono")
def a12(spark, d):
    g = M.features(spark, d).select("cell").distinct().withColumn("gex", F.lit(True))
    return M.members(spark, d).join(g, "cell", "left").groupBy("clono").agg(F.count_if(F.coalesce("gex", F.lit(False))).alias("n_gex"), F.count_if(F.col("status").startswith("F")).alias("n_b"), F.count_if(F.col("tag") == "1-URGENT").alias("mark"))


@query("a14_secreted_membrane", W + M.MEMBER + " SELECT exact, CAST(sum(umi) FILTER (status = 'F') AS BIGINT) AS sec, CAST(sum(umi) FILTER (status = 'O') AS BIGINT) AS mem FROM mem GROUP BY exact")
def a14(spark, d):
    """Sums of a precomputed per-cell table, here UMIs by status."""
    u = lambda s: F.sum(F.when(F.col("status") == s, F.col("umi")))
    return M.members(spark, d).groupBy("exact").agg(u("F").alias("sec"), u("O").alias("mem"))


@query("a15_entropy", W + M.FEATURE + ", q AS (SELECT cell, CAST(count AS DOUBLE) / sum(count) OVER (PARTITION BY cell) AS q FROM feat WHERE count > 0) SELECT cell, CAST(round(-sum(q * log2(q)) * 100) AS BIGINT) AS entropy_hundredths FROM q GROUP BY cell")
def a15(spark, d):
    q = M.features(spark, d).where("count > 0").select("cell", (F.col("count").cast("double") / F.sum("count").over(Window.partitionBy("cell"))).alias("q"))
    return q.groupBy("cell").agg(F.round(-F.sum(F.col("q") * F.log2("q")) * 100).cast("long").alias("entropy_hundredths"))


@query("a16_sum_and_mean_rows", W + M.MEMBER + """ SELECT clono, 'sum' AS line, CAST(sum(umi) AS DOUBLE) AS umi FROM mem GROUP BY clono UNION ALL SELECT clono, 'mean', CAST(sum(CASE WHEN status <> 'P' THEN umi END) AS DOUBLE) / count(*) FROM mem GROUP BY clono""")
def a16(spark, d):
    g = M.members(spark, d).groupBy("clono").agg(F.sum("umi").cast("double").alias("s"), (F.sum(F.when(F.col("status") != "P", F.col("umi"))).cast("double") / F.count("*")).alias("m"))
    return g.unpivot("clono", ["s", "m"], "line", "umi").select("clono", F.when(F.col("line") == "s", "sum").otherwise("mean").alias("line"), "umi")


POSITIONS = M.SEGMENT + ", pos AS (SELECT length(name) AS len, i AS pos, substr(seq, i, 1) AS base FROM seg, unnest(range(1, 97)) t(i))"


def positions(spark, d):
    s = M.segments(spark, d)
    return s.select(F.length("name").cast("long").alias("len"), F.posexplode(F.split("seq", "")).alias("p", "base")).where("base <> ''").select("len", (F.col("p") + 1).cast("long").alias("pos"), "base")


@query("a17_consensus_conx", W + POSITIONS + ", c AS (SELECT len, pos, CASE WHEN count(DISTINCT base) = 1 THEN min(base) ELSE 'X' END AS b FROM pos GROUP BY ALL) SELECT len, string_agg(b, '' ORDER BY pos) AS conx FROM c GROUP BY len")
def a17(spark, d):
    c = positions(spark, d).groupBy("len", "pos").agg(F.when(F.count_distinct("base") == 1, F.min("base")).otherwise("X").alias("b"))
    return c.groupBy("len").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("conx"))


@query("a17_consensus_conp", W + POSITIONS + """, c AS (SELECT len, pos, string_agg(DISTINCT base, '' ORDER BY base) AS s FROM pos GROUP BY ALL)
  SELECT len, string_agg(CASE WHEN length(s) = 1 THEN s WHEN s = 'AG' THEN 'R' WHEN s = 'CT' THEN 'Y' ELSE 'X' END, '' ORDER BY pos) AS conp FROM c GROUP BY len""")
def a17p(spark, d):
    """Classes are tried top down; the first that holds all letters of a position names it."""
    s = F.array_join(F.sort_array(F.collect_set("base")), "")
    c = positions(spark, d).groupBy("len", "pos").agg(s.alias("s"))
    b = F.when(F.length("s") == 1, F.col("s")).when(F.col("s") == "AG", "R").when(F.col("s") == "CT", "Y").otherwise("X")
    return c.select("len", "pos", b.alias("b")).groupBy("len").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("conp"))


@query("a18_majority_codon", W + M.SEGMENT + """, c AS (SELECT length(name) AS len, i AS pos, substr(seq, 3 * i + 1, 3) AS codon, count(*) AS n FROM seg, unnest(range(0, 32)) t(i) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY len, pos ORDER BY n DESC, codon) AS k, sum(n) OVER (PARTITION BY len, pos) AS total FROM c)
  SELECT len, string_agg(CASE WHEN 2 * n > total THEN codon ELSE 'XXX' END, '' ORDER BY pos) AS consensus FROM r WHERE k = 1 GROUP BY len""")
def a18(spark, d):
    i = F.explode(F.sequence(F.lit(0), F.lit(31))).alias("pos")
    n = M.segments(spark, d).select(F.length("name").cast("long").alias("len"), "seq", i).groupBy("len", "pos", F.expr("substring(seq, 3 * pos + 1, 3)").alias("codon")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("len", "pos")
    r = n.select("*", F.row_number().over(w.orderBy(F.desc("n"), "codon")).alias("k"), F.sum("n").over(w).alias("total")).where("k = 1")
    r = r.select("len", "pos", F.when(2 * F.col("n") > F.col("total"), F.col("codon")).otherwise("XXX").alias("b"))
    return r.groupBy("len").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "b"))), lambda x: x["b"]), "").alias("consensus"))


@query("a19_variable_and_shared_positions", W + POSITIONS + """, r AS (SELECT i AS pos, substr(min(seq), i, 1) AS ref FROM seg, unnest(range(1, 97)) t(i) GROUP BY i), c AS (SELECT len, pos, count(DISTINCT base) AS k, min(base) AS base FROM pos GROUP BY ALL)
  SELECT len, coalesce(string_agg(CASE WHEN k > 1 THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos), '') AS var_indices, coalesce(string_agg(CASE WHEN k = 1 AND base <> ref THEN CAST(pos AS VARCHAR) END, ',' ORDER BY pos), '') AS share_indices FROM c JOIN r USING (pos) GROUP BY len""")
def a19(spark, d):
    s = M.segments(spark, d)
    ref = s.agg(F.min("seq").alias("m")).select(F.posexplode(F.split("m", "")).alias("p", "ref")).select((F.col("p") + 1).cast("long").alias("pos"), "ref").where("pos <= 96")
    c = positions(spark, d).groupBy("len", "pos").agg(F.count_distinct("base").alias("k"), F.min("base").alias("base")).join(F.broadcast(ref), "pos")  # 96 rows
    listed = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.col("pos")))), lambda x: x.cast("string")), ",")
    return c.groupBy("len").agg(listed(F.col("k") > 1).alias("var_indices"), listed((F.col("k") == 1) & (F.col("base") != F.col("ref"))).alias("share_indices"))


@query("a20_frequency_table", "SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value")
def a20(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


BARCODE = "bc AS (SELECT c_custkey AS cell, c_mktsegment AS dataset, substr(md5(c_name), 1, 3) AS b8, CAST(floor(abs(c_acctbal)) AS BIGINT) AS umi FROM customer)"


@query("a21_whitelist_percent", W + BARCODE + ", f AS (SELECT dataset, max(umi) OVER (PARTITION BY dataset, b8) >= 10 * umi AND max(umi) OVER (PARTITION BY dataset, b8) > umi AS junk FROM bc) SELECT dataset, count(*) AS n, count(*) FILTER (junk) AS flagged, floor(count(*) FILTER (junk) * 10000.0::DOUBLE / count(*) + 0.5) / 100 AS white FROM f GROUP BY dataset")
def a21(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("dataset"), F.substring(F.md5(F.col("c_name").cast("binary")), 1, 3).alias("b8"), F.floor(F.abs("c_acctbal")).alias("umi"))
    top = F.max("umi").over(Window.partitionBy("dataset", "b8"))
    f = c.select("dataset", ((top >= 10 * F.col("umi")) & (top > F.col("umi"))).alias("junk"))
    return f.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if("junk").alias("flagged"), percent(F.count_if("junk"), F.count("*")).alias("white"))


@query("a22_summary_totals", W + M.MEMBER + ", k AS (SELECT clono, count(*) AS n FROM mem GROUP BY clono) SELECT count(DISTINCT dataset) AS datasets, count(DISTINCT donor) AS donors, count(*) AS cells, (SELECT count(*) FROM k) AS clonotypes, (SELECT count(*) FROM k WHERE n >= 2) AS clonotypes_2 FROM mem")
def a22(spark, d):
    m = M.members(spark, d)
    per = m.groupBy("clono").agg(F.count("*").alias("n"), F.collect_set("dataset").alias("ds"), F.collect_set("donor").alias("dn"))
    size = lambda c: F.size(F.array_distinct(F.flatten(F.collect_set(c)))).cast("long")
    return per.agg(size("ds").alias("datasets"), size("dn").alias("donors"), F.sum("n").alias("cells"), F.count("*").alias("clonotypes"), F.count_if(F.col("n") >= 2).alias("clonotypes_2"))


@query("a23_chains_table", W + M.MEMBER + " SELECT CASE WHEN grouping(nchains) = 1 THEN 'total' ELSE CAST(nchains AS VARCHAR) END AS chains, count(DISTINCT clono) AS clonotypes, count(*) AS cells FROM mem GROUP BY ROLLUP(nchains)")
def a23(spark, d):
    r = M.members(spark, d).rollup("nchains").agg(F.grouping("nchains").alias("g"), F.count_distinct("clono").alias("clonotypes"), F.count("*").alias("cells"))
    return r.select(F.when(F.col("g") == 1, "total").otherwise(F.col("nchains").cast("string")).alias("chains"), "clonotypes", "cells")


@query("a24_intradonor_merges", W + M.MEMBER + ", c AS (SELECT clono, donor, count(*) AS n FROM mem GROUP BY ALL) SELECT CAST(sum(n - 1) AS BIGINT) AS merges, CAST(sum(n * (n - 1) // 2) AS BIGINT) AS pairs FROM c")
def a24(spark, d):
    c = M.members(spark, d).groupBy("clono", "donor").agg(F.count("*").alias("n"))
    return c.agg(F.sum(F.col("n") - 1).alias("merges"), F.sum(F.expr("n * (n - 1) div 2")).alias("pairs"))


@query("a25_cross_donor_stats", W + M.MEMBER + """, c AS (SELECT clono, donor, count(*) AS n FROM mem GROUP BY ALL), k AS (SELECT sum(n) AS s, sum(n * n) AS q FROM c GROUP BY clono), t AS (SELECT donor, sum(n) AS n FROM c GROUP BY donor)
  SELECT CAST((SELECT (sum(s * s - q)) // 2 FROM k) AS BIGINT) AS mixes, CAST((SELECT (sum(n) * sum(n) - sum(n * n)) // 2 FROM t) AS BIGINT) AS cross_pairs, CAST((SELECT sum(n * (n - 1)) // 2 FROM t) AS BIGINT) AS intra_pairs""")
def a25(spark, d):
    c = M.members(spark, d).groupBy("clono", "donor").agg(F.count("*").alias("n"))
    k = c.groupBy("clono").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q")).agg(F.expr("sum(s * s - q) div 2").alias("mixes"))
    t = c.groupBy("donor").agg(F.sum("n").alias("n")).agg(F.expr("(sum(n) * sum(n) - sum(n * n)) div 2").alias("cross_pairs"), F.expr("sum(n * (n - 1)) div 2").alias("intra_pairs"))
    return k.crossJoin(t)  # one row each


@query("a26_doublet_rate", W + M.SIGNATURE + " SELECT count(*) FILTER (nchains = 1) AS one, count(*) FILTER (nchains IN (2, 3)) AS two_three, CAST(count(*) FILTER (nchains = 4) AS DOUBLE) / (count(*) FILTER (nchains = 2) + count(*) FILTER (nchains = 4)) AS doublet_rate FROM sig")
def a26(spark, d):
    n = F.col("nchains")
    return M.signatures(spark, d).agg(F.count_if(n == 1).alias("one"), F.count_if(n.isin(2, 3)).alias("two_three"), (F.count_if(n == 4).cast("double") / (F.count_if(n == 2) + F.count_if(n == 4))).alias("doublet_rate"))


MIDDLE = ", r AS (SELECT heavy, umi, row_number() OVER (PARTITION BY heavy ORDER BY umi) - 1 AS k, count(*) OVER (PARTITION BY heavy) AS n FROM plain) SELECT heavy, CAST(sum(umi) AS DOUBLE) / count(*) AS mean_umi FROM r WHERE k >= n // 3 AND k < 2 * n // 3 GROUP BY heavy"


@query("a27_middle_third_mean", W + M.PLAIN + MIDDLE)
def a27(spark, d):
    """Ranks come from counts by value, so no partition holds all rows of a side: the middle third takes a share of each value."""
    by = M.chains_plain(spark, d).groupBy("heavy", "umi").agg(F.count("*").alias("c"))
    w = Window.partitionBy("heavy")
    run = by.select("*", F.sum("c").over(w).alias("n"), (F.sum("c").over(w.orderBy("umi")) - F.col("c")).alias("k"))
    take = F.greatest(F.lit(0), F.least(F.expr("2 * n div 3"), F.col("k") + F.col("c")) - F.greatest(F.expr("n div 3"), F.col("k")))
    return run.withColumn("take", take).groupBy("heavy").agg((F.sum(F.col("umi") * F.col("take")).cast("double") / F.sum("take")).alias("mean_umi"))


@query("a28_means", W + M.SIGNATURE + " SELECT CAST(sum(umi) AS DOUBLE) / count(*) AS umi_per_cell, CAST(sum(reads) AS DOUBLE) / sum(umi) AS reads_per_umi FROM sig")
def a28(spark, d):
    return M.signatures(spark, d).agg((F.sum("umi").cast("double") / F.count("*")).alias("umi_per_cell"), (F.sum("reads").cast("double") / F.sum("umi")).alias("reads_per_umi"))


@query("a29_validated_umis", W + M.UMI + """, k AS (SELECT heavy, median(len(validated)) AS med, 100.0::DOUBLE * sum(len(validated)) / sum(umi) AS pc FROM um GROUP BY heavy), t AS (SELECT cell, min(len(validated)) AS least FROM um GROUP BY cell HAVING count(*) = 2)
  SELECT h.med AS heavy_median, h.pc AS heavy_percent, l.med AS light_median, l.pc AS light_percent, (SELECT 100.0::DOUBLE * count(*) FILTER (least > 0) / count(*) FROM t) AS both_percent FROM k h, k l WHERE h.heavy AND NOT l.heavy""")
def a29(spark, d):
    return validated_statistics(M.umi_chains(spark, d))


@query("a30_marking_stats", W + M.MEMBER + """, x AS (SELECT exact AS k, CASE WHEN cell % 40 < 2 * nchains THEN dataset ELSE 'MAIN' END AS ds, nchains IN (2, 3) AS fine, tag = '1-URGENT' AS mark, status <> 'P' AS b FROM mem),
  c AS (SELECT k, ds, count(*) AS c, row_number() OVER (PARTITION BY k ORDER BY count(*) DESC, ds) AS r FROM x GROUP BY k, ds),
  g AS (SELECT k, sum(c) AS n, count(*) AS nds, max(CASE WHEN r = 1 THEN ds END) AS top, count(*) = 1 OR max(CASE WHEN r = 1 THEN c END) >= 10 * max(CASE WHEN r = 2 THEN c END) AS alone FROM c GROUP BY k),
  y AS (SELECT x.*, n, nds, alone, alone AND n >= 10 AS fake, alone AND ds = top AS own FROM x JOIN g USING (k)), f AS (SELECT k, n, count(*) FILTER (mark) AS m FROM y WHERE fake GROUP BY k, n),
  z AS (SELECT count(*) FILTER (n >= 2 AND (own OR NOT b)) AS dubious, count(*) FILTER (mark) AS marked, count(*) FILTER (mark AND fine AND b AND nds >= 2) AS marked_good, count(*) FILTER (NOT fake AND n >= 10 AND b AND fine) AS good0, count(*) FILTER (NOT fake AND n >= 10 AND b AND fine AND mark) AS good_marked FROM y),
  w AS (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS fake, CAST(coalesce(sum(CASE WHEN m = n THEN m - 1 ELSE m END), 0) AS BIGINT) AS fake_marked, count(*) AS fakes FROM f)
  SELECT dubious, marked, marked_good, fake, fake_marked, fake - fake_marked AS residual, good0 + fakes AS good, good_marked FROM z, w""")
def a30(spark, d):
    """Counts of dubious, marked, fake and good cells; datasets are dealt so that cells of few chains are mostly in one."""
    m = M.members(spark, d)
    ds = F.when(F.col("cell") % 40 < 2 * F.col("nchains"), F.col("dataset")).otherwise("MAIN")
    return marking_statistics(m.select(F.col("exact").alias("clonotype"), ds.alias("dataset"), "nchains", (F.col("tag") == "1-URGENT").alias("marked"), (F.col("status") != "P").alias("b")))


@query("a31_origin_donor_table", W + M.CELL + " SELECT donor, origin, count(*) AS n FROM cell GROUP BY ALL HAVING count(*) > 1")
def a31(spark, d):
    return M.cells(spark, d).groupBy("donor", "origin").agg(F.count("*").alias("n")).where("n > 1")


@query("a32_cluster_table", W + M.MEMBER + """, c AS (SELECT status, clono, count(*) AS n, count(*) FILTER (tag LIKE '1%') AS b FROM mem GROUP BY ALL)
  SELECT status, CAST(sum(n) AS BIGINT) AS cells, floor(CAST(sum(b) AS DOUBLE) * 10000 / sum(n) + 0.5) / 100 AS pct_type, floor(CAST(max(n) AS DOUBLE) * 10000 / sum(n) + 0.5) / 100 AS pct_largest FROM c GROUP BY status""")
def a32(spark, d):
    c = M.members(spark, d).groupBy("status", "clono").agg(F.count("*").alias("n"), F.count_if(F.col("tag").startswith("1")).alias("b"))
    return c.groupBy("status").agg(F.sum("n").alias("cells"), percent(F.sum("b"), F.sum("n")).alias("pct_type"), percent(F.max("n"), F.sum("n")).alias("pct_largest"))


@query("a33_summary_csv", W + M.MEMBER + " SELECT count(*) AS cells, count(DISTINCT clono) AS clonotypes, count(DISTINCT exact) AS exacts FROM mem")
def a33(spark, d):
    """Counted over pre-aggregated keys: an exact signature has one clonotype."""
    e = M.members(spark, d).groupBy("clono", "exact").agg(F.count("*").alias("n")).groupBy("clono").agg(F.sum("n").alias("n"), F.count("*").alias("e"))
    return e.agg(F.sum("n").alias("cells"), F.count("*").alias("clonotypes"), F.sum("e").alias("exacts"))


@query("a34_fate_table", W + M.SIGNATURE + ", f AS (SELECT CASE WHEN nchains > 8 THEN 'MAX_CONTIGS' WHEN umi < 20 THEN 'UMI' WHEN clono LIKE '%:R' THEN 'IMPROPER' END AS filter FROM sig) SELECT CASE WHEN grouping(filter) = 1 THEN 'total' ELSE filter END AS filter, count(*) AS n FROM f WHERE filter IS NOT NULL GROUP BY ROLLUP(filter)")
def a34(spark, d):
    f = F.when(F.col("nchains") > 8, "MAX_CONTIGS").when(F.col("umi") < 20, "UMI").when(F.col("clono").endswith(":R"), "IMPROPER")
    r = M.signatures(spark, d).select(f.alias("filter")).where("filter is not null").rollup("filter").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("filter", F.lit("total")).alias("filter"), "n")


@query("a35_dataset_feature_percent", W + M.FEATURE + ", e AS (SELECT f.feature, f.count, f.cell % 2 = 0 AS inside FROM feat f) SELECT feature, floor(CAST(sum(CASE WHEN inside THEN count ELSE 0 END) AS DOUBLE) * 10000 / nullif(sum(count), 0) + 0.5) / 100 AS cellular_u FROM e GROUP BY feature")
def a35(spark, d):
    return M.features(spark, d).groupBy("feature").agg(percent(F.sum(F.when(F.col("cell") % 2 == 0, F.col("count")).otherwise(0)), F.nullif(F.sum("count"), F.lit(0))).alias("cellular_u"))


@query("a36_inconsistent_percent", W + M.CHAIN + """, e AS (SELECT v_name, j_name, count(*) AS n FROM chain WHERE heavy GROUP BY ALL), k AS (SELECT sum(n) AS s, sum(n * n) AS q, sum(n * (n - 1)) AS same FROM e GROUP BY v_name)
  SELECT CAST(sum(s * (s - 1)) // 2 AS BIGINT) AS d_inconsistent_n, floor(CAST(sum(s * (s - 1) - same) AS DOUBLE) * 10000 / sum(s * (s - 1)) + 0.5) / 100 AS d_inconsistent_pct FROM k""")
def a36(spark, d):
    """Over all pairs within a block, by counts alone: no pair is made."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("v_name"), F.col("p_type").alias("j_name"))
    e = M.chains_plain(spark, d).where("heavy").join(part, "part").groupBy("v_name", "j_name").agg(F.count("*").alias("n"))
    k = e.groupBy("v_name").agg(F.sum("n").alias("s"), F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))
    pairs = F.sum(F.col("s") * (F.col("s") - 1))
    return k.agg(F.floor(pairs / 2).alias("d_inconsistent_n"), percent(pairs - F.sum("same"), pairs).alias("d_inconsistent_pct"))


@query("a37_sensitivity_specificity", W + M.MEMBER + """, c AS (SELECT clono, exact, donor, count(*) AS n FROM mem GROUP BY ALL), b AS (SELECT exact, sum(n) AS s FROM c GROUP BY exact), k AS (SELECT clono, sum(n) AS s FROM c GROUP BY clono), x AS (SELECT clono, donor, sum(n) AS n FROM c GROUP BY ALL)
  SELECT CAST((SELECT sum(s * (s - 1)) // 2 FROM k) AS BIGINT) AS merged_pairs, CAST((SELECT sum(s * (s - 1)) // 2 FROM b) AS BIGINT) AS identical_pairs, CAST((SELECT sum(s * (s - 1)) // 2 FROM k) - (SELECT sum(n * (n - 1)) // 2 FROM x) AS BIGINT) AS cross_donor_pairs""")
def a37(spark, d):
    c = M.members(spark, d).groupBy("clono", "exact", "donor").agg(F.count("*").alias("n"))
    pairs = lambda *by: c.groupBy(*by).agg(F.sum("n").alias("s")).agg(F.floor(F.sum(F.col("s") * (F.col("s") - 1)) / 2).alias("p"))
    merged, same, donor = (pairs(*by).withColumnRenamed("p", n) for by, n in ((["clono"], "merged_pairs"), (["exact"], "identical_pairs"), (["clono", "donor"], "x")))
    return merged.crossJoin(same).crossJoin(donor).select("merged_pairs", "identical_pairs", (F.col("merged_pairs") - F.col("x")).alias("cross_donor_pairs"))  # one row each


@query("a38_multi_donor", W + M.MEMBER + " SELECT clono, count(DISTINCT donor) AS donors, count(DISTINCT dataset) AS datasets FROM mem GROUP BY clono HAVING count(DISTINCT donor) > 1")
def a38(spark, d):
    return M.members(spark, d).groupBy("clono").agg(F.count_distinct("donor").alias("donors"), F.count_distinct("dataset").alias("datasets")).where("donors > 1")


@query("a39_public_cells", W + M.MEMBER + ", g AS (SELECT exact, count(DISTINCT donor) AS k FROM mem GROUP BY exact) SELECT k > 1 AS public, m.nchains <= 2 AS naive, count(*) AS cells FROM mem m JOIN g USING (exact) GROUP BY ALL")
def a39(spark, d):
    g = M.members(spark, d).groupBy("exact", "donor", "nchains").agg(F.count("*").alias("n"))
    k = F.size(F.collect_set("donor").over(Window.partitionBy("exact")))
    return g.select((k > 1).alias("public"), (F.col("nchains") <= 2).alias("naive"), "n").groupBy("public", "naive").agg(F.sum("n").alias("cells"))


@query("a40_length_histogram", "SELECT CAST(length(text) // 500 * 500 AS BIGINT) AS bin, count(*) AS n, floor(count(*) * 10000.0::DOUBLE / (SELECT count(*) FROM documents) + 0.5) / 100 AS pct FROM documents GROUP BY 1")
def a40(spark, d):
    h = table(spark, d, "documents").groupBy(F.expr("length(text) div 500 * 500").alias("bin")).agg(F.count("*").alias("n"))
    return h.crossJoin(h.agg(F.sum("n").alias("t"))).select("bin", "n", percent(F.col("n"), F.col("t")).alias("pct"))  # one row


@query("a41_class_donor_cube", W + M.MEMBER + " SELECT coalesce(status, 'all') AS class, coalesce(donor, 'all') AS donor, count(*) AS cells, CAST(count(*) FILTER (nchains <= 2) AS DOUBLE) / count(*) AS naive FROM mem GROUP BY CUBE(status, donor)")
def a41(spark, d):
    c = M.members(spark, d).cube("status", "donor").agg(F.count("*").alias("cells"), (F.count_if(F.col("nchains") <= 2).cast("double") / F.count("*")).alias("naive"))
    return c.select(F.coalesce("status", F.lit("all")).alias("class"), F.coalesce("donor", F.lit("all")).alias("donor"), "cells", "naive")


@query("a42_conditional_fractions", W + M.MEMBER + " SELECT nchains <= 2 AS naive, donor, CAST(count(*) FILTER (exact LIKE '%NO%') AS DOUBLE) / count(*) AS dd FROM mem GROUP BY ALL")
def a42(spark, d):
    return M.members(spark, d).groupBy((F.col("nchains") <= 2).alias("naive"), "donor").agg((F.count_if(F.col("exact").contains("NO")).cast("double") / F.count("*")).alias("dd"))


@query("a46_moments", "SELECT l_returnflag AS class, CAST(round(corr(l_quantity, l_discount) * 1e6) AS BIGINT) AS r_ppm, CAST(round(covar_pop(l_quantity, l_tax) * 1e6) AS BIGINT) AS cov_ppm, CAST(round(stddev_pop(l_quantity) * 1e6) AS BIGINT) AS sd_ppm FROM lineitem GROUP BY 1")
def a46(spark, d):
    ppm = lambda c: F.round(c * 1e6).cast("long")
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("class")).agg(ppm(F.corr("l_quantity", "l_discount")).alias("r_ppm"), ppm(F.covar_pop("l_quantity", "l_tax")).alias("cov_ppm"), ppm(F.stddev_pop("l_quantity")).alias("sd_ppm"))


@query("a47_insertion_analysis", W + M.PLAIN + " SELECT umi // 10 AS jun_ins, count(*) AS n, CAST(sum(reads) AS DOUBLE) / count(*) AS mean_reads FROM plain WHERE heavy GROUP BY 1 HAVING count(*) >= 10")
def a47(spark, d):
    return M.chains_plain(spark, d).where("heavy").groupBy(F.expr("umi div 10").alias("jun_ins")).agg(F.count("*").alias("n"), (F.sum("reads").cast("double") / F.count("*")).alias("mean_reads")).where("n >= 10")


@query("a48_likelihood_histogram", W + M.PLAIN + " SELECT kind AS class, CAST(floor(log10(greatest(reads, 1))) AS BIGINT) AS bucket, count(*) AS n FROM plain GROUP BY ALL")
def a48(spark, d):
    return M.chains_plain(spark, d).groupBy(F.col("kind").alias("class"), F.floor(F.log10(F.greatest("reads", F.lit(1)).cast("double"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("a49_assess_clusters", W + M.MEMBER + ", k AS (SELECT clono, count(*) AS n, count(DISTINCT donor) AS dn FROM mem GROUP BY clono) SELECT clono, n, dn > 1 AS mixed FROM k ORDER BY n DESC, clono LIMIT 10")
def a49(spark, d):
    k = M.members(spark, d).groupBy("clono").agg(F.count("*").alias("n"), F.count_distinct("donor").alias("dn"))
    return k.orderBy(F.desc("n"), "clono").limit(10).select("clono", "n", (F.col("dn") > 1).alias("mixed"))  # a top-10 report


@query("a50_categories_and_other", W + M.CELL + ", c AS (SELECT dataset || ',' || status AS v, count(*) AS n FROM cell GROUP BY 1), r AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS k FROM c) SELECT CASE WHEN k < 5 THEN v ELSE 'other' END AS category, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1")
def a50(spark, d):
    c = M.cells(spark, d).groupBy(F.concat_ws(",", "dataset", "status").alias("v")).agg(F.count("*").alias("n"))
    top = c.orderBy(F.desc("n"), "v").limit(4).select("v", F.lit(True).alias("top"))  # maxcat - 1 categories
    return c.join(F.broadcast(top), "v", "left").groupBy(F.when(F.col("top"), F.col("v")).otherwise("other").alias("category")).agg(F.sum("n").alias("n"))


@query("a51_similarity_matrix", W + M.FEATURE + """, p AS (SELECT a.feature AS f1, b.feature AS f2, sum(a.count * b.count) AS dot FROM feat a JOIN feat b USING (cell) GROUP BY ALL), n AS (SELECT feature, sum(count * count) AS q FROM feat GROUP BY feature)
  SELECT f1, f2, CASE WHEN x.q = 0 OR y.q = 0 THEN 0 ELSE CAST(round(CAST(dot AS DOUBLE) / (sqrt(CAST(x.q AS DOUBLE)) * sqrt(CAST(y.q AS DOUBLE))) * 1e6) AS BIGINT) END AS cosine_ppm FROM p JOIN n x ON f1 = x.feature JOIN n y ON f2 = y.feature""")
def a51(spark, d):
    f = M.features(spark, d)
    a, b = f.select("cell", F.col("feature").alias("f1"), F.col("count").alias("c1")), f.select("cell", F.col("feature").alias("f2"), F.col("count").alias("c2"))
    dot = a.join(b, "cell").groupBy("f1", "f2").agg(F.sum(F.col("c1") * F.col("c2")).alias("dot"))
    q = f.groupBy("feature").agg(F.sum(F.col("count") * F.col("count")).alias("q"))
    m = dot.join(q.select(F.col("feature").alias("f1"), F.col("q").alias("x")), "f1").join(q.select(F.col("feature").alias("f2"), F.col("q").alias("y")), "f2")
    cosine = F.round(F.col("dot").cast("double") / (F.sqrt(F.col("x").cast("double")) * F.sqrt(F.col("y").cast("double"))) * 1e6).cast("long")
    return m.select("f1", "f2", F.when((F.col("x") == 0) | (F.col("y") == 0), F.lit(0).cast("long")).otherwise(cosine).alias("cosine_ppm"))


@query("o01_order_groups", W + M.MEMBER + " SELECT clono, count(*) AS n FROM mem GROUP BY clono ORDER BY n DESC, clono")
def o01(spark, d):
    return M.members(spark, d).groupBy("clono").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "clono")


@query("o02_order_clusters", W + M.MEMBER + " SELECT exact, count(*) AS n FROM mem GROUP BY exact HAVING count(*) > 1 ORDER BY n DESC, exact")
def o02(spark, d):
    return M.members(spark, d).groupBy("exact").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "exact")


@query("o03_top_sizes", W + M.SIGNATURE + " SELECT exact, count(*) AS n FROM sig GROUP BY exact ORDER BY n DESC, exact LIMIT 10")
def o03(spark, d):
    return M.signatures(spark, d).groupBy("exact").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exact").limit(10)


@query("o04_union_by_name", "SELECT c_name AS name, c_nationkey AS nation, 'customer' AS origin FROM customer UNION ALL SELECT s_name, s_nationkey, 'supplier' FROM supplier")
def o04(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit("customer").alias("origin"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return c.unionByName(s)


@query("o05_unique_sort", "SELECT DISTINCT p_brand, p_type FROM part")
def o05(spark, d):
    return table(spark, d, "part").select("p_brand", "p_type").distinct()


@query("o06_set_difference", "SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def o06(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).exceptAll(table(spark, d, "supplier").select("s_nationkey"))


@query("o07_seeded_sample", "SELECT o_orderkey AS cell, md5('seed7' || o_orderkey) AS h FROM orders ORDER BY h, cell LIMIT 100")
def o07(spark, d):
    """A sampling operator: the rows of the least keyed hashes, the same ones on every run and layout."""
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), F.md5(F.concat(F.lit("seed7"), F.col("o_orderkey").cast("string")).cast("binary")).alias("h")).orderBy("h", "cell").limit(100)


@query("o08_subsample_cells", "SELECT o_orderkey AS cell FROM orders WHERE substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 1) < '4'")
def o08(spark, d):
    """A sampling operator: a quarter of the cells, by hash."""
    return table(spark, d, "orders").where(F.substring(F.md5(F.col("o_orderkey").cast("string").cast("binary")), 1, 1) < "4").select(F.col("o_orderkey").alias("cell"))


@query("o09_intersection", W + M.PLAIN + ", s AS (SELECT cell, list_sort(list(DISTINCT kind || c_name)) AS k FROM plain GROUP BY cell) SELECT cell, array_to_string(list_filter(k, lambda x: x IN ('AF', 'NO', 'RF')), ',') AS meet FROM s")
def o09(spark, d):
    k = F.sort_array(F.collect_set(F.concat("kind", "c_name")))
    return M.chains_plain(spark, d).groupBy("cell").agg(k.alias("k")).select("cell", F.array_join(F.array_intersect("k", F.array(F.lit("AF"), F.lit("NO"), F.lit("RF"))), ",").alias("meet"))
