"""Noise filters K01-K18 and donor reference R01."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lymphframe.functions.stats import binomial_tail
from lymphframe.operators import filters as K
from lymphframe.plans.registry import query
from lymphframe.session import table
from lymphframe.sources import mapped as M

W = "WITH "

#: P(Binomial(g.n, 0.1) >= g.k)
TAIL = "list_sum(list_transform(range(CAST(g.k AS BIGINT), g.n + 1), lambda i: exp(lgamma(g.n + 1) - lgamma(i + 1) - lgamma(g.n - i + 1) + i * ln(0.1) + (g.n - i) * ln(0.9))))"


@query("k01_cell_filter", "SELECT o_orderkey AS cell FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice >= 1000")
def k01(spark, d):
    return table(spark, d, "orders").where("o_orderstatus <> 'P' AND o_totalprice >= 1000").select(F.col("o_orderkey").alias("cell"))


@query("k02_max_contigs", W + M.SIGNATURE + " SELECT cell, nchains FROM sig WHERE nchains <= 4")
def k02(spark, d):
    return M.signatures(spark, d).where("nchains <= 4").select("cell", "nchains")


@query("k04_cross", W + M.CELL + ", " + M.PLAIN + """, c AS (SELECT p.*, cell.dataset FROM plain p JOIN cell USING (cell)), z AS (SELECT dataset, count(*) AS cells FROM cell GROUP BY dataset), b AS (SELECT part, count(*) AS n, min(dataset) AS lo FROM c GROUP BY part HAVING min(dataset) = max(dataset)),
  o AS (SELECT part FROM b JOIN z ON lo = z.dataset WHERE pow(CAST(z.cells AS DOUBLE) / (SELECT sum(cells) FROM z), n) <= 1e-1) SELECT cell FROM c WHERE part IN (SELECT part FROM o) AND umi < 30""")
def k04(spark, d):
    """With a limit of 0.1, as the mapped tables have few sequences in one dataset alone."""
    cells = M.cells(spark, d)
    chains = M.chains_plain(spark, d).join(cells.select("cell", "dataset"), "cell")
    return K.cross(chains, cells.groupBy("dataset").agg(F.count("*").alias("cells")), limit=0.1, least_umis=30)


@query("k05_barcode_duplication", W + M.SIGNATURE + ", d AS (SELECT exact, o_custkey AS barcode, count(*) AS n FROM sig JOIN orders ON cell = o_orderkey GROUP BY ALL) SELECT exact, barcode FROM d WHERE n = 1")
def k05(spark, d):
    """Barcodes, customers here, that stand once in an exact subclonotype."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("cell"), F.col("o_custkey").alias("barcode"))
    return M.signatures(spark, d).select("cell", "exact").join(o, "cell").groupBy("exact", "barcode").agg(F.count("*").alias("n")).where("n = 1").select("exact", "barcode")


PAIRED = M.SIGNATURE + ", pr AS (SELECT DISTINCT h.cell, h.c_name || l.kind || l.c_name AS pair, s.nchains FROM plain h JOIN plain l ON h.cell = l.cell AND h.heavy AND NOT l.heavy JOIN sig s ON s.cell = h.cell)"


@query("k07_foursies", W + PAIRED + " SELECT DISTINCT cell FROM pr WHERE nchains = 4 AND pair IN (SELECT pair FROM pr WHERE nchains = 2 GROUP BY pair HAVING count(*) >= 10)")
def k07(spark, d):
    p = M.chains_plain(spark, d)
    sets = p.groupBy("cell").agg(F.collect_set(F.when(F.col("heavy"), F.col("c_name"))).alias("h"), F.collect_set(F.when(~F.col("heavy"), F.concat("kind", "c_name"))).alias("l"), F.count("*").alias("nchains"))
    pairs = sets.select("cell", "nchains", F.explode("h").alias("x"), "l").select("cell", "nchains", "x", F.explode("l").alias("y")).select("cell", F.concat("x", "y").alias("pair"), "nchains")
    return K.foursies(sets, pairs)


@query("k08_improper", W + M.SIGNATURE + " SELECT cell FROM sig WHERE NOT (nchains > 1 AND length(clono) - position(':' IN clono) = 1)")
def k08(spark, d):
    return M.signatures(spark, d).where(~((F.col("nchains") > 1) & (F.length(F.split_part("clono", F.lit(":"), F.lit(2))) == 1))).select("cell")


@query("k09_weak_onesies", W + M.SIGNATURE + ", g AS (SELECT exact, count(*) AS n FROM sig WHERE nchains = 1 GROUP BY exact) SELECT s.cell, CASE WHEN g.n < 0.01 * (SELECT count(*) FROM sig) THEN exact || '#' || cell ELSE exact END AS clonotype FROM sig s JOIN g USING (exact) WHERE s.nchains = 1")
def k09(spark, d):
    s = M.signatures(spark, d)
    g = s.where("nchains = 1").groupBy("exact").agg(F.count("*").alias("n")).crossJoin(s.agg(F.count("*").alias("t")))  # one-row side
    key = F.when(F.col("n") < 0.01 * F.col("t"), F.concat("exact", F.lit("#"), F.col("cell").cast("string"))).otherwise(F.col("exact"))
    return s.where("nchains = 1").join(g, "exact").select("cell", key.alias("clonotype"))


@query("k10_umi_filter", W + M.MEMBER + ", p AS (SELECT dataset, count(*) AS n, quantile_cont(umi, 0.1) AS p10, median(umi) AS p50 FROM mem WHERE nchains = 2 GROUP BY dataset), b AS (SELECT dataset, least(p10, p50 - 4 * sqrt(p50)) AS umin FROM p WHERE n >= 20), m AS (SELECT mem.cell, mem.exact, mem.umi, coalesce(mem.umi < b.umin, FALSE) AS low FROM mem LEFT JOIN b USING (dataset)), g AS (SELECT exact, count(*) AS n, count(*) FILTER (low) AS k FROM m GROUP BY exact), x AS (SELECT m.cell, g.n, g.k, row_number() OVER (PARTITION BY m.exact ORDER BY m.umi DESC, m.cell) AS place FROM m JOIN g USING (exact) WHERE m.low AND g.n >= 2 AND g.k > 0 AND " + TAIL + " < 0.01) SELECT cell FROM x WHERE k < n OR place > 1")
def k10(spark, d):
    m = M.members(spark, d)
    return K.low_umis(m, K.baseline(m.where("nchains = 2"), "dataset", "umi"), "exact", "dataset", "umi")


@query("k10_umi_baseline", W + M.MEMBER + ", p AS (SELECT dataset, count(*) AS n, quantile_cont(umi, 0.1) AS p10, median(umi) AS p50 FROM mem WHERE nchains = 2 GROUP BY dataset) SELECT dataset, floor(least(p10, p50 - 4 * sqrt(p50)) * 1000) AS umin_milli FROM p WHERE n >= 20")
def k10b(spark, d):
    return K.baseline(M.members(spark, d).where("nchains = 2"), "dataset", "umi").select("dataset", F.floor(F.col("umin") * 1000).cast("double").alias("umin_milli"))


@query("k11_umi_ratio", W + M.SIGNATURE + ", x AS (SELECT cell, max(umi) AS top FROM plain GROUP BY cell), g AS (SELECT s.exact, max(x.top) AS top FROM sig s JOIN x USING (cell) GROUP BY s.exact) SELECT s.cell FROM sig s JOIN g USING (exact) WHERE g.top >= 3 * s.umi")
def k11(spark, d):
    """Cells that another cell of their signature outdoes, here threefold (500-fold by default in real data)."""
    s = M.signatures(spark, d, F.max("umi").alias("t"))
    g = s.groupBy("exact").agg(F.max("t").alias("top"))
    return s.join(g, "exact").where("top >= 3 * umi").select("cell")


@query("k11_umi_ratio_by_chance", W + M.SIGNATURE + ", x AS (SELECT cell, max(umi) AS top FROM plain GROUP BY cell), t AS (SELECT s.exact, max(x.top) AS top FROM sig s JOIN x USING (cell) GROUP BY s.exact), m AS (SELECT s.cell, s.exact, t.top >= 2 * s.umi AS low FROM sig s JOIN t USING (exact)), g AS (SELECT exact, count(*) AS n, count(*) FILTER (low) AS k FROM m GROUP BY exact) SELECT m.cell FROM m JOIN g USING (exact) WHERE m.low AND g.n >= 2 AND g.k > 0 AND " + TAIL + " < 0.01")
def k11b(spark, d):
    """Cells that another cell of their signature outdoes, here twofold, where so many of them aren't chance."""
    s = M.signatures(spark, d, F.max("umi").alias("t"))
    g = s.groupBy("exact").agg(F.max("t").alias("top"))
    m = s.join(g, "exact").select("cell", "exact", (F.col("top") >= 2 * F.col("umi")).alias("low"))
    n = m.groupBy("exact").agg(F.count("*").alias("n"), F.count_if("low").alias("k")).where("n >= 2 AND k > 0")
    return m.where("low").join(n.where(binomial_tail(F.col("k"), F.col("n"), 0.1) < 0.01), "exact", "left_semi").select("cell")


@query("k12_gex_filter", W + M.SIGNATURE + " SELECT cell FROM sig WHERE cell IN (SELECT user_id FROM events)")
def k12(spark, d):
    return M.signatures(spark, d).select("cell").join(table(spark, d, "events").select(F.col("user_id").alias("cell")).distinct(), "cell", "left_semi")


PURE = M.CHAIN + ", n4 AS (SELECT cell, list_sort(list_distinct(list(v_name))) AS keys FROM chain GROUP BY cell HAVING count(*) <= 4), pure AS (SELECT keys, count(*) AS n FROM n4 GROUP BY keys)"


def pure_subclonotypes(spark, d):
    """(id, n, keys): cells of at most four chains by the set of their V segments."""
    v = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("v_name"))
    c = M.chains_plain(spark, d).select("cell", "part").join(v, "part").groupBy("cell").agg(F.array_sort(F.collect_set("v_name")).alias("keys"), F.count("*").alias("chains"))
    return c.where("chains <= 4").groupBy("keys").agg(F.count("*").alias("n")).select(F.array_join("keys", " ").alias("id"), "n", "keys")


@query("k13_doublets", W + PURE + """, e AS (SELECT a.keys AS p0, b.keys AS p FROM pure a JOIN pure b ON list_has_any(a.keys, b.keys) AND a.keys <> b.keys AND 5 * a.n <= b.n)
  SELECT DISTINCT array_to_string(x.p0, ' ') AS id FROM e x JOIN e y ON x.p0 = y.p0 AND x.p < y.p AND NOT list_has_any(x.p, y.p)""")
def k13(spark, d):
    """Sets of V segments that two others without a common segment make up, each five times as frequent."""
    return K.doublets(pure_subclonotypes(spark, d))


@query("k14_signature_filter", W + M.SIGNATURE + """, g AS (SELECT exact, string_split(exact, ' ') AS s, count(*) AS n FROM sig WHERE nchains = 2 GROUP BY exact), c AS (SELECT exact, n, unnest(list_distinct(s)) AS chain FROM g), t AS (SELECT a.exact, any_value(a.n) AS n, sum(b.n) AS total FROM c a JOIN c b ON a.chain = b.chain AND a.exact <> b.exact GROUP BY a.exact) SELECT exact FROM t WHERE total >= 20 * n""")
def k14(spark, d):
    """Sums by chain less the own share: no pair of signatures is made but those with two common chains."""
    g = M.signatures(spark, d).where("nchains = 2").groupBy("exact").agg(F.count("*").alias("n"))
    c = g.select("exact", "n", F.explode(F.array_distinct(F.split("exact", " "))).alias("chain"))
    total = F.sum("n").over(Window.partitionBy("chain")) - F.col("n")
    t = c.withColumn("other", total).groupBy("exact").agg(F.min("n").alias("n"), F.sum("other").alias("total"))
    return t.where("total >= 20 * n").select("exact")


@query("k15_onesie_merger", W + M.SIGNATURE + ", g AS (SELECT exact, count(*) AS n FROM sig WHERE nchains = 1 GROUP BY exact) SELECT exact, n >= 0.0001 * (SELECT count(*) FROM sig) AS may_merge FROM g")
def k15(spark, d):
    s = M.signatures(spark, d)
    g = s.where("nchains = 1").groupBy("exact").agg(F.count("*").alias("n"))
    return g.crossJoin(s.agg(F.count("*").alias("t"))).select("exact", (F.col("n") >= 0.0001 * F.col("t")).alias("may_merge"))  # one-row side


@query("k16_weak_chains", W + M.SIGNATURE + ", c AS (SELECT s.clono, p.kind || p.c_name AS chain, count(DISTINCT s.cell) AS support FROM sig s JOIN plain p USING (cell) WHERE s.nchains >= 3 GROUP BY ALL), t AS (SELECT clono, count(*) AS total FROM sig GROUP BY clono) SELECT clono, chain FROM c JOIN t USING (clono) WHERE support <= 20 AND 8 * support < total")
def k16(spark, d):
    s = M.signatures(spark, d)
    c = s.where("nchains >= 3").select("clono", F.explode(F.array_distinct(F.split("exact", " "))).alias("chain")).groupBy("clono", "chain").agg(F.count("*").alias("support"))
    t = s.groupBy("clono").agg(F.count("*").alias("total"))
    return c.join(t, "clono").where("support <= 20 AND 8 * support < total").select("clono", "chain")


@query("k17_quality", W + M.PLAIN + " SELECT cell FROM plain GROUP BY cell HAVING max(umi) >= 40 OR count(*) FILTER (umi >= 30) >= 2")
def k17(spark, d):
    """One position at high quality, or two at a lower one."""
    return M.chains_plain(spark, d).groupBy("cell").agg(F.max("umi").alias("q"), F.count_if(F.col("umi") >= 30).alias("n")).where("q >= 40 OR n >= 2").select("cell")


@query("k18_composite_switches", W + M.SIGNATURE + ", f AS (SELECT cell, nchains <= 4 AS k02, umi >= 20 AS k10 FROM sig) SELECT count(*) AS all_off, count(*) FILTER (k02) AS without_umi, count(*) FILTER (k02 AND k10) AS all_on FROM f")
def k18(spark, d):
    s = M.signatures(spark, d)
    return s.agg(F.count("*").alias("all_off"), F.count_if(F.col("nchains") <= 4).alias("without_umi"), F.count_if((F.col("nchains") <= 4) & (F.col("umi") >= 20)).alias("all_on"))


@query("k_fate_chain", W + M.SIGNATURE + " SELECT cell, 'MAX_CONTIGS' AS filter FROM sig WHERE nchains > 8 UNION ALL SELECT cell, 'UMI' FROM sig WHERE nchains <= 8 AND umi < 20")
def fate(spark, d):
    s = M.signatures(spark, d)
    kept, f = K.drop(s, None, s.where("nchains > 8"), "MAX_CONTIGS")
    return K.drop(kept, f, kept.where("umi < 20"), "UMI")[1]


@query("r01_donor_alleles", W + M.CELL + ", " + M.CHAIN + """, c AS (SELECT DISTINCT cell.donor, chain.v_name, chain.name FROM chain JOIN cell USING (cell)), y AS (SELECT donor, v_name, i AS pos, substr(name, i, 1) AS base FROM c, unnest(range(1, 40)) t(i) WHERE i <= length(name)), z AS (SELECT donor, v_name, pos, base, count(*) AS n FROM y GROUP BY ALL), x AS (SELECT *, sum(n) OVER (PARTITION BY donor, v_name, pos) AS total FROM z),
  m AS (SELECT v_name, min(name) AS m FROM chain GROUP BY v_name), r AS (SELECT v_name, i AS pos, substr(m, i, 1) AS ref FROM m, unnest(range(1, 40)) t(i) WHERE i <= length(m)) SELECT donor, v_name, pos, base, n FROM x JOIN r USING (v_name, pos) WHERE base <> ref AND n >= 4 AND 4 * n >= total""")
def r01(spark, d):
    """Bases other than the reference's that at least 4 and a quarter of a donor's distinct sequences show."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("v_name"), F.col("p_name").alias("name"))
    chains = M.chains_plain(spark, d).select("cell", "part").join(part, "part")
    c = chains.join(M.cells(spark, d).select("cell", "donor"), "cell").select("donor", "v_name", "name").distinct()
    letters = lambda c: F.posexplode(F.split(c, "")).alias("p", "base")
    x = c.select("donor", "v_name", letters("name")).where("base <> ''").groupBy("donor", "v_name", "p", "base").agg(F.count("*").alias("n"))
    x = x.withColumn("total", F.sum("n").over(Window.partitionBy("donor", "v_name", "p")))
    r = chains.groupBy("v_name").agg(F.min("name").alias("m")).select("v_name", letters("m")).withColumnRenamed("base", "ref").where("ref <> ''")
    return x.join(r, ["v_name", "p"]).where("base <> ref AND n >= 4 AND 4 * n >= total").select("donor", "v_name", (F.col("p") + 1).cast("long").alias("pos"), "base", "n")
