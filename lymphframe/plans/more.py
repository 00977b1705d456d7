"""Rows of the inventory that the other modules leave: P19, P20, J05, K06, R03, R04, T05, V03, V04, V07, V08, F36, X09, streaming."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lymphframe.functions import conditions as C
from lymphframe.functions import features as Q
from lymphframe.functions import regions as R
from lymphframe.functions import sequence as S
from lymphframe.functions.regions import region_starts
from lymphframe.functions.stats import percent
from lymphframe.operators import clonotype as J
from lymphframe.operators import grouping as G
from lymphframe.operators import plots as P
from lymphframe.operators import trees as T
from lymphframe.operators.components import connected_components
from lymphframe.plans.functions import AA, AMINO, amino
from lymphframe.plans.registry import query
from lymphframe.plans.structures import tree_members
from lymphframe.session import stage, table
from lymphframe.sources import mapped as M
from lymphframe.streaming.counts import windowed_counts

W = "WITH "
JUNK = "bc AS (SELECT c_custkey AS cell, c_mktsegment AS dataset, substr(md5(c_name), 1, 3) AS lo, substr(md5(c_name), 30, 3) AS hi, CAST(floor(abs(c_acctbal)) AS BIGINT) AS umi FROM customer), f AS (SELECT cell, dataset, greatest(max(umi) OVER (PARTITION BY dataset, lo), max(umi) OVER (PARTITION BY dataset, hi)) >= 10 * umi AND greatest(max(umi) OVER (PARTITION BY dataset, lo), max(umi) OVER (PARTITION BY dataset, hi)) > umi AS junk FROM bc)"


def junk(spark, d):
    """Cells that share either half of their barcode with a cell of the dataset with ten times the UMIs."""
    h = F.md5(F.col("c_name").cast("binary"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("cell"), F.col("c_mktsegment").alias("dataset"), F.substring(h, 1, 3).alias("lo"), F.substring(h, 30, 3).alias("hi"), F.floor(F.abs("c_acctbal")).alias("umi"))
    top = F.greatest(*(F.max("umi").over(Window.partitionBy("dataset", k)) for k in ("lo", "hi")))
    return c.select("cell", "dataset", ((top >= 10 * F.col("umi")) & (top > F.col("umi"))).alias("junk"))


@query("k06_whitelist_filter", W + JUNK + " SELECT cell FROM f WHERE NOT junk")
def k06(spark, d):
    return junk(spark, d).where("NOT junk").select("cell")


@query("p19_junk_rate", W + JUNK + " SELECT dataset, floor(CAST(count(*) FILTER (junk) AS DOUBLE) * 10000 / count(*) + 0.5) / 100 AS rate FROM f GROUP BY dataset HAVING count(*) FILTER (junk) > 0")
def p19(spark, d):
    return junk(spark, d).groupBy("dataset").agg(percent(F.count_if("junk"), F.count("*")).alias("rate")).where("rate > 0")


@query("p20_name_validation", "SELECT 'u1_nosuch' AS name, FALSE AS known UNION ALL SELECT 'cell', TRUE")
def p20(spark, d):
    """Names are checked before anything runs."""
    have = M.signatures(spark, d).columns
    rows = []
    for n in ("u1_nosuch", "cell"):
        try:
            C.check_names([n], have)
            rows.append((n, True))
        except ValueError:
            rows.append((n, False))
    return spark.createDataFrame(rows, "name string, known boolean")


@query("j05_refined_groups", W + M.MEMBER + ", g AS (SELECT cell AS id, donor || '|' || nchains || '|' || clono AS group_key FROM mem) SELECT group_key, count(*) AS n FROM g GROUP BY 1")
def j05(spark, d):
    g = G.refined_groups(M.members(spark, d), "cell", [F.col("donor"), F.col("nchains").cast("string"), F.col("clono")])
    return g.groupBy("group_key").agg(F.count("*").alias("n"))


@query("j03_stretch_join", W + M.SEGMENT + " SELECT a.name AS src, b.name AS dst, CAST(hamming(a.name, b.name) AS BIGINT) AS distance FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name < b.name WHERE hamming(a.name, b.name) <= 5")
def j03s(spark, d):
    return G.hamming_pairs(M.segments(spark, d), "name", "name", 5)


@query("r03_tunables")
def r03(spark, d):
    return spark.createDataFrame([(k, float(v)) for k, v in vars(J.JoinRule()).items()], "name string, value double")


@query("r04_chain_columns", W + M.SIGNATURE + ", c AS (SELECT DISTINCT s.clono, p.kind, p.c_name FROM sig s JOIN plain p USING (cell)) SELECT clono, kind, c_name, dense_rank() OVER (PARTITION BY clono ORDER BY kind) AS col FROM c")
def r04(spark, d):
    """Chains of a clonotype that are linked take one column; columns count from 1."""
    c = M.signatures(spark, d).select("clono", F.explode(F.array_distinct(F.split("exact", " "))).alias("x")).distinct()
    c = c.select("clono", F.substring("x", 1, 1).alias("kind"), F.substring("x", 2, 1).alias("c_name"))
    return c.withColumn("col", F.dense_rank().over(Window.partitionBy("clono").orderBy("kind")).cast("long"))


@query("t05_text_tree")
def t05(spark, d):
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name")
        tree = T.rooted(T.neighbour_joining(T.base_distances(list(pdf["seq"]))))
        return pd.DataFrame({"clonotype": [pdf["clonotype"].iloc[0]], "text": [T.text_tree(tree, dict(enumerate(pdf["name"])))]})

    return tree_members(spark, d).groupBy("clonotype").applyInPandas(one, "clonotype long, text string")


@query("v03_circle_packing")
def v03(spark, d):
    """Places of all clusters of a plot, one circle a distinct signature; the driver packs them."""
    top = M.signatures(spark, d).groupBy("exact").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exact").collect()
    places = P.pack_circles([r.n**0.5 for r in top])
    return spark.createDataFrame([(r.exact, float(r.n**0.5), x, y) for r, (x, y) in zip(top, places)], "exact string, radius double, x double, y double")


@query("v04_split_by_origin", W + M.MEMBER + " SELECT donor, exact, count(*) AS n FROM mem GROUP BY ALL")
def v04(spark, d):
    return M.members(spark, d).groupBy("donor", "exact").agg(F.count("*").alias("n"))


@query("v07_points_in_polygon", "SELECT o_orderkey AS cell FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 200000 AND o_custkey > 10 AND o_custkey < 60")
def v07(spark, d):
    box = [(100000.0, 10.0), (200000.0, 10.0), (200000.0, 60.0), (100000.0, 60.0)]

    x, y = F.col("o_totalprice"), F.col("o_custkey").cast("double")
    # half a step to either side: points on the box's edges are outside
    return table(spark, d, "orders").where(P.inside_columns(box, x, y - 0.5) & P.inside_columns(box, x, y + 0.5) & (x != box[0][0])).select(F.col("o_orderkey").alias("cell"))


def shade_sql(c):
    terms = " + ".join(f"({a!r})::DOUBLE * pow(k / 255::DOUBLE, {i})" for i, a in enumerate(c))
    return f"CAST(least(255, greatest(0, floor(255 * ({terms}) + 0.5))) AS BIGINT)"


@query("v08_palette", "SELECT CAST(k AS INTEGER) AS shade, format('#{:02x}{:02x}{:02x}', " + ", ".join(map(shade_sql, P.TURBO)) + ") AS colour FROM range(256) t(k)")
def v08(spark, d):
    return spark.createDataFrame([(k, P.turbo(k)) for k in range(256)], "shade int, colour string")


@query("f36_region_starts", W + AA + ", c AS (SELECT name, aa, regexp_extract(aa, '[A-Z]C[A-Z]{2}[ASTVFG]') AS hit FROM aa) SELECT name, CASE WHEN hit <> '' THEN position(hit IN aa) - 1 + 5 END AS cdr1 FROM c")
def f36(spark, d):
    return amino(spark, d).select("name", region_starts(F.col("aa"))["cdr1"].cast("long").alias("cdr1"))


def long_amino(spark, d):
    """128 residues a name: long enough for every region."""
    x = M.segments(spark, d).select("name", F.concat(*(M.dna(F.concat("name", F.lit(t))) for t in ("", "a", "b", "c"))).alias("seq"))
    return x.select("name", S.translate(F.col("seq")).alias("aa"))


def motif_sql(places, low, high):
    """The best place of a motif in aa, the last of equals."""
    weigh = " + ".join(f"CASE WHEN substr(aa, j + {k + 1}, 1) IN ({', '.join(repr(c) for c in place)}) THEN {next(iter(place.values()))} ELSE 0 END" for k, place in enumerate(places) if place)
    return f"list_max(list_transform(range(CAST({low} AS BIGINT), CAST(least({high}, length(aa) - {len(places)}) AS BIGINT) + 1), lambda j: 1000 * ({weigh}) + j)) % 1000"


LONG = ", ".join(f"translate(md5(name || '{t}{u}'), '{M.HEX}', '{M.BASES}')" for t in ("", "a", "b", "c") for u in ("", "1", "2"))
REGIONS = (
    W + M.SEGMENT + f", lng AS (SELECT name, concat({LONG}) AS seq FROM seg), res AS (SELECT name, {AMINO} AS aa FROM lng), one AS (SELECT name, aa, {motif_sql(R.motif(R.FR1), '0', '40')} AS f1, {motif_sql(R.motif(R.FR2), '40', '73')} + 2 AS fr2 FROM res), "
    "two AS (SELECT *, f1 + CASE WHEN substr(aa, f1 + 1, 1) = 'C' THEN 1 ELSE 0 END AS fr1 FROM one) "
    f"SELECT name, fr1, {motif_sql(R.motif(R.CDR1), '25', 'fr1 + 19')} + 5 AS cdr1, fr2, fr2 + 15 AS cdr2 FROM two"
)


@query("f36_framework_regions", REGIONS)
def f36r(spark, d):
    """Starts of the first regions of kappa chains by weighted motifs."""
    x = long_amino(spark, d).select("name", R.starts(F.col("aa"), "IGK").alias("s"))
    return x.select("name", *(F.col(f"s.{c}").cast("long").alias(c) for c in ("fr1", "cdr1", "fr2", "cdr2")))


@query("f08_regions_of_all_chains")
def f08r(spark, d):
    """Regions of a V segment as residues, for each chain type."""
    aa = F.col("aa")
    out = None
    for chain in ("IGH", "IGK", "IGL", "TRA", "TRB"):
        x = long_amino(spark, d).select(F.lit(chain).alias("chain"), "name", "aa", R.starts(aa, chain).alias("s"))
        x = x.select("chain", "name", *(R.region(aa, F.col(f"s.{a}"), F.col(f"s.{b}")).alias(n) for n, a, b in (("fwr1", "fr1", "cdr1"), ("cdr1", "cdr1", "fr2"), ("fwr2", "fr2", "cdr2"), ("cdr2", "cdr2", "fr3"), ("fwr3", "fr3", "cdr3"))))
        out = x if out is None else out.union(x)
    return out



CHAINS = ("IGH", "IGK", "IGL", "TRA", "TRB")
#: Named variables of each of the four queries on found regions.
COUNTED = ["count_cdr_[ST]", "count_fwr_[ST]", "count_cdr1_C", "count_fwr2_[KR]", "count_fwr3_S", "count_Q"]
SLICED = ["cdr1_aa_ref", "cdr1_dna_ref", "cdr2_aa_ref", "fwr1_dna_ref", "fwr2_aa_ref", "cdr1_dna", "cdr2_aa", "fwr2_len"]
EXTENDED = ["cdr1_aa_2_1_ext", "cdr1_aa_-1_-1_ext", "cdr2_aa_0_3_ext", "cdr3_aa_1_2_ext"]
NORTHERN = ["cdr1_aa_north", "cdr2_aa_north", "cdr3_aa_north"]


def on_regions(spark, d, names):
    """The named variables of 128 residues a name, for each chain type by its own starts; CDR3 ends three residues before the end, references are the least name of the same length."""
    seq = F.concat(*(M.dna(F.concat("name", F.lit(t))) for t in ("", "a", "b", "c")))
    x = M.segments(spark, d).select("name", F.length("name").alias("len"), seq.alias("dna")).withColumn("aa", S.translate(F.col("dna")))
    r = x.groupBy("len").agg(F.min_by("dna", "name").alias("ref_dna"), F.min_by("aa", "name").alias("ref_aa"))
    x = stage(x.join(r, "len"), "residues")
    ref = any("_ref" in n for n in names)
    out = None
    for chain in CHAINS:
        place = lambda c, chain=chain: R.starts(F.col(c), chain).withField("cdr3_end", F.length(c) - 3)
        y = x.withColumn("starts", place("aa"))
        y = y.withColumn("ref_starts", place("ref_aa")) if ref else y
        y = y.select(F.lit(chain).alias("chain"), "name", *(c.alias(n) for n, c in Q.planned(names, chain in ("IGH", "TRB")).items()))
        out = y if out is None else out.unionByName(y)
    return out


@query("f07_counts_in_found_regions")
def f07(spark, d):
    return on_regions(spark, d, COUNTED)


@query("f09_slices_of_found_regions")
def f09(spark, d):
    return on_regions(spark, d, SLICED)


@query("f10_extended_found_regions")
def f10(spark, d):
    return on_regions(spark, d, EXTENDED)


@query("f11_north_of_found_regions")
def f11(spark, d):
    return on_regions(spark, d, NORTHERN)


KAPPA = REGIONS.split(" SELECT name, fr1")[0].rstrip() + ", reg AS (" + REGIONS[REGIONS.index("SELECT name, fr1") :] + ")"


@query("f07_kappa_counts", KAPPA + " SELECT name, " + ", ".join(f"CASE WHEN {a} <= {b} THEN len(regexp_extract_all(substr(aa, CAST({a} AS INT) + 1, CAST({b} - {a} AS INT)), '{m}')) ELSE 0 END AS \"count_{r}_{m}\"" for r, a, b, m in (("cdr1", "cdr1", "fr2", "[ST]"), ("fwr1", "fr1", "cdr1", "[ST]"), ("fwr2", "fr2", "cdr2", "[KR]"))) + " FROM reg JOIN res USING (name)")
def f07k(spark, d):
    """Counts within kappa regions, by reference SQL."""
    x = long_amino(spark, d).withColumn("starts", R.starts(F.col("aa"), "IGK"))
    names = ["count_cdr1_[ST]", "count_fwr1_[ST]", "count_fwr2_[KR]"]
    return x.select("name", *(c.alias(n) for n, c in Q.planned(names, False).items()))


@query("x09_group_correspondence", W + M.SIGNATURE + ", e AS (SELECT DISTINCT 'a' || exact AS src, 'b' || clono AS dst FROM sig) SELECT src, dst FROM e")
def x09(spark, d):
    """Two runs' groups that share cells, as a bipartite graph."""
    return M.signatures(spark, d).select(F.concat(F.lit("a"), "exact").alias("src"), F.concat(F.lit("b"), "clono").alias("dst")).distinct()


@query("x09_correspondence_classes", W + M.SIGNATURE + " SELECT clono, min('a' || exact) AS root, count(DISTINCT exact) AS groups FROM sig GROUP BY clono")
def x09c(spark, d):
    e = x09(spark, d)
    c = connected_components(e)
    n = e.join(c, F.col("dst") == F.col("node")).groupBy("dst", "root").agg(F.count("*").alias("groups"))
    return n.select(F.expr("substr(dst, 2)").alias("clono"), "root", "groups")


@query("stream_windowed_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windows(spark, d):
    """The batch twin of a streaming extension."""
    w = windowed_counts(table(spark, d, "events"), "ts", ["event_type"])
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))
