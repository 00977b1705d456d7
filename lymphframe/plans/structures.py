"""Alignment functions F15-F18, F33, join scoring J02 and R02, trees T01-T05, plot data V01-V06, offline programs X."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from lymphframe.functions import align as A
from lymphframe.functions import junction as N
from lymphframe.functions import sequence as S
from lymphframe.operators import alleles as Y
from lymphframe.operators import annotate as X
from lymphframe.operators import clonotype as C
from lymphframe.operators import coherence as H
from lymphframe.operators import columns as L
from lymphframe.operators import grouping as G
from lymphframe.operators import plots as P
from lymphframe.operators import trees as T
from lymphframe.operators.components import connected_components
from lymphframe.operators.forest import forests
from lymphframe.plans.functions import referenced
from lymphframe.plans.registry import query
from lymphframe.session import stage, table
from lymphframe.sources import mapped as M

W = "WITH "


@query("f15_f16_edits_and_cigar")
def f15(spark, d):
    x = referenced(spark, d).withColumn("e", A.edit_udf()(F.substring("seq", 61, 36), F.substring("r", 61, 36)))
    return x.select("name", "e.comp", "e.edit", "e.cigar")


def d_segments(spark, d):
    """The D genes by name: a reference set, refused if it is larger than any."""
    found = M.segment_table(spark, d).orderBy("name").limit(N.MOST_SEGMENTS + 1).collect()
    N.choices(out := {r.name: r.seq for r in found})
    return out


def aligned_junctions(spark, d, how=N.aligned_udf):
    x = G.spread(M.junctions(spark, d), "id", 4000)
    return x.withColumn("b", how(d_segments(spark, d))("seq", "v", "j"))


@query("f17_best_segments")
def f17(spark, d):
    """The best and second best of no, one and two D segments for each heavy junction, with scores."""
    return aligned_junctions(spark, d, N.best_udf).select("id", F.when(F.col("b.d1_name") == "", "none").otherwise(F.col("b.d1_name")).alias("d1_name"), "b.d1_score", F.when(F.col("b.d2_name") == "", "none").otherwise(F.col("b.d2_name")).alias("d2_name"), "b.d2_score", (F.col("b.d1_score") - F.col("b.d2_score")).alias("d_delta"))


@query("f18_junction_complexity")
def f18c(spark, d):
    """Complexity, inserted, matching and substituted bases of each heavy junction against its best segments."""
    return aligned_junctions(spark, d).select("id", "b.hcomp", "b.jun_ins", "b.jun_mat", "b.jun_sub")


@query("f18_junction_counts", W + M.SEGMENT + ", ref AS (SELECT length(name) AS len, min(seq) AS r FROM seg GROUP BY 1) SELECT name, CAST(hamming(substr(seq, 61, 36), substr(r, 61, 36)) AS BIGINT) AS jun_sub, 36 - CAST(hamming(substr(seq, 61, 36), substr(r, 61, 36)) AS BIGINT) AS jun_mat FROM seg JOIN ref ON length(name) = len")
def f18(spark, d):
    h = S.hamming(F.substring("seq", 61, 36), F.substring("r", 61, 36)).cast("long")
    return referenced(spark, d).select("name", h.alias("jun_sub"), (36 - h).alias("jun_mat"))


@query("f33_visual_alignment")
def f33(spark, d):
    """Each whole V..J sequence printed against the reference of its best D segments, 100 letters a line."""
    x = G.spread(M.heavy_chains(spark, d), "id", 1000)
    return x.select("id", N.pictures_udf(d_segments(spark, d))("seq", "v", "j", F.lit(0)).alias("alignment"))


def printed_junctions(spark, d, second):
    x = G.spread(M.junctions(spark, d), "id", 4000)
    return x.select("id", N.pictures_udf(d_segments(spark, d), 1000, second, S.CODE)("seq", "v", "j", "frame").alias("alignment"))


@query("f33_junction_alignment")
def f33j(spark, d):
    """The junction alone, with residues over the middle bases of their codons."""
    return printed_junctions(spark, d, False)


@query("f33_junction_alignment_2nd")
def f33j2(spark, d):
    """The same against the second best D segments."""
    return printed_junctions(spark, d, True)


@query("r02_chance_of_shares")
def r02(spark, d):
    k = M.chains_plain(spark, d).select((F.col("umi") % 30 + 1).alias("k"), (F.col("reads") % 10).alias("d")).where("d <= k").distinct()
    return k.select("k", "d", C.shared_by_chance()(F.col("k"), F.col("d"), F.lit(700)).alias("p"))


@query("s29_annotated_sequences")
def s29(spark, d):
    """The V, J, C and leading segments of each contig, on either strand, with their alignments."""
    x = G.spread(M.contig_sequences(spark, d).select("id", "seq"), "id", 1000)
    return X.annotated(x, M.reference_segments(spark, d), both_strands=True)


def aligned_heavies(exacts, segments):
    """(id, b): the alignment of the heavy junction of each of `exacts`."""
    x = exacts.select("id", F.substr("h_seq", F.lit(83), F.length("h_seq") - F.lit(102)).alias("seq"), F.substring("h_v", 83, 14).alias("v"), F.substring("h_j", 1, 20).alias("j"))
    return G.spread(x, "id", 4000).select("id", N.aligned_udf(segments)("seq", "v", "j").alias("b"))


def junction_complexity(exacts, segments):
    """Function from (id) to (id, hcomp) of the heavy junctions of `exacts`."""
    return lambda ids: aligned_heavies(exacts.join(ids, "id", "left_semi"), segments).select("id", F.col("b.hcomp").alias("hcomp"))


def joined(spark, d, rule=C.JoinRule()):
    x = stage(M.exact_pairs(spark, d), "exacts")
    return x, C.joined_pairs(x, junction_complexity(x, d_segments(spark, d)), rule)


def clonotypes(spark, d, chains=False):
    """(exacts, members, best, ties): members (id, clonotype), best (id, d1_name, hcomp); with chains, ties of chains that links make."""
    x = stage(M.exact_pairs(spark, d), "exacts")
    best = stage(aligned_heavies(x, d_segments(spark, d)).select("id", "b.d1_name", "b.hcomp"), "best")
    alone = M.clonotype_chains(spark, d, x, x.select("id", F.col("id").alias("clonotype"))) if chains else None
    edges = stage(forests(x, best, chains=alone, third=L.THIRD), "forests")
    found = connected_components(edges.where("src_ix IS NULL").select("src", "dst"))
    members = stage(x.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("clonotype")), "members")
    ties = edges.where("src_ix IS NOT NULL").select(F.concat_ws(":", "src", "src_ix").alias("src"), F.concat_ws(":", "dst", "dst_ix").alias("dst"))
    return x, members, best, ties


@query("j02_scored_join")
def j02(spark, d):
    """Exact subclonotypes of two chains, compared where both lengths agree, linked where the published rule accepts."""
    return clonotypes(spark, d)[1]


@query("r04_columns_of_linked_chains")
def r04(spark, d):
    """The column of each chain, from the links of the clonotype join, third chains and equal sequences."""
    x, members, _, ties = clonotypes(spark, d, chains=True)
    return L.chain_columns(M.clonotype_chains(spark, d, x, members), ties=ties)


def heavy_columns(spark, d):
    """(clonotype, col, d): the best D segments of each heavy chain of joined clonotypes."""
    x, members, best, ties = clonotypes(spark, d, chains=True)
    chains = stage(M.clonotype_chains(spark, d, x, members), "chains")
    heavy = L.chain_columns(chains, ties=ties).join(chains.where("left").select("exact", "ix"), ["exact", "ix"])
    return heavy.join(best.select(F.col("id").alias("exact"), F.col("d1_name").alias("d")), "exact").select("clonotype", "col", "d")


@query("a36_inconsistent_segments")
def a36d(spark, d):
    """Pairs of exact subclonotypes in a heavy column and the share whose best D segments differ."""
    return L.d_inconsistency(heavy_columns(spark, d))


@query("p12_d_conditions")
def p12d(spark, d):
    """Clonotypes with an inconsistent, no or a double D segment."""
    return L.d_conditions(heavy_columns(spark, d))


@query("r01_alleles_by_footprint")
def r01f(spark, d):
    """Alternate V alleles of each donor, from one chain a putative clonotype."""
    a = Y.donor_alleles(Y.one_a_clonotype(M.donor_chains(spark, d), ["j_name", "cdr3_len"]))
    return a.select("donor", "v_name", "allele", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"), "letters", "cells", "seq")


@query("f12_distance_to_donor_alleles")
def f12a(spark, d):
    """Distances to the own donor's alleles, in letters, as the greatest of a chain, and in residues."""
    c = stage(M.donor_chains(spark, d), "chains")
    return Y.donor_distances(c, Y.donor_alleles(Y.one_a_clonotype(c, ["j_name", "cdr3_len"])))


def tree_members(spark, d):
    return M.segments(spark, d).select(F.length("name").cast("long").alias("clonotype"), "name", "seq")


@query("t01_distance_matrix", W + M.SEGMENT + " SELECT a.name AS a, b.name AS b, CAST(hamming(a.seq, b.seq) AS BIGINT) AS distance FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name < b.name")
def t01(spark, d):
    left, right = (tree_members(spark, d).select("clonotype", F.col("name").alias(k), F.col("seq").alias(f"s{k}")) for k in "ab")
    return left.join(right, "clonotype").where("a < b").select("a", "b", S.hamming(F.col("sa"), F.col("sb")).cast("long").alias("distance"))


@query("t02_t03_neighbour_joining")
def t02(spark, d):
    return T.clonotype_trees(tree_members(spark, d), "clonotype", "name", "seq").drop("newick")


@query("t04_newick")
def t04(spark, d):
    return T.clonotype_trees(tree_members(spark, d), "clonotype", "name", "seq").select("clonotype", "newick").distinct()


@query("v01_honeycomb", W + M.SIGNATURE + ", n AS (SELECT exact, cell, CAST(row_number() OVER (PARTITION BY exact ORDER BY cell) - 1 AS DOUBLE) AS k FROM sig), r AS (SELECT *, greatest(1, ceil((sqrt(12 * k + 9) - 3) / 6 - 1e-12::DOUBLE)) AS ring FROM n), p AS (SELECT *, k - 3 * ring * (ring - 1) - 1 AS past FROM r), h AS (SELECT *, pi() / 3 * floor(past / ring) AS a, past / ring - floor(past / ring) AS t FROM p) SELECT exact, cell, " + ", ".join(f"CASE WHEN k = 0 THEN 0 ELSE round(ring * ({f}(a) + ({f}(a + pi() / 3) - {f}(a)) * t), 6) + 0 END AS {c}" for f, c in (("cos", "x"), ("sin", "y"))) + " FROM h")
def v01(spark, d):
    k = G.numbered_within(M.signatures(spark, d), "exact", ["cell"], "k")
    x, y = P.hex_columns(F.col("k"))
    return k.select("exact", "cell", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("v02_cell_colours", W + M.SIGNATURE + ", m AS (SELECT min(umi) AS lo, max(umi) AS hi FROM sig) SELECT cell, CAST(floor(CAST(umi - lo AS DOUBLE) / nullif(hi - lo, 0) * 255 + 0.5) AS BIGINT) AS shade FROM sig, m")
def v02(spark, d):
    s = M.signatures(spark, d)
    m = s.agg(F.min("umi").alias("lo"), F.max("umi").alias("hi"))
    return s.crossJoin(F.broadcast(m)).select("cell", P.scaled(F.col("umi"), F.col("lo"), F.col("hi")).alias("shade"))  # one row


@query("v02_category_colours", W + M.MEMBER + ", h AS (SELECT cell, min(c_name) AS isotype FROM plain WHERE heavy GROUP BY cell), x AS (SELECT mem.cell, dataset || coalesce(isotype, '') AS category, nchains = 2 AS mark FROM mem LEFT JOIN h USING (cell)), c AS (SELECT category, row_number() OVER (ORDER BY count(*) DESC, category) - 1 AS k FROM x GROUP BY category) SELECT cell, least(k, 6) AS shade, mark FROM x JOIN c USING (category)")
def v02c(spark, d):
    """Cells by dataset and isotype, the six most frequent of them in colours of their own, and whether each is marked."""
    h = M.chains_plain(spark, d).where("heavy").groupBy("cell").agg(F.min("c_name").alias("isotype"))
    x = M.members(spark, d).join(h, "cell", "left").select("cell", F.concat("dataset", F.coalesce("isotype", F.lit(""))).alias("category"), (F.col("nchains") == 2).alias("mark"))
    return P.category_shades(x, "category", 6).select("cell", "shade", "mark")


@query("v02_colourings", W + M.MEMBER + """, ds AS (SELECT dataset, row_number() OVER (ORDER BY dataset) - 1 AS ix FROM (SELECT DISTINCT dataset FROM cell)), h AS (SELECT cell, CASE WHEN count(DISTINCT c_name) = 1 THEN CASE min(c_name) WHEN 'F' THEN 1 ELSE 2 END ELSE 0 END AS iso FROM plain WHERE heavy GROUP BY cell), lo AS (SELECT min(umi) AS lo FROM sig)
  SELECT cell, 'default-pre-' || ix % 256 AS by_dataset, 'turbo-pre-' || CAST(floor(CAST(greatest(least(umi, 200), lo) - lo AS DOUBLE) / (200 - lo) * 255 + 0.5) AS BIGINT) AS by_value, CAST(coalesce(iso, 0) AS VARCHAR) AS by_isotype,
    CASE WHEN dataset = 'BUILDING' THEN CASE WHEN nchains = 2 THEN 'rgb(255,200,200)' ELSE 'red' END ELSE CASE WHEN nchains = 2 THEN 'rgb(200,200,255)' ELSE 'blue' END END AS by_mark,
    CASE origin WHEN 'CHINA' THEN 'orange' WHEN 'KENYA' THEN 'green' ELSE 'black' END AS by_origin, CASE WHEN status = 'F' THEN 'violet' ELSE 'black' END AS by_barcode
  FROM mem JOIN ds USING (dataset) LEFT JOIN h USING (cell), lo""")
def v02all(spark, d):
    """Each way to colour a cell: by dataset, by a variable with an upper end, by isotype, by mark, by origin and by barcode."""
    h = M.chains_plain(spark, d).where("heavy").groupBy("cell").agg(F.collect_set("c_name").alias("constants"))  # as many as there are isotypes
    cells = M.members(spark, d).join(h, "cell", "left")
    ix = cells.select("dataset").distinct().withColumn("ix", F.row_number().over(Window.orderBy("dataset")) - 1)  # a row a dataset
    x = P.value_colour(cells.join(ix, "dataset"), "umi", high=200, name="by_value")
    own = F.when(F.col("status") == "F", "violet")
    return x.select(
        "cell", P.dataset_colour(F.col("ix")).alias("by_dataset"), "by_value", P.isotype_colour(F.coalesce("constants", F.array().cast("array<string>")), ["O", "F"]).alias("by_isotype"),
        P.mark_colour(F.col("dataset") == "BUILDING", F.col("nchains") == 2).alias("by_mark"), P.assigned_colour(F.col("origin"), F.col("dataset"), own, {"CHINA": "orange", "KENYA": "green"}).alias("by_origin"), P.assigned_colour(F.col("origin"), F.col("dataset"), own).alias("by_barcode"),
    )


RANGE = "CASE WHEN {0}l <= 0 THEN {0}l * 1.02::DOUBLE WHEN {0}h > {0}l AND {0}l / ({0}h - {0}l) < 0.02::DOUBLE THEN 0 ELSE {0}l * 0.98::DOUBLE END AS {0}_low, CASE WHEN {0}h > 0 THEN {0}h * 1.02::DOUBLE ELSE {0}h * 0.98::DOUBLE END AS {0}_high"


@query("v05_symmetric_axes", W + M.SIGNATURE + ", p AS (SELECT CAST(sum(umi) AS DOUBLE) AS x, log10(CAST(sum(reads) AS DOUBLE)) AS y FROM sig GROUP BY exact HAVING sum(reads) > 0), e AS (SELECT min(x) AS xl, max(x) AS xh, min(y) AS yl, max(y) AS yh FROM p), r AS (SELECT " + RANGE.format("x") + ", " + RANGE.format("y") + " FROM e) SELECT kind, floor(1000 * CASE kind WHEN 'own' THEN x_low ELSE least(x_low, y_low) END + 0.5) AS x_low, floor(1000 * CASE kind WHEN 'own' THEN x_high ELSE greatest(x_high, y_high) END + 0.5) AS x_high, floor(1000 * CASE kind WHEN 'own' THEN y_low ELSE least(x_low, y_low) END + 0.5) AS y_low, floor(1000 * CASE kind WHEN 'own' THEN y_high ELSE greatest(x_high, y_high) END + 0.5) AS y_high FROM r, (VALUES ('own'), ('both')) t(kind)")
def v05s(spark, d):
    """The axes of a plot of exact subclonotypes, each its own and both alike, in thousandths."""
    g = M.signatures(spark, d).groupBy("exact").agg(F.sum("umi").alias("u"), F.sum("reads").alias("r"))
    p = P.xy_points(g, "u", "r", log_y=True)
    both = P.axis_ranges(p).withColumn("kind", F.lit("own")).union(P.axis_ranges(p, symmetric=True).withColumn("kind", F.lit("both")))
    return both.select("kind", *(F.floor(1000 * F.col(c) + 0.5).cast("double").alias(c) for c in ("x_low", "x_high", "y_low", "y_high")))


@query("v05_log_points", W + M.SIGNATURE + " SELECT exact, floor(log10(CAST(sum(umi) AS DOUBLE)) * 1000) AS x_milli, floor(log10(CAST(sum(reads) AS DOUBLE)) * 1000) AS y_milli FROM sig GROUP BY exact HAVING sum(umi) > 0 AND sum(reads) > 0")
def v05(spark, d):
    """Points on logarithmic axes; values that have no logarithm are dropped."""
    g = M.signatures(spark, d).groupBy("exact").agg(F.sum("umi").alias("u"), F.sum("reads").alias("r")).where("u > 0 AND r > 0")
    milli = lambda c: F.floor(F.log10(F.col(c).cast("double")) * 1000).cast("double")
    return g.select("exact", milli("u").alias("x_milli"), milli("r").alias("y_milli"))


@query("x01_penalty_matrix_step", W + M.SEGMENT + ", p AS (SELECT a.seq AS s, b.seq AS t FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name < b.name), x AS (SELECT substr(s, i, 1) AS u, substr(t, i, 1) AS v FROM p, unnest(range(1, 97)) q(i)) SELECT least(u, v) AS a, greatest(u, v) AS b, count(*) AS n FROM x WHERE u <> v GROUP BY ALL")
def x01(spark, d):
    """Substitution counts over pairs, from which a penalty matrix is improved step by step."""
    p = G.similar_pairs(tree_members(spark, d).withColumnRenamed("name", "id"), "id", ["clonotype"], F.lit(True))
    s = M.segments(spark, d)
    x = p.join(s.select(F.col("name").alias("src"), F.col("seq").alias("s")), "src").join(s.select(F.col("name").alias("dst"), F.col("seq").alias("t")), "dst")
    u = x.select(F.explode(F.arrays_zip(F.split("s", "").alias("u"), F.split("t", "").alias("v"))).alias("z")).select(F.col("z.u").alias("u"), F.col("z.v").alias("v")).where("u <> v")
    return u.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n"))


@query("x02_pair_similarity", W + M.SEGMENT + " SELECT levenshtein(a.name, b.name) AS distance, count(*) AS pairs FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name < b.name GROUP BY 1")
def x02(spark, d):
    p = G.similar_pairs(tree_members(spark, d).withColumnRenamed("name", "id"), "id", ["clonotype"], F.lit(True))
    return p.groupBy(F.levenshtein("src", "dst").cast("long").alias("distance")).agg(F.count("*").alias("pairs"))


@query("x05_dataset_table", W + M.CELL + " SELECT dataset, donor, count(*) AS cells FROM cell GROUP BY ALL")
def x05(spark, d):
    return M.cells(spark, d).groupBy("dataset", "donor").agg(F.count("*").alias("cells"))


@query("x07_position_weights", W + M.SEGMENT + " SELECT length(name) AS len, i AS pos, substr(name, i, 1) AS letter, count(*) AS n FROM seg, unnest(range(1, 21)) t(i) WHERE i <= length(name) GROUP BY ALL")
def x07(spark, d):
    s = M.segments(spark, d).select(F.length("name").cast("long").alias("len"), F.posexplode(F.split("name", "")).alias("p", "letter")).where("letter <> ''")
    return s.groupBy("len", (F.col("p") + 1).cast("long").alias("pos"), "letter").agg(F.count("*").alias("n"))


@query("x12_description_table", "SELECT p_partkey AS id, p_name || ', ' || p_brand AS description FROM part")
def x12(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(", ", "p_name", "p_brand").alias("description"))


def coherence_chains(spark, d):
    """(block, donor, light, cdr3): junction residues of the donors' chains."""
    x = M.donor_chains(spark, d)
    return x.select(F.col("v_name").alias("block"), "donor", F.col("j_name").alias("light"), S.translate(F.substr("seq", F.lit(85), 3 * F.floor(F.col("cdr3_len") / 3).cast("int"))).alias("cdr3"))


@query("x01_penalty_matrix")
def x01m(spark, d):
    """The penalty matrix after forty steps of the search, in tenths."""
    found = H.penalty_matrix(stage(coherence_chains(spark, d), "chains"), 40)
    rows = [(a, b, int(found.matrix[i, j])) for i, a in enumerate(H.RESIDUES) for j, b in enumerate(H.RESIDUES)]
    return spark.createDataFrame(rows, "a string, b string, tenths int").withColumn("pairs", F.lit(found.best).cast("long"))


HEX_SQL = ", r AS (SELECT *, greatest(1, ceil((sqrt(12 * k + 9) - 3) / 6 - 1e-12::DOUBLE)) AS ring FROM n), p AS (SELECT *, k - 3 * ring * (ring - 1) - 1 AS past FROM r), h AS (SELECT *, pi() / 3 * floor(past / ring) AS a, past / ring - floor(past / ring) AS t FROM p), pl AS (SELECT *, " + ", ".join(f"CASE WHEN k = 0 THEN 0 ELSE round(ring * ({f}(a) + ({f}(a + pi() / 3) - {f}(a)) * t), 6) + 0 END AS {c}" for f, c in (("cos", "x"), ("sin", "y"))) + " FROM h)"


@query("v04_like_colours_together", "WITH c AS (SELECT o_custkey AS id, count(*) AS size, CASE WHEN min(o_orderpriority) = max(o_orderpriority) THEN min(o_orderpriority) END AS colour FROM orders GROUP BY 1), n AS (SELECT *, CAST(row_number() OVER (ORDER BY size DESC, id) - 1 AS DOUBLE) AS k FROM c)" + HEX_SQL + ", z AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY colour, id) AS ca, row_number() OVER (PARTITION BY size ORDER BY floor(atan2(y, x) * 1e9 + 0.5), id) AS an FROM pl WHERE colour IS NOT NULL) SELECT a.id, a.size, a.colour, b.x, b.y FROM z a JOIN z b ON a.size = b.size AND a.ca = b.an UNION ALL SELECT id, size, colour, x, y FROM pl WHERE colour IS NULL")
def v04c(spark, d):
    """Clusters of cells on a honeycomb, largest in the middle; those of one colour and size are brought together."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("size"), F.min("o_orderpriority").alias("lo"), F.max("o_orderpriority").alias("hi"))
    c = c.select("id", "size", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("colour"), (-F.col("size")).alias("by"), F.lit("").alias("all"))
    k = G.numbered_within(c, "all", ["by", "id"], "k")
    x, y = P.hex_columns(F.col("k"))
    return P.relocated(k.select("id", "size", "colour", (F.round(x, 6) + 0.0).alias("x"), (F.round(y, 6) + 0.0).alias("y")))
