"""Source and sink operators S01-S31 over the mapped tables; readers of real files are tested on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from lymphframe.plans.functions import amino
from lymphframe.plans.registry import query
from lymphframe.session import stage, stage_path, table
from lymphframe.sources import mapped as M
from lymphframe.sources import readers as R
from lymphframe.sources import references as Q
from lymphframe.sources import sinks as K
from lymphframe.sources.convert import annotations_from_repertoire
from lymphframe.sources.split import read_matrix, write_matrix

W = "WITH "


@query("s02_path_list")
def s02(spark, d):
    return spark.createDataFrame([tuple(r.values()) for r in R.path_list("a/1-3,b:c;e/f")], "dataset string, path string, origin string, donor string")


@query("s06_cell_fields_join", "SELECT d.doc_id AS barcode, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def s06(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select(F.col("doc_id").alias("barcode"), F.coalesce(F.col("quality").cast("string"), F.lit("")).alias("quality"))


def written(df, name, sep=","):
    """The path of df as delimited text with a header, in the shared folder."""
    path = stage_path(df.sparkSession, name)
    df.write.csv(path, header=True, sep=sep, emptyValue="")
    return path


@query("s05_metadata_file", "SELECT DISTINCT c_mktsegment || n_name AS dataset, 'runs/' || c_mktsegment || n_name AS path, CAST(NULL AS VARCHAR) AS gex, n_name AS origin, r_name AS donor, CAST(NULL AS VARCHAR) AS color, CAST(NULL AS VARCHAR) AS bc FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def s05(spark, d):
    """Metadata files of two donors' groups, written and read; the dataset is named before the colon or by the path's end."""
    c = M.cells_of(spark, d).select(F.concat("dataset", "origin").alias("id"), "origin", "donor").distinct()
    early = F.col("donor") < "B"
    bcr = F.when(early, F.concat("id", F.lit(":runs/"), "id")).otherwise(F.concat(F.lit("runs/"), "id")).alias("bcr")
    return R.metadata(spark, [written(c.where(w).select(bcr, "origin", "donor"), "meta.csv") for w in (early, ~early)])


@query("s06_joint_cell_fields", "SELECT c_mktsegment AS dataset, CAST(c_custkey AS VARCHAR) AS barcode, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def s06j(spark, d):
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("dataset"), F.col("c_custkey").alias("barcode"), F.col("c_nationkey").alias("nation"))
    return R.cell_fields(spark, written(c, "fields.tsv", "\t"), joint=True)


@query("s07_pair_information", W + M.SEGMENT + ", n AS (SELECT seq, name, length(name) AS len FROM seg) SELECT seq || '_' || md5(name) AS key, seq AS vj_seq1, md5(name) AS vj_seq2, min(CAST(len AS VARCHAR)) AS note FROM n GROUP BY ALL")
def s07(spark, d):
    """Fields of heavy and light pairs; every pair stands twice in the file and the least row is taken."""
    x = M.segments(spark, d).select(F.col("seq").alias("vj_seq1"), F.md5(F.col("name").cast("binary")).alias("vj_seq2"), F.length("name").cast("string").alias("note"))
    return R.pair_info(spark, written(x.union(x.withColumn("note", F.concat("note", F.lit("b")))), "info.csv"), resolve_first=True)


@query("s10_metrics_summary", W + M.CELL + ", m AS (SELECT dataset, count(*) AS cells, count(*) FILTER (status = 'F') AS f FROM cell GROUP BY dataset) SELECT dataset, 'Cells' AS metric, CAST(cells AS DOUBLE) AS value FROM m UNION ALL SELECT dataset, 'Share', floor(CAST(f AS DOUBLE) / cells * 100 + 0.5) / 100 FROM m")
def s10(spark, d):
    """Metrics of each dataset in the form that summaries have, numbers with commas and percentages, read back as numbers."""
    m = M.cells(spark, d).groupBy("dataset").agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "F").alias("f"))
    share = F.concat(F.floor(F.col("f").cast("double") / F.col("cells") * 100 + 0.5).cast("string"), F.lit("%"))
    return R.metrics(spark, written(m.select("dataset", F.format_number("cells", 0).alias("Cells"), share.alias("Share")), "metrics_summary.csv"), "dataset")


SEGMENT_REF = W + M.SEGMENT + ", r AS (SELECT name, seq, dense_rank() OVER (ORDER BY name) AS id FROM seg) SELECT CAST(id AS INTEGER) AS id, 'IGH' || replace(name, ' ', '_') AS name, seq, 0 AS rtype FROM r"


def written_reference(spark, s, seq="seq", folder=None):
    """The path of segments (group_id, group_key, seq) as a reference FASTA."""
    path = f"{folder}/regions.fa" if folder else stage_path(spark, "regions.fa")
    head = F.concat(F.lit(">"), F.col("group_id").cast("string"), F.lit("|IGH"), F.translate("group_key", " ", "_"), F.lit(" x|V|L-REGION"))
    s.select(F.concat(head, F.lit("\n"), F.expr(seq)).alias("record")).write.text(path)
    return path


def numbered_segments(spark, d):
    from lymphframe.operators.grouping import ordinals

    return ordinals(M.segments(spark, d).select("seq", F.col("name").alias("group_key"), F.lit(1).alias("n")))


@query("s11_reference_fasta", SEGMENT_REF)
def s11(spark, d):
    """A reference written as FASTA and read again."""
    return R.reference(spark, written_reference(spark, numbered_segments(spark, d)))


def contig_parts(spark, d):
    """Groups of cells in which contigs are written: a compressed file is read by one task, so files stay small."""
    return F.pmod("cell", F.lit(max(8, table(spark, d, "lineitem").count() // 500_000))).alias("part")


@query("s11_reference_of_contigs", SEGMENT_REF)
def s11c(spark, d):
    """The folders hold no reference and two are known, which differ in every third segment: annotations tell which was used."""
    s = stage(numbered_segments(spark, d), "segments")
    known = {"older": R.reference(spark, written_reference(spark, s, "if(group_id % 3 = 0, left(seq, 90), seq)")), "newer": R.reference(spark, written_reference(spark, s))}
    feature = F.struct(F.col("group_id").cast("int").alias("feature_id"), F.concat(F.lit("IGH"), F.translate("group_key", " ", "_")).alias("gene_name"))
    note = F.array(F.struct(F.length("seq").alias("annotation_length"), feature.alias("feature")))
    c = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("cell"), F.col("l_linenumber").alias("ix"), F.col("p_name").alias("group_key")).join(s, "group_key")
    path = stage_path(spark, "contigs")
    record = F.to_json(F.struct(F.col("cell").cast("string").alias("barcode"), note.alias("annotations")))
    K.write_json_arrays(c.select(contig_parts(spark, d), "cell", "ix", record.alias("record")), ["part"], ["cell", "ix", "record"], path, "gzip")
    return Q.resolve_reference(spark, [stage_path(spark, "empty")], f"{path}/*/part-*", known)


@query("s11_reference_of_folders", SEGMENT_REF)
def s11f(spark, d):
    """Two datasets whose folders hold the same reference at different places."""
    s = stage(numbered_segments(spark, d).coalesce(1), "segments")
    a, b = stage_path(spark, "a"), stage_path(spark, "b")
    written_reference(spark, s, folder=f"{a}/outs/vdj_reference/fasta")
    written_reference(spark, s, folder=f"{b}/vdj_reference/fasta")
    return Q.resolve_reference(spark, [f"{a}/multi/vdj_b", b])


@query("s10_clusters_and_projection", "SELECT CAST(c_custkey AS VARCHAR) AS barcode, CAST(c_nationkey AS INTEGER) AS cluster, CAST(floor(abs(c_acctbal)) AS DOUBLE) AS x, CAST(c_nationkey AS DOUBLE) AS y FROM customer")
def s10c(spark, d):
    """Clusters and coordinates of barcodes written as the two files that clustering makes, read and joined."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("Barcode"), F.col("c_nationkey").alias("Cluster"), F.floor(F.abs("c_acctbal")).alias("UMAP-1"), F.col("c_nationkey").alias("UMAP-2"))
    place = R.projection(spark, written(c.select("Barcode", "`UMAP-2`", "`UMAP-1`"), "projection.csv"))
    return R.clusters(spark, written(c.select("Barcode", "Cluster"), "clusters.csv")).join(place, "barcode").select("barcode", "cluster", F.col("place")[0].alias("x"), F.col("place")[1].alias("y"))


@query("s31_demultiplexed", "SELECT CAST(c_custkey AS VARCHAR) AS barcode, CASE WHEN c_acctbal < 0 THEN 'unassigned' ELSE 'singlet' END AS status, CAST(c_nationkey AS VARCHAR) AS assignment FROM customer")
def s31(spark, d):
    c = table(spark, d, "customer")
    x = c.select(F.col("c_custkey").alias("barcode"), F.when(F.col("c_acctbal") < 0, "unassigned").otherwise("singlet").alias("status"), F.col("c_nationkey").alias("assignment"))
    return R.demultiplexed(spark, written(x, "demux.tsv", "\t"))


@query("s08_external_counts", "SELECT user_id AS cell, event_type AS value, count(*) AS n FROM events GROUP BY ALL")
def s08(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("value")).agg(F.count("*").alias("n"))


@query("s09_feature_matrix", W + M.FEATURE + " SELECT * FROM feat")
def s09(spark, d):
    return M.features(spark, d)


@query("s13_parseable_rows", W + M.SIGNATURE + " SELECT exact AS signature, CAST(count(*) AS VARCHAR) AS n, string_agg(CAST(cell AS VARCHAR), ';' ORDER BY cell) AS barcodes FROM sig GROUP BY exact")
def s13(spark, d):
    g = M.signatures(spark, d).groupBy("exact").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("cell")).alias("barcodes"))
    return K.parseable(g, ["exact", "n", "barcodes"], show={"exact": "signature"})


@query("s13_parseable_cells", W + M.SIGNATURE + " SELECT exact, CAST(cell AS VARCHAR) AS cells, CAST(umi AS VARCHAR) AS umis FROM sig")
def s13c(spark, d):
    """A row a cell needs no list of its group's cells: nothing is gathered that would be taken apart again."""
    return K.parseable(M.signatures(spark, d).select("exact", F.col("cell").alias("cells"), F.col("umi").alias("umis")), ["exact", "cells", "umis"])


GROUP_LINES = W + M.SIGNATURE + ", g AS (SELECT clono, CAST(count(*) AS VARCHAR) AS n, CAST(CAST(sum(umi) AS BIGINT) AS VARCHAR) AS umis FROM sig GROUP BY clono), l AS (SELECT 'clono' AS clono, 'n' AS n, 'umis' AS umis UNION ALL SELECT * FROM g)"


def group_lines(spark, d, style):
    g = M.signatures(spark, d).groupBy("clono").agg(F.count("*").alias("n"), F.sum("umi").alias("umis"))
    return K.preview(g, ["clono", "n", "umis"], style)


@query("s14_preview_aligned", GROUP_LINES + ", w AS (SELECT max(length(clono)) AS a, max(length(n)) AS b, max(length(umis)) AS c FROM l) SELECT rtrim(rpad(clono, CAST(a AS INTEGER), ' ') || '  ' || rpad(n, CAST(b AS INTEGER), ' ') || '  ' || rpad(umis, CAST(c AS INTEGER), ' ')) AS line FROM l, w")
def s14(spark, d):
    return group_lines(spark, d, "aligned")


@query("s14_preview_tabs", GROUP_LINES + " SELECT clono || chr(9) || n || chr(9) || umis AS line FROM l")
def s14t(spark, d):
    return group_lines(spark, d, "tsv")


@query("s15_default_columns")
def s15(spark, d):
    from lymphframe.functions.variables import default_columns

    return spark.createDataFrame([(c,) for c in default_columns(chains=3, gex=True)], "column string")


@query("s16_fasta", W + M.SEGMENT + " SELECT length(name) AS len, '>' || name || chr(10) || seq AS record FROM seg")
def s16(spark, d):
    x = M.segments(spark, d).select(F.length("name").cast("long").alias("len"), "name", "seq", F.lit(None).cast("string").alias("c"))
    return K.fasta(x, "len", ["name"], "seq", "c")


@query("s17_clustal")
def s17(spark, d):
    return K.group_text(amino(spark, d).withColumn("len", F.length("name")), "len", "name", "aa", "clustal_aa")


@query("s18_phylip", W + M.SEGMENT + ", w AS (SELECT length(name) AS len, max(length(name)) + 1 AS wide, count(*) AS n FROM seg GROUP BY 1) SELECT CAST(s.len AS BIGINT) AS len, n || ' 96' || chr(10) || string_agg(rpad(name, CAST(wide AS INTEGER), ' ') || seq || chr(10), '' ORDER BY name) AS text FROM (SELECT *, length(name) AS len FROM seg) s JOIN w ON s.len = w.len GROUP BY s.len, n")
def s18(spark, d):
    return K.group_text(M.segments(spark, d).withColumn("len", F.length("name").cast("long")), "len", "name", "seq", "phylip")


@query("s22_subset", "SELECT page_id, url FROM pages WHERE page_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def s22(spark, d):
    a = table(spark, d, "pages").select(F.lit("p").alias("dataset"), F.col("page_id").alias("barcode"), "url")
    k = table(spark, d, "labels").where("quality = 1").select(F.lit("p").alias("dataset"), F.col("doc_id").alias("barcode"))
    return K.subset_annotations(a, k).select(F.col("barcode").alias("page_id"), "url")


@query("s24_html_text", "SELECT item_id, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM benchmark")
def s24(spark, d):
    return table(spark, d, "benchmark").select("item_id", K.ansi_to_html(F.col("text")).alias("html"))


@query("s28_json_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def s28(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("s30_expand_ranges", "SELECT unnest([100, 101, 500]) AS n")
def s30(spark, d):
    return spark.createDataFrame([(n,) for n in R.expand_ranges("100-101,500")], "n int")


@query("s_barcode_overlap", "WITH b AS (SELECT DISTINCT c_nationkey AS barcode, c_mktsegment AS dataset FROM customer) SELECT x.dataset AS a, y.dataset AS b, count(*) AS shared FROM b x JOIN b y ON x.barcode = y.barcode AND x.dataset < y.dataset GROUP BY ALL")
def overlap(spark, d):
    return R.barcode_overlap(table(spark, d, "customer").select(F.col("c_nationkey").alias("barcode"), F.col("c_mktsegment").alias("dataset")))


@query("s01_contig_annotations", W + M.CELL + ", " + M.CHAIN + f", c AS (SELECT chain.*, dataset, translate(md5(name), '{M.HEX}', '{M.BASES}') AS seq FROM chain JOIN cell USING (cell)) SELECT dataset, CAST(cell AS VARCHAR) || '-1' AS barcode, 'IG' || CASE WHEN heavy THEN 'H' ELSE 'K' END AS chain, v_name, j_name, umi, reads, seq, substr(seq, 3, 28) AS vj_seq FROM c")
def s01(spark, d):
    """Contigs written as JSON arrays, a compressed file a market segment and group of cells, read in pieces and reduced to chains."""
    cells = M.cells(spark, d).select("cell", "dataset")
    c = M.chains(spark, d).join(cells, "cell").withColumn("seq", F.translate(F.md5(F.col("name").cast("binary")), M.HEX, M.BASES))
    kind = F.when(F.col("heavy"), "IGH").otherwise("IGK")
    note = lambda region, gene, a, b: F.struct(F.lit(a).alias("contig_match_start"), F.lit(b).alias("contig_match_end"), F.struct(kind.alias("chain"), gene.alias("gene_name"), F.lit(region).alias("region_type")).alias("feature"))
    barcode = F.concat(F.col("cell").cast("string"), F.lit("-1"))
    record = F.struct(
        barcode.alias("barcode"), F.concat(barcode, F.lit("_contig_"), "ix").alias("contig_name"), F.col("seq").alias("sequence"), F.concat(F.lit("}{"), F.repeat(F.lit("]"), 30)).alias("quals"), F.lit('"{"').alias("version"), F.col("umi").cast("int").alias("umi_count"),
        F.col("reads").cast("int").alias("read_count"), F.lit(True).alias("productive"), F.lit(True).alias("high_confidence"), F.lit(True).alias("is_cell"),
        F.array(note("L-REGION+V-REGION", F.col("v_name"), 2, 20), note("J-REGION", F.col("j_name"), 24, 30)).alias("annotations"),
    )
    path = stage_path(spark, "contigs")
    K.write_json_arrays(c.select("dataset", contig_parts(spark, d), "cell", "ix", F.to_json(record).alias("record")), ["dataset", "part"], ["cell", "ix"], path, "gzip")
    found = R.json_objects(spark, f"{path}/*/*/part-*").select(F.from_json("object", R.CONTIG).alias("r"), F.regexp_extract("file", "dataset=([^/]*)", 1).alias("dataset")).select("r.*", F.url_decode("dataset").alias("dataset"))
    return R.contig_chains(found).select("dataset", "barcode", "chain", "v_name", "j_name", F.col("umi").cast("long").alias("umi"), F.col("reads").cast("long").alias("reads"), "seq", "vj_seq")


MATRIX = W + M.FEATURE + ", b AS (SELECT DISTINCT o_custkey AS cell FROM orders UNION SELECT cell FROM feat)"


@query("s09_sparse_matrix", MATRIX + " SELECT CAST(b.cell AS VARCHAR) AS barcode, count(feat.feature) FILTER (feat.count <> 0) AS features, coalesce(CAST(sum(feat.count) AS BIGINT), 0) AS total FROM b LEFT JOIN feat USING (cell) GROUP BY b.cell")
def s09m(spark, d):
    """A sparse matrix of features by cells, written in coordinate form and read back; cells without a count stay."""
    feat = M.features(spark, d).select(F.col("cell").cast("string").alias("barcode"), "feature", "count")
    cells = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("barcode")).union(feat.select("barcode")).distinct()
    path = stage_path(spark, "matrix")
    write_matrix(feat, cells, feat.select("feature").union(spark.range(1).select(F.lit("never seen"))).distinct(), path)
    barcodes, _, counts = read_matrix(spark, path)
    n = counts.groupBy("barcode").agg(F.count("*").alias("features"), F.sum("count").alias("total"))
    return barcodes.select("barcode").join(n, "barcode", "left").select("barcode", F.coalesce("features", F.lit(0)).alias("features"), F.coalesce("total", F.lit(0)).alias("total"))


@query("s28_json_from_repertoire", "WITH c AS (SELECT 'contig_' || row_number() OVER (ORDER BY o_orderkey) AS name, * FROM orders) SELECT '{\"barcode\":\"B' || o_custkey || '\",\"contig_name\":\"' || name || '\",\"is_cell\":' || (o_orderstatus = 'F') || ',\"high_confidence\":' || (o_orderstatus = 'F') || ',\"productive\":' || (o_orderstatus = 'F') || ',\"read_count\":0,\"umi_count\":' || o_orderkey || ',\"sequence\":\"' || md5(CAST(o_orderkey AS VARCHAR)) || '\",\"quals\":\"' || repeat(']', 32) || '\"}' AS record FROM c")
def s28r(spark, d):
    """A repertoire table of the orders, written in order with its columns shuffled, read back as contig annotations."""
    o = table(spark, d, "orders")
    line = F.concat_ws("\t", F.md5(F.col("o_orderkey").cast("string").cast("binary")), F.lit("x"), F.when(F.col("o_orderstatus") == "F", "T").otherwise("F"), F.col("o_orderkey").cast("string"), F.concat(F.lit("B"), "o_custkey"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("sequence\tnote\tproductive\tconsensus_count\tcell_id").alias("value"))
    path = stage_path(spark, "repertoire.tsv")
    head.union(o.select("o_orderkey", line)).orderBy("k").select("value").write.text(path)
    return annotations_from_repertoire(spark, path)


@query("s13_chain_columns", W + M.CHAIN + " SELECT CAST(cell AS VARCHAR) AS cell, " + ", ".join(f"coalesce(CAST(max(umi) FILTER (ix = {k}) AS VARCHAR), '') AS u{k}, coalesce(max(v_name) FILTER (ix = {k}), '') AS v{k}" for k in (1, 2)) + " FROM chain GROUP BY cell")
def s13p(spark, d):
    """Parseable output with the variables of two chains, of more that the cells have."""
    one = lambda k, c, n: F.max(F.when(F.col("ix") == k, F.col(c))).alias(f"{n}{k}")
    x = M.chains(spark, d).groupBy("cell").agg(*(one(k, c, n) for k in (1, 2, 3, 4) for c, n in (("umi", "u"), ("v_name", "v"))))
    return K.parseable(x, K.parseable_columns(["cell"], ["u", "v"], 2, x.columns))
