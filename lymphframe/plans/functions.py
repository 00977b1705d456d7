"""Sequence functions F01-F36 and predicates P01-P22."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lymphframe.functions import colours as Z
from lymphframe.functions import conditions as C
from lymphframe.functions import sequence as S
from lymphframe.functions import umis as U
from lymphframe.functions.stats import distinct_list, half_up, rounded_median
from lymphframe.plans.registry import query
from lymphframe.session import table
from lymphframe.sources import mapped as M

W = "WITH "
AMINO = f"list_reduce(list_transform(range(0, length(seq) // 3), lambda i: substr('{S.CODE}', 16 * (position(substr(seq, 3 * i + 1, 1) IN 'TCAG') - 1) + 4 * (position(substr(seq, 3 * i + 2, 1) IN 'TCAG') - 1) + position(substr(seq, 3 * i + 3, 1) IN 'TCAG'), 1)), lambda a, b: a || b)"
AA = M.SEGMENT + f", aa AS (SELECT name, seq, {AMINO} AS aa FROM seg)"


def amino(spark, d):
    return M.segments(spark, d).withColumn("aa", S.translate(F.col("seq")))


@query("f01_translate", W + AA + " SELECT name, aa FROM aa")
def f01(spark, d):
    return amino(spark, d).select("name", "aa")


@query("f02_first_codon", W + AA + " SELECT name, substr(seq, 1, 3) AS codon, substr(aa, 1, 1) AS residue FROM aa")
def f02(spark, d):
    return M.segments(spark, d).select("name", F.substring("seq", 1, 3).alias("codon"), S.translate(F.substring("seq", 1, 3)).alias("residue"))


PAIR = ", pair AS (SELECT a.name AS n1, b.name AS n2, a.seq AS s1, b.seq AS s2 FROM seg a JOIN seg b ON length(a.name) = length(b.name) AND a.name < b.name)"


def pairs(spark, d):
    """Pairs of distinct sequences within a block of equal name length, each once."""
    s = M.segments(spark, d).withColumn("block", F.length("name"))
    a, b = (s.select("block", F.col("name").alias(f"n{k}"), F.col("seq").alias(f"s{k}")) for k in (1, 2))
    return a.join(b, "block").where("n1 < n2")


@query("f03_levenshtein", W + M.SEGMENT + PAIR + " SELECT n1, n2, levenshtein(n1, n2) AS full_distance, CASE WHEN levenshtein(n1, n2) <= 6 THEN levenshtein(n1, n2) ELSE -1 END AS bounded FROM pair")
def f03(spark, d):
    return pairs(spark, d).select("n1", "n2", F.levenshtein("n1", "n2").cast("long").alias("full_distance"), F.levenshtein("n1", "n2", 6).cast("long").alias("bounded"))


@query("f04_hamming", W + M.SEGMENT + PAIR + " SELECT n1, n2, CAST(hamming(s1, s2) AS BIGINT) AS distance FROM pair")
def f04(spark, d):
    return pairs(spark, d).select("n1", "n2", S.hamming(F.col("s1"), F.col("s2")).cast("long").alias("distance"))


@query("f05_weighted_hamming", W + M.SEGMENT + PAIR + " SELECT n1, n2, list_sum(list_transform(range(1, 97), lambda i: CASE WHEN substr(s1, i, 1) = substr(s2, i, 1) THEN 0.0::DOUBLE WHEN substr(s1, i, 1) || substr(s2, i, 1) IN ('AG', 'GA', 'CT', 'TC') THEN 0.5 ELSE 1.0 END)) AS distance FROM pair")
def f05(spark, d):
    half = F.create_map(*(F.lit(x) for k in ("AG", "GA", "CT", "TC") for x in (k, 0.5)))
    return pairs(spark, d).select("n1", "n2", S.weighted_hamming(F.col("s1"), F.col("s2"), half).alias("distance"))


@query("f06_count_motif", W + AA + " SELECT name, CAST(len(regexp_extract_all(aa, 'S[A-Z]')) AS BIGINT) AS n FROM aa")
def f06(spark, d):
    return amino(spark, d).select("name", F.regexp_count("aa", F.lit("S[A-Z]")).cast("long").alias("n"))


@query("f07_count_in_features", W + AA + " SELECT name, CAST(len(regexp_extract_all(substr(aa, 5, 8), '[ST]')) AS BIGINT) AS count_cdr1, CAST(len(regexp_extract_all(substr(aa, 13, 12), '[ST]')) AS BIGINT) AS count_fwr2 FROM aa")
def f07(spark, d):
    n = lambda a, b: F.regexp_count(F.substring("aa", a, b), F.lit("[ST]")).cast("long")
    return amino(spark, d).select("name", n(5, 8).alias("count_cdr1"), n(13, 12).alias("count_fwr2"))


@query("f08_feature_slices", W + AA + " SELECT name, substr(seq, 13, 24) AS cdr1_dna, substr(aa, 5, 8) AS cdr1_aa, length(replace(substr(aa, 5, 8), '*', '')) AS cdr1_len FROM aa")
def f08(spark, d):
    return amino(spark, d).select("name", F.substring("seq", 13, 24).alias("cdr1_dna"), F.substring("aa", 5, 8).alias("cdr1_aa"), F.length(F.replace(F.substring("aa", 5, 8), F.lit("*"), F.lit(""))).cast("long").alias("cdr1_len"))


@query("f09_reference_slices", W + M.SEGMENT + ", ref AS (SELECT length(name) AS len, min(seq) AS r FROM seg GROUP BY 1) SELECT name, substr(r, 13, 24) AS cdr1_dna_ref FROM seg JOIN ref ON length(name) = len")
def f09(spark, d):
    s = M.segments(spark, d).withColumn("len", F.length("name"))
    return s.join(s.groupBy("len").agg(F.min("seq").alias("r")), "len").select("name", F.substring("r", 13, 24).alias("cdr1_dna_ref"))


@query("f10_extended_slices", W + AA + " SELECT name, substr(aa, 5 - 2, 8 + 2 + 1) AS cdr1_aa_2_1_ext, substr(aa, 5 + 1, 8 - 1 - 1) AS cdr1_aa_m1_m1_ext FROM aa")
def f10(spark, d):
    e = lambda a, b: S.extend(F.col("aa"), F.lit(5), F.lit(8), a, b)
    return amino(spark, d).select("name", e(2, 1).alias("cdr1_aa_2_1_ext"), e(-1, -1).alias("cdr1_aa_m1_m1_ext"))


@query("f11_north_slices", W + AA + " SELECT name, substr(aa, 5 - 3, 8 + 3 + 3) AS heavy1, substr(aa, 5 - 2, 8 + 2 + 3) AS heavy2, substr(aa, 5 + 1, 8 - 2) AS any3 FROM aa")
def f11(spark, d):
    e = lambda k: S.extend(F.col("aa"), F.lit(5), F.lit(8), *S.NORTH[k])
    return amino(spark, d).select("name", e(("heavy", 1)).alias("heavy1"), e(("heavy", 2)).alias("heavy2"), e(("light", 3)).alias("any3"))


REF = ", ref AS (SELECT length(name) AS len, min(seq) AS r FROM seg GROUP BY 1), x AS (SELECT name, seq, r FROM seg JOIN ref ON length(name) = len)"


def referenced(spark, d):
    s = M.segments(spark, d).withColumn("len", F.length("name"))
    return s.join(s.groupBy("len").agg(F.min("seq").alias("r")), "len")


@query("f12_reference_distance", W + M.SEGMENT + REF + " SELECT name, CAST(hamming(substr(seq, 1, 81), substr(r, 1, 81)) AS BIGINT) AS dref FROM x")
def f12(spark, d):
    """Mismatches outside the last 15 bases."""
    return referenced(spark, d).select("name", S.hamming(F.substring("seq", 1, 81), F.substring("r", 1, 81)).cast("long").alias("dref"))


@query("f13_identity_percent", W + M.SEGMENT + REF + " SELECT name, floor(CAST(96 - hamming(seq, r) AS DOUBLE) * 10000 / 96 + 0.5) / 100 AS dna_pct FROM x")
def f13(spark, d):
    return referenced(spark, d).select("name", S.identity_percent(F.col("seq"), F.col("r")).alias("dna_pct"))


@query("f14_distance_by_region", W + M.SEGMENT + REF + " SELECT name, CAST(hamming(substr(seq, 1, 60), substr(r, 1, 60)) AS BIGINT) AS d_donor, CAST(hamming(substr(seq, 61, 36), substr(r, 61, 36)) AS BIGINT) AS d_univ FROM x")
def f14(spark, d):
    h = lambda a, b: S.hamming(F.substring("seq", a, b), F.substring("r", a, b)).cast("long")
    return referenced(spark, d).select("name", h(1, 60).alias("d_donor"), h(61, 36).alias("d_univ"))


@query("f19_differences", W + M.SEGMENT + REF + """, d AS (SELECT name, list_filter(range(1, 13), lambda i: substr(seq, i, 1) <> substr(r, i, 1)) AS places, seq FROM x)
  SELECT name, array_to_string(list_concat(list_concat(list_transform(list_slice(places, 1, 5), lambda i: CAST(i - 1 AS VARCHAR) || substr(seq, i, 1)), CASE WHEN len(places) > 5 THEN ['...'] ELSE [] END), ['+3']), ',') AS cdiff FROM d""")
def f19(spark, d):
    return referenced(spark, d).select("name", S.differences(F.substring("seq", 1, 15), F.substring("r", 1, 12)).alias("cdiff"))


@query("f20_coordinates", W + M.CHAIN + " SELECT cell, ix, length(name) AS vjlen, length(v_name) AS ulen, length(name) - length(j_name) AS d_start, (length(name) - length(j_name)) % 3 AS d_frame FROM chain")
def f20(spark, d):
    n = lambda c: F.length(c).cast("long")
    return M.chains(spark, d).select("cell", "ix", n("name").alias("vjlen"), n("v_name").alias("ulen"), (n("name") - n("j_name")).alias("d_start"), ((n("name") - n("j_name")) % 3).alias("d_frame"))


@query("f21_segment_names", "SELECT DISTINCT p_brand AS v_name, dense_rank() OVER (ORDER BY p_brand) AS v_id FROM part")
def f21(spark, d):
    b = table(spark, d, "part").select(F.col("p_brand").alias("v_name")).distinct()
    return b.select("v_name", F.row_number().over(Window.orderBy("v_name")).cast("long").alias("v_id"))  # the reference's segments, a small dimension


@query("f22_original_names", W + M.CHAIN + " SELECT cell, string_agg(DISTINCT v_name, ',' ORDER BY v_name) AS v_name_orig FROM chain GROUP BY cell")
def f22(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("v_name"))
    return M.chains_plain(spark, d).join(part, "part").groupBy("cell").agg(distinct_list(F.col("v_name")).alias("v_name_orig"))


@query("f23_alleles", W + M.CHAIN + ", a AS (SELECT v_name, j_name, count(*) AS n FROM chain GROUP BY ALL) SELECT v_name, j_name, row_number() OVER (PARTITION BY v_name ORDER BY n DESC, j_name) AS allele, n FROM a")
def f23(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("v_name"), F.col("p_type").alias("j_name"))
    a = M.chains_plain(spark, d).join(part, "part").groupBy("v_name", "j_name").agg(F.count("*").alias("n"))
    return a.select("v_name", "j_name", F.row_number().over(Window.partitionBy("v_name").orderBy(F.desc("n"), "j_name")).cast("long").alias("allele"), "n")


@query("f24_quality_at_position", W + M.UMI + " SELECT cell, string_agg(CAST(ascii(substr(quals, 3, 1)) - 33 AS VARCHAR), ',' ORDER BY line, umi) AS q2_, count(ascii(substr(nullif(substr(quals, 9, 1), ''), 1, 1))) AS n8 FROM um WHERE heavy GROUP BY cell")
def f24(spark, d):
    """Qualities of a cell's heavy chains at place 2, and how many have a place 8, where all have ended."""
    q = F.array_sort(F.collect_list(F.struct("line", "umi", U.quality_at(F.col("quals"), 2).cast("string").alias("q"))))
    return M.umi_chains(spark, d).where("heavy").groupBy("cell").agg(F.array_join(q["q"], ",").alias("q2_"), F.count(U.quality_at(F.col("quals"), 8)).alias("n8"))


UMI_LISTS = {"val": "validated", "nval": "other", "ival": "invalid"}


@query("f25_umi_lists", W + M.UMI + " SELECT cell, line, umi, " + ", ".join([f"len({UMI_LISTS[k]}) AS {v}" for v, k in U.COUNTS.items()] + [f"array_to_string({c}, ',') AS {k}umis, array_to_string(list_transform({c}, lambda u: split_part(barcode, '-', 1) || u), ',') AS {k}bcumis" for k, c in UMI_LISTS.items()]) + " FROM um")
def f25(spark, d):
    """All variables of a chain's lists of UMIs."""
    return M.umi_chains(spark, d).select("cell", "line", "umi", *(U.umi_variable(v).alias(v) for v in U.VARIABLES))


@query("f26_barcode_number", W + M.SEGMENT + " SELECT name, lpad(CAST(list_sum(list_transform(range(1, 17), lambda i: (position(substr(seq, i, 1) IN 'ACGT') - 1) * (CAST(4 AS BIGINT) ** (16 - i))))::BIGINT AS VARCHAR), 10, '0') AS nbc FROM seg")
def f26(spark, d):
    return M.segments(spark, d).select("name", S.barcode_number(F.substring("seq", 1, 16)).alias("nbc"))


@query("f27_innate_evidence", W + M.CHAIN + """ SELECT cell, CASE WHEN bool_or(heavy AND v_name = 'Brand#1') THEN 'h' ELSE '' END || CASE WHEN bool_or(NOT heavy AND v_name IN ('Brand#2', 'Brand#3') AND j_name = 'PROMO') THEN 'l' ELSE '' END || CASE WHEN bool_or(name IN ('red ring', 'small widget')) THEN 'j' ELSE '' END AS evidence FROM chain GROUP BY cell""")
def f27(spark, d):
    """Gene evidence of either chain and junction evidence from a fixed list, as flags in a string."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("v"), F.col("p_type").alias("j"), F.col("p_name").alias("name"))
    flag = lambda c, s: F.when(F.bool_or(c), s).otherwise("")
    c = M.chains_plain(spark, d).join(part, "part")
    light = ~F.col("heavy") & F.col("v").isin("Brand#2", "Brand#3") & (F.col("j") == "PROMO")
    return c.groupBy("cell").agg(F.concat(flag(F.col("heavy") & (F.col("v") == "Brand#1"), "h"), flag(light, "l"), flag(F.col("name").isin("red ring", "small widget"), "j")).alias("evidence"))


@query("f28_sequence_outputs", W + AA + " SELECT name, seq AS vj_seq, substr(seq, 13) AS vj_seq_nl, aa AS vj_aa, substr(aa, 5) AS vj_aa_nl FROM aa")
def f28(spark, d):
    return amino(spark, d).select("name", F.col("seq").alias("vj_seq"), F.expr("substr(seq, 13)").alias("vj_seq_nl"), F.col("aa").alias("vj_aa"), F.expr("substr(aa, 5)").alias("vj_aa_nl"))


@query("f29_notes", W + M.CHAIN + " SELECT cell, ix, CASE WHEN length(name) < 8 THEN 'gap from J stop to C start = ' || (length(name) - 8) ELSE '' END AS notes FROM chain")
def f29(spark, d):
    gap = F.length("name") - 8
    return M.chains(spark, d).select("cell", "ix", F.when(gap < 0, F.concat(F.lit("gap from J stop to C start = "), gap.cast("string"))).otherwise("").alias("notes"))


@query("f30_filter_label", W + M.MEMBER + " SELECT cell, CASE WHEN nchains > 8 THEN 'MAX_CONTIGS' WHEN umi < 20 THEN 'UMI' ELSE '' END AS filter FROM mem")
def f30(spark, d):
    return M.members(spark, d).select("cell", F.when(F.col("nchains") > 8, "MAX_CONTIGS").when(F.col("umi") < 20, "UMI").otherwise("").alias("filter"))


@query("f31_barcode_lists", W + M.MEMBER + " SELECT exact, string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) AS barcodes, coalesce(string_agg(CASE WHEN dataset = 'BUILDING' THEN CAST(cell AS VARCHAR) END, ',' ORDER BY cell), '') AS building_barcodes FROM mem GROUP BY exact")
def f31(spark, d):
    listed = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(c)), lambda x: x.cast("string")), ",")
    return M.members(spark, d).groupBy("exact").agg(listed("cell").alias("barcodes"), listed(F.when(F.col("dataset") == "BUILDING", F.col("cell"))).alias("building_barcodes"))


@query("f32_paralog_normalisation", "SELECT DISTINCT p_brand AS v, regexp_replace(replace(p_brand, 'd', ''), '#.*$', '') AS gene FROM part")
def f32(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("v")).distinct().select("v", F.regexp_replace(F.replace("v", F.lit("d"), F.lit("")), "#.*$", "").alias("gene"))


@query("f34_peer_groups", W + AA + " SELECT length(name) AS len, i AS pos, substr(aa, i, 1) AS residue, count(*) AS n FROM aa, unnest(range(1, 33)) t(i) GROUP BY ALL")
def f34(spark, d):
    a = amino(spark, d).select(F.length("name").cast("long").alias("len"), F.posexplode(F.split("aa", "")).alias("p", "residue")).where("residue <> ''")
    return a.groupBy("len", (F.col("p") + 1).cast("long").alias("pos"), "residue").agg(F.count("*").alias("n"))


@query("f35_property_colors", W + AA + " SELECT name, translate(aa, 'AGILPVFWYDERHKSTCMNQ*', '11111122233444556677.') AS classes FROM aa")
def f35(spark, d):
    return amino(spark, d).select("name", Z.by_property(F.col("aa")).alias("classes"))


@query("f35_codon_colors", W + M.SEGMENT + f""", base AS (SELECT substr('TCAG', CAST(i AS INTEGER), 1) AS b, i FROM range(1, 5) t(i)), code AS (SELECT x.b || y.b || z.b AS codon, substr('{S.CODE}', CAST(16 * x.i + 4 * y.i + z.i - 20 AS INTEGER), 1) AS aa FROM base x, base y, base z),
  place AS (SELECT codon, row_number() OVER (PARTITION BY aa ORDER BY codon) - 1 AS k FROM code), c AS (SELECT name, i, substr(seq, CAST(3 * i + 1 AS INTEGER), 3) AS codon FROM seg, range(0, 32) t(i))
  SELECT name, string_agg(CAST(k AS VARCHAR), '' ORDER BY i) AS places FROM c JOIN place USING (codon) GROUP BY name""")
def f35_codon(spark, d):
    return M.segments(spark, d).select("name", Z.by_codon(F.col("seq")).alias("places"))


#: Chains of a group, names of one length: half of each sequence is that of the least name.
RELATED = ", lead AS (SELECT length(name) AS g, min(name) AS name FROM seg GROUP BY ALL), rel AS (SELECT seg.name, length(seg.name) AS g, substr(l.seq, 1, 48) || substr(seg.seq, 49) AS seq, l.seq AS ref FROM seg JOIN lead ON length(seg.name) = lead.g JOIN seg l ON l.name = lead.name)"


def related(spark, d):
    s = M.segments(spark, d).withColumn("g", F.length("name").cast("long"))
    lead = s.groupBy("g").agg(F.min_by("seq", "name").alias("ref"))
    return s.join(lead, "g").select("name", "g", F.concat(F.substring("ref", 1, 48), F.substring("seq", 49, 48)).alias("seq"), "ref")


@query("f35_codon_differences", W + M.SEGMENT + RELATED + """, c AS (SELECT name, g, i, substr(seq, CAST(3 * i + 1 AS INTEGER), 3) AS codon, substr(ref, CAST(3 * i + 1 AS INTEGER), 3) AS was FROM rel, range(0, 32) t(i)), n AS (SELECT g, i, codon, count(*) AS n FROM c WHERE i >= 12 AND i < 20 GROUP BY ALL),
  m AS (SELECT g, i, max(CASE WHEN 2 * n > t THEN codon END) AS most FROM (SELECT *, sum(n) OVER (PARTITION BY g, i) AS t FROM n) GROUP BY ALL)
  SELECT name, string_agg(CASE WHEN codon <> was OR i >= 12 AND i < 20 AND most IS DISTINCT FROM codon THEN '+' ELSE '-' END, '' ORDER BY i) AS shown FROM c LEFT JOIN m USING (g, i) GROUP BY name""")
def f35_diffs(spark, d):
    """Codons that differ from the group's reference, or in the CDR3, here bases 37 to 60, from most chains of the group."""
    x = related(spark, d)
    con = Z.codon_consensus(x.withColumn("cdr3", F.substring("seq", 37, 24)), ["g"])
    return x.join(con, "g").select("name", Z.codon_highlights(F.col("seq"), F.col("ref"), F.lit(37), F.lit(24), F.col("consensus")).alias("shown"))


@query("f35_peer_rarity", W + AA + """, c AS (SELECT name, length(name) AS g, i AS pos, substr(aa, CAST(i AS INTEGER), 1) AS residue FROM aa, range(1, 33) t(i)), p AS (SELECT g, pos, residue, count(*) AS n FROM c WHERE substr(md5(name), 1, 1) < '8' GROUP BY ALL), t AS (SELECT g, pos, sum(n) AS t FROM p GROUP BY ALL)
  SELECT name, string_agg(CASE WHEN t IS NULL OR 100 * coalesce(n, 0) > 25 * t THEN 'k' WHEN n IS NULL THEN 'r' ELSE 'b' END, '' ORDER BY c.pos) AS colours FROM c LEFT JOIN p USING (g, pos, residue) LEFT JOIN t USING (g, pos) GROUP BY name""")
def f35_rarity(spark, d):
    """Residues that are rare, here a quarter at most, at their place among peers, names of one length and half of the hashes."""
    a = amino(spark, d).withColumn("g", F.length("name").cast("long"))
    peer = a.where(F.substring(F.md5(F.col("name").cast("binary")), 1, 1) < "8").select("g", F.posexplode(F.split("aa", "")).alias("p", "residue")).where("residue <> ''")
    peers = peer.groupBy("g", (F.col("p") + 1).cast("long").alias("pos"), "residue").agg(F.count("*").alias("n"))
    return Z.peer_colours(a, peers, "name", "g", 25)


# --- predicates ---


@query("p01_lead_columns", W + M.MEMBER + " SELECT exact, string_agg(DISTINCT dataset, ',' ORDER BY dataset) AS datasets, count(*) AS n FROM mem GROUP BY exact")
def p01(spark, d):
    return M.members(spark, d).groupBy("exact").agg(distinct_list(F.col("dataset")).alias("datasets"), F.count("*").alias("n"))


@query("p02_chain_columns", W + M.PLAIN + " SELECT cell, CAST(max(umi) FILTER (kind = 'A') AS BIGINT) AS u1, max(umi) FILTER (kind = 'N') AS u2, max(umi) FILTER (kind = 'R') AS u3, max(c_name) FILTER (kind = 'A') AS const1, max(c_name) FILTER (kind = 'N') AS const2, max(c_name) FILTER (kind = 'R') AS const3 FROM plain GROUP BY cell")
def p02(spark, d):
    p = M.chains_plain(spark, d).groupBy("cell").pivot("kind", ["A", "N", "R"]).agg(F.max("umi").alias("u"), F.max("c_name").alias("const"))
    return p.select("cell", *(F.col(f"{k}_{v}").alias(f"{v}{i}") for i, k in enumerate("ANR", 1) for v in ("u", "const")))


@query("p03_amino_positions", W + AA + " SELECT name, substr(aa, 5, 8) AS cdr1, substr(aa, 1, 4) || '.' || substr(aa, 13, 2) AS fwr FROM aa")
def p03(spark, d):
    return amino(spark, d).select("name", F.substring("aa", 5, 8).alias("cdr1"), F.concat(F.substring("aa", 1, 4), F.lit("."), F.substring("aa", 13, 2)).alias("fwr"))


@query("p04_alias", W + M.SIGNATURE + " SELECT cell AS barcode, umi AS u FROM sig")
def p04(spark, d):
    named = dict(x.split(":") for x in ("barcode:cell", "u:umi"))
    return M.signatures(spark, d).select(*(F.col(v).alias(a) for a, v in named.items()))


@query("p05_variable_definition", W + M.SIGNATURE + " SELECT exact, median((CAST(reads AS DOUBLE) - 2 * umi) / nchains) AS x FROM sig GROUP BY exact")
def p05(spark, d):
    s = M.signatures(spark, d)
    name, x = C.define("x:( reads - 2 * umi ) / nchains", s.columns)
    return s.groupBy("exact").agg(F.median(x).alias(name))


@query("p06_cell_predicate", W + M.MEMBER + " SELECT cell FROM mem WHERE dataset = 'BUILDING' AND (umi > 100 OR nchains = 2) AND status <> 'P'")
def p06(spark, d):
    m = M.members(spark, d)
    return m.where(C.predicate("dataset == 'BUILDING' && (umi > 100 || nchains == 2) && status != 'P'", m.columns)).select("cell")


for _k, _f in (("mean", F.avg), ("min", F.min), ("max", F.max)):

    def _p07(spark, d, f=_f):
        s = M.signatures(spark, d)
        cond = C.linear("2*umi - 0.5*nchains ≥ 150", s.columns, f)
        return s.groupBy("clono").agg(cond.alias("ok")).where("ok").select("clono")

    query(f"p07_keep_clono_if_cell_{_k}", W + M.SIGNATURE + f" SELECT clono FROM sig GROUP BY clono HAVING 2.0 * {'avg' if _k == 'mean' else _k}(CAST(umi AS DOUBLE)) - 0.5 * {'avg' if _k == 'mean' else _k}(CAST(nchains AS DOUBLE)) >= 150")(_p07)


@query("p08_numeric_filters", W + M.MEMBER + """, g AS (SELECT clono, dataset, count(*) AS n, sum(umi) AS u FROM mem GROUP BY ALL), t AS (SELECT clono, count(*) AS k, sum(n) AS cells, sum(u) AS umis, max(n) AS n1, CASE WHEN count(*) > 1 THEN list_sort(list(n), 'DESC')[2] END AS n2 FROM g GROUP BY clono)
  SELECT clono FROM t WHERE cells BETWEEN 3 AND 1000 AND umis >= 100 AND k >= 2 AND n1 >= 1.2 * n2""")
def p08(spark, d):
    """MIN_CELLS, MAX_CELLS, MIN_UMIS, MIN_DATASETS and MIN_DATASET_RATIO in one."""
    g = M.members(spark, d).groupBy("clono", "dataset").agg(F.count("*").alias("n"), F.sum("umi").alias("u"))
    t = g.groupBy("clono").agg(F.count("*").alias("k"), F.sum("n").alias("cells"), F.sum("u").alias("umis"), F.sort_array(F.collect_list("n"), asc=False).alias("top"))
    return t.where("cells BETWEEN 3 AND 1000 AND umis >= 100 AND k >= 2 AND get(top, 0) >= 1.2 * get(top, 1)").select("clono")


@query("p09_cdr3_pattern", "SELECT DISTINCT p_name FROM part WHERE regexp_full_match(p_name, 'red .*|.*bolt') OR levenshtein(p_name, 'small rung') <= 2")
def p09(spark, d):
    n = table(spark, d, "part").select("p_name").distinct()
    return n.where(C.sequence_pattern("red .*|.*bolt|small rung~2", F.col("p_name")))


@query("p10_segment_filters", W + M.CHAIN + " SELECT cell FROM chain GROUP BY cell HAVING bool_or(v_name IN ('Brand#1', 'Brand#2')) AND bool_or(j_name = 'PROMO') AND NOT bool_or(v_name = 'Brand#7')")
def p10(spark, d):
    """SEG twice (both needed) and NSEG: semi and anti joins on cells."""
    part = table(spark, d, "part")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("cell"), F.col("l_partkey").alias("p_partkey"))
    named = lambda cond: line.join(part.where(cond).select("p_partkey"), "p_partkey", "left_semi").select("cell").distinct()
    return named(F.col("p_brand").isin("Brand#1", "Brand#2")).join(named(F.col("p_type") == "PROMO"), "cell", "left_semi").join(named(F.col("p_brand") == "Brand#7"), "cell", "left_anti")


@query("p11_barcode_keeps_clonotype", W + M.SIGNATURE + " SELECT cell FROM sig WHERE exact IN (SELECT exact FROM sig WHERE cell IN (1, 5, 9))")
def p11(spark, d):
    s = M.signatures(spark, d)
    return s.join(s.where(F.col("cell").isin(1, 5, 9)).select("exact").distinct(), "exact", "left_semi").select("cell")


@query("p12_existence_filters", W + M.PLAIN + " SELECT cell, bool_or(umi > 45) AS cdiff, bool_or(heavy AND c_name = 'F') AS del, NOT bool_or(heavy) AS d_none FROM plain GROUP BY cell")
def p12(spark, d):
    return M.chains_plain(spark, d).groupBy("cell").agg(F.bool_or(F.col("umi") > 45).alias("cdiff"), F.bool_or(F.col("heavy") & (F.col("c_name") == "F")).alias("del"), (~F.bool_or("heavy")).alias("d_none"))


@query("p13_exact_filters", W + M.SIGNATURE + " SELECT exact, count(*) AS n FROM sig WHERE nchains >= 2 GROUP BY exact HAVING count(*) >= 2")
def p13(spark, d):
    return M.signatures(spark, d).where("nchains >= 2").groupBy("exact").agg(F.count("*").alias("n")).where("n >= 2")


@query("p14_constant_region", W + M.PLAIN + " SELECT DISTINCT cell FROM plain WHERE heavy AND regexp_matches(c_name, 'O')")
def p14(spark, d):
    return M.chains_plain(spark, d).where(F.col("heavy") & F.col("c_name").rlike("O")).select("cell").distinct()


@query("p15_complete", W + M.PLAIN + ", k AS (SELECT cell, string_agg(DISTINCT kind, '' ORDER BY kind) AS kinds, count(*) AS n FROM plain GROUP BY cell), m AS (SELECT k.n, count(DISTINCT p.kind) AS cols FROM k JOIN plain p USING (cell) GROUP BY k.n) SELECT cell FROM k JOIN m USING (n) WHERE length(kinds) = cols")
def p15(spark, d):
    k = M.chains_plain(spark, d).groupBy("cell").agg(F.collect_set("kind").alias("kinds"), F.count("*").alias("n"))
    cols = k.groupBy("n").agg(F.size(F.array_distinct(F.flatten(F.collect_set("kinds")))).alias("cols"))
    return k.join(cols, "n").where(F.size("kinds") == F.col("cols")).select("cell")


@query("p16_onesie_exact_match", W + M.PLAIN + ", n AS (SELECT cell, count(*) AS n FROM plain GROUP BY cell), c AS (SELECT p.*, n.n FROM plain p JOIN n USING (cell)) SELECT cell FROM c WHERE n = 1 AND part NOT IN (SELECT part FROM c WHERE n > 1)")
def p16(spark, d):
    p = M.chains_plain(spark, d)
    n = p.groupBy("cell").agg(F.count("*").alias("n"), F.min("part").alias("part"))
    many = p.join(n.where("n > 1").select("cell"), "cell", "left_semi").select("part").distinct()
    return n.where("n = 1").join(many, "part", "left_anti").select("cell")


@query("p17_max_heavies", W + M.PLAIN + " SELECT cell FROM plain GROUP BY cell HAVING count(*) FILTER (heavy) <= 1")
def p17(spark, d):
    return M.chains_plain(spark, d).groupBy("cell").agg(F.count_if("heavy").alias("h")).where("h <= 1").select("cell")


@query("p18_group_ordinals", W + M.SIGNATURE + ", g AS (SELECT exact, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, exact) AS group_id FROM sig GROUP BY exact) SELECT exact, n, group_id FROM g WHERE group_id = 2 OR group_id BETWEEN 4 AND 6")
def p18(spark, d):
    from lymphframe.sources.readers import expand_ranges

    wanted = expand_ranges("2,4-6")
    g = M.signatures(spark, d).groupBy("exact").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "exact").limit(max(wanted))
    return g.withColumn("group_id", F.row_number().over(Window.orderBy(F.desc("n"), "exact")).cast("long")).where(F.col("group_id").isin(wanted))


@query("p21_regex_features", W + M.FEATURE + " SELECT cell, CAST(sum(count) AS BIGINT) AS n FROM feat WHERE regexp_full_match(feature, '(click|.*w)') GROUP BY cell")
def p21(spark, d):
    return M.features(spark, d).where(F.col("feature").rlike("^(?:(click|.*w))$")).groupBy("cell").agg(F.sum("count").alias("n"))


@query("p22_required_counts", W + M.MEMBER + " SELECT count(*) >= 1 AS cells, count(DISTINCT clono) >= 1 AS clonotypes, count(DISTINCT donor) <= 5 AS donors FROM mem")
def p22(spark, d):
    return M.members(spark, d).agg((F.count("*") >= 1).alias("cells"), (F.count_distinct("clono") >= 1).alias("clonotypes"), (F.count_distinct("donor") <= 5).alias("donors"))


@query("flagship_clonotype_table", W + M.MEMBER + """, g AS (SELECT clono, exact, count(*) AS n, CAST(floor(median(umi) + 0.5) AS BIGINT) AS u, CAST(floor(CAST(sum(reads) AS DOUBLE) / count(reads) + 0.5) AS BIGINT) AS r_mean, string_agg(DISTINCT donor, ',' ORDER BY donor) AS donors FROM mem GROUP BY ALL),
  k AS (SELECT clono FROM mem GROUP BY clono HAVING avg(CAST(umi AS DOUBLE)) >= 50)
  SELECT clono, exact, row_number() OVER (PARTITION BY clono ORDER BY n DESC, exact) AS exact_subclonotype_id, n, u, r_mean, donors FROM g WHERE clono IN (SELECT clono FROM k)""")
def flagship(spark, d):
    """Signature grouping, clonotype-level condition, lead variables and ordinals.

    The clonotype's mean comes from the signatures' sums, so cells are read and dealt once.
    """
    g = M.members(spark, d).groupBy("clono", "exact").agg(
        F.count("*").alias("n"), rounded_median(F.col("umi")).alias("u"), half_up(F.sum("reads") / F.count("reads")).alias("r_mean"), distinct_list(F.col("donor")).alias("donors"), F.sum("umi").alias("umis"),
    )
    w = Window.partitionBy("clono")
    g = g.withColumn("umi_mean", F.sum("umis").over(w) / F.sum("n").over(w)).withColumn("place", F.row_number().over(w.orderBy(F.desc("n"), "exact")).cast("long"))
    kept = g.where(C.linear("umi_mean >= 50", g.columns))
    return kept.select("clono", "exact", F.col("place").alias("exact_subclonotype_id"), "n", "u", "r_mean", "donors")
