"""The domain's tables as views of star-schema tables.

cell: an order; chain: a line item, numbered within its cell; donor, origin, dataset: region, nation
and market segment of the customer; segment names: brand and type of the part; feature counts: events
of a user. Sequences are derived from part names, 96 nucleotides each, so that sequence functions have
something to work on. Each view has its SQL twin, a WITH item, for the reference queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphframe.session import stage, table

HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def dna(name: Column) -> Column:
    """96 nucleotides that depend on the name alone."""
    one = lambda tail: F.translate(F.md5(F.concat(name, F.lit(tail)).cast("binary")), HEX, BASES)
    return F.concat(one(""), one("1"), one("2"))


DNA_SQL = f"translate(md5(p_name), '{HEX}', '{BASES}') || translate(md5(p_name || '1'), '{HEX}', '{BASES}') || translate(md5(p_name || '2'), '{HEX}', '{BASES}')"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """(cell, donor, origin, dataset, tag, status)."""
    t = lambda n: table(spark, d, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    donor = t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey"))
    return (
        t("orders")
        .join(donor, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("cell"), F.col("r_name").alias("donor"), F.col("n_name").alias("origin"), F.col("c_mktsegment").alias("dataset"), F.col("o_orderpriority").alias("tag"), F.col("o_orderstatus").alias("status"))
    )


def cells_of(spark: SparkSession, d: str) -> DataFrame:
    """(dataset, origin, donor) of every customer, whether or not there are cells."""
    t = lambda n: table(spark, d, n)
    place = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return t("customer").join(place, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("dataset"), F.col("n_name").alias("origin"), F.col("r_name").alias("donor"))


CELL = """cell AS (SELECT o_orderkey AS cell, r_name AS donor, n_name AS origin, c_mktsegment AS dataset, o_orderpriority AS tag, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def chains(spark: SparkSession, d: str) -> DataFrame:
    """(cell, ix, heavy, kind, c_name, umi, reads, v_name, j_name, name, part)."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    line = table(spark, d, "lineitem").withColumn("ix", F.row_number().over(w).cast("long"))
    return line.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("cell"), "ix", (F.col("l_returnflag") == "A").alias("heavy"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("c_name"),
        F.col("l_quantity").cast("long").alias("umi"), F.floor("l_extendedprice").alias("reads"), F.col("p_brand").alias("v_name"), F.col("p_type").alias("j_name"), F.col("p_name").alias("name"), F.col("p_partkey").alias("part"),
    )


CHAIN = f"""chain AS (SELECT l_orderkey AS cell, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS ix, l_returnflag = 'A' AS heavy, l_returnflag AS kind, l_linestatus AS c_name,
  CAST(l_quantity AS BIGINT) AS umi, CAST(floor(l_extendedprice) AS BIGINT) AS reads, p_brand AS v_name, p_type AS j_name, p_name AS name, p_partkey AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def chains_plain(spark: SparkSession, d: str) -> DataFrame:
    """Chains without number or segment names: no shuffle, no join."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cell"), (F.col("l_returnflag") == "A").alias("heavy"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("c_name"),
        F.col("l_quantity").cast("long").alias("umi"), F.floor("l_extendedprice").alias("reads"), F.col("l_partkey").alias("part"),
    )


PLAIN = """plain AS (SELECT l_orderkey AS cell, l_returnflag = 'A' AS heavy, l_returnflag AS kind, l_linestatus AS c_name,
  CAST(l_quantity AS BIGINT) AS umi, CAST(floor(l_extendedprice) AS BIGINT) AS reads, l_partkey AS part FROM lineitem)"""


def umi_chains(spark: SparkSession, d: str) -> DataFrame:
    """(cell, line, heavy, barcode, umi, quals, validated_umis, non_validated_umis, invalidated_umis): chains with lists of UMIs and letters of qualities, both made of hashes."""
    own = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    word = lambda i: F.translate(F.substring(F.md5(F.concat_ws("/", own, i.cast("string")).cast("binary")), 1, 10), HEX, BASES)
    umi = F.col("l_quantity").cast("int")
    several = lambda first, n: F.when(n > 0, F.transform(F.sequence(F.lit(first), F.lit(first - 1) + n), word)).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("cell"), F.col("l_linenumber").cast("long").alias("line"), (F.col("l_returnflag") == "A").alias("heavy"), F.concat(F.lit("BC"), F.col("l_orderkey").cast("string"), F.lit("-1")).alias("barcode"), umi.cast("long").alias("umi"),
        F.substring(F.md5(own.cast("binary")), 1, 8).alias("quals"), several(1, F.floor(umi / 10).cast("int")).alias("validated_umis"), several(101, umi % 3).alias("non_validated_umis"), F.when(umi % 11 != 0, several(201, umi % 2)).alias("invalidated_umis"),
    )


def _umis_sql(first: int, n: str) -> str:
    return f"list_transform(range({first}, {first} + {n}), lambda i: translate(substr(md5(l_orderkey || '/' || l_linenumber || '/' || i), 1, 10), '{HEX}', '{BASES}'))"


UMI = f"""um AS (SELECT l_orderkey AS cell, CAST(l_linenumber AS BIGINT) AS line, l_returnflag = 'A' AS heavy, 'BC' || l_orderkey || '-1' AS barcode, CAST(l_quantity AS BIGINT) AS umi, substr(md5(l_orderkey || '/' || l_linenumber), 1, 8) AS quals,
  {_umis_sql(1, "CAST(l_quantity AS BIGINT) // 10")} AS validated, {_umis_sql(101, "CAST(l_quantity AS BIGINT) % 3")} AS other, CASE WHEN CAST(l_quantity AS BIGINT) % 11 <> 0 THEN {_umis_sql(201, "CAST(l_quantity AS BIGINT) % 2")} ELSE [] END AS invalid FROM lineitem)"""


def signatures(spark: SparkSession, d: str, *more: Column) -> DataFrame:
    """(cell, exact, clono, nchains, umi, reads, *more): equality signature and cluster key of each cell that has chains; more: further aggregates of its chains."""
    return chains_plain(spark, d).groupBy("cell").agg(
        F.array_join(F.sort_array(F.collect_list(F.concat("kind", "c_name"))), " ").alias("exact"),
        F.concat(F.count("*").cast("string"), F.lit(":"), F.array_join(F.sort_array(F.collect_set("kind")), "")).alias("clono"),
        F.count("*").alias("nchains"), F.sum("umi").alias("umi"), F.sum("reads").alias("reads"), *more,
    )


SIGNATURE = (
    PLAIN
    + """, sig AS (SELECT cell, string_agg(kind || c_name, ' ' ORDER BY kind || c_name) AS exact, CAST(count(*) AS VARCHAR) || ':' || string_agg(DISTINCT kind, '' ORDER BY kind) AS clono,
  count(*) AS nchains, CAST(sum(umi) AS BIGINT) AS umi, CAST(sum(reads) AS BIGINT) AS reads FROM plain GROUP BY cell)"""
)


def members(spark: SparkSession, d: str) -> DataFrame:
    """Cells with their signatures."""
    return cells(spark, d).join(signatures(spark, d), "cell")


MEMBER = CELL + ", " + SIGNATURE + ", mem AS (SELECT * FROM cell JOIN sig USING (cell))"


def features(spark: SparkSession, d: str) -> DataFrame:
    """(cell, feature, count): a sparse feature matrix as a long table."""
    e = table(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("cell"), F.col("event_type").alias("feature")).agg(F.sum(F.floor(F.abs("value"))).alias("count"))


FEATURE = "feat AS (SELECT user_id AS cell, event_type AS feature, CAST(sum(CAST(floor(abs(value)) AS BIGINT)) AS BIGINT) AS count FROM events GROUP BY ALL)"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """(name, seq): one derived sequence a distinct part name."""
    return table(spark, d, "part").select("p_name").distinct().select(F.col("p_name").alias("name"), dna(F.col("p_name")).alias("seq"))


SEGMENT = f"seg AS (SELECT DISTINCT p_name AS name, {DNA_SQL} AS seq FROM part)"


def segment_table(spark: SparkSession, d: str) -> DataFrame:
    """(name, seq): D segments of 11 to 31 letters, 24 at most, named by sizes."""
    return table(spark, d, "part").select(_segment_name(F.col("p_size")).alias("name")).distinct().select("name", _segment(F.col("name")).alias("seq"))


def _segment_name(size: Column) -> Column:
    return F.concat(F.lit("D"), (size % 24 + 1).cast("string"))


def _segment(name: Column) -> Column:
    return F.substr(dna(name), F.lit(1), (F.pmod(F.xxhash64(name), F.lit(21)) + 11).cast("int"))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts dealt to all cores: their file is too small to be read by many tasks, what is made of a row takes long."""
    from lymphframe.operators.grouping import spread

    return spread(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), "p_partkey", 8000)


def heavy_chains(spark: SparkSession, d: str) -> DataFrame:
    """(id, v_name, j_name, v, j, seq): recombined chains, one a part.

    V is 96 letters of the brand, J 40 of the type. V's end, J's start and both ends of a D segment,
    that of the part's size, are trimmed, up to five letters stand between segments, one part in seven
    has no D, one in eleven two, and three places are mutated.
    """
    key = lambda k, n: F.pmod(F.xxhash64("p_partkey", F.lit(k)), F.lit(n)).cast("int")
    one, letters = F.lit(1), dna(F.concat(F.col("p_partkey").cast("string"), F.lit("N")))
    x = _parts(spark, d).select("p_partkey", "p_brand", "p_type", _segment_name(F.col("p_size")).alias("name"), dna(F.concat("p_brand", F.lit("V"))).alias("v"), F.substr(dna(F.concat("p_type", F.lit("J"))), one, F.lit(40)).alias("j"))
    whole = _segment(F.col("name"))
    segment = F.substr(whole, one + key(3, 4), F.length(whole) - key(3, 4) - key(4, 4))
    middle = F.when(key(5, 7) == 0, "").when(key(5, 11) == 1, F.concat(segment, F.substr(letters, F.lit(40), key(6, 4)), segment)).otherwise(segment)
    seq = F.concat(F.substr(F.col("v"), one, F.lit(96) - key(1, 5)), F.substr(letters, one, key(2, 6)), middle, F.substr(letters, F.lit(20), key(7, 6)), F.substr(F.col("j"), one + key(8, 4), F.lit(40)))
    x = x.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v_name"), F.col("p_type").alias("j_name"), "v", "j", seq.alias("seq"))
    for k in range(3):
        at = (F.pmod(F.xxhash64("id", F.lit(20 + k)), F.length("seq").cast("long")) + 1).cast("int")
        x = x.withColumn("seq", F.overlay("seq", F.translate(F.substr(F.col("seq"), at, one), "ACGT", "CGTA"), at))
    return stage(x, "heavy_chains")  # so that its expressions don't multiply in what is built on it


def junctions(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq, v, j, frame): the junctions of heavy_chains() with the V and J letters beside them; frame: place of the first base in its codon."""
    x = heavy_chains(spark, d)
    return x.select("id", F.substr("seq", F.lit(83), F.length("seq") - F.lit(102)).alias("seq"), F.substring("v", 83, 14).alias("v"), F.substring("j", 1, 20).alias("j"), F.lit(82 % 3).alias("frame"))


def exact_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(id, v_name, light_c, cells, and of chains h and l: v, j, seq, ref, cdr3_start, cdr3_len; fwr1, cdr12): exact subclonotypes, one a part.

    A family, the parts of one brand and parity of size, shares its recombination, a branch of it, by
    size and type, three mutations of the heavy and one of the light chain; every part has some more.
    """
    family, one = F.concat_ws("/", "p_brand", (F.col("p_size") % 2).cast("string")), F.lit(1)
    branch = F.concat_ws("/", family, (F.col("p_size") % 4).cast("string"), "p_type")
    h = lambda n, *key: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    letters = dna(F.concat(family, F.lit("N")))

    def mutated(x: DataFrame, name: str, size: int, key: Column, label: str, count: int, least: Column | None = None) -> DataFrame:
        """x with `count` letters (`least`, if given) among the first `size` of column `name` changed at hashed places."""
        for k in range(count):
            at = h(size, key, F.lit(f"{label}{k}")) + 1
            new = F.overlay(name, F.translate(F.substr(F.col(name), at, one), "ACGT", "CGTA"), at)
            x = x.withColumn(name, new if least is None else F.when(least > k, new).otherwise(F.col(name)))
        return x

    x = _parts(spark, d).select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("v_name"), family.alias("family"), branch.alias("branch"), letters.alias("letters"), *(dna(F.concat("p_brand", F.lit(t))).alias(t) for t in "VJLK"))
    fam, own = F.col("family"), F.col("id").cast("string")
    segment = _segment(_segment_name(h(24, fam)))
    x = x.select("id", "v_name", "family", "branch", F.col("V").alias("h_v"), F.substring("J", 1, 40).alias("h_j"), F.col("L").alias("l_v"), F.substring("K", 1, 40).alias("l_j"), F.concat(F.substr("V", one, 96 - h(5, fam)), F.substr("letters", one, h(8, fam, F.lit(1))), segment, F.substr("letters", F.lit(30), h(8, fam, F.lit(2))), F.substr("J", one + h(4, fam), F.lit(40) - h(4, fam))).alias("h_seq"), F.concat(F.substr("L", one, 96 - h(4, fam, F.lit(3))), F.substr("letters", F.lit(60), h(4, fam, F.lit(4))), F.substr("K", F.lit(1), F.lit(40))).alias("l_seq"))
    x = mutated(mutated(x, "h_seq", 84, F.col("branch"), "h", 3), "h_seq", 84, own, "o", 4, h(5, F.lit("o"), own))
    x = mutated(mutated(x, "h_seq", 100, own, "c", 3, h(4, F.lit("c"), own)), "l_seq", 84, F.col("branch"), "l", 1)
    x = mutated(x, "l_seq", 100, own, "m", 2, h(3, F.lit("m"), own))
    gap = lambda c: F.length(f"{c}_seq") - F.lit(104)
    ref = lambda c: F.concat(F.substring(f"{c}_v", 1, 84), F.repeat(F.lit("A"), gap(c)), F.substring(f"{c}_j", 21, 20)).alias(f"{c}_ref")
    part = lambda *p: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(n).alias("size")) for a, n in p))
    return x.select(
        "id", "v_name", F.when(h(9, own) == 0, "IGLC").otherwise("IGKC").alias("light_c"), (h(3, own) + 1).alias("cells"), "h_v", "h_j", "h_seq", ref("h"), F.lit(85).alias("h_cdr3_start"), gap("h").alias("h_cdr3_len"),
        "l_v", "l_j", "l_seq", ref("l"), F.lit(85).alias("l_cdr3_start"), gap("l").alias("l_cdr3_len"), part((1, 24)).alias("fwr1"), part((25, 12), (55, 12)).alias("cdr12"),
    )


def reference_segments(spark: SparkSession, d: str) -> DataFrame:
    """(name, kind, seq): V of the brands, J of the types, four constant and six leading regions."""
    p = table(spark, d, "part")
    v = p.select("p_brand").distinct().select(F.col("p_brand").alias("name"), F.lit("V").alias("kind"), dna(F.concat("p_brand", F.lit("V"))).alias("seq"))
    j = p.select("p_type").distinct().select(F.col("p_type").alias("name"), F.lit("J").alias("kind"), F.substring(dna(F.concat("p_type", F.lit("J"))), 1, 40).alias("seq"))
    other = spark.range(10).select(F.when(F.col("id") < 4, F.concat(F.lit("C"), "id")).otherwise(F.concat(F.lit("U"), F.col("id") - 4)).alias("name"))
    return v.union(j).union(other.select("name", F.substring("name", 1, 1), dna(F.col("name"))))


def contig_sequences(spark: SparkSession, d: str) -> DataFrame:
    """(id, seq, v_name, j_name, c_name): heavy_chains() between a leading and the start of a constant region; every fifth is reversed."""
    h = lambda n, k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    x = heavy_chains(spark, d).withColumn("c_name", F.concat(F.lit("C"), h(4, "c").cast("string"))).withColumn("u_name", F.concat(F.lit("U"), h(6, "u").cast("string")))
    seq = F.concat(F.substr(dna(F.col("u_name")), F.lit(50)), "seq", F.substring(dna(F.col("c_name")), 1, 60))
    back = F.reverse(F.translate(seq, "ACGT", "TGCA"))
    return x.select("id", F.when(h(5, "r") == 0, back).otherwise(seq).alias("seq"), "v_name", "j_name", "c_name")


def donor_chains(spark: SparkSession, d: str) -> DataFrame:
    """(id, exact, donor, v_name, j_name, cdr3_len, v, j, seq): heavy_chains() of four donors, two chains an exact subclonotype.

    Half of a donor's chains of a V segment have other letters at two places of their own germline.
    """
    x = heavy_chains(spark, d).withColumn("donor", F.concat(F.lit("d"), (F.col("id") % 4).cast("string")))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)) == 0
    for k in range(2):
        at = (F.pmod(F.xxhash64("donor", "v_name", F.lit(k)), F.lit(75)) + 1).cast("int")
        x = x.withColumn("seq", F.when(half, F.overlay("seq", F.translate(F.substr(F.col("v"), at, F.lit(1)), "ACGT", "GTAC"), at)).otherwise(F.col("seq")))
    return x.select("id", F.floor(F.col("id") / 8).alias("exact"), "donor", "v_name", "j_name", (F.length("seq") - 104).alias("cdr3_len"), "v", "j", "seq")


def clonotype_chains(spark: SparkSession, d: str, exacts: DataFrame, clonotypes: DataFrame) -> DataFrame:
    """(clonotype, exact, ix, left, seq, cdr3_len) of exact_pairs(): every third with its chains in the other order, every fourth with a second light chain, every ninth with a heavy chain alone."""
    x = exacts.join(clonotypes, "id")
    h = lambda n, k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n))
    one = lambda left, seq, size: F.struct(F.lit(left).alias("left"), seq.alias("seq"), size.cast("int").alias("cdr3_len"))
    heavy, light = one(True, F.col("h_seq"), F.col("h_cdr3_len")), one(False, F.col("l_seq"), F.col("l_cdr3_len"))
    other = dna(F.concat("v_name", F.lit("M")))
    second = one(False, F.overlay(other, F.translate(F.substr(other, (h(90, "m") + 1).cast("int"), F.lit(1)), "ACGT", "CGTA"), (h(90, "m") + 1).cast("int")), F.lit(12))
    two = F.when(h(3, "s") == 0, F.array(light, heavy)).otherwise(F.array(heavy, light))
    parts = F.when(h(9, "o") == 0, F.array(heavy)).when(h(4, "t") == 0, F.concat(F.array(second), two)).otherwise(two)
    return x.select("clonotype", F.col("id").alias("exact"), F.posexplode(parts).alias("ix", "c")).select("clonotype", "exact", "ix", "c.left", "c.seq", "c.cdr3_len")
