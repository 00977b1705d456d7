"""Converters between forms of contig data: annotations, the filtered table with its FASTA, repertoire tables, a smaller JSON and FASTA."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.sources.split import numbered_lines

#: Columns of the filtered table; the last two stay empty.
FILTERED = "barcode is_cell contig_id high_confidence length chain v_gene d_gene j_gene c_gene full_length productive cdr3 cdr3_nt reads umis raw_clonotype_id raw_consensus_id".split()
#: Fields of an annotation that nothing needs when contigs are annotated anew.
NOT_NEEDED = "aa_sequence annotations clonotype frame full_length info start_codon_pos stop_codon_pos cdr1 cdr2 fwr1 fwr2 fwr3 fwr4 validated_umis non_validated_umis invalidated_umis".split()
#: The mark of a perfect quality score.
PERFECT = "]"


def filtered_from_annotations(contigs: DataFrame) -> DataFrame:
    """The filtered table and `seq`, a row a contig (readers.contigs); barcodes get the dataset as their suffix.

    A missing gene, CDR3 or flag is empty or false; a contig without annotations has an empty chain.
    """
    gene = lambda kind: F.coalesce(F.get(F.filter("annotations", lambda a: a["feature"]["region_type"] == kind), F.lit(0))["feature"]["gene_name"], F.lit(""))
    bc = F.concat(F.substring_index("barcode", "-", 1), F.lit("-"), F.coalesce("dataset", F.lit("null")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    values = {
        "barcode": bc, "is_cell": flag("is_cell"), "contig_id": F.concat(bc, F.lit("_contig_"), F.substring_index("contig_name", "_", -1)), "high_confidence": flag("high_confidence"),
        "length": F.length("sequence"), "chain": F.coalesce(F.get("annotations", F.lit(0))["feature"]["chain"], F.lit("")),
        "v_gene": gene("L-REGION+V-REGION"), "d_gene": gene("D-REGION"), "j_gene": gene("J-REGION"), "c_gene": gene("C-REGION"),
        "full_length": flag("full_length"), "productive": flag("productive"), "cdr3": F.coalesce("cdr3", F.lit("")), "cdr3_nt": F.coalesce("cdr3_seq", F.lit("")),
        "reads": F.col("read_count"), "umis": F.col("umi_count"), "raw_clonotype_id": F.lit(""), "raw_consensus_id": F.lit(""),
    }
    return contigs.select(*(values[c].alias(c) for c in FILTERED), F.col("sequence").alias("seq"))


def annotations_from_filtered(table: DataFrame, sequences: DataFrame) -> DataFrame:
    """(record): JSON objects of the filtered table and (contig_id, seq) of its FASTA; qualities, which neither holds, are perfect.

    A contig without a sequence is left out.
    """
    x = table.join(sequences.select("contig_id", "seq"), "contig_id")
    true = lambda c: (F.lower(F.col(c).cast("string")) == "true").alias(c)
    record = F.struct(
        "barcode", F.col("contig_id").alias("contig_name"), true("is_cell"), true("high_confidence"), true("productive"), F.col("reads").cast("long").alias("read_count"), F.col("umis").cast("long").alias("umi_count"),
        F.col("seq").alias("sequence"), F.repeat(F.lit(PERFECT), F.length("seq")).alias("quals"),
    )
    return x.select(F.to_json(record).alias("record"))


def shrunk(contigs: DataFrame) -> DataFrame:
    """(record): the annotations as JSON without the fields that aren't needed; whatever else a contig has is kept."""
    return contigs.select(F.to_json(F.struct(*(c for c in contigs.columns if c not in NOT_NEEDED))).alias("record"))


#: The columns of a repertoire table that contigs are made of.
REPERTOIRE = ("cell_id", "consensus_count", "productive", "sequence")


def annotations_from_repertoire(spark: SparkSession, path: str) -> DataFrame:
    """(record): JSON objects of a repertoire's tab-separated file, a row a contig, named by the number of its line.

    Columns are found by name, in any order; a file without one of REPERTOIRE is an error. What the
    file lacks is set: perfect qualities, no reads; productive contigs ('T') count as cells and as sure.
    """
    lines = numbered_lines(spark, path).where("line <> ''")
    head = lines.where("n = 1").select("line").first()
    names = head.line.split("\t") if head else []
    missing = [c for c in REPERTOIRE if c not in names]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    cut = F.split("line", "\t", -1)
    field = {c: F.get(cut, F.lit(names.index(c))) for c in REPERTOIRE}
    good = field["productive"] == "T"
    record = F.struct(
        field["cell_id"].alias("barcode"), F.concat(F.lit("contig_"), F.col("n") - 1).alias("contig_name"), good.alias("is_cell"), good.alias("high_confidence"), good.alias("productive"), F.lit(0).alias("read_count"),
        field["consensus_count"].cast("long").alias("umi_count"), field["sequence"].alias("sequence"), F.repeat(F.lit(PERFECT), F.length(field["sequence"])).alias("quals"),
    )
    return lines.where("n > 1").select(F.to_json(record).alias("record"))


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq): the records of a FASTA file, plain or gzip, lines of a sequence put together; a record is one task's work."""
    text = spark.read.text(path, lineSep=">").select(F.col("value").alias("r")).where("trim(r) <> ''")
    cut = F.split("r", "\n", 2)
    return text.select(F.rtrim(F.get(cut, F.lit(0))).alias("header"), F.regexp_replace(F.coalesce(F.get(cut, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def shrunk_fasta(records: DataFrame, most: int = 1000, width: int = 80) -> DataFrame:
    """(record): FASTA text of (header, seq) with runs of N cut to `most` letters, in lines of `width`."""
    seq = F.regexp_replace("seq", f"N{{{most},}}", "N" * most)
    return records.select(F.concat(F.lit(">"), "header", F.lit("\n"), F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n")).alias("record"))
