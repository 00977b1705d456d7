"""Which reference a run takes: one that is built in or given, the one its folders hold, or the one its contigs name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphframe.session import stage
from lymphframe.sources.readers import CONTIG, reference
from lymphframe.sources.split import json_objects

#: Where a dataset's folder may hold its reference, in order, and ends of its path that don't count.
PLACES = ("outs/vdj_reference/fasta/regions.fa", "vdj_reference/fasta/regions.fa", "regions.fa")
ENDS = ("/multi/vdj_b", "/multi/vdj_t")


def agreed_reference(spark: SparkSession, folders: list[str]) -> str | None:
    """The path of the reference in these folders, None if none has one; an error if two differ. Files are compared by digests made in tasks."""
    conf, found = spark._jsparkSession.sessionState().newHadoopConf(), []
    for folder in folders:
        base = folder.rstrip("/")
        for end in ENDS:
            base = base.removesuffix(end)
        for place in PLACES:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{place}")
            if p.getFileSystem(conf).exists(p):
                found.append(f"{base}/{place}")
                break
    if not found:
        return None
    files = spark.read.format("binaryFile").load(sorted(set(found)))
    # a file that Spark wrote is a folder of parts: its digest is that of its parts in order
    parts = files.select(F.regexp_replace("path", "(regions\\.fa)/.*", "$1").alias("file"), F.struct("path", F.sha2("content", 256).alias("d")).alias("p"), F.length("content").alias("n")).where("n > 0")
    one = parts.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list("p"))["d"], "").alias("d"))
    if one.select("d").distinct().count() > 1:
        raise ValueError("the datasets were made with different references: give one of them and annotate again")
    return found[0]


def reference_of_contigs(spark: SparkSession, path: str, known: dict[str, DataFrame]) -> str:
    """The known reference (id, name, seq) whose segments the contigs at path name.

    Annotations are taken in order; the first that fits one reference alone by id, name and length
    decides. One that fits none first, a contig without annotations, or no decision is an error. Of
    references with the same segments the first counts.
    """
    parts = [r.select(F.lit(k).alias("ref"), "id", "name", F.length("seq").alias("len")) for k, r in enumerate(known.values())]
    x = parts[0]
    for p in parts[1:]:
        x = x.union(p)
    x = stage(x.distinct(), "known")
    same = x.groupBy("ref").agg(F.count("*").alias("n"), F.sum(F.xxhash64("id", "name", "len").cast("decimal(38,0)")).alias("h"))
    first = same.withColumn("first", F.min("ref").over(Window.partitionBy("n", "h"))).where("ref = first").select("ref")  # a row a known reference
    fits = x.join(F.broadcast(first), "ref").groupBy("id", "name", "len").agg(F.count("*").alias("fits"), F.min("ref").alias("ref"))
    c = json_objects(spark, path).select("file", "number", F.from_json("object", CONTIG)["annotations"].alias("a"))
    named = c.select("file", "number", F.posexplode_outer("a").alias("at", "a"))
    named = named.select("file", "number", F.coalesce("at", F.lit(-1)).alias("at"), F.col("a.feature.feature_id").alias("id"), F.col("a.feature.gene_name").alias("name"), F.col("a.annotation_length").alias("len"))
    met = named.join(fits, ["id", "name", "len"], "left").where("at < 0 OR fits IS NULL OR fits = 1")
    got = met.agg(F.min(F.struct("file", "number", "at", F.coalesce("fits", F.lit(0)).alias("fits"), "ref")).alias("m")).first().m
    if got is not None and got["at"] < 0:
        raise ValueError(f"{path} has a contig without annotations: take the built-in reference and annotate again")
    if got is None or not got.fits:
        raise ValueError(f"the reference of {path} is unknown: give it")
    return list(known)[got.ref]


def resolve_reference(spark: SparkSession, folders: list[str], contigs: str | None = None, known: dict[str, DataFrame] | None = None, given: str | None = None, built_in: str | None = None, mouse: bool = False) -> DataFrame:
    """(id, name, seq, ...) of the reference of a run.

    In this order: the known one called built_in; the file `given`; the one that the folders agree on,
    where asking for mouse too is an error; the one that the contigs name among the known.
    """
    known = known or {}
    if built_in:
        return known[built_in]
    if given:
        return reference(spark, given)
    path = agreed_reference(spark, folders)
    if path:
        if mouse:
            raise ValueError("the folders hold a reference, so mouse can't be asked for")
        return reference(spark, path)
    if not contigs or not known:
        raise ValueError("no reference is given or found")
    return known[reference_of_contigs(spark, contigs, known)]
