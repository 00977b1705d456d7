"""Alternate V alleles of donors, from the letters their cells have in common, and distances to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lymphframe.functions import sequence as S
from lymphframe.session import stage


@dataclass(frozen=True)
class Evidence:
    """Last letters of V that are left out; times and share that a letter or a footprint must be seen."""

    trim: int = 15
    least: int = 4
    share: float = 0.25


def one_a_clonotype(chains: DataFrame, clonotype: list[str], order: str = "id") -> DataFrame:
    """The chain with the least id of each donor, V segment and putative clonotype."""
    key = ["donor", "v_name", *clonotype]
    return chains.join(chains.groupBy(*key).agg(F.min(order).alias(order)), [*key, order], "left_semi")


def _enough(n: Column, total: Column, rule: Evidence) -> Column:
    return (n >= rule.least) & (n >= rule.share * total)


def donor_alleles(chains: DataFrame, rule: Evidence = Evidence()) -> DataFrame:
    """(donor, v_name, allele, positions, letters, cells, seq): alternate alleles, numbered from 1 by cells, then letters.

    chains: (donor, v_name, v, seq), v the segment's reference, one row a cell that is to be counted; seq
    begins where v does. A position counts (from 0, before the trim) if some letter other than the
    reference's has evidence enough there; cells have their letters at all of these as a footprint, and
    each footprint with evidence enough that isn't the reference's is an allele. Sequences that end
    before a position have '-' there; an allele's seq keeps the reference's letters elsewhere.
    """
    x = stage(chains.where("seq IS NOT NULL AND v IS NOT NULL").select("donor", "v_name", F.upper("v").alias("v"), F.upper("seq").alias("seq")), "chains")
    size = F.greatest(F.length("v") - rule.trim, F.lit(0))
    # letters are counted by row before they are sent: (donor, segment, position, letter)
    letters = x.select("donor", "v_name", "v", F.posexplode(F.split(F.rpad(F.col("seq"), size, "-"), "")).alias("pos", "letter")).where((F.col("letter") != "") & (F.col("pos") < size))
    n = letters.groupBy("donor", "v_name", "v", "pos", "letter").agg(F.count("*").alias("n"))
    n = n.withColumn("total", F.sum("n").over(Window.partitionBy("donor", "v_name", "v", "pos")))  # a letter a row
    good = n.where((F.col("letter") != F.substr("v", F.col("pos") + 1, F.lit(1))) & (F.col("letter") != "-") & _enough(F.col("n"), F.col("total"), rule))
    at = good.groupBy(F.col("donor").alias("at_donor"), F.col("v_name").alias("at_name"), F.col("v").alias("at_v")).agg(F.array_sort(F.collect_set("pos")).alias("positions"))  # a segment's length at most
    take = lambda s: F.array_join(F.transform("positions", lambda p: F.coalesce(F.nullif(F.substr(F.col(s), p + 1, F.lit(1)), F.lit("")), F.lit("-"))), "")
    same = F.col("donor").eqNullSafe(F.col("at_donor")) & F.col("v_name").eqNullSafe(F.col("at_name")) & (F.col("v") == F.col("at_v"))
    prints = x.join(at, same).select("donor", "v_name", "v", "positions", take("seq").alias("letters"))
    f = prints.groupBy("donor", "v_name", "v", "positions", "letters").agg(F.count("*").alias("cells"))
    f = f.withColumn("total", F.sum("cells").over(Window.partitionBy("donor", "v_name", "v")))
    found = f.where(_enough(F.col("cells"), F.col("total"), rule) & (F.col("letters") != take("v")) & ~F.contains("letters", F.lit("-")))
    put = F.transform(F.split("v", ""), lambda c, i: F.when(F.array_contains("positions", i), F.substr("letters", F.array_position("positions", i).cast("int"), F.lit(1))).otherwise(c))
    # evidence of a quarter leaves four at most
    number = F.row_number().over(Window.partitionBy("donor", "v_name", "v").orderBy(F.desc("cells"), "letters"))
    return found.select("donor", "v_name", number.alias("allele"), "positions", "letters", "cells", F.array_join(put, "").alias("seq"))


def with_allele(chains: DataFrame, alleles: DataFrame, trim: int = 15) -> DataFrame:
    """chains (id, donor, v_name, v, j, seq, ...) with allele and germline: the donor's allele that differs least before the trim, 0 and v where none does better."""
    a = alleles.select(F.col("donor").alias("a_donor"), F.col("v_name").alias("a_v"), F.col("allele"), F.col("seq").alias("a_seq"))
    own = chains.join(a, F.col("donor").eqNullSafe(F.col("a_donor")) & F.col("v_name").eqNullSafe(F.col("a_v")))
    size = F.length("v") - trim
    cut = lambda c: S.packed_array(F.substr(c, F.lit(1), size))
    d = own.withColumn("d", S.array_differences(cut("seq"), cut("a_seq"))).withColumn("d0", S.array_differences(cut("seq"), cut("v"))).where("d < d0")
    best = d.groupBy("id").agg(F.min(F.struct("d", "allele", "a_seq")).alias("best"))
    return chains.join(best, "id", "left").select(*chains.columns, F.coalesce("best.allele", F.lit(0)).alias("allele"), F.coalesce("best.a_seq", "v").alias("germline"))


def distances(seq: Column, v: Column, j: Column, v_trim: int = 15, j_trim: int = 15) -> tuple[Column, Column]:
    """(letters, residues) in which a V..J sequence differs from the start of v and the end of j, both trimmed where they meet.

    Residues are compared where whole codons lie in the kept parts; '-' in a codon counts as one.
    """
    size, n = F.greatest(F.length(v) - v_trim, F.lit(0)), F.length(seq)
    tail = F.greatest(F.length(j) - j_trim, F.lit(0))
    apart = lambda a, b: S.once(S.hamming, a, b)
    letters = apart(F.substr(seq, F.lit(1), size), F.substr(v, F.lit(1), size)) + apart(F.right(seq, tail), F.right(j, tail))
    whole = F.floor(n / 3).cast("int")
    end = 3 * whole + 1
    first = (F.floor((end - tail + 3) / 3) + 1).cast("int")  # the first codon that begins after the trimmed J does by more than three letters
    codons = lambda s, start, k: F.when(k > 0, S.once(S.translate, F.substr(s, start, 3 * k))).otherwise("")
    k = F.greatest(F.floor(F.least(size, 3 * whole) / 3).cast("int"), F.lit(0))
    m = F.when(tail > 0, F.greatest(whole - first, F.lit(0))).otherwise(0)
    offset = F.length(j) - (end - 3 * first)
    residues = apart(codons(seq, F.lit(1), k), codons(v, F.lit(1), k)) + apart(codons(seq, 3 * first + 1, m), codons(j, offset + 1, m))
    return letters, residues


def donor_distances(chains: DataFrame, alleles: DataFrame, exact: str = "exact", v_trim: int = 15, j_trim: int = 15) -> DataFrame:
    """(exact, dref, dref_max, dref_aa): sum and maximum over an exact subclonotype's chains of the distances to the donor's own alleles."""
    x = with_allele(chains, alleles, v_trim)
    d, a = distances(F.col("seq"), F.col("germline"), F.col("j"), v_trim, j_trim)
    x = x.select(exact, d.alias("d"), a.alias("a"))
    return x.groupBy(exact).agg(F.sum("d").alias("dref"), F.max("d").alias("dref_max"), F.sum("a").alias("dref_aa"))
