"""How amino acids are coloured: by property, by codon, by differences of codons, by rarity among peers."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lymphframe.functions.sequence import CODE

#: Classes of amino acids by their properties, numbered from 1.
PROPERTIES = {"aliphatic": "AGILPV", "aromatic": "FWY", "acidic": "DE", "basic": "RHK", "hydroxylic": "ST", "sulfurous": "CM", "amidic": "NQ"}


def by_property(aa: Column) -> Column:
    """A digit a residue, its class of PROPERTIES; '.' for one of no class."""
    known = "".join(PROPERTIES.values())
    digits = "".join(str(k) * len(v) for k, v in enumerate(PROPERTIES.values(), 1))
    return F.translate(F.regexp_replace(aa, f"[^{known}]", "."), known, digits)


def codons(seq: Column) -> Column:
    """The whole codons of a sequence; what is left over at its end is none."""
    n = F.floor(F.length(seq) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(seq, 3 * i + 1, F.lit(3)))).when(n == 0, F.array().cast("array<string>"))


def synonym_places() -> dict[str, int]:
    """The place of each codon among those of its amino acid, in alphabetical order, from 0."""
    residue = {"".join(c): CODE[k] for k, c in enumerate(product("TCAG", repeat=3))}
    return {c: sum(residue[o] == residue[c] for o in residue if o < c) for c in residue}


def by_codon(seq: Column) -> Column:
    """A digit a codon, its place among synonyms, so that residues of one kind and equal colour have one codon; '.' for a codon with another letter."""
    places = F.create_map(*(F.lit(x) for c, k in synonym_places().items() for x in (c, str(k))))
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(places, c), F.lit("."))), "")


def codon_consensus(chains: DataFrame, group: list[str], cdr3: str = "cdr3") -> DataFrame:
    """(*group, consensus): for each place of a group's CDR3s the codon of more than half of them, else XXX.

    A row of chains is a chain of an exact subclonotype; null CDR3s take no part, and where lengths
    differ a place counts those that reach it. Codons are counted before anything moves, so a large
    group moves as many rows as it has different codons.
    """
    x = chains.where(F.col(cdr3).isNotNull()).select(*group, F.posexplode(codons(F.col(cdr3))).alias("_place", "_codon"))
    n = x.groupBy(*group, "_place", "_codon").agg(F.count("*").alias("_n"))
    most = n.groupBy(*group, "_place").agg(F.max(F.struct("_n", "_codon")).alias("_m"), F.sum("_n").alias("_all"))
    kept = F.when(2 * F.col("_m._n") > F.col("_all"), F.col("_m._codon")).otherwise("XXX")
    listed = F.array_sort(F.collect_list(F.struct("_place", kept.alias("codon"))))  # as many as a CDR3 has codons
    return most.groupBy(*group).agg(F.array_join(listed["codon"], "").alias("consensus"))


def codon_highlights(seq: Column, ref: Column, start: Column, size: Column, consensus: Column) -> Column:
    """'+' for each codon that shows its colour, '-' for one that is greyed out.

    A codon shows if it differs from the reference's or, within the CDR3 (start, from 1, and size in
    bases), from the consensus there. The reference ends where it ends: letters past it don't differ.
    A null consensus differs nowhere.
    """

    def one(c: Column, i: Column) -> Column:
        at = 3 * i + 1
        there = F.substr(ref, at, F.lit(3))
        same = F.substr(c, F.lit(1), F.length(there)) == there
        shared = F.coalesce(F.substr(consensus, at - start + 1, F.lit(3)) == c, F.lit(True))
        return F.when(~same | ((at >= start) & (at < start + size) & ~shared), "+").otherwise("-")

    return F.array_join(F.transform(codons(seq), one), "")


def peer_colours(chains: DataFrame, peers: DataFrame, key: str, group: str, percent: float, aa: str = "aa") -> DataFrame:
    """(key, colours): a letter a residue: r, no peer has it there; b, at most `percent` of them; k, more, or no peers are known there.

    chains: (key, group, aa), one row a key; peers: (group, pos, residue, n), pos from 1. Residues meet
    the counts of their place by a plain join; a chain with no residue has no row.
    """
    x = chains.select(key, group, F.posexplode(F.regexp_extract_all(aa, F.lit("(.)"))).alias("_at", "residue")).select(key, group, (F.col("_at") + 1).cast("long").alias("pos"), "residue")
    n = peers.groupBy(group, "pos", "residue").agg(F.sum("n").alias("_n"))
    total = n.groupBy(group, "pos").agg(F.sum("_n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("residue", "_n"))).alias("_by"))  # a count a residue
    x = x.join(total, [group, "pos"], "left").withColumn("_n", F.coalesce(F.try_element_at("_by", F.col("residue")), F.lit(0)))
    rare = (F.col("_all") > 0) & (100 * F.col("_n") <= percent * F.col("_all"))
    letter = F.when(~F.coalesce(rare, F.lit(False)), "k").when(F.col("_n") == 0, "r").otherwise("b")
    return x.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", letter.alias("c"))))["c"], "").alias("colours"))
