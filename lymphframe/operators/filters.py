"""Noise filters of cells, each a condition or an anti join, and the table of what each cell fell to.

A cell filter takes and gives (cells, fate): fate has one row a removed cell with the filter's name,
the last filter that hit it winning where filters are switched off and applied again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lymphframe.functions.stats import binomial_tail
from lymphframe.operators.components import connected_components
from lymphframe.operators.grouping import fresh
from lymphframe.session import stage


def drop(cells: DataFrame, fate: DataFrame | None, bad: DataFrame, name: str, key: str = "cell") -> tuple[DataFrame, DataFrame]:
    """Remove the cells of `bad` and note why."""
    bad = bad.select(key).distinct()
    row = cells.select(key).join(bad, key, "left_semi").select(key, F.lit(name).alias("filter"))
    return cells.join(bad, key, "left_anti"), row if fate is None else fate.unionByName(row)


@dataclass(frozen=True)
class Step:
    """A filter of a chain: its label, the switch that turns it off and its rule.

    The rule is a SQL condition on a cell's own columns, or a function from the cells that are left to
    (cell) of those to remove.
    """

    label: str
    switch: str
    rule: str | Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Regroup:
    """A step that removes nothing but gives the cells that are left another value of a column: a function from them to (key, column)."""

    label: str
    switch: str
    column: str
    rule: Callable[[DataFrame], DataFrame]


#: Switches that turn off every filter, or every one but the named.
COMPOSITE = {"NALL": None, "NALL_CELL": "CELL", "NALL_GEX": "GEX"}


def active(steps: Iterable[Step | Regroup], off: Iterable[str] = ()) -> list[Step | Regroup]:
    """The steps that are left when switches are given; an unknown switch is an error."""
    steps, off = list(steps), set(off)
    unknown = off - set(COMPOSITE) - {s.switch for s in steps}
    if unknown:
        raise ValueError(f"unknown switches: {', '.join(sorted(unknown))}")
    return [s for s in steps if s.switch not in off and all(s.label == COMPOSITE[o] for o in off & set(COMPOSITE))]


def run_chain(cells: DataFrame, steps: Iterable[Step | Regroup], off: Iterable[str] = (), key: str = "cell") -> DataFrame:
    """All cells with a column `filter`: the label of the step that removed each, null for those that stay.

    Steps see only what those before them left. Conditions on single cells take no shuffle and are
    evaluated together; before a rule over groups the cells are staged, so that the plan reads a table
    twice instead of growing twofold with each step. A group's verdict comes from an aggregate and is
    joined back by key, never from a window, so a hot group isn't one task's work. No row is dropped:
    a null key is met by conditions alone. A column `filter` that cells has is replaced.
    """
    out = cells.withColumn("filter", F.lit(None).cast("string"))
    for s in active(steps, off):
        if isinstance(s, Step) and isinstance(s.rule, str):
            out = out.withColumn("filter", F.when(F.col("filter").isNull() & F.coalesce(F.expr(s.rule), F.lit(False)), s.label).otherwise(F.col("filter")))
            continue
        out = stage(out, "cells")
        if isinstance(s, Regroup):
            to, value = fresh(out.columns, "to", "value")
            new = s.rule(out.where("filter IS NULL")).select(F.col(key).alias(to), F.col(s.column).alias(value))
            put = F.when(F.col("filter").isNull(), F.coalesce(value, s.column)).otherwise(F.col(s.column)).alias(s.column)
            out = out.join(new, F.col(key) == F.col(to), "left").select(*(put if c == s.column else c for c in out.columns))
            continue
        mark = fresh(out.columns, "bad")[0]
        bad = s.rule(out.where("filter IS NULL")).select(key).distinct().withColumn(mark, F.lit(True))
        out = out.join(bad, key, "left").withColumn("filter", F.when(F.col(mark), s.label).otherwise(F.col("filter"))).drop(mark)
    return out


def duplicated(group: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Rule: every cell that shares `group` with another; cells without one share none."""

    def rule(cells: DataFrame) -> DataFrame:
        n = fresh(cells.columns, "n")[0]
        return cells.join(cells.groupBy(*group).agg(F.count("*").alias(n)).where(F.col(n) > 1), group, "left_semi")

    return rule


def outdone(group: str, top: str, total: str, times: float) -> Callable[[DataFrame], DataFrame]:
    """Rule: cells of a group whose `total` some cell's `top` exceeds `times` over, where so many of them aren't chance."""

    def rule(cells: DataFrame) -> DataFrame:
        best, low, n, k = fresh(cells.columns, "best", "low", "n", "k")
        g = cells.groupBy(group).agg(F.max(top).alias(best))
        marked = cells.join(g, group).withColumn(low, F.col(best) >= times * F.col(total))
        c = marked.groupBy(group).agg(F.count("*").alias(n), F.count_if(low).alias(k)).where((F.col(n) >= 2) & (F.col(k) > 0))
        c = c.where(binomial_tail(F.col(k), F.col(n), 0.1) < 0.01)
        return marked.where(low).join(c.select(group), group, "left_semi")

    return rule


def doublets(pure: DataFrame, times: int = 5) -> DataFrame:
    """(id): pure subclonotypes that two others without a common key seem to make up: each shares a key with it and has `times` its cells.

    pure: (id, n, keys), keys an array of chains or CDR3s without order. Of those that hold a key,
    the one with this key alone makes all not larger than itself needless, as it overlaps with least;
    so a key that many have costs little.
    """
    p = pure.select("id", "n", F.array_distinct(F.filter("keys", lambda k: k.isNotNull())).alias("keys"))
    own = p.select("id", "n", "keys", F.explode("keys").alias("key"))
    alone = own.where(F.size("keys") == 1).groupBy("key").agg(F.max("n").alias("most"))
    others = own.join(alone, "key", "left").where((F.size("keys") == 1) | F.col("most").isNull() | (F.col("n") > F.col("most")))
    others = others.select("key", F.col("id").alias("other"), F.col("n").alias("m"), F.col("keys").alias("held"))
    e = own.join(others, "key").where((F.col("id") != F.col("other")) & (times * F.col("n") <= F.col("m"))).select("id", "other", "held").distinct()
    x, y = e.alias("x"), e.alias("y")
    apart = (F.col("x.id") == F.col("y.id")) & (F.col("x.other") < F.col("y.other")) & ~F.arrays_overlap("x.held", "y.held")
    return x.join(y, apart, "left_semi").select("id").distinct()


def contaminants(signature: str, nchains: str, times: int = 20) -> Callable[[DataFrame], DataFrame]:
    """Rule: cells of a two-chain signature that others sharing one of its chains outnumber `times` over, by sums by chain less the own share."""

    def rule(cells: DataFrame) -> DataFrame:
        two = cells.select(F.col(signature).alias("signature"), F.col(nchains).alias("k")).where("k = 2")
        g = two.groupBy("signature").agg(F.count("*").alias("n"))
        c = g.select("signature", "n", F.explode(F.array_distinct(F.split("signature", " "))).alias("chain"))
        t = c.join(c.groupBy("chain").agg(F.sum("n").alias("all")), "chain").groupBy("signature").agg(F.min("n").alias("n"), F.sum(F.col("all") - F.col("n")).alias("others"))
        bad = t.where((F.col("others") > 0) & (F.col("others") >= times * F.col("n"))).select(F.col("signature").alias(signature))
        return cells.where(F.col(nchains) == 2).join(bad, signature, "left_semi")

    return rule


def cross(chains: DataFrame, sizes: DataFrame, sequence: str = "part", dataset: str = "dataset", limit: float = 1e-6, least_umis: int = 100) -> DataFrame:
    """Cells whose sequence occurs in one dataset only although its frequency n makes that unlikely: share of cells ** n <= limit.

    sizes: (dataset, cells). Sequences with `least_umis` UMIs or more in a cell are spared.
    """
    total = sizes.agg(F.sum("cells").alias("all_cells"))
    by = chains.groupBy(sequence).agg(F.count("*").alias("n"), F.min(dataset).alias("lo"), F.max(dataset).alias("hi")).where("lo = hi")
    odd = by.join(sizes.withColumnRenamed(dataset, "lo"), "lo").crossJoin(total).where(F.pow(F.col("cells") / F.col("all_cells"), F.col("n")) <= limit)  # one-row side
    return chains.join(odd.select(sequence), sequence, "left_semi").where(F.col("umi") < least_umis).select("cell")


def foursies(members: DataFrame, pairs: DataFrame, least: int = 10) -> DataFrame:
    """Cells of four chains with a heavy-light pair that is a two-chain signature of at least `least` cells; pairs: (cell, pair, nchains)."""
    common = pairs.where("nchains = 2").groupBy("pair").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("pair")
    return pairs.where("nchains = 4").join(common, "pair", "left_semi").select("cell").distinct()


def low_umis(cells: DataFrame, baseline: DataFrame, group: str, dataset: str, total: str) -> DataFrame:
    """Cells under their dataset's UMI baseline, in groups where so many aren't chance; the best cell of a wholly bad group stays.

    baseline: (dataset, umin). A group's k low cells of n go if P(Binomial(n, 0.1) >= k) < 0.01.
    """
    marked = cells.join(baseline, dataset, "left").withColumn("low", F.coalesce(F.col(total) < F.col("umin"), F.lit(False)))
    n = marked.groupBy(group).agg(F.count("*").alias("n"), F.count_if("low").alias("k")).where("n >= 2 AND k > 0")
    n = n.where(binomial_tail(F.col("k"), F.col("n"), 0.1) < 0.01)
    bad = marked.where("low").join(n, group)
    # the best cell, of equals the one with the least id, stays where every cell would go; an aggregate, so a hot group isn't one task's work
    best = bad.where("k = n").groupBy(group).agg(F.min_by("cell", F.struct((-F.col(total)).alias("t"), "cell")).alias("cell"))
    return bad.select("cell").join(best.select("cell"), "cell", "left_anti")


def baseline(cells: DataFrame, dataset: str, total: str, least: int = 20) -> DataFrame:
    """(dataset, umin): min(10th percentile, median - 4 * sqrt(median)) of cells that stand alone, from `least` of them on."""
    p = cells.groupBy(dataset).agg(F.count("*").alias("n"), F.percentile(total, 0.1).alias("p10"), F.median(total).alias("p50")).where(F.col("n") >= least)
    return p.select(dataset, F.least("p10", F.col("p50") - 4 * F.sqrt("p50")).alias("umin"))


@dataclass(frozen=True)
class Limits:
    """Numbers of the default filters; the defaults are the published ones."""

    contigs: int = 4
    cross: float = 1e-6
    cross_umis: int = 100
    junk: float = 10.0
    foursie_cells: int = 10
    weak_onesies: float = 0.001
    baseline_cells: int = 20
    umi_ratio: float = 500.0
    doublet: int = 5
    signature: int = 20
    merge_onesies: float = 0.0001
    weak_chain_cells: int = 20
    weak_chain_times: int = 8
    quality: int = 2


def exploded(cells: DataFrame) -> DataFrame:
    """(cell, dataset, clonotype, exact, part, umi): a row a chain of cells (default_filters())."""
    return cells.select("cell", "dataset", "clonotype", "exact", F.explode("parts").alias("p")).select("cell", "dataset", "clonotype", "exact", F.col("p.key").alias("part"), F.col("p.umi").alias("umi"))


def junk(cells: DataFrame, times: float) -> DataFrame:
    """(cell): those that share the first or last eight letters of their barcode with a cell of the dataset that has `times` their UMIs."""
    x = cells.select("cell", "dataset", "umi", F.substring("barcode", 1, 8).alias("first"), F.right("barcode", F.lit(8)).alias("last"))
    for half in ("first", "last"):
        x = x.join(x.groupBy("dataset", half).agg(F.max("umi").alias(f"top_{half}")), ["dataset", half], "left")
    top = F.greatest("top_first", "top_last")
    return x.where((top >= times * F.col("umi")) & (top > F.col("umi"))).select("cell")


def _foursie(cells: DataFrame, least: int) -> DataFrame:
    side = lambda c: F.transform(F.filter("parts", lambda p: p["key"].startswith(c)), lambda p: p["key"])
    p = cells.select("cell", "nchains", F.explode(side("H")).alias("h"), side("L").alias("l")).select("cell", "nchains", "h", F.explode("l").alias("l"))
    return foursies(cells, p.select("cell", F.concat_ws("|", "h", "l").alias("pair"), "nchains").distinct(), least)


def weak_chains(cells: DataFrame, most: int, times: int) -> DataFrame:
    """(cell): those that have a chain which, in a clonotype of three or more, few of its cells have."""
    c = exploded(cells).select("cell", "clonotype", "part").distinct()
    kinds = c.groupBy("clonotype", "part").agg(F.count("*").alias("support"))
    three = kinds.groupBy("clonotype").agg(F.count("*").alias("chains")).where("chains >= 3").select("clonotype")
    total = cells.groupBy("clonotype").agg(F.count("*").alias("total"))
    weak = kinds.join(three, "clonotype", "left_semi").join(total, "clonotype").where((F.col("support") <= most) & (times * F.col("support") < F.col("total")))
    return c.join(weak.select("clonotype", "part"), ["clonotype", "part"], "left_semi").select("cell").distinct()


def reformed(cells: DataFrame) -> DataFrame:
    """(cell, clonotype): clonotypes that fell apart, anew as what shared chains still hold together: the old name and the least exact signature."""
    c = exploded(cells).select("clonotype", "exact", "part").distinct()
    node = lambda e: F.concat_ws("|", "clonotype", e)
    low = c.groupBy("clonotype", "part").agg(F.min("exact").alias("low"))
    edges = c.join(low, ["clonotype", "part"]).select(node("low").alias("src"), node("exact").alias("dst"))
    root = connected_components(edges)
    return cells.select("cell", node("exact").alias("own")).join(root, F.col("own") == F.col("node"), "left").select("cell", F.coalesce("root", "own").alias("clonotype"))


def _onesies(cells: DataFrame) -> DataFrame:
    return cells.where("nchains = 1").groupBy("exact").agg(F.count("*").alias("n"), F.min(F.col("parts")[0]["key"]).alias("part"))


def _split_onesies(cells: DataFrame, share: float) -> DataFrame:
    total = cells.agg(F.count("*").alias("total"))  # one row
    weak = _onesies(cells).where(F.col("part").startswith("L")).crossJoin(F.broadcast(total)).where(F.col("n") < share * F.col("total")).select("exact")
    return cells.where("nchains = 1").join(weak, "exact", "left_semi").select("cell", F.concat_ws("#", "clonotype", "cell").alias("clonotype"))


def _merged_onesies(cells: DataFrame, share: float) -> DataFrame:
    total = cells.agg(F.count("*").alias("total"))  # one row
    common = _onesies(cells).crossJoin(F.broadcast(total)).where(F.col("n") >= share * F.col("total")).select("exact", "part")
    into = exploded(cells.where("nchains > 1")).groupBy("part").agg(F.min("clonotype").alias("into"))
    return cells.where("nchains = 1").join(common, "exact").join(into, "part").select("cell", F.col("into").alias("clonotype"))


def default_filters(called: DataFrame, limits: Limits = Limits()) -> list[Step | Regroup]:
    """The sixteen default filters with a published rule, in their order; each has a switch of its own.

    They work on cells (cell, dataset, barcode, called, umi, top, nchains, parts, exact, clonotype): parts
    an array of (key, umi), keys of heavy chains begin with H, of light ones with L; exact names the set
    of keys; umi is the cell's total, top its best chain; called says whether it is a cell at all. `called`,
    the table, has the cells that expression data show. Graph filtering has no published rule.
    """
    n, sides = limits, F.size(F.array_distinct(F.transform("parts", lambda p: F.substring(p["key"], 1, 1))))

    def umi(cells: DataFrame) -> DataFrame:
        alone = cells.where("nchains = 2").join(cells.groupBy("clonotype").agg(F.count("*").alias("size")).where("size = 1").select("clonotype"), "clonotype", "left_semi")
        return low_umis(cells, baseline(alone, "dataset", "umi", n.baseline_cells), "clonotype", "dataset", "umi")

    def doublet(cells: DataFrame) -> DataFrame:
        pure = cells.groupBy(F.concat_ws("|", "clonotype", "exact").alias("id")).agg(F.count("*").alias("n"), F.first(F.transform("parts", lambda p: p["key"])).alias("keys"))
        return cells.join(doublets(pure, n.doublet), F.concat_ws("|", "clonotype", "exact") == F.col("id"), "left_semi")

    return [
        Step("CELL", "NCELL", "NOT called"),
        Step("MAX_CONTIGS", "NMAX", f"nchains > {n.contigs}"),
        Step("CROSS", "NCROSS", lambda c: cross(exploded(c), c.groupBy("dataset").agg(F.count("*").alias("cells")), limit=n.cross, least_umis=n.cross_umis)),
        Step("BC_DUP", "NBC_DUP", duplicated(["exact", "barcode"])),
        Step("WHITEF", "NWHITEF", lambda c: junk(c, n.junk)),
        Step("FOURSIE", "NFOURSIE_KILL", lambda c: _foursie(c, n.foursie_cells)),
        Step("IMPROPER", "NIMPROPER", lambda c: c.where((F.col("nchains") > 1) & (sides == 1))),
        Regroup("WEAK_ONESIES", "NWEAK_ONESIES", "clonotype", lambda c: _split_onesies(c, n.weak_onesies)),
        Step("UMI", "NUMI", umi),
        Step("UMI_RATIO", "NUMI_RATIO", outdone("clonotype", "top", "umi", n.umi_ratio)),
        Step("GEX", "NGEX", lambda c: c.join(called.select("cell"), "cell", "left_anti")),
        Step("DOUBLET", "NDOUBLET", doublet),
        Regroup("DOUBLET_REFORM", "NDOUBLET", "clonotype", reformed),
        Step("SIGNATURE", "NSIG", contaminants("exact", "nchains", n.signature)),
        Regroup("MERGE_ONESIES", "NMERGE_ONESIES", "clonotype", lambda c: _merged_onesies(c, n.merge_onesies)),
        Step("WEAK_CHAINS", "NWEAK_CHAINS", lambda c: weak_chains(c, n.weak_chain_cells, n.weak_chain_times)),
        Regroup("WEAK_CHAINS_REFORM", "NWEAK_CHAINS", "clonotype", reformed),
        Step("QUAL", "NQUAL", f"top < {n.quality}"),
    ]
