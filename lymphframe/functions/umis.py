"""Variables of a contig's UMI lists and qualities, and statistics over validated UMIs and marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What the variables' names say of the three lists.
LISTS = {"val": "validated_umis", "nval": "non_validated_umis", "ival": "invalidated_umis"}
#: The variables by what they show of a list.
COUNTS = {"nval": "val", "nnval": "nval", "nival": "ival"}
VARIABLES = [*COUNTS, *(f"{k}{s}" for s in ("umis", "bcumis") for k in LISTS)]


def umi_variable(name: str, columns: dict[str, Column] | None = None) -> Column:
    """One of VARIABLES for a contig with the three lists and its barcode: a number of UMIs, the UMIs, or the UMIs after the barcode's letters, joined by commas.

    A list that is null counts as empty. columns: other columns by the names of LISTS and 'barcode'.
    """
    col = lambda c: (columns or {}).get(c, F.col(c))
    if name not in VARIABLES:
        raise ValueError(f"no variable of UMIs: {name}")
    kind = COUNTS.get(name) or name.removesuffix("umis").removesuffix("bc")
    umis = F.coalesce(col(LISTS[kind]), F.array().cast("array<string>"))
    if name in COUNTS:
        return F.size(umis).cast("long")
    head = F.substring_index(col("barcode"), "-", 1)
    return F.array_join(F.transform(umis, lambda u: F.concat(head, u)) if name.endswith("bcumis") else umis, ",")


def quality_at(quals: Column, at: int) -> Column:
    """The quality of the base at a place from 0, from letters that stand for it plus 33; null past the end."""
    if at < 0:
        raise ValueError("places begin at 0")
    letter = F.substr(quals, F.lit(at + 1), F.lit(1))
    return F.when(letter != "", F.ascii(letter) - 33)


def _percent(a: Column, b: Column) -> Column:
    return F.try_divide(100.0 * a, b)


def validated_statistics(chains: DataFrame) -> DataFrame:
    """One row: medians of validated UMIs of heavy and light chains, their percentages of all UMIs, and the percentage of two-chain cells with some in both.

    chains: (cell, heavy, umi, validated_umis). If a chain has no such list, or one kind of chain doesn't
    occur, there is no row; without a two-chain cell the last figure is null. Medians come from counts
    by value, so no kind of chain is one task's work.
    """
    x = chains.select("cell", "heavy", "umi", F.size("validated_umis").alias("n"), F.col("validated_umis").isNull().alias("missing"))
    kinds = x.groupBy("heavy", "n").agg(F.count("*").alias("k"), F.sum("umi").alias("umi"), F.max("missing").alias("missing"))
    side = kinds.groupBy("heavy").agg(F.percentile("n", 0.5, F.col("k")).alias("median"), _percent(F.sum(F.col("n") * F.col("k")), F.sum("umi")).alias("percent"), F.max("missing").alias("missing"))
    of = lambda heavy, c: F.max(F.when(F.col("heavy") == heavy, F.col(c)))
    sides = side.agg(of(True, "median").alias("heavy_median"), of(True, "percent").alias("heavy_percent"), of(False, "median").alias("light_median"), of(False, "percent").alias("light_percent"), F.max("missing").alias("missing"))
    two = x.groupBy("cell").agg(F.count("*").alias("chains"), F.min("n").alias("least")).where("chains = 2")
    both = two.agg(_percent(F.count_if(F.col("least") > 0), F.count("*")).alias("both_percent"))
    return sides.crossJoin(F.broadcast(both)).where("NOT missing AND heavy_median IS NOT NULL AND light_median IS NOT NULL").drop("missing")  # one row each


def marking_statistics(cells: DataFrame) -> DataFrame:
    """One row of counts of cells (clonotype, dataset, nchains, marked, b): dubious, marked, marked_good, fake, fake_marked, residual, good, good_marked.

    b: called a B cell. A clonotype is of one dataset if that has ten times the cells of the next; it is
    fake if it has ten cells or more besides, and one of its cells may be real. Dubious are cells of the
    own dataset of such a clonotype, and cells that aren't B cells, in clonotypes of two cells or more.
    Good are B cells of two or three chains in clonotypes of ten cells or more that aren't fake, and one
    cell of each fake one; marked ones of them are good marks, if the clonotype has several datasets.
    Nulls in marked and b count as false. Cells are counted by clonotype and dataset first.
    """
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    fine = yes("b") & F.col("nchains").between(2, 3)
    x = cells.groupBy("clonotype", "dataset").agg(F.count("*").alias("c"), F.count_if(yes("marked")).alias("m"), F.count_if(~yes("b")).alias("other"), F.count_if(fine).alias("g"), F.count_if(fine & yes("marked")).alias("gm"))
    sums = (F.sum(c).alias(c) for c in ("m", "other", "g", "gm"))
    k = x.groupBy("clonotype").agg(F.sum("c").alias("n"), F.reverse(F.array_sort(F.collect_list("c"))).alias("counts"), F.max(F.struct("c", "other")).alias("top"), *sums)  # a count a dataset
    alone = (F.size("counts") == 1) | (F.col("counts")[0] >= 10 * F.get("counts", F.lit(1)))
    k = k.withColumn("alone", alone).withColumn("fake", F.col("alone") & (F.col("n") >= 10))
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0))
    fake, real = F.col("fake"), ~F.col("fake") & (F.col("n") >= 10)
    dubious = F.col("other") + F.when(F.col("alone"), F.col("top.c") - F.col("top.other")).otherwise(0)
    marks = F.col("m") - (F.col("m") == F.col("n")).cast("long")
    out = k.agg(
        total(F.col("n") >= 2, dubious).alias("dubious"), total(F.lit(True), F.col("m")).alias("marked"), total(F.size("counts") >= 2, F.col("gm")).alias("marked_good"), total(fake, F.col("n") - 1).alias("fake"),
        total(fake, marks).alias("fake_marked"), (total(real, F.col("g")) + F.count_if(fake)).alias("good"), total(real, F.col("gm")).alias("good_marked"),
    )
    return out.withColumn("residual", F.col("fake") - F.col("fake_marked"))
