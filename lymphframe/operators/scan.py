"""Feature scan: features whose mean count differs between two sets of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def feature_scan(counts: DataFrame, cells: DataFrame, test: Column, control: Column, keep: Column) -> DataFrame:
    """(feature, test_mean, control_mean, enrichment) of features for which `keep`, over both means, holds.

    counts: (cell, feature, count), absent pairs being zero; cells: all cells of the matrix; test and
    control: conditions on a cell. Raises if either set is empty.
    """
    n = cells.agg(F.count_if(test).alias("t"), F.count_if(control).alias("c")).first()
    if not n.t or not n.c:
        raise ValueError("no test cells" if not n.t else "no control cells")
    total = lambda cond: F.sum(F.when(cond, F.col("count")).otherwise(0)).cast("double")
    out = counts.groupBy("feature").agg((total(test) / n.t).alias("test_mean"), (total(control) / n.c).alias("control_mean"))
    return out.where(keep).withColumn("enrichment", F.try_divide("test_mean", "control_mean"))
