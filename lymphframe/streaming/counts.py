"""An extension: incremental counts over a stream, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, keys..., n) of a stream or a table: tumbling windows; a stream drops what is later than the watermark."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    return e.groupBy(F.window(time, width).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


def running_signatures(chains: DataFrame, cell: str, value: str) -> DataFrame:
    """(cell, signature, n) as chains arrive: the sorted values of each cell so far (complete or update mode)."""
    return chains.groupBy(cell).agg(F.array_join(F.sort_array(F.collect_list(value)), " ").alias("signature"), F.count("*").alias("n"))
