"""What the corpus operators share: row-wise Arrow maps, word rules, folds and label samples."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from lymphframe.session import stage

#: ASCII lower-casing of UTF-8 bytes; other letters stay as they are.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def arrow_map(df: DataFrame, start: Callable[[], Callable[[list[list]], list[list]]], schema: str | StructType) -> DataFrame:
    """Map columns to columns, batch by batch; start() runs once a task and gives the function of a batch.

    The function gets one Python list a column and returns one a column of the schema, of any length.
    """
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(kind)
        f = start()
        for b in batches:
            for part in slices(b):
                columns = f([c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, kind)


def slices(b: pa.RecordBatch, rows: int = 512, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most so many rows and, but for single rows, about so many bytes."""
    at = 0
    while at < b.num_rows:
        part = b.slice(at, rows)
        while part.num_rows > 1 and part.nbytes > size:
            part = part.slice(0, part.num_rows // 2)
        yield part
        at += part.num_rows


def fresh(taken: list[str], *wanted: str) -> list[str]:
    """Column names like the wanted ones that the input lacks, whatever the case of its letters."""
    low, out = {c.lower() for c in taken}, []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def words(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than space, tab, line feed, vertical tab, form feed and carriage return."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def held_out(doc_id: str, divisor: int, remainder: int):
    """Column: crc32 of the id as text, modulo divisor, is the remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % divisor == remainder, F.lit(False))


def label_sample(labels: DataFrame, label: str, bound: int, divisor: int = 0, remainder: int = 0) -> DataFrame:
    """(id, y): at most `bound` labelled ids outside the held-out fold (all, if divisor is 0).

    The sample is taken in order of a hash of the id, so it is the same on every run and never
    larger than the bound, however large the tables; labels other than 0 and 1 and ids with several
    different labels are left out.
    """
    y = labels.select(F.col("doc_id").alias("id"), F.col(label).alias("y")).where(F.col("y").isin(0, 1) & F.col("id").isNotNull())
    if divisor:
        y = y.where(~held_out("id", divisor, remainder))
    y = y.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    return y.orderBy(F.xxhash64("id"), "id").limit(bound)


#: UTF-8 bytes of labelled texts that are learned from, at most: they reach the driver.
LEARN_BYTES = 1 << 27


def labelled(documents: DataFrame, labels: DataFrame, label: str, bound: int, divisor: int, remainder: int, most_bytes: int = LEARN_BYTES) -> DataFrame:
    """(id, text, y): the whole texts of label_sample(); of several rows with one id, the least text.

    Texts are taken in order of a hash of their id until they hold `most_bytes`; a text that doesn't
    fit any more is left out of learning, not cut. So both rows and bytes have a bound.
    """
    y = label_sample(labels, label, bound, divisor, remainder)
    d = documents.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    # y has a proven bound: `bound` rows of two numbers
    rows = stage(d.join(F.broadcast(y), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y")), "labelled")
    left, out = most_bytes, []
    for r in sorted(rows.select(F.xxhash64("id").alias("h"), "id", F.octet_length("text").alias("n")).collect()):
        if r.n <= left:
            left -= r.n
        else:
            out.append(r.id)
    return rows.where(~F.col("id").isin(out)) if out else rows


def sigmoid(x):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF
