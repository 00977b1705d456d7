"""Best-fit packing of tokenised documents by exact-complement hashing.

Only lengths matter for a plan, and there are at most `capacity` of them, so the plan is made from
the histogram of lengths: for each length the gap it leaves is looked up among single lengths, in an
index of sums of two, and among sums of three (one more length and the index), and as many of such
combinations are consumed as the counts of what is still available allow; what remains is packed best-fit decreasing, equal lengths at a time. A step uses
up a length or a group of bins, so the plan's size is bounded by the capacity and not by the corpus.
Each piece then finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import crc
from lymphframe.session import stage, table

CAPACITY, END = 2048, 0
VOCABULARY = "byte_bpe_50k.json"
#: The byte-level vocabulary's split of a text, and the bytes that stand for themselves in its file.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_encoders: dict = {}


def encoder(path: str):
    """text -> ids: byte-level BPE of a tokenizers file, added tokens in a text being those tokens.

    The file lists its pieces in order of merging, so ids are ranks; the ids equal those of the
    tokenizers library with the file as loaded, several times as fast. Added tokens that strip
    spaces or want whole words aren't known here and are refused.
    """
    if path not in _encoders:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        vocab, added = found["model"]["vocab"], found.get("added_tokens", [])
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError("added tokens must stand for themselves alone")
        letter = {chr(b): b for b in PLAIN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in PLAIN)}
        special = {a["content"]: a["id"] for a in added}
        ranks = {bytes(letter[c] for c in piece): i for piece, i in vocab.items() if piece not in special and all(c in letter for c in piece)}
        encoding = tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        _encoders[path] = lambda text: encoding.encode(text, allowed_special="all", disallowed_special=())
    return _encoders[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; a document that is too long has its shorter piece first."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class Pairs:
    """Available lengths by the sum of two: pairs (a, b), a <= b, of one sum lie side by side."""

    def __init__(self, counts: np.ndarray):
        have = np.flatnonzero(counts)
        have = have[have > 0]
        a, b = np.meshgrid(have, have, indexing="ij")
        keep = (a <= b) & (a + b < len(counts))
        self.a, self.b = a[keep], b[keep]
        order = np.argsort(self.a + self.b, kind="stable")
        self.a, self.b = self.a[order], self.b[order]
        self.first = np.searchsorted(self.a + self.b, np.arange(len(counts) + 1))

    def find(self, total: int, counts: np.ndarray, also: list[int]) -> list[int] | None:
        """The pair of this sum that most copies are left of, besides what `also` needs."""
        s = slice(self.first[total], self.first[total + 1])
        a, b = self.a[s], self.b[s]
        left = [counts[x] - sum((x == k).astype(np.int64) for k in also) for x in (a, b)]
        most = np.where(a == b, left[0] // 2, np.minimum(*left)) if len(a) else a
        k = int(np.argmax(most)) if len(a) else -1
        return [int(a[k]), int(b[k])] if k >= 0 and most[k] > 0 else None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(bins, [(length, copies a bin)])] for counts[length]; every piece is placed once.

    Filling every gap that can be filled may use up the short pieces that later gaps need, so plans
    with complements of up to three, two and one lengths are made; the one with the fewest bins
    wins, the first among equals.
    """
    best: list[tuple[int, list[tuple[int, int]]]] = []
    fewest, least = None, -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
    for depth in (3, 2, 1):
        found = _plan(counts, capacity, depth)
        bins = sum(b for b, _ in found)
        if fewest is None or bins < fewest:
            best, fewest = found, bins
        if fewest == least:
            break
    return best


def _plan(counts: np.ndarray, capacity: int, depth: int) -> list[tuple[int, list[tuple[int, int]]]]:
    c = counts.astype(np.int64).copy()
    index = Pairs(c) if depth > 1 else None
    out: list[tuple[int, list[tuple[int, int]]]] = []

    def use(parts: list[int]) -> bool:
        kinds = sorted(set(parts), reverse=True)
        bins = min(int(c[k]) // parts.count(k) for k in kinds)
        if bins:
            for k in kinds:
                c[k] -= bins * parts.count(k)
            out.append((bins, [(k, parts.count(k)) for k in kinds]))
        return bins > 0

    if c[capacity]:
        use([capacity])
    for length in range(capacity - 1, 0, -1):
        while c[length] and use([length, capacity - length]):
            pass
    for length in range(capacity - 1, 0, -1) if depth > 1 else ():
        while c[length] and (two := index.find(capacity - length, c, [length])) and use([length, *two]):
            pass
    have = np.zeros(0, bool)
    for length in range(capacity - 1, 0, -1) if depth > 2 else ():
        gap = capacity - length
        while c[length] and gap > 2:
            if not np.array_equal(have, now := c > 0):
                have, sums = now, np.convolve(now, now)[: capacity + 1] > 0.5  # sums of two that are still about
            thirds = np.flatnonzero(have[1 : gap - 1] & sums[gap - 1 : 1 : -1]) + 1
            if not any((two := index.find(gap - t, c, [length, t])) and use([length, t, *two]) for t in thirds[::-1].tolist() if c[t] > (t == length)):
                break
    # best-fit decreasing on what is left: groups of equal bins by the gap they have
    open_bins: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    for length in range(capacity - 1, 0, -1):
        k = int(c[length])
        for gap in sorted(g for g in open_bins if g >= length):
            groups = open_bins.pop(gap)
            while groups and k:
                bins, parts = groups.pop()
                fit = gap // length
                full = min(bins, k // fit)
                if full:
                    open_bins.setdefault(gap - fit * length, []).append((full, [*parts, (length, fit)]))
                    k -= full * fit
                    bins -= full
                if bins and 0 < k < fit:
                    open_bins.setdefault(gap - k * length, []).append((1, [*parts, (length, k)]))
                    k, bins = 0, bins - 1
                if bins:
                    groups.append((bins, parts))
            if groups:
                open_bins.setdefault(gap, []).extend(groups)
            if not k:
                break
        fit = capacity // length
        if k >= fit:
            open_bins.setdefault(capacity - fit * length, []).append((k // fit, [(length, fit)]))
        if k % fit:
            open_bins.setdefault(capacity - k % fit * length, []).append((1, [(length, k % fit)]))
    return out + [g for groups in open_bins.values() for g in groups]


def places(found: list[tuple[int, list[tuple[int, int]]]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, bins, first sequence, first offset) in order of rank."""
    used: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence = 0
    for bins, parts in found:
        offset = 0
        for length, copies in parts:
            rows.setdefault(length, []).append((used.get(length, 0), bins, sequence, offset))
            used[length] = used.get(length, 0) + bins * copies
            offset += length * copies
        sequence += bins
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pieces(documents: DataFrame, vocabulary: str | None, id_col: str, text_col: str, capacity: int) -> DataFrame:
    """(id, piece, start, length, ids_crc32, task, nth): nth counts the pieces of that length in the task before it.

    Each task ends with its tallies: a row a length it met, with a null piece and the count of such pieces in nth.
    """
    kind = documents.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "task", "nth"]
    types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary or vocabulary_path())
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                row, out = [], []
                for i, text in enumerate(b.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), END], np.dtype("<u4"))
                    for k, (s, n) in enumerate(cut(len(ids), capacity)):
                        row.append(i)
                        out.append((k, s, n, crc(ids[s : s + n].tobytes()), task, int(seen[n])))
                        seen[n] += 1
                columns = [pa.array(v, type=t) for v, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *columns], names=names)
        met = np.flatnonzero(seen)
        if len(met):
            none = [pa.nulls(len(met), t) for t in (b.column(0).type, *types)]
            yield pa.RecordBatch.from_arrays([*none[:3], pa.array(met), none[4], pa.array(np.full(len(met), task, np.int32)), pa.array(seen[met])], names=names)

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def firsts(tallies: DataFrame) -> DataFrame:
    """(of, by, base, total): the rank of the first piece of length `of` in task `by`; one row a length has its total, others null.

    Tallies of a length meet in one task, at most one row for each task that read documents.
    Running sums are made on arrays, as Spark's aggregates and windows take whole memory pages in
    every task, however few its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = [b for b in batches if b.num_rows]
        if met:
            t = pa.Table.from_batches(met).sort_by([("length", "ascending"), ("task", "ascending")])
            length, task, n = (t[c].to_numpy() for c in ("length", "task", "nth"))
            new = np.diff(length, prepend=-1) > 0
            at, before = np.flatnonzero(new), np.cumsum(n) - n
            base = before - np.repeat(before[at], np.diff(np.append(at, len(n))))
            total = np.zeros(len(n), np.int64)
            total[at] = np.add.reduceat(n, at)
            yield pa.RecordBatch.from_arrays([pa.array(length.astype(np.int32)), pa.array(task), pa.array(base), pa.array(total, mask=~new)], names=["of", "by", "base", "total"])

    return tallies.select("length", "task", "nth").repartition("length").mapInArrow(run, "of int, by int, base long, total long")


def pack(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset): one row a piece, each sequence gapless from 0.

    A null or empty text is one piece, the end id alone. Repeated rows are packed each on their own
    and null ids are kept; ties between pieces of one length are settled by where they were read.
    Other columns of the input are not read. vocabulary: path of a byte-level tokenizers file.
    """
    staged = stage(pieces(documents, vocabulary, id_col, text_col, capacity), "pieces")
    cuts, first = staged.where("piece is not null"), firsts(staged.where("piece is null"))
    # at most `capacity` rows, whatever the corpus
    counts = np.zeros(capacity + 1, np.int64)
    for r in first.where("total is not null").select("of", "total").collect():
        counts[r.of] = r.total
    where = places(plan(counts, capacity))
    # a hash join, as sorting both sides takes pages too; two ints make one key, and its table has at most `capacity` rows a task
    met = cuts.join(first.hint("shuffle_hash"), (F.col("length").cast("int") == F.col("of")) & (F.col("task") == F.col("by")))
    ranked = met.select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    # rows are few bytes: no more tasks and files than these make, and no fewer than there are cores
    ranked = ranked.coalesce(max(staged.rdd.getNumPartitions(), documents.sparkSession.sparkContext.defaultParallelism))
    kind = documents.schema[id_col].dataType.simpleString()

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), where[int(n)]
                row = rows[np.searchsorted(rows[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + k % row[:, 1], row[:, 3] + k // row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    out = ranked.mapInArrow(put, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
