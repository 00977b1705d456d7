"""SimHash near-dedup: fingerprints of word shingles, linked by a binary trie self-join.

A fingerprint pair within the Hamming budget of 3 agrees on at least one of four 16-bit blocks,
so each distinct fingerprint is dealt to four buckets (block, value) and a bucket is joined with
itself by walking pairs of trie nodes downwards together, adding up differing bits and dropping a
pair as soon as it exceeds the budget. A bucket above HOT rows is dealt once more, by a block of
12 of its remaining 48 bits, on which such a pair agrees as well. A task returns a spanning forest
of the links it found, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import LOWER, arrow_map, fresh
from lymphframe.operators.components import connected_components
from lymphframe.session import stage, table

BITS, BUDGET, SHINGLE, SEED = 64, 3, 3, 42
#: Rows of a bucket above which it is dealt anew; rows that a task joins at a time; node pairs held at a time.
HOT, CHUNK, FRONTIER = 100_000, 200_000, 1_000_000
LEAF = 16


def fingerprint(text: str | None) -> int:
    """Unsigned 64-bit SimHash of 3-word shingles; 0 for a text without words or a null one."""
    w = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not w:
        return 0
    if len(w) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(w), SEED)
    h64, sums, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(w) - SHINGLE + 1
    for at in range(0, n, 8192):
        part = w[at : at + 8192 + SHINGLE - 1]
        h = np.array([h64(b"%b %b %b" % t, SEED) for t in zip(part, part[1:], part[2:])], np.dtype("<u8"))
        sums += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(sums * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", *also: Column) -> DataFrame:
    """(id, fp, also...): one row a row, fp the fingerprint's bits as a signed long; also: named columns to carry along."""

    def start():
        return lambda c: [c[0], [(x := fingerprint(t)) - ((x >> 63) << 64) for t in c[1]], *c[2:]]

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *also)
    more = "".join(f", {f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return arrow_map(source, start, f"id {source.schema['id'].dataType.simpleString()}, fp long{more}")


def trie_links(group: np.ndarray, fp: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of one spanning forest of the links within each group; input sorted by group, then fp (unsigned).

    Nodes are ranges of the sorted array: [lo, hi) holds the fingerprints of one prefix.
    """
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    edges = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[edges[1:], n]
    keep = ends - edges > 1
    lo, hi = edges[keep], ends[keep]
    work = [(BITS - 1, lo, hi, lo, hi, np.zeros(len(lo), np.int8))]
    ones: dict[int, np.ndarray] = {}
    while work:
        bit, lo1, hi1, lo2, hi2, err = work.pop()
        if not len(lo1):
            continue
        if len(lo1) > FRONTIER:
            half = len(lo1) // 2
            work += [(bit, *(x[:half] for x in (lo1, hi1, lo2, hi2, err))), (bit, *(x[half:] for x in (lo1, hi1, lo2, hi2, err)))]
            continue
        size = (hi1 - lo1) * (hi2 - lo2)
        small = (size <= LEAF) | (bit < 0)
        if small.any():
            _leaves(label, fp, lo1[small], hi1[small], lo2[small], hi2[small], budget)
            lo1, hi1, lo2, hi2, err = (x[~small] for x in (lo1, hi1, lo2, hi2, err))
            if not len(lo1):
                continue
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((fp >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        c = ones[bit]
        mid1, mid2 = hi1 - (c[hi1] - c[lo1]), hi2 - (c[hi2] - c[lo2])
        own = lo1 == lo2
        parts = [(lo1, mid1, lo2, mid2, err), (mid1, hi1, mid2, hi2, err), (lo1, mid1, mid2, hi2, err + 1)]
        other = ~own
        parts.append((mid1[other], hi1[other], lo2[other], mid2[other], err[other] + 1))
        a, b, x, y, e = (np.concatenate(p) for p in zip(*parts))
        alive = (b > a) & (y > x) & (e <= budget) & ~((a == x) & (b - a < 2))
        work.append((bit - 1, a[alive], b[alive], x[alive], y[alive], e[alive]))
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def _leaves(label: np.ndarray, fp: np.ndarray, lo1: np.ndarray, hi1: np.ndarray, lo2: np.ndarray, hi2: np.ndarray, budget: int) -> None:
    """Compare what small node pairs hold and merge the labels of what is linked, in place."""
    size = (hi1 - lo1) * (hi2 - lo2)
    for at in range(0, len(size), 100_000):
        s = slice(at, at + 100_000)
        pair = np.repeat(np.arange(len(size))[s], size[s])
        k = np.arange(len(pair)) - np.repeat(np.cumsum(size[s]) - size[s], size[s])
        wide = (hi2 - lo2)[pair]
        i, j = lo1[pair] + k // wide, lo2[pair] + k % wide
        near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]) <= budget)
        _merge(label, i[near], j[near])


def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    while len(i):
        a, b = label[i], label[j]
        i, j, a, b = (x[a != b] for x in (i, j, a, b))
        if not len(i):
            return
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _join_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("src", pa.int64()), ("dst", pa.int64())])

    def links(g: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        u = fp.view(np.uint64)
        order = np.lexsort((u, g))
        g, u = g[order], u[order]
        child, parent = trie_links(g, u)
        return pa.RecordBatch.from_arrays([pa.array(u[child].view(np.int64)), pa.array(u[parent].view(np.int64))], schema=schema)

    held_g, held_fp = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        held_g = np.r_[held_g, b.column(0).to_numpy()]
        held_fp = np.r_[held_fp, b.column(1).to_numpy()]
        if len(held_g) >= CHUNK:
            cut = np.searchsorted(held_g, held_g[-1])  # sorted by bucket: the last one may go on
            if cut:
                yield links(held_g[:cut], held_fp[:cut])
                held_g, held_fp = held_g[cut:].copy(), held_fp[cut:].copy()
    if len(held_g):
        yield links(held_g, held_fp)


def links(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(src, dst): a spanning forest, bucket by bucket, of all pairs of fingerprints within the budget."""
    block = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.shiftrightunsigned("fp", 16 * t).bitwiseAND(0xFFFF).alias("k")) for t in range(4)]))
    dealt = distinct.select("fp", block.alias("b")).select("fp", (F.col("b.t") * 65536 + F.col("b.k")).alias("g"))
    # at most 4 * 65536 buckets exist, so the list of hot ones has a proven bound
    heavy = F.broadcast(dealt.groupBy("g").count().where(F.col("count") > hot).select("g", F.lit(True).alias("heavy")))
    # the other 48 bits of a hot bucket, as four blocks of 12
    rest = F.col("fp").bitwiseAND(F.lit(-1))
    t = F.floor(F.col("g") / 65536).cast("int")
    low = [F.when(t > b, F.shiftrightunsigned(rest, 16 * b)).otherwise(F.shiftrightunsigned(rest, 16 * b + 16)).bitwiseAND(0xFFFF) for b in range(3)]
    r48 = low[0] + F.shiftleft(low[1].cast("long"), 16) + F.shiftleft(low[2].cast("long"), 32)
    finer = F.array(*[F.shiftrightunsigned(r48, 12 * s).bitwiseAND(0xFFF) + s * 4096 + 1 for s in range(4)])
    dealt = dealt.join(heavy, "g", "left").select("fp", F.explode(F.when(F.col("heavy"), finer).otherwise(F.array(F.lit(0).cast("long")))).alias("s"), "g")
    dealt = dealt.select((F.col("g").cast("long") * 32768 + F.col("s")).alias("g"), "fp").repartition(F.col("g")).sortWithinPartitions("g")
    return dealt.mapInArrow(_join_task, "src long, dst long")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(id, fingerprint, component_id): one row a row of documents.

    Documents whose fingerprints differ in at most 3 bits are linked; component_id is the least id
    reachable over links. Null and wordless texts have fingerprint zero and are linked like others;
    rows with a null id take part in linking, but give no component id unless all ids are null;
    repeated rows stay. Other columns of the input are not read.
    """
    fps = stage(fingerprints(documents, id_col, text_col), "fingerprints")
    root = rooted(fps.groupBy("fp").agg(F.min("id").alias("least")), hot)
    # a root's members arrive pre-aggregated; a group of one fingerprint needs no second join
    name = root.groupBy("root").agg(F.min("least").alias("component_id"))
    member = root.join(name, "root").select("fp", "component_id")
    out = fps.join(member, "fp")
    return out.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def rooted(distinct: DataFrame, hot: int = HOT) -> DataFrame:
    """(fp, least, root) for distinct fingerprints: root is the least fingerprint reachable over links."""
    found = connected_components(links(distinct.select("fp"), hot))
    return distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The same columns, one row of each group of near-duplicates: that of the least id, rows without an id coming last.

    A row is named by two hashes of id and text, so rows that share an id but belong to different
    groups each have their own fate. Of rows that repeat both, the one of the least hash of all its
    columns stays, the same on every run.
    """
    names = documents.columns
    a, b, form = fresh(names, "first", "second", "row")
    mark = lambda seed: F.xxhash64(F.lit(seed), F.col(id_col).isNull(), id_col, F.col(text_col).isNull(), text_col)
    fps = stage(fingerprints(documents, id_col, text_col, mark(1).alias("a"), mark(2).alias("b")), "fingerprints")
    root = rooted(fps.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("no"), "id", "a", "b")).alias("least")), hot)
    keeper = root.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.a").alias(a), F.col("least.b").alias(b))
    kept = documents.withColumns({a: mark(1), b: mark(2)}).join(keeper, [a, b], "left_semi")
    # dealt by the same two columns as the join, so no further shuffle
    whole = F.xxhash64(*[F.to_json(F.struct(c)) if "map<" in t else F.col(c) for c, t in documents.dtypes])
    return kept.groupBy(a, b).agg(F.min_by(F.struct(*names), whole).alias(form)).select(f"{form}.*")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
