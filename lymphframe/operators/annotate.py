"""Annotation of sequences: where reference segments lie in them.

Words of the reference are an index that the sequences' words are joined with; common words of a
sequence and a segment are added up by diagonal in the shuffle, so that what goes on is a row a pair
and diagonal. The diagonals of a pair are chained, and pairs with words enough are aligned by affine
gaps within the chain's band, many pairs at once, row by row of the segments. Of each kind of segment
the best that stands in order is kept.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lymphframe.session import stage


@dataclass(frozen=True)
class Search:
    """Letters of a word; words that a pair needs; how far diagonals may part, and how far the band reaches beyond them; scores."""

    word: int = 10
    least_words: int = 3
    drift: int = 12
    margin: int = 8
    match: int = 1
    mismatch: int = -2
    gap_open: int = -6
    gap_extend: int = -1
    least_score: int = 12
    #: Letters by which segments in order may overlap.
    overlap: int = 10


#: Kinds of segments in the order in which they stand; those that a scan reports.
ORDER = ("U", "V", "D", "J", "C")
#: Words of a reference that are broadcast, at most; a larger index is joined by a shuffle.
BROADCAST_WORDS = 1 << 20
#: Cells of the bands that are aligned at once, at most.
ROOM = 1 << 22
NEVER = -(1 << 28)
ALIGNED = "score int, contig_start int, contig_end int, ref_start int, ref_end int, mismatches int, cigar string"


def reverse_complement(seq):
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def words(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(*keys, pos, word): the words of k letters of column seq; ones with other letters than ACGT are left out."""
    found = F.regexp_extract_all(F.upper("seq"), F.lit(rf"(?s)(?=(.{{{k}}}))."), F.lit(1))
    return rows.select(*keys, F.posexplode(found).alias("pos", "word")).where(~F.col("word").rlike("[^ACGT]"))


def diagonals(contigs: DataFrame, segments: DataFrame, how: Search = Search()) -> DataFrame:
    """(id, name, runs): for each pair with words enough in common, runs of (diag, n, low, high), diagonal, words and the segment's places they span."""
    ref = words(segments, ["name"], how.word).withColumnRenamed("pos", "at")
    if ref.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        ref = F.broadcast(ref)  # BROADCAST_WORDS rows of some thirty bytes at most
    hit = words(contigs, ["id"], how.word).join(ref, "word")
    run = hit.groupBy("id", "name", (F.col("pos") - F.col("at")).alias("diag")).agg(F.count("*").alias("n"), F.min("at").alias("low"), F.max("at").alias("high"))
    # a pair has no more diagonals than letters
    pair = run.groupBy("id", "name").agg(F.sum("n").alias("words"), F.sort_array(F.collect_list(F.struct("low", "diag", "n", "high"))).alias("runs"))
    return pair.where(F.col("words") >= how.least_words).select("id", "name", "runs")


def chained(runs: Sequence[tuple[int, int, int, int]], drift: int) -> tuple[int, int, int]:
    """(words, least, greatest diagonal) of the best chain of runs (low, diag, n, high), each further on in both sequences and within `drift` of the one before."""
    best: list[tuple[int, int, int]] = []
    for i, (low, diag, n, _) in enumerate(runs):
        own = (n, diag, diag)
        for j in range(i):
            before = runs[j]
            if before[0] < low and before[0] + before[1] < low + diag and abs(before[1] - diag) <= drift and best[j][0] + n > own[0]:
                own = (best[j][0] + n, min(best[j][1], diag), max(best[j][2], diag))
        best.append(own)
    return max(best, key=lambda b: (b[0], b[1]))


def extended(contigs: Sequence[str], refs: Sequence[str], bands: Sequence[tuple[int, int]], how: Search = Search()) -> list[tuple]:
    """The best local alignment of each pair within its band of diagonals: fields of ALIGNED, places from 0, ends exclusive."""
    out: list[tuple] = []
    at = 0
    while at < len(contigs):
        width = max(h - l + 1 for l, h in bands[at:])  # noqa: E741
        step = max(1, ROOM // (width * max(1, max(map(len, refs[at:]))) * 3))
        part = slice(at, at + step)
        out += _band(contigs[part], refs[part], bands[part], how)
        at += step
    return out


def _band(contigs: Sequence[str], refs: Sequence[str], bands: Sequence[tuple[int, int]], how: Search) -> list[tuple]:
    n, rows = len(refs), max(map(len, refs))
    low = np.array([l for l, _ in bands], np.int64)  # noqa: E741
    width = int(max(h - l for l, h in bands)) + 1  # noqa: E741
    size, length = np.array([len(c) for c in contigs]), np.array([len(r) for r in refs])
    letters = np.zeros((n, size.max(initial=0) + 1), np.uint8)
    ref = np.full((n, rows), 1, np.uint8)
    for k, (c, r) in enumerate(zip(contigs, refs)):
        letters[k, : len(c)] = np.frombuffer(c.encode("ascii", "replace"), np.uint8)
        ref[k, : len(r)] = np.frombuffer(r.encode("ascii", "replace"), np.uint8)
    wide = np.array([h - l for l, h in bands])[:, None] >= np.arange(width)  # noqa: E741
    place = np.arange(width, dtype=np.int64)
    m = np.full((rows + 1, n, width), NEVER, np.int32)
    d, i = m.copy(), m.copy()  # d: the reference has more; i: the contig has more
    for r in range(rows):
        at = low[:, None] + place + r  # the contig's place of each diagonal
        ok = wide & (at >= 0) & (at < size[:, None]) & (r < length)[:, None]
        same = letters[np.arange(n)[:, None], np.clip(at, 0, letters.shape[1] - 1)] == ref[:, r : r + 1]
        before = np.maximum(np.maximum(m[r], d[r]), np.maximum(i[r], 0))
        m[r + 1] = np.where(ok, before + np.where(same, how.match, how.mismatch), NEVER)
        # one letter of the reference alone moves to the diagonal below
        d[r + 1, :, :-1] = np.where(wide[:, 1:], np.maximum(np.maximum(m[r], i[r]) + how.gap_open, d[r] + how.gap_extend)[:, 1:], NEVER)
        # letters of the contig alone move up along the row
        start = np.maximum(m[r + 1], d[r + 1]).astype(np.int64) + how.gap_open - how.gap_extend * (place + 1)
        i[r + 1, :, 1:] = np.where(wide[:, 1:], np.maximum.accumulate(start, axis=1)[:, :-1] + how.gap_extend * place[1:], NEVER)
    found = []
    for k in range(n):
        flat = int(m[:, k].argmax())
        found.append(_trace(m, d, i, k, *divmod(flat, width), int(low[k]), contigs[k], refs[k], how))
    return found


def _trace(m, d, i, k: int, r: int, w: int, low: int, contig: str, ref: str, how: Search) -> tuple:
    score, ops, wrong = int(m[r, k, w]), [], 0
    if score <= 0:
        return 0, 0, 0, 0, 0, 0, f"{len(contig)}S" if contig else ""
    ref_end, end = r, low + w + r
    state = "M"
    while True:
        if state == "M":
            same = contig[low + w + r - 1] == ref[r - 1]
            left = int(m[r, k, w]) - (how.match if same else how.mismatch)
            ops.append("M")
            wrong += not same
            r -= 1
            state = "" if left == 0 else next(s for s, t in (("M", m), ("D", d), ("I", i)) if t[r, k, w] == left)
        elif state == "D":
            now = int(d[r, k, w])
            ops.append("D")
            r, w = r - 1, w + 1
            state = "D" if d[r, k, w] + how.gap_extend == now else "M" if m[r, k, w] + how.gap_open == now else "I"
        else:
            now = int(i[r, k, w])
            ops.append("I")
            w -= 1
            state = "I" if i[r, k, w] + how.gap_extend == now else "M" if m[r, k, w] + how.gap_open == now else "D"
        if not state:
            break
    ops.reverse()
    start = low + w + r
    runs: list[list] = [[start, "S"]] if start else []
    for o in ops:
        if runs and runs[-1][1] == o:
            runs[-1][0] += 1
        else:
            runs.append([1, o])
    if end < len(contig):
        runs.append([len(contig) - end, "S"])
    return score, start, end, r, ref_end, wrong, "".join(f"{x}{o}" for x, o in runs)


def _aligner(how: Search):
    @F.pandas_udf(ALIGNED)
    def f(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ALIGNED.split(", ")]
        for contig, ref, runs in batches:
            bands = []
            for r in runs:
                _, low, high = chained([(x["low"], x["diag"], x["n"], x["high"]) for x in r], how.drift)
                bands.append((low - how.margin, high + how.margin))
            yield pd.DataFrame(extended(contig.tolist(), ref.tolist(), bands, how), columns=names)

    return f


def annotated(contigs: DataFrame, segments: DataFrame, how: Search = Search(), both_strands: bool = False) -> DataFrame:
    """(id, strand, kind, name, ALIGNED fields): the best segment of each kind that stands in order in each sequence.

    contigs: (id, seq), ids that are null or stand twice with other letters are not meant; segments:
    (name, kind, seq), kinds of ORDER. V comes first, of J and C the best that begins where the ones
    before have ended, `overlap` letters earlier at most; U ends where V begins. Ties go to the earlier
    name. Sequences without a hit give no row. With both_strands the strand of the higher sum of
    scores stays. Letters other than ACGT match nothing but themselves.
    """
    c = contigs.select("id", F.upper("seq").alias("seq")).where("seq IS NOT NULL")
    if both_strands:
        c = c.select("id", F.explode(F.array(F.struct(F.lit("+").alias("strand"), "seq"), F.struct(F.lit("-").alias("strand"), reverse_complement(F.col("seq")).alias("seq")))).alias("s")).select(F.struct("id", "s.strand").alias("id"), "s.seq")
    else:
        c = c.select(F.struct("id", F.lit("+").alias("strand")).alias("id"), "seq")
    s = segments.select("name", "kind", F.upper("seq").alias("ref"))
    pairs = diagonals(c, s.select("name", F.col("ref").alias("seq")), how).join(c, "id").join(s, "name")
    x = pairs.withColumn("a", _aligner(how)("seq", "ref", "runs")).select("id", "kind", "name", "a.*").where(F.col("score") >= how.least_score)
    x = stage(x, "aligned")  # read once a kind
    each = Window.partitionBy("id", "kind")  # no more rows than segments
    out, end = None, None
    for kind in ("V", "J", "C"):
        y = x.where(F.col("kind") == kind)
        if end is not None:
            y = y.join(end, "id", "left").where(F.col("contig_start") >= F.coalesce("after", F.lit(0)) - how.overlap).drop("after")
        top = _first(y, each)
        after = top.select("id", F.col("contig_end").alias("after"))
        end = after if end is None else end.union(after).groupBy("id").agg(F.max("after").alias("after"))
        out = top if out is None else out.unionByName(top)
    v = out.where("kind = 'V'").select("id", F.col("contig_start").alias("before"))
    u = x.where("kind = 'U'").join(v, "id").where(F.col("contig_end") <= F.col("before") + how.overlap).drop("before")
    out = out.unionByName(_first(u, each))
    rows = out.select("id.id", "id.strand", "kind", "name", *(c.split()[0] for c in ALIGNED.split(", ")))
    if not both_strands:
        return rows
    total = rows.groupBy("id", "strand").agg(F.sum("score").alias("sum"))
    keep = total.groupBy("id").agg(F.max_by("strand", F.struct("sum", (F.col("strand") == "+").alias("plus"))).alias("strand"))
    return rows.join(keep, ["id", "strand"], "left_semi")


def _first(x: DataFrame, each) -> DataFrame:
    return x.withColumn("place", F.row_number().over(each.orderBy(F.desc("score"), "mismatches", "name", "contig_start"))).where("place = 1").drop("place")
