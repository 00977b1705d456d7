"""Suffix-array dedup: remove every byte covered by a 200-byte string that starts elsewhere as well.

A suffix array over a whole corpus can't be built in one place, so equal strings are first brought
together. Each 200-byte window has a key that depends on its bytes alone, the least hash of its
64-byte substrings; consecutive windows of one key form a run. Only runs whose key occurs more than
once can hold a repeated window. Of these, each distinct run text is taken once, with the number of
its occurrences as weight, and dealt by key to shards. A shard's suffix array is built by
Larsson-Sadakane refinement, its common prefixes by Kasai's permuted rule, and suffixes that share
200 bytes form a class; a window is repeated if its class weighs two or more. A key whose texts
fill several shards is merged by binary search: the shards' classes, each sorted, are merged two by
two into one list, in which each shard then looks its own classes up. Keys with over HOT occurrences
are split by a second, finer key of longer substrings; pieces of such runs that are alike are merged
in the task that cuts them and again before they are dealt, whichever run texts they come from.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import fresh
from lymphframe.session import stage, table, unstage

LENGTH, CORE = 200, 64
#: Substrings that cut runs of keys with over HOT and over 2 * HOT occurrences.
FINE = (160, 192)
#: Bytes of a shard (ranks must fit 21 bits), windows of a run, occurrences from which a key is split.
SHARD, RUN, HOT = 1_000_000, 1024, 1_000
#: Occurrences and bytes of merged pieces that a task holds before it passes them on.
HELD, HELD_BYTES = 20_000, 1 << 24
_STEP = 1 << 16


def window_keys(x: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of LENGTH bytes: the least 47-bit hash of its substrings of `core` bytes, and whether it occurs twice in them.

    core is a sum of powers of two; hashes of doubling length are combined, then minima of doubling
    width. The low 17 bits hold the place, from the left and from the right, so that ties show.
    """
    with np.errstate(over="ignore"):
        part, base, size = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), np.uint64(0x100000001B3), 1
        whole: np.ndarray | None = None
        have = 0
        while True:
            if core & size:
                whole = part if whole is None else whole[: len(part) - have] * base + part[have:]
                have += size
            if have == core:
                break
            part = part[:-size] * base + part[size:]
            base, size = base * base, size * 2
        m = whole ^ (whole >> np.uint64(31))
        m *= np.uint64(0x9E3779B97F4A7C15)
        m ^= m >> np.uint64(29)
    m &= ~np.uint64(0x1FFFF)
    place = np.arange(len(m), dtype=np.uint64)
    left, right = _least(m | place, core), _least(m | (np.uint64(0x1FFFF) - place), core)
    return left >> np.uint64(17), (left & np.uint64(0x1FFFF)) != np.uint64(0x1FFFF) - (right & np.uint64(0x1FFFF))


def _least(m: np.ndarray, core: int) -> np.ndarray:
    width, have = LENGTH - core + 1, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(m) - (width - have)], m[width - have :]) if width > have else m


def runs(x: np.ndarray, ends: np.ndarray, core: int) -> tuple[np.ndarray, ...]:
    """(start, windows, key, twice) of the runs of several texts that lie in x one after another; ends: where each ends.

    twice: the run may hold one window at two places, as its key occurs in it twice.
    """
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(x) - LENGTH + 1, _STEP):
        m, tie = window_keys(x[at : at + _STEP + LENGTH - 1], core)
        place = np.arange(at, at + len(m))
        text = np.searchsorted(ends, place, side="right")
        fits = place + LENGTH <= ends[text]
        new = np.ones(len(m) + 1, bool)
        new[1:-1] = (m[1:] != m[:-1]) | (text[1:] != text[:-1]) | (fits[1:] != fits[:-1])
        edge = np.flatnonzero(new)
        start, size = edge[:-1], np.diff(edge)
        ties = np.r_[0, np.cumsum(tie)]
        twice = (ties[edge[1:]] > ties[edge[:-1]]) | (size > LENGTH - core + 1)
        pieces = (size + RUN - 1) // RUN
        if (pieces > 1).any():
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start, size, twice = np.repeat(start, pieces) + k * RUN, np.minimum(RUN, np.repeat(size, pieces) - k * RUN), np.repeat(twice, pieces)
        ok = fits[start]
        start, size = start[ok], size[ok]
        found.append((start + at, size, m[start], twice[ok]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(c) for c in zip(*found))


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column one after another, and the ends of its rows."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    x = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return x, off[1:] - off[0]


_ANCHORS = "doc long, tx long, h long, th long, s int, n int, c int"


def _anchor_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            b = whole.slice(at, 1024)
            x, ends = _strings(b.column(2))
            start, size, key, twice = runs(x, ends, CORE)
            if not len(start):
                continue
            buf, h64 = x.tobytes(), xxhash.xxh3_64_intdigest
            th = np.fromiter((h64(buf[p:q]) for p, q in zip(start.tolist(), (start + size + LENGTH - 1).tolist())), np.uint64, len(start))
            row = np.searchsorted(ends, start, side="right")
            begin = np.r_[0, ends[:-1]]
            doc, tx = (b.column(k).to_numpy()[row] for k in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc), pa.array(tx), pa.array(key.view(np.int64)), pa.array(th.view(np.int64)), pa.array((start - begin[row]).astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(twice.astype(np.int32) + 1, type=pa.int32())],
                names=["doc", "tx", "h", "th", "s", "n", "c"],
            )


#: level: 0 for a whole run (key is h, text hash th), else how fine it was cut; parts: where a merged piece lies, as (h, th, offset).
_PIECES = "key long, ph long, w long, n int, text binary, level int, parts array<struct<h: long, th: long, off: int>>"
_PIECE_SCHEMA = pa.schema([("key", pa.int64()), ("ph", pa.int64()), ("w", pa.int64()), ("n", pa.int32()), ("text", pa.binary()), ("level", pa.int32()), ("parts", pa.list_(pa.struct([("h", pa.int64()), ("th", pa.int64()), ("off", pa.int32())])))])
_VERDICT_SCHEMA = pa.schema([("key", pa.int64()), ("ph", pa.int64()), ("level", pa.int32()), ("spans", pa.list_(pa.int32()))])


def _signed(x: int) -> int:
    return x - ((x >> 63) << 64)


def _piece_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut the wanted runs out of their texts, the last two columns; runs of split keys come in finer pieces, merged where alike."""
    whole: list[tuple] = []
    merged: dict[tuple[int, int, int], list] = {}
    held = held_bytes = 0
    for b in batches:
        for text, wanted in zip(b.column(b.num_columns - 2).cast(pa.binary()), b.column(b.num_columns - 1)):
            buf = text.as_py()
            for r in wanted.as_py():
                s, n, level = r["s"], r["n"], r["level"]
                cut = buf[s : s + n + LENGTH - 1]
                if not level:
                    whole.append((r["h"], r["th"], r["w"], n, cut, 0, None))
                    continue
                x = np.frombuffer(cut, np.uint8)
                for p, m, key, _ in zip(*(c.tolist() for c in runs(x, np.array([len(x)]), FINE[level - 1]))):
                    piece = cut[p : p + m + LENGTH - 1]
                    name = _signed(key ^ (r["h"] & 0xFFFFFFFFFFFFFFFF)), _signed(xxhash.xxh3_64_intdigest(piece)), level
                    if name not in merged:
                        merged[name] = [0, m, piece, []]
                        held_bytes += len(piece)
                    merged[name][0] += r["w"]
                    merged[name][3].append((r["h"], r["th"], p))
                    held += 1
            if len(whole) >= 4000:
                yield _batch(whole, _PIECE_SCHEMA)
                whole = []
            if held > HELD or held_bytes > HELD_BYTES:
                yield _told_pieces(merged)
                held = held_bytes = 0
    if whole:
        yield _batch(whole, _PIECE_SCHEMA)
    if merged:
        yield _told_pieces(merged)


def _told_pieces(merged: dict[tuple[int, int, int], list]) -> pa.RecordBatch:
    rows = [(key, ph, w, n, text, level, [dict(zip(("h", "th", "off"), p)) for p in parts]) for (key, ph, level), (w, n, text, parts) in merged.items()]
    merged.clear()
    return _batch(rows, _PIECE_SCHEMA)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def words8(x: np.ndarray) -> np.ndarray:
    """At each place the next 8 bytes as one big-endian number, zeros after the end."""
    k = np.r_[x, np.zeros(LENGTH + 16, np.uint8)].astype(np.uint64)
    for size in (1, 2, 4):
        k = (k[:-size] << np.uint64(8 * size)) | k[size:]
    return k


def suffix_array(x: np.ndarray, k8: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson-Sadakane refinement; at most 2**21 - 2 bytes.

    Suffixes start out ordered by 8 bytes. A round orders each group still equal in h bytes by the
    ranks of the suffixes h and 2h further on, so h grows threefold; groups of one are left alone.
    """
    n = len(x)
    sa = np.argsort(k8[:n], kind="stable")
    first = k8[sa]
    head = np.r_[True, first[1:] != first[:-1]]
    if n >= 8:
        # the last suffixes are shorter than a key: among equals, the shorter one comes first
        short = sa > n - 8
        if short.any():
            length = np.minimum(n - sa, 8)
            order = np.lexsort((length, first))
            sa, first, length = sa[order], first[order], length[order]
            head = np.r_[True, (first[1:] != first[:-1]) | (length[1:] != length[:-1])]
    else:
        sa = np.array(sorted(range(n), key=lambda p: x[p:].tobytes()), np.int64)
        head = np.ones(n, bool)
    rank = np.zeros(3 * n + 3 * LENGTH, np.int64)  # past the end: 0, others from 1
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank[sa] = group + 1
    h = 8
    size_one = head & np.r_[head[1:], True]
    slots = np.flatnonzero(~size_one)
    while len(slots):
        p = sa[slots]
        second, third = rank[np.minimum(p + h, n)], rank[np.minimum(p + 2 * h, n)]
        mix = (rank[p] << 42) | (second << 21) | third
        order = np.argsort(mix, kind="stable")
        p, mix = p[order], mix[order]
        sa[slots] = p
        head = np.r_[True, mix[1:] != mix[:-1]]
        rank[p] = slots[np.maximum.accumulate(np.where(head, np.arange(len(p)), 0))] + 1
        slots = slots[~(head & np.r_[head[1:], True])]
        h *= 3
    return sa, rank[:n] - 1


def common_prefixes(x: np.ndarray, k8: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """lcp[i]: bytes that the suffixes at places i - 1 and i of sa share (lcp[0] = 0).

    Kasai's rule, in text order: where the letters before both suffixes agree, the prefix is one
    shorter than that of the suffix before; only the other places are compared, 8 bytes at a time.
    """
    n = len(x)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    fresh = (place == 0) | (before <= 0)
    fresh |= x[place - 1] != x[np.maximum(before - 1, 0)]
    fresh[1:] |= before[1:] - 1 != before[:-1]  # the suffix before has another neighbour
    p = np.flatnonzero(fresh & (before >= 0))
    q, shared, live = before[p], np.zeros(len(p), np.int64), np.arange(len(p))
    while len(live):
        a, b = p[live] + shared[live], q[live] + shared[live]
        diff = k8[np.minimum(a, n)] ^ k8[np.minimum(b, n)]
        equal = (diff == 0) & (np.maximum(a, b) + 8 <= n)
        done = live[~equal]
        d = diff[~equal]
        lead = np.zeros(len(d), np.int64)
        for k in range(8):
            lead += (lead == k) & ((d >> np.uint64(56 - 8 * k)) & np.uint64(255) == 0)
        shared[done] += np.minimum(lead, n - np.maximum(a, b)[~equal])
        live = live[equal]
        shared[live] += 8
    plcp = np.zeros(n, np.int64)
    plcp[p] = shared + p
    origin = np.maximum.accumulate(np.where(fresh, place, 0))
    plcp = np.where(before >= 0, plcp[origin] - place, 0)
    lcp = plcp[sa]
    lcp[0] = 0
    return lcp


class Shard:
    """Pieces of text with their windows, the classes of equal windows and the classes' weights."""

    def __init__(self, texts: list[bytes], n: list[int], w: list[int]):
        self.x = np.frombuffer(b"".join(texts), np.uint8)
        self.k8 = words8(self.x)
        begin = np.cumsum([0, *map(len, texts)])[:-1]
        self.n = np.array(n)
        self.piece = np.repeat(np.arange(len(n)), self.n)
        self.inside = np.arange(len(self.piece)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        self.at = begin[self.piece] + self.inside
        self.sa, rank = suffix_array(self.x, self.k8)
        lcp = common_prefixes(self.x, self.k8, self.sa)
        self.by_place = np.cumsum(lcp < LENGTH) - 1
        self.cls = self.by_place[rank[self.at]]
        self.weight = np.bincount(self.cls, np.array(w)[self.piece], minlength=len(self.sa))
        self.repeated = self.weight[self.cls] >= 2

    def spans(self) -> list[list[int]]:
        """For each piece, [from, to) pairs of its repeated windows, one after another."""
        r = np.r_[False, self.repeated, False]
        p = np.r_[-1, self.piece, -1]
        start = np.flatnonzero(r[1:-1] & (~r[:-2] | (p[:-2] != p[1:-1])))
        end = np.flatnonzero(r[1:-1] & (~r[2:] | (p[2:] != p[1:-1])))
        out: list[list[int]] = [[] for _ in self.n]
        for k, a, b in zip(self.piece[start].tolist(), self.inside[start].tolist(), self.inside[end].tolist()):
            out[k] += [a, b + 1]
        return out


def _place(k8: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where windows p stand in the sorted windows q, and whether they are there; windows are places in k8."""
    first = k8[q]  # eight bytes settle most; only what agrees in them is compared on
    lo, hi = (np.searchsorted(first, k8[p], side) for side in ("left", "right"))
    top = hi.copy()
    while (live := np.flatnonzero(lo < hi)).size:
        mid = (lo[live] + hi[live]) // 2
        after = _compare(k8, p[live], q[mid]) > 0
        lo[live[after]], hi[live[~after]] = mid[after] + 1, mid[~after]
    there = lo < top
    there[there] = _compare(k8, p[there], q[lo[there]]) == 0
    return lo, there


def _compare(k8: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Sign of the windows at p minus those at q, over LENGTH bytes."""
    sign, live = np.zeros(len(p), np.int8), np.arange(len(p))
    for t in range(0, LENGTH, 8):
        a, b = k8[p[live] + t], k8[q[live] + t]
        sign[live] = np.where(a > b, 1, np.where(a < b, -1, 0))
        live = live[a == b]
        if not len(live):
            break
    return sign


def merge_classes(shards: list[Shard]) -> None:
    """Make the shards of one key know of each other: a class weighs what it weighs in all of them.

    Sorted classes are merged two by two by binary search, so n windows cost about n log² n.
    """
    base = np.cumsum([0, *(len(s.k8) for s in shards)])
    k8 = np.concatenate([s.k8 for s in shards])
    own, todo = [], []
    for s, start in zip(shards, base.tolist()):
        cls, first = np.unique(s.cls, return_index=True)  # classes are numbered in sorted order
        own.append((cls, s.at[first] + start))
        todo.append((own[-1][1], s.weight[cls]))
    while len(todo) > 1:
        (p, v), (q, w) = todo.pop(0), todo.pop(0)
        if len(p) > len(q):
            p, v, q, w = q, w, p, v
        at, there = _place(k8, p, q)
        w = w.copy()
        w[at[there]] += v[there]
        todo.append((np.insert(q, at[~there], p[~there]), np.insert(w, at[~there], v[~there])))
    final, weight = todo[0]
    for s, (cls, p) in zip(shards, own):
        s.weight[cls] = weight[_place(k8, p, final)[0]]
        s.repeated = s.weight[s.cls] >= 2


def shard_rows(rows: Iterator[tuple], limit: int = SHARD) -> Iterator[tuple]:
    """(key, ph, level, spans) for rows (key, ph, w, n, text, level) sorted by key, one shard at a time."""
    held: list[tuple] = []
    size = 0
    open_shards: list[tuple[Shard, list[tuple]]] = []  # of one key that fills more than a shard

    def build(part: list[tuple]) -> tuple[Shard, list[tuple]]:
        return Shard([r[4] for r in part], [r[3] for r in part], [r[2] for r in part]), part

    def told(shard: Shard, part: list[tuple]) -> Iterator[tuple]:
        for r, spans in zip(part, shard.spans()):
            if spans:
                yield r[0], r[1], r[5], spans

    def merged() -> Iterator[tuple]:
        if open_shards:
            merge_classes([s for s, _ in open_shards])
        for s in open_shards:
            yield from told(*s)
        open_shards.clear()

    for r in rows:
        if open_shards and r[0] != open_shards[0][1][0][0]:
            if held:
                open_shards.append(build(held))
                held, size = [], 0
            yield from merged()
        if held and size + len(r[4]) > limit:
            last = held[-1][0]
            if last != held[0][0] and r[0] == last:
                cut = next(i for i, q in enumerate(held) if q[0] == last)
                yield from told(*build(held[:cut]))
                held = held[cut:]
            elif r[0] != last:
                yield from told(*build(held))
                held = []
            else:
                open_shards.append(build(held))
                held = []
            size = sum(len(q[4]) for q in held)
        held.append(r)
        size += len(r[4])
    if held:
        if open_shards:
            open_shards.append(build(held))
        else:
            yield from told(*build(held))
    yield from merged()


def _shard_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns))

    out: list[tuple] = []
    for r in shard_rows(rows()):
        out.append(r)
        if len(out) >= 10_000:
            yield _batch(out, _VERDICT_SCHEMA)
            out = []
    if out:
        yield _batch(out, _VERDICT_SCHEMA)


def covered(n_bytes: int, found: list[tuple[int, list[int]]]) -> list[tuple[int, int]]:
    """Maximal [from, to) byte ranges under the repeated windows; found: run starts and their spans."""
    ranges = sorted((s + a, s + b - 1 + LENGTH) for s, spans in found for a, b in zip(spans[::2], spans[1::2]))
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, n_bytes)) for a, b in out]


def _kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in gone:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def _whole_letters(data: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same ranges, shrunk so that no letter of several bytes is cut."""
    out = []
    for a, b in gone:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def repeated_runs(documents: DataFrame, doc: str, tx: str, text: str, hot: int = HOT) -> DataFrame:
    """(doc, tx, found): for texts with repeated windows, run starts and the repeated starts in each run.

    The caller joins the same frame by the same keys once more. As no column is left out here, the
    shuffle of the texts for both joins is one.
    """
    source = documents.select(F.col(doc).alias("doc"), F.col(tx).alias("tx"), F.col(text).alias("text"))
    anchors = stage(source.where(F.octet_length("text") >= LENGTH).mapInArrow(_anchor_task, _ANCHORS), "anchors")
    often = anchors.groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    often = often.select("h", F.when(F.col("c") > 2 * hot, 2).when(F.col("c") > hot, 1).otherwise(0).alias("level"))
    occ = stage(anchors.drop("c").join(often, "h"), "occurrences")
    unstage(anchors)
    distinct = occ.groupBy("h", "th", "level").agg(F.count("*").alias("w"), F.min(F.struct("doc", "tx", "s", "n")).alias("r"))
    (want,) = fresh(documents.columns, "wanted")
    wanted = distinct.groupBy(F.col("r.doc").alias(doc), F.col("r.tx").alias(tx)).agg(
        F.collect_list(F.struct("h", "th", "w", "level", F.col("r.s").alias("s"), F.col("r.n").alias("n"))).alias(want)
    )
    rest = [c for c in documents.columns if c not in (doc, tx, text)]
    pieces = stage(documents.join(wanted, [doc, tx]).select(*rest, text, want).mapInArrow(_piece_task, _PIECES), "pieces")
    fine = pieces.where("level > 0")
    alike = fine.groupBy("key", "ph", "level").agg(F.sum("w").alias("w"), F.max("n").alias("n"), F.max("text").alias("text"))
    columns = ["key", "ph", "w", "n", "text", "level"]
    dealt = pieces.where("level = 0").select(*columns).union(alike.select(*columns)).repartition(F.col("key")).sortWithinPartitions("key")
    verdict = stage(dealt.mapInArrow(_shard_task, "key long, ph long, level int, spans array<int>"), "verdict")
    cut = fine.select("key", "ph", "level", "parts").join(verdict.where("level > 0"), ["key", "ph", "level"]).select(F.explode("parts").alias("p"), "spans")
    told = verdict.where("level = 0").select(F.col("key").alias("h"), F.col("ph").alias("th"), "spans").union(
        cut.select("p.h", "p.th", F.transform("spans", lambda x: x + F.col("p.off")))
    )
    hit = occ.select("doc", "tx", "h", "th", "s").join(told, ["h", "th"])
    return hit.groupBy("doc", "tx").agg(F.collect_set(F.struct("s", "spans")).alias("found"))


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): one row a row of documents.

    With keep_text, kept_sha256 gives way to `kept`, the text that is left; removed ranges are then
    shrunk to whole letters. A null text counts as empty, null ids are kept, and rows with equal id
    and text each get the same result; both copies of a repeated string go. Other columns aren't read.
    """
    source = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    source = source.select("id", F.xxhash64("id").alias("doc"), F.xxhash64("text").alias("tx"), "text")
    found = repeated_runs(source, "doc", "tx", "text", hot)
    joined = source.join(found, ["doc", "tx"], "left").select("id", "text", "found")
    kind = documents.schema[id_col].dataType.simpleString()
    last = "kept string" if keep_text else "kept_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                rows = []
                for t, f in zip(b.column(1).cast(pa.binary()), b.column(2)):
                    data, got = t.as_py(), f.as_py()
                    gone = covered(len(data), [(r["s"], r["spans"]) for r in got]) if got else []
                    if keep_text:
                        gone = _whole_letters(data, gone)
                    left = _kept(data, gone) if gone else data
                    rows.append((len(data), sum(q - p for p, q in gone), len(gone), left.decode("utf-8", "replace") if keep_text else hashlib.sha256(left).hexdigest()))
                c = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v, type=k) for v, k in zip(c, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["id", "n_bytes", "n_removed", "n_spans", last.split()[0]])

    return joined.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, {last}").withColumnRenamed("id", id_col)


def strip_repeats(documents: DataFrame, text_col: str = "text", chars_col: str = "n_chars", hot: int = HOT) -> DataFrame:
    """The same rows and columns, repeated strings cut out of the text (to whole letters), the column of its length set anew."""
    # the text alone tells what goes, so rows of one text share a key, two hashes of 64 bits
    doc, tx, gone = fresh(documents.columns, "first", "second", "gone")
    keyed = documents.withColumns({doc: F.xxhash64(F.lit(1), F.col(text_col)), tx: F.xxhash64(text_col)})
    found = repeated_runs(keyed, doc, tx, text_col, hot).select(F.col("doc").alias(doc), F.col("tx").alias(tx), F.col("found").alias(gone))
    joined = keyed.join(found, [doc, tx], "left").select(*documents.columns, gone)
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                columns = dict(zip(names, b.columns))
                texts = columns[text_col].to_pylist()
                for i, f in enumerate(b.column(len(names)).to_pylist()):
                    if f:
                        data = texts[i].encode("utf-8", "surrogatepass")
                        texts[i] = _kept(data, _whole_letters(data, covered(len(data), [(r["s"], r["spans"]) for r in f]))).decode("utf-8", "replace")
                columns[text_col] = pa.array(texts, type=columns[text_col].type)
                if chars_col in columns:
                    columns[chars_col] = pa.array([None if t is None else len(t) for t in texts], type=columns[chars_col].type)
                yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return joined.mapInArrow(run, documents.schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
