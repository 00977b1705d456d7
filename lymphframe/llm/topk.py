"""Exact top-k inner-product search by no-random-access aggregation over sorted lists.

Each component of the candidates is a list sorted by value; a query reads it from the top where its
own component is positive and from the bottom where it is negative. Lists are read in order, some
depth further at a time, for a block of queries at once, as matrix products. What was read of a
candidate, with the far ends of the lists not yet read, is its lower bound; with the values at which
those lists stand, its upper bound. A candidate whose upper bound is under the k-th lower bound, or
under the k-th score of the candidates read before, can't qualify. A query stops reading when no more
candidates are left than a few times k; those alone get their scores completed. Bounds that prune
nothing until late (vectors without any structure) cost depth, never results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphframe.session import table

K, SCALE, EVERY = 20, 64, 20
#: Components of a block's vectors, at most; rows of the lists read at a time and queries that read them.
BLOCK, LISTS, READERS = 1 << 22, 2048, 512
#: Shares of each list after which bounds are compared.
DEPTHS = (0.25, 0.5, 0.75, 0.875, 1.0)


def scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row by row inner products of integers, exact; one beyond 64 bits stands at their end."""
    largest = [max(int(m.max(initial=0)), -int(m.min(initial=0))) for m in (q, v)]
    if largest[0] * largest[1] * q.shape[1] < 1 << 63:
        return np.einsum("ij,ij->i", q, v)
    exact = (sum(int(a) * int(b) for a, b in zip(x, y)) for x, y in zip(q, v))
    return np.fromiter((min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact), np.int64, len(q))


def read_lists(q: np.ndarray, v: np.ndarray, out: np.ndarray, bar: np.ndarray, k: int, told: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score) of all pairs that may be among a query's k best, few more besides.

    q, v: integers; out[i, j]: the pair takes no part; bar: a score that k candidates of the query
    are known to reach. told, if given, adds up list entries, those read, pairs, and pairs completed.
    """
    n, m = len(q), len(v)
    qf, vf = q.astype(np.float64), v.astype(np.float64)
    room = np.abs(qf) @ np.abs(vf).max(axis=0)  # no sum is larger
    kind, slack = (np.float32, 0.0) if room.max() < 2**24 else (np.float64, 0.0 if room.max() < 2**53 else 2.0**-40)
    up, down, vf, free = np.maximum(qf, 0).astype(kind), np.minimum(qf, 0).astype(kind), vf.astype(kind), (room * slack)[:, None]
    lists = np.sort(vf, axis=0)
    alive = ~out
    reads, want = np.arange(n), min(k, m)
    for share in DEPTHS:
        depth = min(m - 1, int(m * share))
        top, bottom = lists[m - 1 - depth], lists[depth]  # where the lists stand, from either end
        head, tail = vf >= top, vf <= bottom  # read so far
        u, d, live = up[reads], down[reads], alive[reads]
        upper = u @ np.where(head, vf, top).T + d @ np.where(tail, vf, bottom).T + free[reads]
        lower = u @ np.where(head, vf, lists[0]).T + d @ np.where(tail, vf, lists[-1]).T - free[reads]
        if slack:  # scores stand at the ends of 64 bits
            upper, lower = np.maximum(upper, -(2.0**63)), np.minimum(lower, 2.0**63)
        lower[~live] = -np.inf
        least = bar[reads] - free[reads, 0]
        if m > want:
            least = np.maximum(least, np.partition(lower, m - want, axis=1)[:, m - want])
        live &= upper >= least[:, None]
        alive[reads] = live
        done = live.sum(axis=1) <= 4 * want
        if told is not None:
            told["read"] = told.get("read", 0) + (len(reads) if share == DEPTHS[-1] else int(done.sum())) * share * m
        reads = reads[~done]
        if not len(reads):
            break
    i, j = np.nonzero(alive)
    score = np.concatenate([scores(q[i[s : s + 65536]], v[j[s : s + 65536]]) for s in range(0, max(1, len(i)), 65536)])
    if told is not None:
        for key, x in (("entries", n * m), ("pairs", n * m), ("completed", len(i))):
            told[key] = told.get(key, 0) + x
    return i, j, score


def search(own: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int, told: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's place, candidate's place, score) of each query's k best candidates with another id, ties to smaller ids."""
    order = np.argsort(ids, kind="stable")
    found = []
    for at in range(0, len(own), READERS):
        part = own[at : at + READERS]
        best, bar = (np.zeros(0, np.int64),) * 3, np.full(len(part), -np.inf)
        for c in range(0, len(order), LISTS):
            place = order[c : c + LISTS]
            i, j, s = read_lists(q[at : at + READERS], v[place], part[:, None] == ids[place][None, :], bar, k, told)
            i, j, s = (np.r_[x, y] for x, y in zip(best, (i, j + c, s)))
            rank = np.lexsort((j, ~s, i))  # ~s falls as s grows and can't overflow
            i, j, s = i[rank], j[rank], s[rank]
            nth = np.arange(len(i)) - np.searchsorted(i, i)
            bar[i[nth == k - 1]] = s[nth == k - 1]
            best = tuple(x[nth < k] for x in (i, j, s))
        found.append((best[0] + at, order[best[1]], best[2]))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


def _matrix(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers; what a shorter vector lacks is 0."""
    lists = pa.concat_arrays(lists.chunks)
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])


def _block(query: pa.Table, candidate: pa.Table, k: int, width: int) -> pa.Table:
    if not query.num_rows or not candidate.num_rows:
        return _FOUND.empty_table()
    own, ids = (t.column("id").to_numpy() for t in (query, candidate))
    i, j, score = search(own, _matrix(query.column("v"), width), ids, _matrix(candidate.column("v"), width), k)
    copies = np.minimum(query.column("n").to_numpy()[i] * candidate.column("n").to_numpy()[j], k)
    return pa.table([own[i], ids[j], score, copies], schema=_FOUND)


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v, n): floor(SCALE * x) of whole, finite vectors, n rows with this id and vector.

    Null ids, null and empty vectors and those with a null or non-finite component go. Numbers
    beyond 64 bits stand at their end.
    """
    x = F.col(vector_col).cast("array<double>")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    v = F.transform(x, lambda e: F.floor(e * SCALE))
    ok = embeddings.where(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    return ok.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id", "v").agg(F.count("*").alias("n"))


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows, ties to the smaller id.

    Queries are the rows whose id is divisible by `every`; candidates are all rows with another id.
    Rows that share an id all take part, each on its own: an id with several query rows gets the k
    best scores of all of them, and a candidate that stands twice is found twice. Vectors that are
    null, empty or hold a null or non-finite component take no part; a vector shorter than another
    counts as filled up with zeros. Scores are exact; one beyond 64 bits stands at their end. Fewer
    candidates than k give fewer rows; an empty table gives none.

    Queries and candidates are dealt to blocks of at most BLOCK components by a hash of id and
    vector; each pair of blocks is one task's and gives k rows a query.
    """
    vectors = quantised(embeddings, id_col, vector_col)
    n, nq, width = vectors.agg(F.count("*"), F.count_if(F.col("id") % every == 0), F.max(F.size("v"))).first()
    rows = max(1, BLOCK // max(1, width or 0))
    blocks, groups = max(1, min(12, n // 256), -(-n // rows)), max(1, -(-nq // rows))
    number = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    deal = lambda m: F.pmod(F.xxhash64("id", "v"), F.lit(m)).cast("int")
    queries = vectors.where(F.col("id") % every == 0).select("id", "v", "n", deal(groups).alias("qb"), number(blocks).alias("cb"))
    candidates = vectors.select("id", "v", "n", deal(blocks).alias("cb"), number(groups).alias("qb"))
    found = (
        queries.groupBy("qb", "cb")
        .cogroup(candidates.groupBy("qb", "cb"))
        .applyInArrow(lambda a, b: _block(a, b, k, width), "query_id long, vec_id long, score long, copies long")
    )
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""
