"""Merkle dataset manifest: a tree of SHA-256 over the rows of every group, a tree over the groups, and proofs.

A parent is stored with its preimage, the concatenated digests of its children. Paths go down the
tree: a node's path is its parent's preimage, with the node's place in it, followed by the parent's
path. A leaf meets its path in one join with the lowest parents, a sixteenth as many; cutting its own
64 letters out of each preimage leaves the siblings, putting a recomputed digest in their place folds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.operators.grouping import numbered_within
from lymphframe.session import stage, table

#: Children of a node, as a power of two; hexadecimal letters of a digest.
BITS, DIGEST = 4, 64
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(*values: Column) -> Column:
    """Each value as '-' if null, else its length in UTF-8 bytes, ':' and the value; all concatenated."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.concat(*(one(v.cast("string")) for v in values))


def leaves(documents: DataFrame, divisor: int = 5) -> DataFrame:
    """(doc_id, g, leaf, changed): digests of rows, and of tampered ones where divisor divides the id's crc32, else null.

    g: '' for a null source, '+' and the source for others, so that g sorts as sources do.
    """
    d = documents.select(*FIELDS)
    text = F.col("text")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 0
    digest = lambda t: F.sha2(encoded(*(F.col(c) for c in FIELDS[:-1]), t), 256)
    changed = F.when(hit, digest(F.translate(text, UPPER, LOWER)))
    return d.select("doc_id", F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("g"), digest(text).alias("leaf"), changed.alias("changed"))


def parents(nodes: DataFrame) -> list[DataFrame]:
    """Levels of (g, i, preimage, digest, m) above nodes (g, i, digest, m): i counts from 0 within g, m is the level's size there.

    Groups of a single node have no more levels. A run's children, 1 << BITS at most, meet in one row.
    """
    out, most = [], nodes.agg(F.max("m")).first()[0] or 0
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("i", "digest")))
        up = nodes.where("m > 1").groupBy("g", F.shiftright("i", BITS).alias("i")).agg(F.array_join(F.transform(children, lambda c: c["digest"]), "").alias("preimage"), F.max("m").alias("m"))
        over = F.shiftright(F.col("m") + ((1 << BITS) - 1), BITS)
        nodes = stage(up.select("g", "i", "preimage", F.sha2("preimage", 256).alias("digest"), over.alias("m")), "level")
        out.append(nodes)
        most = -(-most >> BITS)
    return out


def _below(nodes: DataFrame, up: DataFrame | None, tops: DataFrame) -> DataFrame:
    """nodes with path, an array of (preimage, slot) from the nearest parent to the top, and what tops carries besides.

    up: the level above with its own paths; tops: (g, path, ...) of groups that have only one node left.
    """
    more = [c for c in tops.columns if c not in ("g", "path")]
    alone = nodes.where("m = 1").join(tops, "g").select(*nodes.columns, "path", *more)
    if up is None:
        return alone
    p = up.select(F.col("g").alias("pg"), F.col("i").alias("pi"), F.col("preimage").alias("pre"), F.col("path").alias("above"), *more)
    x = nodes.where("m > 1").join(p, (F.col("g") == F.col("pg")) & (F.shiftright("i", BITS) == F.col("pi")))
    slot = F.col("i").bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")
    path = F.concat(F.array(F.struct(F.col("pre").alias("preimage"), slot.alias("slot"))), F.col("above"))
    return x.select(*nodes.columns, path.alias("path"), *more).unionByName(alone)


def descend(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """nodes (the lowest level) with their paths; see _below()."""
    up = None
    for level in reversed(levels):
        up = _below(level, up, tops)
    return _below(nodes, up, tops)


def manifest(rows: DataFrame) -> DataFrame:
    """rows (g, leaf, doc_id, ...) with subroot, root and path: all that a proof needs.

    Leaves of a group are ordered by id, nulls first, ties by digest; groups by g.
    """
    n = numbered_within(stage(rows, "leaves"), "g", ["doc_id", "leaf"], "i", "m")
    n = stage(n.withColumn("digest", F.col("leaf")), "placed")
    levels = parents(n.select("g", "i", "digest", "m"))
    single = [x.where("m = 1").select("g", "digest") for x in (n, *levels)]
    subroots = single[0]
    for x in single[1:]:
        subroots = subroots.unionByName(x)
    s = numbered_within(subroots.select(F.col("g").alias("source"), "digest").withColumn("g", F.lit("")), "g", ["source"], "i", "m")
    s = stage(s, "subroots")
    higher = parents(s.select("g", "i", "digest", "m"))
    root = (higher[-1] if higher else s).select("digest").first()  # one row, none for an empty table
    none = F.array().cast("array<struct<preimage:string,slot:int>>")
    tops = s.select("g").distinct().select("g", none.alias("path"), F.lit(root[0] if root else None).cast("string").alias("root"))
    tops = descend(s, higher, tops).select(F.col("source").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    return descend(n, levels, stage(tops, "tops")).drop("digest")


def siblings(path: Column) -> Column:
    """The digests beside the node's own and its ancestors', level by level, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(_before(p), _after(p))), "")


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda h, p: F.sha2(F.concat(_before(p), h, _after(p)), 256))


def _before(p: Column) -> Column:
    return F.substr(p["preimage"], F.lit(1), p["slot"] * DIGEST)


def _after(p: Column) -> Column:
    return F.substr(p["preimage"], (p["slot"] + 1) * DIGEST + 1)


def proofs(documents: DataFrame, divisor: int = 5) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): one row a row of documents.

    Null columns are leaves' '-'; a null id comes before others in its source and is never tampered
    with; rows that share an id are ordered by their digests, and rows alike in everything have a leaf
    each. Columns besides FIELDS are not read. An empty table gives no rows.
    """
    m = manifest(leaves(documents, divisor))
    proof, root = F.sha2(siblings(F.col("path")), 256), folded(F.col("path"), F.coalesce("changed", "leaf"))
    x = m.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), root.alias("folded_root"))
    return x.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


def _oracle(depth: int = 7, over: int = 4) -> str:
    """SQL for groups of up to 16 ** depth rows and up to 16 ** over groups."""
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END"
    leaf = lambda t: "sha256(" + " || ".join([*map(one, FIELDS[:-1]), t]) + ")"
    marks = "list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: [CAST(ascii(substr(s, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({marks}, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END), 4294967295)"
    up = lambda a, k: (
        f"{a}{k} AS (SELECT g, i // 16 AS i, string_agg(h, '' ORDER BY i) AS pre, sha256(string_agg(h, '' ORDER BY i)) AS h, (max(m) + 15) // 16 AS m FROM {a}{k - 1} WHERE m > 1 GROUP BY g, i // 16)"
    )
    cut = lambda a, i, k: f"substr({a}{k}.pre, 1, 64 * CAST({i} // {16 ** (k - 1)} % 16 AS INT))"
    end = lambda a, i, k: f"substr({a}{k}.pre, 64 * CAST({i} // {16 ** (k - 1)} % 16 AS INT) + 65)"
    steps = [("l", "l0.i", k) for k in range(1, depth + 1)] + [("t", "t0.i", k) for k in range(1, over + 1)]
    joins = " ".join(f"LEFT JOIN {a}{k} ON {a}{k}.g = {a}0.g AND {a}{k}.i = {i} // {16**k}" for a, i, k in steps if k)
    pieces = " || ".join(f"coalesce({cut(*s)} || {end(*s)}, '')" for s in steps)
    path = ", ".join(f"{cut(*s)} AS b{n}, {end(*s)} AS e{n}" for n, s in enumerate(steps))
    folds, last = [], "f"
    for n in range(len(steps)):
        folds.append(f"f{n} AS (SELECT * EXCLUDE (b{n}, e{n}, folded), CASE WHEN b{n} IS NULL THEN folded ELSE sha256(b{n} || folded || e{n}) END AS folded FROM {last})")
        last = f"f{n}"
    return f"""
WITH d AS (
  SELECT *, CAST(doc_id AS VARCHAR) AS s, translate(text, '{UPPER}', '{LOWER}') AS low, CASE WHEN source IS NULL THEN '' ELSE '+' || source END AS g FROM documents
), v AS (
  SELECT doc_id, g, {leaf(one("text"))} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(one("low"))} END AS changed FROM d
), l0 AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY g) AS m FROM v
), {", ".join(up("l", k) for k in range(1, depth + 1))}, sub AS (
  {" UNION ALL ".join(f"SELECT g, h FROM l{k} WHERE m = 1" for k in range(depth + 1))}
), t0 AS (
  SELECT 'all' AS g, g AS source, h, row_number() OVER (ORDER BY g) - 1 AS i, count(*) OVER () AS m FROM sub
), {", ".join(up("t", k) for k in range(1, over + 1))}, top AS (
  {" UNION ALL ".join(f"SELECT h AS root FROM t{k} WHERE m = 1" for k in range(over + 1))}
), f AS (
  SELECT l0.doc_id, l0.h AS leaf, t0.h AS subroot, root, sha256({pieces}) AS proof_sha256, coalesce(changed, l0.h) AS folded, {path}
  FROM l0 JOIN t0 ON t0.source = l0.g {joins} CROSS JOIN top
), {", ".join(folds)}
SELECT doc_id, leaf, subroot, root, proof_sha256, folded AS folded_root, folded = root AS verified FROM {last}
"""


ORACLE = _oracle()
