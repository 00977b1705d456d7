"""Grouping of clonotypes: by key, by similarity, by distance to a centre; conditions on groups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lymphframe.functions.sequence import hamming
from lymphframe.operators.components import connected_components
from lymphframe.session import stage


def keyed_groups(clonotypes: DataFrame, id_col: str, key: Column, size: Column, empty_alone: bool = True) -> DataFrame:
    """(id, group_key, group_n): clonotypes of equal key are one group; with empty_alone, an empty key makes a group of one."""
    own = F.concat(F.lit("#"), F.col(id_col).cast("string"))
    k = F.when(key == "", own).otherwise(key) if empty_alone else key
    rows = clonotypes.select(F.col(id_col).alias("id"), k.alias("group_key"), size.alias("size"))
    n = rows.groupBy("group_key").agg(F.sum("size").alias("group_n"))
    return rows.join(n, "group_key").select("id", "group_key", "group_n")


def similar_pairs(items: DataFrame, id_col: str, block: list[str], near: Column) -> DataFrame:
    """(src, dst): pairs of distinct items of one block for which `near`, over columns a.* and b.*, holds; each pair once.

    Items are distinct sequences, so a group of copies is one item; a block is an equi-join key.
    """
    a, b = items.alias("a"), items.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in block]
    cond = F.col(f"a.{id_col}") < F.col(f"b.{id_col}")
    for s in same:
        cond = cond & s
    return a.join(b, cond & near).select(F.col(f"a.{id_col}").alias("src"), F.col(f"b.{id_col}").alias("dst"))


def stretch_pairs(items: DataFrame, id_col: str, seq_col: str, most: Column, block: list[str] = ()) -> DataFrame:
    """(src, dst): pairs of one block and length that may differ at `most` places at most; each pair once, none missing.

    Two such sequences agree on one of most + 1 stretches, so the join is on (block, length, stretch,
    its letters), and groups shrink with the length of a stretch. most: a function of the length and
    the block, so that it is the same for both; with as many differences as letters it falls back to
    blocks of one length.
    """
    n = F.length(seq_col)
    keyed = items.select(F.col(id_col).alias("id"), *block, F.col(seq_col).alias("seq"), n.alias("n"), most.cast("int").alias("most"))
    bound = lambda k: F.floor(F.col("n") * k / (F.col("most") + 1)).cast("int")
    stretch = F.transform(F.sequence(F.lit(0), F.col("most")), lambda k: F.struct(k.alias("k"), F.substr(F.col("seq"), bound(k) + 1, bound(k + 1) - bound(k)).alias("t")))
    keyed = keyed.select("id", *block, "n", F.explode(stretch).alias("e")).select("id", *block, "n", "e.k", "e.t")
    a, b = keyed.alias("a"), keyed.alias("b")
    same = F.col("a.id") < F.col("b.id")
    for c in (*block, "n", "k", "t"):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, same).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst")).distinct()


def hamming_pairs(items: DataFrame, id_col: str, seq_col: str, most: int) -> DataFrame:
    """(src, dst, distance): pairs of equal-length sequences that differ at `most` places at most; each pair once.

    Candidates are those of stretch_pairs(), so it is meant for high identities.
    """
    seq = items.select(F.col(id_col).alias("id"), F.col(seq_col).alias("seq"))
    found = stretch_pairs(items, id_col, seq_col, F.lit(most))
    both = found.join(seq.select(F.col("id").alias("src"), F.col("seq").alias("a")), "src").join(seq.select(F.col("id").alias("dst"), F.col("seq").alias("b")), "dst")
    return both.select("src", "dst", hamming(F.col("a"), F.col("b")).cast("long").alias("distance")).where(F.col("distance") <= most)


def refined_groups(clonotypes: DataFrame, id_col: str, keys: list[Column]) -> DataFrame:
    """(id, group_key): the partition that all conditions refine together; their order doesn't matter."""
    return clonotypes.select(F.col(id_col).alias("id"), F.concat_ws("|", *keys).alias("group_key"))


def similarity_classes(items: DataFrame, id_col: str, block: list[str], near: Column) -> DataFrame:
    """(id, root): transitive closure of similar_pairs; an item without a partner is its own root."""
    found = connected_components(similar_pairs(items, id_col, block, near))
    return items.select(F.col(id_col).alias("id")).join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))


def ratio_near(k: float, seq: str) -> Column:
    """1 - distance / length is at least k on either sequence, so on the longer one."""
    a, b = F.col(f"a.{seq}"), F.col(f"b.{seq}")
    return F.levenshtein(a, b) <= (1 - k) * F.greatest(F.length(a), F.length(b))


def bounded_near(k: float, seq: str) -> Column:
    """Distance at most the whole part of (1 - k) times the shorter length."""
    a, b = F.col(f"a.{seq}"), F.col(f"b.{seq}")
    return F.levenshtein(a, b) <= F.floor((1 - k) * F.least(F.length(a), F.length(b)) + 1e-9)


def nearest_groups(items: DataFrame, centres: DataFrame, id_col: str, block: list[str], distance: Column, top: int | None = None, within: float | None = None) -> DataFrame:
    """(centre, id, distance): for each centre its `top` nearest others, or all within a distance; ties by id."""
    a, b = centres.alias("a"), items.alias("b")
    cond = F.col(f"a.{id_col}") != F.col(f"b.{id_col}")
    for c in block:
        cond = cond & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    found = a.join(b, cond).select(F.col(f"a.{id_col}").alias("centre"), F.col(f"b.{id_col}").alias("id"), distance.alias("distance"))
    if within is not None:
        found = found.where(F.col("distance") <= within)
    if top is not None:
        found = found.withColumn("k", F.row_number().over(Window.partitionBy("centre").orderBy("distance", "id"))).where(F.col("k") <= top).drop("k")
    return found


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names like the wanted ones that are not taken, whatever the case of their letters."""
    low, out = {c.lower() for c in taken}, []
    for w in wanted:
        while w.lower() in low:
            w += "_"
        low.add(w.lower())
        out.append(w)
    return out


def spread(rows: DataFrame, key: str, most: int) -> DataFrame:
    """rows dealt by a hash of `key` to tasks of about `most` rows, for work that takes milliseconds a row."""
    n = rows.count()
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // most)), key)


def ordinals(groups: DataFrame) -> DataFrame:
    """groups with group_id, its place from 1 by n, largest first, ties by group_key.

    Rows are sorted by ranges, numbered within each range and written once; the ranges' sizes, a row
    a partition, then give each its first number. No task holds more than its range.
    """
    mark, part, first = fresh([*groups.columns, "group_id"], "row", "part", "first")
    number = F.monotonically_increasing_id()  # the partition's number above 33 bits of the row's
    rows = stage(groups.orderBy(F.desc("n"), "group_key").withColumn(mark, number), "ordered")
    rows = rows.withColumn(part, F.shiftright(mark, 33)).withColumn(mark, F.col(mark).bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = rows.groupBy(part).agg(F.count("*").alias(first))
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    start = F.broadcast(sizes.select(part, F.coalesce(F.sum(first).over(before), F.lit(0)).alias(first)))
    return rows.join(start, part).select(*groups.columns, (F.col(first) + F.col(mark) + 1).alias("group_id"))


def numbered_within(rows: DataFrame, group: str, order: list[str], name: str, total: str | None = None) -> DataFrame:
    """rows with `name`, each row's place from 0 within its group by `order`; ties are numbered in any order.

    Like ordinals(): rows are sorted by ranges of (group, order), so a hot group is spread over tasks; the
    least row number of each range's part of a group, a row a group and range, gives its first place.
    total: name of a further column, the number of rows of the group. Null groups are a group; helper
    columns take names that rows doesn't have, so no column of rows is lost but one called as `name` or `total`.
    """
    named = [name] if total is None else [name, total]
    rows = rows.drop(*named)
    mark, part, size, low, first, g, p = fresh([*rows.columns, *named], "row", "part", "size", "low", "first", "g", "p")
    x = stage(rows.orderBy(group, *order).withColumn(mark, F.monotonically_increasing_id()), "numbered").withColumn(part, F.shiftright(mark, 33))
    sizes = x.groupBy(F.col(group).alias(g), F.col(part).alias(p)).agg(F.count("*").alias(size), F.min(mark).alias(low))
    whole = Window.partitionBy(g)
    before = whole.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    start = sizes.select(g, p, (F.coalesce(F.sum(size).over(before), F.lit(0)) - F.col(low)).alias(first), F.sum(size).over(whole).alias(size))
    out = x.join(start, x[group].eqNullSafe(F.col(g)) & (F.col(part) == F.col(p)))
    return out.select(*(x[c] for c in rows.columns), (F.col(mark) + F.col(first)).alias(name), *([F.col(size).alias(total)] if total else []))
