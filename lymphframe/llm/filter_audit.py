"""Filter interaction audit: what each filter removes, repeats and alone catches, in every order of application.

A document is reduced to a mask of the filters it fails. Masks are counted by part and labels; the
counted cells are unpivoted against the steps of every order, a running bit-or over the steps before
tells what was removed earlier, conditional sums give each step's figures and totals by part and
filter the Shapley numerators. After the masks, nothing is larger than 2 ** filters * 4 cells a part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphframe.llm.common import fresh
from lymphframe.session import stage, table

WORD = r"[^\x20\x09-\x0D]+"
#: The last of the filters is the one on copies; the others are conditions on a text alone.
LETTERS = "ABCDE"
#: Labels of a document that are counted where it is lost: value of a bit and condition.
GOOD, TOXIC = 1, 2


def failures(text: Column, words: Column) -> list[Column]:
    """Whether a text fails A (short), B (repetitive), C (capitals) and D (signs); words: its words in order."""
    n = F.size(words)
    return [
        n < 100,
        F.size(F.array_distinct(words)) * 100 < n * 80,
        F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 10,
        text.rlike("[#$%&*|]"),
    ]


def masks(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, tags, n): documents by part, filters failed (bit k: letter k) and labels.

    Copies are told by SHA-256 of whole texts: E fails unless a row's id is the least of its text's
    ids, so rows that repeat the least id don't fail, nor do rows without an id, which have no order.
    Several labels of one id count if any of them says so.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    d = d.select("id", "part", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    bits = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(F.col("text"), F.col("words")))), F.lit(0))
    # texts are read once; from here on a row is some fifty bytes
    d = stage(d.select("id", "part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("h")), "masks")
    known, unknown = d.where("id IS NOT NULL"), d.where("id IS NULL")
    least = known.groupBy("h").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    y = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id"))
    y = y.agg((F.max(F.when(F.col("quality") == 1, GOOD).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, TOXIC).otherwise(0))).alias("tags"))
    # keys are ids, or ids with a hash: a text with many copies is no hot key
    known = known.join(least, ["id", "h"], "left").join(y, "id", "left")
    copy = F.when(F.col("first"), 0).otherwise(1 << LETTERS.index("E"))
    rows = known.select("part", (F.col("mask") + copy).alias("mask"), F.coalesce("tags", F.lit(0)).alias("tags")).union(unknown.select("part", "mask", F.lit(0)))
    return rows.groupBy("part", "mask", "tags").agg(F.count("*").alias("n"))


def audit(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of counted masks.

    cells: (part, mask, tags, n); bit k of a mask stands for letters[k], at most seven of them, as all
    orders are listed. Each part has a row for every order and step, zeros included; no cells, no rows.
    """
    if not 0 < len(letters) <= 7 or len(set(letters)) < len(letters):
        raise ValueError("one to seven different letters are needed")
    orders = F.array(*(F.lit("".join(p)) for p in permutations(letters)))
    part, step, bit, failed, before = fresh(cells.columns, "part_", "step", "bit", "failed", "before")
    x = cells.select("*", F.explode(orders).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))).alias(step))
    letter = F.substr("filter_order", F.col(step), F.lit(1))
    x = x.withColumn(bit, F.expr(f"shiftleft(1, cast(locate(substr(filter_order, {step}, 1), '{letters}') - 1 AS int))")).withColumn(failed, F.col("mask").bitwiseAND(F.col(bit)))
    earlier = Window.partitionBy("part", "mask", "tags", "filter_order").orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn(before, F.coalesce(F.bit_or(failed).over(earlier), F.lit(0)))
    total = lambda *conditions: F.sum(F.when(_all(*conditions), F.col("n")).otherwise(0))
    fails, here = F.col(failed) != 0, F.col(before) == 0
    steps = x.groupBy("part", "filter_order", step, letter.alias(part)).agg(
        total(~fails, here).alias("kept"), total(fails, here).alias("removed"), total(fails, ~here).alias("redundant"),
        total(F.col("mask") == F.col(bit)).alias("unique_fails"),
        total(fails, here, F.col("tags").bitwiseAND(F.lit(GOOD)) != 0).alias("good_lost"), total(fails, here, F.col("tags").bitwiseAND(F.lit(TOXIC)) != 0).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", part))
    return steps.select("part", "filter_order", F.col(step).alias("step"), "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley.alias("shapley"))


def _all(*conditions: Column) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


_COUNTED = {
    "kept": "failed = 0 AND before = 0",
    "removed": "failed <> 0 AND before = 0",
    "redundant": "failed <> 0 AND before <> 0",
    "unique_fails": "mask = bit",
    "good_lost": "failed <> 0 AND before = 0 AND good",
    "toxic_lost": "failed <> 0 AND before = 0 AND toxic",
}
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents
), y AS (
  SELECT doc_id, bool_or(coalesce(quality = 1, FALSE)) AS good, bool_or(coalesce(toxic = 1, FALSE)) AS toxic FROM labels GROUP BY doc_id
), m AS (
  SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)::INT AS mask
  FROM d LEFT JOIN y USING (doc_id)
), c AS (
  SELECT part, good, toxic, mask, count(*) AS n FROM m GROUP BY ALL
), l AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (
  SELECT *, 1 << (strpos('ABCDE', substr(filter_order, step, 1)) - 1) AS bit FROM c, o, (SELECT unnest(range(1, 6)) AS step)
), f AS (
  SELECT *, mask & bit AS failed, coalesce(bit_or(mask & bit) OVER (PARTITION BY part, good, toxic, mask, filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s
), g AS (
  SELECT part, filter_order, step, bit, {', '.join(f"CAST(coalesce(sum(n) FILTER ({c}), 0) AS BIGINT) AS {k}" for k, c in _COUNTED.items())}
  FROM f GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, {', '.join(_COUNTED)}, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM g
"""
