"""URL filter: host and path rules, and for the rest a ratio of two character language models.

URLs that a rule allows or blocks are the models' text: variable-order Markov models of up to ORDER
letters of context, interpolated by Witten-Bell smoothing, one for either verdict. Counts are taken
over all URLs, as tables of distinct windows; a window's log-likelihood difference is worked out once
and joined to the URLs that hold it. A URL's sum over its letters, divided by their number, is
compared with a threshold calibrated on ruled URLs that the counts left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lymphframe.session import stage, table

#: Letters of context; windows are one longer.
ORDER = 4
#: Marks before the first letter and after the last, from the private use area.
START, END = "\ue000", "\ue001"
#: Differences are summed in units of 1 / UNIT nats, so that no sum depends on its order.
UNIT = 1 << 20
#: Width of a bin of the calibration histogram, 1/256 nat, and the bins' ends.
BIN, ENDS = UNIT >> 8, 4096
#: Windows that hold this share of all places or more are at most as many; they are broadcast, others are shuffled.
HEAVY = 1 << 14
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(*lines: str) -> list[Rule]:
    """Rules of lines like 'block example.org/es/'; the longest comes first, of equals the one with the longer host, then blocks."""
    out = []
    for line in lines:
        verdict, _, rest = line.partition(" ")
        host, slash, path = rest.partition("/")
        if verdict not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line}")
        out.append(Rule(verdict, host, slash + path))
    return sorted(out, key=lambda r: (-len(r.name), -len(r.host), r.verdict != "block", r.name))


RULES = rules("allow org/", "block example.org/es/", "block example.org/en/1", "allow com/fr/", "block com/de/")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def scored_text(url: Column) -> Column:
    """What the models read: the host in lower case and all that follows it; without '://' the URL as it is, nothing for null."""
    rest = F.regexp_extract(url, r"(?s)://[^/?#]*(.*)", 1)
    return F.coalesce(F.when(F.contains(url, F.lit("://")), F.concat(host_of(url), rest)).otherwise(url), F.lit(""))


def ruled(host: Column, path: Column, by: list[Rule] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or a domain above it and the path's start; null fields without one."""
    hits = [(host.isin(r.host) | host.endswith("." + r.host)) & path.startswith(r.path) for r in by]
    pick = lambda value: F.coalesce(*(F.when(hit, F.lit(value(r))) for hit, r in zip(hits, by)), F.lit(None).cast("string"))
    return F.struct(pick(lambda r: r.name).alias("rule"), pick(lambda r: r.verdict).alias("verdict"))


def windows(text: Column, order: int = ORDER) -> Column:
    """Array of one window a letter, the end mark's included: the letter and the `order` ones before it."""
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    return F.regexp_extract_all(padded, F.lit(rf"(?s)(?=(.{{{order + 1}}}))."), F.lit(1))


def _level(grams: DataFrame, below: DataFrame, k: int) -> DataFrame:
    """(w, allow, block, n, p_allow, p_block) of windows of k + 1 letters, from those of k letters."""
    context = Window.partitionBy(F.expr(f"left(w, {k})"))  # no more rows than letters of the alphabet
    x = grams.select("*", *(f(c).over(context).alias(f"{m}_{c}") for c in ("allow", "block") for m, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))))
    low = below.select(F.col("w").alias("low"), F.col("p_allow").alias("q_allow"), F.col("p_block").alias("q_block"))
    x = x.join(low, F.expr(f"right(w, {k})") == F.col("low"))
    return x.select("w", "allow", "block", "n", *(F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}")).alias(f"p_{c}") for c in ("allow", "block")))


def differences(grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(w, n, d): each window's log-likelihood difference, allow over block, in units of 1 / UNIT.

    grams: (w, allow, block, n), windows of order + 1 letters with their counts in either text and in
    all URLs. A context that a model hasn't seen passes its shorter one's probability on; under the
    shortest, all letters of the table are equally likely.
    """
    levels = [grams]
    for k in range(order, 0, -1):
        levels.append(levels[-1].groupBy(F.expr(f"right(w, {k})").alias("w")).agg(*(F.sum(c).alias(c) for c in ("allow", "block", "n"))))
    levels.reverse()
    totals = levels[0].agg(F.count("*").alias("v"), *(f(c).alias(f"{m}_{c}") for c in ("allow", "block") for m, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))))
    x = levels[0].crossJoin(F.broadcast(totals))  # one row
    probability = lambda c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * (F.lit(1.0) / F.col("v"))) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.lit(1.0) / F.col("v"))
    x = x.select("w", "allow", "block", "n", *(probability(c).alias(f"p_{c}") for c in ("allow", "block")))
    for k, grams in enumerate(levels[1:], 1):
        x = _level(grams, x, k)
    return x.select("w", "n", F.floor((F.log("p_allow") - F.log("p_block")) * UNIT + 0.5).alias("d"))


def threshold(histogram: list[tuple[int, str, int]]) -> int:
    """The bin from which URLs are allowed: the best mean of the shares judged right of either verdict, nearest to 0 among equals.

    histogram: (bin, verdict, count). Without URLs of both verdicts it is 0.
    """
    counts = {v: np.zeros(2 * ENDS + 2, np.int64) for v in ("allow", "block")}
    for b, v, n in histogram:
        counts[v][b + ENDS] += n
    allow, block = counts["allow"], counts["block"]
    if not allow.sum() or not block.sum():
        return 0
    above = allow.sum() - np.concatenate([[0], np.cumsum(allow)[:-1]])  # at this bin or beyond
    below = np.concatenate([[0], np.cumsum(block)[:-1]])
    value = above / allow.sum() + below / block.sum()
    bins = np.arange(-ENDS, ENDS + 2)
    return int(bins[np.lexsort((bins, np.abs(bins), -value))[0]])


def scores(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(page_id, h, score): the mean difference a letter of each (page_id, h), h the hash of its text, in units of 1 / UNIT, floored.

    rows: (page_id, h, text, copies, use); use: 'allow' or 'block' where the text counts for a model.
    """
    places = rows.select("page_id", "h", "copies", "use", F.explode(windows(F.col("text"), order)).alias("w"))
    use = lambda v: F.sum(F.when(F.col("use") == v, F.col("copies")).otherwise(0)).alias(v)
    grams = stage(places.groupBy("w").agg(use("allow"), use("block"), F.sum("copies").alias("n")), "grams")
    d = stage(differences(grams, order), "differences")
    total = d.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(d.where(F.col("n").cast("double") * HEAVY >= total).select("w", "d"))  # HEAVY rows at most, as their n add up to no more than total
    x = places.select("page_id", "h", "w").join(heavy, "w", "left")
    rest = x.where("d IS NULL").select("page_id", "h", "w").join(d.where(F.col("n").cast("double") * HEAVY < total).select("w", "d"), "w")
    parts = [y.groupBy("page_id", "h").agg(F.sum("d").alias("d"), F.count("*").alias("n")) for y in (x.where("d IS NOT NULL"), rest)]
    both = parts[0].unionByName(parts[1]).groupBy("page_id", "h").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return both.select("page_id", "h", F.floor(F.col("d") / F.col("n")).alias("score"))


def judge(pages: DataFrame, by: list[Rule] = RULES, order: int = ORDER) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): one row a row of pages, repeated rows and null ids included.

    Null URLs and those without '://' have empty host and path, and no rule that names a host fits
    them; the models judge them like any others, a null or empty one by the end mark alone. score is
    the mean log-likelihood difference a letter in nats; the threshold isn't taken off. Repeated rows
    count for the models as often as they stand. Other columns of pages aren't read; without ruled
    URLs of both verdicts the threshold is 0, and without any all scores are 0 and verdicts allow.
    """
    p = pages.select("page_id", F.col("url").cast("string").alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("copies"))
    p = p.select("page_id", "copies", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), scored_text(F.col("url")).alias("text"), F.xxhash64("url").alias("h"))
    p = p.withColumn("r", ruled(F.col("host"), F.col("path"), by)).select("*", "r.rule", "r.verdict").drop("r")
    spare = F.substring(F.md5(F.col("text").cast("binary")), 1, 1) < "4"  # a quarter of the texts calibrates
    p = stage(p.withColumn("spare", spare), "urls")
    found = scores(p.withColumn("use", F.when(~F.col("spare"), F.col("verdict"))), order)
    found = found.select(F.col("page_id").alias("id"), F.col("h").alias("g"), "score")
    out = stage(p.join(found, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g"))), "scored")
    held = F.least(F.greatest(F.floor(F.col("score") / BIN), F.lit(-ENDS)), F.lit(ENDS))
    out = out.withColumn("bin", held)
    # 2 * (2 * ENDS + 1) rows at most
    counted = out.where("spare AND verdict IS NOT NULL").groupBy("bin", "verdict").agg(F.sum("copies").alias("n")).collect()
    least = threshold([(r.bin, r.verdict, r.n) for r in counted])
    verdict = F.coalesce("verdict", F.when(F.col("bin") >= least, "allow").otherwise("block"))
    rows = out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (F.col("score") / UNIT).alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("copy"))
    return rows.drop("copy")


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _oracle(by: list[Rule] = RULES, order: int = ORDER) -> str:
    lower = f"translate(regexp_extract(url, '(?s)://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    fits = lambda r: f"(host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}')"
    cases = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in by) + " END"
    level = lambda k: (
        f"g{k} AS (SELECT right(w, {k + 1}) AS w, sum(allow) AS allow, sum(block) AS block FROM grams GROUP BY 1), "
        f"c{k} AS (SELECT *, sum(allow) OVER (PARTITION BY left(w, {k})) AS n_allow, count(*) FILTER (allow > 0) OVER (PARTITION BY left(w, {k})) AS t_allow, "
        f"sum(block) OVER (PARTITION BY left(w, {k})) AS n_block, count(*) FILTER (block > 0) OVER (PARTITION BY left(w, {k})) AS t_block FROM g{k}), "
        f"p{k} AS (SELECT c.w, "
        + ", ".join(
            f"CASE WHEN n_{v} > 0 THEN (CAST(c.{v} AS DOUBLE) + CAST(t_{v} AS DOUBLE) * {q.format(v=v)}) / (CAST(n_{v} AS DOUBLE) + CAST(t_{v} AS DOUBLE)) ELSE {q.format(v=v)} END AS p_{v}"
            for v in ("allow", "block")
            for q in (("b.p_{v}" if k else "(1.0::DOUBLE / (SELECT count(*) FROM g0))"),)
        )
        + f" FROM c{k} c"
        + (f" JOIN p{k - 1} b ON right(c.w, {k}) = b.w" if k else "")
        + ")"
    )
    return f"""
WITH u AS (
  SELECT page_id, count(*) AS copies, coalesce({lower}, '') AS host, coalesce(regexp_extract(url, '(?s)://[^/?#]*([^?#]*)', 1), '') AS path,
         coalesce(CASE WHEN contains(url, '://') THEN {lower} || regexp_extract(url, '(?s)://[^/?#]*(.*)', 1) ELSE url END, '') AS text, url
  FROM pages GROUP BY page_id, url
), r AS (
  SELECT *, {cases(lambda r: r.name)} AS rule, {cases(lambda r: r.verdict)} AS ruled, substr(md5(text), 1, 1) < '4' AS spare, row_number() OVER () AS k FROM u
), places AS (
  SELECT k, copies, CASE WHEN NOT spare THEN ruled END AS use, substr(repeat('{START}', {order}) || text || '{END}', i, {order + 1}) AS w
  FROM (SELECT *, unnest(range(1, length(text) + 2)) AS i FROM r)
), grams AS (
  SELECT w, sum(CASE WHEN use = 'allow' THEN copies ELSE 0 END) AS allow, sum(CASE WHEN use = 'block' THEN copies ELSE 0 END) AS block FROM places GROUP BY w
), {", ".join(level(k) for k in range(order + 1))}, d AS (
  SELECT w, CAST(floor((ln(p_allow) - ln(p_block)) * {UNIT} + 0.5) AS BIGINT) AS d FROM p{order}
), s AS (
  SELECT k, floor(CAST(sum(d) AS DOUBLE) / count(*)) AS score FROM places JOIN d USING (w) GROUP BY k
), b AS (
  SELECT *, CAST(least(greatest(floor(score / {BIN}), -{ENDS}), {ENDS}) AS BIGINT) AS bin FROM r JOIN s USING (k)
), h AS (
  SELECT bin, ruled, CAST(sum(copies) AS DOUBLE) AS n FROM b WHERE spare AND ruled IS NOT NULL GROUP BY ALL
), t AS (
  SELECT t, sum(CASE WHEN ruled = 'allow' AND bin >= t THEN n ELSE 0 END) / sum(CASE WHEN ruled = 'allow' THEN n ELSE 0 END)
            + sum(CASE WHEN ruled = 'block' AND bin < t THEN n ELSE 0 END) / sum(CASE WHEN ruled = 'block' THEN n ELSE 0 END) AS value
  FROM h, range(-{ENDS}, {ENDS + 2}) q(t) GROUP BY t
), best AS (
  SELECT coalesce((SELECT t FROM t WHERE isfinite(value) ORDER BY value DESC, abs(t), t LIMIT 1), 0) AS least
)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN bin >= least THEN 'allow' ELSE 'block' END) AS verdict, score / {UNIT} AS score
FROM (SELECT *, unnest(range(copies)) AS copy FROM b), best
"""


ORACLE = _oracle()
