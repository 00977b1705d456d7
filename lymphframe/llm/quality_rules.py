"""Quality rules: base statistics of a text and gradient-boosted trees over them.

Trees are grown on the labels' logistic loss from histograms; on chosen features a score may only
fall (repetition, symbols, lines and words in capitals) as the feature rises. All trees lie in
flat node arrays, so a batch is scored level by level without a loop over rows.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import arrow_map, label_sample, sigmoid
from lymphframe.session import stage, table

#: Labelled documents used for learning, at most (a row of figures each).
SAMPLE = 20_000
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Features of the trees, and the direction in which quality may move as each rises (0: either).
FEATURES = {"log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "same_next_share": -1, "bang_share": -1, "upper_share": -1, "stop_share": 0, "distinct_share": 0}
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the trees' features of a whole text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    letters = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        first: dict = {}
        marked = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j != i:
                marked[i : i + 3] = marked[j : j + 3] = b"\1\1\1"
        repeat = marked.count(1)
    m = max(1, n)
    same = sum(map(bytes.__eq__, words, words[1:]))
    stop = sum(text.count(c) for c in ".,")
    figures = [float(np.log1p(n)), letters / m, symbols / m, dup / (text.count("\n") + 1), repeat / m, same / m, text.count("!") / m, len(_CAPITAL.findall(text)) / max(1, letters), stop / m, len(set(words)) / m]
    return n, letters, symbols, dup, repeat, figures


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 3, bins: int = 32, rate: float = 0.2, ridge: float = 1.0) -> dict:
    """Boosted trees as node arrays: feature (-1 at a leaf), threshold, left child (right is next), value, and roots.

    A split that would go against a feature's sign is not taken, and what the children may be worth
    is bounded by the midpoint, so the whole score is monotonic in the signed features.
    """
    model: dict[str, list] = {"feature": [], "threshold": [], "left": [], "value": []}
    roots: list[int] = []
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    score = np.full(len(y), base)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(y) else []
    code = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if len(y) else x.astype(int)

    def node(rows: np.ndarray, g: np.ndarray, h: np.ndarray, at: int, left: int, low: float, high: float) -> None:
        total_g, total_h = g[rows].sum(), h[rows].sum()
        worth = float(np.clip(-total_g / (total_h + ridge), low, high))
        best = (1e-6, -1, 0, 0.0, 0.0)
        if left and len(rows) >= 8:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                gs, hs = (np.cumsum(np.bincount(code[rows, f], v[rows], k))[:-1] for v in (g, h))
                c = np.cumsum(np.bincount(code[rows, f], minlength=k))[:-1]
                a, b = np.clip(-gs / (hs + ridge), low, high), np.clip(-(total_g - gs) / (total_h - hs + ridge), low, high)
                gain = -(gs * a + 0.5 * (hs + ridge) * a * a) - ((total_g - gs) * b + 0.5 * (total_h - hs + ridge) * b * b) + (total_g * worth + 0.5 * (total_h + ridge) * worth * worth)
                gain[(c < 4) | (len(rows) - c < 4) | (signs[f] * (b - a) < 0)] = -1
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, i, float(a[i]), float(b[i]))
        if best[1] < 0:
            model["value"][at] = rate * worth
            score[rows] += rate * worth
            return
        _, f, i, a, b = best
        child = len(model["feature"])
        for v, k in ((-1, "feature"), (0.0, "threshold"), (0, "left"), (0.0, "value")):
            model[k] += [v, v]
        model["feature"][at], model["threshold"][at], model["left"][at] = f, float(edges[f][i]), child
        middle = (a + b) / 2
        below = code[rows, f] <= i
        for r, c, s in ((rows[below], child, 0), (rows[~below], child + 1, 1)):
            lo, hi = low, high
            if signs[f]:
                up = (signs[f] > 0) == bool(s)
                lo, hi = (max(lo, middle), hi) if up else (lo, min(hi, middle))
            node(r, g, h, c, left - 1, lo, hi)

    if len(y) and 0 < y.sum() < len(y):
        for _ in range(trees):
            p = sigmoid(score)
            roots.append(len(model["feature"]))
            for v, k in ((-1, "feature"), (0.0, "threshold"), (0, "left"), (0.0, "value")):
                model[k].append(v)
            node(np.arange(len(y)), p - y, p * (1 - p), roots[-1], depth, -8.0, 8.0)
    return {k: np.array(v) for k, v in model.items()} | {"roots": np.array(roots, int), "base": base if len(y) else 3.0, "depth": depth}


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of quality 1, for all rows and trees at once."""
    at = np.repeat(model["roots"][None, :], len(x), 0)
    if at.size:
        row = np.arange(len(x))[:, None]
        for _ in range(model["depth"]):
            f = model["feature"][at]
            at = np.where(f < 0, at, model["left"][at] + (x[row, np.maximum(f, 0)] > model["threshold"][at]))
        return sigmoid(model["base"] + model["value"][at].sum(1))
    return sigmoid(np.full(len(x), model["base"]))


def rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score).

    One row a row of documents, repeated rows and null ids included; a null text has no words.
    base_failed: under 50 words, or over half the words in repeated 3-word windows. kept: not
    base_failed, and the trees' score is at least 0.5. Columns besides doc_id and text aren't read.
    Without labels of both kinds, the base rules alone decide unless all labels are 0.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def start():
        def batch(c):
            s = [statistics(t) for t in c[1]]
            return [c[0], *([r[k] for r in s] for k in range(6))]

        return batch

    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, figures array<double>"
    stats = stage(arrow_map(documents.select("doc_id", "text"), start, schema), "statistics")
    # the sample has a proven bound: SAMPLE rows of a few numbers
    sample = stats.join(F.broadcast(label_sample(labels, "quality", SAMPLE)), stats.doc_id == F.col("id")).groupBy("id").agg(F.min("figures").alias("x"), F.first("y").alias("y")).orderBy("id").collect()
    model = grow(np.array([r.x for r in sample]).reshape(len(sample), len(FEATURES)), np.array([r.y for r in sample], float), list(FEATURES.values()))

    def judged(batches):
        for b in batches:
            x = b.column("figures").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(predict(model, x))], names=[*b.schema.names[:6], "score"])

    out = stats.mapInArrow(judged, schema.rpartition(",")[0] + ", score double")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("score") >= 0.5)).alias("kept"), "score")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
