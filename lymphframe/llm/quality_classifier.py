"""Quality classifier: hashed word n-gram logistic regression, follow-the-regularised-leader updates.

Tokens are runs of letters, of digits and of other signs. Features are hashed unigrams and bigrams
of tokens, bigrams of token shapes (case, kind, signs as they are) and whether a token repeats the
one before; each kind's values are relative frequencies, so a score is a sparse dot product that
doesn't depend on a text's length.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import arrow_map, held_out, labelled, sigmoid
from lymphframe.session import table

DIVISOR, REMAINDER = 3, 1
#: Labelled documents used for learning, at most; hashed dimensions; passes over the sample.
SAMPLE, DIMENSIONS, PASSES = 3_000, 1 << 18, 6
#: Follow-the-regularised-leader: step, smoothing, and penalties on absolute values and squares.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
SCALE = 8.0
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
_CHUNK = 1 << 16


class _Tokens(dict):
    """Hash of a token in the upper half, hash of its shape in the lower.

    Tokens of at most WORD bytes are remembered, all forgotten when there are LIMIT of them.
    """

    LIMIT, WORD = 300_000, 64

    def __missing__(self, t: bytes) -> int:
        if t[:1].isalpha() or t[0] >= 128:
            s = t.decode("utf-8", "replace")
            shape = b"A" if s.isupper() and len(s) > 1 else b"Aa" if s[0].isupper() else b"a"
        else:
            shape = b"0" if t.isdigit() else t[:8]
        v = (xxhash.xxh32_intdigest(t.lower()) << 32) | xxhash.xxh32_intdigest(shape)
        if len(t) <= self.WORD:
            if len(self) > self.LIMIT:
                self.clear()
            self[t] = v
        return v


def features(text: str | None, tokens: _Tokens) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, value): all n-grams of the whole text, repeated dimensions allowed; none for a text without tokens."""
    found = _TOKEN.findall(text.encode("utf-8", "replace")) if text else []
    if not found:
        return np.zeros(0, np.int64), np.zeros(0)
    h = np.fromiter(map(tokens.__getitem__, found), np.uint64, len(found))
    word, shape = h >> np.uint64(32), h & np.uint64(0xFFFFFFFF)
    parts = [word * np.uint64(3), shape * np.uint64(11) + np.uint64(1)]
    if len(h) > 1:
        parts.append(word[:-1] * np.uint64(0x9E3779B1) + word[1:] * np.uint64(0x85EBCA77) + np.uint64(2))
        parts.append(shape[:-1] * np.uint64(0xC2B2AE3D) + shape[1:] * np.uint64(0x27D4EB2F) + np.uint64(3))
        parts.append(np.where(word[1:] == word[:-1], np.uint64(5), np.uint64(7)))
    index = np.concatenate([((p * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 18)).astype(np.int64) for p in parts])
    return index, np.concatenate([np.full(len(p), SCALE / len(p)) for p in parts])


def examples(rows: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    tokens = _Tokens()
    out = []
    for text, y in rows:
        index, value = features(text, tokens)
        dims, back = np.unique(index, return_inverse=True)
        out.append((dims.astype(np.int32), np.bincount(back, value, minlength=len(dims)).astype(np.float32), y))
    return out


def train_rows(rows: list[tuple[str, int]], passes: int = PASSES) -> tuple[np.ndarray, float]:
    """(weights, bias) after FTRL updates, one example at a time in a fixed shuffled order; classes weigh alike."""
    data = examples(rows)
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    ones = sum(y for *_, y in data)
    if not 0 < ones < len(data):
        return np.zeros(DIMENSIONS), 0.0
    share = {1: len(data) / (2 * ones), 0: len(data) / (2 * (len(data) - ones))}
    rng = np.random.default_rng(0)
    l1 = np.full(DIMENSIONS + 1, L1)
    l1[-1] = 0

    def weights(i):
        return np.where(np.abs(z[i]) <= l1[i], 0, -(z[i] - np.sign(z[i]) * l1[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(passes):
        for k in rng.permutation(len(data)):
            dims, value, y = data[k]
            i, x = np.r_[dims, DIMENSIONS], np.r_[value, 1.0]
            w = weights(i)
            g = (float(sigmoid(x @ w)) - y) * share[y] * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    w = weights(np.arange(DIMENSIONS + 1))
    return w[:-1], float(w[-1])


def train(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> tuple[np.ndarray, float]:
    rows = labelled(documents, labels, "quality", bound, DIVISOR, REMAINDER).select("id", "text", "y").toLocalIterator()
    return train_rows([(t, y) for _, t, y in sorted((r.id, r.text, r.y) for r in rows)])


def score(documents: DataFrame, weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row a row; a text without tokens scores by the bias alone."""
    used = np.flatnonzero(weights)
    sparse = (used, weights[used])

    def start():
        w = np.zeros(DIMENSIONS)
        w[sparse[0]] = sparse[1]
        tokens = _Tokens()

        def one(text):
            index, value = features(text, tokens)
            return float(sigmoid(bias + w[index] @ value)) if len(index) else float(sigmoid(bias))

        return lambda c: [c[0], [one(t) for t in c[1]]]

    kind = documents.schema[id_col].dataType.simpleString()
    return arrow_map(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, score double")


def quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row a row of documents, repeated rows and null ids included.

    Null texts count as empty. Columns besides doc_id and text are not read. Without labels of both
    kinds every score is 0.5.
    """
    scored = score(documents, *train(documents, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id", DIVISOR, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
