"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words map to classes: insult, threat, target, negation, reported speech, other. Insults come from a
seed list and from the labels: words, and stems with any ending, that occur in toxic documents and
hardly elsewhere. Transducers, one a relation, pass other classes on and put out an arc when they
meet what they look for: an insult or a threat (a head), a target within reach of a head on either
side, a negation or a verb of reporting that a head follows within reach. Their composition is one
machine that reads a clause's classes; the clause's weight is the sum of its arcs' weights, not
under 0. Arc weights start from set values and move as far as the labels tell: a target always adds
to a head, a negation and a report always take away from it. A clause without a head weighs nothing.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import arrow_map, held_out, labelled, sigmoid
from lymphframe.session import table

DIVISOR, REMAINDER = 5, 0
#: Labelled documents used for learning, at most.
SAMPLE = 6_000
#: Seed words. The lists only start the grammar; labels add to the insults.
INSULT = "idiot moron loser scum trash stupid worthless pathetic disgusting clown imbecile dumbass jerk".split()
THREAT = "kill hurt destroy strangle shoot stab burn beat töten umbringen tuer frapper matar golpear".split()
TARGET = "you your yours yourself he she they them him her people all du dich ihr euch sie tu toi vous te tú usted ustedes".split()
NEGATION = "not no never none without nicht kein keine nie ne pas jamais nunca ningún sin".split()
REPORT = "said says say told called quoted wrote reported claims sagte sagt dit disait dijo dice".split()
OTHER_, INSULT_, THREAT_, TARGET_, NEGATION_, REPORT_ = range(6)
#: Words over which a negation, a report or a target bears on a head.
REACH = 4
#: Arcs that transducers put out, what they weigh before labels speak, and where labels may move them.
ARC_INSULT, ARC_THREAT, ARC_AT_INSULT, ARC_AT_THREAT, ARC_NEGATION, ARC_REPORT = range(6)
PRIOR = np.array([1.5, 0.2, 1.0, 2.5, -1.2, -0.6])
LEAST, MOST = np.array([0.1, 0.0, 0.3, 1.0, -6.0, -6.0]), np.array([6.0, 1.0, 6.0, 6.0, -0.5, -0.3])
SLOPE, BIAS = 2.4, -2.4

_SPACES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CLAUSE = re.compile(r"[.!?;:\n]+")
#: A contracted negation, with either apostrophe: "aren't" reads as "are not".
_CONTRACTED = re.compile(r"n['\u2019]t\b", re.IGNORECASE)


class Transducer:
    """Deterministic machine over word classes: arcs[state][symbol] = (next state, arcs put out)."""

    def __init__(self, arcs: list[list[tuple[int, tuple[int, ...]]]]):
        self.arcs = arcs

    def compose(self, other: "Transducer") -> "Transducer":
        """Run both on one input: states are pairs, what they put out joins."""
        number, arcs, todo = {(0, 0): 0}, [], [(0, 0)]
        for a, b in todo:
            row = []
            for (x, v), (y, w) in zip(self.arcs[a], other.arcs[b]):
                if (x, y) not in number:
                    number[x, y] = len(number)
                    todo.append((x, y))
                row.append((number[x, y], v + w))
            arcs.append(row)
        return Transducer(arcs)

    def run(self, symbols) -> tuple[int, ...]:
        """How often each arc is put out."""
        state, out = 0, [0] * len(PRIOR)
        for s in symbols:
            state, found = self.arcs[state][s]
            for k in found:
                out[k] += 1
        return tuple(out)


def seen(symbol: int, arc: int) -> Transducer:
    """Each word of the class puts out the arc."""
    return Transducer([[(0, (arc,) if s == symbol else ()) for s in range(6)]])


def governed(symbol: int, arc: int, reach: int = REACH) -> Transducer:
    """Puts out the arc once, when a head follows the class by at most `reach` words."""
    done = reach + 1  # states: 0 far from it, k - 1 words since it, done: found
    rows = []
    for state in range(done):
        far = (state + 1 if 0 < state < reach else 0, ())
        rows.append([(1, ()) if s == symbol else (done, (arc,)) if s in (INSULT_, THREAT_) and state else far for s in range(6)])
    return Transducer([*rows, [(done, ())] * 6])


def aimed(head: int, arc: int, reach: int = REACH) -> Transducer:
    """Puts out the arc once, when a target and the head lie at most `reach` words apart, in either order.

    A target before a verb of reporting is the speaker and not aimed at.
    """
    place: dict = {(0, 0): 0}  # (words since a target, words since a head); 0: out of reach
    rows: list = []
    done = -1
    todo = [(0, 0)]
    for t, h in todo:
        row = []
        for s in range(6):
            if (s == head and t) or (s == TARGET_ and h):
                row.append((done, (arc,)))
                continue
            t2 = 1 if s == TARGET_ else 0 if s == REPORT_ or not 0 < t < reach else t + 1
            h2 = 1 if s == head else h + 1 if 0 < h < reach else 0
            if (t2, h2) not in place:
                place[t2, h2] = len(place)
                todo.append((t2, h2))
            row.append((place[t2, h2], ()))
        rows.append(row)
    last = len(rows)
    return Transducer([[(last if x == done else x, v) for x, v in row] for row in rows] + [[(last, ())] * 6])


def grammar() -> Transducer:
    machine = seen(INSULT_, ARC_INSULT)
    for part in (seen(THREAT_, ARC_THREAT), aimed(INSULT_, ARC_AT_INSULT), aimed(THREAT_, ARC_AT_THREAT), governed(NEGATION_, ARC_NEGATION), governed(REPORT_, ARC_REPORT)):
        machine = machine.compose(part)
    return machine


class Lexicon(dict):
    """Class of a word given as bytes; stems stand for every word that begins with them.

    Words are remembered up to LIMIT of at most WORD bytes each, so the memory has a bound.
    """

    LIMIT, WORD = 200_000, 64

    def __init__(self, insults: list[str], stems: list[str]):
        super().__init__()
        self.fixed = {w.encode(): k for k, ws in ((TARGET_, TARGET), (NEGATION_, NEGATION), (REPORT_, REPORT), (THREAT_, THREAT), (INSULT_, insults)) for w in ws}
        self.stems = {s.encode() for s in stems}
        self.lengths = sorted({len(s) for s in self.stems})

    def __missing__(self, word: bytes) -> int:
        k = self.fixed.get(word, OTHER_)
        if k == OTHER_ and any(word[:n] in self.stems for n in self.lengths):
            k = INSULT_
        if len(word) <= self.WORD:
            if len(self) > self.LIMIT:
                self.clear()
            self[word] = k
        return k


def features(text: str | None, lexicon: Lexicon, machine: Transducer) -> dict[tuple[int, ...], int]:
    """Clauses with a head, counted by the arcs they put out; empty for a text without one."""
    words = (text or "").encode("utf-8", "replace").translate(_SPACES).split()
    if not any(lexicon[w] in (INSULT_, THREAT_) for w in set(words)):
        return {}
    out: Counter = Counter()
    for clause in _CLAUSE.split(text):
        symbols = [lexicon[w] for w in _CONTRACTED.sub(" not", clause).encode("utf-8", "replace").translate(_SPACES).split()]
        if INSULT_ in symbols or THREAT_ in symbols:
            out[machine.run(symbols)] += 1
    return out


def families(texts: list[str], hashes: int = 6) -> list[int]:
    """A number for each of the (boundedly many) sample texts, equal for copies and near copies.

    Texts that share one of `hashes` least values of differently mixed hashes of their 3-word
    shingles are joined.
    """
    parent = list(range(len(texts)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    mix = np.random.default_rng(1).integers(1, 2**63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)
    first: dict = {}
    for i, text in enumerate(texts):
        w = (text or "").encode("utf-8", "replace").translate(_SPACES).split()
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w)) if w else np.zeros(1, np.uint64)
        with np.errstate(over="ignore"):
            if len(h) > 2:
                h = (h[:-2] * mix[0] + h[1:-1]) * mix[1] + h[2:]
            for k, m in enumerate(mix):
                x = h * m
                j = root(first.setdefault((k, int((x ^ (x >> np.uint64(32))).min())), i))
                parent[root(i)] = j
    return [root(i) for i in range(len(texts))]


def learn_lexicon(rows: list[tuple[str, int]], chance: float = 1e-7) -> tuple[list[str], list[str]]:
    """Insult words and stems (4 to 8 letters): those that stay with toxic documents more than chance allows.

    A word or stem counts once for all documents of one family (see families()), so that copies
    don't count as evidence. It is taken if at least 9 in 10 of its families are toxic and a
    binomial tail at the toxic share, at most `chance`, says that this is no accident.
    """

    def found_in(text: str) -> set[str]:
        """Words after a 'w', stems after an 's'."""
        words = {w.decode("utf-8", "replace") for w in (text or "").encode("utf-8", "replace").translate(_SPACES).split()}
        return {"w" + w for w in words if len(w) >= 3} | {"s" + w[:k] for w in words for k in range(4, min(9, len(w) + 1))}

    often: Counter = Counter()  # a count alone first: only what is in three toxic documents is looked at closely
    for text, y in rows:
        if y:
            often.update(found_in(text))
    #: Families that hold it in documents of label 0, of label 1, in either: three numbers each, however many families there are.
    held = {f: [0, 0, 0] for f, k in often.items() if k >= 3}
    del often
    sign = families([t for t, _ in rows])
    labelled_as: tuple[set, set] = (set(), set())
    for s, (_, y) in zip(sign, rows):
        labelled_as[y].add(s)
    for _, family in groupby(sorted(range(len(rows)), key=sign.__getitem__), key=sign.__getitem__):
        seen: tuple[set, set] = (set(), set())
        for i in family:
            seen[rows[i][1]].update(found_in(rows[i][0]) & held.keys())
        for k, found in enumerate((*seen, seen[0] | seen[1])):
            for f in found:
                held[f][k] += 1
    share = min(0.5, max(0.02, len(labelled_as[1]) / max(1, len(labelled_as[0] | labelled_as[1]))))

    def strong(against: int, k: int, n: int) -> bool:
        if k < 3 or against * 9 > k:
            return False
        tail = sum(math.comb(n, i) * share**i * (1 - share) ** (n - i) for i in range(k, n + 1))
        return tail <= chance

    best = {f for f, found in held.items() if strong(*found)}
    words = sorted(f[1:] for f in best if f[0] == "w")
    stems = set()
    for stem in sorted(f[1:] for f in best if f[0] == "s"):
        full = held["s" + stem][1]
        while longer := [f[1:] for f in best if f[0] == "s" and len(f) == len(stem) + 2 and f[1:].startswith(stem) and held[f][1] >= 0.97 * full]:
            stem = longer[0]  # as long as it takes in the same documents
        if full > 1.2 * held.get("w" + stem, (0, 0, 0))[1]:
            stems.add(stem)
    return words, sorted(s for s in stems if not any(s[:k] in stems for k in range(4, len(s))))


def evidence(f: dict[tuple[int, ...], int], arcs: np.ndarray) -> float:
    """Weight of a text's clauses; a clause weighs the sum of its arcs, not under 0."""
    return sum(n * max(0.0, float(np.dot(c, arcs))) for c, n in f.items())


def fit(rows: list[tuple[dict[tuple[int, ...], int], int]], steps: int = 600, hold: float = 0.25) -> dict:
    """Arc weights, slope and bias: log odds are bias + slope * log(1 + evidence).

    Starts at the set values and is held to them by a normal prior of precision `hold`, so an arc
    that the labels don't show keeps its weight; each step is cut back to LEAST and MOST.
    """
    w = np.r_[PRIOR, SLOPE, BIAS]
    start, low, high = w.copy(), np.r_[LEAST, 0.5, -8.0], np.r_[MOST, 8.0, 2.0]
    y = np.array([v for _, v in rows], float)
    if len(y) and 0 < y.sum() < len(y):
        kinds = sorted({c for f, _ in rows for c in f})
        arcs = np.array(kinds, float).reshape(-1, len(PRIOR))
        n = np.array([[f.get(c, 0) for c in kinds] for f, _ in rows], float).reshape(len(y), -1)
        mean, square = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            weight = arcs @ w[:-2]
            e = n @ np.maximum(weight, 0)
            off = (sigmoid(w[-1] + w[-2] * np.log1p(e)) - y) / len(y)
            slope = np.r_[((off * w[-2] / (1 + e)) @ n * (weight > 0)) @ arcs, off @ np.log1p(e), off.sum()] + hold / len(y) * np.r_[w[:-1] - start[:-1], 0]
            mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
            w = np.clip(w - 0.05 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9), low, high)
    return {"arcs": w[:-2].tolist(), "slope": float(w[-2]), "bias": float(w[-1])}


def probability(f: dict[tuple[int, ...], int], model: dict) -> float:
    return float(sigmoid(model["bias"] + model["slope"] * math.log1p(evidence(f, np.array(model["arcs"])))))


def train(documents: DataFrame, labels: DataFrame, bound: int = SAMPLE, divisor: int = DIVISOR, remainder: int = REMAINDER) -> dict:
    """Lexicon and weights from at most `bound` labelled documents outside the held-out fold."""
    found = labelled(documents, labels, "toxic", bound, divisor, remainder).select("id", "text", "y").toLocalIterator()
    rows = [(t, y) for _, t, y in sorted((r.id, r.text, r.y) for r in found)]
    words, stems = learn_lexicon(rows)
    lexicon, machine = Lexicon([*INSULT, *words], stems), grammar()
    return {"words": [*INSULT, *words], "stems": stems} | fit([(features(t, lexicon, machine), y) for t, y in rows])


def score(documents: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): one row a row; null and empty texts score as texts without a match."""

    def start():
        lexicon, machine = Lexicon(model["words"], model["stems"]), grammar()
        return lambda c: [c[0], [probability(features(t, lexicon, machine), model) for t in c[1]]]

    kind = documents.schema[id_col].dataType.simpleString()
    return arrow_map(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), start, f"id {kind}, score double")


def drop_toxic(documents: DataFrame, labels: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The same columns, without the rows that score `least` or more; no shuffle."""
    model = train(documents, labels)
    place = documents.columns.index(text_col)

    def run(batches):
        lexicon, machine = Lexicon(model["words"], model["stems"]), grammar()
        for b in batches:
            keep = [probability(features(t.as_py(), lexicon, machine), model) < least for t in b.column(place)]
            yield b.filter(pa.array(keep, type=pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row a row of documents, repeated rows and null ids included.

    Null texts count as empty. Columns besides doc_id and text are not read. With no usable label
    the seed lists alone decide.
    """
    scored = score(documents, train(documents, labels)).withColumnRenamed("id", "doc_id")
    return scored.select("doc_id", held_out("doc_id", DIVISOR, REMAINDER).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
