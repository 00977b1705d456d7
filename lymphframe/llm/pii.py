"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Base spans (email, ip, card, phone by fixed patterns) always stand. Further candidates come from
looser rules: runs that a base pattern swallowed and then dropped, spelled-out addresses, numbers in
groups, secrets behind a key word. Regex, gazetteer, checksum and context labelers each vote for,
against or not at all. The corpus-wide counts of vote patterns, of which there are boundedly many,
go through expectation-maximisation, which estimates how often each labeler is right without any
label; a logistic regression over votes and span figures is then fitted to the estimated
probabilities, and a candidate it puts at one half or more becomes a span unless it overlaps one.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lymphframe.llm.common import arrow_map, fresh, sigmoid
from lymphframe.session import stage, table

KINDS = ("email", "ip", "card", "phone", "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a run of digits does: from within the run it would fail like the whole.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SPELLED = re.compile(r"\b[A-Za-z0-9._-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}\b")
_GROUPS = re.compile(r"(?<![\w.+-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
_INTERNATIONAL = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3})(?![0-9])")
_CARDLIKE = re.compile(r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9-])")
_QUAD = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
_SECRET = re.compile(r"\b(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?([A-Za-z0-9+/_.-]{8,128})|\b(AKIA[0-9A-Z]{16})\b")
_HINT = re.compile(r"password|passwd|pwd|secret|token|api[_-]?key|AKIA")

#: Gazetteers and cue words (in the languages of the corpus).
ENDINGS = frozenset("com org net edu gov io de fr es uk eu info example".split())
CUES = {
    "email": "mail email e-mail contact write correo courriel schreiben".split(),
    "ip": "ip address host server adresse dirección".split(),
    "card": "card visa mastercard credit karte carte tarjeta".split(),
    "phone": "phone call tel mobile fax telefon téléphone teléfono".split(),
    "secret": "password token secret key passwort clave".split(),
}
AGAINST = "version license isbn order invoice page chapter copyright section build".split()


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start: leftmost non-overlapping matches of each kind that hold."""
    out: list[tuple[str, int, int]] = []
    last = 0  # end of the match before
    at = text.find("@")
    while at >= 0:
        # the pattern's leftmost start is as far left as letters of a local part go
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        if text.count(".") >= 3:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(q := p.lstrip("0")) <= 3 and int(q or "0") <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13:
                d = m.group().replace(" ", "").replace("-", "")
                if 13 <= len(d) <= 19 and luhn(d):
                    out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of all candidate spans, base spans left out."""
    found: list[tuple[str, int, int]] = []
    if _DIGIT.search(text):
        found += [("phone", *m.span()) for m in _GROUPS.finditer(text)]
        found += [("card", *m.span()) for m in _CARDLIKE.finditer(text)]
        if "+" in text:
            found += [("phone", *m.span()) for m in _INTERNATIONAL.finditer(text)]
        if text.count(".") >= 3:
            found += [("ip", *m.span()) for m in _QUAD.finditer(text)]
    if " at " in text or "at)" in text or "at]" in text:
        found += [("email", *m.span()) for m in _SPELLED.finditer(text)]
    if _HINT.search(text):
        found += [("secret", *m.span(1 if m.group(1) else 2)) for m in _SECRET.finditer(text)]
    return [(k, a, b, votes(text, k, a, b)) for k, a, b in dict.fromkeys(found)]


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """A vote each of the labelers: 1 for, -1 against, 0 none; then the span's length class."""
    span = text[start:end]
    digits = "".join(_DIGIT.findall(span))
    around = text[max(0, start - 40) : start].lower()
    before = re.findall(r"[\w-]+", around)[-4:]
    shape = check = gazetteer = 0
    if kind == "email":
        shape = 1 if "@" in span or re.fullmatch(r"[\w.-]+ ?[(\[]at[)\]] ?.*", span) else 0
        gazetteer = 1 if re.split(r"[ .]", span)[-1].strip("()[]").lower() in ENDINGS else -1
    elif kind == "ip":
        shape = 1
        check = 1 if all(int(p) <= 255 for p in span.split(".")) and span[0] != "0" else -1
    elif kind == "card":
        shape = 1 if len(digits) == 16 else 0
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits[0] in "3456" else -1
    elif kind == "phone":
        shape = 1 if span.startswith("+") else 0
        check = 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
    else:
        shape = 1 if span.startswith("AKIA") else 0
        check = 1 if len(set(span)) >= 8 and any(map(str.isdigit, span)) and any(map(str.isalpha, span)) else -1
        gazetteer = 1 if span.startswith("AKIA") or re.fullmatch(r"[0-9a-f]+", span) else 0
    cue = 1 if any(w in before for w in CUES[kind]) else 0
    context = -1 if any(w in before for w in AGAINST) else 0
    edge = 1 if (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum()) else -1
    return shape, check, gazetteer, cue, context, edge, min(3, (end - start) // 10)


LABELERS = 6


def code(kind: str, v: tuple[int, ...]) -> int:
    """One number for kind, votes and length class: under 5 * 3**6 * 4 exist."""
    out = KINDS.index(kind)
    for x in v[:LABELERS]:
        out = out * 3 + x + 1
    return out * 4 + v[LABELERS]


def decode(c: int) -> tuple[int, tuple[int, ...]]:
    c, size = divmod(c, 4)
    v = []
    for _ in range(LABELERS):
        c, x = divmod(c, 3)
        v.append(x - 1)
    return c, (*reversed(v), size)


#: How often a labeler is taken to be right before the counts speak, and how many spans that view is worth; checksums and ranges are known best.
RIGHT = {"card": {1: (0.98, 100.0)}, "ip": {1: (0.95, 50.0)}, "phone": {1: (0.8, 10.0)}}
USUALLY = 0.7, 8.0
#: Labelers that are never wrong when they vote against: a card number that fails its checksum isn't one, however rare or frequent.
VETO = {"card": 1}


def fit(counts: dict[int, int], rounds: int = 200) -> dict[int, float]:
    """Probability of each pattern code, from their corpus-wide counts alone.

    EM, kind by kind: two classes, labelers independent given the class, each with reliabilities of
    its own for the kind; a labeler of VETO has one of 1, so what it votes against has probability 0. What is known of a labeler beforehand counts as a set number of spans, however
    many there are, so the counts have the last word. The classifier is then fitted to the posteriors,
    weighted by counts, on each kind's votes and on lengths.
    """
    if not counts:
        return {}
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    kind, vote = zip(*(decode(k) for k in keys))
    kind = np.array(kind)
    v = np.array([x[:LABELERS] for x in vote]) + 1
    size = np.array([x[LABELERS] for x in vote])
    p, out_of_question = np.zeros(len(keys)), np.zeros(len(keys), bool)
    for k in set(kind.tolist()):
        rows = np.flatnonzero(kind == k)
        m, w = n[rows], v[rows]
        never = w[:, VETO[KINDS[k]]] == 0 if KINDS[k] in VETO else np.zeros(len(rows), bool)
        right, worth = np.array([RIGHT.get(KINDS[k], {}).get(j, USUALLY) for j in range(LABELERS)]).T
        # votes against, none, for: none says nothing
        lean = np.stack([(1 - right) * 2 / 3, np.full(LABELERS, 1 / 3), right * 2 / 3], 1)
        q = np.where(never, 0.0, sigmoid(np.log(lean / lean[:, ::-1])[np.arange(LABELERS), w].sum(1)))
        for _ in range(rounds):
            prior = (m @ q + 1) / (m.sum() + 2)
            log_odds = np.full(len(rows), np.log(prior / (1 - prior)))
            for j in range(LABELERS):
                one, zero = (np.array([(m * x)[w[:, j] == y].sum() for y in range(3)]) for x in (q, 1 - q))
                one, zero = one + worth[j] * lean[j], zero + worth[j] * lean[j, ::-1]
                log_odds += np.log(one / one.sum() / (zero / zero.sum()))[w[:, j]]
            new = np.where(never, 0.0, sigmoid(log_odds))
            done, q = np.abs(new - q).max() < 1e-9, new
            if done:
                break
        p[rows], out_of_question[rows] = q, never
    own = np.eye(len(KINDS))[kind]
    columns = [(own[:, :, None] * np.eye(3)[v[:, j]][:, None, [0, 2]]).reshape(len(keys), -1) for j in range(LABELERS)] + [own, np.eye(4)[size]]
    x = np.concatenate(columns, 1)
    w, weight = np.zeros(x.shape[1]), n / n.sum()
    for _ in range(50):
        q = sigmoid(x @ w)
        slope = x.T @ (weight * (q - p)) + 1e-5 * w
        curve = (x * (weight * (q * (1 - q) + 1e-4))[:, None]).T @ x + 1e-5 * np.eye(len(w))
        w -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return dict(zip(keys, np.where(out_of_question, 0.0, sigmoid(x @ w)).tolist()))


def chosen(base: list[tuple[str, int, int]], more: list[tuple[str, int, int, int]], model: dict[int, float]) -> list[tuple[str, int, int]]:
    """Base spans and the accepted candidates, likeliest first where they overlap, in order."""
    out = list(base)
    taken = [(a, b) for _, a, b in base]
    for k, a, b, c in sorted(more, key=lambda m: (-model.get(m[3], 0.0), m[1] - m[2], m[1], m[0])):
        if model.get(c, 0.0) >= 0.5 and not any(a < y and x < b for x, y in taken):
            out.append((k, a, b))
            taken.append((a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def told(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


_FOUND = "base string, kinds array<int>, starts array<int>, ends array<int>, codes array<int>, sure array<int>"


def scan(documents: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
    """(id, also..., base, kinds, starts, ends, codes, sure): base spans and candidates of each whole text.

    sure: the pattern codes of the base spans; they stand anyway, but tell EM what labelers agree on.
    """

    def start():
        def one(t):
            t = t or ""
            base = base_spans(t)
            have = {(k, a, b) for k, a, b in base}
            more = [c for c in candidates(t) if c[:3] not in have]
            return told(base), [KINDS.index(c[0]) for c in more], [c[1] for c in more], [c[2] for c in more], [code(c[0], c[3]) for c in more], [code(k, votes(t, k, a, b)) for k, a, b in base]

        def batch(c):
            return [*c[:-1], *map(list, zip(*map(one, c[-1])))]

        return batch

    names = [id_col, *also]
    kinds = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in names)
    return arrow_map(documents.select(*names, text_col), start, f"{kinds}, {_FOUND}")


def learn(found: DataFrame) -> dict[int, float]:
    """The model from the pattern counts of all documents; boundedly many patterns reach the driver."""
    return fit({r.c: r.n for r in found.select(F.explode(F.concat("codes", "sure")).alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()})


def parse(base: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(","))] if base else []


def personal_data(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans): one row a row of documents.

    The counts and the digest are of base spans; spans has all of them, secrets last. A null text
    has none. Offsets are code points, ends exclusive. Repeated rows and null ids are kept; other
    columns aren't read.
    """
    found = stage(scan(documents, id_col, text_col), "candidates")
    model = learn(found)

    def start():
        def one(base, kinds, starts, ends, codes):
            spans = parse(base)
            n = [sum(k == x for x, _, _ in spans) for k in KINDS[:4]]
            more = [(KINDS[k], a, b, c) for k, a, b, c in zip(kinds, starts, ends, codes)]
            return (*n, hashlib.sha256(base.encode()).hexdigest(), told(chosen(spans, more, model)))

        return lambda c: [c[0], *map(list, zip(*map(one, *c[1:6])))]

    kind = documents.schema[id_col].dataType.simpleString()
    return arrow_map(found, start, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping spans go as one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_all(documents: DataFrame, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The same rows and columns, spans masked in the text, the column of its length set anew; null texts stay null.

    Texts are read twice, once to learn and once to mask, rather than kept in between.
    """
    row = fresh([text_col], "row")[0]
    model = learn(scan(documents.select(text_col, F.lit(0).alias(row)), row, text_col))
    names = documents.columns

    def one(t: str | None) -> str | None:
        if not t:
            return t
        base = base_spans(t)
        have = set(base)
        spans = chosen(base, [(k, a, b, code(k, v)) for k, a, b, v in candidates(t) if (k, a, b) not in have], model)
        return mask(t, spans) if spans else t

    def run(batches):
        for b in batches:
            columns = dict(zip(names, b.columns))
            texts = [one(t.as_py()) for t in columns[text_col]]
            columns[text_col] = pa.array(texts, type=columns[text_col].type)
            if chars_col in columns:
                columns[chars_col] = pa.array([None if t is None else len(t) for t in texts], type=columns[chars_col].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names=names)

    return documents.mapInArrow(run, documents.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
