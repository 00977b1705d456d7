from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest

from lymphframe.llm import suffix_dedup as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    c = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - 199):
            if c[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(v for v, g in zip(d, gone) if not g)
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def make(seed, n):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdeéñ"), rng.integers(2, 7)))
    text = lambda k: " ".join(word() for _ in range(k))
    base = [text(rng.integers(5, 200)) for _ in range(n)]
    passage = text(80)
    out = list(base)
    out += [b[: len(b) // 2] + " " + passage + " " + b[len(b) // 2 :] for b in base[:8]]
    out += [base[0]] * 3 + [base[1].replace("a", "b", 1), "ab " * 400, "xyz " * 30 + text(10), None, "", "é" * 99, "é" * 150, "x" * 5000]
    out += [base[2][: 150 + k] for k in range(0, 60, 10)]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_array_and_prefixes(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 5, 9, 300, 3000):
        x = rng.integers(0, 3, n).astype(np.uint8)
        if n > 1000:
            x[1000:1500] = x[:500]
            x[2000:2400] = 0
        k8 = S.words8(x)
        sa, rank = S.suffix_array(x, k8)
        raw = x.tobytes()
        assert sa.tolist() == sorted(range(n), key=lambda p: raw[p:])
        lcp = S.common_prefixes(x, k8, sa)
        for i in range(1, n):
            a, b = raw[sa[i - 1] :], raw[sa[i] :]
            want = next((k for k, (u, v) in enumerate(zip(a, b)) if u != v), min(len(a), len(b)))
            assert lcp[i] == want


@pytest.mark.parametrize("limit", [10**6, 3000])
def test_shards_merge_by_binary_search(limit):
    rng = np.random.default_rng(3)
    common = bytes(rng.integers(97, 123, 230).astype(np.uint8))
    rows = []
    for k in range(40):
        own = bytes(rng.integers(97, 100, 100).astype(np.uint8))
        text = own + common[:k] + common + own[:30] if k % 2 and k < 30 else own + own + own
        rows.append((7 if k < 30 else k, k, 1, len(text) - 199, text, 0))
    want = Counter()
    for key, *_, text, _ in rows:
        want.update((key if key == 7 else 0, text[i : i + 200]) for i in range(len(text) - 199))
    got = {ph: spans for _, ph, _, spans in S.shard_rows(iter(rows), limit)}
    for key, h, _, n, text, _ in rows:
        if key == 7:
            expected = [want[(7, text[i : i + 200])] > 1 for i in range(n)]
            spans = got.get(h, [])
            assert expected == [any(a <= i < b for a, b in zip(spans[::2], spans[1::2])) for i in range(n)]


@pytest.mark.parametrize("hot", [S.HOT, 3])
def test_query_against_brute_force(spark, hot):
    texts = make(5, 30)
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int")
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df, hot=hot).collect()}
    want = brute(texts)
    assert got == dict(enumerate(want))


def test_kept_text_cuts_no_letter(spark):
    texts = ["é" * 150 + "tail", "x" + "é" * 150, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in S.remove_repeats(df, keep_text=True).collect():
        assert "�" not in r.kept


def test_empty_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert S.remove_repeats(spark.createDataFrame([], kind)).count() == 0
    t = "word " * 3 + "".join(chr(97 + i * i % 26) for i in range(300))
    got = S.remove_repeats(spark.createDataFrame([(1, t), (1, t), (None, t[:100])], kind)).collect()
    assert sorted(r.n_removed for r in got) == [0, len(t), len(t)]


def test_one_key_takes_linear_time():
    """Pieces of one key that fill many shards: four times the pieces, nowhere near sixteen times the seconds."""
    import time

    rng = np.random.default_rng(6)
    core = bytes(rng.integers(97, 123, 190).astype(np.uint8))
    took = []
    for n in (250, 1000):
        texts = [bytes(rng.integers(97, 123, 500).astype(np.uint8)) + core + bytes(rng.integers(97, 123, 510).astype(np.uint8)) for _ in range(n)]
        texts[-1] = texts[0][:700] + texts[1][-300:]
        began = time.process_time()
        got = list(S.shard_rows(iter([(7, k, 1, len(t) - 199, t, 1) for k, t in enumerate(texts)]), 30_000))
        took.append(time.process_time() - began)
        assert {r[1] for r in got} == {0, 1, n - 1}
    assert took[1] < 8 * took[0]


def test_many_near_copies_of_one_text(spark):
    """A group of near copies whose keys are split at both levels, against brute force."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefg"), 6)) for _ in range(120)]
    texts = []
    for k in range(160):
        w = list(words)
        w[rng.integers(0, 120)] = f"edit{k}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for hot in (100, 4):
        got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df, hot=hot).collect()}
        assert got == dict(enumerate(brute(texts)))


def test_very_long_texts_against_brute_force(spark):
    """Texts of 300,000 letters that share a passage with themselves and with each other, and one of a single letter."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcdefghij "), n))
    passage = word(700)
    texts = [word(150_000) + passage + word(150_000), word(90_000) + passage + word(300) + passage, "z" * 30_000, word(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in S.remove_repeats(df).collect()}
    assert got[0].n_removed == 700 and got[0].n_spans == 1 and got[1].n_removed == 1400 and got[1].n_spans == 2
    assert got[2].n_removed == 30_000 and got[3].n_removed == 0 and all(got[k].n_bytes == len(t) for k, t in enumerate(texts))
