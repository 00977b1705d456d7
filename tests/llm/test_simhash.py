from __future__ import annotations

import numpy as np
import xxhash

from lymphframe.llm import simhash as S


def slow_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(fps, ids):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(fps))]


def test_fingerprint_by_definition():
    for t in [None, "", " \t\n", "One", "one TWO", "A b C", "É à x y z \x0bq\x85r", "w " * 9000, "The cat sat on the mat, the cat sat on the hat"]:
        assert S.fingerprint(t) == slow_fingerprint(t)


def test_trie_links_match_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fp = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(12)] + [base]))
    child, parent = S.trie_links(np.zeros(len(fp), np.int64), fp)
    want = slow_components([int(x) for x in fp], list(range(len(fp))))
    label = np.arange(len(fp))
    label[child] = parent
    assert label.tolist() == want


def test_query_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(vocabulary, rng.integers(1, 120))) for _ in range(60)]
    texts += [t + " tail" for t in texts[:30]] + texts[:10] + [None, "", "  "] + [" ".join(["same"] * 500)] * 2
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    for hot in (S.HOT, 2):
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.near_duplicates(df, hot=hot).collect()}
        fps = [slow_fingerprint(t) for t in texts]
        comp = slow_components(fps, list(range(len(texts))))
        assert got == {i: (f"{fps[i]:016x}", comp[i]) for i in range(len(texts))}


def test_empty_and_repeated_rows(spark):
    kind = "doc_id long, text string"
    assert S.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = S.near_duplicates(spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d")], kind)).collect()
    assert [r.component_id for r in got] == [1, 1, 1]


def test_keep_one_loses_no_text(spark):
    """One row a group: rows that share an id but not a group stay, repeated rows and rows without an id don't multiply."""
    rng = np.random.default_rng(5)
    text = lambda: " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(80))
    a, b, c, d = text(), text(), text(), text()
    rows = [(1, a, 0), (1, b, 0), (5, a, 0), (5, c, 0), (5, c, 1), (5, c, 0), (None, d, 0), (None, d, 0), (None, b, 0), (2, a, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, first int")
    for _ in range(2):
        got = S.keep_one(df.repartition(3)).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("1", a), ("1", b), ("5", c), ("None", d)])
    assert S.keep_one(df).columns == df.columns and S.keep_one(df.limit(0)).count() == 0
