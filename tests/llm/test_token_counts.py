from __future__ import annotations

import re
from functools import lru_cache

from hypothesis import given, settings
from hypothesis import strategies as st

from lymphframe.llm import token_counts as T


def greedy(word, initial, continuing):
    at, n = 0, 0
    while at < len(word):
        pieces = initial if at == 0 else continuing
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


words = st.text(alphabet="abc", min_size=1, max_size=9)


@settings(max_examples=400, deadline=None)
@given(st.sets(st.text(alphabet="abc", min_size=1, max_size=5), max_size=8), st.sets(st.text(alphabet="abc", min_size=1, max_size=5), max_size=8), st.lists(words, min_size=1, max_size=12))
def test_automaton_equals_greedy_match(initial, continuing, tried):
    m = T.LongestMatch(initial, continuing)
    for w in tried:
        assert m.count(w) == greedy(w, initial, continuing)


def test_frames(spark):
    initial, continuing = T.vocabulary()
    rows = [(1, "Hello worlds 東x"), (1, "Hello worlds 東x"), (2, None), (None, " \t"), (3, "a" * 4000 + " b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS n_words")
    want = sorted((i or 0, len((t or "").split()), sum(greedy(w, initial, continuing) for w in (t or "").split())) for i, t in rows)
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in T.token_counts(df).collect()) == want
    assert T.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    """Every whole text of the table."""
    initial, continuing = T.vocabulary()
    slow = lru_cache(None)(lambda w: greedy(w, initial, continuing))
    got = T.op8_token_counts(spark, "/root/testdata/sf0.001").collect()
    text = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(got) == len(text)
    for r in got:
        w = re.findall(r"[^\x20\x09-\x0D]+", text[r.doc_id])
        assert (r.n_words, r.n_tokens) == (len(w), sum(map(slow, w)))


def test_cache_is_bounded():
    c = T.Counts(T.LongestMatch({"a"}, {"a"}))
    assert c[b"a" * 1_000_000] == 1_000_000 and not c and c[b"aa"] == 2 and c == {b"aa": 2}
