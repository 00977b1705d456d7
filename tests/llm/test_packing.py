from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lymphframe.llm import packing as P


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.vocabulary_path())


def test_ids_equal_the_library(tokenizer):
    texts = ["", " ", "Hello  world\n\n x ", "it's we'LL don't 12345 ½² ñandú 東京 <|endoftext|> \t  z", "a" * 500, "!!!??? ...", "  x\r\n", "é" * 300, "word " * 3000]
    enc = P.encoder(P.vocabulary_path())
    for t in texts:
        assert enc(t) == tokenizer.encode(t, add_special_tokens=False).ids


@given(st.lists(st.one_of(st.sampled_from(["<|endoftext|>", "<|endoftext|", "|>", " ", "  ", "\n", "'s", "a", "1"]), st.text(st.characters(codec="utf-8"), max_size=6)), max_size=10))
@settings(max_examples=400, deadline=None)
def test_ids_equal_the_library_with_special_tokens_in_texts(tokenizer, parts):
    t = "".join(parts)
    assert P.encoder(P.vocabulary_path())(t) == tokenizer.encode(t, add_special_tokens=False).ids


def test_pair_index():
    counts = np.zeros(21, int)
    counts[[3, 5, 7, 10]] = 4, 1, 9, 2
    index = P.Pairs(counts)
    assert index.find(10, counts, []) == [3, 7] and index.find(20, counts, []) == [10, 10] and index.find(19, counts, []) is None and index.find(6, counts, []) == [3, 3]
    assert index.find(10, counts, [5]) == [3, 7] and index.find(12, counts, [5]) is None and index.find(4, counts, []) is None


def test_cut():
    assert P.cut(1) == [(0, 1)] and P.cut(2048) == [(0, 2048)] and P.cut(4096) == [(0, 2048), (2048, 2048)]
    assert P.cut(4100) == [(0, 4), (4, 2048), (2052, 2048)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_whole_and_tight(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 50, 3000, 3000, 20000][seed]
    lengths = np.minimum(2048, rng.integers(1, 2049, n) if seed % 2 else (rng.exponential(400, n).astype(int) + 1))
    counts = np.bincount(lengths, minlength=2049)
    found = P.plan(counts)
    back = np.zeros(2049, int)
    for bins, parts in found:
        assert bins > 0 and sum(k * m for k, m in parts) <= 2048
        for k, m in parts:
            back[k] += bins * m
    assert (back == counts).all()
    assert sum(b for b, _ in found) <= -(-int(lengths.sum()) // 2048) * 1.02 + 1 or seed == 1


def test_query(spark, tokenizer):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 999, rng.integers(1, 900))) for _ in range(80)] + [None, "", "x y " * 5000, "same", "same", "a <|endoftext|> b", "<|endoftext|>" * 3000]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (7, texts[7], 0)]
    got = P.pack(spark.createDataFrame(rows, "doc_id long, text string, offset int")).collect()
    want = defaultdict(int)
    for d, t, _ in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], np.dtype("<u4"))
        for k, (s, n) in enumerate(P.cut(len(ids))):
            want[d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    back = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        back[tuple(r)[:5]] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert back == want
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 2048
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 2048) + 2


def test_empty(spark):
    assert P.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_first_ranks(spark):
    rng = np.random.default_rng(7)
    n = {(k, t): int(c) for k in range(1, 40) for t in range(9) if (c := rng.integers(0, 5))}
    rows = [(None, k, t, c) for (k, t), c in n.items()]
    got = P.firsts(spark.createDataFrame(rows, "piece int, length long, task int, nth long").repartition(5)).collect()
    assert {(r.of, r.by): r.base for r in got} == {(k, t): sum(n.get((k, u), 0) for u in range(t)) for k, t in n} and len(got) == len(n)
    totals = [(r.of, r.total) for r in got if r.total is not None]
    assert sorted(totals) == [(k, sum(c for (x, _), c in n.items() if x == k)) for k in sorted({k for k, _ in n})]


def test_ranks_take_no_memory_pages(spark):
    """Aggregates, windows and sorts take pages of megabytes a task; with hundreds of short tasks they filled the heap."""
    store, args = spark.sparkContext._jsc.sc().statusStore(), spark._jvm.java.util.ArrayList

    def peaks():
        found = store.stageList(args(), False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), args())
        return {s.stageId(): s.peakExecutionMemory() for s in (found.apply(k) for k in range(found.size()))}

    docs = spark.createDataFrame([(i, "x y " * (i % 50)) for i in range(400)], "doc_id long, text string").repartition(6)
    docs.count()
    before = peaks()
    assert P.pack(docs).count() == 400
    made = {k: v for k, v in peaks().items() if k not in before}
    assert len(made) > 3 and max(made.values()) < 1 << 20, made


def test_many_shuffle_partitions_make_no_small_files(spark):
    docs = spark.createDataFrame([(i, "x y " * (i % 50)) for i in range(400)], "doc_id long, text string").repartition(6)
    wanted = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        got = P.pack(docs)
        assert got.rdd.getNumPartitions() <= 6 and got.count() == 400
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
