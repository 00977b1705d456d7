from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lymphframe.llm import sentencepiece_codec as C


@pytest.fixture(scope="module")
def c():
    return C.Codec()


def unigram_model(path):
    """The model file with its type set to unigram, so that the library's Viterbi decodes the same scores."""
    data = open(path, "rb").read()

    def varint(at):
        v = shift = 0
        while True:
            b = data[at]
            v |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return v, at

    at, out = 0, bytearray()
    while at < len(data):
        begin = at
        tag, at = varint(at)
        size, at = varint(at)
        body = data[at : at + size]
        at += size
        if tag >> 3 == 2:  # the trainer's settings; field 3 is the type
            body += bytes([3 << 3, 1])
            out += bytes([tag])
            n = len(body)
            while n > 127:
                out.append(n & 127 | 128)
                n >>= 7
            out.append(n)
            out += body
        else:
            out += data[begin:at]
    return bytes(out)


def test_equals_the_library_as_unigram_model(c):
    import public_tokenizers
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_proto=unigram_model(public_tokenizers.path(C.VOCABULARY)))
    texts = ["Hello world", "The quick  brown fox.", "à la carte, señor", "x", "aaaa aaa aa", "year 2024 / 12", "thanedble antion onea"]
    for t in texts:
        ours = np.frombuffer(c.encode([t])[0], "<u4").tolist()
        theirs = lib.encode(t)
        total = lambda ids: sum(c.score.get(c.pieces[i], c.low) for i in ids)
        assert "".join(c.pieces[i] for i in ours) == "".join(c.pieces[i] for i in theirs)
        assert ours == theirs or total(ours) == pytest.approx(total(theirs))


def slow_best(c, w):
    best = [0.0] + [-np.inf] * len(w)
    for e in range(1, len(w) + 1):
        for s in range(e):
            v = c.score.get(w[s:e], c.low if e == s + 1 else None)
            if v is not None:
                best[e] = max(best[e], best[s] + v)
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abetnd éß東\n", min_size=0, max_size=30), max_size=8))
def test_best_score_and_round_trip(texts):
    c = C.codec(None)
    for t, x in zip(texts, c.encode(texts)):
        assert c.decode(x) == t
        marked = c.marked(t)
        assert "".join(c.split(marked)) == marked
        ids = np.frombuffer(x, "<u4").tolist()
        total = bytes_ = 0
        for i in ids:
            if i in c.is_byte:
                bytes_ += c.is_byte[i] & 0xC0 != 0x80
            else:
                total += c.score[c.pieces[i]]
        if t:
            assert total + bytes_ * c.low == pytest.approx(slow_best(c, marked))


def test_frames(spark):
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "  x  y "), (4, "w" * 3000), (5, "é\t\n ¼ 東")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS ids")
    back = C.decode(C.encode(df)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((i or 0, t or "") for i, t in rows)
    assert C.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    got = C.op1_sentencepiece(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200 and all(r.restored for r in got)


def test_cache_is_bounded(monkeypatch):
    """Texts without spaces are words as long as they are; they are forgotten after their batch."""
    monkeypatch.setattr(C, "_LETTERS", 1000)
    c = C.Codec()
    first = c.encode(["short words", "x" * 50_000])
    assert not c.words and c.encode(["short words"]) == first[:1] and c.words
