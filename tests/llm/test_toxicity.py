from __future__ import annotations

import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lymphframe.llm import toxicity as T

SF = "/root/testdata/sf0.01"


def read(symbols, reach=T.REACH):
    """What the composed machine puts out, read off the word places instead."""
    at = lambda *kinds: [i for i, s in enumerate(symbols) if s in kinds]
    heads = at(T.INSULT_, T.THREAT_)

    def aimed(head):
        # a verb of reporting cuts a target off from what follows it; the nearest of both counts
        return any(
            abs(t - h) <= reach and not (t < h and T.REPORT_ in symbols[t:h]) for t in at(T.TARGET_) for h in at(head)
        )

    governs = lambda kind: any(0 < h - g <= reach for g in at(kind) for h in heads)
    return len(at(T.INSULT_)), len(at(T.THREAT_)), int(aimed(T.INSULT_)), int(aimed(T.THREAT_)), int(governs(T.NEGATION_)), int(governs(T.REPORT_))


@given(st.lists(st.integers(0, 5), max_size=14))
@settings(max_examples=600, deadline=None)
def test_composed_machine_reads_as_its_rules_say(symbols):
    assert T.grammar().run(symbols) == read(symbols)


def test_grammar_arcs():
    lexicon, machine = T.Lexicon(T.INSULT, ["zork"]), T.grammar()
    f = lambda t: dict(T.features(t, lexicon, machine))
    assert f("a quiet day") == {} and f(None) == {} and f("") == {}
    assert f("You idiot! Nice day.") == {(1, 0, 1, 0, 0, 0): 1}
    assert f("not an idiot") == {(1, 0, 0, 0, 1, 0): 1}
    assert f("not at once, as far as seen, an idiot") == {(1, 0, 0, 0, 0, 0): 1}
    assert f("he said idiot") == {(1, 0, 0, 0, 0, 1): 1}
    assert f("ZORKable. kill him") == {(1, 0, 0, 0, 0, 0): 1, (0, 1, 0, 1, 0, 0): 1}


@pytest.mark.parametrize("rows", [0, 300])
def test_relations_order_the_scores(rows):
    """With and without labels, however one-sided: direct over plain over reported and negated, threats at somebody over others."""
    lexicon, machine = T.Lexicon(T.INSULT, []), T.grammar()
    learned = [(T.features("a word idiot more words" if k % 3 else "a quiet day", lexicon, machine), int(k % 3 > 0)) for k in range(rows)]
    model = T.fit(learned)
    p = lambda t: T.probability(T.features(t, lexicon, machine), model)
    assert p("You idiot") > p("idiot") > p("he said idiot") and p("idiot") > p("not an idiot")
    assert p("I will kill you") > p("kill the process and burn the disc") < 0.5 <= p("You idiot")
    assert p("you are no idiot") < p("you are an idiot")


def test_cache_is_bounded():
    lexicon = T.Lexicon([], ["z" * 70])
    assert lexicon[b"z" * 1_000_000] == T.INSULT_ and lexicon[b"y" * 1_000_000] == T.OTHER_ and not len(lexicon)


def test_lexicon_ignores_copies_and_chance():
    own = lambda k: " ".join("".join(chr(97 + (k * m + m * m) % 26) for m in range(j, j + 6)) + chr(97 + k // 26) for j in range(5))
    rows = [(f"plain text {own(k)}", 0) for k in range(300)]
    rows += [(f"bad word gronk {own(k + 300)}", 1) for k in range(30)] + [("the very same copied text rareword", 1)] * 30
    words, stems = T.learn_lexicon(rows)
    assert "gronk" in words and "rareword" not in words


def test_held_out_accuracy_and_contract(spark):
    got = T.op4_toxicity(spark, SF).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    y = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert sum(p == t for p, t in held) / len(held) >= 0.95


def test_held_out_accuracy_and_recall(spark):
    """At 0.1, on the held-out fold. A rule of one word of the learned lexicon reaches as much there (0.9855), as labels mark scattered words."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    y = {r.doc_id: r.toxic for r in labels.collect()}
    got = [(r.predicted, y[r.doc_id]) for r in T.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).where("held_out").collect()]
    assert sum(p == t for p, t in got) / len(got) > 0.975
    assert sum(p for p, t in got if t) / sum(t for _, t in got) > 0.85


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "You idiot."), (3, "You idiot."), (None, "fine"), (5, "ok " * 50000)], "doc_id long, text string").selectExpr("*", "'x' AS score")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.predicted) for r in T.toxicity(docs, none).collect()}
    assert got == {(1, 0), (2, 0), (3, 1), (None, 0), (5, 0)}
    assert T.toxicity(docs.limit(0), none).count() == 0
    assert T.drop_toxic(docs, none).count() == 4


def test_contracted_negations():
    machine, lexicon = T.grammar(), T.Lexicon(T.INSULT, [])
    arcs = lambda t: sum((k[T.ARC_NEGATION] * n for k, n in T.features(t, lexicon, machine).items()), 0)
    for text in ("You are not an idiot", "You aren't an idiot", "You AREN'T an idiot", "He isn\u2019t a loser", "I won't kill you", "they can't be idiot"):
        assert arcs(text) == 1
    assert arcs("You want an idiot") == arcs("n't. You idiot") == 0
