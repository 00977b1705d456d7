from __future__ import annotations

import zlib

import numpy as np

import corpus_pipeline as C
from lymphframe.llm import packing, pii
from lymphframe.llm import toxicity as X
from tests.llm.test_simhash import slow_components, slow_fingerprint


def test_registered():
    import __spark_entry__ as E

    q = E.queries()
    assert [n.split("_")[0] for n in q if n.startswith("op")] == [f"op{k}" for k in range(1, 14)] and "pipeline" in q
    assert E.oracle_sql().keys() <= q.keys()
    assert [n for n, _ in C.STAGES] == ["toxicity", "simhash_near_dedup", "suffix_array_dedup", "pii", "best_fit_packing"]


def cut_repeats(texts):
    """Brute force: bytes under a 200-byte string that starts twice go, to whole letters."""
    from collections import Counter

    data = [t.encode() for t in texts]
    c = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - 199):
            if c[d[i : i + 200]] > 1:
                gone[i : i + 200] = True
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int)]))
        kept, at = b"", 0
        for a, b in zip(edge[::2], edge[1::2]):
            while a < b and d[a] & 0xC0 == 0x80:
                a += 1
            while b > a and b < len(d) and d[b] & 0xC0 == 0x80:
                b -= 1
            kept, at = kept + d[at:a], b
        out.append((kept + d[at:]).decode())
    return out


def test_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    word = lambda: "".join(rng.choice(list("abcdeé"), rng.integers(2, 7)))
    passage = " ".join(word() for _ in range(70))
    texts = [" ".join(word() for _ in range(rng.integers(3, 150))) for _ in range(40)]
    texts += texts[:4] + [t + " " + passage + " " + word() for t in texts[5:9]] + ["you idiot " + t for t in texts[10:14]]
    texts += ["write to x.y@z.org or +1 (269) 555-3296 " + texts[20], ""]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, kind).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, int("idiot" in t)) for i, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = C.run(spark, str(tmp_path)).collect()

    docs = [(i, t) for i, t in enumerate(texts) if "idiot" not in t]
    comp = slow_components([slow_fingerprint(t) for _, t in docs], [i for i, _ in docs])
    docs = [(i, t) for (i, t), c in zip(docs, comp) if i == c]
    docs = [(i, t) for (i, _), t in zip(docs, cut_repeats([t for _, t in docs]))]
    want = set()
    for i, t in docs:
        t = pii.mask(t, pii.base_spans(t))
        ids = np.array([*packing.encoder(packing.vocabulary_path())(t), 0], "<u4")
        want |= {(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    assert X.DIVISOR == 5


def test_stages_on_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and long texts, repeated rows, clashing names: every stage but the last keeps the columns."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = "long " * 60000
    rows = [(1, "a b c d", None, "s"), (1, "a b c d", None, "s"), (None, "no id here", "en", None), (None, None, None, None), (2, None, "en", "s"), (3, "", "en", "s"), (4, long, "en", "s"), (5, long, "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars", "1 AS score", "2 AS found", "3 AS component_id", "4 AS h", "5 AS doc", "6 AS tx", "7 AS id", "8 AS spans", "9 AS node", "10 AS __doc", "11 AS __tx", "12 AS __found", "13 AS __wanted", "14 AS first", "15 AS second", "16 AS `row`", "17 AS a", "18 AS b", "map('k', 1) AS m")
    kept = {}
    for name, f in C.STAGES:
        out = f(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == docs.columns
        kept[name] = out.collect()
        empty = f(spark, docs.limit(0), str(tmp_path))
        assert empty.count() == 0
    assert len(kept["toxicity"]) == 8 and len(kept["pii"]) == 8 and len(kept["suffix_array_dedup"]) == 8
    # null and empty texts share fingerprint zero, with or without an id; the long ones are copies
    assert sorted(str(r.doc_id) for r in kept["simhash_near_dedup"]) == ["1", "2", "4", "None"]
    assert {r.text for r in kept["suffix_array_dedup"] if r.doc_id in (4, 5)} == {""} and all(r.n_chars == 0 for r in kept["suffix_array_dedup"] if r.doc_id in (3, 4, 5))
    assert {r.doc_id for r in kept["best_fit_packing"]} == {None, 1, 2, 3, 4, 5}
