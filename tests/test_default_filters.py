"""The sixteen default filters in order, and with each switched off, against plain loops over cells."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lymphframe.operators import filters as K
from tests.test_operators import brute_components

LIMITS = K.Limits(cross=0.05, foursie_cells=3, weak_onesies=0.02, baseline_cells=4, umi_ratio=6, signature=4, merge_onesies=0.03, weak_chain_times=4, quality=3)
SCHEMA = "cell int, dataset string, barcode string, called boolean, umi long, top long, nchains int, parts array<struct<key:string,umi:long>>, exact string, clonotype string"


def tail(k, n):
    return sum(math.comb(n, i) * 0.1**i * 0.9 ** (n - i) for i in range(k, n + 1))


def made(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for cell in range(n):
        size = rng.choice((1, 1, 2, 2, 2, 2, 2, 3, 4, 5))
        family = rng.randrange(4)
        keys = set()
        while len(keys) < size:
            keys.add(f"{rng.choice('HL')}{family if rng.random() < 0.93 else rng.randrange(4)}{rng.choice('aaab')}")
        rare = cell % 23 == 0  # a chain of one dataset
        keys |= {"Lzz"} if rare else set()
        parts = [(k, rng.choice((1, 2, 5, 9, 30, 60, 200))) for k in sorted(keys)]
        barcode = f"{rng.choice(['AAAAAAAA', 'CCCCCCCC', f'{cell:08d}', f'x{cell:07d}'])}{cell % 97:08d}"
        rows.append((cell, "d0" if rare else f"d{rng.randrange(2)}", barcode, rng.random() > 0.1, sum(u for _, u in parts), max(u for _, u in parts), len(parts), parts, " ".join(sorted(keys)), f"c{family}"))
    return rows


def plain(rows, seen, off=(), n=LIMITS):
    """(filter, clonotype) of each cell, step by step."""
    names = [c.split()[0] for c in SCHEMA.replace("struct<key:string,umi:long>", "s").split(", ")]
    cells = {r[0]: dict(zip(names, r)) for r in rows}
    fate = dict.fromkeys(cells)
    left = lambda: [c for c in cells.values() if fate[c["cell"]] is None]
    keys = lambda c: [k for k, _ in c["parts"]]

    def drop(label, bad):
        for c in bad:
            fate[c["cell"]] = label

    def by(cs, *names_):
        out = defaultdict(list)
        for c in cs:
            out[tuple(c[x] for x in names_)].append(c)
        return out

    def cross(cs):
        total, size = len(cs), Counter(c["dataset"] for c in cs)
        where = defaultdict(list)
        for c in cs:
            for k in keys(c):
                where[k].append(c["dataset"])
        odd = {k for k, d in where.items() if len(set(d)) == 1 and (size[d[0]] / total) ** len(d) <= n.cross}
        return [c for c in cs if any(k in odd and u < n.cross_umis for k, u in c["parts"])]

    def white(cs):
        out = []
        for c in cs:
            top = max(x["umi"] for x in cs if x["dataset"] == c["dataset"] and (x["barcode"][:8] == c["barcode"][:8] or x["barcode"][-8:] == c["barcode"][-8:]))
            if top >= n.junk * c["umi"] and top > c["umi"]:
                out.append(c)
        return out

    def foursie(cs):
        pairs = lambda c: {(h, k) for h in keys(c) for k in keys(c) if h[0] == "H" and k[0] == "L"}
        common = Counter(p for c in cs if c["nchains"] == 2 for p in pairs(c))
        return [c for c in cs if c["nchains"] == 4 and any(common[p] >= n.foursie_cells for p in pairs(c))]

    def umi(cs):
        base = {}
        groups = by(cs, "clonotype")
        alone = by([c for c in cs if c["nchains"] == 2 and len(groups[c["clonotype"],]) == 1], "dataset")
        for (d,), g in alone.items():
            if len(g) >= n.baseline_cells:
                u = [c["umi"] for c in g]
                base[d] = min(np.percentile(u, 10), np.median(u) - 4 * np.sqrt(np.median(u)))
        out = []
        for g in groups.values():
            low = [c for c in g if c["dataset"] in base and c["umi"] < base[c["dataset"]]]
            if len(g) >= 2 and low and tail(len(low), len(g)) < 0.01:
                out += sorted(low, key=lambda c: (-c["umi"], c["cell"]))[1 if len(low) == len(g) else 0 :]
        return out

    def ratio(cs):
        out = []
        for g in by(cs, "clonotype").values():
            low = [c for c in g if max(x["top"] for x in g) >= n.umi_ratio * c["umi"]]
            if len(g) >= 2 and low and tail(len(low), len(g)) < 0.01:
                out += low
        return out

    def doublet(cs):
        pure = by(cs, "clonotype", "exact")
        out = []
        for p, g in pure.items():
            large = [q for q, h in pure.items() if q != p and set(keys(h[0])) & set(keys(g[0])) and n.doublet * len(g) <= len(h)]
            if any(not set(keys(pure[a][0])) & set(keys(pure[b][0])) for a, b in itertools.combinations(large, 2)):
                out += g
        return out

    def signature(cs):
        g = by([c for c in cs if c["nchains"] == 2], "exact")
        out = []
        for e, members in g.items():
            others = sum(len(h) * len(set(keys(h[0])) & set(keys(members[0]))) for f, h in g.items() if f != e)
            if others and others >= n.signature * len(members):
                out += members
        return out

    def weak(cs):
        out = []
        for g in by(cs, "clonotype").values():
            support = Counter(k for c in g for k in keys(c))
            bad = {k for k, s in support.items() if len(support) >= 3 and s <= n.weak_chain_cells and n.weak_chain_times * s < len(g)}
            out += [c for c in g if bad & set(keys(c))]
        return out

    def reform(cs):
        edges, low = [], {}
        node = lambda c: f"{c['clonotype']}|{c['exact']}"
        for c in cs:
            for k in keys(c):
                edges.append((low.setdefault((c["clonotype"], k), node(c)), node(c)))
        label = brute_components(edges) if edges else {}
        for c in [*cs]:
            c["new"] = label.get(node(c), node(c))
        for c in cs:
            c["clonotype"] = c.pop("new")

    def split(cs):
        g = by([c for c in cs if c["nchains"] == 1], "exact")
        for members in g.values():
            if keys(members[0])[0][0] == "L" and len(members) < n.weak_onesies * len(cs):
                for c in members:
                    c["clonotype"] = f"{c['clonotype']}#{c['cell']}"

    def merge(cs):
        into = {}
        for c in cs:
            if c["nchains"] > 1:
                for k in keys(c):
                    into[k] = min(c["clonotype"], into.get(k, c["clonotype"]))
        for members in by([c for c in cs if c["nchains"] == 1], "exact").values():
            if len(members) >= n.merge_onesies * len(cs):
                for c in members:
                    c["clonotype"] = into.get(keys(c)[0], c["clonotype"])

    steps = [
        ("NCELL", "CELL", lambda cs: [c for c in cs if not c["called"]]), ("NMAX", "MAX_CONTIGS", lambda cs: [c for c in cs if c["nchains"] > n.contigs]), ("NCROSS", "CROSS", cross),
        ("NBC_DUP", "BC_DUP", lambda cs: [c for g in by(cs, "exact", "barcode").values() if len(g) > 1 for c in g]), ("NWHITEF", "WHITEF", white), ("NFOURSIE_KILL", "FOURSIE", foursie),
        ("NIMPROPER", "IMPROPER", lambda cs: [c for c in cs if c["nchains"] > 1 and len({k[0] for k in keys(c)}) == 1]), ("NWEAK_ONESIES", None, split), ("NUMI", "UMI", umi), ("NUMI_RATIO", "UMI_RATIO", ratio),
        ("NGEX", "GEX", lambda cs: [c for c in cs if c["cell"] not in seen]), ("NDOUBLET", "DOUBLET", doublet), ("NDOUBLET", None, reform), ("NSIG", "SIGNATURE", signature), ("NMERGE_ONESIES", None, merge),
        ("NWEAK_CHAINS", "WEAK_CHAINS", weak), ("NWEAK_CHAINS", None, reform), ("NQUAL", "QUAL", lambda cs: [c for c in cs if c["top"] < n.quality]),
    ]
    for switch, label, f in steps:
        if switch not in off:
            if label:
                drop(label, f(left()))
            else:
                f(left())
    return {c: (fate[c], cells[c]["clonotype"]) for c in cells}


SWITCHES = "NCELL NMAX NCROSS NBC_DUP NWHITEF NFOURSIE_KILL NIMPROPER NWEAK_ONESIES NUMI NUMI_RATIO NGEX NDOUBLET NSIG NMERGE_ONESIES NWEAK_CHAINS NQUAL".split()


def run(spark, rows, seen, off=()):
    called = spark.createDataFrame([(c,) for c in seen], "cell int")
    out = K.run_chain(spark.createDataFrame(rows, SCHEMA), K.default_filters(called, LIMITS), off).collect()
    assert len(out) == len(rows)
    return {r.cell: (r.filter, r.clonotype) for r in out}


def test_every_filter_in_order(spark):
    rows = made(8)
    seen = set(random.Random(8).sample(range(260), 235))
    want = plain(rows, seen)
    assert run(spark, rows, seen) == want
    hit = Counter(f for f, _ in want.values())
    labels = {s.label for s in K.default_filters(spark.createDataFrame([], "cell int")) if isinstance(s, K.Step)}
    assert labels - {"UMI", "UMI_RATIO"} <= set(hit) and hit[None] > 30


def test_each_switch(spark):
    """Every other filter off, then the rest."""
    rows = made(3, 200)
    seen = set(range(0, 200)) - {5, 50, 120}
    for k in range(2):
        off = SWITCHES[k::2]
        assert run(spark, rows, seen, off) == plain(rows, seen, off)
    assert {f for f, _ in run(spark, rows, seen, ["NALL"]).values()} == {None}
    with pytest.raises(ValueError):
        K.active(K.default_filters(spark.createDataFrame([], "cell int")), ["NOSUCH"])


def test_group_filters(spark):
    """Filters that random cells seldom meet, on cells made for each, apart in chains, clonotypes and datasets."""
    rows = []

    def put(case, n, *keys, u=50, alone=False):
        for _ in range(n):
            i = len(rows)
            own = [f"{k[0]}{case}{k[1]}" for k in keys]
            rows.append((i, f"d{case}", f"b{i:015d}", True, u * len(own), u, len(own), [(k, u) for k in own], " ".join(own), f"{case}{i if alone else ''}"))

    put("p", 10, "Ha", "La"), put("p", 12, "Hb", "Lb"), put("p", 2, "Ha", "Lb")  # doublets
    put("q", 12, "Ha", "La"), put("q", 1, "Ha", "Lb")  # signature
    put("r", 12, "Ha", "La"), put("r", 2, "Ha", "La", "Lb")  # weak chains
    put("s", 3, "Ha", "La", u=100), put("s", 5, "Ha", "La", u=2)  # umi ratio
    put("t", 20, "Ha", "La", u=100, alone=True), put("t", 5, "Hb", "Lb", u=3)  # umi
    off = [s for s in SWITCHES if s not in ("NDOUBLET", "NSIG", "NWEAK_CHAINS", "NUMI_RATIO", "NUMI")]
    want = plain(rows, set(), off)
    assert run(spark, rows, set(), off) == want
    assert {f for f, _ in want.values()} == {None, "DOUBLET", "SIGNATURE", "WEAK_CHAINS", "UMI_RATIO", "UMI"}
