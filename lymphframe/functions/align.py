"""Edit scripts between two sequences, for Arrow-batched use over distinct sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def edit_script(a: str, b: str) -> tuple[int, str]:
    """(edits, script): the least edits from b to a; 'S3' substitutes place 3 of b, 'D3:2' deletes two from 3, 'I3:2' inserts two before 3; joined by •."""
    n, m = len(a), len(b)
    cost = np.zeros((n + 1, m + 1), np.int32)
    cost[:, 0], cost[0, :] = np.arange(n + 1), np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            cost[i, j] = min(cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1, j] + 1, cost[i, j - 1] + 1)
    i, j, steps = n, m, []
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                steps.append(("S", j, 1))
        elif j and cost[i, j] == cost[i, j - 1] + 1:
            j -= 1
            steps.append(("D", j, 1))
        else:
            i -= 1
            steps.append(("I", j, 1))
    out: list[list] = []
    for kind, at, k in reversed(steps):
        if out and out[-1][0] == kind and ((kind == "D" and out[-1][1] + out[-1][2] == at) or (kind == "I" and out[-1][1] == at)):
            out[-1][2] += k
        else:
            out.append([kind, at, k])
    return int(cost[n, m]), "•".join(f"{k}{p}" if k == "S" else f"{k}{p}:{c}" for k, p, c in out)


def cigar(a: str, b: str) -> str:
    """CIGAR of a against the reference b, from the least edits."""
    _, script = edit_script(a, b)
    marks = {}
    for s in filter(None, script.split("•")):
        kind, rest = s[0], s[1:].split(":")
        marks.setdefault(int(rest[0]), []).append((kind, int(rest[1]) if len(rest) > 1 else 1))
    ops: list[list] = []

    def put(kind: str, k: int) -> None:
        if k and ops and ops[-1][0] == kind:
            ops[-1][1] += k
        elif k:
            ops.append([kind, k])

    j = 0
    while j <= len(b):
        skip = 0
        for kind, k in sorted(marks.get(j, []), key=lambda x: x[0] != "I"):
            if kind == "I":
                put("I", k)
            elif kind == "D":
                put("D", k)
                skip = k
        if j < len(b) and not skip:
            put("M", 1)
        j += skip or 1
    return "".join(f"{k}{c}" for c, k in ops)


def edit_udf():
    @F.pandas_udf("comp long, edit string, cigar string")
    def f(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [(*edit_script(x, y), cigar(x, y)) for x, y in zip(a, b)]
        return pd.DataFrame(rows, columns=["comp", "edit", "cigar"])

    return f
