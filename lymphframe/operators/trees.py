"""Trees of clonotypes: distances, neighbour joining, rooting, Newick and text forms."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def neighbour_joining(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (u, v, length) of the unrooted tree over leaves 0..n-1, inner vertices from n on; negative lengths count as 0.

    Of equally good pairs the first in row order is joined; n leaves give 2n - 3 edges (n >= 3).
    """
    n = len(dist)
    if n < 2:
        return []
    d = dist.astype(float).copy()
    names, edges, fresh = list(range(n)), [], n
    while len(names) > 2:
        m = len(names)
        total = d.sum(1)
        q = (m - 2) * d - total[:, None] - total[None, :]
        q[np.tril_indices(m)] = np.inf
        i, j = np.unravel_index(int(np.argmin(q)), q.shape)
        a = d[i, j] / 2 + (total[i] - total[j]) / (2 * (m - 2))
        edges += [(fresh, names[i], max(0.0, a)), (fresh, names[j], max(0.0, d[i, j] - a))]
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(m) if k not in (i, j)]
        d = np.block([[d[np.ix_(keep, keep)], row[keep][:, None]], [row[keep][None, :], np.zeros((1, 1))]])
        names = [names[k] for k in keep] + [fresh]
        fresh += 1
    return [*edges, (names[1], names[0], max(0.0, d[0, 1]))]


def rooted(edges: list[tuple[int, int, float]], root: int = 0) -> list[tuple[int, int, float]]:
    """The edges as (parent, child, length), breadth first from the root."""
    near: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
        near.setdefault(v, []).append((u, w))
    out, seen, todo = [], {root}, deque([root])
    while todo:
        u = todo.popleft()
        for v, w in sorted(near.get(u, [])):
            if v not in seen:
                seen.add(v)
                out.append((u, v, w))
                todo.append(v)
    return out


def newick(tree: list[tuple[int, int, float]], names: dict[int, str], root: int = 0) -> str:
    """Newick text, lengths with two decimals; vertices without a name are I<k>."""
    below: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in tree:
        below.setdefault(u, []).append((v, w))
    name = lambda v: names.get(v, f"I{v}")
    text: dict[int, str] = {}
    for u in [v for _, v, _ in reversed(tree)] + [root]:
        inner = ",".join(f"{text[v]}:{w:.2f}" for v, w in below.get(u, []))
        text[u] = f"({inner}){name(u)}" if inner else name(u)
    return text[root] + ";"


def text_tree(tree: list[tuple[int, int, float]], names: dict[int, str], root: int = 0) -> str:
    """An indented listing, one vertex a line."""
    below: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in tree:
        below.setdefault(u, []).append((v, w))
    lines, todo = [], [(root, 0.0, 0)]
    while todo:
        v, w, depth = todo.pop()
        lines.append("  " * depth + (f"{names.get(v, f'I{v}')} [{w:.2f}]" if depth else names.get(v, f"I{v}")))
        todo += [(c, x, depth + 1) for c, x in reversed(below.get(v, []))]
    return "\n".join(lines)


def base_distances(seqs: list[str]) -> np.ndarray:
    """Differing places of each pair, over the shorter length."""
    m = np.zeros((len(seqs), len(seqs)))
    for i, a in enumerate(seqs):
        for j in range(i):
            m[i, j] = m[j, i] = sum(x != y for x, y in zip(a, seqs[j]))
    return m


def clonotype_trees(members: DataFrame, group: str, name: str, seq: str) -> DataFrame:
    """(group, parent, child, length, newick): a tree a group, rooted at its first member by name.

    A group is one clonotype's distinct sequences, which are few; null and repeated sequences are left out.
    """
    kind = members.schema[group].dataType.simpleString()
    rows = members.select(group, name, seq).where(f"`{seq}` is not null").dropDuplicates([group, seq])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(name)
        names = dict(enumerate(pdf[name].astype(str)))
        tree = rooted(neighbour_joining(base_distances(list(pdf[seq]))))
        text = newick(tree, names)
        show = lambda v: names.get(v, f"I{v}")
        return pd.DataFrame([(pdf[group].iloc[0], show(u), show(v), float(w), text) for u, v, w in tree], columns=[group, "parent", "child", "length", "newick"])

    return rows.groupBy(group).applyInPandas(one, f"`{group}` {kind}, parent string, child string, length double, newick string")
