"""The registry of variables: a name gives its family, parameters, suffix, class and level."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: The catalogue's plain names by class and level.
LEAD = {
    "cell": "barcode nbc filter clust type",
    "cell-exact": "datasets donors origins gex n n_gex n_b n_other mark entropy cred mem sec",
    "exact": "barcodes dref dref_max dref_aa exact_subclonotype_id far near nchains_present inkt mait hcomp jun_ins jun_mat jun_sub",
    "clono": "clonotype_id clonotype_ncells nchains",
    "group": "group_id group_ncells dist_center",
    "global": "d_inconsistent_% d_inconsistent_n",
}
CHAIN = {
    "cell-exact": "u r",
    "exact": "aa% dna% allele allele_d cdiff cdr3_start cigar clen comp const const_id d1_name d1_score d2_name d2_score d_delta d_Δ d_donor d_frame d_start d_univ edit notes seq udiff ulen utr_id utr_name v_name_orig v_start var_aa vj_aa vj_aa_nl vj_seq vj_seq_nl vjlen white nval nnval nival valumis nvalumis ivalumis valbcumis nvalbcumis ivalbcumis",
    "clono": "cdr3_aa_conp cdr3_aa_conx d_id d_name j_id j_name v_id v_name share_indices_aa share_indices_dna var var_indices_aa var_indices_dna",
}
#: Parametric names: pattern, class, level.
PATTERNS = [
    (r"cdr(?P<k>[123])_(?P<what>aa|dna|len)", "chain", "exact"),
    (r"fwr(?P<k>[1234])_(?P<what>aa|dna|len)", "chain", "exact"),
    (r"(?P<region>cdr[123]|fwr[1234])_(?P<what>aa|dna)_ref", "chain", "clono"),
    (r"cdr(?P<k>[123])_aa_(?P<left>-?[0-9]+)_(?P<right>-?[0-9]+)_ext", "chain", "exact"),
    (r"cdr(?P<k>[123])_aa_north", "chain", "exact"),
    (r"q(?P<at>[0-9]+)_", "chain", "exact"),
    (r"ndiff(?P<nth>[1-9][0-9]*)vj", "chain", "exact"),
    (r"count_(?P<region>cdr[123]?|fwr[1234]?)_(?P<motif>.+)", "lead", "exact"),
    (r"count_(?P<motif>.+)", "lead", "exact"),
    (r"g(?P<d>[0-9]+)", "lead", "exact"),
    (r"nd(?P<k>[1-9][0-9]*)", "lead", "clono"),
    (r"(?P<kind>pe|npe|ppe)(?P<n>[0-9]+)", "lead", "cell-exact"),
    (r"n_(?P<name>.+)", "lead", "cell-exact"),
    (r"(?P<feature>.+)_cellular_(?P<of>[ru])", "lead", "dataset"),
    (r"(?P<dataset>.+)_barcodes?", "lead", "exact"),
]
SUFFIXES = ("_mean", "_μ", "_sum", "_Σ", "_min", "_max", "_cell", "_%_cell", "_%")


@dataclass(frozen=True)
class Variable:
    """A parsed name; chain: the column number for chain variables with one."""

    name: str
    family: str
    kind: str
    level: str
    suffix: str = ""
    chain: int | None = None
    params: tuple[tuple[str, str], ...] = ()
    alias: str | None = None


def parse(text: str, features: frozenset[str] = frozenset(), fields: frozenset[str] = frozenset()) -> Variable:
    """The variable that a name stands for; 'abbr:name' renames. Raises on a name that none fits.

    features: names of a feature matrix; fields: user-defined cell fields.
    """
    alias, _, name = text.rpartition(":")
    base = dict(alias=alias or None)
    plain = {n: (kind, level) for kind, t in (("lead", LEAD), ("chain", CHAIN)) for level, names in t.items() for n in names.split()}
    for n in (name, name.rstrip("0123456789")):
        if n in plain:
            kind, level = plain[n]
            if n == name or kind == "chain":
                return Variable(name, n, kind, level, chain=int(name[len(n) :]) if n != name else None, **base)
    if name in fields:
        return Variable(name, "field", "lead", "cell", **base)
    for s in sorted(SUFFIXES, key=len, reverse=True):
        if name.endswith(s):
            stem = name[: -len(s)]
            if stem in features:
                return Variable(name, "feature", "lead", "cell" if s.endswith("_cell") else "exact", s, params=(("feature", stem),), **base)
            try:
                v = parse(stem, features, fields)
            except ValueError:
                continue
            if v.level == "cell-exact" and not v.suffix:
                return Variable(name, v.family, v.kind, "cell" if s == "_cell" else "exact", s, v.chain, v.params, alias or None)
    if name in features:
        return Variable(name, "feature", "lead", "cell-exact", params=(("feature", name),), **base)
    for pattern, kind, level in PATTERNS:
        m = re.fullmatch(pattern, name)
        chain = None
        if not m and kind == "chain" and (c := re.fullmatch(r"(.*?)([0-9]+)", name)):
            m, chain = re.fullmatch(pattern, c[1]), int(c[2])
        if m:
            return Variable(name, pattern.split("(")[0] or "named", kind, level, chain=chain, params=tuple(m.groupdict().items()), **base)
    raise ValueError(f"unknown variable: {name}")


def default_columns(chains: int, gex: bool) -> list[str]:
    """All plain output columns: identifiers, lead variables, chain variables for each column; expression ones only with a matrix."""
    lead = [n for names in LEAD.values() for n in names.split() if gex or n not in ("gex", "n_gex", "entropy", "cred", "clust")]
    return ["group_id", "group_ncells", "clonotype_id", "exact_subclonotype_id", *dict.fromkeys(n for n in lead if n not in ("group_id", "group_ncells", "clonotype_id", "exact_subclonotype_id")), *(f"{n}{k}" for k in range(1, chains + 1) for names in CHAIN.values() for n in names.split())]
