from __future__ import annotations

import json

import pytest

from lymphframe.sources import readers as R
from lymphframe.sources import references as Q


def fasta(path, genes, tail=""):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(f">{k}|{name} x|V|L\n{seq}\n" for k, name, seq in genes) + tail)
    return str(path)


def contigs(path, *annotations):
    """One contig a list of (id, name, length)."""
    path.write_text(json.dumps([{"barcode": str(k), "annotations": [{"annotation_length": n, "feature": {"feature_id": i, "gene_name": g}} for i, g, n in a]} for k, a in enumerate(annotations)]))
    return str(path)


OLD = [(1, "IGHV1", "ACGT" * 5), (2, "IGHV2", "AACC" * 5), (3, "IGHJ1", "GG" * 6)]
NEW = [(1, "IGHV1", "ACGT" * 5), (2, "IGHV2", "AACC" * 6), (3, "IGHJ9", "GG" * 6)]


@pytest.fixture()
def known(spark, tmp_path):
    return {n: R.reference(spark, fasta(tmp_path / f"{n}.fa", g)) for n, g in (("old", OLD), ("new", NEW), ("again", NEW))}


def test_contigs_decide(spark, tmp_path, known):
    path = lambda *a: contigs(tmp_path / "c.json", *a)
    both, old, new = (1, "IGHV1", 20), (2, "IGHV2", 20), (3, "IGHJ9", 12)
    assert Q.reference_of_contigs(spark, path([both, both], [both, new], [old]), known) == "new"
    assert Q.reference_of_contigs(spark, path([both, old, new]), known) == "old"
    # what comes after the decision doesn't count
    assert Q.reference_of_contigs(spark, path([old], [], [(9, "x", 1)]), known) == "old"
    for bad in ([both, (9, "x", 1), old],), ([both], [], [old]), ([both],), ():
        with pytest.raises(ValueError):
            Q.reference_of_contigs(spark, path(*bad), known)


def test_folders(spark, tmp_path):
    fasta(tmp_path / "a/outs/vdj_reference/fasta/regions.fa", OLD)
    fasta(tmp_path / "a/regions.fa", NEW)  # the first place counts
    fasta(tmp_path / "b/regions.fa", OLD)
    fasta(tmp_path / "c/vdj_reference/fasta/regions.fa", NEW)
    (tmp_path / "d").mkdir()
    at = lambda *f: [str(tmp_path / x) for x in f]
    assert Q.agreed_reference(spark, at("a/multi/vdj_b", "b", "d")).endswith("a/outs/vdj_reference/fasta/regions.fa")
    assert Q.agreed_reference(spark, at("d")) is None
    with pytest.raises(ValueError, match="different"):
        Q.agreed_reference(spark, at("a", "c"))


def test_order_of_sources(spark, tmp_path, known):
    names = lambda df: sorted(r.name for r in df.collect())
    fasta(tmp_path / "a/regions.fa", OLD)
    given = fasta(tmp_path / "mine.fa", [(7, "IGKV7", "ACGT")])
    folder, path = [str(tmp_path / "a")], contigs(tmp_path / "c.json", [(3, "IGHJ9", 12)])
    assert "IGHJ9" in names(Q.resolve_reference(spark, folder, path, known, given, built_in="new"))
    assert names(Q.resolve_reference(spark, folder, path, known, given)) == ["IGKV7"]
    assert "IGHJ1" in names(Q.resolve_reference(spark, folder, path, known))
    assert "IGHJ9" in names(Q.resolve_reference(spark, [str(tmp_path)], path, known))
    with pytest.raises(ValueError, match="mouse"):
        Q.resolve_reference(spark, folder, path, known, mouse=True)
    with pytest.raises(ValueError, match="no reference"):
        Q.resolve_reference(spark, [str(tmp_path)])


def test_clusters_and_projection(spark, tmp_path):
    (tmp_path / "clusters.csv").write_text("Barcode,Cluster\nA-1,3\nB-1,x\n")
    assert sorted(map(tuple, R.clusters(spark, str(tmp_path / "clusters.csv")).collect())) == [("A-1", 3), ("B-1", None)]
    (tmp_path / "twice.csv").write_text("Barcode,Cluster\nA-1,3\nA-1,3\n")
    with pytest.raises(Exception, match="twice"):
        R.clusters(spark, str(tmp_path / "twice.csv")).collect()
    names = [f"PC-{k}" for k in (10, 2, 1)]
    (tmp_path / "p.csv").write_text(",".join(["Barcode", *names]) + "\nA-1,10,2.5,1\nB-1,x,-2,\n")
    assert sorted(map(tuple, R.projection(spark, str(tmp_path / "p.csv")).collect())) == [("A-1", [1.0, 2.5, 10.0]), ("B-1", [None, -2.0, None])]
    (tmp_path / "q.csv").write_text("Barcode,Other\nA-1,1\n")
    with pytest.raises(ValueError):
        R.projection(spark, str(tmp_path / "q.csv"))
