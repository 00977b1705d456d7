"""The streaming extension equals its batch twin."""

from __future__ import annotations

from lymphframe.functions.regions import region_starts
from lymphframe.operators.grouping import hamming_pairs
from lymphframe.operators.plots import pack_circles, palette_distance, svg, turbo
from lymphframe.streaming.counts import running_signatures, windowed_counts


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7,0) as ts, cast(id % 3 as string) as kind from range(100)")
    rows.write.parquet(f"{tmp_path}/in")
    batch = {tuple(r) for r in windowed_counts(spark.read.parquet(f"{tmp_path}/in"), "ts", ["kind"]).collect()}
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream, "ts", ["kind"]).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("counts").collect()} == batch


def test_running_signatures(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c")], "cell int, v string")
    assert {tuple(r) for r in running_signatures(df, "cell", "v").collect()} == {(1, "a b", 2), (2, "c", 1)}


def test_hamming_pairs_find_all(spark):
    words = [f"{k:08b}" for k in range(0, 256, 3)] + ["", "0"]
    got = {(r.src, r.dst): r.distance for r in hamming_pairs(spark.createDataFrame([(w,) for w in words], "s string"), "s", "s", 2).collect()}
    want = {}
    for a in words:
        for b in words:
            if a < b and len(a) == len(b) and (n := sum(x != y for x, y in zip(a, b))) <= 2:
                want[a, b] = n
    assert got == want


def test_circles_do_not_overlap():
    r = [3.0, 2.0, 2.0, 1.0, 1.0, 1.0, 0.5] * 3
    c = pack_circles(r, seed=1)
    for i in range(len(r)):
        for j in range(i):
            assert ((c[i][0] - c[j][0]) ** 2 + (c[i][1] - c[j][1]) ** 2) ** 0.5 >= r[i] + r[j] - 1e-9
    assert all(x >= 0 and y >= 0 for x, y in pack_circles(r, quarter=True))
    assert svg([(x, y, q, turbo(9)) for (x, y), q in zip(c, r)]).count("<circle") == len(r)
    assert palette_distance("#ffffff", "#ffffff") == 0 and palette_distance("#ffffff", "#000000") > 99


def test_region_starts(spark):
    aa = "QVQLVQSGAEVKKPGASVKVSCKASGYTFTGYYMHWVRQAPGQGLEWMGWINPNSGGTNYAQKFQGRVTMTRDTSISTAYMELSRLRSDDTAVYYCAR"
    from pyspark.sql import functions as F

    r = spark.createDataFrame([(aa,), ("GGG",)], "aa string").select(region_starts(F.col("aa")).alias("s")).collect()
    s = r[0].s
    assert aa[s.fr2] == "W" and aa[s.cdr3 : s.cdr3 + 3] == "CAR" and s.fr1 < s.cdr1 < s.fr2 < s.cdr2 < s.fr3 < s.cdr3
    assert r[1].s.fr2 is None
