import itertools

import pytest

from spanloom.llm import sharding as H

from tests.llm.conftest import DOCS


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(n, bits):
    points = sorted(itertools.product(range(1 << bits), repeat=n), key=lambda p: H.hilbert_of(list(p), bits))
    assert [H.hilbert_of(list(p), bits) for p in points] == list(range(1 << n * bits))
    for a, b in itertools.pairwise(points):
        assert sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1


def test_the_state_machine_in_the_jvm(spark):
    from pyspark.sql import functions as F

    rows = [(x, y, z, w) for x in (0, 3, 17, 31) for y in (0, 8, 31) for z in (1, 30) for w in (0, 5, 16)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int").withColumn("h", H.curve_index([F.col(c) for c in "abcd"], 5))
    for r in df.collect():
        assert r.h == H.hilbert_of([r.a, r.b, r.c, r.d], 5)


def test_runs_and_pruning(documents):
    rows = [(i, f"t{i}", "en de fr".split()[i * 7 % 3], f"s{i * 13 % 10}", i * 37 % 5000) for i in range(3000)]
    got = H.sharded(documents(rows), 100)
    out = got.collect()
    assert len(out) == 3000
    order = sorted(out, key=lambda r: (r.hilbert, r.doc_id))
    assert [r.shard for r in order] == [i // 100 for i in range(3000)]
    zones = H.manifest(got).collect()
    assert len(zones) == 30 and all(z["rows"] == 100 for z in zones)
    # a filter on two dimensions meets far fewer shards than files in order of arrival, which are 30 of 30
    hit = [z for z in zones if z.least_lang <= "en" <= z.most_lang and z.least_source <= "s3" <= z.most_source]
    assert len(hit) <= 15


def test_odd_rows(odd):
    got = H.sharded(odd, 5)
    assert got.columns == [*odd.columns, "hilbert", "shard"]
    rows = got.collect()
    assert len(rows) == odd.count() and sorted(r.shard for r in rows) == [i // 5 for i in range(len(rows))]


def test_empty_table_and_clashing_names(spark, tmp_path):
    assert H.sharded(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(i, "t", "en", "s", i, 1, 2, 3) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long, hilbert int, shard int, q0 int")
    got = H.sharded(df, 6)
    assert got.columns == [*df.columns, "_hilbert", "_shard"] and {r._shard for r in got.collect()} == {0, 1, 2, 3}
    H.written(H.sharded(df.drop("hilbert", "shard"), 6), f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/shards").count() == 20


@pytest.mark.parametrize("chars", [200, 3_000, 40_000, 10**9])
def test_ranges_by_characters_keep_the_order(documents, chars, monkeypatch):
    monkeypatch.setattr(H, "RANGE_CHARS", chars)
    rows = [(i * i % 7919, f"t{i % 3}", "en", "hot" if i % 3 else f"s{i % 5}", 10 if i % 9 else 4000) for i in range(1500)]
    rows += [(None, f"n{i}", "en", "hot", 10) for i in range(30)] + [(8000 + i, None, None, None, None) for i in range(5)]
    docs = documents(rows)
    got = H.sharded(docs, 50)
    out = got.collect()
    low = lambda r: (r.hilbert, r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
    order = sorted(out, key=lambda r: (r.shard, *low(r)))
    assert [low(r) for r in order] == sorted(low(r) for r in out) and sorted(r.shard for r in out) == [i // 50 for i in range(len(rows))]
    placed = H.coordinates(docs).select("i", "n", H.curve_index([H.F.col(f"q{i}") for i in range(4)], H.BITS).alias("h"))
    table, many = H.ranges(placed, 1)
    found = table.orderBy("h").collect()
    firsts = [r["first"] for r in found]
    assert firsts == sorted(firsts) and many >= min(3 * 10**5 // max(chars, 1), 20)
    for a, b in itertools.pairwise(found):
        assert b["first"] >= a["first"] + len(a["cuts"]) and a["cuts"] == sorted(a["cuts"])


@pytest.mark.parametrize("chars,files", [(10_000, 13), (10**9, 1)])
def test_windows_follow_the_rows_of_the_table(spark, chars, files, monkeypatch, tmp_path):
    monkeypatch.setattr(H, "RANGE_CHARS", chars)
    rows = [(i * i % 7919, f"t{i % 3}", "en", "hot" if i % 3 else f"s{i % 5}", 10 if i % 9 else 4000) for i in range(1000)]
    rows += [(None, f"n{i}", "en", "hot", 10) for i in range(30)] + [(8000 + i, None, None, None, None) for i in range(5)]
    # files of different sizes, which Spark doesn't read in their order
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", k int")
    docs.repartitionById(files, H.F.expr(f"int(sqrt(k) * {files} / 33)")).sortWithinPartitions("k").write.parquet(f"{tmp_path}/t")
    out = H.sharded_in_windows(spark.read.parquet(f"{tmp_path}/t"), 20).collect()
    plain = {r.k: r.hilbert for r in H.sharded(docs, 20).collect()}
    low = lambda r: (r.hilbert, r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or "")
    assert len(out) == len(rows) and all(r.hilbert == plain[r.k] for r in out)
    # 52 shards, seven in a window
    for w in range(8):
        own = sorted((r for r in out if r.k // 140 == w), key=low)
        assert sorted(r.shard for r in own) == [w * 7 + i // 20 for i in range(len(own))]
        assert [low(r) for r in sorted(own, key=lambda r: (r.shard, *low(r)))] == [low(r) for r in own]
