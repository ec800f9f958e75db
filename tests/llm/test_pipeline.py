"""Every stage against brute force on its own input, over one small corpus."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as P
from spanloom.llm import mixing, quality_cnn, shared, sharding
from spanloom.llm.shared import stored, text_buffer

from tests.llm.conftest import DOCS
from tests.llm.test_decontaminate import ITEMS
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_ngram_join import brute as copies
from tests.llm.test_ngram_join import edited


def corpus(prose, words):
    items = [(i, prose(900 + i, 30)) for i in range(5)]
    rows = [(i, prose(i, 20 + i % 60), "en" if i % 3 else "de", f"s{i % 4}") for i in range(160)]
    rows += [(200 + i, "#%$ " * (5 + i), "en", "s1") for i in range(40)]
    rows += [(300 + i, edited(rows[i][1], 0.02, i, words), "en", "s2") for i in range(20)]
    rows += [(400 + i, prose(50 + i, 30) + " " + items[i][1], "en", "s3") for i in range(5)]
    return [(i, t, la, s, len(t)) for i, t, la, s in rows], items


def test_stages(spark, prose, words, tmp_path):
    rows, items = corpus(prose, words)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, ITEMS).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(i, int(not 200 <= i < 240), 0) for i, *_ in rows if i < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = stored(stage(spark, docs, str(tmp_path)), "test")
        seen.append((name, sorted(docs.collect()), sorted(out.collect())))
        assert name == P.STAGES[-1][0] or out.columns == docs.columns
        docs = out
    quality, near, leak, mixed, shards = seen

    texts = [r.text for r in quality[1]]
    good = dict((i, bool(q)) for i, q, _ in labels)
    model = quality_cnn.train([r.text for r in quality[1] if r.doc_id in good], np.array([good[r.doc_id] for r in quality[1] if r.doc_id in good]))
    p = quality_cnn.probabilities(*text_buffer(pa.array(texts)), model)
    assert [r.doc_id for r in quality[2]] == [r.doc_id for r, x in zip(quality[1], p, strict=True) if x >= quality_cnn.THRESHOLD]
    assert not {r.doc_id for r in quality[2]} & set(range(200, 240)) and len(quality[2]) >= 180

    _, group = copies([(r.doc_id, r.text) for r in near[1]])
    assert [r.doc_id for r in near[2]] == [r.doc_id for r in near[1] if group[r.doc_id] == r.doc_id]
    assert len(near[2]) < len(near[1])

    gone = {d for d, _ in leaks([(r.doc_id, r.text) for r in leak[1]], items)}
    assert len(gone) == 5 and [r.doc_id for r in leak[2]] == [r.doc_id for r in leak[1] if r.doc_id not in gone]

    # the slots are tested with the operator; the stage keeps all
    assert mixed[1] == mixed[2]

    assert [r[:5] for r in shards[2]] == [tuple(r) for r in shards[1]]
    in_turn = sorted(shards[2], key=lambda r: (r.hilbert, r.doc_id))
    assert [r.shard for r in in_turn] == [i // sharding.SHARD_ROWS for i in range(len(in_turn))]
    before = len(shared.WRITTEN)
    assert len(P.run(spark, str(tmp_path)).collect()) == len(shards[2])
    # of the stages before the last only the table that it reads is left
    left = [p for p in shared.WRITTEN[before:] if "/stage-" in p]
    assert len(left) == 1 and not any(kind in p for p in shared.WRITTEN[before:] for kind in ("groups", "labelled", "buckets"))


KEEPS = {  # doc_ids of the odd rows that each stage keeps, 0 for null
    "n-gram Jaccard join": [-(2**63), 0, 0, 1, 2, 3, 4, 5, 6, 7, 2**63 - 1],
    "benchmark decontamination": [-(2**63), 0, 2, 3, 4, 5, 6, 7, 2**63 - 1],
}


def tables(spark, at, items, labels):
    spark.createDataFrame(items, ITEMS).write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_odd_rows_and_clashing_names_in_every_stage(spark, odd, prose, tmp_path):
    # the item is in rows 1, which repeat, and in a row without a doc_id
    items = [(1, prose(1, 80)), (2, prose(2, 50)), (3, None), (None, "")]
    at = tables(spark, tmp_path, items, [(5, 1, 0), (6, 1, 0), (None, 0, 0), (1, None, None)])
    taken = ["slot", "shard", "hilbert", "probability", "low", "d", "i", "n", "h", "c0", "a.b", "group_id", "range", "at"]
    wide = odd.select("*", *[F.lit(k).alias(c) for k, c in enumerate(taken)])
    for name, stage in P.STAGES:
        out = stage(spark, wide, at)
        assert out.columns[: len(wide.columns)] == wide.columns and len(out.columns) == len(wide.columns) + 2 * (name == "sharding")
        assert name == "sharding" or out.schema.simpleString() == wide.schema.simpleString()
        rows = out.collect()
        assert all(r[len(odd.columns) :][: len(taken)] == tuple(range(len(taken))) for r in rows)
        kept = sorted(r.doc_id or 0 for r in rows)
        assert kept == KEEPS.get(name, sorted(r.doc_id or 0 for r in odd.collect()))
    assert out.columns[-2:] == ["_hilbert", "_shard"]


def test_empty_tables_in_every_stage(spark, odd, tmp_path):
    at = tables(spark, tmp_path, [], [])
    empty = spark.createDataFrame([], DOCS)
    for _, stage in P.STAGES:
        assert stage(spark, empty, at).count() == 0
    # nothing is known of quality or of benchmarks: all rows stay
    assert P.good_quality(spark, odd, at).count() == P.benchmark_leaks(spark, odd, at).count() == odd.count()
    empty.write.parquet(f"{at}/documents.parquet")
    assert P.run(spark, at).count() == 0


def test_the_shards_follow_the_mixture(spark, documents, tmp_path):
    rows = [(i, "t", "en" if i % 3 else "de", "hot" if i % 9 else f"rare{i % 2}", i % 50) for i in range(9_001)]
    docs = documents(rows)
    slots = {r.doc_id: r.slot for r in mixing.mixed(docs, whole=True).collect()}
    # five shards, two in a window
    turn, window = sorted(slots, key=lambda i: (slots[i], i)), 2 * sharding.SHARD_ROWS
    got = P.shards(spark, stored(P.mixture(spark, docs, str(tmp_path)), "test"), str(tmp_path)).collect()
    for k in range(3):
        own = sorted((r for r in got if r.shard // 2 == k), key=lambda r: (r.hilbert, r.doc_id))
        assert sorted(r.doc_id for r in own) == sorted(turn[k * window : (k + 1) * window])
        assert [r.shard for r in own] == [2 * k + i // sharding.SHARD_ROWS for i in range(len(own))]
    # the target weights, within a block, as long as every source has documents
    weights = {"hot": 8_000**mixing.ALPHA, "rare0": 501**mixing.ALPHA, "rare1": 500**mixing.ALPHA}
    for s, w in weights.items():
        n = sum(r.source == s for r in got if r.shard < 2) / mixing.BLOCK
        assert abs(n - window / mixing.BLOCK * w / sum(weights.values())) < 1.2
    # without it, other documents share a window
    plain = P.shards(spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in plain if r.shard < 2} != {r.doc_id for r in got if r.shard < 2}
