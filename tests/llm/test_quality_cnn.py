import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import quality_cnn as Q
from spanloom.llm.shared import text_buffer

from tests.llm.conftest import DOCS

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus():
    import random

    rng = random.Random(1)
    syllables = ["ba", "re", "ti", "no", "sel", "mur", "kin", "dov", "lar", "pes"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows = []
    for i in range(800):
        n = rng.randint(5, 300)
        if i % 4:
            rows.append((i, ". ".join(" ".join(word() for _ in range(8)).capitalize() for _ in range(1 + n // 8)), 1))
        elif i % 8:
            rows.append((i, " ".join(word() + rng.choice(["###", "%%%"]) for _ in range(n)), 0))
        else:
            rows.append((i, " ".join(word().upper() + "!!" for _ in range(n)), 0))
    return rows


def test_held_out_accuracy(corpus):
    model = Q.train([t for _, t, _ in corpus[:500]], np.array([q == 1 for _, _, q in corpus[:500]]))
    p = Q.probabilities(*text_buffer(pa.array([t for _, t, _ in corpus[500:]])), model)
    good = np.array([q == 1 for _, _, q in corpus[500:]])
    assert (p[good] >= Q.THRESHOLD).mean() >= 0.97 and (p[~good] < Q.THRESHOLD).mean() >= 0.97


def test_whole_documents_are_read():
    """Each byte of a text is in a chunk, and texts don't run into each other."""
    texts = ["a" * n for n in (0, 1, Q.CHUNK - 1, Q.CHUNK, Q.CHUNK + 1, 5 * Q.STEP + 3, 20_000)]
    chunks, bounds = Q.chunked(*text_buffer(pa.array(texts)))
    for k, t in enumerate(texts):
        own = chunks[bounds[k] : bounds[k + 1]]
        assert len(own) >= 1
        covered = sum((own[i, Q.CHUNK - Q.STEP if i else 0 :] == 97).sum() for i in range(len(own)))
        assert covered == len(t)


def test_rows_do_not_depend_on_their_batch(corpus):
    model = Q.train([t for _, t, _ in corpus[:60]], np.array([q == 1 for _, _, q in corpus[:60]]))
    texts = [t for _, t, _ in corpus[60:90]]
    together = Q.probabilities(*text_buffer(pa.array(texts)), model)
    alone = [Q.probabilities(*text_buffer(pa.array([t])), model)[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_odd_rows_and_clashing_names(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, None), (None, 1, 0), (6, None, 0), (1, 0, 0)], LABELS)
    named = odd.selectExpr("doc_id", "text", "lang as probability", "source as p", "n_chars as c0")
    out = Q.scored(named, Q.fitted(named, labels))
    assert out.columns == [*named.columns, "_probability"] and out.count() == odd.count()
    assert all(0 <= r._probability <= 1 for r in out.collect())
    kept = Q.classified(named, labels)
    assert kept.columns == out.columns


def test_no_labels_and_empty_tables(spark, odd):
    none = spark.createDataFrame([], LABELS)
    assert Q.classified(odd, none).count() == odd.count()
    assert Q.classified(spark.createDataFrame([], DOCS), none).count() == 0
    assert Q.classified(odd, spark.createDataFrame([(1, 0, 0)], LABELS)).count() == 0


def test_training_takes_at_most_the_bound(spark, documents, corpus):
    docs = documents([(i, t) for i, t, _ in corpus])
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in corpus], LABELS)
    texts, good = Q.labelled(docs, labels, 100)
    assert len(texts) == len(good) == 100
    assert len(Q.labelled(docs, labels)[0]) == 800


def test_probabilities_against_plain_loops(corpus):
    model = Q.train([t for _, t, _ in corpus[:40]], np.array([q == 1 for _, _, q in corpus[:40]]))
    texts = ["", "short", corpus[50][1][:300], "é" * 200, "x" * 600]
    got = Q.probabilities(*text_buffer(pa.array(texts)), model)
    for text, p in zip(texts, got, strict=True):
        data = text.encode()
        rows, at = [], 0
        while True:
            chunk = data[at : at + Q.CHUNK].ljust(Q.CHUNK, b"\0")
            best = np.full(Q.FILTERS, -np.inf)
            for i in range(Q.CHUNK - Q.WIDTH + 1):  # every byte
                best = np.maximum(best, np.concatenate([model["e"][b] for b in chunk[i : i + Q.WIDTH]]) @ model["w"])
            rows.append(np.maximum(best + model["b"], 0))
            at += Q.STEP
            if at + Q.CHUNK - Q.STEP >= len(data):
                break
        rows = np.array(rows)
        x = np.concatenate((rows.mean(axis=0), rows.max(axis=0), [np.log1p(len(data)) / 4, min(len(data) / Q.CHUNK, 1)]))
        y = np.maximum(x @ model["h"] + model["a"], 0) @ model["v"] + model["c"][0]
        assert abs(1 / (1 + np.exp(-y)) - p) < 1e-4


def test_a_long_text_takes_little_memory(corpus):
    import tracemalloc

    model = Q.train([t for _, t, _ in corpus[:40]], np.array([q == 1 for _, _, q in corpus[:40]]))
    raw, offsets = text_buffer(pa.array(["word " * 400_000]))
    Q.probabilities(raw[:1000], np.array([0, 1000]), model)
    tracemalloc.start()
    Q.probabilities(raw, offsets, model)
    assert tracemalloc.get_traced_memory()[1] < 4 * len(raw)
    tracemalloc.stop()


def test_training_texts_are_bounded_in_bytes_and_any_case_of_text_will_do(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * 100) for i in range(50)], "doc_id long, Text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(50)], LABELS)
    monkeypatch.setattr(Q, "MOST_BYTES", 5_000)
    assert len(Q.labelled(docs, labels)[0]) == 10
    monkeypatch.setattr(Q, "MOST_BYTES", 1)
    assert len(Q.labelled(docs, labels)[0]) == 1
    assert Q.scored(docs, Q.fitted(docs, labels)).columns == ["doc_id", "Text", "probability"]
