import random
import time

import numpy as np
import pyarrow as pa
import pytest

from spanloom.llm import decontaminate as D
from spanloom.llm.licenses import WORD
from spanloom.llm.shared import text_buffer

from tests.llm.conftest import DOCS

ITEMS = "item_id long, text string"


def brute(docs, items, match=D.MATCH_WORDS, least=D.LEAST_WORDS):
    out = {}
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for i, item in items:
            b = WORD.findall((item or "").lower())
            need = min(match, len(b))
            if len(b) < least or d is None or i is None:
                continue
            best = None
            for p in range(len(w)):
                for q in range(len(b)):
                    k = 0
                    while p + k < len(w) and q + k < len(b) and w[p + k] == b[q + k]:
                        k += 1
                    if k >= need and (best is None or (k, -p, -q) > best):
                        best = (k, -p, -q)
            if best and ((d, i) not in out or best > out[d, i]):
                out[d, i] = best
    return {k: (n, -p, -q) for k, (n, p, q) in out.items()}


def got(df):
    return {(r.doc_id, r.item_id): (r.match_words, r.doc_word, r.item_word) for r in df.collect()}


def test_against_brute_force(spark, documents, prose):
    items = [(i, prose(i, 6 + 5 * i)) for i in range(10)]
    part = lambda i, a, b: " ".join(items[i][1].split(" ")[a:b])
    docs = [(100 + i, prose(50 + i, 30) + " " + items[i][1].upper() + ". " + prose(70 + i, 20)) for i in range(10)]
    docs += [(200, part(9, 3, 20)), (201, prose(1, 5) + ", " + part(8, 10, 22)), (202, part(7, 0, 13) + " " + part(7, 20, 34)), (203, part(5, 0, 14) + "x"), (204, part(0, 0, 5)), (205, items[0][1] + " " + items[0][1])]
    docs += [(300 + i, prose(500 + i, 200)) for i in range(20)]
    docs.append((400, " ".join([part(6, 0, 12)] * 5)))
    # a match may not run from one document into the next
    docs += [(501, part(9, 0, 10)), (502, part(9, 10, 30))]
    bench = spark.createDataFrame(items, ITEMS)
    expected = brute(docs, items)
    assert len(expected) >= 13
    assert got(D.matches(documents(docs).coalesce(1), bench)) == expected
    kept = {r.doc_id for r in D.decontaminated(documents(docs), bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in expected}


def test_several_passes_give_the_same(spark, documents, prose, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(6)]
    docs = [(i, prose(90 + i, 10) + " " + items[i][1]) for i in range(6)]
    bench = spark.createDataFrame(items, ITEMS)
    whole = got(D.matches(documents(docs), bench))
    monkeypatch.setattr(D, "PASS_BYTES", 200)
    assert got(D.matches(documents(docs), bench)) == whole and len(whole) == 6


def test_odd_rows(spark, odd, prose):
    bench = spark.createDataFrame([(1, prose(1, 80)), (1, prose(1, 80)), (None, prose(1, 80)), (2, None), (3, ""), (4, "least of all"), (5, prose(99, 60_000)[1000:1200])], ITEMS)
    found = got(D.matches(odd, bench))
    assert found[1, 1] == (80, 0, 0) and set(found) == {(1, 1), (5, 5), (-(2**63), 4)}
    kept = D.decontaminated(odd, bench)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4


def test_empty_tables(spark, odd):
    none, docs = spark.createDataFrame([], ITEMS), spark.createDataFrame([], DOCS)
    assert D.matches(odd, none).count() == 0 and D.decontaminated(odd, none).count() == odd.count()
    assert D.matches(docs, spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0


def test_clashing_names(spark, prose):
    df = spark.createDataFrame([(1, prose(1, 40), 7, "x"), (2, prose(2, 40), 8, "y")], "doc_id long, text string, item_id int, match_words string")
    kept = D.decontaminated(df, spark.createDataFrame([(1, prose(1, 40))], ITEMS))
    assert kept.columns == df.columns and [r.item_id for r in kept.collect()] == [8]


def test_repeated_passages_and_equal_prefixes(spark, documents, prose):
    """Many suffixes with the same first 24 bytes."""
    head = prose(7, 12)
    items = [(i, head + " " + prose(700 + i, 8)) for i in range(20)]
    docs = [(i, (head + " ") * 30 + prose(700 + i, 8)) for i in range(20)]
    assert got(D.matches(documents(docs).coalesce(1), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_rows_are_judged_by_their_own_text(spark, documents, prose):
    leak = prose(1, 30)
    docs = documents([(None, leak), (7, leak), (7, prose(2, 30)), (None, prose(3, 30)), (8, None), (8, None)])
    kept = D.decontaminated(docs, spark.createDataFrame([(None, leak)], ITEMS)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in kept) == sorted([(7, prose(2, 30)), (0, prose(3, 30)), (8, ""), (8, "")])


@pytest.mark.parametrize("seed", range(60))
def test_few_words_in_many_places(seed):
    rng = random.Random(seed)
    some = "abcde"[: rng.randint(1, 5)]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 30)))) for i in range(rng.randint(1, 6))]
    items = [(i, " ".join(rng.choice(some + "z") for _ in range(rng.randint(0, 12)))) for i in range(rng.randint(1, 5))]
    match = rng.randint(1, 6)
    shard = D.Shard(*text_buffer(pa.array([t for _, t in docs])), D.Benchmark([t for _, t in items], match, 1))
    expected = brute(docs, items, match, 1)
    assert {(d, i): (n, p, q) for d, i, n, p, q in zip(*(x.tolist() for x in shard.longest()), strict=True)} == expected
    assert set(np.flatnonzero(shard.leaked()).tolist()) == {d for d, _ in expected}


def test_the_array_is_sorted_to_the_ends():
    texts = [" ".join("ab"[(i * i >> 3) % 2] for i in range(200))] * 3 + ["a " * 100]
    shard = D.Shard(*text_buffer(pa.array(texts)), D.Benchmark(["a b"], 13, 1))
    suffixes = [shard.number[p : shard.end[p]].tolist() for p in shard.array.tolist()]
    assert suffixes == sorted(suffixes) and len(set(shard.array.tolist())) == len(suffixes)


def test_periodic_text_takes_no_square_of_time():
    began = time.perf_counter()
    shard = D.Shard(*text_buffer(pa.array(["ab cd ef " * 111_000])), D.Benchmark(["ab cd ef " * 1_111], 13, 1))
    assert [x.tolist() for x in shard.longest()] == [[0], [0], [3_333], [0], [0]]
    assert time.perf_counter() - began < 5


def test_long_texts_in_pieces(spark, documents, prose, monkeypatch):
    items = [(i, prose(i, 20 + i)) for i in range(5)]
    docs = [(1, " ".join(prose(100 + i, 90) + ", " + items[i % 5][1] for i in range(40))), (2, prose(7, 3000)), (3, "x" * 20_000 + " " + items[0][1])]
    bench = spark.createDataFrame(items, ITEMS)
    whole = got(D.matches(documents(docs), bench))
    monkeypatch.setattr(D, "SHARD", 700)
    assert got(D.matches(documents(docs), bench)) == whole and {d for d, _ in whole} == {1, 3} and len(whole) == 6
    assert [r.doc_id for r in D.decontaminated(documents(docs), bench).collect()] == [2]
