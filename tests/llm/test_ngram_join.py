import itertools
import random

import pytest
from spanloom.llm import ngram_join as J
from spanloom.llm.licenses import WORD

from tests.llm.conftest import DOCS


def gram_set(text, n=J.N):
    w = WORD.findall((text or "").lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def brute(rows, threshold=J.THRESHOLD):
    """Pairs at the threshold, and the least id of each component."""
    sets = {i: gram_set(t) for i, t in rows}
    pairs = {}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold:
            pairs[a, b] = j
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return pairs, {i: find(i) for i in sets}


def edited(text, share, seed, words):
    rng = random.Random(seed)
    return " ".join(rng.choice(words) if rng.random() < share else w for w in text.split(" "))


def test_against_brute_force(spark, documents, prose, words):
    rows = []
    for g in range(30):
        base = prose(g, random.Random(g).randint(8, 300))
        rows += [(g * 10 + k, edited(base, 0.02 * k, g * 10 + k, words)) for k in range(1 + g % 6)]
    shared = prose(1000, 60)
    rows += [(1000 + k, shared + " " + prose(2000 + k, 400)) for k in range(15)]  # a passage that many documents share isn't a copy
    pairs, group = brute(rows)
    got = {r.doc_id: r for r in J.ngram_join(documents(rows)).collect()}
    expected = {x for p in pairs for x in p}
    assert len(expected & set(got)) >= 0.9 * len(expected)
    assert set(got) <= expected
    for r in got.values():
        assert abs(pairs[min(r.doc_id, r.partner_id), max(r.doc_id, r.partner_id)] - r.jaccard) < 1e-9
    assert sum(group[i] == r.group_id for i, r in got.items()) >= 0.9 * len(got)


def test_many_copies_are_one_group(documents, prose, words):
    base = prose(5, 200)
    rows = [(i, edited(base, 0.03, i, words)) for i in range(300)] + [(1000 + i, base) for i in range(50)]
    got = J.ngram_join(documents(rows)).collect()
    assert len(got) == 350 and {r.group_id for r in got} == {0}


def test_odd_rows(odd):
    got = J.ngram_join(odd).collect()
    assert got == []  # a row that repeats isn't a copy of itself
    kept = J.one_of_each_group(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in [1, 2, 3, None, None, 4, 5, 6, 7, -(2**63), 2**63 - 1])


def test_empty_table_and_clashing_names(spark, prose):
    assert J.ngram_join(spark.createDataFrame([], DOCS)).count() == 0
    assert J.one_of_each_group(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, prose(1, 50), 1, 2, "x"), (2, prose(1, 50), 3, 4, "y"), (3, prose(2, 50), 5, 6, "z")], "doc_id long, text string, turn int, partner_id int, `group_id` string")
    kept = J.one_of_each_group(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 3}


def test_the_least_id_of_a_group_stays(documents, prose):
    rows = [(9, prose(1, 50)), (4, prose(1, 50).upper()), (7, prose(1, 50)), (1, prose(2, 50))]
    assert {r.doc_id for r in J.one_of_each_group(documents(rows)).collect()} == {1, 4}


def test_bands_reach_the_recall():
    for t in (0.5, 0.6, 0.8, 0.9):
        bands, rows = J.choose_bands(t, 0.95)
        assert 1 - (1 - t**rows) ** bands >= 0.95 and bands * rows <= J.MOST_PERMUTATIONS


def test_chains_of_trees(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (102, 101), (200, 100)], "a long, b long")
    got = {r.doc_id: r.root for r in J.components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == got[200] == 100
    links = spark.createDataFrame([(i + 1, i, 1.0) for i in range(40)], "doc_id long, partner_id long, jaccard double")
    assert {r.root for r in J.roots(links).collect()} == {0}


def test_the_registered_query_counts_all_links(spark, documents, prose, words, tmp_path):
    from spanloom.llm import queries

    base = prose(5, 200)
    rows = [(i, edited(base, 0.03, i, words)) for i in range(40)] + [(100 + i, base) for i in range(12)]
    rows += [(200 + k, edited(prose(6, 150), 0.06 * k, k, words)) for k in range(8)]  # a chain: its ends are unlike
    rows += [(300 + i, prose(300 + i, 60)) for i in range(20)] + [(400, ""), (401, ""), (402, "one word"), (403, "One word!")]
    rows += [(500, "a b c d a b c"), (501, "b c d a b c d a"), (502, "b c d a b c d a")]  # one set, two texts
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_ngram_join(spark, str(tmp_path)).collect()}
    pairs, group = brute(rows)
    text = {}
    for i, t in rows:
        text.setdefault(tuple(WORD.findall(t.lower())), []).append(i)
    own = {i: ids for ids in text.values() for i in ids}
    assert set(got) == {x for p in pairs for x in p}
    links = dict.fromkeys(got, 0)
    for a, b in pairs:
        for x, y in ((a, b), (b, a)):
            # copies share the links of the first
            links[x] += own[x] is not own[y] and y == own[y][0]
    for i, r in got.items():
        assert r.text_id == own[i][0] and r.copies == len(own[i]) and r.links <= links[i]
        assert abs(pairs[min(i, r.partner_id), max(i, r.partner_id)] - r.jaccard) < 1e-9
        if r.copies > 1:
            assert r.jaccard == 1
    assert sum(r.links for r in got.values()) >= 0.95 * sum(links.values())
    assert sum(r.class_id == group[i] for i, r in got.items()) >= 0.95 * len(got)
    assert (got[500].partner_id, got[501].partner_id, got[502].partner_id) == (501, 500, 500) and got[502].links == 1


def test_no_text_is_lost_for_a_repeated_or_missing_id(documents, prose):
    rows = [(1, None), (1, prose(1, 50)), (2, prose(1, 50)), (3, prose(2, 50)), (3, prose(3, 50)), (None, prose(4, 50)), (None, prose(4, 50)), (None, prose(2, 50)), (None, None), (4, "")]
    kept = sorted((r.doc_id or 0, r.text or "") for r in J.one_of_each_group(documents(rows)).collect())
    assert kept == sorted([(1, ""), (1, prose(1, 50)), (3, prose(2, 50)), (3, prose(3, 50)), (0, prose(4, 50)), (0, ""), (4, "")])
    assert {r.doc_id for r in J.ngram_join(documents(rows)).collect()} == {1, 2}


@pytest.mark.parametrize(("block", "dense", "cells"), [(64, 8, 1 << 22), (5, 0, 100), (5, 10**9, 1 << 22)])
def test_tiles_give_what_pairs_give(spark, documents, prose, words, monkeypatch, block, dense, cells):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "DENSE", dense)
    monkeypatch.setattr(J, "CELLS", cells)
    rows = [(g * 100 + k, edited(prose(g, 80), 0.04 * k, g * 100 + k, words)) for g in range(4) for k in range(2 + 7 * g)] + [(900, ""), (901, "a b"), (902, "a b")]
    texts = documents(rows).select("doc_id", "text")
    ids = [i for i, _ in rows]
    pairs = spark.createDataFrame([(a, b) for a, b in itertools.combinations(ids, 2) if a // 100 == b // 100], "a long, b long")
    got = {(r.doc_id, r.partner_id): r.jaccard for r in J.tiled(J.stored(pairs, "pairs"), texts, J.N, J.THRESHOLD).collect()}
    want, _ = brute(rows)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
