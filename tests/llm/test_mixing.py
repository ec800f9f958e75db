import random
from fractions import Fraction

import pytest

from spanloom.llm import mixing as M

from tests.llm.conftest import DOCS


@pytest.mark.parametrize("seed", range(8))
def test_every_prefix_is_within_a_block(seed):
    rng = random.Random(seed)
    period = rng.choice([10, 97, 1000])
    slots = M.quantised({f"s{i}": rng.random() ** 3 + 1e-6 for i in range(rng.randint(1, min(period, 25)))}, period)
    assert sum(slots.values()) == period
    had = dict.fromkeys(slots, 0)
    for t, (k, i, at) in enumerate(M.schedule(slots)):
        assert at == t and i == had[k]
        # released and not late
        assert Fraction(i * period, slots[k]) < t + 1 and t < -(-(i + 1) * period // slots[k])
        had[k] += 1
        for s, n in had.items():
            assert abs(n - Fraction((t + 1) * slots[s], period)) < 1
    assert had == slots


def brute(counts, weights, block, period):
    """The mixture by simulation, slot by slot."""
    slots = M.quantised(weights, period)
    plan = M.schedule(slots)
    left, out, t = {k: counts[k] // block for k in weights}, [], 0
    while True:
        k, _, _ = plan[t % period]
        if not left[k]:
            return out
        left[k] -= 1
        out.append(k)
        t += 1


@pytest.mark.parametrize("block", [1, 3])
def test_against_simulation(documents, block):
    counts = {"a": 500, "b": 60, "c": 7, "d": 33}
    rows = [(i, f"text {i}", "en", s, 5) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    weights = {"a": 0.5, "b": 0.3, "d": 0.2}
    got = M.mixed(documents(rows), weights, block=block, period=20).collect()
    expected = brute(counts, weights, block, 20)
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, []).append(r)
    assert sorted(by_slot) == list(range(len(expected)))
    for t, source in enumerate(expected):
        assert {r.source for r in by_slot[t]} == {source} and len(by_slot[t]) == block
    assert len({r.doc_id for r in got}) == len(got)


def test_weights_from_counts(documents):
    rows = [(i, "t", "en", "hot" if i % 10 else f"s{i % 3}", 1) for i in range(2000)]
    got = M.mixed(documents(rows), block=2).collect()
    n = max(r.slot for r in got) + 1
    weights = {"hot": 1800**M.ALPHA} | {f"s{k}": sum(i % 10 == 0 and i % 3 == k for i in range(2000)) ** M.ALPHA for k in range(3)}
    for s, w in weights.items():
        assert abs(sum(r.source == s for r in got) / 2 - n * w / sum(weights.values())) < 1.1


def test_odd_rows(spark, odd):
    got = M.mixed(odd, block=1)
    assert got.columns == [*odd.columns, "slot"]
    rows = got.collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and rows
    assert None in {r.source for r in rows}


def test_empty_table_clashing_names_and_absent_sources(spark, documents):
    assert M.mixed(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(i, "t", f"s{i % 2}", 1, 2, 3) for i in range(40)], "doc_id long, text string, source string, slot int, block int, hash int")
    got = M.mixed(df, {"s0": 1, "s1": 1, "gone": 5}, block=1)
    assert got.columns == [*df.columns, "_slot"] and got.count() == 40
    assert M.mixed(df, {"gone": 1}).count() == 0


def check_whole(counts, got, block, period):
    """Every document has a slot, and each prefix of a phase is within a block of the renormalised weights of the sources that have documents left."""
    assert sum(counts.values()) == len(got) == len({r.doc_id for r in got})
    by_slot = {}
    for r in got:
        by_slot.setdefault(r.slot, []).append(r.source)
    assert sorted(by_slot) == list(range(sum(-(-n // block) for n in counts.values())))
    left = {s: -(-n // block) for s, n in counts.items()}
    t = 0
    while left:
        slots = M.quantised({s: counts[s] ** M.ALPHA for s in left}, period)
        plan, had, start = M.schedule(slots), dict.fromkeys(left, 0), t
        while left[k := plan[(t - start) % period][0]] > had[k]:
            had[k] += 1
            size = block if had[k] < left[k] or counts[k] % block == 0 else counts[k] % block
            assert by_slot[t] == [k] * size
            t += 1
            assert all(abs(n - Fraction((t - start) * slots[s], period)) < 1 for s, n in had.items())
        left = {s: n - had[s] for s, n in left.items() if n > had[s]}
    assert t == len(by_slot)


@pytest.mark.parametrize("counts", [{"hot": 20_003, "tiny": 3}, {"a": 400, "b": 400, "c": 3, "d": 77, None: 1}])
def test_a_tiny_source_cuts_nothing(documents, counts):
    rows = [(i, "t", "en", s, 1) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    assert M.mixed(documents(rows)).count() < len(rows)
    got = [r.asDict() for r in M.mixed(documents(rows), whole=True).collect()]
    named = [type("R", (), {**r, "source": r["source"] or ""}) for r in got]
    check_whole({s or "": n for s, n in counts.items()}, named, M.BLOCK, M.PERIOD)


def test_the_registered_query_and_stage_keep_all(spark, documents, tmp_path):
    import corpus_pipeline
    from spanloom.llm import queries

    docs = documents([(i, "t", "en", "hot" if i else "one", 1) for i in range(900)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in queries.op10_source_mixing(spark, str(tmp_path)).collect()) == list(range(900))
    assert sorted(r.doc_id for r in corpus_pipeline.mixture(spark, docs, str(tmp_path)).collect()) == list(range(900))


def test_an_ordered_mixture_lies_in_its_order(spark, documents, tmp_path, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 64)
    docs = documents([(i, "t", "en", "hot" if i % 7 else f"s{i % 2}", 1) for i in range(1_803)])
    M.mixed(docs, whole=True, ordered=True).write.parquet(f"{tmp_path}/t")
    files = sorted(tmp_path.glob("t/part-*"))
    got = [(r.slot, r.doc_id) for f in files for r in spark.read.parquet(str(f)).collect()]
    assert len(files) == 28 and got == sorted((r.slot, r.doc_id) for r in M.mixed(docs, whole=True).collect())


@pytest.mark.parametrize("counts", [{"a": 1_000_000, "b": 1}, {f"big{i}": 1_000_000 for i in range(5)} | {f"tiny{i}": 1 for i in range(100)}])
def test_rare_sources_end_nothing(counts):
    """By the schedule's arithmetic: every block of every source has a slot of its own, without gaps."""
    blocks = {s: -(-n // M.BLOCK) for s, n in counts.items()}
    period = max(M.PERIOD, 10 * len(counts))
    had, end = dict.fromkeys(blocks, 0), 0
    for start, taken in M.phases(blocks, {s: n**M.ALPHA for s, n in counts.items()}, period):
        assert start == end
        for s, (first, n, own, at) in taken.items():
            assert first == had[s] and own >= len(at) > 0
            had[s] += n
        end += sum(n for _, n, _, _ in taken.values())
    assert had == blocks and end == sum(blocks.values())
