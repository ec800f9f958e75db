"""Writers that race, leases, restarts of streams, and what readers list and scan."""

import time

import pytest
from pyspark.sql import functions as F

from spanloom.operators import lifecycle
from spanloom.sources import ingest
from spanloom.sources.storage import LeaseHeldError, SpanStore, selected
from spanloom.streaming import spans as streams


@pytest.fixture(scope="module")
def spans(spark):
    rows = [(1 + t % 2, 0, f"t{t}", f"t{t}s{i}", 1000 * t + i, 1000 * t + i + 5, 5, "ok", t * 10 + i + 1) for t in range(4) for i in range(10)]
    shape = "tenant_id long, partition_id long, trace_id string, span_id string, start_time_ms long, end_time_ms long, duration_ms long, status string, commit_id long"
    return ingest.conformed(spark.createDataFrame(rows, shape))


def test_writers_that_race_lose_nothing(spark, spans, tmp_path, monkeypatch):
    store, other = SpanStore(spark, f"file://{tmp_path}/s"), SpanStore(spark, f"file://{tmp_path}/s")
    store.append(spans)
    # the second writer commits between the first one's look at the state and its commit
    real, done = store._create, []

    def late(name, text):
        if not done and name.startswith("manifest"):
            done.append(other.append(spans.withColumn("commit_id", F.col("commit_id") + 100)))
        return real(name, text)

    monkeypatch.setattr(store, "_create", late)
    store.append(spans.withColumn("commit_id", F.col("commit_id") + 200))
    assert done and store.raw().count() == 120 and len(store.state()["bronze"]) == 3


def test_compactions_that_overlap(spark, spans, tmp_path, monkeypatch):
    store, other = SpanStore(spark, f"file://{tmp_path}/s"), SpanStore(spark, f"file://{tmp_path}/s")
    for k in range(3):
        store.append(spans.filter(F.col("start_time_ms") % 3 == k))
    real, done = store._write, []

    def slow(*args, **more):
        entry = real(*args, **more)
        if not done:
            monkeypatch.setattr(other, "acquire", lambda worker: None)
            done.append(other.compact(2))
        return entry

    monkeypatch.setattr(store, "_write", slow)
    assert store.compact(1) is False and done == [True]
    assert store.raw().count() == 40 and store.compact() and store.spans().count() == 40
    assert [r.kind for r in store.manifest().collect()] == ["silver"]


def test_lease(spark, spans, tmp_path):
    store = SpanStore(spark, f"file://{tmp_path}/s")
    store.append(spans)
    store.acquire("a", 60)
    with pytest.raises(LeaseHeldError):
        store.compact(worker="b")
    store.release("b")
    with pytest.raises(LeaseHeldError):
        store.acquire("b")
    store.release("a")
    store.acquire("c", 0.01)
    time.sleep(0.05)
    assert store.compact(worker="d")


def test_an_unfinished_manifest_is_passed_over(spark, spans, tmp_path, monkeypatch):
    monkeypatch.setattr("spanloom.sources.storage.PATIENCE", 0.1)
    store = SpanStore(spark, f"file://{tmp_path}/s")
    store.append(spans)
    (tmp_path / "s" / "manifest" / f"{2:020d}.json").write_text("")
    assert store.raw().count() == 40
    store.append(spans)
    assert store.raw().count() == 80


def test_batches_are_taken_by_size():
    parts = [{"path": str(k), "bytes": 10, "rows": 5} for k in range(6)]
    assert len(selected(parts)) == 6 and len(selected(parts, 25)) == 3 and len(selected(parts, None, 1)) == 1 and len(selected(parts, 1000, 10)) == 2 and selected([], 5) == []


def test_ranges_list_only_parts_that_may_hold_rows(spark, spans, tmp_path):
    store = SpanStore(spark, f"file://{tmp_path}/s")
    for t in range(4):
        store.append(spans.filter(F.col("trace_id") == f"t{t}"))
    df = store.raw(since=1005, until=2003)
    assert df.count() == 8 and len(df.inputFiles()) < len(store.raw().inputFiles())
    bounds = store.manifest().orderBy("min_start_time_ms").first()
    assert (bounds.rows, bounds.min_start_time_ms, bounds.max_start_time_ms, bounds.min_trace_id, bounds.max_commit_id) == (10, 0, 9, "t0", 10) and bounds.bytes > 0


def test_filters_reach_the_compacted_version(spark, spans, tmp_path):
    store = SpanStore(spark, f"file://{tmp_path}/s")
    store.append(spans)
    store.compact()
    store.append(spans.filter("start_time_ms % 5 = 0").withColumns({"commit_id": F.col("commit_id") + 1000, "status": F.lit("late")}))
    found = store.spans().filter("trace_id = 't1'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    silver = next(line for line in plan.split("\n") if "FileScan" in line and "silver" in line)
    assert "EqualTo(trace_id,t1)" in silver
    assert sorted((r.span_id, r.status) for r in found.collect()) == [(f"t1s{i}", "late" if i % 5 == 0 else "ok") for i in range(10)]


def test_older_commits_in_a_later_batch_lose(spark, spans, tmp_path):
    store = SpanStore(spark, f"file://{tmp_path}/s")
    store.append(spans.withColumn("commit_id", F.col("commit_id") + 100))
    store.compact()
    store.append(spans.filter("start_time_ms % 2 = 0").withColumn("status", F.lit("old")))
    store.append(spans.limit(1).withColumns({"span_id": F.lit("new"), "status": F.lit("new")}))
    want = sorted(lifecycle.latest(store.raw()).select("span_id", "status", "commit_id").collect())
    assert sorted(store.spans().select("span_id", "status", "commit_id").collect()) == want and len(want) == 41


def test_a_batch_that_is_run_again_is_not_added_twice(spark, spans, tmp_path):
    store = SpanStore(spark, f"file://{tmp_path}/s")
    assert store.append(spans, "q", 0) and store.append(spans, "q", 0) is None and store.append(spans, "q", 1)
    store.compact()
    assert store.append(spans, "q", 1) is None and store.raw().count() == 40
    # a stream that stops after its batch was added and before it was noted reads the same files again
    spans.write.parquet(f"{tmp_path}/in")
    read = streams.stream(spark, f"{tmp_path}/in", spans.schema)
    fresh = SpanStore(spark, f"file://{tmp_path}/f")
    streams.append_to(read, fresh, f"{tmp_path}/c").awaitTermination()
    for f in (tmp_path / "c" / "commits").iterdir():
        f.unlink()
    streams.append_to(read, fresh, f"{tmp_path}/c").awaitTermination()
    assert fresh.raw().count() == 40


def test_backup_keeps_versions_and_streams(spark, spans, tmp_path):
    store = SpanStore(spark, f"file://{tmp_path}/s")
    store.append(spans, "q", 4)
    store.append(spans)
    store.backup(f"file://{tmp_path}/b")
    again = SpanStore.restore(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/r")
    assert again.raw().count() == 80 and again.append(spans, "q", 4) is None


def test_commits_by_ranges(spark, monkeypatch):
    rows = [(i % 3 or None, 0, f"t{i * 7 % 50:02d}", f"s{i}", i % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "tenant_id long, partition_id long, trace_id string, span_id string, start_time_ms long")
    for few in (100_000, 0):
        monkeypatch.setattr(lifecycle, "FEW_GROUPS", few)
        got = lifecycle.with_commits(df, 10).collect()
        for tenant in (None, 1, 2):
            own = sorted((r for r in got if r.tenant_id == tenant), key=lambda r: (r.trace_id, r.start_time_ms, r.span_id))
            assert [r.commit_id for r in own] == list(range(10, 10 + len(own)))
