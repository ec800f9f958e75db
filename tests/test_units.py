import contextlib
import json
import random
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import jsonpath, scalars, text
from spanloom.operators import aggregates, lifecycle, vectors
from spanloom.plans.dialect import DialectError, Engine, rewritten
from spanloom.sources import ingest
from spanloom.sources.storage import SpanStore
from spanloom.streaming import spans as streams

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


@contextlib.contextmanager
def limited(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@pytest.fixture(scope="module")
def spans(spark):
    """5 traces of 10 spans."""
    rows = [(1 + t % 2, 0, f"t{t}", f"t{t}s{i}", 1_700_000_000_000 + 1000 * t + i, 1_700_000_000_005 + 1000 * t + i, 5 * i, "error" if i == 3 else "ok", f"m{t % 2}", f"step {i} out of memory" if i == 7 else "all well", '{"a": {"b": "x"}, "n": 1.5, "z": null}', t * 10 + i + 1) for t in range(5) for i in range(10)]
    shape = "tenant_id long, partition_id long, trace_id string, span_id string, start_time_ms long, end_time_ms long, duration_ms long, status string, model string, prompt string, metadata string, commit_id long"
    return ingest.conformed(spark.createDataFrame(rows, shape))


def test_percentiles_by_nearest_rank(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, rng.randint(0, 9), rng.random()])) for k in "abc" for _ in range(rng.randint(1, 60))]
    rows = [(k, None if v is None else float(v)) for k, v in rows] + [("none", None)]
    got = {r.k: r for r in aggregates.percentiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}).collect()}
    for k in ("a", "b", "c", "none"):
        v = sorted(x for j, x in rows if j == k and x is not None)
        for name, q in (("a", 0.0), ("b", 0.5), ("c", 0.95), ("d", 1.0)):
            assert got[k][name] == (v[min(int(len(v) * q), len(v) - 1)] if v else None)


@pytest.mark.parametrize(("query", "expected"), [("memory", 5), ("out well", 50), ("out AND memory", 5), ('"out of memory"', 5), ('"of out"', 0), ("well -memory", 45), ("NOT memory", 45), ("MEMOR", 0), ("(out OR well) AND NOT step", 45)])
def test_text_match(spans, query, expected):
    assert spans.filter(text.text_match("prompt", query)).count() == expected


def test_text_that_is_no_query_is_a_substring(spans):
    assert spans.filter(text.text_match("prompt", "(of mem")).count() == 0
    assert spans.filter(text.text_match("prompt", "OF MEM", "substring")).count() == 5


def test_json_paths(spark):
    rows = [(1, '{"a":{"b":"x"},"t":[{"n":"p"},{"n":"q"}],"f":true,"z":null,"d":1.50}'), (2, '{"a":{"b":"y"},"t":[]}'), (3, "no json"), (4, None)]
    df = spark.createDataFrame(rows, "id long, m string")
    ids = lambda c: sorted(r.id for r in df.filter(c).collect())
    eq = jsonpath.json_path_eq
    assert ids(eq("m", "a.b", "x")) == ids(eq("m", "t[*].n", "q")) == ids(eq("m", "f", "true")) == ids(eq("m", "z", "null")) == ids(eq("m", "d", "1.5")) == [1]
    assert ids(~eq("m", "a.b", "x")) == [2, 3, 4] and ids(jsonpath.json_path_compare("m", "d", ">", 1)) == [1]
    found = {(r.path, r.value) for r in jsonpath.leaves(df.filter("id = 1"), "m", "id").collect()}
    assert found == {("a.b", "x"), ("t[*]", None), ("t[*].n", "p"), ("t[*].n", "q"), ("f", "true"), ("z", "null"), ("d", "1.5")}


def test_ulids(spark):
    hexes = ["0" * 32, "f" * 32, "0123456789abcdef0123456789abcdef", "abc"]
    df = spark.createDataFrame([(h,) for h in hexes], "h string").select("h", scalars.hex_to_ulid("h").alias("u")).select("h", "u", scalars.ulid_to_hex("u").alias("back"))
    for r in df.collect():
        assert len(r.u) == 26 and r.back == r.h.rjust(32, "0")


def test_nearest_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(8)] if i % 10 else None) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    have = [r for r in rows if r[1]]
    q = have[4][1]
    assert [r.vec_id for r in vectors.nearest(df, q, 5).collect()] == [i for i, v in sorted(have, key=lambda r: (dist(r[1], q), r[0]))[:5]]
    every = {}
    for r in vectors.nearest_of_each(df.filter("embedding is not null"), df, 3).collect():
        every.setdefault(r["query"], {})[r.place] = r.vec_id
    for i, v in have:
        want = [j for j, w in sorted(have, key=lambda r: (dist(r[1], v), r[0])) if j != i][:3]
        assert [every[i][k] for k in (1, 2, 3)] == want
    with pytest.raises(Exception, match="a vector has size 8"):
        vectors.checked(df, "embedding", 9).collect()


def test_latest_is_idempotent_and_keeps_every_column(spans):
    again = spans.filter("status = 'error'").withColumns({"commit_id": F.col("commit_id") + 1000, "status": F.lit("fixed")})
    once = lifecycle.latest(spans.unionByName(again))
    assert once.columns == spans.columns and once.count() == 50 and once.filter("status = 'fixed'").count() == 5
    assert sorted(lifecycle.latest(once).collect()) == sorted(once.collect())


def test_store(spark, spans, tmp_path):
    store = SpanStore(spark, f"file://{tmp_path}/s")
    assert store.raw().count() == 0 and not store.compact()
    for _ in range(3):
        store.append(spans)
    assert store.raw().count() == 150 and store.spans(1).count() == 30
    assert store.compact() and store.raw().count() == 50 and [r.kind for r in store.manifest().collect()] == ["silver"]
    store.append(spans.withColumns({"commit_id": F.col("commit_id") + 100, "status": F.lit("late")}))
    assert store.raw().count() == 100 and {r.status for r in store.spans().collect()} == {"late"}
    store.backup(f"file://{tmp_path}/b")
    assert SpanStore.restore(spark, f"file://{tmp_path}/b", f"file://{tmp_path}/r").raw().count() == 100


def test_stream_drops_repeats(spark, spans, tmp_path):
    for _ in range(2):
        spans.write.mode("append").parquet(f"{tmp_path}/in")
    read = streams.stream(spark, f"{tmp_path}/in", spans.schema)
    store = SpanStore(spark, f"file://{tmp_path}/s")
    out = streams.unrepeated(read).drop("event_time")
    streams.append_to(out, store, f"{tmp_path}/c").awaitTermination()
    assert store.raw().count() == 50


def test_dialect(spans):
    engine = Engine(spans)
    assert engine.sql("SELECT count(*) AS n FROM spans", 1).first().n == 30
    assert engine.sql("SELECT count(*) AS n FROM spans WHERE tenant_id = 2", 1).first().n == 0
    assert engine.sql("SELECT span_id FROM spans WHERE metadata.a.b = 'x' AND text_match(prompt, '\"out of memory\"')", 2).count() == 2
    assert engine.sql("SELECT model, percentile(duration_ms, 0.5) AS p FROM spans GROUP BY model", 1).first().p == 25
    assert engine.sql("SELECT 'metadata.a = ''x''' AS s FROM spans LIMIT 1", 1).first().s == "metadata.a = 'x'"
    assert engine.rows_json("SELECT model FROM spans LIMIT 1", 1).first().row_json == '{"model":"m0"}'


@pytest.mark.parametrize("bad", ["SELECT 1; SELECT 2", "DELETE FROM spans", "SELECT " + "(" * 65 + "1" + ")" * 65])
def test_dialect_refuses(bad):
    with pytest.raises(DialectError):
        rewritten(bad)
    with pytest.raises(DialectError):
        rewritten("SELECT DISTINCT model FROM spans", strict=True)


def test_ingest(spark):
    body = '{"tenant_id": 7, "spans": [{"start_time_ms": 5, "end_time_ms": 9, "model": "m"}, {"start_time_ms": 6, "end_time_ms": 4, "span_id": "01ARZ3NDEKTSV4RRFFQ69G5FAV"}]}'
    rows = ingest.ingest_json(spark.createDataFrame([(body,)], "body string"), base_commit=50).collect()
    assert {r.duration_ms for r in rows} == {4, 0} and {r.commit_id for r in rows} == {50, 51} and {r.partition_id for r in rows} == {0}
    assert "01ARZ3NDEKTSV4RRFFQ69G5FAV" in {r.span_id for r in rows} and all(len(r.trace_id) == 26 for r in rows)
    assert ingest.synthetic(spark, 100).count() == 100


def test_requests_that_are_refused(spark):
    good = '{"tenant_id": 1, "spans": [{"start_time_ms": 1, "end_time_ms": 2, "parent_span_id": "bad"}]}'
    bodies = [good, '{"tenant_id": 1, "spans": []}', "nonsense", None, '{"tenant_id": "x", "spans": []}', '{"spans": []}', '{"tenant_id": 1}', '{"tenant_id": 1, "spans": [{"start_time_ms": 1}]}']
    df = spark.createDataFrame([(b,) for b in bodies], "body string")
    assert sorted(r.reason for r in ingest.ingest_rejects(df).collect()) == ["a span without start or end", "malformed", "malformed", "malformed", "no spans", "no tenant_id"]
    rows = ingest.ingest_json(df).collect()
    assert len(rows) == 1 and rows[0].parent_span_id is None
    otlp = spark.createDataFrame([("nonsense",), ("{}",), ('{"resourceSpans": []}',)], "body string")
    assert sorted(r.reason for r in ingest.otlp_rejects(otlp).collect()) == ["malformed", "no resourceSpans"] and ingest.ingest_otlp(otlp, 1).count() == 0


def test_otlp_attributes(spark):
    a = '{"key":"k","value":{"stringValue":"1"}},{"key":"k","value":{"intValue":2}},{"value":{"stringValue":"x"}},{"key":"q\\"","value":{"doubleValue":1.5}},{"key":"f","value":{"boolValue":false}},{"key":"gen_ai.usage.input_tokens","value":{"intValue":"12"}},{"key":"gen_ai.request.temperature","value":{"doubleValue":"0.1"}},{"key":"gen_ai.request.temperature","value":{"doubleValue":2}}'
    body = f'{{"resourceSpans":[{{"scopeSpans":[{{"spans":[{{"traceId":"AB","spanId":"1","name":"n","status":{{"code":2}},"attributes":[{a}]}}]}}]}}]}}'
    r = ingest.ingest_otlp(spark.createDataFrame([(body,)], "body string"), 3).first()
    assert json.loads(r.metadata) == {"otel_span_name": "n", "attributes": {"k": 2, 'q"': 1.5, "f": False, "gen_ai.usage.input_tokens": "12", "gen_ai.request.temperature": 2}}
    assert (r.prompt_tokens, r.temperature, r.status, r.span_type, r.tenant_id, len(r.trace_id)) == (12, 2.0, "error", "agent_step", 3, 26)


def test_proto_records(spark):
    shape = "tenant_id long, partition_id long, trace_id binary, span_id binary, parent_span_id binary, start_time_ms long, end_time_ms long, duration_ms long, status string, prompt_tokens long, metadata_json binary, embedding array<float>"
    rows = [(1, 0, b"\x01", b"\x00\x02", b"", 5, 6, 1, "", 0, b"{", []), (1, 0, b"\x01" * 16, b"\x03" * 8, b"\x02", 5, 6, 1, "ok", 4, b'{"a": 1}', [0.5])]
    got = sorted(ingest.from_proto(spark.createDataFrame(rows, shape)).collect(), key=lambda r: r.trace_id)
    assert got[0].trace_id == "0" * 25 + "1" and (got[0].parent_span_id, got[0].status, got[0].prompt_tokens, got[0].metadata, got[0].embedding) == (None,) * 5
    assert got[1].parent_span_id.endswith("02"[-1]) and (got[1].status, got[1].prompt_tokens, got[1].metadata, got[1].embedding) == ("ok", 4, '{"a": 1}', [0.5]) and {r.commit_id for r in got} == {1, 2}


def test_words_without_tokens_are_left_out_of_a_query(spans):
    match = lambda q: spans.filter(text.text_match("prompt", q)).count()
    assert match("out & memory") == match("out memory") and match("&") == 0 and match("NOT &") == 0 and match("x" * 50) == 0 and match("memory AND " + "x" * 50) == match("memory")
    two = spans.withColumn("other", F.when(F.col("span_id").endswith("7"), "note"))
    assert two.filter(text.text_match_any(["prompt", "other"], "memory AND note")).count() == 5 and two.filter(text.text_match_any(["prompt", "other"], "well AND NOT note")).count() == 45


def test_index_of_cells(spark):
    rng = random.Random(6)
    centres = [[rng.gauss(0, 5) for _ in range(6)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 1) for x in rng.choice(centres)]) for i in range(900)] + [(900, None), (901, []), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 10 = 0")
    exact = {(r.query, r.vec_id) for r in vectors.nearest_of_each(asked, df, 5, block=7).collect()}
    index = vectors.CellIndex(df, 16)
    assert index.rows.count() == 900
    found = {(r.query, r.vec_id) for r in index.nearest(asked, 5, 5).collect()}
    assert len(exact) == 450 and len(found & exact) >= 0.9 * len(exact)
    assert {(r.query, r.vec_id) for r in index.nearest(asked, 5, 16).collect()} == exact
    near = {(r.query, r.vec_id) for r in vectors.within_of_each(asked, df, 2.0, block=50).collect()}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    assert near == {(i, j) for i, v in rows[:900] if i % 10 == 0 for j, w in rows[:900] if i != j and dist(v, w) <= 2.0}


@pytest.mark.parametrize(("far", "probes"), [(0, 3), (3e5, 8)])
def test_index_makes_no_pairs_of_rows(spark, far, probes):
    """Tasks give k rows a query, so nothing grows with queries times vectors; far from the origin, where products lose digits, and with ties, results are those of plain loops."""
    rng = random.Random(8)
    rows = [(i, [far + rng.gauss(0, 1e-3 if far else 1) for _ in range(5)]) for i in range(700)]
    rows += [(700 + i, rows[i % 3][1]) for i in range(60)] + [(760, None), (761, []), (None, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.filter("vec_id % 9 = 0")
    index = vectors.CellIndex(df, 8)
    plan = index.nearest(asked, 4, probes)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    cell = {r.key: r.cell for r in index.rows.collect()}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) ** 0.5
    order = lambda i, keep: [j for _, j in sorted((dist(rows[i][1], w), j) for j, w in rows[:760] if j != i and keep(j))[:4]]
    exact, found = {}, {}
    for r in vectors.nearest_of_each(asked, df, 4, block=11).orderBy("place").collect():
        exact.setdefault(r["query"], []).append(r.vec_id)
    for r in index.nearest(asked, 4, probes, block=11).orderBy("place").collect():
        found.setdefault(r["query"], []).append(r.vec_id)
    assert sorted(exact) == sorted(found) == list(range(0, 760, 9))
    for i in exact:
        asks = sorted(range(len(index.centroids)), key=lambda c: (vectors.distances(np.array([rows[i][1]]), index.centroids)[0][c], c))[:probes]  # noqa: B023
        assert exact[i] == order(i, lambda j: True) and found[i] == order(i, lambda j: cell[j] in asks)  # noqa: B023


def test_subtree_reads_its_spans_once_and_has_no_limit_of_rows(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    # a tree of two children each, a chain below its last span, a second tree and a cycle; one span of another tenant
    rows = [(1, f"s{i}", f"s{i // 2}" if i > 1 else None) for i in range(1, 201)] + [(1, f"c{i}", f"c{i - 1}" if i else "s200") for i in range(5)]
    rows += [(1, "o1", None), (1, "o2", "o1"), (1, "x", "y"), (1, "y", "x"), (2, "z", "s1")]
    df = spark.createDataFrame(rows, "tenant_id long, span_id string, parent_span_id string").mapInArrow(counted, "tenant_id long, span_id string, parent_span_id string")
    want = {(f"s{i}", i.bit_length() - 1) for i in range(1, 201)} | {(f"c{i}", 8 + i) for i in range(5)}
    with limited(spark, "spark.sql.cteRecursionRowLimit", "100"):
        got = [(r.span_id, r.depth) for r in lifecycle.subtree(df, "s1", 1, depth=12).collect()]
    assert len(got) == len(want) and set(got) == want and max(d for _, d in got) == 12
    assert read.value == len(rows)
    assert lifecycle.subtree(df, "none", 1).count() == 0
    with pytest.raises(Exception, match="(?i)level"):
        lifecycle.subtree(df, "s1", 1, depth=11).collect()


def test_functions_for_plain_sql(spark):
    from spanloom.functions.sql import register

    register(spark)
    r = spark.sql("SELECT ulid_from_hex('0123456789abcdef0123456789abcdef') AS a, ulid_from_bytes(X'FF') AS b, l2_distance(array(0D, 3D), array(4D, 0D)) AS c, text_tokens('A b_c,é') AS d, text_has('out of Memory', 'memory') AS e, json_path_eq('{\"a\":{\"b\":1}}', 'a.b', '1') AS f, json_path_number('{\"a\":\"x\"}', 'a') AS g, nanos_to_ms('1999999') AS h").first()
    assert r.a == spark.range(1).select(scalars.hex_to_ulid(F.lit("0123456789abcdef0123456789abcdef"))).first()[0]
    assert (r.b, r.c, r.d, r.e, r.f, r.g, r.h) == ("0" * 24 + "7Z", 5.0, ["a", "b", "c", "é"], True, True, None, 1)


def test_filters_and_columns_reach_the_scan(spark, spans, tmp_path):
    spans.write.parquet(f"{tmp_path}/p")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = spark.read.parquet(f"{tmp_path}/p").filter("trace_id = 't1' AND start_time_ms >= 1700000001005").select("model")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(trace_id,t1)" in plan and "GreaterThanOrEqual(start_time_ms,1700000001005)" in plan and "prompt" not in plan.split("ReadSchema")[1]


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(n.startswith('op1') for n in e.queries()) and set(e.oracle_sql()) <= set(e.queries())"
    code += "; from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.driver.host', '127.0.0.1').getOrCreate()"
    code += f"; d = {str(DATA)!r}; import os; assert not os.path.isdir(d) or (e.entry(s).count() > 0 and e.queries()['store_compaction'](s, d).count() > 0)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True)


def test_a_fault_within_the_operators_is_not_taken_for_their_absence(tmp_path):
    if not (ROOT / "spanloom" / "llm").is_dir():
        pytest.skip("without the training-data operators")
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__"))
    (tmp_path / "r" / "spanloom" / "llm" / "queries.py").write_text("import no_such_module\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path / "r", capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr
