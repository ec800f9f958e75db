"""Tenancy and the forms of the dialect."""

import pytest
from spanloom.operators.aggregates import percentile_sql
from spanloom.plans.dialect import DialectError, Engine, rewritten
from spanloom.sources import ingest


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1 + i % 2, 0, f"t{i % 5}", f"s{i}", 1000 + i, 1010 + i, i, "ok", f"m{i % 3}", f'{{"k": {i}, "s": "v{i % 4}", "tags": [{{"n": "a{i % 2}"}}, {{"n": "b"}}], "d": {{"e": "{i}"}}}}' if i % 10 else "no json", i) for i in range(60)]
    shape = "tenant_id long, partition_id long, trace_id string, span_id string, start_time_ms long, end_time_ms long, duration_ms long, status string, model string, metadata string, commit_id long"
    return Engine(ingest.conformed(spark.createDataFrame(rows, shape)))


@pytest.mark.parametrize(
    "query",
    [
        "SELECT count(*) FROM parquet.`{0}`", "SELECT * FROM other", "SELECT * FROM spans WHERE 1 IN (SELECT a FROM other)", "SELECT * FROM other WHERE 1 IN (WITH other AS (SELECT 1 AS a) SELECT a FROM other)",
        "WITH x AS (SELECT * FROM other) SELECT * FROM x", "WITH x AS (SELECT 1 AS a) INSERT INTO other SELECT * FROM x", "SELECT * FROM IDENTIFIER('other')", "SELECT (SELECT max(a) FROM other) FROM spans", "SELECT * FROM default.spans",
        "SELECT * FROM spans JOIN LATERAL (SELECT * FROM other)", "SELECT * FROM spans, other", "SELECT * FROM spans |> UNION ALL (TABLE other)", "SELECT exists(SELECT * FROM other)", "SELECT * FROM sql_keywords()",
        "SELECT transform(array(1), x -> (SELECT max(a) FROM other))", "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect`('java.lang.System', 'lineSeparator')", "SELECT * FROM spans; DROP TABLE other", "TABLE other", "SELECT nonsense FROM (",
    ],
)
def test_other_tables_are_out_of_reach(spark, engine, tmp_path, query):
    spark.range(5).selectExpr("id AS a").createOrReplaceTempView("other")
    spark.range(5).write.mode("overwrite").parquet(str(tmp_path / "p"))
    with pytest.raises(DialectError):
        engine.sql(query.format(tmp_path / "p"), 1)


def numbers(engine, where, tenant=1):
    return sorted(r.duration_ms for r in engine.sql(f"SELECT duration_ms FROM spans WHERE {where}", tenant).collect())


@pytest.mark.parametrize(
    ("where", "keep"),
    [
        ("metadata.k > 50", lambda i: i > 50), ("50 >= metadata.k", lambda i: i <= 50), ("metadata.k = 4", lambda i: i == 4), ("metadata.k <> 4", lambda i: i != 4 or not i % 10), ("'v2' = metadata.s", lambda i: i % 4 == 2),
        ("metadata.s != 'v2'", lambda i: i % 4 != 2 or not i % 10), ("metadata.s >= 'v2'", lambda i: i % 4 >= 2), ("metadata.k IN (2, 4, 10)", lambda i: i in (2, 4)), ("metadata.s NOT IN ('v0', 'v2')", lambda i: i % 4 not in (0, 2) or not i % 10),
        ("metadata.s LIKE '%2'", lambda i: i % 4 == 2), ("metadata.s not like 'v_'", lambda i: not i % 10), ("metadata.k BETWEEN 6 AND 9", lambda i: 6 <= i <= 9), ("metadata.none IS NULL", lambda i: True), ("metadata.k IS NOT NULL AND duration_ms < 8", lambda i: i < 8),
        ("metadata.tags[*].n = 'a0'", lambda i: True), ("metadata.tags[*].n = 'a1'", lambda i: False), ("metadata.d.e = '12'", lambda i: i == 12), ("spans.metadata.k < 5 AND model = 'm2'", lambda i: i < 5 and i % 3 == 2), ("metadata.k < -1.5e0", lambda i: False),
    ],
)
def test_paths(engine, where, keep):
    always = where.endswith("IS NULL")
    two_valued = "<>" in where or "!=" in where or "NOT IN" in where or "not like" in where
    assert numbers(engine, where) == [i for i in range(0, 60, 2) if keep(i) and (i % 10 or always or two_valued)]


def test_paths_as_values_and_joins(engine):
    rows = engine.sql("WITH e AS (SELECT trace_id FROM spans WHERE duration_ms = 4) SELECT s.metadata.s AS v, count(*) AS n FROM spans s, e WHERE s.trace_id = e.trace_id GROUP BY s.metadata.s ORDER BY n DESC, v", 1).collect()
    assert [tuple(r) for r in rows] == [("v0", 3), ("v2", 3)]
    assert engine.sql("SELECT 1 AS a FROM spans UNION SELECT 2", 1).count() == 2
    assert engine.sql("SELECT * FROM VALUES (1), (2) AS t(a)", 1).count() == 2
    assert engine.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 5) SELECT * FROM r", 1).count() == 5


def test_limits_are_as_they_are_written(engine):
    assert "LIMIT 200000" in rewritten("SELECT * FROM spans LIMIT 200000").upper()
    assert Engine(engine.spans, most_rows=3).sql("SELECT * FROM spans LIMIT 20", 1).count() == 3


def test_percentiles_keep_their_type_and_rank(spark, engine):
    assert dict(engine.sql("SELECT percentile(duration_ms, 0.5) AS p FROM spans", 1).dtypes) == {"p": "bigint"}
    rows = [(n, float((i * 7919) % (10 * n + 1))) for n in (1, 2, 7, 20, 100) for i in range(n)]
    spark.createDataFrame(rows, "n int, v double").createOrReplaceTempView("ranked")
    for q in (0.0, 0.05, 0.5, 0.95, 0.99, 1.0):
        for r in spark.sql(f"SELECT n, {percentile_sql('v', q)} AS p FROM ranked GROUP BY n").collect():
            v = sorted(x for n, x in rows if n == r.n)
            assert r.p == v[min(int(len(v) * q), len(v) - 1)]
