import duckdb

from spanloom.llm import quality_rules as R

from tests.llm.conftest import DOCS


def test_against_sql_in_any_order(spark, documents, prose, tmp_path, monkeypatch):
    texts = [prose(i, 10 + 7 * i) for i in range(25)]
    texts += ["", None, "ab", "### $$$ %%% " * 9, "SHOUTING ALL THE TIME NOW", "no! no! no! no!", "a | b | c | d", "12345 67890 " * 8, "x" * 400, "same same same " * 60, "line\n" * 40, "é ü ñ words that are fine here", "tab\tand\nlines of plain words \U0001f600"]
    docs = documents(list(enumerate(texts)))
    docs.coalesce(1).write.parquet(f"{tmp_path}/d")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/d/*.parquet'")
    want = {r[0] for r in con.execute(R.oracle_sql("doc_id")).fetchall()}
    assert set(range(25)) <= want and len(want) < len(texts) - 8
    assert {r.doc_id for r in R.passed(docs, sample_rows=18).collect()} == want
    monkeypatch.setattr(R, "in_order", lambda d, rules, sample_rows: list(reversed(rules)))
    assert {r.doc_id for r in R.passed(docs).collect()} == want


def test_order_is_by_rejection_for_cost(documents, prose):
    docs = documents([(i, "ab" if i % 2 else prose(i, 30)) for i in range(200)])
    order = R.in_order(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in R.RULES)
    # a rule that rejects nothing comes after those that do
    assert order[0].name in {"has_text", "mostly_letters", "word_length", "few_capitals"}


def test_odd_rows_empty_table_and_clashing_names(spark, odd, prose):
    kept = R.passed(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == sorted((i is None, i or 0) for i in [1, 1, None, 5, 6, 7, -(2**63), 2**63 - 1])
    assert R.passed(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, prose(1, 50), 2, 3, "x")], "doc_id long, text string, d int, h int, w string")
    assert [r.w for r in R.passed(df).collect()] == ["x"]


def test_features_are_made_once_and_the_sample_has_a_fixed_size(spark, documents, prose, tmp_path):
    text = R.cascade(list(R.RULES))
    assert all(text.count(spark_sql) == 1 for spark_sql, _ in R.FEATURES.values())
    documents([(i, prose(i, 20)) for i in range(3000)]).repartition(20).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    assert 150 < R.sampled(docs, 300).count() < 450 and 150 < R.sampled(docs.filter("doc_id >= 0"), 300).count() < 450
    # files hold about equally many rows
    assert abs(R.sampled(docs, 10**9).count() - 3000 * R.SAMPLE_FILES // 20) < 100
