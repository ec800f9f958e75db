import time

from spanloom.llm import token_cache as C
from spanloom.llm.shared import is_parquet, new_path

from tests.llm.conftest import DOCS


def brute(texts):
    t = C.Tokenizer()
    encode = C.encoding(t.digest, t.ranks, t.pattern).encode_ordinary
    return [len(encode((x or "").replace("\r\n", "\n").strip(" \t\n"))) for x in texts]


def test_counts_and_cache(spark, documents, prose):
    texts = [prose(i % 7, 20 + i % 7) for i in range(20)] + [" a\r\nb ", "a\nb", "", None, "naïve 你好 \U0001f600"]
    cache = new_path(spark, "cache")
    want = brute(texts)
    got = {r.doc_id: r.tokens for r in C.counted(documents(list(enumerate(texts))), cache).collect()}
    assert got == dict(enumerate(want))
    held = C.read_cache(documents([]), cache)
    assert held.count() == 7 + 1 + 1 + 1 == held.select("digest").distinct().count()
    # only what the cache lacks is encoded and appended
    more = C.counted(documents([(1, texts[0]), (2, "new words")]), cache).collect()
    assert sorted((r.doc_id, r.tokens) for r in more) == [(1, want[0]), (2, brute(["new words"])[0])]
    held = C.read_cache(documents([]), cache)
    assert held.count() == 11 == held.select("digest").distinct().count()
    # a cached count is believed; another tokenizer has counts of its own
    other = C.Tokenizer(pattern=r"\p{L}|[^\p{L}]")
    assert other.digest != C.Tokenizer().digest
    C.counted(documents([(1, texts[0])]), cache, other).count()
    assert C.read_cache(documents([]), cache).count() == 12


def test_odd_rows_empty_table_and_clashing_names(spark, odd):
    got = C.counted(odd)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "tokens"] and got.count() == odd.count()
    assert {r.tokens for r in got.filter("doc_id in (2, 3, 4)").collect()} == {0}
    assert C.counted(spark.createDataFrame([], DOCS)).count() == 0
    df = spark.createDataFrame([(1, "a b", 5, b"x")], "doc_id long, text string, tokens int, digest binary")
    assert [tuple(r) for r in C.counted(df).collect()] == [(1, 5, b"x", brute(["a b"])[0])]


def test_a_parquet_table_is_read_where_it_lies(spark, documents, prose, tmp_path):
    texts = [prose(i % 50, 5 + i % 50) for i in range(400)] + ["", None]
    documents(list(enumerate(texts))).repartition(3).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/a table %41/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/a table %41/documents.parquet")
    assert is_parquet(docs) and not is_parquet(docs.filter("doc_id > 5")) and not is_parquet(documents([]))
    cache = new_path(spark, "cache")
    want = dict(enumerate(brute(texts)))
    assert {r.doc_id: r.tokens for r in C.counted(docs, cache).collect()} == want
    held = C.read_cache(docs, cache)
    assert held.count() == 51 == held.select("digest").distinct().count()
    assert {r.doc_id: r.tokens for r in C.counted(docs.filter("doc_id > 5")).collect()} == {k: n for k, n in want.items() if k > 5}


def test_long_runs_take_linear_time(documents):
    t = C.Tokenizer()
    encoder = C.encoding(t.digest, t.ranks, t.pattern)
    for gap in (" " * 12_000, "\n" * 12_000, " \n\t" * 5_000):
        for text in (f"a{gap}b c", f"a{gap}. b", gap + "x", f"a{gap}b{gap}", "a" + gap[:9_000] + "b"):
            assert C.count_tokens(encoder, text) == len(encoder.encode_ordinary(text))
    began = time.perf_counter()
    texts = ["a" + " " * 1_000_000 + "b", " " * 1_000_000, "z" * 1_000_000, "a" + "\r\n" * 500_000]
    got = {r.doc_id: r.tokens for r in C.counted(documents(list(enumerate(texts)))).collect()}
    assert got[1] == 0 and got[3] == 1 and got[0] > 2
    assert time.perf_counter() - began < 30
