import gzip
import time
from collections import Counter
from functools import cache

import numpy as np
import pytest

from spanloom.llm import warc as A
from spanloom.llm.shared import new_path

PAGES = "page_id long, url string, html string"


@cache
def odd_pages():
    inner = A.record(9, "http://inner", "inner").decode()
    return [
        (1, "http://a", "<p>x</p>"), (2, None, None), (None, "http://b\r\nContent-Length: 1", ""), (3, "u%0A", inner * 3), (8, " <b> %20\u2028", "x"), (9, "<http://c>", "y"), (4, "http://c", "é" * 50_000), (1, "http://a", "<p>x</p>"), (None, None, None),
        (5, "m", "WARC/1.0\r\n"), (6, "m", "WARC/1.0\r\nContent-Length: 99999999\r\n\r\n"), (7, "", "\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"),
    ]


def rows(df):
    return Counter(tuple(r) for r in df.select("page_id", "url", "html").collect())


def test_round_trip_of_odd_pages(spark):
    pages = spark.createDataFrame(odd_pages(), PAGES)
    files = A.write(pages.coalesce(1), new_path(spark, "warc"))
    for size in (97, A.RANGE):
        assert rows(A.read(files, size)) == Counter(odd_pages())
    # magic inside payloads is a candidate, but not on the chain
    found = A.candidates(files, 97)
    assert found.count() > len(odd_pages()) and A.records(found).count() == len(odd_pages())


def test_empty_table_and_other_columns(spark):
    assert A.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0
    df = spark.createDataFrame([(1, "u", "h", "p", 5)], PAGES + ", path string, size int")
    assert rows(A.round_trip(spark, df)) == Counter([(1, "u", "h")])


def test_pointer_jumping_against_following_the_chain():
    rng = np.random.default_rng(4)
    for _ in range(200):
        offset = np.sort(rng.choice(300, rng.integers(1, 80), replace=False))
        if rng.random() < 0.8:
            offset[0] = 0
        following = offset + rng.integers(1, 12, len(offset))
        turn = rng.permutation(len(offset))
        at, chain = 0, set()
        ends = dict(zip(offset.tolist(), following.tolist(), strict=True))
        while at in ends:
            chain.add(at)
            at = ends[at]
        assert set(offset[turn][A.reachable(offset[turn], following[turn])].tolist()) == chain


def test_a_record_cut_short_is_none(spark, tmp_path):
    whole = A.record(1, "u", "first")
    (tmp_path / "x.warc").write_bytes(whole + A.record(2, "u", "second")[:-9])
    path = f"file://{tmp_path}/x.warc"
    files = spark.createDataFrame([(path, (tmp_path / "x.warc").stat().st_size)], "path string, size long")
    assert rows(A.read(files)) == Counter([(1, "u", "first")])


def fileof(spark, path, data):
    path.write_bytes(data)
    return spark.createDataFrame([(f"file://{path}", len(data))], "path string, size long")


def foreign(version, kind, body, *fields):
    lines = [version, f"WARC-Type: {kind}", "WARC-Date: 2020-01-01T00:00:00Z", *fields, f"content-length:{len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
@pytest.mark.parametrize("size", [61, 1 << 20])
def test_files_of_other_writers(spark, tmp_path, packed, size):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>WARC/1.0\r\n</p>"
    records = [
        foreign("WARC/1.1", "warcinfo", b"software: x"), foreign("WARC/1.1", "request", b"GET / HTTP/1.1"),
        foreign("WARC/1.1", "response", http, "WARC-Target-URI: http://a/?q=%25%0A", "Content-Type: application/http; msgtype=response", "X-Folded: a", "\tb"),
        foreign("WARC/1.0", "resource", b"\xff plain", "WARC-Target-URI: <http://b/>", "X-Page-Id: none"), foreign("WARC/1.0", "conversion", b""),
    ]
    data = b"".join(map(gzip.compress, records)) if packed else b"".join(records)
    files = fileof(spark, tmp_path / ("x.warc.gz" if packed else "x.warc"), data)
    assert rows(A.read(files, size)) == Counter([(None, "http://a/?q=%25%0A", "<p>WARC/1.0\r\n</p>"), (None, "http://b/", "\ufffd plain"), (None, None, "")])
    assert A.breaks(files, size).count() == 0
    cut = len(data) - 7
    broken = fileof(spark, tmp_path / ("y.warc.gz" if packed else "y.warc"), data[:cut])
    last = len(gzip.compress(records[-1]) if packed else records[-1])
    assert [(r.size, r.offset) for r in A.breaks(broken, size).collect()] == [(cut, len(data) - last)]
    assert A.breaks(fileof(spark, tmp_path / "z.warc", b"no such file"), size).first().offset == 0


@pytest.mark.parametrize("payload", [b"WARC/1.0\r\n" * 100_000, b"A: WARC/1.0\r\n" * 80_000, b"WARC/1.0\r\nA: b\r\n" * 60_000, b"WARC/1.0\r\n" + b"x" * 1_000_000, b"WARC/1.0\r\n" + b" \r\n" * 300_000])
def test_hostile_payloads_take_linear_time(payload):
    data = A.record(1, "u", payload.decode())
    began = time.perf_counter()
    found = A.candidates_in(data, 0, len(data), lambda o, n: b"")
    assert (found[0][0], found[0][2]) == (0, len(data))
    assert time.perf_counter() - began < 5


def test_one_large_file_has_few_entries(spark, tmp_path):
    data = b"".join(A.record(i, "u", "WARC/1.0\r\nContent-Length: 3\r\n\r\n" * 3) for i in range(300))
    found = A.candidates(fileof(spark, tmp_path / "x.warc", data), 4_000)
    assert A.records(found).count() == 300 and found.count() > 900
    assert A.entered(found).count() <= len(data) // 4_000 + 1
