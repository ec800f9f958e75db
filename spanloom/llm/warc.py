"""WARC files: writing, and reading by boundary-chain verification.

A WARC record is a header, a blank line, Content-Length bytes of payload and two line ends; in a .warc.gz file each record is a gzip
member. A reader that starts in the middle of a file can't tell the
start of a record from the same bytes inside a payload. So tasks scan ranges of bytes for the magic and emit candidates: the
offset, and by the header's length or the member's end the offset of the successor, and where the chain from it leaves the range. The chain from the
start of the file is then followed by pointer jumping over the places at which chains enter ranges, and within each range from there. Only candidates on it are records.
Payloads are read for those alone.

Files are opened with pyarrow's filesystems, so any that it knows (local, HDFS, S3, GCS) will do.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import filesystem, new_path, stored, tune

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
MAGIC_BYTES = 10
GZIP = b"\x1f\x8b\x08"
#: Bytes of a file that a task scans.
RANGE = 16 << 20
#: Bytes that are read past a range's end, at first, where a header or member goes on.
HEADER = 1 << 14
NAMES = ("page_id", "url", "html")
#: A line of a header: a name and a colon, or the continuation of the line before.
FIELD = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+[ \t]*:|[ \t]+[^ \t\r]")
LENGTH = re.compile(rb"content-length[ \t]*:[ \t]*(\d{1,18})[ \t]*", re.I)
#: Types of record that hold a page.
PAGES = (b"resource", b"response", b"conversion")


def record(page_id: int | None, url: str | None, page: str | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A resource record of WARC/1.0. What is null has no header line; a null page has a line that says so and no payload.

    A URL that a header line can't hold as it is (line ends, white space at an end, angle brackets around it) is escaped, and a line says so.
    """
    payload = b"" if page is None else page.encode()
    lines = ["WARC/1.0", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", "Content-Type: text/html; charset=utf-8"]
    if url is not None:
        if url != url.strip() or url[:1] == "<" or "\r" in url or "\n" in url:
            lines.append("X-Escaped-URI: 1")
            url = "".join(f"%{b:02X}" if b <= 32 or b in b"%<>" else chr(b) for b in url.encode()).encode("latin-1").decode()
        lines.append("WARC-Target-URI: " + url)
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if page is None:
        lines.append("X-Null-Payload: 1")
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parsed(header: bytes) -> dict[bytes, bytes]:
    """The fields of a header by their names in lower case; the first of each name counts. Continuation lines belong to the line before."""
    out: dict[bytes, bytes] = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", header).split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def page_of(header: bytes, payload: bytes) -> tuple[int | None, str | None, str | None] | None:
    """(page_id, url, html) of a record, or None where its type holds no page. Bytes that aren't UTF-8 are replaced; the HTTP header of a response is left out."""
    fields = parsed(header)
    if fields.get(b"warc-type", b"resource").lower() not in PAGES:
        return None
    page_id = int(fields[b"x-page-id"]) if re.fullmatch(rb"-?\d{1,19}", fields.get(b"x-page-id", b"")) else None
    page_id = page_id if page_id is None or -(2**63) <= page_id < 2**63 else None
    url = fields.get(b"warc-target-uri")
    if url is not None:
        if b"x-escaped-uri" in fields:
            url = re.sub(rb"%([0-9A-F]{2})", lambda m: bytes([int(m[1], 16)]), url)
        elif url[:1] == b"<" and url[-1:] == b">":
            url = url[1:-1]
        url = url.decode("utf-8", "replace")
    if b"x-null-payload" in fields:
        return page_id, url, None
    if fields.get(b"content-type", b"").lower().replace(b" ", b"").startswith(b"application/http") and payload[:5] == b"HTTP/":
        payload = payload.partition(b"\r\n\r\n")[2]
    return page_id, url, payload.decode("utf-8", "replace")


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html) rows as WARC files in ``folder``, one for each partition; returns (path, size) of the files.

    Each attempt of a task writes a file of its own name and only that of the attempt that succeeds is listed, so lost tasks leave
    nothing that is read.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/{uuid.uuid4().hex}.warc"
        out, size = None, 0
        for batch in batches:
            if out is None:
                store, at = filesystem(path)
                store.create_dir(at.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(at)
            for row in zip(*(batch.column(c).to_pylist() for c in NAMES), strict=True):
                size += out.write(record(*row))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "size"])

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return stored(plain.mapInArrow(run, "path string, size long"), "warcs")


def candidates_in(data: bytes, base: int, stop: int, more: Callable[[int, int], bytes]) -> list[tuple[int, int, int]]:
    """(offset, payload's offset, successor) of each magic that starts before ``stop``. ``more(offset, length)`` reads past ``data``.

    Lines of headers are read once each, however many magics stand before them.
    """
    out = []
    #: What a header that goes on with the line at this place comes to: (its end, the payload's length), or None.
    known: dict[int, tuple[int, int | None] | None] = {}
    ended = False
    for m in list(MAGIC.finditer(data)):
        if base + m.start() >= stop:
            break
        at, passed = m.end(), []
        while at not in known:
            end = data.find(b"\r\n", at)
            while end < 0 and not ended:
                piece = more(base + len(data), max(HEADER, len(data) // 2))
                ended = not piece
                data, seen = data + piece, max(len(data) - 1, at)
                end = data.find(b"\r\n", seen)
            if end < 0:
                known[at] = None
            elif end == at:
                known[at] = (end + 2, None)
            elif not FIELD.match(data, at, end):
                known[at] = None
            else:
                passed.append((at, end))
                at = end + 2
        found = known[at]
        for start, end in reversed(passed):
            if found is not None and (length := LENGTH.fullmatch(data, start, end)):
                found = (found[0], int(length[1]))
            known[start] = found
        if found is not None and found[1] is not None:
            body = base + found[0]
            out.append((base + m.start(), body, body + found[1] + 4))
    return out


def members_in(data: bytes, base: int, stop: int, more: Callable[[int, int], bytes]) -> list[tuple[int, int, int]]:
    """(offset, -1, successor) of each gzip member that starts before ``stop`` and holds a record."""
    out = []
    at = data.find(GZIP)
    while at >= 0 and base + at < stop:
        if (end := member_end(data, at, base, more)) is not None:
            out.append((base + at, -1, end))
        at = data.find(GZIP, at + 1)
    return out


def member_end(data: bytes, at: int, base: int, more: Callable[[int, int], bytes]) -> int | None:
    """Where the gzip member at ``at`` ends, if it holds a record."""
    unpack = zlib.decompressobj(31)
    begun, fed, piece = b"", at, data[at : at + HEADER]
    try:
        while True:
            part = unpack.decompress(piece, 1 << 20)
            begun = begun if len(begun) >= MAGIC_BYTES else begun + part[:MAGIC_BYTES]
            if len(begun) >= MAGIC_BYTES and not MAGIC.match(begun):
                return None
            if unpack.eof:
                return base + fed + len(piece) - len(unpack.unused_data) if MAGIC.match(begun) else None
            if unpack.unconsumed_tail:
                fed, piece = fed + len(piece) - len(unpack.unconsumed_tail), unpack.unconsumed_tail
                continue
            fed += len(piece)
            piece = data[fed : fed + (1 << 20)] or more(base + fed, 1 << 20)
            if not piece:
                return None
    except zlib.error:
        return None


FOUND = "path string, size long, range long, offset long, body long, next long, leaves long"


def candidates(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, size, range, offset, body, next, leaves) of every place in the files that looks like a record. ``files``: (path, size).

    ``leaves``: the first successor outside the range on the chain from here; null where the chain ends inside.
    """
    ranges = files.select("path", F.col("size").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    tasks = ranges.repartition(F.col("path"), F.col("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, whole, start in zip(*(batch.column(c).to_pylist() for c in ("path", "whole", "start")), strict=True):
                store, at = filesystem(path)
                with store.open_input_file(at) as f:
                    stop = min(start + size, whole)
                    # a magic that starts in the range may end past it
                    data = f.read_at(min(stop + MAGIC_BYTES - 1, whole) - start, start)
                    find = members_in if path.endswith(".gz") else candidates_in
                    found = find(data, start, stop, lambda o, n, f=f, whole=whole: f.read_at(max(min(n, whole - o), 0), o))
                if found:
                    leaves: dict[int, int | None] = {}
                    for o, _, n in reversed(found):
                        leaves[o] = n if n >= stop else leaves.get(n)
                    o, b, n = zip(*found, strict=True)
                    same = [[path] * len(o), [whole] * len(o), [start // size] * len(o)]
                    kinds = (pa.string(), *[pa.int64()] * 6)
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((*same, o, b, n, [leaves[x] for x in o]), kinds, strict=True)], [c.split()[0] for c in FOUND.split(", ")])

    return tasks.mapInArrow(run, FOUND)


def reachable(offset: np.ndarray, following: np.ndarray, start: int = 0) -> np.ndarray:
    """Which candidates are on the chain from ``start``, by pointer jumping: each round doubles the length of the jumps, and what is reached so far jumps on."""
    n = len(offset)
    order = np.argsort(offset)
    place = np.searchsorted(offset[order], following)
    ok = (place < n) & (offset[order][np.minimum(place, n - 1)] == following) if n else np.zeros(0, bool)
    jump = np.append(np.where(ok, order[np.minimum(place, n - 1)], n), n) if n else np.zeros(1, np.int64)
    reached = np.zeros(n + 1, bool)
    reached[:-1] = offset == start
    while True:
        targets = jump[np.flatnonzero(reached[:-1])]
        if (targets == n).all():
            return reached[:-1]
        reached[targets] = True
        reached[n] = False
        jump = jump[jump]


def entered(found: DataFrame) -> DataFrame:
    """(path, range, entry): the places at which the chains from the starts of the files enter ranges, at most one for each range.

    Only places to which a chain from some candidate leads count here, about one for each range, so the rows of even a very large file are few.
    """
    places = found.filter("leaves is not null").select("path", F.col("leaves").alias("offset")).distinct().unionByName(found.select("path").distinct().withColumn("offset", F.lit(0).cast("long")))
    places = found.select("path", "range", "offset", "leaves").join(places, ["path", "offset"])

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        keep = reachable(rows["offset"].to_numpy(), rows["leaves"].fillna(-1).to_numpy().astype(np.int64))
        return rows[keep][["path", "range", "offset"]].rename(columns={"offset": "entry"})

    return places.groupBy("path").applyInPandas(chain, "path string, range long, entry long")


def records(found: DataFrame) -> DataFrame:
    """The candidates that are records: those on the chain of successors from the start of their file. A record that its file cuts short is none."""

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        at = rows["offset"].to_numpy()
        keep = reachable(at, rows["next"].to_numpy(), rows["entry"].iloc[0])
        return rows[keep & (rows["next"].to_numpy() <= rows["size"].to_numpy())].drop(columns=["entry", "leaves"])

    return found.join(entered(found), ["path", "range"]).groupBy("path", "range").applyInPandas(chain, FOUND.replace(", leaves long", ""))


def breaks(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, size, offset): the files whose chain doesn't come to their end, and how far it comes. What lies beyond is not read."""
    ends = records(stored(candidates(files, size), "candidates")).groupBy("path").agg(F.max("next").alias("offset"))
    return files.select("path", "size").join(ends, "path", "left").withColumn("offset", F.coalesce("offset", F.lit(0).cast("long"))).filter(F.col("offset") < F.col("size")).select("path", "size", "offset")


def read(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(page_id, url, html) of the records of WARC files, of version 1.0 or 1.1, plain or (``.gz``) with a gzip member for each record. ``files``: (path, size).

    Records of types other than resource, response and conversion hold no pages. A file's records after a fault, or after a record that is cut short, aren't
    read; ``breaks`` names such files. Ids that are no numbers are null. Empty files have no records.
    """
    placed = records(stored(candidates(files, size), "candidates")).repartition(F.col("path"), F.col("range")).sortWithinPartitions("path", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, f = None, None
        for batch in batches:
            rows = []
            for path, offset, body, after in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "body", "next")), strict=True):
                if path != now:
                    if f is not None:
                        f.close()
                    store, at = filesystem(path)
                    now, f = path, store.open_input_file(at)
                data = f.read_at(after - offset, offset)
                if body < 0:
                    data = zlib.decompress(data, 31)
                    cut = data.find(b"\r\n\r\n") + 4
                    length = parsed(data[:cut]).get(b"content-length", b"")
                    end = cut + int(length) if length.isdigit() else max(len(data) - 4, cut)
                else:
                    cut, end = body - offset, len(data) - 4
                if (row := page_of(data[: cut - 4], data[cut:end])) is not None:
                    rows.append(row)
            ids, urls, pages = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(pages, pa.string())], list(NAMES))
        if f is not None:
            f.close()

    return placed.mapInArrow(run, "page_id long, url string, html string")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as WARC files of the shared folder and read them back.

    The result equals (page_id, url, html) of ``pages``, row for row: nulls and empty texts come back as they were, rows that repeat
    stay apart, payloads that hold the magic or whole records are not cut, and payloads of any length are read whole. Other columns are not written. An empty table gives an empty result.
    """
    return read(write(pages, new_path(spark, "warc")))
