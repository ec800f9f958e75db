"""Benchmark decontamination with suffix arrays over the training texts.

Each task joins its documents into shards of about ``SHARD`` bytes of text and sorts all suffixes that start at words, by prefix doubling
over word numbers, to their ends. Every suffix of every benchmark item is then found by binary search: first the interval of training
suffixes that begin with the words a match must have, which names the documents; then, in the suffix array of each such document, the
place of the whole test suffix, whose longest match is with one of its two neighbours there. No pair of positions is compared but those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordbytes as W
from .shared import gathered, lowered, text_buffer, tune

#: Words that a match must have; a shorter item must be matched whole. Items under LEAST_WORDS are left out; by default none is.
MATCH_WORDS, LEAST_WORDS = 13, 1
#: Bytes of text in a shard. A longer document is cut into pieces that overlap by the words of the longest item.
SHARD = 4 << 20
#: Bytes of benchmark that a task holds at once; a larger benchmark takes several passes.
PASS_BYTES = 16 << 20
#: Runs of words are compared by polynomials modulo two primes.
PRIMES = ((2147483629, 1103515245), (2147483587, 69621))

MATCH = "doc_id long, item_id long, match_words int, doc_word int, item_word int"


class Benchmark:
    """Items as word hashes. ``suffix``: the words at which a match may start; ``need``: the words that it must have."""

    def __init__(self, texts: list[str], match_words: int, least_words: int) -> None:
        raw, offsets = text_buffer(pa.array(texts, pa.string()))
        starts, ends, first = W.spans(raw, offsets)
        self.hash = W.word_hashes(raw, starts, ends, W.Powers())
        counts = np.diff(first)
        self.item = np.repeat(np.arange(len(texts)), counts)
        self.word = np.arange(len(self.hash)) - first[:-1][self.item]
        self.end = first[1:][self.item]
        need = np.minimum(match_words, counts)[self.item]
        self.suffix = np.flatnonzero((counts[self.item] >= least_words) & (self.word + need <= counts[self.item]))
        self.need = need[self.suffix]
        self.longest = int(counts.max(initial=0))


def suffix_array(ids: np.ndarray, end: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The suffixes in order (a suffix ends with its document, before longer ones), the packed first words of each in that order, how many words these are, and the bits of each.

    ``ids``: numbers from 1 to ``size``; ``end``: for each position the end of its document. The first sort packs as many words into a
    key as fit; then the depth doubles, and only groups of equals are sorted again.
    """
    n = len(ids)
    bits = int(size).bit_length()
    depth = 63 // bits
    at = np.arange(n)
    padded = np.concatenate((ids, np.zeros(depth, np.int64)))
    key = np.zeros(n, np.int64)
    for j in range(depth):
        key <<= bits
        key |= np.where(at + j < end, padded[j : j + n], 0)
    array = np.argsort(key)
    keys = key[array]
    rank = np.empty(n, np.int64)
    slots, sorted_, k = at, keys, depth
    while len(slots):
        own = array[slots]
        new = np.ones(len(slots), bool)
        new[1:] = sorted_[1:] != sorted_[:-1]
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, len(slots)))
        rank[own] = np.repeat(slots[heads], sizes) + 1
        # of equals that ended before this depth, nothing more is to be told
        slots = slots[np.repeat(sizes > 1, sizes) & (end[own] - own >= k)]
        own = array[slots]
        after = own + k
        sorted_ = rank[own] * (n + 1) + np.where(after < end[own], rank[np.minimum(after, n - 1)], 0)
        turn = np.argsort(sorted_)
        array[slots], sorted_ = own[turn], sorted_[turn]
        k *= 2
    return array, keys, depth, bits


class Runs:
    """Compares runs of words of a shard and of the benchmark, of any length, at the cost of a few products."""

    def __init__(self, shard: np.ndarray, bench: np.ndarray) -> None:
        longest = max(len(shard), len(bench)) + 1
        self.parts = []
        for p, base in PRIMES:
            up = np.ones(1, np.uint64)
            while len(up) < longest:
                up = np.concatenate((up, up * W.U(pow(base, len(up), p)) % W.U(p)))
            sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(h % W.U(p) * up[: len(h)] % W.U(p)) % W.U(p))) for h in (shard, bench)]
            self.parts.append((W.U(p), up, *sums))

    def equal(self, p: np.ndarray, q: np.ndarray, size: int) -> np.ndarray:
        """Whether the runs of ``size`` words at ``p`` of the shard and at ``q`` of the benchmark are the same."""
        out = np.ones(len(p), bool)
        for m, up, a, b in self.parts:
            out &= (a[p + size] + m - a[p]) % m * up[q] % m == (b[q + size] + m - b[q]) % m * up[p] % m
        return out


class Shard:
    """Texts with their suffix array, ready for a benchmark's suffixes."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, bench: Benchmark) -> None:
        starts, ends, self.first = W.spans(raw, offsets)
        self.hash, self.bench = W.word_hashes(raw, starts, ends, W.Powers()), bench
        self.docs = len(offsets) - 1
        self.doc = np.repeat(np.arange(self.docs), np.diff(self.first))
        self.end = self.first[1:][self.doc]
        known, ids = np.unique(self.hash, return_inverse=True)
        self.array, self.keys, self.depth, self.bits = suffix_array(ids + 1, self.end, max(len(known), 1))
        # words of the shard have even numbers; a word that it lacks has the odd number of its place
        self.number = 2 * (ids + 1)
        at = np.searchsorted(known, bench.hash)
        self.there = known[np.minimum(at, len(known) - 1)] == bench.hash if len(known) else np.zeros(len(at), bool)
        self.asked = np.where(self.there, 2 * (at + 1), 2 * at + 1)
        self.intervals()

    def compared(self, p: np.ndarray, q: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The sign of the first ``need`` words of the suffixes at ``p`` against those at ``q``."""
        sign = np.zeros(len(p), np.int64)
        live, j = np.arange(len(p)), 0
        while len(live := live[need[live] > j]):
            x = np.where(p[live] + j < self.end[p[live]], self.number[np.minimum(p[live] + j, len(self.number) - 1)], 0)
            sign[live] = d = np.sign(x - self.asked[q[live] + j])
            live = live[d == 0]
            j += 1
        return sign

    def intervals(self) -> None:
        """``q``: suffixes of the benchmark whose first words stand in the shard; ``low`` and ``high``: where in the suffix array."""
        bench = self.bench
        # all words needed must be known
        missing = np.concatenate(([0], np.cumsum(~self.there)))
        ok = missing[bench.suffix + bench.need] == missing[bench.suffix]
        q, need = bench.suffix[ok], bench.need[ok]
        low_key, high_key = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for j in range(self.depth):
            x = np.where(j < need, self.asked[np.minimum(q + j, max(len(self.asked) - 1, 0))] // 2, 0) if len(q) else low_key
            low_key, high_key = low_key << self.bits | x, high_key << self.bits | np.where(j < need, x, (1 << self.bits) - 1)
        low, high = np.searchsorted(self.keys, low_key, "left"), np.searchsorted(self.keys, high_key, "right")
        live = high > low
        q, need, low, high = q[live], need[live], low[live], high[live]
        deep = np.flatnonzero(need > self.depth)
        if len(deep):
            a = self.bounds(q[deep], need[deep], low[deep], high[deep], 0)
            high[deep] = self.bounds(q[deep], need[deep], a, high[deep], 1)
            low[deep] = a
        live = high > low
        self.q, self.low, self.high = q[live], low[live], high[live]

    def bounds(self, q: np.ndarray, need: np.ndarray, low: np.ndarray, high: np.ndarray, above: int) -> np.ndarray:
        """The first place in [low, high) whose suffix isn't less than (above = 1: is more than) the first ``need`` words at ``q``."""
        low, high = low.copy(), high.copy()
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            up = self.compared(self.array[mid], q[live], need[live]) < above
            low[live[up]], high[live[~up]] = mid[up] + 1, mid[~up]
        return low

    def leaked(self) -> np.ndarray:
        """Which documents hold a match."""
        edge = np.zeros(len(self.array) + 1, np.int64)
        np.add.at(edge, self.low, 1)
        np.add.at(edge, self.high, -1)
        out = np.zeros(self.docs, bool)
        out[self.doc[self.array[np.cumsum(edge[:-1]) > 0]]] = True
        return out

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Words that the suffixes have in common."""
        left = np.minimum(self.end[p] - p, self.bench.end[q] - q)
        got = np.zeros(len(p), np.int64)
        step = 1 << int(left.max(initial=0)).bit_length()
        while step := step >> 1:
            live = np.flatnonzero(got + step <= left)
            got[live] += step * self.runs.equal(p[live] + got[live], q[live] + got[live], step)
        return got

    def longest(self) -> tuple[np.ndarray, ...]:
        """(document, item, words, word of the document, word of the item): the longest match of each document and item, the earliest of equals."""
        none = np.zeros(0, np.int64)
        if not len(self.q):
            return none, none, none, none, none
        self.runs = Runs(self.hash, self.bench.hash)
        # the documents of each interval; suffixes of the benchmark with the same first words share theirs
        spans, which = np.unique(self.low * (len(self.array) + 1) + self.high, return_inverse=True)
        low, high = spans // (len(self.array) + 1), spans % (len(self.array) + 1)
        span = np.repeat(np.arange(len(spans)), high - low)
        there = np.unique(span * self.docs + self.doc[self.array[ranges(low, high)]])
        span, doc = there // self.docs, there % self.docs
        by_span = np.argsort(which, kind="stable")
        bound = np.searchsorted(which[by_span], np.arange(len(spans) + 1))
        q = self.q[by_span[ranges(bound[span], bound[span + 1])]]
        doc = np.repeat(doc, bound[span + 1] - bound[span])
        # the suffix array of each document
        wanted = np.zeros(self.docs, bool)
        wanted[doc] = True
        self.own = self.array[wanted[self.doc[self.array]]]
        self.own = self.own[np.argsort(self.doc[self.own], kind="stable")]
        of = self.doc[self.own]
        start, stop = np.searchsorted(of, doc, "left"), np.searchsorted(of, doc, "right")
        place = self.placed(q, np.full(len(q), len(self.bench.hash)), start, stop, 0)
        size = np.zeros(len(q), np.int64)
        for x in (place - 1, place):
            ok = (x >= start) & (x < stop)
            size[ok] = np.maximum(size[ok], self.common(self.own[x[ok]], q[ok]))
        item = self.bench.item[q]
        turn = np.lexsort((-size, item, doc))
        pair = doc[turn] * (len(self.bench.end) + 1) + item[turn]
        head = np.concatenate(([True], pair[1:] != pair[:-1]))
        most = np.repeat(size[turn][head], np.diff(np.append(np.flatnonzero(head), len(pair))))
        best = turn[size[turn] == most]
        q, doc, item, size, start, stop = (x[best] for x in (q, doc, item, size, start, stop))
        # of all places in the document with the longest match, the first
        low = self.placed(q, size, start, stop, 0)
        high = self.placed(q, size, low, stop, 1)
        spans, which = np.unique(low * (len(self.own) + 1) + high, return_inverse=True)
        ends = np.stack((spans // (len(self.own) + 1), spans % (len(self.own) + 1)), axis=1).ravel()
        place = np.minimum.reduceat(np.append(self.own, len(self.array)), ends)[::2][which] - self.first[doc]
        turn = np.lexsort((q, place, item, doc))
        head = np.concatenate(([True], (doc[turn][1:] != doc[turn][:-1]) | (item[turn][1:] != item[turn][:-1])))
        keep = turn[head]
        return doc[keep], item[keep], size[keep], place[keep], self.bench.word[q[keep]]

    def placed(self, q: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, above: int) -> np.ndarray:
        """Like ``bounds``, in the suffix arrays of documents, for the first ``size`` words at ``q``, or as many as its item has."""
        low, high = low.copy(), high.copy()
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            p, own = self.own[mid], q[live]
            same = np.minimum(self.common(p, own), size[live])
            x = np.where(p + same < self.end[p], self.number[np.minimum(p + same, len(self.number) - 1)], 0)
            y = np.where(own + same < self.bench.end[own], self.asked[np.minimum(own + same, len(self.asked) - 1)], 0)
            up = np.where(same == size[live], 0, np.sign(x - y)) < above
            low[live[up]], high[live[~up]] = mid[up] + 1, mid[~up]
        return low


def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers from low to high of each pair, one pair after the other."""
    size = high - low
    base = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(low - base[:-1], size) + np.arange(base[-1])


def pieces(raw: np.ndarray, offsets: np.ndarray, overlap: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, words before): the texts at once, or a single text of more than two limits in pieces, each with the ``overlap`` words that follow it."""
    if len(offsets) != 2 or len(raw) <= 2 * limit:
        yield raw, offsets, 0
        return
    at = before = 0

    def boundary(x: int) -> int:
        while x < len(raw):
            gap = np.flatnonzero(~W.IS_WORD[raw[x : x + 4096]])
            if len(gap):
                return x + int(gap[0])
            x += 4096
        return len(raw)

    while at < len(raw):
        end = boundary(min(at + limit, len(raw)))
        size, words = 16 * overlap + 64, -1
        while words < overlap:
            stop = boundary(min(end + size, len(raw)))
            words = len(W.spans(raw[end:stop], np.array([0, stop - end]))[0]) if stop < len(raw) else overlap
            size *= 2
        yield raw[at:stop], np.array([0, stop - at]), before
        before += len(W.spans(raw[at:end], np.array([0, end - at]))[0])
        at = end


def finder(held, match_words: int, least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in held.value], np.int64)
        bench = Benchmark([t for _, t in held.value], match_words, least_words)
        for batch in gathered(batches, "text", SHARD):
            for raw, offsets, before in pieces(*text_buffer(batch.column("text")), bench.longest, SHARD):
                doc, item, size, place, word = Shard(raw, offsets, bench).longest()
                if len(doc):
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(doc)), pa.array(ids[item]), pa.array(size.astype(np.int32)), pa.array((place + before).astype(np.int32)), pa.array(word.astype(np.int32))],
                        ["doc_id", "item_id", "match_words", "doc_word", "item_word"],
                    )

    return run


def cleaner(held, column: str, match_words: int, least_words: int):
    """Leaves out rows whose ``column`` holds a match, and the column itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark([t for _, t in held.value], match_words, least_words)
        for batch in gathered(batches, column, SHARD):
            leaked = np.zeros(batch.num_rows, bool)
            for raw, offsets, _ in pieces(*text_buffer(batch.column(column)), bench.longest, SHARD):
                leaked |= Shard(raw, offsets, bench).leaked()
            yield batch.filter(pa.array(~leaked)).drop_columns([column])

    return run


def passes(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's items in lists of at most ``limit`` bytes, or one longer item, so that what a task holds has a fixed size."""
    held: list[tuple[int | None, str]] = []
    size = 0
    for row in benchmark.select(F.col("item_id").cast("long"), lowered("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        if held and size + len(row.text.encode()) > limit:
            yield held
            held, size = [], 0
        held.append((row.item_id, row.text))
        size += len(row.text.encode())
    yield held


def matches(docs: DataFrame, benchmark: DataFrame, match_words: int = MATCH_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """Longest verbatim matches: (doc_id, item_id, match_words, doc_word, item_word).

    One row for each document and item that share a run of at least ``match_words`` whole words, or all words of an item
    that is shorter; items under ``least_words`` words are left out (with the default of 1, none that has a word). Words are compared in lower case,
    whatever stands between them. doc_word and item_word count words from 0; of equally long matches
    the first in the document counts, then the first in the item.

    Nulls: rows without doc_id, item_id or text give nothing. Empty texts and tables give nothing. Rows that repeat a
    doc_id or an item_id count as one, with the longest match of any. Texts of any length are searched whole. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered("text").alias("text")).filter("doc_id is not null")
    found = None
    for items in passes(benchmark.filter("item_id is not null"), PASS_BYTES):
        part = texts.mapInArrow(finder(spark.sparkContext.broadcast(items), match_words, least_words), MATCH)
        found = part if found is None else found.unionByName(part)
    best = F.struct("match_words", -F.col("doc_word"), -F.col("item_word"))
    return found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("match_words", "doc_word", "item_word"), best).alias("m")).select("doc_id", "item_id", "m.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, match_words: int = MATCH_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the rows whose text has a match, in one pass without a shuffle.

    Each row is judged by its own text: rows without a doc_id, and rows that share one, stay or go like any other. An item counts whether it has an id or
    not. Rows without text stay. All columns stay as they are, whatever their names. Empty tables give no match.
    """
    spark = docs.sparkSession
    tune(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    rest = docs.toDF(*names)
    text = next(i for i, c in zip(names, docs.columns, strict=True) if c.lower() == "text")
    schema = rest.schema
    for items in passes(benchmark, PASS_BYTES):
        rest = rest.withColumn("low", lowered(text)).mapInArrow(cleaner(spark.sparkContext.broadcast(items), "low", match_words, least_words), schema)
    return rest.toDF(*docs.columns)


def oracle_sql(match_words: int = MATCH_WORDS, least_words: int = LEAST_WORDS) -> str:
    """The same by joining runs of words and merging those that follow each other."""
    words = "regexp_extract_all(lower(text), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
    return f"""
WITH d AS (SELECT doc_id, {words} AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, {words} AS w, least({match_words}, len(w)) AS m FROM benchmark WHERE item_id IS NOT NULL AND len({words}) >= {max(least_words, 1)}),
bg AS (SELECT item_id, m, unnest(range(len(w) - m + 1)) AS q, w[q + 1 : q + m] AS gram FROM b),
sizes AS (SELECT DISTINCT m FROM b),
dp AS (SELECT doc_id, m, w, unnest(range(len(w) - m + 1)) AS p FROM d, sizes WHERE len(w) >= m),
hit AS (SELECT doc_id, item_id, bg.m, p, q FROM (SELECT doc_id, m, p, w[p + 1 : p + m] AS gram FROM dp) x JOIN bg ON x.m = bg.m AND x.gram = bg.gram),
run AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - q ORDER BY p) AS island FROM (SELECT DISTINCT * FROM hit)),
found AS (SELECT doc_id, item_id, min(p) AS p, min(q) AS q, count(*) - 1 + any_value(m) AS n FROM run GROUP BY doc_id, item_id, p - q, island)
SELECT doc_id, item_id, n::INTEGER AS match_words, p::INTEGER AS doc_word, q::INTEGER AS item_word FROM found
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, p, q) = 1"""
