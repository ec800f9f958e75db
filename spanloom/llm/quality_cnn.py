"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters over learned byte
embeddings slide over each chunk; each filter's largest response in the chunk is kept. A document's chunk
features are combined by their mean and their largest values, and a hidden and a logistic layer give one probability that the document is
of good quality, as the labels' column ``quality`` says.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, gathered, stored, text_buffer, tune

CHUNK, STEP = 256, 240
WIDTH, DIM, FILTERS, HIDDEN = 10, 8, 32, 16
#: Filters are tried at every byte of a chunk.
PLACES = CHUNK - WIDTH + 1
#: Labelled documents that training reads at most, the least by a hash of doc_id. It is the one bound here; scoring has none.
MOST_LABELLED = 4000
#: Bytes of text that training holds at most; where the chosen documents have more, those first by the hash that fit are taken, one at least.
MOST_BYTES = 64 << 20
EPOCHS, BATCH, RATE = 6, 32, 0.004
THRESHOLD = 0.5
SLICE = 1 << 20
#: Chunks that go through the filters at once, in training and in scoring.
BLOCK, SCORED = 128, 16


def bounds_of(offsets: np.ndarray) -> np.ndarray:
    """The number of each document's first chunk, and of all at the end. An empty document has one chunk."""
    return np.concatenate(([0], np.cumsum(np.maximum(-(-(np.diff(offsets) - (CHUNK - STEP)) // STEP), 1))))


def chunks_at(raw: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, low: int, high: int) -> np.ndarray:
    """The chunks (n, CHUNK) from ``low`` to ``high``, zero-padded."""
    number = np.arange(low, min(high, bounds[-1]))
    doc = np.searchsorted(bounds, number, "right") - 1
    at = offsets[:-1][doc] + (number - bounds[doc]) * STEP
    left = np.minimum(offsets[1:][doc] - at, CHUNK)
    out = np.zeros((len(number), CHUNK), np.uint8)
    whole = np.flatnonzero(left == CHUNK)
    if len(whole):
        out[whole] = np.lib.stride_tricks.sliding_window_view(raw, CHUNK)[at[whole]]
    for i in np.flatnonzero(left < CHUNK):
        out[i, : left[i]] = raw[at[i] : at[i] + left[i]]
    return out


def chunked(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks (n, CHUNK) of all documents, zero-padded, and the bounds by document. An empty document has one chunk of zeros."""
    bounds = bounds_of(offsets)
    return chunks_at(raw, offsets, bounds, 0, bounds[-1]), bounds


def windows(chunks: np.ndarray, e: np.ndarray) -> np.ndarray:
    """(n * PLACES, WIDTH * DIM): the embedded bytes under each filter place."""
    x = e[chunks].reshape(len(chunks), CHUNK * DIM)
    step = x.strides[1]
    view = np.lib.stride_tricks.as_strided(x, (len(x), PLACES, WIDTH * DIM), (x.strides[0], DIM * step, step))
    return np.ascontiguousarray(view).reshape(-1, WIDTH * DIM)


def tables(m: dict) -> np.ndarray:
    """(WIDTH / 2, 65536, FILTERS): what each pair of bytes adds to the responses at each even place of a filter.

    A response is a sum over the bytes under the filter, so two bytes' part is looked up at once in place of 2 * DIM products.
    """
    one = np.einsum("bd,kdf->kbf", m["e"], m["w"].reshape(WIDTH, DIM, FILTERS))
    return (one[0::2, :, None, :] + one[1::2, None, :, :]).reshape(WIDTH // 2, 65536, FILTERS).astype(np.float32)


def features(raw: np.ndarray, offsets: np.ndarray, bounds: np.ndarray, m: dict) -> np.ndarray:
    """The largest response of each filter in each chunk. Chunks are made a few at a time, so a long text takes little more than its own bytes."""
    if "t" not in m:
        m["t"] = tables(m)
    out = np.empty((bounds[-1], FILTERS), np.float32)
    for i in range(0, bounds[-1], SCORED):
        part = chunks_at(raw, offsets, bounds, i, i + SCORED)
        # pairs of bytes, the first in the upper half
        pairs = part[:, :-1].astype(np.intp) << 8 | part[:, 1:]
        total = m["t"][0].take(pairs[:, :PLACES], axis=0)
        for k in range(1, WIDTH // 2):
            total += m["t"][k].take(pairs[:, 2 * k : 2 * k + PLACES], axis=0)
        out[i : i + SCORED] = total.max(axis=1)
    return np.maximum(out + m["b"], 0)


def pooled(f: np.ndarray, bounds: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each document the chunks' mean and largest features, and its length, which tells a short chunk from a monotonous one."""
    low = bounds[:-1]
    size = np.diff(offsets)[:, None]
    length = np.concatenate((np.log1p(size) / 4, np.minimum(size / CHUNK, 1)), axis=1).astype(np.float32)
    return np.concatenate((np.add.reduceat(f, low, axis=0) / np.diff(bounds)[:, None].astype(np.float32), np.maximum.reduceat(f, low, axis=0), length), axis=1)


def probabilities(raw: np.ndarray, offsets: np.ndarray, m: dict) -> np.ndarray:
    bounds = bounds_of(offsets)
    hidden = np.maximum(pooled(features(raw, offsets, bounds, m), bounds, offsets) @ m["h"] + m["a"], 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ m["v"] + m["c"], -30, 30)))


def train(texts: list[str], good: np.ndarray, seed: int = 5) -> dict:
    """Fit the network with Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    m = {
        "e": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "w": (rng.normal(0, 1, (WIDTH * DIM, FILTERS)) * 0.1).astype(np.float32),
        "b": np.zeros(FILTERS, np.float32), "h": (rng.normal(0, 0.15, (2 * FILTERS + 2, HIDDEN))).astype(np.float32), "a": np.zeros(HIDDEN, np.float32),
        "v": (rng.normal(0, 0.3, HIDDEN)).astype(np.float32), "c": np.zeros(1, np.float32),
    }
    if not len(texts) or good.all() or not good.any():
        # nothing to tell apart: everything is as likely as the labels say
        m["v"][:] = 0
        m["c"][:] = 20.0 if not len(texts) or good.all() else -20.0
        return m
    state = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in m.items()}
    t = 0
    batches_a_pass = -(-len(texts) // BATCH)
    for epoch in range(EPOCHS):
        turn = rng.permutation(len(texts))
        for i in range(0, len(turn), BATCH):
            own = turn[i : i + BATCH]
            raw, offsets = text_buffer(pa.array([texts[k] for k in own], pa.string()))
            chunks, bounds = chunked(raw, offsets)
            n = len(chunks)
            f, best = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
            for j in range(0, n, BLOCK):
                part = chunks[j : j + BLOCK]
                r = (windows(part, m["e"]) @ m["w"]).reshape(len(part), PLACES, FILTERS)
                best[j : j + BLOCK] = a = r.argmax(axis=1)
                f[j : j + BLOCK] = np.take_along_axis(r, a[:, None], 1)[:, 0]
            f = np.maximum(f + m["b"], 0)
            p = pooled(f, bounds, offsets)
            u = np.maximum(p @ m["h"] + m["a"], 0)
            y = 1 / (1 + np.exp(-np.clip(u @ m["v"] + m["c"], -30, 30)))
            d = (y - good[own]).astype(np.float32) / len(own)
            du = d[:, None] * m["v"] * (u > 0)
            g = {"v": u.T @ d, "c": np.array([d.sum()], np.float32), "h": p.T @ du, "a": du.sum(axis=0)}
            dp = du @ m["h"].T
            doc = np.repeat(np.arange(len(own)), np.diff(bounds))
            top = p[:, FILTERS : 2 * FILTERS][doc] == f
            df = dp[doc, :FILTERS] / np.diff(bounds)[doc][:, None].astype(np.float32) + dp[doc, FILTERS : 2 * FILTERS] * top
            df *= f > 0
            g["b"] = df.sum(axis=0)
            # only the place that gave the largest response has a gradient
            g["w"], g["e"] = np.zeros_like(m["w"]), np.zeros_like(m["e"])
            for k in range(FILTERS):
                rows = np.flatnonzero(df[:, k])
                under = chunks[rows[:, None], best[rows, k][:, None] + np.arange(WIDTH)]
                g["w"][:, k] = df[rows, k] @ m["e"][under].reshape(len(rows), -1)
                back = df[rows, k][:, None, None] * m["w"][:, k].reshape(1, WIDTH, DIM)
                flat = under.ravel()
                for q in range(DIM):
                    g["e"][:, q] += np.bincount(flat, back[:, :, q].ravel(), 256)
            t += 1
            rate = RATE * 0.5 * (1 + np.cos(np.pi * t / (EPOCHS * batches_a_pass)))
            for k, x in m.items():
                a, b = state[k]
                a += 0.1 * (g[k] - a)
                b += 0.001 * (g[k] ** 2 - b)
                x -= (rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return m


def labelled(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> tuple[list[str], np.ndarray]:
    """At most ``most`` labelled texts of MOST_BYTES together, the least by a hash of doc_id, and whether each is good. Labels without doc_id or quality don't count."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good"))
    chosen = stored(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "good").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    # at most ``most`` rows, whose sizes are added up in one place
    turn = Window.orderBy(F.xxhash64("doc_id"), "doc_id")
    texts = stored(texts, "training").withColumn("turn", F.row_number().over(turn))
    sizes = texts.select("turn", F.sum(F.octet_length("text")).over(turn).alias("bytes")).filter((F.col("bytes") <= MOST_BYTES) | (F.col("turn") == 1))
    last = sizes.agg(F.max("turn")).first()[0] or 0
    rows = sorted(((r.doc_id, r.text, r.good) for r in texts.filter(F.col("turn") <= last).toLocalIterator()), key=lambda r: r[0])
    return [r[1] for r in rows], np.array([r[2] for r in rows], bool)


def scored(docs: DataFrame, model: dict, name: str = "probability") -> DataFrame:
    """``docs`` with the probability of each text, in a column of a free name like ``name``.

    A null text counts as empty. All other columns pass through, whatever their names.
    """
    spark = docs.sparkSession
    tune(spark)
    column = free_name(docs, name)
    held = spark.sparkContext.broadcast(model)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    plain = docs.toDF(*inner)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, f"c{at}", SLICE):
            p = probabilities(*text_buffer(batch.column(at)), held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.float64))], [*inner, "p"])

    out = plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("p", T.DoubleType())]))
    return out.toDF(*docs.columns, column)


def fitted(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> dict:
    return train(*labelled(docs, labels, most))


def classified(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = MOST_LABELLED) -> DataFrame:
    """The documents that the classifier keeps, with all their columns and their probability.

    The network is fitted on at most ``most`` labelled documents, and MOST_BYTES of text, and scores every document's whole text, however long; those under ``threshold`` go,
    those at it stay.

    Nulls: a null text is scored as an empty one; labels without doc_id or quality are left out. Rows that repeat a doc_id are scored each; for
    training they count once, and labels of one doc_id that differ count as bad. Without labels, or with labels of one kind only,
    all documents get the same answer. Columns may have any names; the probability's gets underscores in front where it is taken. An empty table gives an empty result.
    """
    out = scored(docs, fitted(docs, labels, most))
    return out.filter(F.col(out.columns[-1]) >= threshold)
