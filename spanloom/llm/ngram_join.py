"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

Texts are lower-cased and cut into words; a document's set holds the hashes of its word n-grams.
Two documents match where the Jaccard similarity of their sets is at least ``threshold``.

``ngram_links`` verifies every pair of different texts that shares a bucket and gives each document its class, the number of its
links and its best partner; documents with equal word sequences share the links of one of them, so copies make no pairs.

Where only groups are wanted, ``ngram_join`` verifies far fewer pairs: every document that has a match is
linked to one verified partner, and groups are the components of all verified candidate pairs.

1. ``sketch``: one pass over the texts gives a digest of the word sequence and the band hashes.
2. Documents with equal word sequences collapse into the one of the least id (similarity 1).
3. Band hashes are shuffled; in each bucket the least id is the pivot. Each document is verified against the
   pivot with which it shares most bands. A link leads to a smaller id, so links form trees.
4. Trees are contracted by pointer jumping; every pair in a bucket that still spans two trees is
   verified too. There is no cap on buckets: pairs left out are already linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbytes as W
from .shared import gathered, lowered, remove, stored, text_buffer, tune

N, THRESHOLD, RECALL = 3, 0.5, 0.95
MOST_PERMUTATIONS = 192
SLICE = 2 << 20

EDGE = "doc_id long, partner_id long, jaccard double"


def choose_bands(threshold: float, recall: float, most: int = MOST_PERMUTATIONS) -> tuple[int, int]:
    """Bands and rows: the most rows, so the fewest false candidates, that reach ``recall`` at the threshold within ``most`` permutations."""
    best = (most, 1)
    for rows in range(1, 17):
        for bands in range(1, most // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                best = (bands, rows)
                break
    return best


def unique(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


SKETCH = "doc_id long, d1 long, d2 long, grams long, bands array<long>"


def sketches(n: int, bands: int, rows: int):
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**32, bands * rows, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 2**32, bands * rows, dtype=np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers()
        for batch in gathered(batches, "text", SLICE):
            raw, offsets = text_buffer(batch.column("text"))
            starts, ends, first = W.spans(raw, offsets)
            h = W.word_hashes(raw, starts, ends, powers)
            keep = np.diff(first) > 0
            ids = batch.column("doc_id").filter(pa.array(keep))
            if not len(ids):
                continue
            # empty documents have no words, so dropping their bounds leaves the others' as they are
            first = np.concatenate((first[:-1][keep], first[-1:]))
            at = np.arange(len(h)) - np.repeat(first[:-1], np.diff(first))
            powers.to(len(h) + 1)
            digest = [np.add.reduceat(W.mix(h + W.U(s)) * powers.up[at], first[:-1]) for s in (11, 29)]
            g, bounds = W.grams(h, first, n)
            top = (g >> W.U(32)).astype(np.uint32)
            low = bounds[:-1]
            distinct = unique((np.repeat(np.arange(len(low), dtype=np.uint64), np.diff(bounds)) << W.U(44)) | (g >> W.U(20)))
            distinct = np.bincount((distinct >> W.U(44)).astype(np.int64), minlength=len(low))
            out = np.empty((bands, len(low)), np.uint64)
            for i in range(bands):
                key = np.full(len(low), i + 1, np.uint64)
                for j in range(i * rows, (i + 1) * rows):
                    x = top * a[j]
                    x += b[j]
                    key = W.mix(key * W.U(0x9FB21C651E98DF25) + np.minimum.reduceat(x, low))
                out[i] = key
            flat = out.T.reshape(-1).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([ids, pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), pa.array(distinct), lists], ["doc_id", "d1", "d2", "grams", "bands"])

    return run


def similarities(n: int, threshold: float):
    def sets(column: pa.Array, powers: W.Powers) -> tuple[np.ndarray, int]:
        raw, offsets = text_buffer(column)
        starts, ends, first = W.spans(raw, offsets)
        g, bounds = W.grams(W.word_hashes(raw, starts, ends, powers), first, n)
        pair = np.repeat(np.arange(len(column), dtype=np.uint64), np.diff(bounds))
        # 16 bits name the pair within the slice, 48 are the gram's
        return unique((pair << W.U(48)) | (g >> W.U(16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = W.Powers()
        for batch in gathered(batches, "a_text", SLICE):
            m = batch.num_rows
            for at in range(0, m, 32768):
                part = batch.slice(at, 32768)
                a, b = (sets(part.column(c), powers) for c in ("a_text", "b_text"))
                size = [np.bincount((x >> W.U(48)).astype(np.int64), minlength=part.num_rows) for x in (a, b)]
                both = np.bincount((np.intersect1d(a, b, assume_unique=True) >> W.U(48)).astype(np.int64), minlength=part.num_rows)
                j = both / np.maximum(size[0] + size[1] - both, 1)
                ok = pa.array(j >= threshold)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(ok), part.column("b").filter(ok), pa.array(j).filter(ok)], ["doc_id", "partner_id", "jaccard"])

    return run


#: Distinct ids of pairs up to this many (some 10 MB) go to every task as a filter on the texts; more are met by a shuffled join.
FEW_IDS = 250_000


def verified(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    if ids.count() <= FEW_IDS:
        texts = texts.join(F.broadcast(ids), "doc_id", "left_semi")
    left, right = (texts.select(F.col("doc_id").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab")
    # the smaller row first: pivots meet their pairs in the second join, where AQE splits a pivot of many
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(similarities(n, threshold), EDGE)


#: Documents of a block: pairs of large components are verified in tiles of two blocks each, small components together in tiles of about as many documents.
BLOCK = 64
#: Cells of a tile's table of documents and grams that are held at once.
CELLS = 1 << 22
#: Pairs for each document from which on a tile's intersections are counted by a product of tables.
DENSE = 8


def tiled(pairs: DataFrame, texts: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that reach the threshold, like ``verified``, where pairs are many more than documents.

    The components of the candidate pairs are cut into blocks by a hash; the pairs of two blocks are a tile, which is verified by one task. A text goes
    to as many tiles as its component has blocks, in place of once for each pair, and its set is made once for each tile.
    """
    spark = pairs.sparkSession
    found = components(pairs)
    ids = found.unionByName(found.select(F.col("root").alias("doc_id"), "root")).distinct()
    sizes = ids.groupBy("root").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
    block = stored(ids.join(sizes, "root").select("doc_id", "root", "blocks", F.pmod(F.xxhash64("doc_id"), "blocks").alias("block")), "blocks")
    remove(spark, found.stored_at)
    small = max(block.filter("blocks = 1").count() // BLOCK, 1)
    left, right = (block.select(F.col("doc_id").alias(c), F.col("block").alias(f"{c}_block"), *(["root", "blocks"] if c == "a" else [])) for c in "ab")
    place = F.xxhash64("root", F.least("a_block", "b_block"), F.greatest("a_block", "b_block"))
    placed = stored(pairs.join(left, "a").join(right, "b").select(F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(small))).otherwise(place).alias("tile"), "a", "b"), "tiles")
    members = placed.select(F.col("tile").alias("of"), F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    # few ids go to every task as a filter, so that no other texts are shuffled
    if block.count() <= FEW_IDS:
        texts = texts.join(F.broadcast(block.select("doc_id")), "doc_id", "left_semi")
    held = members.join(texts, "doc_id").select("of", "doc_id", "text")
    tile = tile_similarities(n, threshold)
    return placed.groupBy("tile").cogroup(held.groupBy("of")).applyInArrow(tile, EDGE)


def tile_similarities(n: int, threshold: float):
    def run(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        ids = np.asarray(texts.column("doc_id"))
        order = np.argsort(ids)
        ids = ids[order]
        raw, offsets = text_buffer(texts.column("text").take(pa.array(order)))
        starts, ends, first = W.spans(raw, offsets)
        g, bounds = W.grams(W.word_hashes(raw, starts, ends, W.Powers()), first, n)
        # 20 bits name the document within the tile, 44 are the gram's
        keys = unique((np.repeat(np.arange(len(ids), dtype=np.uint64), np.diff(bounds)) << W.U(44)) | (g >> W.U(20)))
        doc, gram = (keys >> W.U(44)).astype(np.int64), keys & W.U((1 << 44) - 1)
        size = np.bincount(doc, minlength=len(ids))
        start = np.concatenate(([0], np.cumsum(size)))
        a, b = (np.searchsorted(ids, np.asarray(pairs.column(c))) for c in "ab")
        both = np.zeros(len(a), np.int64)
        if len(a) > DENSE * len(ids):
            _, column = np.unique(gram, return_inverse=True)
            wide = int(column.max(initial=-1)) + 1
            step = max(CELLS // len(ids), 1)
            turn = np.argsort(column, kind="stable")
            edge = np.searchsorted(column[turn], np.arange(0, wide + step, step))
            total = np.zeros((len(ids), len(ids)), np.float32)
            for low, high, at in zip(edge[:-1], edge[1:], range(0, wide, step), strict=False):
                part = turn[low:high]
                table = np.zeros((len(ids), min(step, wide - at)), np.float32)
                table[doc[part], column[part] - at] = 1
                total += table @ table.T
            both = total[a, b].astype(np.int64)
        else:
            for at in range(0, len(a), 4096):
                x, y = a[at : at + 4096], b[at : at + 4096]
                many = size[x]
                pair = np.repeat(np.arange(len(x)), many)
                base = np.concatenate(([0], np.cumsum(many)))
                own = gram[np.repeat(start[x] - base[:-1], many) + np.arange(base[-1])] | (y[pair].astype(np.uint64) << W.U(44))
                hit = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                both[at : at + 4096] = np.bincount(pair[keys[hit] == own] if len(own) else pair, minlength=len(x))
        j = both / np.maximum(size[a] + size[b] - both, 1)
        ok = pa.array(j >= threshold)
        return pa.table({"doc_id": pairs.column("a").filter(ok), "partner_id": pairs.column("b").filter(ok), "jaccard": pa.array(j).filter(ok)})

    return run


def roots(links: DataFrame) -> DataFrame:
    """(doc_id, root) from links to smaller ids, one for each document, by pointer jumping."""
    spark = links.sparkSession
    now = stored(links.select("doc_id", F.col("partner_id").alias("root")), "roots")
    while True:
        up = now.select(F.col("doc_id").alias("root"), F.col("root").alias("above"))
        after = stored(now.join(up, "root", "left").select("doc_id", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "roots")
        more = after.filter("moved").limit(1).count()
        remove(spark, now.stored_at)
        path, now = after.stored_at, after.select("doc_id", "root")
        now.stored_at = path
        if not more:
            return now


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): the least id of each component of the graph of (a, b) rows. Large-star and small-star rounds until nothing changes."""
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "star")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.select("u", "v", least.alias("m")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small = large.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
        small = small.select("v", "m", "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        after = stored(small, "star")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(spark, now.stored_at)
        now = after
        if state == before:
            out = now.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
            out.stored_at = now.stored_at
            return out
        before = state


def sketched(docs: DataFrame, n: int, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) in lower case, and the stored sketch; rows that repeat a doc_id are one."""
    spark = docs.sparkSession
    tune(spark)
    bands, rows = choose_bands(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lowered("text").alias("text")).filter("doc_id is not null")
    sketch = stored(texts.mapInArrow(sketches(n, bands, rows), SKETCH), "sketch")
    repeated = sketch.count() != sketch.select("doc_id").distinct().count()
    if repeated:
        # a text before none
        texts = texts.groupBy("doc_id").agg(F.coalesce(F.min(F.nullif("text", F.lit(""))), F.lit("")).alias("text"))
        remove(spark, sketch.stored_at)
        sketch = stored(texts.mapInArrow(sketches(n, bands, rows), SKETCH), "sketch")
    return texts, sketch


def ngram_links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Documents that have a near copy: (doc_id, class_id, text_id, copies, links, partner_id, jaccard), one row for each.

    ``class_id``: the least doc_id of the component of all matching pairs. ``text_id``: the least doc_id of the documents with the same word
    sequence; ``copies``: how many these are. ``links``: how many different texts match this one; every pair of different texts that
    shares a band is verified, none is capped. ``partner_id``: the most similar other document (ties: the least id), with the exact Jaccard
    similarity of the two n-gram sets; of other texts, their text_id stands for all copies. Pairs of different texts are missed
    with a probability of at most 1 - ``recall`` each, copies never.

    Nulls, short texts, repeated doc_ids and other columns: as in ``ngram_join``.
    """
    spark = docs.sparkSession
    texts, sketch = sketched(docs, n, threshold, recall)
    same = Window.partitionBy("d1", "d2")
    turn = F.row_number().over(same.orderBy("doc_id"))
    members = sketch.select("doc_id", F.min("doc_id").over(same).alias("text_id"), F.count("*").over(same).alias("copies"), turn.alias("turn"), F.lead("doc_id").over(same.orderBy("doc_id")).alias("after"))
    # the copy of the least id: for the first that is the second
    members = stored(members.select("doc_id", "text_id", "copies", F.when(F.col("turn") == 1, F.col("after")).otherwise(F.col("text_id")).alias("copy")), "members")
    originals = sketch.groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "grams", "bands"), "doc_id").alias("s")).select("s.*")
    bucket = Window.partitionBy("bucket")
    buckets = originals.select("doc_id", "grams", F.posexplode("bands").alias("band", "hash")).select("doc_id", "grams", F.xxhash64("band", "hash").alias("bucket"))
    # near copies meet in the same company in many bands: buckets of equal members are one; members that only seem equal add candidates
    buckets = buckets.withColumns({"company": F.bit_xor(F.xxhash64("doc_id")).over(bucket), "members": F.count("*").over(bucket)}).filter("members > 1")
    buckets = stored(buckets.select("doc_id", "grams", "company", "members").distinct(), "buckets")
    remove(spark, sketch.stored_at)
    # sets of sizes a <= b have a similarity of at most a / b
    fits = F.least("grams", "b_grams") >= F.greatest("grams", "b_grams") * F.lit(threshold - 1e-6)
    other = buckets.select(F.col("doc_id").alias("b"), F.col("grams").alias("b_grams"), "company", "members")
    pairs = buckets.withColumnRenamed("doc_id", "a").join(other, ["company", "members"]).filter("a < b").filter(fits).select("a", "b").distinct()
    pairs = stored(pairs, "pairs")
    remove(spark, buckets.stored_at)
    edges = stored(tiled(pairs, texts, n, threshold), "links")
    remove(spark, pairs.stored_at)
    root = components(edges.select(F.col("doc_id").alias("a"), F.col("partner_id").alias("b")))
    ends = edges.unionByName(edges.select(F.col("partner_id").alias("doc_id"), F.col("doc_id").alias("partner_id"), "jaccard"))
    best = F.max_by(F.struct("jaccard", "partner_id"), F.struct("jaccard", F.bitwise_not("partner_id"))).alias("best")
    by_text = ends.groupBy("doc_id").agg(F.count("*").alias("links"), best).select(F.col("doc_id").alias("text_id"), "links", "best")
    by_text = by_text.join(root.select(F.col("doc_id").alias("text_id"), "root"), "text_id", "left")
    rows = members.join(by_text, "text_id", "left").filter("copies > 1 or links > 0")
    # a copy has similarity 1; another text of the same set may have the lesser id
    copy = F.col("copy").isNotNull() & (F.col("best").isNull() | (F.col("best.jaccard") < 1) | (F.col("copy") < F.col("best.partner_id")))
    return rows.select(
        "doc_id", F.coalesce("root", "text_id").alias("class_id"), "text_id", "copies", F.coalesce("links", F.lit(0).cast("long")).alias("links"),
        F.when(copy, F.col("copy")).otherwise(F.col("best.partner_id")).alias("partner_id"), F.when(copy, F.lit(1.0)).otherwise(F.col("best.jaccard")).alias("jaccard"),
    )


def ngram_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Documents that have a near copy: (doc_id, partner_id, jaccard, group_id).

    ``partner_id`` is another document of the group, with the exact Jaccard similarity of the two n-gram
    sets, at least ``threshold``; ``group_id`` is the least doc_id of the group. Each document of a group has
    one row. Candidates are missed with a probability of at most 1 - ``recall`` a pair.

    Nulls: rows without doc_id or text take no part. Empty texts and texts without words match nothing.
    A text of fewer than n words is one gram; texts of any length are read whole. Rows that repeat a doc_id count as one document, with the least
    text of that id that isn't empty. Ties between partners go to the least id. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    texts, sketch = sketched(docs, n, threshold, recall)

    same = Window.partitionBy("d1", "d2")
    copies = sketch.select("doc_id", F.min("doc_id").over(same).alias("partner_id")).filter("doc_id > partner_id").withColumn("jaccard", F.lit(1.0))
    originals = sketch.groupBy("d1", "d2").agg(F.min_by(F.struct("doc_id", "grams", "bands"), "doc_id").alias("s")).select("s.*")
    buckets = stored(
        originals.select("doc_id", "grams", F.posexplode("bands").alias("band", "hash")).select("doc_id", "grams", F.xxhash64("band", "hash").alias("bucket"))
        .withColumns({"pivot": F.min(F.struct("doc_id", "grams")).over(Window.partitionBy("bucket")), "members": F.count("*").over(Window.partitionBy("bucket"))})
        .filter("members > 1").select("doc_id", "grams", "bucket", F.col("pivot.doc_id").alias("pivot"), F.col("pivot.grams").alias("pivot_grams")),
        "buckets",
    )
    # sets of sizes a <= b have a similarity of at most a / b
    near = buckets.filter("doc_id > pivot").filter(F.least("grams", "pivot_grams") >= F.greatest("grams", "pivot_grams") * F.lit(threshold - 1e-6)).groupBy("doc_id", "pivot").agg(F.count("*").alias("shared"))
    best = near.groupBy("doc_id").agg(F.max_by("pivot", F.struct("shared", F.bitwise_not("pivot"))).alias("pivot"))
    first = stored(best.select(F.col("doc_id").alias("a"), F.col("pivot").alias("b")), "pairs")
    links = stored(verified(first, texts, n, threshold).unionByName(copies), "links")
    remove(spark, first.stored_at)
    remove(spark, sketch.stored_at)

    root = roots(links)
    treed = buckets.select("doc_id", "grams", "bucket").join(root, "doc_id", "left").select("doc_id", "grams", "bucket", F.coalesce("root", "doc_id").alias("root"))
    spread = Window.partitionBy("bucket")
    open_ = stored(treed.withColumns({"low": F.min("root").over(spread), "high": F.max("root").over(spread)}).filter("low < high").select("doc_id", "grams", "bucket", "root"), "open")
    other = open_.select(F.col("doc_id").alias("b"), F.col("grams").alias("b_grams"), "bucket", F.col("root").alias("b_root"))
    # a bucket's pairs: of two trees, each pair once, save those that were verified before
    fits = F.least("grams", "b_grams") >= F.greatest("grams", "b_grams") * F.lit(threshold - 1e-6)
    across = open_.select(F.col("doc_id").alias("a"), "grams", "bucket", F.col("root").alias("a_root")).join(other, "bucket").filter("a_root != b_root and a > b").filter(fits).select("a", "b").distinct()
    rest = stored(across.join(links.select(F.col("doc_id").alias("a"), F.col("partner_id").alias("b")), ["a", "b"], "left_anti"), "pairs")
    found = stored(verified(rest, texts, n, threshold), "links")
    remove(spark, rest.stored_at)
    remove(spark, open_.stored_at)
    remove(spark, buckets.stored_at)

    tree = lambda c: F.coalesce(F.col(c), F.col(c.removesuffix("_root")))
    joins = found.select(F.col("doc_id").alias("a"), F.col("partner_id").alias("b"))
    for c in "ab":
        joins = joins.join(root.select(F.col("doc_id").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
    merged = components(joins.select(tree("a_root").alias("a"), tree("b_root").alias("b")))
    edges = links.unionByName(found)
    ends = edges.unionByName(edges.select(F.col("partner_id").alias("doc_id"), F.col("doc_id").alias("partner_id"), "jaccard"))
    rows_ = ends.groupBy("doc_id").agg(F.max_by(F.struct("partner_id", "jaccard"), F.struct("jaccard", F.bitwise_not("partner_id"))).alias("p")).select("doc_id", "p.partner_id", "p.jaccard")
    grouped = rows_.join(root, "doc_id", "left").select("doc_id", "partner_id", "jaccard", F.coalesce("root", "doc_id").alias("root"))
    top = merged.select(F.col("doc_id").alias("root"), F.col("root").alias("top"))
    return grouped.join(top, "root", "left").select("doc_id", "partner_id", "jaccard", F.coalesce("top", "root").alias("group_id"))


def one_of_each_group(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``docs`` without near copies: of each group, the row of the least doc_id stays.

    All columns stay, whatever their names. Where a doc_id is null or repeats, rows are told apart by their place in the order of doc_id (null last) and text, so
    each text is judged for itself and no text goes but for a near copy that stays. Texts without words are copies of nothing: such rows stay as
    they are. Of rows that repeat, one stays. An empty table gives an empty result.
    """
    found = docs.groupBy(F.col("doc_id").cast("long").alias("i")).count().agg(F.count_if(F.col("i").isNull() | (F.col("count") > 1)).alias("odd")).first()
    if found.odd:
        own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")
        rows = docs.select(own, F.col("doc_id").cast("long").alias("i"), F.col("text").cast("string").alias("text"))
        # rows that repeat are spread over tasks by the third key
        order = [F.col("i").asc_nulls_last(), F.col("text").asc_nulls_last(), F.monotonically_increasing_id()]
        rows = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order[:2]).select("d", "text", F.monotonically_increasing_id().alias("doc_id")), "numbered")
        return one_of_each_group(rows, n, threshold, recall).select("d.*")
    groups = stored(ngram_join(docs, n, threshold, recall), "groups")
    gone = groups.filter("doc_id > group_id").select("doc_id")
    # up to FEW_IDS ids go to every task, so that texts aren't shuffled
    return docs.join(F.broadcast(gone) if groups.count() <= FEW_IDS else gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
