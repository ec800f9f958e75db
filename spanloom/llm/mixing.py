"""Mixing sources to target weights by Pfair scheduling.

A source of weight w owns w of the slots of an endless schedule; each slot takes one block of documents. Block i (from 1) of a
source is released at slot floor((i - 1) / w) and due before slot ceil(i / w). Each slot goes to the released block of the earliest
deadline, so after any number t of slots a source has had more than t * w - 1 and fewer than t * w + 1 blocks.

Weights are multiples of 1 / PERIOD, so the schedule repeats after PERIOD slots. Only one period is simulated, on the driver, at a
cost that doesn't depend on the documents; a block's slot then follows from its number by arithmetic.

At the first slot whose source has nothing left, a new phase starts: the sources that still have blocks are scheduled anew, their
weights renormalised, until all documents have a slot. There are at most as many phases as sources; one period is simulated for each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name

#: Slots of a period: the resolution of the weights.
PERIOD = 10_000
#: Documents in a block.
BLOCK = 4
#: Share of a source's documents that counts towards its weight, as a power: 1 keeps natural weights, 0 makes sources equal.
ALPHA = 0.7
#: Slots of all phases that are sent to every task, some 4 MB; longer periods are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Files at most of a mixture that lies in order.
MOST_FILES = 100_000


def quantised(weights: dict[str, float], period: int = PERIOD) -> dict[str, int]:
    """Positive weights as whole numbers of slots that sum to ``period``, by largest remainders (ties: by name), at least 1 each."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of at least as many slots")
    total = sum(weights.values())
    exact = {k: v / total * period for k, v in weights.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    by_need = sorted(out, key=lambda k: (out[k] - exact[k], k))
    i = 0
    while (missing := period - sum(out.values())) > 0:
        out[by_need[i % len(by_need)]] += 1
        i += 1
    while missing < 0:
        most = max((k for k in out if out[k] > 1), key=lambda k: (out[k] - exact[k], k))
        out[most] -= 1
        missing += 1
    return out


def schedule(slots: dict[str, int]) -> list[tuple[str, int, int]]:
    """One period: (source, block of the source in the period from 0, slot), by earliest deadline first (ties: by name)."""
    return list(scheduled(slots))


def scheduled(slots: dict[str, int]) -> Iterator[tuple[str, int, int]]:
    """``schedule``, slot by slot."""
    period = sum(slots.values())
    waiting = [(0, k, 0) for k in sorted(slots)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, k, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * period // slots[k]), k, i))
        _, k, i = heapq.heappop(ready)
        yield k, i, t
        if i + 1 < slots[k]:
            heapq.heappush(waiting, ((i + 1) * period // slots[k], k, i + 1))


def phase(blocks: dict[str, int], weights: dict[str, float], period: int) -> tuple[int, dict[str, tuple[int, int, list[int]]]]:
    """The schedule up to the first slot whose source has no block left: its slots, and of each source the blocks taken, the slots it owns of a period and where these are."""
    slots = quantised({k: weights[k] for k in blocks}, period)
    at: dict[str, list[int]] = {k: [] for k in slots}
    for k, i, t in scheduled(slots):
        if i == blocks[k]:
            # within the first period
            return t, {k: (len(v), slots[k], v) for k, v in at.items()}
        at[k].append(t)
    end = min(n // slots[k] * period + at[k][n % slots[k]] for k, n in blocks.items())
    full, rest = divmod(end, period)
    return end, {k: (full * slots[k] + sum(t < rest for t in v), slots[k], v) for k, v in at.items()}


def phases(blocks: dict[str, int], weights: dict[str, float], period: int) -> Iterator[tuple[int, dict[str, tuple[int, int, int, list[int]]]]]:
    """(first slot, {source: (first block, blocks, own, slots)}) of each phase, until no source has a block left."""
    start, had, left = 0, dict.fromkeys(blocks, 0), {k: n for k, n in blocks.items() if n}
    while left:
        end, taken = phase(left, weights, period)
        yield start, {k: (had[k], *v) for k, v in taken.items() if v[0]}
        start += end
        for k, (n, _, _) in taken.items():
            had[k] += n
            left[k] -= n
        left = {k: n for k, n in left.items() if n}


def source_counts(docs: DataFrame) -> dict[str, int]:
    """Documents of each source, over all of them; a null source counts as ""."""
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("s")).count()
    return {r["s"]: r["count"] for r in counts.toLocalIterator()}


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, period: int = PERIOD, whole: bool = False, ordered: bool = False) -> DataFrame:
    """The mixture: ``docs`` in the schedule, all of them if ``whole``, else up to the slot at which a source first lacks the full block that is due.

    All columns stay and ``slot`` is added (with underscores in front where the name is taken): the place of the document's block in
    the mixture. Every prefix of whole slots is within one block of the target weights; if ``whole``, that holds within each phase, from its
    start, for the weights of the sources that still have documents, and the last block of a source may be a partial one. Within a source, documents come in the order of a hash
    of doc_id, then by doc_id and text, so blocks are random samples that any run repeats.

    ``weights``: by source; None takes each count to the power ALPHA. Sources with a weight of 0 or without one are left out; a weighted source without
    documents is left out too and the rest share its part. ``period`` is raised to ten slots a source where it is less. A null source is the source "". Rows that repeat are documents of their own. Null doc_ids and texts sort first; texts of any length pass as they are. An empty table
    gives an empty result.

    ``ordered``: the rows lie in the order of the slots, within a slot by doc_id and text, so a table written from them holds the mixture from its first file to its last.
    """
    spark = docs.sparkSession
    slot = free_name(docs, "slot")
    counts = source_counts(docs)
    weights = {k: float(n) ** ALPHA for k, n in counts.items()} if weights is None else weights
    weights = {k: w for k, w in weights.items() if w > 0 and counts.get(k)}
    if not weights:
        return docs.limit(0).withColumn(slot, F.lit(None).cast("long"))
    # ten slots a source at least, so that any number of sources fits
    period = max(period, 10 * len(weights))
    if whole:
        found = list(phases({k: -(-counts[k] // block) for k in weights}, weights, period))
    else:
        found = [(0, {k: (0, *v) for k, v in phase({k: counts[k] // block for k in weights}, weights, period)[1].items()})]
    # of each phase and source at most one period of slots
    rows = [(k, start, first, n, own, at) for start, taken in found for k, (first, n, own, at) in taken.items()]
    table = spark.createDataFrame(rows, "source string, start long, first long, blocks long, own int, slots array<int>")
    simulated = sum(len(r[-1]) for r in rows)
    joined = numbered(docs, block, max(counts.values())).join(F.broadcast(table) if simulated <= MOST_BROADCAST else table, "source")
    at = F.col("block") - F.col("first")
    placed = joined.filter((at >= 0) & (at < F.col("blocks")))
    placed = placed.select("d", (F.col("start") + F.floor(at / F.col("own")) * F.lit(period) + F.element_at("slots", (at % F.col("own") + 1).cast("int"))).cast("long").alias("slot"))
    if ordered:
        # slots have no gaps; equal numbers of them are one partition each
        slots = sum(r[3] for r in rows)
        many = min(max(slots * block // RANGE_ROWS, 2 * spark.sparkContext.defaultParallelism), MOST_FILES)
        placed = placed.repartitionById(many, F.expr(f"int(slot * {many} div {slots})")).sortWithinPartitions("slot", "d.doc_id", "d.text")
    return placed.select("d.*", F.col("slot").alias(slot))


#: Rows of the largest source that fall into a range of the hash. Ranges are as many as that takes, so a task's sort stays as small however hot a source is.
RANGE_ROWS = 4_096


def numbered(docs: DataFrame, block: int, most: int) -> DataFrame:
    """(d, source, block): each row as a struct, with its source and its place by hash within the source over ``block``. ``most``: rows of the largest source.

    A row's place is the count of all ranges of the hash before its own, plus its place within the range. The order doesn't depend on the number of ranges.
    """
    bits = min(max((most // RANGE_ROWS).bit_length(), 1), 30)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.xxhash64("doc_id").alias("hash"))
    rows = rows.withColumn("range", F.shiftrightunsigned("hash", 64 - bits).cast("int"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source", "range").count().select("source", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inner = Window.partitionBy("source", "range").orderBy("hash", "d.doc_id", "d.text")
    turned = rows.withColumn("turn", F.row_number().over(inner) - 1)
    return turned.join(starts, ["source", "range"]).select("d", "source", F.floor((F.col("start") + F.col("turn")) / F.lit(block)).alias("block"))
