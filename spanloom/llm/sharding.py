"""Sharding along a Hilbert curve over several metadata dimensions.

Language, source, length and doc_id are quantised to ``BITS`` bits each; the cell's index on a four-dimensional Hilbert curve orders the
documents, and runs of equal size along the order become shards, so each shard spans a small box in every dimension and a reader can skip
shards by the least and largest values of any of them.
"""

from __future__ import annotations

from functools import cache
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import free_name, is_parquet, stored

BITS = 5
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")
#: Distinct values of a dimension, some 10 MB, up to which their ranks are broadcast.
FEW_VALUES = 250_000
#: Documents of a shard.
SHARD_ROWS = 2_000
#: Shards of a window at most: the curve halves a window some four times, about once in each dimension.
WINDOW_SHARDS = 16


def hilbert_of(point: list[int], bits: int) -> int:
    """The index of a point on the Hilbert curve, by Skilling's transposition; in plain Python, for tests and for the table of states."""
    x = list(point)
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    q = 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    index = 0
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = index << 1 | ((x[i] ^ t) >> b & 1)
    return index


@cache
def states(n: int) -> tuple[list[int], list[int]]:
    """The curve as a state machine: for state s and the n bits c of a level, digit[s * 2**n + c] and next[s * 2**n + c].

    A state is a permutation of the axes with a flip of each. States are found from the first one on, each from the order in which its cell's children are visited.
    """
    cells = 1 << n

    def bits_of(c: int) -> list[int]:
        return [c >> (n - 1 - i) & 1 for i in range(n)]

    # the base curve's first level, and how each child's own first level is turned, both taken from two levels of the curve
    one = {c: hilbert_of(bits_of(c), 1) for c in range(cells)}
    two = {}
    for c in range(cells):
        order = [0] * cells
        for k in range(cells):
            p = [a << 1 | b for a, b in zip(bits_of(c), bits_of(k), strict=True)]
            order[hilbert_of(p, 2) % cells] = k
        two[c] = tuple(order)
    base = tuple(sorted(range(cells), key=one.get))
    # a turn maps base cells to a child's cells of equal digit; it is linear over bits plus a flip, so composing lists composes turns
    found = {base: 0}
    todo = [base]
    digit: list[int] = []
    following: list[int] = []
    while todo:
        own = todo.pop(0)
        place = {c: d for d, c in enumerate(own)}
        turn = dict(zip(base, own, strict=True))
        for c in range(cells):
            d = place[c]
            child = tuple(turn[k] for k in two[base[d]])
            if child not in found:
                found[child] = len(found)
                todo.append(child)
            digit.append(d)
            following.append(found[child])
    return digit, following


def curve_index(coordinates: list[Column], bits: int) -> Column:
    """The Hilbert index of integer columns of ``bits`` bits each, inside the JVM: one step of the state machine a bit."""
    n = len(coordinates)
    digit, following = states(n)
    pack = lambda values: F.expr(f"array({','.join(map(str, values))})")
    levels = []
    for b in range(bits - 1, -1, -1):
        c = F.lit(0)
        for i, x in enumerate(coordinates):
            c = c + F.shiftleft(F.shiftright(x, b).bitwiseAND(F.lit(1)), n - 1 - i)
        levels.append(c)

    def step(acc: Column, c: Column) -> Column:
        k = acc["state"] * F.lit(1 << n) + c + F.lit(1)
        return F.struct(F.element_at(pack(following), k).alias("state"), (acc["index"] * F.lit(1 << n) + F.element_at(pack(digit), k)).cast("long").alias("index"))

    start = F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("index"))
    return F.aggregate(F.array(*levels), start, step, lambda acc: acc["index"])


#: Level k of a length starts at the k-th of these: 1.75 levels for each doubling.
LENGTHS = [-int(-(2 ** (k / 1.75)) // 1) for k in range(1, 1 << BITS)]


def ranked(pairs: DataFrame, column: str, out: str) -> DataFrame:
    """(value, out): the distinct values of a column in order (null first), spread over the levels."""
    values = pairs.select(F.col(column).alias("v")).distinct()
    order = Window.orderBy(F.col("v").asc_nulls_first())
    return values.select("v", (F.row_number().over(order) - 1).alias("r"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n")).select("v", F.expr(f"int(r * {1 << BITS} div n)").alias(out))


def coordinates(docs: DataFrame, **more: Column) -> DataFrame:
    """(d, i, n, q0..q3, more): each row as a struct, its doc_id and n_chars, and its quantised lang, source, n_chars and doc_id. The statistics take one pass over these four columns."""
    keys = {"l": F.col("lang").cast("string"), "s": F.col("source").cast("string"), "n": F.col("n_chars").cast("long"), "i": F.col("doc_id").cast("long")}
    pairs = stored(docs.select(*[c.alias(k) for k, c in keys.items()]).groupBy("l", "s").agg(F.min("i").alias("a"), F.max("i").alias("b")), "pairs")
    ends = pairs.agg(F.min("a").alias("a"), F.max("b").alias("b")).first()
    low, high = (ends.a or 0, ends.b or 0)
    lengths = F.expr(f"array({','.join(map(str, LENGTHS))})")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), *[c.alias(k) for k, c in (keys | more).items()])
    for column, out in (("l", "q0"), ("s", "q1")):
        ranks = stored(ranked(pairs, column, out), "ranks")
        # few values go to every task; a shuffle would send all rows of a hot value to one
        rows = rows.join(F.broadcast(ranks) if ranks.count() <= FEW_VALUES else ranks, F.col(column).eqNullSafe(F.col("v"))).drop("v")
    # wide enough for any two ids and 32 times their distance
    wide = lambda v: f"cast({v} as decimal(20,0))"
    low_, span = wide(f"'{low}'"), wide(f"'{high - low + 1}'")
    return rows.select(
        "d", "i", "n", "q0", "q1", F.size(F.filter(lengths, lambda t: t <= F.coalesce(F.col("n"), F.lit(0)))).alias("q2"),
        F.expr(f"int((coalesce({wide('i')}, {low_}) - {low_}) * {1 << BITS} div {span})").alias("q3"), *more,
    )


#: Characters, by n_chars, of a range that one task sorts and writes; ROW_CHARS are added for each row.
RANGE_CHARS, ROW_CHARS = 16 << 20, 64
#: Ranges at most, about: beyond RANGE_CHARS times this, ranges grow with the table, and tasks sort with spilling.
MOST_RANGES = 100_000
#: Tasks on each core at least, where there is less to do.
TASKS_A_CORE = 2
#: A cell with more than a range's characters is cut at these many quantiles of its doc_ids at most.
QUANTILES = 1_000


def ranges(placed: DataFrame, fewest: int) -> tuple[DataFrame, int]:
    """(h, first, cuts) for each cell of the curve, and how many ranges there are: ranges follow the curve and hold about equal numbers of characters.

    A cell lies in the range ``first``, or is cut by doc_id at ``cuts`` into that range and those after it, where it alone has more than a range should.
    There are at most 2**20 cells; n_chars only balances the ranges, so that a wrong one does no harm to the order.
    """
    sized = placed.select("h", "i", (F.greatest(F.coalesce("n", F.lit(0).cast("long")), F.lit(0)) + F.lit(ROW_CHARS)).alias("w"))
    cells = stored(sized.groupBy("h").agg(F.sum("w").cast("double").alias("w")), "cells")
    total = cells.agg(F.sum("w")).first()[0] or 0.0
    share = max(min(RANGE_CHARS, total / fewest), total / MOST_RANGES, 1.0)
    along = cells.withColumn("before", F.coalesce(F.sum("w").over(Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    large = along.filter(F.col("w") > share)
    cut = [k / QUANTILES for k in range(1, QUANTILES)]
    # ids are read again only where a cell is large
    cut_from = sized.join(F.broadcast(large.select("h")), "h", "left_semi") if large.limit(1).count() else sized.limit(0)
    quantiles = cut_from.groupBy("h").agg(F.percentile_approx("i", cut, 10 * QUANTILES).alias("quantiles"))
    # a large cell begins a range of its own and has as many as its characters take; small ones are gathered
    own = F.when(F.col("w") > share, F.least(F.ceil(F.col("w") / share), F.lit(QUANTILES))).otherwise(0).cast("int")
    found = along.join(quantiles, "h", "left").withColumn("own", own)
    # the number of a cell's range: the whole shares of small cells before it, and all ranges of large ones
    order = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    run = F.sum(F.when(F.col("own") > 0, 1).otherwise(0)).over(order) * 2 - F.when(F.col("own") > 0, 1).otherwise(0)
    found = found.withColumn("run", run)
    inner = Window.partitionBy("run").orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("part", F.when(F.col("own") > 0, 0).otherwise(F.floor(F.coalesce(F.sum("w").over(inner), F.lit(0.0)) / share)).cast("int"))
    sizes = found.groupBy("run").agg((F.max("part") + F.greatest(F.max("own"), F.lit(1))).alias("size"))
    starts = sizes.select("run", F.coalesce(F.sum("size").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    place = lambda k: F.greatest(F.floor(k * F.lit(QUANTILES) / F.col("own")).cast("int"), F.lit(1))
    cuts = F.when(F.col("own") > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.col("own") - 1, F.lit(1))), lambda k: F.element_at("quantiles", place(k))))
    table = stored(found.join(starts, "run").select("h", (F.col("start") + F.col("part")).cast("int").alias("first"), F.filter(F.coalesce(cuts, F.expr("array()").cast("array<bigint>")), lambda x: x.isNotNull()).alias("cuts")), "ranges")
    many = table.agg(F.max(F.col("first") + F.size("cuts") + 1)).first()[0] or 1
    return table, many


def sharded(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with ``hilbert``, the index of its cell on the curve, and ``shard``, the number of its run.

    All documents are ordered by hilbert, then doc_id, then text; runs of ``shard_rows`` documents are the shards 0, 1, ..., of which only the last may be shorter.

    Nulls: a null lang or source is a value of its own, before the others; a null n_chars counts as 0; a null doc_id has the least
    coordinate and sorts first. Texts aren't looked at but to break ties of doc_id, however long; rows that repeat stay apart. All columns
    stay; the two new ones get underscores in front where their names are taken. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    h, shard = free_name(docs, "hilbert"), free_name(docs, "shard")
    placed = coordinates(docs).select("d", "i", "n", curve_index([F.col(f"q{i}") for i in range(4)], BITS).alias("h"))
    table, many = ranges(placed, TASKS_A_CORE * spark.sparkContext.defaultParallelism)
    above = F.size(F.filter("cuts", lambda x: F.col("i") > x))
    cut = placed.join(F.broadcast(table), "h").select("d", "i", "h", (F.col("first") + F.when(F.size("cuts") > 0, above).otherwise(0)).alias("range"))
    return runs(cut, many, ["h", "i", "d.text"], shard_rows).select("d.*", F.col("h").alias(h), F.col("shard").alias(shard))


def runs(cut: DataFrame, many: int, order: list[str], shard_rows: int) -> DataFrame:
    """(d, h, shard): the rows in ``order``, which their ``range`` of ``many`` follows, and the number of the run of each."""
    # each range is one partition, in order
    ordered = cut.repartitionById(many, F.col("range")).sortWithinPartitions(*order).select("d", "h")
    # the number of a sorted row: its partition in the upper bits, its place in the partition in the lower 33
    run = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = run.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return run.withColumn("part", part).join(F.broadcast(starts), "part").select("d", "h", F.floor(place / F.lit(shard_rows)).cast("long").alias("shard"))


def file_starts(docs: DataFrame) -> DataFrame:
    """(file, rows, start) of each file of a Parquet table: its rows and those of all files before it, in the order in which Spark numbers the files it writes, others by name."""
    files = docs.groupBy(docs.metadataColumn("_metadata")["file_path"].alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    number = F.expr(r"try_cast(regexp_extract(file, r'/part-(\d+)[^/]*$', 1) AS bigint)")
    return files.withColumn("start", F.coalesce(F.sum("rows").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def window_ranges(placed: DataFrame, fewest: int) -> tuple[DataFrame, int]:
    """(window, bounds) and how many ranges there are: ranges follow the windows, and the curve within each, and hold about equal numbers of characters.

    ``bounds`` has the first (key, range) of each range in the window, in order. Rows of one key aren't split.
    """
    sized = placed.select("window", window_key().alias("key"), (F.greatest(F.coalesce("n", F.lit(0).cast("long")), F.lit(0)) + F.lit(ROW_CHARS)).cast("double").alias("w"))
    sizes = stored(sized.groupBy("window").agg(F.sum("w").alias("w")), "windows")
    total = sizes.agg(F.sum("w")).first()[0] or 0.0
    share = max(min(RANGE_CHARS, total / fewest), total / MOST_RANGES, 1.0)
    preceding = lambda order: F.coalesce(F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    starts = sizes.select("window", preceding(Window.orderBy("window")).alias("start"))
    along = sized.withColumn("before", preceding(Window.partitionBy("window").orderBy("key"))).join(F.broadcast(starts), "window")
    firsts = along.groupBy("window", F.floor((F.col("start") + F.col("before")) / share).cast("int").alias("range")).agg(F.min("key").alias("key"))
    table = stored(firsts.groupBy("window").agg(F.sort_array(F.collect_list(F.struct("key", "range"))).alias("bounds")), "bounds")
    many = table.agg(F.max(F.element_at("bounds", -1)["range"]) + 1).first()[0] or 1
    return table, many


def window_key() -> Column:
    """The order within a window; a null doc_id comes first."""
    return F.struct("h", F.col("i").isNotNull().alias("some"), F.coalesce("i", F.lit(0).cast("long")).alias("i"))


def sharded_in_windows(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``sharded``, one window of rows after the other: the order in which ``docs`` lie decides the window of a row, the curve its shard in the window.

    A table of a mixture so gives shards that keep it: window after window holds its share of each source. A window is ``WINDOW_SHARDS`` shards, in smaller
    tables fewer, about as many as there are windows, so that both orders count. ``shard`` numbers the runs of ``shard_rows`` documents by window, hilbert,
    doc_id and text; no shard is in two windows. The curve is that of all documents.

    The order is that of a Parquet table's files, as Spark numbers those it writes, and of the rows in them; other ``docs`` are written first, in the order of
    their partitions. All else is as in ``sharded``.
    """
    if not is_parquet(docs):
        docs = stored(docs, "rows")
    h, shard = free_name(docs, "hilbert"), free_name(docs, "shard")
    files = stored(file_starts(docs), "files")
    rows = files.agg(F.sum("rows")).first()[0] or 0
    window_rows = max(min(isqrt(-(-rows // shard_rows)), WINDOW_SHARDS), 1) * shard_rows
    at = docs.metadataColumn("_metadata")
    placed = coordinates(docs, file=at["file_path"], row=at["row_index"]).join(F.broadcast(files.drop("rows")), "file")
    placed = placed.select("d", "i", "n", curve_index([F.col(f"q{i}") for i in range(4)], BITS).alias("h"), F.expr(f"(start + row) div {window_rows}").alias("window"))
    table, many = window_ranges(placed, TASKS_A_CORE * docs.sparkSession.sparkContext.defaultParallelism)
    keyed = placed.withColumn("key", window_key()).join(F.broadcast(table), "window")
    cut = keyed.select("d", "i", "h", "window", F.element_at(F.filter("bounds", lambda b: b["key"] <= F.col("key")), -1)["range"].alias("range"))
    return runs(cut, many, ["window", "h", "i", "d.text"], shard_rows).select("d.*", F.col("h").alias(h), F.col("shard").alias(shard))


def manifest(shards: DataFrame, shard: str = "shard") -> DataFrame:
    """The rows and the least and largest values of each shard, by which readers skip shards."""
    ends = [f(F.col(c)).alias(f"{n}_{c}") for c in DIMENSIONS for f, n in ((F.min, "least"), (F.max, "most"))]
    return shards.groupBy(shard).agg(F.count(F.lit(1)).alias("rows"), *ends)


def written(shards: DataFrame, path: str, shard: str = "shard", hilbert: str = "hilbert") -> None:
    """Write each shard into a folder of its own, in the order of the curve, and the manifest beside them."""
    shards.repartition(shard).sortWithinPartitions(shard, hilbert, "doc_id").write.partitionBy(shard).parquet(f"{path}/shards")
    manifest(shards, shard).coalesce(1).write.parquet(f"{path}/manifest")


def oracle_sql(shard_rows: int = SHARD_ROWS) -> str:
    digit, following = states(4)
    steps = ["s0 AS (SELECT *, 0 AS state, 0::BIGINT AS h FROM q)"]
    for b in range(BITS):
        c = " + ".join(f"(((q{i} >> {BITS - 1 - b}) & 1) << {3 - i})" for i in range(4))
        steps.append(f"s{b + 1} AS (SELECT * REPLACE (t.next[state * 16 + ({c}) + 1] AS state, h * 16 + t.digit[state * 16 + ({c}) + 1] AS h) FROM s{b}, t)".replace("SELECT * REPLACE", f"SELECT s{b}.* REPLACE"))
    return f"""
WITH t AS (SELECT {following} AS next, {digit} AS digit),
lr AS (SELECT lang AS v, (row_number() OVER (ORDER BY lang NULLS FIRST) - 1) * {1 << BITS} // count(*) OVER () AS q FROM (SELECT DISTINCT lang FROM documents)),
sr AS (SELECT source AS v, (row_number() OVER (ORDER BY source NULLS FIRST) - 1) * {1 << BITS} // count(*) OVER () AS q FROM (SELECT DISTINCT source FROM documents)),
e AS (SELECT min(doc_id) AS a, max(doc_id) AS b FROM documents),
q AS (SELECT d.*, lr.q::INTEGER AS q0, sr.q::INTEGER AS q1, len(list_filter({LENGTHS}, lambda x: x <= coalesce(n_chars, 0)))::INTEGER AS q2,
  ((coalesce(doc_id, a) - a) * {1 << BITS} // (b - a + 1))::INTEGER AS q3
  FROM documents d, lr, sr, e WHERE d.lang IS NOT DISTINCT FROM lr.v AND d.source IS NOT DISTINCT FROM sr.v),
{", ".join(steps)}
SELECT doc_id, text, lang, source, n_chars, h AS hilbert, (row_number() OVER (ORDER BY h, doc_id NULLS FIRST, text NULLS FIRST) - 1) // {shard_rows} AS shard FROM s{BITS}"""
