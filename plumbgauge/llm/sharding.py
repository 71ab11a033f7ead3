"""Sharding by minimax contiguous partition.

Documents of equal text form one atomic group. Groups stand in the order of their smallest
doc_id (then of their hash); a shard is a run of neighbouring groups, and the largest shard is as
small as any such cutting allows. Whether a capacity suffices is checked greedily: fill a shard until the
next group does not fit. A binary search finds the smallest capacity that needs no more
than the given number of shards, and its greedy cuts are the result.

The check only looks at the points where groups end, on the line of running sizes. Those stay
in Spark; the driver first sees counts and ends per stretch of that line, then only the
stretches in which a cut can still fall, in ever finer pieces, until those hold few enough ends to list.

Defined results: a null text is empty, so null and empty texts are one group, of one byte a row; rows
without doc_id come last; repeated rows are sharded one by one; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.llm.common import cut, numbered, present

#: Ends the driver lists at most, and stretches it looks at in one round.
LISTED, STRETCHES = 200_000, 20_000


def greedy_cuts(ends: list[int], capacity: int, shards: int) -> list[int] | None:
    """Last ends of the shards that greedy filling makes; None if a group or the number of shards is too large."""
    out, start = [], 0
    while start < ends[-1]:
        if len(out) == shards:
            return None
        i = bisect_right(ends, start + capacity) - 1
        if i < 0 or ends[i] <= start:
            return None
        out.append(ends[i])
        start = ends[i]
    return out


def smallest_capacity(ends: list[int], shards: int, low: int, high: int) -> int:
    """Smallest capacity in [low, high] that greedy filling can use; ``high`` must be usable."""
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(ends, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def _reach(known: list[tuple[int, int]], target: int, optimistic: bool) -> int:
    """Where greedy filling towards ``target`` stops, at least or at most, if only (lowest, highest) end per stretch is known."""
    i = bisect_right(known, (target, float("inf"))) - 1
    if i < 0:
        return 0
    low, high = known[i]
    if high <= target:
        return high
    return target if optimistic else low


def _bounds(known: list[tuple[int, int]], capacity: int, shards: int) -> list[tuple[int, int]] | None:
    """Per cut, the range in which greedy filling at ``capacity`` leaves it; None if even the best case needs more shards."""
    low = high = 0
    out, total = [], known[-1][1]
    for _ in range(shards):
        low, high = max(low, _reach(known, low + capacity, False)), max(high, _reach(known, high + capacity, True))
        out.append((low, high))
    return out if high >= total else None


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Running sizes at which the shards end, for groups with their running ``end`` and ``size``."""
    total, largest, count = groups.agg(F.max("end"), F.max("size"), F.count("*")).first()
    if not count:
        return []
    low, high = max(largest, -(-total // shards)), total
    windows = [(0, total)]  # the stretches of the line on which a cut may fall
    known: list[tuple[int, int]] = []
    while True:
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("end").between(a, b)
        within = groups.where(inside)
        if within.limit(LISTED + 1).count() <= LISTED:
            points = sorted({r[0] for r in within.select("end").collect()} | {p for span in known for p in span if _outside(p, windows)} | {total})
            best = smallest_capacity(points, shards, low, high)
            return greedy_cuts(points, best, shards)
        width = max(1, sum(b - a + 1 for a, b in windows) // STRETCHES)
        found = [tuple(r) for r in within.groupBy(F.floor(F.col("end") / width)).agg(F.min("end"), F.max("end")).select(
            F.col("min(end)"), F.col("max(end)")).collect()]
        known = sorted([span for span in known if _outside(span[0], windows)] + found)
        # narrow the capacity: below ``low`` even the best case fails, at ``high`` even the worst case works
        a, b = low, high
        while a < b:
            middle = (a + b) // 2
            a, b = (a, middle) if _bounds(known, middle, shards) else (middle + 1, b)
        low = a
        a, b = low, high
        while a < b:
            middle = (a + b) // 2
            spans = _bounds(known, middle, shards)
            a, b = (a, middle) if spans and spans[-1][0] >= total else (middle + 1, b)
        high = b
        least, most = _bounds(known, low, shards), _bounds(known, high, shards)
        windows = _merged([(x[0], y[1]) for x, y in zip(least, most)])


def _outside(point: int, windows: list[tuple[int, int]]) -> bool:
    return not any(a <= point <= b for a, b in windows)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def with_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the group of equal texts: two hashes and the smallest doc_id."""
    text = present(F.col(text_col))
    narrow = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                         F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2"))
    narrow = cut(narrow)
    groups = narrow.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.sum("size").alias("group_size"))
    return narrow.join(groups, ["h1", "h2"])


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    order = ["missing", "first", "h1", "h2", "doc_id"]
    placed = numbered(with_group(docs, id_col, text_col).withColumn("missing", F.col("first").isNull()), order)
    groups = placed.groupBy("missing", "first", "h1", "h2").agg(F.min("_rank").alias("row"), F.first("group_size").alias("size"))
    ended = _running(groups)
    cuts = minimax_cuts(ended.select("end", "size"), shards)
    if not cuts:
        return placed.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    shard = F.lit(0)
    for limit in cuts[:-1]:
        shard = shard + (F.col("end") > limit).cast("int")
    ended = cut(ended.select("row", shard.alias("shard")))
    starts = {r["shard"]: r["first"] for r in ended.groupBy("shard").agg(F.min("row").alias("first")).collect()}
    bounds = sorted((row, s) for s, row in starts.items())
    number, start = F.lit(bounds[0][1]), F.lit(bounds[0][0])
    for row, s in bounds[1:]:
        number, start = F.when(F.col("_rank") >= row, s).otherwise(number), F.when(F.col("_rank") >= row, row).otherwise(start)
    return placed.select("doc_id", "size", "text_crc32", number.cast("int").alias("shard"), (F.col("_rank") - start).cast("long").alias("slot"))


def _running(groups: DataFrame) -> DataFrame:
    """``groups`` with ``end``, the sum of sizes up to and with the group, in the order of ``row``."""
    spark = groups.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(groups.repartitionByRange(n, "row").sortWithinPartitions("row").withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.sum("size").alias("n")).orderBy("_part").collect()
    offsets, total = [], 0
    for r in sizes:
        offsets += [F.lit(r["_part"]), F.lit(total)]
        total += r["n"]
    if not offsets:
        return dealt.withColumn("end", F.lit(0).cast("long")).drop("_part")
    within = F.sum("size").over(Window.partitionBy("_part").orderBy("row").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cut(dealt.withColumn("end", (within + F.create_map(*offsets)[F.col("_part")]).cast("long")).drop("_part"))
