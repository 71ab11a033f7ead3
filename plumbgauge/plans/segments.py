"""Windows over groups of any size, by cutting the sorted table into segments of bounded size.

A plain window sends a whole group to one task. Here rows get their place in the order of (group, order), segments
are runs of places, the window runs per (group, segment), and what must cross a segment border is carried
by a summary of one row per segment. A group's share of the summary is its size divided by the segment size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.plans.ranking import global_rank
from plumbgauge.plans.stats import col


def neighbours(df: DataFrame, group: str, order: str, carry: list[str], *,
               segment_size: int = 4096) -> DataFrame:
    """Add ``prev_<c>`` and ``next_<c>`` for each carried column: the row before and after.

    ``order`` is unique within the group; its values may lie as far apart as they like.
    """
    rows = _segments(df, [group, order], segment_size)
    inner = Window.partitionBy(group, "_seg").orderBy(order)
    item = F.struct(*[col(c) for c in [order, *carry]])
    edges = rows.groupBy(group, "_seg").agg(F.min_by(item, col(order)).alias("_first"),
                                            F.max_by(item, col(order)).alias("_last"))
    outer = Window.partitionBy(group).orderBy("_seg")
    edges = edges.select(group, "_seg",
                         F.lag("_last").over(outer).alias("_before"),
                         F.lead("_first").over(outer).alias("_after"))
    joined = (rows.withColumn("_prev", F.lag(item).over(inner))
              .withColumn("_next", F.lead(item).over(inner))
              .join(edges, [group, "_seg"], "left"))
    before, after = F.coalesce("_prev", "_before"), F.coalesce("_next", "_after")
    return joined.select(*[col(c) for c in df.columns],
                         *[before.getField(c).alias(f"prev_{c}") for c in carry],
                         *[after.getField(c).alias(f"next_{c}") for c in carry])


def _segments(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """``df`` with ``_seg``, which numbers runs of at most ``size`` rows in the given order."""
    ranked = global_rank(df, [col(c).asc_nulls_first() for c in order], "_rank")
    return ranked.withColumn("_seg", F.floor(F.col("_rank") / F.lit(size)).cast("bigint")).drop("_rank")


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str,
              payload: list[str], *, segment_size: int = 65_536) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time.

    ``payload`` are right columns; ties in time are settled by the largest payload. Left rows
    without a match keep nulls. Segments hold at most ``segment_size`` rows, also of one key within one hour.
    """
    item = F.struct(col(right_time), *[col(p) for p in payload])
    item_type = right.select(item.alias("i")).schema["i"].dataType
    lefts = left.select(col(key).alias("_key"), col(left_time).alias("_time"), F.lit(1).alias("_side"),
                        F.struct(*[col(c) for c in left.columns]).alias("_left"),
                        F.lit(None).cast(item_type).alias("_item"))
    right = right.filter(col(key).isNotNull() & col(right_time).isNotNull())
    rights = right.select(col(key).alias("_key"), col(right_time).alias("_time"), F.lit(0).alias("_side"),
                          F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType)
                          .alias("_left"), item.alias("_item"))
    both = _segments(lefts.unionAll(rights), ["_key", "_time", "_side"], segment_size)
    latest = both.groupBy("_key", "_seg").agg(F.max("_item").alias("_max"))
    earlier = Window.partitionBy("_key").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("_key", "_seg", F.max("_max").over(earlier).alias("_carried"))
    running = (Window.partitionBy("_key", "_seg").orderBy("_time", "_side")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    best = F.coalesce(F.col("_found"), F.col("_carried"))
    return (both.withColumn("_found", F.max("_item").over(running))
            .filter("_side = 1")
            .join(carried, ["_key", "_seg"], "left")
            .select("_left.*", *[best.getField(c).alias(f"asof_{c}") for c in [right_time, *payload]]))


