"""Row numbers over whole tables without a one-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.plans.stats import col, local_rows
from plumbgauge.session import materialise

_PART_SHIFT = 33  # monotonically_increasing_id keeps the partition number above this bit


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based position of every row in the total order ``order``.

    A range-partitioned sort, each row's position within its sorted partition, and the sizes of
    the partitions before it. The sorted rows are written once, so that the partition numbers
    used for counting and for numbering are the same ones. End ``order`` with a unique key.
    """
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    stored = materialise(placed, "sorted")
    part = F.shiftright("_place", _PART_SHIFT)
    # One row per sort partition comes to the driver, however large the table is.
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).collect()
    offsets, before = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], before))
        before += row["_size"]
    starts = local_rows(df.sparkSession, "_part bigint, _offset bigint", offsets)
    within = F.col("_place").bitwiseAND(F.lit((1 << _PART_SHIFT) - 1))
    return (stored.withColumn("_part", part).join(starts, "_part")
            .select(*[col(c) for c in df.columns], (F.col("_offset") + within + 1).alias(rank)))


def rank_within(df: DataFrame, group: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """1-based position of every row within its group; a group may be of any size."""
    numbered = global_rank(df, [col(g) for g in group] + order, "_global")
    first = numbered.groupBy(*group).agg(F.min("_global").alias("_first"))
    keep = [col(c) for c in df.columns]
    return (numbered.join(first, group)
            .select(*keep, (F.col("_global") - F.col("_first") + 1).alias(rank)))


def number_few(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Row numbers for a result already bounded by a limit or by the size of a dimension."""
    return df.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def top_n(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows of the order with their position: a distributed top-k, then numbering."""
    return number_few(df.orderBy(*order).limit(n), order, rank)
