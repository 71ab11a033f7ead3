"""Exact quantiles of any number of groups at once, whatever their sizes.

The built-in exact ``percentile`` sorts the distinct values of a group in one task. Here all groups are narrowed together: a pass counts, per group and wanted
rank, the values of each bucket of the interval in which that rank lies; the bucket that holds it is the next interval. The first buckets are the powers of two, by sign, so that no far
value spoils the later ones, which cut an interval into equal widths. An interval that holds few values, or a single one, is read off. Counts are combined in the tasks, so a group with most of the rows is a few
thousand counts of each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbgauge.plans.quantiles import number
from plumbgauge.plans.stats import col
from plumbgauge.session import materialise

BUCKETS = 4096
#: Values of an interval that one task may sort.
SORT_LIMIT = 10_000


def _bucket(first: bool) -> Column:
    """Bucket of ``v``; larger values are never in a smaller one."""
    if first:
        # the least magnitudes share a bucket; the order of magnitudes turns for negative values
        size = F.floor(F.least(F.log2(F.greatest(F.abs("v"), F.lit(1e-300))), F.lit(1100.0))) + 1001
        return F.when(F.col("v") == 0, F.lit(0)).otherwise(F.when(F.col("v") < 0, -size).otherwise(size)).cast("int")
    share = (F.col("v") - F.col("low")) / (F.col("high") - F.col("low"))
    return F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1)).cast("int")


def grouped_quantiles(df: DataFrame, keys: list[str], columns: list[str], probabilities: list[float], sort_limit: int = SORT_LIMIT) -> DataFrame:
    """(keys, column_name, probability, value): quantiles with linear interpolation over the non-null values that are no NaN.

    Null keys are a group. A group without any value of a column has null values. Infinite values are not interpolated with finite ones.
    """
    named = [col(k).alias(f"k{i}") for i, k in enumerate(keys)]
    group = [f"k{i}" for i in range(len(keys))] + ["c"]
    cells = F.array(*[F.struct(F.lit(i).alias("c"), number(c).alias("v")) for i, c in enumerate(columns)])
    values = materialise(df.select(*named, F.inline(cells)), "values")
    sizes = values.groupBy(*group).agg(F.count("v").alias("size"), F.min("v").alias("low"), F.max("v").alias("high"))
    spot = F.col("p") * (F.col("size") - 1)
    wanted = materialise(sizes.select("*", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("p")).select("*", F.floor(spot).alias("below"), F.ceil(spot).alias("above")), "wanted")
    # one open interval per group and rank
    open_ = wanted.where("size > 0").select(*group, "size", "low", "high", F.explode(F.array("below", "above")).alias("rank")).distinct().withColumn("left", F.col("rank"))
    found, first = [], True
    while True:
        open_ = materialise(open_, "intervals")
        found.append(open_.where("low = high").select(*group, "rank", F.col("low").alias("value")))
        few = open_.where((F.col("low") < F.col("high")) & (F.col("size") <= sort_limit))
        order = Window.partitionBy(*group, "rank").orderBy("v")
        found.append(_inside(values, few, group).withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") == F.col("left") + 1).select(*group, "rank", F.col("v").alias("value")))
        many = open_.where((F.col("low") < F.col("high")) & (F.col("size") > sort_limit))
        if many.isEmpty():
            break
        counted = (_inside(values, many, group).withColumn("b", _bucket(first)).groupBy(*group, "rank", "left", "b")
                   .agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("low"), F.max("v").alias("high")))
        before = F.sum("size").over(Window.partitionBy(*group, "rank").orderBy("b")) - F.col("size")
        open_ = (counted.withColumn("before", before).where((F.col("before") <= F.col("left")) & (F.col("left") < F.col("before") + F.col("size")))
                 .select(*group, "size", "low", "high", "rank", (F.col("left") - F.col("before")).alias("left")))
        first = False
    told = found[0]
    for more in found[1:]:
        told = told.unionAll(more)
    told = materialise(told, "ranks")
    ends = wanted
    for end in ("below", "above"):
        ends = _joined(ends, told.withColumnsRenamed({"rank": end, "value": f"{end}_value"}), [*group, end], "left")
    share = spot - F.col("below")
    value = F.when(F.col("below_value") == F.col("above_value"), F.col("below_value")).otherwise(F.col("below_value") + (F.col("above_value") - F.col("below_value")) * share)
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c") + 1)
    return ends.select(*[F.col(f"k{i}").alias(k) for i, k in enumerate(keys)], names.alias("column_name"), F.col("p").alias("probability"), value.alias("value"))


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join in which nulls are equal."""
    other = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    met = F.lit(True)
    for c in on:
        met = met & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(other, met, how).drop(*[f"_r_{c}" for c in on])


def _inside(values: DataFrame, intervals: DataFrame, group: list[str]) -> DataFrame:
    """The values of each interval, with its bounds. AQE splits the group that most rows belong to, if the intervals are too many to broadcast."""
    return _joined(values.where("v IS NOT NULL"), intervals, group, "inner").where("v >= low AND v <= high")
