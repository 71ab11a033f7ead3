"""Check of numbers claimed in answers against the numbers of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.plans.stats import col, fields, is_text

NUMBER = r"\b\d+(?:\.\d+)?\b"
TOLERANCE = 0.05
_BASE = 1.04  # bucket ratio, below 1 + TOLERANCE so that values of one bucket always agree


def _bucket(x: Column) -> Column:
    return F.floor(F.log(x) / F.log(F.lit(_BASE))).cast("bigint")


def numbers_in(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def _close(r: Column, x: Column) -> Column:
    return F.abs(r - x) < TOLERANCE * F.greatest(F.abs(r), F.lit(1.0))


def claim_mismatches(answers: DataFrame, results: DataFrame, key: str, answer: str, values: list[str]) -> DataFrame:
    """Numbers in the answers that lie within 5 % of no number of the same key's result.

    Numbers under 5 and years 1990 to 2040 are ignored. Result numbers are reduced to the smallest
    and largest per logarithmic bucket: the result value nearest to a claim within a bucket is one of
    the two, so a claim meets a handful of bucket rows by equality instead of every result row.
    """
    claims = (answers.select(col(key), F.explode(numbers_in(col(answer))).alias("claim"))
              .withColumn("x", F.round(F.col("claim").cast("double"), 2))
              .filter("x >= 5 AND NOT (x BETWEEN 1990 AND 2040)"))
    types = fields(results)
    parts = []
    for v in values:
        if is_text(types[v]):
            parts.append(F.transform(numbers_in(col(v)), lambda n: F.round(n.cast("double"), 2)))
        else:
            number = col(v).cast("double")
            parts.append(F.array(F.round(number, 2), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
                                 .cast("double")))
    # A claim is at least 5, so only result values above 1 can be within 5 % of it.
    ranges = (results.select(col(key), F.explode(F.concat(*parts)).alias("r")).filter("r > 1")
              .groupBy(key, _bucket(F.col("r")).alias("bucket"))
              .agg(F.min("r").alias("r_min"), F.max("r").alias("r_max")))
    distinct = claims.select(key, "x").distinct()
    reach = F.sequence(_bucket(F.col("x") / 1.06), _bucket(F.col("x") / 0.94))
    matched = (distinct.select(key, "x", F.explode(reach).alias("bucket"))
               .join(ranges, [key, "bucket"])
               .filter(_close(F.col("r_min"), F.col("x")) | _close(F.col("r_max"), F.col("x")))
               .select(key, "x").distinct())
    return claims.join(matched, [key, "x"], "left_anti").select(key, "claim")
