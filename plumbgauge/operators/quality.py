"""Weighted quality score and the check that cleaning has not shifted the key totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.functions import lexicon as L
from plumbgauge.operators.profile import fences, outside
from plumbgauge.operators.recommend import candidates, invalid_rules, unparseable
from plumbgauge.operators.schema import roles_of
from plumbgauge.plans.quantiles import exact_quantiles
from plumbgauge.plans.stats import col, columns_to_rows, fields, is_numeric, is_text


def column_weight(name: str, role: str) -> int:
    """Weight by well-known name, else by role."""
    return L.WEIGHT_BY_NAME.get(name.lower().strip(), L.WEIGHT_BY_ROLE.get(role, 3))


def column_scores(df: DataFrame, roles: dict[str, str] | None = None,
                  formats: list[str] | None = None) -> DataFrame:
    """Per column: weight, nulls, outliers beyond 3 interquartile ranges, invalid cells, score.

    When several name rules fit a numeric column, the last one gives the invalid count.
    """
    roles = roles or roles_of(df)
    types = fields(df)
    names = candidates(df)
    numeric = [c for c in names if is_numeric(types[c])]
    quartiles = exact_quantiles(df, numeric, [0.25, 0.75])
    aggs, structs = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(names):
        role = roles.get(c, "DIMENSION")
        invalid: Column = F.lit(False)
        if c in quartiles:
            rules = invalid_rules(c)
            invalid = rules[-1] if rules else invalid
        elif role == "DATE" and is_text(types[c]):
            invalid = unparseable(c, formats)
        far = outside(col(c).cast("double"), *fences(quartiles[c], 3.0)) if c in quartiles else F.lit(False)
        aggs += [F.count_if(col(c).isNull()).alias(f"m{i}"), F.count_if(far).alias(f"o{i}"),
                 F.count_if(invalid).alias(f"v{i}")]
        structs.append(F.struct(F.lit(c).alias("column_name"), F.lit(column_weight(c, role)).cast("bigint").alias("weight"),
                                F.col("n").alias("row_count"), F.col(f"m{i}").alias("nulls"),
                                F.col(f"o{i}").alias("outliers"), F.col(f"v{i}").alias("invalid")))
    share = F.try_divide(F.col("nulls") + F.col("outliers") + F.col("invalid"), F.col("row_count"))
    return (columns_to_rows(df.agg(*aggs), structs)
            .withColumn("column_score", F.coalesce(F.greatest(F.lit(0.0), 1 - share), F.lit(1.0))))


def quality_score(df: DataFrame, roles: dict[str, str] | None = None,
                  formats: list[str] | None = None) -> DataFrame:
    """Weighted mean of the column scores, 0 to 100 with one decimal."""
    scores = column_scores(df, roles, formats)
    return scores.agg(F.round(F.sum(F.col("column_score") * F.col("weight")) / F.sum("weight") * 100, 1)
                      .alias("quality_score"))


def score_before_after(before: DataFrame, after: DataFrame, roles: dict[str, str] | None = None,
                       formats: list[str] | None = None) -> DataFrame:
    parts = [quality_score(df, roles, formats).select(F.lit(stage).alias("stage"), "quality_score")
             for stage, df in (("before", before), ("after", after))]
    return parts[0].unionAll(parts[1])


def kpi_columns(df: DataFrame) -> dict[str, str]:
    """First column, in table order, that carries one of a KPI's names."""
    out = {}
    for kpi, aliases in L.KPI_ALIASES.items():
        found = [c for c in df.columns if c.lower().strip() in aliases]
        if found:
            out[kpi] = found[0]
    return out


def _totals(df: DataFrame, columns: dict[str, str], value: str) -> DataFrame:
    have = {c.lower().strip(): c for c in reversed(df.columns)}
    aggs, structs = [F.count(F.lit(1)).cast("double").alias("n")], []
    structs.append(F.struct(F.lit("row_count").alias("metric"), F.col("n").alias(value)))
    for i, (kpi, c) in enumerate(columns.items()):
        actual = c if c in df.columns else have.get(c.lower().strip())
        total = F.sum(_plain_number(df, actual)) if actual else F.lit(0.0)
        aggs.append(F.coalesce(total, F.lit(0.0)).alias(f"t{i}"))
        structs.append(F.struct(F.lit(kpi).alias("metric"), F.col(f"t{i}").alias(value)))
    return columns_to_rows(df.agg(*aggs), structs)


def _plain_number(df: DataFrame, name: str) -> Column:
    t = fields(df)[name]
    return col(name).try_cast("double") if is_text(t) else col(name).cast("double")


def integrity_check(before: DataFrame, after: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Row count and KPI totals before and after; a relative change above ``tolerance`` warns.

    The change is relative to the absolute total before, so that negative totals warn as well.
    """
    columns = kpi_columns(before)
    joined = _totals(before, columns, "before_value").join(_totals(after, columns, "after_value"), "metric")
    change = (F.when(F.col("before_value") != 0,
                     F.abs(F.col("after_value") - F.col("before_value")) / F.abs("before_value"))
              .when(F.col("after_value") != 0, 1.0).otherwise(0.0))
    return joined.select("metric", "before_value", "after_value", F.round(change * 100, 2).alias("pct_change"),
                         (change > tolerance).alias("warning"))


def integrity_warning(check: DataFrame) -> bool:
    return not check.filter("warning").isEmpty()

