"""Cleaning recommendations: what could be fixed, how severe it is, how many cells it touches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbgauge.functions import lexicon as L
from plumbgauge.functions.parsing import parse_timestamp
from plumbgauge.functions.text import strip
from plumbgauge.operators.profile import fences, outside
from plumbgauge.operators.schema import roles_of
from plumbgauge.plans.quantiles import exact_quantiles
from plumbgauge.plans.spelling import near_text_pairs
from plumbgauge.plans.stats import col, columns_to_rows, fields, is_numeric, is_text, local_rows
from plumbgauge.session import stored

_SCHEMA = ("rec_id string, rec_type string, column_name string, severity string, "
           "affected_rows bigint, description string")


def candidates(df: DataFrame) -> list[str]:
    """Columns open to recommendations: all but the flags written by earlier cleaning."""
    return [c for c in df.columns if c not in L.FLAG_COLUMNS]


def _rows(df: DataFrame, checks: list[tuple[str, str, str, str, Column, str]]) -> DataFrame:
    """Recommendation rows for (rec_id, type, column, severity, condition, wording), counted in one pass."""
    if not checks:
        return local_rows(df.sparkSession, _SCHEMA)
    aggs = [F.count_if(cond).alias(f"k{i}") for i, (*_, cond, _) in enumerate(checks)]
    structs = [F.struct(F.lit(rec_id).alias("rec_id"), F.lit(kind).alias("rec_type"), F.lit(c).alias("column_name"),
                        F.lit(severity).alias("severity"), F.col(f"k{i}").alias("affected_rows"),
                        F.format_string(text, F.col(f"k{i}"), F.lit(c)).alias("description"))
               for i, (rec_id, kind, c, severity, _, text) in enumerate(checks)]
    return columns_to_rows(df.agg(*aggs), structs).filter("affected_rows > 0")


def rec_missing(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Fill missing dimensions with ``Unknown`` and missing attributes with the median."""
    roles = roles or roles_of(df)
    fills = {"DIMENSION": ("Unknown", "Group %d missing values of %s under Unknown."),
             "ATTRIBUTE": ("median", "Fill %d missing values of %s with the median.")}
    checks = [(f"impute_missing:{c}:{fills[roles[c]][0]}", "impute_missing", c, "minor",
               col(c).isNull(), fills[roles[c]][1])
              for c in candidates(df) if roles.get(c) in fills]
    return _rows(df, checks)


def rec_outliers(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Flag values beyond 3 interquartile ranges; identifiers and dates are left alone."""
    roles = roles or roles_of(df)
    columns = [c for c in candidates(df) if is_numeric(fields(df)[c])
               and roles.get(c) not in ("IDENTIFIER", "DATE")]
    quartiles = exact_quantiles(df, columns, [0.25, 0.75])
    checks = [(f"flag_outliers:{c}", "flag_outliers", c, "minor",
               outside(col(c).cast("double"), *fences(quartiles[c], 3.0)), "Flag %d outliers in %s.")
              for c in columns]
    return _rows(df, checks)


def invalid_rules(name: str) -> list[Column]:
    """Conditions for impossible numbers that go by the column's name."""
    low, c = name.lower(), col(name)
    rules = []
    if any(w in low for w in L.NEGATIVE_WORDS):
        rules.append(c < 0)
    if "age" in low:
        rules.append((c < 0) | (c > 120))
    if "abv" in low:
        rules.append((c < 0) | (c > 100))
    return rules


def unparseable(name: str, formats: list[str] | None = None) -> Column:
    return col(name).isNotNull() & parse_timestamp(col(name), formats).isNull()


def rec_invalid(df: DataFrame, roles: dict[str, str] | None = None, formats: list[str] | None = None) -> DataFrame:
    """Null out impossible numbers and unparseable dates. Major: needs approval.

    The counts of all rules that fit a column are added up.
    """
    roles = roles or roles_of(df)
    parts = []
    for c in candidates(df):
        t = fields(df)[c]
        rules = invalid_rules(c) if is_numeric(t) else []
        if roles.get(c) == "DATE" and is_text(t):
            rules = rules + [unparseable(c, formats)]
        parts += [(f"clean_invalid_values:{c}", "clean_invalid_values", c, "major", rule,
                   "Null out %d invalid values of %s.") for rule in rules]
    rows = _rows(df, parts)
    return (rows.groupBy("rec_id", "rec_type", "column_name", "severity")
            .agg(F.sum("affected_rows").alias("affected_rows"))
            .withColumn("description", F.format_string("Null out %d invalid values of %s.",
                                                       "affected_rows", "column_name")))


def category_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per column with at least two values: one row per spelling that leads its case variants.

    The leader is the most frequent variant, then the smallest.
    """
    if not columns:
        return local_rows(df.sparkSession, "column_name string, low string, n bigint, value string")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), col(c).cast("string").alias("value"))
                      for c in columns])
    counted = (df.select(F.inline(pairs)).filter("value IS NOT NULL")
               .groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n")))
    return (counted.withColumn("low", strip(F.lower("value")))
            .groupBy("column_name", "low")
            .agg(F.max("n").alias("n"),
                 F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value")))


def near_pairs(leaders: DataFrame) -> DataFrame:
    """Pairs (kept, replaced) of near spellings within a column; the more frequent, then smaller, is kept."""
    leaders = stored(leaders, "leaders")
    a = leaders.select("column_name", F.col("low").alias("low_a"), F.struct("n", "value").alias("a"))
    b = leaders.select("column_name", F.col("low").alias("low_b"), F.struct("n", "value").alias("b"))
    both = near_text_pairs(leaders.select("column_name", "low")).join(a, ["column_name", "low_a"]).join(b, ["column_name", "low_b"])
    first = (F.col("a.n") > F.col("b.n")) | ((F.col("a.n") == F.col("b.n")) & (F.col("a.value") < F.col("b.value")))
    kept, replaced = F.when(first, F.col("a")).otherwise(F.col("b")), F.when(first, F.col("b")).otherwise(F.col("a"))
    return both.select("column_name", kept.alias("k"), replaced.alias("r")).select(
        "column_name", F.col("k.value").alias("kept"), F.col("r.value").alias("replaced"), F.col("k.n").alias("n_a"), F.col("r.n").alias("n_b"))


def rec_categories(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Merge spelling variants of dimensions; ``affected_rows`` counts the pairs."""
    roles = roles or roles_of(df)
    columns = [c for c in candidates(df) if roles.get(c) == "DIMENSION"]
    if not columns:
        return local_rows(df.sparkSession, _SCHEMA)
    return (near_pairs(category_variants(df, columns))
            .groupBy("column_name").agg(F.count(F.lit(1)).alias("affected_rows"))
            .select(F.concat(F.lit("merge_categories:"), "column_name").alias("rec_id"),
                    F.lit("merge_categories").alias("rec_type"), "column_name",
                    F.lit("minor").alias("severity"), "affected_rows",
                    F.format_string("Merge %d pairs of spelling variants in %s.",
                                    "affected_rows", "column_name").alias("description")))


def recommendations(df: DataFrame, roles: dict[str, str] | None = None,
                    formats: list[str] | None = None) -> DataFrame:
    """All recommendations of a table; ``rec_id`` is what an approval names."""
    roles = roles or roles_of(df)
    parts = [rec_missing(df, roles), rec_outliers(df, roles), rec_invalid(df, roles, formats), rec_categories(df, roles)]
    return reduce(DataFrame.unionByName, parts)


def auto_approve(recs: DataFrame) -> bool:
    """A table needs no approval when nothing major was found."""
    return recs.filter(F.col("severity") == "major").isEmpty()
