"""Schema and metadata summaries, column roles, dataset type."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbgauge.functions import lexicon as L
from plumbgauge.functions import roles as R
from plumbgauge.functions.text import contains_any
from plumbgauge.plans.stats import INTEGER, column_stats, few_distinct, fields, is_datetime, is_numeric, local_rows


def normalise_columns(df: DataFrame, on_collision: str = "raise") -> DataFrame:
    """Trim, lower-case and underscore the column names.

    Two names may become equal: ``raise`` stops, ``suffix`` numbers the later ones.
    """
    seen: set[str] = set()
    names = []
    for name in df.columns:
        base = name.strip().lower().replace(" ", "_")
        new, i = base, 1
        while new in seen:
            if on_collision == "raise":
                raise ValueError(f"columns collide after normalisation: {base!r}")
            i += 1
            new = f"{base}_{i}"
        seen.add(new)
        names.append(new)
    return df.toDF(*names)


def schema_summary(df: DataFrame, approx: bool = False, distinct: bool = True) -> DataFrame:
    """One row per column: type, null count, distinct non-null count (unless not needed)."""
    return column_stats(df, approx=approx, distinct=distinct)


def summaries_of(tables: dict[str, DataFrame], approx: bool = False, distinct: bool = True) -> DataFrame:
    """Schema summary of several tables in one DataFrame, with the table name in front."""
    parts = [schema_summary(df, approx, distinct).select(F.lit(name).alias("table_name"), "*")
             for name, df in tables.items()]
    return reduce(DataFrame.unionAll, parts)


def metadata_summary(df: DataFrame) -> DataFrame:
    """Row and column counts and the column names by class; booleans count as categorical."""
    numeric = [n for n, t in fields(df).items() if is_numeric(t)]
    dates = [n for n, t in fields(df).items() if is_datetime(t)]
    rest = [n for n in df.columns if n not in numeric and n not in dates]

    def names(items: list[str]):
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        names(df.columns).alias("columns"), names(numeric).alias("numeric_columns"),
        names(rest).alias("categorical_columns"), names(dates).alias("date_columns"))


def with_roles(summary: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Add ``role`` to schema-summary rows of any number of tables; ``overrides`` maps column names."""
    role = R.role(F.col("column_name"), F.col("dtype"), F.col("distinct_count"))
    for name, fixed in (overrides or {}).items():
        role = F.when(F.col("column_name") == name, fixed).otherwise(role)
    return summary.withColumn("role", role)


def with_dimension_flag(summary: DataFrame) -> DataFrame:
    """Add ``is_dimension``: a well-known dimension name or a text type."""
    return summary.withColumn("is_dimension", R.is_dimension(F.col("column_name"), F.col("dtype")))


def roles_of(df: DataFrame, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Roles of one table as a dictionary, for operators that plan by role.

    Names and types settle nearly every column without touching the data. Only integer columns
    whose role hangs on their distinct count are counted, together in one pass.
    """
    spark = df.sparkSession
    known = [(n, t.simpleString()) for n, t in fields(df).items()]
    bare = local_rows(spark, "column_name string, dtype string", known)
    few = R.role(F.col("column_name"), F.col("dtype"), F.lit(0))
    many = R.role(F.col("column_name"), F.col("dtype"), F.lit(1 << 30))
    settled = bare.select("column_name", few.alias("few"), many.alias("many")).collect()
    out = {r["column_name"]: r["many"] for r in settled}
    open_columns = [r["column_name"] for r in settled
                    if r["few"] != r["many"] and isinstance(fields(df)[r["column_name"]], INTEGER)]
    if open_columns:
        counts = few_distinct(df, open_columns, 10)
        for c in open_columns:
            if counts[c] < 10:
                out[c] = next(r["few"] for r in settled if r["column_name"] == c)
    out.update(overrides or {})
    return {c: out[c] for c in df.columns}


def roles_of_tables(tables: dict[str, DataFrame], overrides: dict[str, str] | None = None) -> DataFrame:
    """(table_name, column_name, role) of every column.

    Tables whose columns all have a role by name and type are not read. In the others the integer columns in doubt are sketched in one pass, and
    only those that may have few values are counted exactly.
    """
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, c, role) for name, df in tables.items() for c, role in roles_of(df, overrides).items()]
    return local_rows(spark, "table_name string, column_name string, role string", rows)


def dataset_types(summary: DataFrame) -> DataFrame:
    """Type of each table: the domain whose words hit most column names, ties to the earlier domain."""
    low = F.lower(F.trim("column_name"))
    hits = [F.count_if(contains_any(low, words)).alias(f"s{i}")
            for i, words in enumerate(L.DATASET_TYPES.values())]
    per_table = summary.groupBy("table_name").agg(*hits)
    names = list(L.DATASET_TYPES)
    # The larger score wins; the smaller position wins among equal scores.
    best = F.array_max(F.array(*[F.struct(F.col(f"s{i}").alias("score"), F.lit(-i).alias("place"),
                                          F.lit(n).alias("name")) for i, n in enumerate(names)]))
    return per_table.select("table_name", F.when(best["score"] > 0, best["name"])
                            .otherwise(L.DEFAULT_DATASET_TYPE).alias("dataset_type"),
                            best["score"].alias("score"))


def dataset_type_of(df: DataFrame) -> str:
    spark: SparkSession = df.sparkSession
    names = local_rows(spark, "table_name string, column_name string", [("t", n) for n in df.columns])
    return dataset_types(names).first()["dataset_type"]


def type_breakdown(summary: DataFrame) -> DataFrame:
    """Numeric against other columns per table."""
    numeric = R.is_numeric_type(F.col("dtype"))
    return summary.groupBy("table_name").agg(F.count_if(numeric).alias("numeric_columns"),
                                             F.count_if(~numeric).alias("other_columns"))
