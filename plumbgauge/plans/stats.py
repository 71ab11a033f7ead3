"""Column statistics in one aggregation, returned as one row per column."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def fields(df: DataFrame) -> dict[str, T.DataType]:
    return {f.name: f.dataType for f in df.schema.fields}


def col(name: str) -> Column:
    """Column by its exact name, dots and blanks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.VarcharType, T.CharType))


def is_datetime(t: T.DataType) -> bool:
    return isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in fields(df).items() if is_numeric(t)]


def text_columns(df: DataFrame) -> list[str]:
    return [n for n, t in fields(df).items() if is_text(t)]


def fingerprint(columns: list[Column]) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of some values, nulls told apart by position.

    Together they stand for the values in grouping and counting, so that wide rows and long texts
    need not be shuffled: even a trillion distinct values collide with a chance below 1e-14.
    """
    parts = [x for c in columns for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts)


def maybe_few(df: DataFrame, columns: list[str], bound: int) -> list[str]:
    """Columns that may have fewer than ``bound`` values, by a sketch with a tenfold margin.

    The others are settled without shuffling their values.
    """
    if not columns:
        return []
    rough = df.agg(*[F.approx_count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if rough[f"d{i}"] < 10 * bound]


def few_distinct(df: DataFrame, columns: list[str], bound: int) -> dict[str, int]:
    """Exact distinct counts of the columns that have fewer than ``bound`` values, ``bound`` for the others."""
    close = maybe_few(df, columns, bound)
    out = dict.fromkeys(columns, bound)
    if close:
        exact = df.agg(*[F.count_distinct(col(c)).alias(f"d{i}") for i, c in enumerate(close)]).first()
        out.update({c: min(bound, exact[f"d{i}"]) for i, c in enumerate(close)})
    return out


def columns_to_rows(one_row: DataFrame, structs: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct, without another pass."""
    return one_row.select(F.inline(F.array(*structs)))


def column_stats(df: DataFrame, columns: list[str] | None = None, *, distinct: bool = True,
                 numeric: bool = False, approx: bool = False) -> DataFrame:
    """One row per column: position, type, row, null and distinct counts, and for numeric columns
    minimum, maximum, mean and sample deviation.

    All columns share a single aggregation. Distinct counts are exact unless ``approx`` asks
    for sketches, which avoid shuffling the distinct values of a wide table. Exact counts group narrow rows of
    column number and fingerprint, so no row is copied in full and no value travels.
    """
    types = fields(df)
    names = columns or df.columns
    aggs = [F.count(F.lit(1)).alias("n")]
    structs = []
    for i, name in enumerate(names):
        c, t = col(name), types[name]
        position = df.columns.index(name)
        aggs.append(F.count(c).alias(f"filled_{i}"))
        out = [F.lit(position).alias("position"), F.lit(name).alias("column_name"),
               F.lit(t.simpleString()).alias("dtype"), F.col("n").alias("row_count"),
               (F.col("n") - F.col(f"filled_{i}")).alias("null_count")]
        if distinct and approx:
            aggs.append(F.approx_count_distinct(c).alias(f"distinct_{i}"))
            out.append(F.col(f"distinct_{i}").alias("distinct_count"))
        if numeric:
            value = c.cast("double") if is_numeric(t) else F.lit(None).cast("double")
            for label, fn in (("min", F.min), ("max", F.max), ("mean", F.avg), ("std", F.stddev_samp)):
                if is_numeric(t):
                    aggs.append(fn(value).alias(f"{label}_{i}"))
                    out.append(F.col(f"{label}_{i}").alias(f"{label}_value"))
                else:
                    out.append(value.alias(f"{label}_value"))
        structs.append(F.struct(*out))
    stats = columns_to_rows(df.agg(*aggs), structs)
    if not distinct or approx:
        return stats
    counted = distinct_counts(df, names).select(F.col("column_name").alias("_name"), "distinct_count")
    after = stats.columns.index("null_count") + 1
    joined = stats.join(counted, F.col("column_name") == F.col("_name"), "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))
    return joined.select(*stats.columns[:after], "distinct_count", *stats.columns[after:])


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, distinct_count): exact distinct non-null values; columns without any are left out."""
    cells = []
    for i, name in enumerate(columns):
        first, second = fingerprint([col(name)])
        cells.append(F.when(col(name).isNotNull(), F.struct(F.lit(i).alias("i"), first.alias("a"), second.alias("b"))))
    distinct = df.select(F.inline(F.filter(F.array(*cells), lambda x: x.isNotNull()))).groupBy("i", "a", "b").agg(F.lit(1).alias("one"))
    names = F.array(*[F.lit(n) for n in columns])
    return distinct.groupBy("i").agg(F.count(F.lit(1)).alias("distinct_count")).select(F.get(names, F.col("i")).alias("column_name"), "distinct_count")


def local_rows(spark: SparkSession, ddl: str, rows: list[tuple] | None = None) -> DataFrame:
    """Small driver-side rows as a local relation, which needs no Python workers to read back."""
    schema = T.StructType.fromDDL(ddl)
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
             "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
    rows = rows or []
    columns = [pa.array([r[i] for r in rows], arrow[f.dataType.simpleString()]) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, names=schema.names), schema)
