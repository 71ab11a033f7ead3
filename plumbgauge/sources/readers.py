"""Readers for delimited, JSON, Parquet and plain text files."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbgauge.functions import lexicon as L
from plumbgauge.functions.parsing import nan_to_null
from plumbgauge.functions.text import strip
from plumbgauge.plans.stats import col, fields
from plumbgauge.session import has_staging, materialise
from plumbgauge.sources import records

_SURPLUS = [f"_surplus{i}" for i in range(16)]


def missing_as_null(df: DataFrame) -> DataFrame:
    """NaN to null in every floating-point column."""
    types = fields(df)
    return df.select(*[nan_to_null(col(c), types[c]).alias(c) for c in df.columns])


def load_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None,
             multi_line: bool = True) -> DataFrame:
    """Delimited file with a header. Lines with surplus fields are skipped, short lines are padded.

    Quoted values may hold line breaks. A first pass finds out; a file with none is split at its lines, one with some is cut at its true record
    ends by many tasks (:mod:`plumbgauge.sources.records`) and staged. Without a staging folder, and if only carriage returns end its lines, such a file is read by one task.
    ``multi_line=False`` saves that pass for files known to have none. The words of ``MISSING_AT_LOAD`` are null. Types are inferred from the whole file; pass ``schema`` to save
    that pass. More text columns than the header has tell the lines with surplus fields; a trailing separator is not surplus.
    """
    rows, names = _fields_as_text(spark, path, sep, multi_line)
    rows = rows.filter(~_surplus()).select(*[F.when(~col(c).isin(L.MISSING_AT_LOAD), col(c)).alias(c) for c in names])
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    types = [f.dataType.simpleString() for f in schema.fields] if schema is not None else inferred_types(rows)
    fields_ = [f.name for f in schema.fields] if schema is not None else names
    return missing_as_null(rows.select(*[(col(c) if t == "string" else strip(col(c)).try_cast(t)).alias(n) for c, t, n in zip(names, types, fields_)]))


def _fields_as_text(spark: SparkSession, path: str, sep: str, multi_line: bool) -> tuple[DataFrame, list[str]]:
    breaks = multi_line and records.breaks_inside_values(spark, path, sep)
    # lines that end in carriage returns alone are left to the reader of whole files
    by_ranges = breaks and has_staging(spark) and not records.returns_end_lines(spark, path)
    options = {"header": "true", "sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": str(breaks).lower(),
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    names = spark.read.options(**options).csv(path).columns
    names[-1:] = [n.removesuffix("\r") for n in names[-1:]]  # left over where a quoted name holds the first line break
    wide = [*names, *_SURPLUS]
    if not by_ranges:
        return spark.read.options(**options).schema(T.StructType([T.StructField(n, T.StringType()) for n in wide])).csv(path), names
    rows = records.records(spark, path, sep).select(records.parsed(F.col("text"), len(wide), sep).alias("r"))
    return materialise(rows.select(*[F.col(f"r.c{i}").alias(n) for i, n in enumerate(wide)]), "records"), names


def _surplus() -> Column:
    return F.coalesce(*[F.col(c) for c in _SURPLUS]).isNotNull()


_DAY = r"^\d{4}-\d{1,2}-\d{1,2}"
# Narrowest type first; a column takes the first that all its values have.
_INFERRED = [("int", r"^[+-]?\d{1,10}$"), ("bigint", r"^[+-]?\d{1,19}$"), ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"),
             ("boolean", r"^(?i:true|false)$"), ("date", _DAY + "$"), ("timestamp", _DAY + r"([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})?)?$")]


def inferred_types(rows: DataFrame) -> list[str]:
    """Type of each text column by all its values, in one aggregation; text where no type fits or nothing is there."""
    aggs = []
    for i, c in enumerate(rows.columns):
        value = strip(col(c))
        aggs.append(F.count(col(c)).alias(f"n{i}"))
        aggs += [F.count(F.when(value.rlike(shape), value.try_cast(t))).alias(f"{t}{i}") for t, shape in _INFERRED]
    seen = rows.agg(*aggs).first()
    return [next((t for t, _ in _INFERRED if seen[f"n{i}"] and seen[f"{t}{i}"] == seen[f"n{i}"]), "string") for i in range(len(rows.columns))]


def malformed_lines(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = True) -> DataFrame:
    """The records :func:`load_csv` skips, for the warning, up to 16 surplus fields."""
    rows, names = _fields_as_text(spark, path, sep, multi_line)
    own = [F.coalesce(col(n), F.lit("")) for n in names]
    return rows.filter(_surplus()).select(F.concat_ws(sep, *own, *[F.col(c) for c in _SURPLUS]).alias("line"))


def load_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    return load_csv(spark, path, "\t", schema, multi_line)


def load_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Array-of-records documents or JSON lines; the first non-blank line tells which.

    A document that is one array cannot be split between tasks, JSON lines can.
    """
    head = spark.read.text(path).filter("trim(value) <> ''").head(1)
    first = head[0]["value"].strip() if head else ""
    lines = first.startswith("{") and first.endswith("}")
    reader = spark.read.option("multiLine", str(not lines).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return missing_as_null(reader.json(path))


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return missing_as_null(spark.read.parquet(path))


def load_text(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A table if the first non-blank line holds tabs or commas and more lines follow, else one document."""
    head = [r["value"] for r in spark.read.text(path).filter(r"value rlike '\\S'").head(2)]
    if len(head) > 1:
        for sep in ("\t", ","):
            if sep in head[0]:
                return load_csv(spark, path, sep, schema)
    # Bytes that are not UTF-8 arrive as replacement characters and are dropped.
    return spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "�", "").alias("text"))


_READERS = {"csv": load_csv, "tsv": load_tsv, "json": load_json, "parquet": load_parquet, "txt": load_text}


def load_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by file extension or by the given format."""
    kind = (fmt or PurePosixPath(path).suffix.lstrip(".")).lower()
    if kind not in _READERS:
        raise ValueError(f"unsupported file type: {kind!r}")
    return _READERS[kind](spark, path)


def promote_header(cells: DataFrame, keys: list[str], row_no: str = "row_no", values: str = "cells") -> DataFrame:
    """Cell grids (one array per row) to (keys, row, column, value), with row 0 as the column names.

    A grid with a header only yields nothing.
    """
    head = cells.filter(col(row_no) == 0).select(*keys, col(values).alias("_names"))
    pairs = F.arrays_zip(F.col("_names").alias("column_name"), col(values).alias("value"))
    return (cells.filter(col(row_no) > 0).join(head, keys)
            .select(*keys, col(row_no), F.inline(pairs).alias("column_name", "value")))
