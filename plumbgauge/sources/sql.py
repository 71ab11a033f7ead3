"""Read-only SQL: one statement, or several separated by semicolons."""

from __future__ import annotations

import re

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from plumbgauge.functions.text import register_text_functions

_PIECE = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/)|(;)""", re.S)
_QUOTES = "spark.sql.ansi.doubleQuotedIdentifiers"


_INITCAP = re.compile(r"\binitcap(?=\s*\()", re.I)


class ReadOnlyError(ValueError):
    """The text is not a query."""


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run a query over the session's tables and the given DataFrames.

    Only queries are accepted: the text has to be usable as a subquery, which no command is. Words
    such as ``update`` inside literals are therefore fine. Double quotes delimit identifiers. A closing
    semicolon is ignored, and ``INITCAP`` capitalises every word and leaves single blanks between them.
    """
    text = prepared(text)
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    register_text_functions(spark)
    before = spark.conf.get(_QUOTES, "false")
    spark.conf.set(_QUOTES, "true")
    try:
        try:
            spark.sql(f"SELECT * FROM (\n{text}\n)")
        except PySparkException as error:
            raise ReadOnlyError(f"not a query: {error}") from error
        return spark.sql(text)
    finally:
        spark.conf.set(_QUOTES, before)


def prepared(text: str) -> str:
    """Without closing semicolons, and with INITCAP calls outside quotes and comments renamed: Spark keeps its built-in."""
    out, at, last = [], 0, 0
    for m in _PIECE.finditer(text):
        out += [_INITCAP.sub("initcap_ws", text[at:m.start()]), m[0]]
        at = m.end()
    out.append(_INITCAP.sub("initcap_ws", text[at:]))
    last = len(out)
    while last and (not out[last - 1].strip() or out[last - 1] == ";" or out[last - 1].startswith(("--", "/*"))):
        last -= 1
    return "".join(out[:last])


def split_statements(text: str) -> list[str]:
    """Cut at semicolons outside quotes and comments; blank pieces are skipped."""
    pieces, start = [], 0
    for m in _PIECE.finditer(text):
        if m.group(2):
            pieces.append(text[start:m.start()])
            start = m.end()
    pieces.append(text[start:])
    return [p.strip() for p in pieces if p.strip()]


def run_statements(spark: SparkSession, text: str,
                   tables: dict[str, DataFrame] | None = None) -> tuple[list[DataFrame], list[str]]:
    """Results of the statements that work, and the errors of those that do not.

    The first result is the one to show.
    """
    results, errors = [], []
    for statement in split_statements(text):
        try:
            results.append(run_sql(spark, statement, tables))
        except (ReadOnlyError, PySparkException) as error:
            errors.append(str(error))
    if not results and errors:
        raise ReadOnlyError("; ".join(errors))
    return results, errors
