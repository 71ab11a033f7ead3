"""Records of delimited files whose quoted values hold line breaks, read by many tasks.

Whether a line begins a record depends on all quotes before it. But a line is only ever entered in one of two states, outside or inside a
quoted value, and for each it leaves in a known one. So every range of a file is scanned once for both states, the ranges' results are chained, a row per
range, and a second pass cuts each range at its true record ends. What crosses the end of a range is put together by one small grouping.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WHOLE, _CONTINUED, _OPEN, _HEADER, _OPEN_HEADER = range(5)


def _patterns(sep: str) -> tuple[str, str]:
    """Patterns of lines that end inside a quoted value, if they begin outside and inside of one.

    A quote opens a value only as its first character; a doubled quote is part of it; what follows the closing quote up to the
    separator belongs to the value, as the CSV reader has it. Possessive throughout: linear, and no recursion on long lines.
    """
    s = "\\t" if sep == "\t" else re.escape(sep)
    inside = '[^"]*+(?:""[^"]*+)*+'
    field = f'(?:"{inside}"[^{s}]*+|[^"{s}][^{s}]*+)?+'
    opened = f'(?:{field}{s})*+"{inside}\\z'
    return f"(?s)^{opened}", f'(?s)^{inside}(?:\\z|"[^{s}]*+{s}{opened})'


def _lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, start, value, out, in): lines in their order, with the range of the file each is read from, and whether it ends inside a quoted value."""
    outside, inside = _patterns(sep)
    quoted = F.contains("value", F.lit('"'))
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value",
        (quoted & F.col("value").rlike(outside)).alias("out"), (~quoted | F.col("value").rlike(inside)).alias("in"))


def breaks_inside_values(spark: SparkSession, path: str, sep: str) -> bool:
    """Whether a quoted value holds a line break. Read in parallel, up to the first one."""
    found = _lines(spark, path, sep).where(F.col("out") | F.col("value").rlike(r"(?s)\r."))
    return not found.isEmpty()


def returns_end_lines(spark: SparkSession, path: str) -> bool:
    """Whether the lines end in carriage returns alone."""
    first = spark.read.option("lineSep", "\n").text(path).head(1)
    return bool(first) and re.match(r'(?:[^"\r]|"[^"]*")*\r.', first[0]["value"], re.DOTALL) is not None


def _runs(batch: pa.RecordBatch):
    """(file, start, slice) of the batch's stretches of one range."""
    files, starts = batch.column(0), batch.column(1).to_numpy()
    names = files.dictionary_encode()
    codes = names.indices.to_numpy()
    change = np.ones(batch.num_rows, dtype=bool)
    change[1:] = (codes[1:] != codes[:-1]) | (starts[1:] != starts[:-1])
    at = [*np.nonzero(change)[0].tolist(), batch.num_rows]
    for s, e in zip(at, at[1:]):
        yield files[s].as_py(), int(starts[s]), batch.slice(s, e - s)


def entered(out: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """State in which each line is entered, and the one after the last, from that before the first."""
    constant, turns = out == inside, out & ~inside
    parity = np.cumsum(turns) % 2 == 1
    last = np.maximum.accumulate(np.where(constant, np.arange(len(out)), -1))
    from_reset = out[last] ^ parity ^ parity[last]
    after = np.where(last >= 0, from_reset, state ^ parity)
    return np.concatenate(([state], after))


def _ranges(lines: DataFrame) -> dict[tuple[str, int], tuple[bool, int | None]]:
    """Per range of a file the state it is entered in, and the range in which the record open there begins."""
    def run(batches):
        now, ends = None, None

        def row():
            values = [now[0], now[1], *(bool(e[0]) for e in ends), ends[1][1]]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["file", "start", "out", "in", "begun"])

        for batch in batches:
            for file, start, part in _runs(batch):
                if (file, start) != now:
                    if now:
                        yield row()
                    now, ends = (file, start), [(False, True), (True, False)]
                out, inside = (part.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
                states = [entered(out, inside, e[0]) for e in ends]
                ends = [(bool(s[-1]), bool(e[1] or not s[:-1].all())) for s, e in zip(states, ends)]
        if now:
            yield row()

    rows = lines.select("file", "start", "out", "in").mapInArrow(run, "file string, start long, out boolean, in boolean, begun boolean")
    told, file, state, owner = {}, None, False, None
    for r in rows.orderBy("file", "start").collect():  # a row per range of a file
        if r["file"] != file:
            file, state, owner = r["file"], False, None
        told[file, r["start"]] = (state, owner)
        begun = r["begun"] if state else True
        state = r["in"] if state else r["out"]
        owner = None if not state else r["start"] if begun else owner
    return told


def records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(text): the records of all files but their headers, cut at true record ends.

    The ranges must be those of one plan, so write the result before it is used twice.
    """
    lines = _lines(spark, path, sep)
    ranges = _ranges(lines)

    def run(batches):
        now, state, held, begun, headed = None, False, [], False, False
        out: list[list] = [[], [], [], []]

        def add(kind, text):
            nonlocal headed
            if kind == _WHOLE and text.endswith("\r"):
                text = text[:-1]
            if not headed and kind in (_WHOLE, _OPEN):
                if not text:
                    return
                headed, kind = True, _HEADER if kind == _WHOLE else _OPEN_HEADER
            for c, v in zip(out, (now[0], now[1] if kind != _CONTINUED else ranges[now][1], now[1], kind)):
                c.append(v)
            texts.append(text)

        def finish():
            if held:
                add((_OPEN if state else _WHOLE) if begun else _CONTINUED, "\n".join(held))

        def taken():
            batch = pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int32()),
                                                pa.array(texts, pa.string())], names=["file", "owner", "start", "kind", "text"])
            for c in (*out, texts):
                c.clear()
            return batch

        texts: list[str] = []
        for batch in batches:
            for file, start, part in _runs(batch):
                if (file, start) != now:
                    finish()
                    now = (file, start)
                    if now not in ranges:
                        raise RuntimeError(f"{file} was cut into other ranges than before: read it again")
                    state, held, begun, headed = ranges[now][0], [], False, start != 0
                ends, inside = (part.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
                states = entered(ends, inside, state)
                values, first = part.column(2).to_pylist(), np.nonzero(~states[:-1])[0].tolist()
                state = bool(states[-1])
                held += values[:first[0] if first else len(values)]
                for s, e in zip(first, [*first[1:], len(values)]):
                    if held:
                        add(_WHOLE if begun else _CONTINUED, "\n".join(held))
                    held, begun = values[s:e], True
            yield taken()
        if now:
            finish()
        yield taken()

    parts = lines.mapInArrow(run, "file string, owner long, start long, kind int, text string")
    pieces = F.sort_array(F.collect_list(F.struct("start", "kind", "text")))
    crossing = parts.where(F.col("kind").isin(_CONTINUED, _OPEN, _OPEN_HEADER)).groupBy("file", "owner").agg(
        pieces.alias("pieces"), F.max("kind").alias("kind")).where(F.col("kind") != _OPEN_HEADER)
    joined = F.regexp_replace(F.array_join(F.transform("pieces", lambda p: p["text"]), "\n"), "\r$", "")
    return parts.where(F.col("kind") == _WHOLE).select("text").unionAll(crossing.select(joined.alias("text"))).where("text <> ''")


def parsed(text: Column, width: int, sep: str) -> Column:
    """A record as a struct of text columns c0, c1 and so on."""
    ddl = ", ".join(f"c{i} string" for i in range(width))
    return F.from_csv(text, ddl, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE",
                                  "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
