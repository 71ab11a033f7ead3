"""Tolerant parsing: failures become null, never an error."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbgauge.functions.lexicon import DATE_SHAPES, FALSE_WORDS, FORMATTED_NUMBER, TRUE_WORDS
from plumbgauge.functions.text import strip


def boolean_text(c: Column) -> Column:
    return F.lower(strip(c.cast("string")))


def is_boolean_word(c: Column) -> Column:
    return boolean_text(c).isin(TRUE_WORDS + FALSE_WORDS)


def parse_boolean(c: Column) -> Column:
    low = boolean_text(c)
    return F.when(low.isin(TRUE_WORDS), True).when(low.isin(FALSE_WORDS), False)


def is_formatted_number(c: Column) -> Column:
    """Currency, percent or thousands format; plain integers of up to three digits match too."""
    return c.rlike(FORMATTED_NUMBER)


def is_plain_number(c: Column) -> Column:
    """Digits with at most one dot."""
    return c.rlike(r"^(\d+\.?\d*|\.\d+)$")


def parse_number(c: Column) -> Column:
    """Strip currency, percent and thousands signs, then cast. ``4%`` is 4, not 0.04."""
    return number_or_null(strip(F.regexp_replace(c, "[$€£%,]", "")))


def number_or_null(text: Column) -> Column:
    """Cast of what looks like a number; a failing cast costs an exception per value, the test does not."""
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def parse_timestamp(c: Column, formats: list[str] | None = None) -> Column:
    """First of the ordered formats that fits; the caller can pass others. Month names may be in any case."""
    text = strip(c)
    tries = []
    for shape, f in DATE_SHAPES if formats is None else []:
        tries.append(F.when(text.rlike(f"^{shape}$"), text.try_cast("timestamp") if f is None else _by_format(text, f)))
    for f in formats or []:
        parsed, shape = F.try_to_timestamp(text, F.lit(f)), _shape(f)
        tries.append(F.when(text.rlike(shape), parsed) if shape else parsed)
    return F.coalesce(*tries)


def _by_format(text: Column, f: str) -> Column:
    """Month names in any case; of two-digit years 69 to 99 lie in the last century."""
    text = F.initcap(text) if "MMM" in f else text
    if f.endswith(("/yy", "-yy")):
        year = F.right(text, F.lit(2))
        text, f = F.concat(F.substr(text, F.lit(1), F.length(text) - 2), F.when(year >= "69", "19").otherwise("20"), year), f + "yy"
    return F.try_to_timestamp(text, F.lit(f))


def _shape(date_format: str) -> str | None:
    """Pattern of the texts an all-digit format can parse, so that others are not tried in vain."""
    out = []
    for quoted, letters, other in re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z'])", date_format):
        if letters:
            if letters not in ("yyyy", "MM", "dd", "HH", "mm", "ss", "SSS"):
                return None
            out.append(rf"\d{{{len(letters)}}}")
        elif other in ("[", "]"):
            return None
        else:
            out.append(re.escape(quoted or other))
    return "^" + "".join(out) + "$"


def parse_date(c: Column, formats: list[str] | None = None) -> Column:
    """Date at day precision. The type is DATE, not text."""
    return parse_timestamp(c, formats).cast("date")


def as_number(c: Column, data_type: T.DataType) -> Column:
    """Numeric view of a column for arithmetic: text is stripped and cast, NaN becomes null."""
    if isinstance(data_type, T.StringType):
        return parse_number(c)
    if isinstance(data_type, T.BooleanType):
        return c.cast("int").cast("double")
    if isinstance(data_type, T.NumericType):
        return nan_to_null(c.cast("double"), T.DoubleType())
    return F.lit(None).cast("double")


def nan_to_null(c: Column, data_type: T.DataType) -> Column:
    """NaN counts as missing everywhere, so it is turned into null at load."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    return c


def finite_or_null(c: Column, data_type: T.DataType) -> Column:
    """NaN and both infinities to null, for output as JSON."""
    if isinstance(data_type, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c
