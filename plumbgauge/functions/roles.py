"""Column roles and dataset types from column names, types and distinct counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbgauge.functions import lexicon as L
from plumbgauge.functions.text import contains_any

INTEGER_TYPES = ["tinyint", "smallint", "int", "bigint"]


def is_integer_type(dtype: Column) -> Column:
    return dtype.isin(INTEGER_TYPES)


def is_numeric_type(dtype: Column) -> Column:
    return is_integer_type(dtype) | dtype.isin("float", "double") | dtype.startswith("decimal")


def is_datetime_type(dtype: Column) -> Column:
    return dtype.isin("date", "timestamp", "timestamp_ntz")


def role(name: Column, dtype: Column, distinct: Column) -> Column:
    """The ordered role rules over (name, type, distinct count).

    The tests are substring tests, so ``page`` contains ``age``; that is the rule, and the
    operators take ``overrides`` for the columns it gets wrong.
    """
    low = F.lower(F.trim(name))
    numeric = is_numeric_type(dtype)
    affix = [F.endswith(low, F.lit(f"_{a}")) | F.startswith(low, F.lit(f"{a}_")) for a in L.ID_AFFIXES]
    id_name = low.isin(L.ID_EXACT) | affix[0] | affix[1] | affix[2]
    id_word = (contains_any(low, L.ID_WORDS)
               & ~contains_any(low, L.ID_METRIC_VETO) & ~contains_any(low, L.ID_ATTRIBUTE_VETO))
    return (F.when(is_datetime_type(dtype) | contains_any(low, L.DATE_WORDS), "DATE")
            .when(id_name | id_word, "IDENTIFIER")
            .when(contains_any(low, L.METRIC_WORDS), "BUSINESS_METRIC")
            .when(contains_any(low, L.ATTRIBUTE_WORDS), F.when(numeric, "ATTRIBUTE").otherwise("DIMENSION"))
            .when(contains_any(low, L.DIMENSION_WORDS), "DIMENSION")
            .when(numeric & ~(is_integer_type(dtype) & (distinct < 10)), "BUSINESS_METRIC")
            .otherwise("DIMENSION"))


def is_dimension(name: Column, dtype: Column) -> Column:
    return F.lower(name).isin(L.KNOWN_DIMENSIONS) | (dtype == "string")
