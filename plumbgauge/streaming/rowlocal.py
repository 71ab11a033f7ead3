"""Apply fitted row-local cleaning to a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from plumbgauge.operators.clean import Standardiser


def standardise_stream(stream: DataFrame, fitted: Standardiser) -> DataFrame:
    """The always-on cleaning of each row with decisions taken earlier on a table.

    No state, no shuffle: the decisions are fixed, so rows can be cleaned as they arrive.
    """
    return fitted.apply(stream)
