"""Imports every query module, so that all queries are registered."""

from plumbgauge.catalogue import answers, cleaning, documents, profiling, relational, storage  # noqa: F401
from plumbgauge.catalogue.registry import oracle_sql, queries  # noqa: F401
