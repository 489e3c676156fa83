"""Every query of the library, by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import act_queries, document_queries, layout_queries, record_queries, relational_queries, text_queries

_MODULES = (relational_queries, record_queries, text_queries, act_queries, document_queries, layout_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
