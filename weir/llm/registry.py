"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weir.llm import queries_corpus, queries_native, queries_tables, queries_text

MODULES = (queries_native, queries_tables, queries_text, queries_corpus)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
