"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import columns, extraction, induction, mining, runs, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**mining.QUERIES, **extraction.QUERIES, **runs.QUERIES, **sessions.QUERIES, **columns.QUERIES, **induction.QUERIES}
ORACLE_SQL: dict[str, str] = {**mining.ORACLE_SQL, **extraction.ORACLE_SQL, **runs.ORACLE_SQL, **sessions.ORACLE_SQL, **columns.ORACLE_SQL, **induction.ORACLE_SQL}
