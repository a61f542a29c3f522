"""Queries by name, and for each the same question in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.operators.profile import profile_table
from gristmill.plans import q_linking, q_profile, q_search, q_selection, q_sql, q_verify
from gristmill.sources.catalog import load_catalog

_MODULES = (q_profile, q_search, q_linking, q_verify, q_selection, q_sql)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column profile of ``orders``."""
    catalog = load_catalog(spark, sf_dir, ["orders"])
    return profile_table(catalog.tables["orders"], "orders").orderBy("ordinal")
