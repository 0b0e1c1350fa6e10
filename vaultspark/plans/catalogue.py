"""All core queries and their SQL, gathered from the plans modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vaultspark.plans import markdown, pages, problems, rendered, stages, vault

FLAGSHIP = "rank_notes"
MODULES = [problems, markdown, vault, pages, rendered, stages]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
