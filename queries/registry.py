"""Named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from queries.mapping import Mapping
from queries.oracle import with_mapping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a function of the mapping under a name, with the SQL it must agree with."""
    def register(function):
        QUERIES[name] = lambda spark, sf_dir: function(Mapping(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_mapping(sql, recursive)
        return function
    return register


def findings(check: str, *parts: tuple) -> str:
    """SQL of finding rows: each part is (code, entity, key, detail, from-clause); the first three are SQL texts."""
    return " UNION ALL ".join(
        f"SELECT snapshot_id, '{check}' AS check_name, {code} AS code, {entity} AS entity, CAST({key} AS VARCHAR) AS key, "
        f"CAST({detail} AS VARCHAR) AS detail FROM {source}" for code, entity, key, detail, source in parts)


def coded(check: str, rules: list[tuple[str, str]], entity: str, key: str, source: str, detail: str = "NULL") -> str:
    """SQL of one finding per rule a row of `source` breaks; rules are (condition, code)."""
    return findings(check, *[(f"'{code}'", entity, key, detail, f"{source} WHERE {condition}") for condition, code in rules])
