"""Connector registry: what a connector must supply, looked up by its name.

A connector is a module with `CONNECTOR`, `DISPLAY_NAME`, `normalize`, `validate_field_values`, `capabilities` and
`classify_failures`. New connectors register under their own name and vocabulary.
"""

from __future__ import annotations

from types import ModuleType

from pyspark.sql import DataFrame, functions as F

_REGISTRY: dict[str, ModuleType] = {}


def register(connector) -> None:
    if connector.CONNECTOR in _REGISTRY and _REGISTRY[connector.CONNECTOR] is not connector:
        raise ValueError(f"connector {connector.CONNECTOR!r} is already registered")
    _REGISTRY[connector.CONNECTOR] = connector


def normalizer(name: str):
    """Normalizing function of a connector; an unknown one is refused, never guessed at."""
    _load()
    if name not in _REGISTRY:
        raise KeyError(f"no connector named {name!r}")
    return _REGISTRY[name].normalize


def field_verdicts(name: str, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """Verdict per observed value. Without a known connector every value is UNPROVEN."""
    _load()
    if name in _REGISTRY:
        return _REGISTRY[name].validate_field_values(values, definitions)
    return values.select("snapshot_id", "record_id", "field_id", F.lit("UNPROVEN").alias("verdict"),
                         F.lit("NO_SEMANTICS").alias("reason"))


def declared_capabilities(name: str, snapshots: DataFrame) -> DataFrame:
    """The connector's capability rows for each snapshot, availability not yet observed."""
    _load()
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in (
        ("id", i), ("name", n), ("requirement", "REQUIRED"), ("implementation", state), ("availability", "UNKNOWN"),
        ("state", state), ("note", note))]) for i, n, state, note in sorted(_REGISTRY[name].CAPABILITIES)])
    return snapshots.select("snapshot_id", F.explode(rows).alias("c")).select("snapshot_id", "c.*")


def observe(capabilities: DataFrame, available: list[str]) -> DataFrame:
    """Mark the capabilities an operation established."""
    return capabilities.withColumn("availability", F.when(F.col("id").isin(available), "AVAILABLE").otherwise(F.col("availability")))


def names() -> list[str]:
    _load()
    return sorted(_REGISTRY)


def _load() -> None:
    from sealcheck.connectors import clickup, notion
    for connector in (clickup, notion):
        register(connector)


def judgeable(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """Values a connector may judge, with their definition: known field, OBSERVED_ONLY, valid JSON."""
    from sealcheck.functions.jsonfn import valid_json
    known = definitions.select("snapshot_id", F.col("id").alias("field_id"), "field_type", "definition_json")
    return values.filter("semantics_state = 'OBSERVED_ONLY'").join(known, ["snapshot_id", "field_id"]).filter(
        valid_json(F.col("observed_value_json")))
