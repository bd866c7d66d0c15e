"""The portable tables as Parquet, partitioned by snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sealcheck.schemas import PORTABLE_COLUMNS, PORTABLE_ORDER, portable_schema
from sealcheck.session import CODEC


def write_portable(tables: dict[str, DataFrame], path: str) -> None:
    """Write every table in stable order inside its files. An existing target is refused, never merged."""
    unknown = set(tables) - set(PORTABLE_COLUMNS)
    if unknown:
        raise ValueError(f"not portable tables: {sorted(unknown)}")
    for name, frame in tables.items():
        order = ["snapshot_id", *PORTABLE_ORDER.get(name, ["id"])]
        columns = [field.name for field in portable_schema(name)]
        frame.select(*columns).sortWithinPartitions(*order).write.mode("errorifexists").partitionBy("snapshot_id").parquet(f"{path}/{name}", compression=CODEC)


def read_portable(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """All portable tables with their declared columns."""
    return {name: spark.read.schema(portable_schema(name)).parquet(f"{path}/{name}") for name in tables or PORTABLE_COLUMNS}


def stored_columns(spark: SparkSession, path: str, tables: list[str]) -> dict[str, list[str]]:
    """Column names found in storage, snapshot_id first; reads file footers only."""
    found = {}
    for name in tables:
        columns = spark.read.parquet(f"{path}/{name}").columns
        found[name] = ["snapshot_id", *[c for c in columns if c != "snapshot_id"]]
    return found
