"""Sealing: what a manifest states, derived from normalized tables and landed files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from sealcheck.operators import seal as S
from sealcheck.operators.normalize import attachment_outcomes


@dataclass
class Manifest:
    attachments: DataFrame
    inventory: DataFrame
    observed: DataFrame
    discrepancies: DataFrame
    capabilities: DataFrame
    status: DataFrame
    findings: DataFrame


def seal(tables: dict[str, DataFrame], landed: DataFrame, expected: DataFrame, capabilities: DataFrame, snapshots: DataFrame) -> tuple[dict, Manifest]:
    """(tables with settled attachments, manifest parts). Mismatched counts are findings and must stop publication."""
    settled = tables | {"attachments": attachment_outcomes(tables["attachments"], landed)}
    refined, undeclared = S.observe_capability(capabilities, settled["attachments"])
    records = settled["attachments"].select(
        "snapshot_id", "id", "source_id", "record_id", "filename", "media_type", "expected_size", F.col("download_status").alias("status"),
        "local_path", "archived_size", "checksum", "error")
    return settled, Manifest(
        records, S.inventory(settled, expected), S.observed_counts(settled), S.discrepancies(settled["attachments"], settled["relationships"]),
        refined, S.archive_status(snapshots, settled["attachments"], refined), S.reconcile_counts(expected, settled).unionByName(undeclared))
