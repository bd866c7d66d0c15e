"""Counts, discrepancies and status of a sealed archive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sealcheck.functions.ids import table_digest
from sealcheck.operators.findings import coded, finding, union_all, union_findings
from sealcheck.rules import ATTACHMENT_CONTENT, CREATED_UNVERIFIED, INCOMPLETE, OBSERVED_ENTITIES
from sealcheck.schemas import LEGACY_COUNTS, NEUTRAL_COUNTS

ENTITY = ["snapshot_id", "entity"]


def zero():
    return F.lit(0).cast("long")


def read_inventory_counts(inventory: DataFrame) -> DataFrame:
    """Expected counts as (snapshot_id, entity, expected) from either count vocabulary.

    `inventory` has snapshot_id and the count columns of both vocabularies, null where not stated. A legacy
    document (spaces or lists present) is projected onto the neutral entities and kinds.
    """
    legacy = F.col("spaces").isNotNull() | F.col("lists").isNotNull()
    n = {name: F.coalesce(F.col(name), zero()) for name in dict.fromkeys(NEUTRAL_COUNTS + LEGACY_COUNTS)}
    projected = {"containers": n["spaces"] + n["folders"], "collections": n["lists"],
                 "records": n["tasks"] + n["subtasks"], "nested_records": n["subtasks"]}
    totals = [F.struct(F.lit(name).alias("entity"),
                       (F.when(legacy, projected[name]).otherwise(n[name]) if name in projected else n[name])
                       .alias("expected")) for name in NEUTRAL_COUNTS]
    old_kinds = F.array(*[F.struct(F.lit(entity).alias("entity"), n[name].alias("expected")) for entity, name in (
        ("container:space", "spaces"), ("container:folder", "folders"), ("record:task", "tasks"),
        ("record:subtask", "subtasks"))])

    def kinds(column, label):
        return F.transform(F.map_entries(F.coalesce(column, F.create_map().cast("map<string,bigint>"))),
                           lambda e: F.struct(F.concat(F.lit(f"{label}:"), e["key"]).alias("entity"),
                                              e["value"].alias("expected")))

    new_kinds = F.concat(kinds(F.col("container_kinds"), "container"), kinds(F.col("record_kinds"), "record"))
    rows = F.concat(F.array(*totals), F.when(legacy, old_kinds).otherwise(new_kinds))
    return inventory.select("snapshot_id", F.explode(rows).alias("row")).select("snapshot_id", "row.*")


def archived_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(snapshot_id, entity, archived, total) over the neutral entities and the connector's own kinds."""
    def count(table, entity, archived=None, total=None):
        one = F.lit(1)
        return tables[table].groupBy("snapshot_id").agg(
            F.count(archived if archived is not None else one).alias("archived"),
            F.count(total if total is not None else one).alias("total")).withColumn("entity", F.lit(entity))

    def by_kind(table, label):
        return tables[table].groupBy("snapshot_id", F.concat(F.lit(f"{label}:"), "kind").alias("entity")).agg(
            F.count(F.lit(1)).alias("archived"), F.count(F.lit(1)).alias("total"))

    retrieved = F.when(F.col("download_status") == "RETRIEVED", 1)
    parts = [count("containers", "containers"), count("collections", "collections"), count("records", "records"),
             count("records", "nested_records", F.col("parent_record_id"), F.col("parent_record_id")),
             count("comments", "comments"), count("attachments", "attachments", retrieved),
             count("field_definitions", "custom_fields"), count("relationships", "relationships"),
             by_kind("containers", "container"), by_kind("records", "record")]
    return union_all([part.select(*ENTITY, "archived", "total") for part in parts])


def inventory(tables: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """Expected, archived and unresolved per entity. Entities on either side alone are kept with zero."""
    joined = expected.join(archived_counts(tables), ENTITY, "full")
    expected_n, archived_n = F.coalesce("expected", zero()), F.coalesce("archived", zero())
    unresolved = F.when(F.col("entity") == "attachments", expected_n - archived_n).otherwise(zero())
    return joined.select(*ENTITY, expected_n.alias("expected"), archived_n.alias("archived"),
                         unresolved.alias("unresolved"))


def observed_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Counts of the entities the source does not declare in advance."""
    return union_all([
        tables[table].groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
        .select("snapshot_id", F.lit(entity).alias("entity"), "n") for entity, table in OBSERVED_ENTITIES.items()])


def reconcile_kinds(expected: DataFrame, actual: DataFrame, label: str) -> DataFrame:
    """A declared kind that is missing or differs in count, or a kind that was never declared."""
    joined = expected.select("snapshot_id", "kind", F.col("n").alias("want")).join(
        actual.select("snapshot_id", "kind", F.col("n").alias("got")), ["snapshot_id", "kind"], "full")
    return coded(joined, "reconcile_kinds", [
        (F.col("want").isNull() & (F.col("got") > 0), "UNDECLARED_KIND"),
        (F.col("want").isNotNull() & (F.coalesce("got", zero()) != F.col("want")), "COUNT_DIFFERS")],
        label, F.col("kind"), F.concat_ws("/", F.coalesce("want", zero()).cast("string"),
                                          F.coalesce("got", zero()).cast("string")))


PARTIAL_MESSAGE = "at least one endpoint lies outside the archived record set; its source ids are kept"


def discrepancies(attachments: DataFrame, relationships: DataFrame) -> DataFrame:
    """What the archive itself shows to be incomplete: (snapshot_id, kind, source_id, message)."""
    files = attachments.filter(F.col("download_status") != "RETRIEVED").select(
        "snapshot_id", F.lit("ATTACHMENT_UNRESOLVED").alias("kind"), "source_id",
        F.coalesce("error", F.lit("attachment unresolved")).alias("message"))
    links = relationships.filter(F.col("resolution_state") != "RESOLVED").select(
        "snapshot_id", F.concat(F.lit("RELATIONSHIP_"), "resolution_state").alias("kind"), "source_id",
        F.lit(PARTIAL_MESSAGE).alias("message"))
    return files.unionByName(links)


def archive_status(snapshots: DataFrame, attachments: DataFrame, capabilities: DataFrame) -> DataFrame:
    """INCOMPLETE if any attachment is not retrieved or any REQUIRED capability is not AVAILABLE."""
    missing = attachments.groupBy("snapshot_id").agg(
        F.bool_or(F.col("download_status") != "RETRIEVED").alias("missing"))
    unmet = capabilities.filter("id IS NOT NULL").groupBy("snapshot_id").agg(
        F.bool_or((F.col("requirement") == "REQUIRED") & (F.col("availability") != "AVAILABLE")).alias("unmet"))
    return (snapshots.select("snapshot_id").join(missing, "snapshot_id", "left").join(unmet, "snapshot_id", "left")
            .select("snapshot_id", F.when(F.coalesce("missing", F.lit(False)) | F.coalesce("unmet", F.lit(False)),
                                          INCOMPLETE).otherwise(CREATED_UNVERIFIED).alias("archive_status")))


def observe_capability(capabilities: DataFrame, attachments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(capabilities, findings): attachment content is AVAILABLE only if every attachment was retrieved.

    Holding attachments without declaring the capability is a finding; declaring none is fine without attachments.
    """
    held = attachments.groupBy("snapshot_id").agg(
        F.bool_and(F.col("download_status") == "RETRIEVED").alias("all_retrieved"))
    joined = capabilities.join(held, "snapshot_id", "left")
    refined = F.when(F.col("id") == ATTACHMENT_CONTENT, F.when(F.coalesce("all_retrieved", F.lit(True)), "AVAILABLE")
                     .otherwise("FAILED")).otherwise(F.col("availability"))
    declared = capabilities.filter(F.col("id") == ATTACHMENT_CONTENT).select("snapshot_id")
    undeclared = held.join(declared, "snapshot_id", "left_anti")
    return (joined.withColumn("availability", refined).select(*capabilities.columns),
            finding(undeclared, "observe_capability", "CAPABILITY_NOT_DECLARED", ATTACHMENT_CONTENT,
                    F.col("snapshot_id")))


CAPABILITY_DIGEST_COLUMNS = ["id", "name", "requirement", "implementation", "availability", "state", "note"]


def capability_digest(capabilities: DataFrame) -> DataFrame:
    """Digest of the declared capability rows; rows without a stable id have none."""
    return table_digest(capabilities.filter("id IS NOT NULL"), CAPABILITY_DIGEST_COLUMNS)


LOGICAL_DIGEST_COLUMNS = ["type", "id", "parent_type", "parent_id", "composite"]


def logical_digest(index: DataFrame) -> DataFrame:
    """Digest of the source-object index of each snapshot."""
    return table_digest(index, LOGICAL_DIGEST_COLUMNS)


def reconcile_counts(expected: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Precondition of sealing: every neutral total and kind agrees with the extraction."""
    counts = archived_counts(tables)
    totals = expected.filter(F.col("entity").isin(NEUTRAL_COUNTS)).join(
        counts.filter(F.col("entity").isin(NEUTRAL_COUNTS)), ENTITY, "left")
    parts = [coded(totals, "reconcile_counts", [(F.coalesce("total", zero()) != F.col("expected"), "COUNT_DIFFERS")],
                   F.col("entity"), F.col("expected"), F.coalesce("total", zero()))]
    for label in ("container", "record"):
        def kinds(frame, column):
            return frame.filter(F.col("entity").startswith(f"{label}:")).select(
                "snapshot_id", F.substring_index("entity", ":", -1).alias("kind"), F.col(column).alias("n"))
        parts.append(reconcile_kinds(kinds(expected, "expected"), kinds(counts, "total"), label))
    return union_findings(parts)
