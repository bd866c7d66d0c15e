"""Declared schemas. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, B, D, TS = (T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType(),
                     T.DoubleType(), T.TimestampType())


def struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


SOURCE_TAIL = ["source_provider", "source_type", "source_id", "source_raw_path", "source_id_composite"]

# Own columns of the 13 portable tables, in order; entity tables end with SOURCE_TAIL.
PORTABLE_COLUMNS = {
    "archive_metadata": ["key", "value"],
    "workspaces": ["id", "name"],
    "containers": ["id", "kind", "workspace_id", "parent_id", "name"],
    "collections": ["id", "workspace_id", "container_id", "name"],
    "records": ["id", "kind", "workspace_id", "collection_id", "parent_record_id", "title", "description",
                "text_content", "status", "status_type", "priority", "archived", "date_created_source",
                "date_updated_source", "date_closed_source", "date_done_source", "start_date_source",
                "due_date_source", "time_estimate_ms", "time_spent_ms", "points"],
    "identities": ["id", "username", "email"],
    "record_identities": ["record_id", "identity_id", "role", "position"],
    "record_tags": ["record_id", "name", "position"],
    "comments": ["id", "workspace_id", "record_id", "parent_comment_id", "author_identity_id", "body_text",
                 "body_json", "date_created_source"],
    "field_definitions": ["id", "name", "field_type", "semantics_state", "definition_json"],
    "record_field_values": ["record_id", "field_id", "observed_value_json", "semantics_state"],
    "relationships": ["id", "kind", "from_record_id", "to_record_id", "from_source_id", "to_source_id",
                      "resolution_state", "source_metadata_json"],
    "attachments": ["id", "workspace_id", "record_id", "filename", "media_type", "expected_size", "source_url",
                    "download_status", "local_path", "archived_size", "checksum", "error"],
}

LINK_TABLES = ("archive_metadata", "record_identities", "record_tags", "record_field_values")
ENTITY_TABLES = tuple(name for name in PORTABLE_COLUMNS if name not in LINK_TABLES)

_TYPED = {"archived": B, "source_id_composite": B, "position": L, "time_estimate_ms": L, "time_spent_ms": L,
          "expected_size": L, "archived_size": L, "points": D}


def portable_columns(table: str) -> list[str]:
    """Declared columns of one portable table, without snapshot_id."""
    return PORTABLE_COLUMNS[table] + (SOURCE_TAIL if table in ENTITY_TABLES else [])


def portable_schema(table: str) -> T.StructType:
    names = ["snapshot_id"] + portable_columns(table)
    return T.StructType([T.StructField(name, _TYPED.get(name, S)) for name in names])


# Stable write order of each portable table.
PORTABLE_ORDER = {
    "archive_metadata": ["key"],
    "record_identities": ["record_id", "role", "position"],
    "record_tags": ["record_id", "position"],
    "record_field_values": ["record_id", "field_id"],
}

LEDGER = struct(sequence=L, operation=S, method=S, path=S, query=S, attempt=I, status_code=I, outcome=S,
                retrying=B, raw_path=S, bytes=L, sha256=S, error=S)

CAPABILITY = struct(id=S, name=S, requirement=S, implementation=S, availability=S, state=S, note=S)

SOURCE_OBJECT = struct(type=S, id=S, parent_type=S, parent_id=S, composite=B)

NEUTRAL_COUNTS = ["containers", "collections", "records", "nested_records", "comments", "attachments",
                  "custom_fields", "relationships"]
LEGACY_COUNTS = ["spaces", "folders", "lists", "tasks", "subtasks"]

COUNTS = T.StructType(
    [T.StructField(name, L) for name in dict.fromkeys(NEUTRAL_COUNTS + LEGACY_COUNTS)]
    + [T.StructField("container_kinds", T.MapType(S, L)), T.StructField("record_kinds", T.MapType(S, L))])

INVENTORY = struct(schema_version=I, kind=S, connector=S, workspace_id=S, counts=COUNTS,
                   capability_schema_version=I, capabilities=T.ArrayType(CAPABILITY), capability_digest=S,
                   source_objects=T.ArrayType(SOURCE_OBJECT), logical_digest=S)

RUN = struct(schema_version=I, kind=S, status=S, connector=S, source=struct(workspace_id=S, workspace_name=S),
             started_at=TS, finished_at=TS, extracted_by=struct(id=S, name=S),
             requests=struct(attempts=L, successful_responses=L, failed_attempts=L, retried_attempts=L),
             source_consistency=struct(atomic=B, note=S), logical_inventory_digest=S, capability_digest=S,
             failure=S)

EVENT_SOURCE = struct(connector=S, workspace_id=S, destination=S)
EVENT = struct(schema_version=I, type=S, operation_id=S, sequence=I, recorded_at=TS, source=EVENT_SOURCE,
               operation=S, stage=S, outcome=S, message=S, metadata=T.MapType(S, S))

FINDING_COLUMNS = ["snapshot_id", "check_name", "code", "entity", "key", "detail"]
FINDING = T.StructType([T.StructField(name, S) for name in FINDING_COLUMNS])

# Readable versions; anything newer is refused, never guessed at.
SNAPSHOT_VERSIONS = (1, 2)
MANIFEST_VERSIONS = (2, 3)
EVENT_VERSIONS = (1, 2)
STATE_VERSIONS = (1, 3)
