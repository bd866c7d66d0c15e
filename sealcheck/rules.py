"""Closed vocabularies and rule tables of the data model.

These must equal the published vocabulary for results to match, so they are stated plainly as data.
"""

# --- verdicts and check states
VERIFIED, LIMITED, INCOMPLETE, FAILED = "VERIFIED", "VERIFIED_WITH_LIMITATIONS", "INCOMPLETE", "FAILED"
PASS, FAIL, UNPROVEN, NOT_EVALUATED = "PASS", "FAIL", "UNPROVEN", "NOT_EVALUATED"
MAX_FINDINGS = 20

# --- the 20 named checks in run order, with the inputs each one needs
CHECK_INPUTS = [
    ("archive_structure", []),
    ("manifest_integrity", ["manifest"]),
    ("manifest_file_inventory", ["manifest"]),
    ("file_checksums", ["manifest"]),
    ("table_constraints", ["database"]),
    ("raw_evidence_integrity", ["evidence"]),
    ("schema_consistency", ["database"]),
    ("archive_metadata_consistency", ["database", "manifest"]),
    ("portable_identifier_derivation", ["database", "manifest"]),
    ("referential_integrity", ["database", "manifest"]),
    ("attachment_integrity", ["database", "manifest"]),
    ("custom_field_evidence", ["database", "manifest"]),
    ("discrepancy_reconciliation", ["database", "manifest"]),
    ("source_object_reconciliation", ["database", "evidence"]),
    ("hierarchy_reconstruction", ["database", "evidence"]),
    ("raw_evidence_references", ["database", "evidence"]),
    ("count_reconciliation", ["database", "manifest", "evidence"]),
    ("source_consistency_scope", ["manifest"]),
    ("access_scope_completeness", ["manifest"]),
    ("limitation_preservation", ["manifest"]),
]
CHECKS = [name for name, _ in CHECK_INPUTS]

# --- archive members
REQUIRED_FILES = ["manifest.json", "schema.json"]
REQUIRED_PREFIXES = ["raw/", "attachments/"]
MANIFEST_FILE = "manifest.json"

# --- archive states
CREATED_UNVERIFIED = "CREATED_UNVERIFIED"
MAX_ATTACHMENT_BYTES = 1 << 30

# --- foreign keys: (child table, key column naming the row, referencing column, parent table)
FOREIGN_KEYS = [
    ("containers", "id", "parent_id", "containers"),
    ("collections", "id", "container_id", "containers"),
    ("records", "id", "collection_id", "collections"),
    ("records", "id", "parent_record_id", "records"),
    ("record_identities", "record_id", "record_id", "records"),
    ("record_identities", "record_id", "identity_id", "identities"),
    ("record_tags", "record_id", "record_id", "records"),
    ("comments", "id", "record_id", "records"),
    ("comments", "id", "parent_comment_id", "comments"),
    ("comments", "id", "author_identity_id", "identities"),
    ("record_field_values", "record_id", "record_id", "records"),
    ("record_field_values", "record_id", "field_id", "field_definitions"),
    ("relationships", "id", "from_record_id", "records"),
    ("relationships", "id", "to_record_id", "records"),
    ("attachments", "id", "record_id", "records"),
]
WORKSPACE_OWNED = ["containers", "collections", "records", "comments", "attachments"]
PARENT_COLUMNS = [("containers", "parent_id"), ("records", "parent_record_id"), ("comments", "parent_comment_id")]

# --- table constraints
PRIMARY_KEYS = {
    "archive_metadata": ["key"],
    "record_identities": ["record_id", "role", "position"],
    "record_tags": ["record_id", "position"],
    "record_field_values": ["record_id", "field_id"],
}
UNIQUE_KEYS = {"record_identities": [["record_id", "identity_id", "role"]]}
NULLABLE = {
    "workspaces": ["name"], "containers": ["parent_id", "name"], "collections": ["name"],
    "records": ["parent_record_id", "title", "description", "text_content", "status", "status_type", "priority",
                "archived", "date_created_source", "date_updated_source", "date_closed_source", "date_done_source",
                "start_date_source", "due_date_source", "time_estimate_ms", "time_spent_ms", "points"],
    "identities": ["username", "email"],
    "comments": ["parent_comment_id", "author_identity_id", "body_text", "body_json", "date_created_source"],
    "field_definitions": ["name", "field_type"],
    "relationships": ["from_record_id", "to_record_id"],
    "attachments": ["filename", "media_type", "expected_size", "source_url", "local_path", "archived_size",
                    "checksum", "error"],
}

# --- neutral entities counted by the inventory
OBSERVED_ENTITIES = {
    "workspaces": "workspaces", "identities": "identities", "record_identity_roles": "record_identities",
    "record_tags": "record_tags", "record_field_values": "record_field_values",
}

# --- capabilities
ATTACHMENT_CONTENT = "attachment_content"
CAPABILITY_STATES = ["SUPPORTED", "PARTIAL", "UNSUPPORTED", "UNAVAILABLE", "UNKNOWN", "FAILED"]
IMPLEMENTATION_STATES = ["SUPPORTED", "PARTIAL", "UNSUPPORTED", "UNKNOWN"]
REQUIREMENTS = ["REQUIRED", "OPTIONAL"]
AVAILABILITIES = ["AVAILABLE", "UNAVAILABLE", "UNKNOWN", "FAILED"]

# --- health
HEALTH_STATES = ["HEALTHY", "DEGRADED", "UNAVAILABLE", "UNKNOWN"]
HEALTH_SEVERITY = {"HEALTHY": 0, "UNKNOWN": 1, "DEGRADED": 2, "UNAVAILABLE": 3}
HEALTH_BASES = ["AUTHENTICATION", "SCAN", "EXTRACTION", "BACKUP"]
HEALTH_REASONS = ["NONE", "AUTHENTICATION_REQUIRED", "AUTHENTICATION_REJECTED", "RATE_LIMITED",
                  "UPSTREAM_UNAVAILABLE", "NETWORK_FAILURE", "UNSUPPORTED_RESPONSE", "CAPABILITY_REMOVED",
                  "API_BEHAVIOR_CHANGED", "OPERATION_CANCELLED", "CAPABILITY_FAILED", "UNKNOWN_FAILURE"]
AUTHENTICATION_STATES = ["UNKNOWN", "AUTHENTICATED", "REQUIRED", "REJECTED"]

# --- operations
OPERATIONS = ["backup", "scan", "extract", "export", "verify", "report", "auth", "notify"]
STAGES = ["prepare", "authenticate", "scan", "extract", "export", "verify", "report", "finalize", "notify"]
OUTCOMES = ["STARTED", "SUCCEEDED", "FAILED", "SKIPPED"]
RESULTS = [VERIFIED, LIMITED, INCOMPLETE, FAILED]

# --- events: type, allowed metadata, required metadata, allowed outcomes (empty = must carry none)
EVENT_TYPES = [
    ("operation.started", ["schedule_id"], [], ["STARTED"]),
    ("operation.completed", ["archive_path", "report_path", "schedule_id"], [], ["SUCCEEDED"]),
    ("operation.failed", ["reason", "failed_path", "schedule_id"], ["reason"], ["FAILED"]),
    ("operation.skipped", ["reason", "schedule_id"], ["reason"], ["SKIPPED"]),
    ("verification.recorded", ["result", "archive_path", "manifest_checksum", "archive_status", "schedule_id"],
     ["result", "archive_path", "manifest_checksum"], ["SUCCEEDED", "FAILED"]),
    ("connector.unhealthy", ["health_state", "reason", "schedule_id"], ["health_state", "reason"], []),
    ("authentication.problem", ["authentication_state", "reason", "schedule_id"],
     ["authentication_state", "reason"], []),
    ("notification.problem", ["destination_id", "event_type", "reason", "retryable", "idempotency_key",
                              "attempts", "schedule_id"],
     ["destination_id", "event_type", "reason", "idempotency_key"], []),
]
NEVER_NOTIFIED = "notification.problem"
PATH_METADATA = ["archive_path", "report_path", "failed_path"]
MAX_TEXT, MAX_PATH, MAX_OPERATION_ID, MAX_METADATA, MAX_LIMITATIONS = 512, 4096, 64, 8, 32
STALE_SECONDS = 24 * 3600
STATUS_SEVERITY = {"HEALTHY": 0, "UNKNOWN": 1, "ATTENTION": 2, "UNREADABLE": 3}

# --- field values
COMPUTED_FIELD_TYPES = ["formula", "rollup", "calculation", "automatic_progress", "progress_auto"]
COMPUTED_PROPERTY_TYPES = ["formula", "rollup", "created_time", "created_by", "last_edited_time",
                           "last_edited_by", "unique_id"]

# --- names a file system reserves
RESERVED_NAMES = (["CON", "PRN", "AUX", "NUL"] + [f"COM{n}" for n in range(1, 10)]
                  + [f"LPT{n}" for n in range(1, 10)])

# --- recovery claims: (claim, wording, checks it rests on)
CLAIMS = [
    ("tables_readable", "the portable tables satisfy their declared constraints", ["table_constraints"]),
    ("self_describing", "the schema document describes exactly the stored tables", ["schema_consistency"]),
    ("traceable", "every row leads back to its source id and raw response",
     ["portable_identifier_derivation", "raw_evidence_references"]),
    ("raw_intact", "the raw responses are unchanged since capture", ["raw_evidence_integrity"]),
    ("structure", "hierarchy, ownership and links match what was extracted",
     ["hierarchy_reconstruction", "referential_integrity"]),
    ("binaries", "every claimed attachment is present and unchanged", ["attachment_integrity"]),
    ("complete", "nothing observed during extraction was dropped",
     ["count_reconciliation", "source_object_reconciliation"]),
    ("unaltered", "the files are exactly those recorded when sealed",
     ["file_checksums", "manifest_file_inventory"]),
    ("field_values", "observed field values agree with their definitions", ["custom_field_evidence"]),
]
CONTENT_CHECKS = ["table_constraints", "count_reconciliation"]
