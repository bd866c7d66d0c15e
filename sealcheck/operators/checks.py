"""The named verification checks. Each returns finding rows for all snapshots at once.

Rules are data: one generic join or filter per rule list. Joins are on row keys; snapshot_id is part of a key
but never the whole of it, because one snapshot may hold most of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck import rules as R
from sealcheck.functions.ids import DEFAULT_PREFIX, packed, portable_id, unpacked
from sealcheck.functions.jsonfn import raw_string, valid_json, with_members
from sealcheck.functions.text import is_blank
from sealcheck.operators.capabilities import compare_capabilities, validate_capabilities
from sealcheck.operators.findings import coded, finding, first_code, union_all, union_findings
from sealcheck.operators.pages import ledger_contiguity
from sealcheck.operators.seal import archived_counts, discrepancies, observed_counts, zero
from sealcheck.operators.trees import climb, parent_cycles
from sealcheck.session import cut_lineage
from sealcheck.skew import sieve
from sealcheck.schemas import ENTITY_TABLES, MANIFEST_VERSIONS, PORTABLE_COLUMNS, portable_columns

Tables = dict[str, DataFrame]
FALSE = "false"


def _no(column) -> Column:
    return ~F.coalesce(column, F.lit(False))


# --- files and manifest

def archive_structure(snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """Required members are present. `files` has (snapshot_id, path)."""
    check = "archive_structure"
    names = [F.struct(F.lit(name).alias("name"), F.lit(False).alias("prefix")) for name in R.REQUIRED_FILES]
    names += [F.struct(F.lit(name).alias("name"), F.lit(True).alias("prefix")) for name in R.REQUIRED_PREFIXES]
    wanted = snapshots.select("snapshot_id", F.explode(F.array(*names)).alias("m")).select("snapshot_id", "m.*")
    top = F.when(F.col("path").contains("/"), F.concat(F.substring_index("path", "/", 1), F.lit("/"))).otherwise(F.col("path"))
    present = files.select("snapshot_id", top.alias("name")).distinct()
    missing = wanted.join(present, ["snapshot_id", "name"], "left_anti")
    return finding(missing, check, F.when(F.col("prefix"), "DIRECTORY_MISSING").otherwise("FILE_MISSING"), "file", F.col("name"))


def manifest_integrity(manifest: DataFrame, capabilities: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """The manifest header is usable and does not contradict its own capabilities or health."""
    check = "manifest_integrity"
    low, high = MANIFEST_VERSIONS
    header = coded(manifest, check, [
        (_no(F.col("schema_version").between(low, high)), "VERSION_UNSUPPORTED"),
        (is_blank(F.col("connector")), "CONNECTOR_MISSING"), (is_blank(F.col("workspace_id")), "WORKSPACE_MISSING"),
        (F.col("status") == R.FAILED, "STATUS_FAILED"),
        (_no(F.col("status").isin(R.CREATED_UNVERIFIED, R.INCOMPLETE, R.FAILED)), "STATUS_UNKNOWN"),
        (F.coalesce("verification_status", F.lit("")) == "", "VERIFICATION_STATUS_MISSING")],
        "manifest", F.col("snapshot_id"), F.col("status"))
    invalid = validate_capabilities(capabilities, manifest)
    clean = manifest.filter((F.col("status") == R.CREATED_UNVERIFIED) & (F.col("capability_schema_version") == 1))
    sound = clean.select("snapshot_id").join(invalid.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    unmet = capabilities.filter("requirement = 'REQUIRED' AND availability <> 'AVAILABLE'").join(sound, "snapshot_id", "left_semi")
    parts = [header, invalid.withColumn("check_name", F.lit(check)),
             finding(unmet, check, "CLEAN_BUT_UNAVAILABLE", "capability", F.col("id"), F.col("availability"))]
    if health is not None:
        created = manifest.filter(F.col("status") == R.CREATED_UNVERIFIED).select("snapshot_id")
        parts.append(finding(health.filter("state <> 'HEALTHY'").join(created, "snapshot_id", "left_semi"), check,
                             "CLEAN_BUT_UNHEALTHY", "health", F.col("snapshot_id"), F.col("state")))
    return union_findings(parts)


def _unsafe_member() -> Column:
    return F.coalesce((F.col("path") == "") | F.col("path").startswith("/") | F.col("path").contains(".."), F.lit(True))


def manifest_file_inventory(listed: DataFrame, files: DataFrame) -> DataFrame:
    """The manifest lists exactly the files present, once each, under safe paths, and not itself."""
    check, key = "manifest_file_inventory", ["snapshot_id", "path"]
    itself = F.col("path") == R.MANIFEST_FILE
    counted = listed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    others = counted.filter(_no(itself))
    safe = others.filter(~_unsafe_member())
    present = files.filter(~itself).select(*key).distinct().withColumn("present", F.lit(True))
    both = safe.withColumn("listed", F.lit(True)).join(present, key, "full")
    return union_findings([
        finding(listed.filter(itself), check, "LISTS_ITSELF", "file", F.col("path")),
        coded(others, check, [((F.col("n") > 1) & ~_unsafe_member(), "LISTED_TWICE"), (_unsafe_member(), "UNSAFE_PATH")],
              "file", F.col("path")),
        coded(both, check, [(F.col("present").isNull(), "LISTED_BUT_MISSING"), (F.col("listed").isNull(), "NOT_LISTED")],
              "file", F.col("path"))])


def file_checksums(listed: DataFrame, files: DataFrame) -> DataFrame:
    """Size, then checksum, of every listed file that is present. `files` has (path, bytes, checksum)."""
    actual = files.select("snapshot_id", "path", F.col("bytes").alias("got_bytes"), F.col("checksum").alias("got_sum"))
    joined = listed.filter(F.col("path") != R.MANIFEST_FILE).join(actual, ["snapshot_id", "path"])
    code = first_code([(F.col("bytes") != F.col("got_bytes"), "SIZE_DIFFERS"),
                       (_no(F.col("checksum") == F.col("got_sum")), "CHECKSUM_DIFFERS")])
    return finding(joined.withColumn("code", code).filter("code IS NOT NULL"), "file_checksums", F.col("code"), "file",
                   F.col("path"))


# --- tables

def unique_keys(table: str) -> list[list[str]]:
    """Column lists that must be unique in a table, the primary key first."""
    keys = [R.PRIMARY_KEYS.get(table, ["id"])] + R.UNIQUE_KEYS.get(table, [])
    return keys + ([["source_provider", "source_type", "source_id"]] if table in ENTITY_TABLES else [])


def table_constraints(tables: Tables) -> DataFrame:
    """Declared keys, required columns, and the status and nullability rule of attachments.

    The keys of all tables go through one aggregation; as in SQL, a key with a null part is never a repeat. Short hashes of the
    keys are counted first, and only keys whose hash repeats are compared in full.
    """
    check, parts, keyed = "table_constraints", [], []
    for table, frame in tables.items():
        keys = F.array(*[F.struct(F.lit("+".join(columns)).alias("rule"), F.array(*[F.col(c).cast("string") for c in columns]).alias("values"))
                         for columns in unique_keys(table)])
        keyed.append(frame.select("snapshot_id", F.lit(table).alias("table"), F.explode(keys).alias("k")))
        required = [c for c in portable_columns(table) if c not in R.NULLABLE.get(table, [])]
        parts.append(coded(frame, check, [(F.col(c).isNull(), f"NULL_{c.upper()}") for c in required], table,
                           F.concat_ws("/", *unique_keys(table)[0])))
    whole = union_all(keyed).filter(F.forall("k.values", lambda v: v.isNotNull())).withColumn("own", F.xxhash64("snapshot_id", "table", "k"))
    again = cut_lineage(whole.groupBy("own").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    repeated = sieve(whole, "own", again).join(again.select("own"), "own").groupBy("snapshot_id", "table", "k").agg(
        F.count(F.lit(1)).alias("n")).filter("n > 1")
    parts.append(finding(repeated, check, "DUPLICATE_KEY", F.col("table"), F.concat_ws("/", "k.values"), F.col("k.rule")))
    retrieved = (F.col("local_path").isNotNull() & F.col("archived_size").isNotNull() & F.col("checksum").isNotNull()
                 & F.col("error").isNull())
    cleared = (F.col("local_path").isNull() & F.col("archived_size").isNull() & F.col("checksum").isNull()
               & F.col("error").isNotNull())
    status = F.col("download_status")
    parts.append(coded(tables["attachments"], check, [
        (_no(status.isin("RETRIEVED", "UNRESOLVED")), "STATUS_NOT_ALLOWED"),
        ((status == "RETRIEVED") & ~retrieved | (status == "UNRESOLVED") & ~cleared, "STATUS_CONTRADICTS_COLUMNS")],
        "attachments", F.col("id")))
    return union_findings(parts)


def schema_consistency(actual: dict[str, list[str]], declared: dict[str, list[str]] | None = None) -> list[tuple[str, str]]:
    """(code, table) differences between stored and declared columns. Metadata only, nothing is read."""
    declared = declared or {table: ["snapshot_id", *portable_columns(table)] for table in PORTABLE_COLUMNS}
    found = [("TABLE_MISSING", table) for table in declared if table not in actual]
    found += [("COLUMNS_DIFFER", table) for table in declared if table in actual and declared[table] != actual[table]]
    return found + [("TABLE_NOT_DECLARED", table) for table in actual if table not in declared]


def schema_findings(snapshots: DataFrame, differences: list[tuple[str, str]]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(t).alias("t")) for c, t in differences]) if differences else \
        F.array().cast("array<struct<c:string,t:string>>")
    return finding(snapshots.select("snapshot_id", F.explode(rows).alias("d")), "schema_consistency", F.col("d.c"),
                   F.col("d.t"), F.col("d.t"))


def stored_schema_findings(snapshots: DataFrame, stored: DataFrame, declared: dict[str, list[str]] | None = None) -> DataFrame:
    """The schema documents of many snapshots against the declared columns.

    `stored` has (snapshot_id, table_name, columns array<string>), one row per table a snapshot says it holds.
    """
    declared = declared or {table: ["snapshot_id", *portable_columns(table)] for table in PORTABLE_COLUMNS}
    rows = F.array(*[F.struct(F.lit(t).alias("table_name"), F.array(*map(F.lit, c)).alias("wanted")) for t, c in declared.items()])
    wanted = snapshots.select("snapshot_id", F.explode(rows).alias("d")).select("snapshot_id", "d.*")
    compared = wanted.join(stored.select("snapshot_id", "table_name", "columns"), ["snapshot_id", "table_name"], "full")
    return coded(compared, "schema_consistency", [
        (F.col("columns").isNull(), "TABLE_MISSING"), (F.col("wanted").isNull(), "TABLE_NOT_DECLARED"),
        (F.col("columns") != F.col("wanted"), "COLUMNS_DIFFER")], F.col("table_name"), F.col("table_name"))


METADATA = {"connector": "connector", "source_workspace_id": "workspace_id",
            "source_snapshot_logical_digest": "logical_digest", "archive_status": "status",
            "writer_version": "writer_version", "archive_schema_version": "schema_version",
            "source_snapshot_atomic": "atomic"}


def archive_metadata_consistency(manifest: DataFrame, metadata: DataFrame, workspaces: DataFrame) -> DataFrame:
    """What the tables say about themselves equals the manifest; exactly one workspace per snapshot."""
    check = "archive_metadata_consistency"
    implied = manifest.select("snapshot_id", F.explode(F.array(*[
        F.struct(F.lit(key).alias("key"), F.col(column).cast("string").alias("want"))
        for key, column in METADATA.items()])).alias("m")).select("snapshot_id", "m.*")
    stored = metadata.select("snapshot_id", "key", "value", F.lit(True).alias("stored"))
    compared = implied.join(stored, ["snapshot_id", "key"], "left")
    status = manifest.select("snapshot_id", F.lit("verification_status").alias("key")).join(
        stored.filter("value <> ''"), ["snapshot_id", "key"], "left_anti")
    counted = workspaces.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.min("source_id").alias("source_id"))
    judged = manifest.select("snapshot_id", "workspace_id").join(counted, "snapshot_id", "left")
    one = F.coalesce(F.col("n"), zero()) == 1
    return union_findings([
        coded(compared, check, [(F.col("stored").isNull(), "KEY_MISSING"),
                                (F.col("stored") & ~F.col("value").eqNullSafe(F.col("want")), "VALUE_DIFFERS")],
              "archive_metadata", F.col("key")),
        finding(status, check, "KEY_MISSING", "archive_metadata", F.col("key")),
        coded(judged, check, [(~one, "WORKSPACE_COUNT"),
                              (one & ~F.col("source_id").eqNullSafe(F.col("workspace_id")), "WORKSPACE_DIFFERS")],
              "workspaces", F.col("snapshot_id"))])


def entity_index(tables: Tables) -> DataFrame:
    """All entity rows in one shape: (snapshot_id, table, id, kind, source identity, raw path)."""
    parts = []
    for table in ENTITY_TABLES:
        kind = F.col("kind") if table in ("containers", "records") else F.col("source_type")
        parts.append(tables[table].select(
            "snapshot_id", F.lit(table).alias("table"), "id", kind.alias("kind"), "source_provider", "source_type",
            "source_id", "source_raw_path"))
    return union_all(parts)


def portable_identifier_derivation(entities: DataFrame, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Every id is the function of its source identity that it claims to be."""
    check = "portable_identifier_derivation"
    namespace = F.when(F.col("table") == "identities", "identity").otherwise(F.col("source_type"))
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("source_provider", "source_type", "source_id")]
    complete = (parts[0] != "") & (parts[1] != "") & (parts[2] != "")
    return coded(entities, check, [
        (~complete, "INCOMPLETE_SOURCE"),
        (complete & ~F.col("id").eqNullSafe(portable_id("source_provider", namespace, "source_id", prefix)), "NOT_DERIVABLE"),
        ((F.col("table") == "containers") & ~F.col("kind").eqNullSafe(F.col("source_type")), "KIND_DIFFERS")],
        F.col("table"), F.col("id"))


def duplicate_sources(entities: DataFrame) -> DataFrame:
    """Source objects archived twice. Records are told apart by kind, people are not source objects."""
    indexed = entities.filter(F.col("table") != "identities").withColumn(
        "type", F.when(F.col("table") == "records", F.col("kind")).otherwise(F.col("source_type")))
    return indexed.groupBy("snapshot_id", "type", "source_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def references(tables: Tables) -> DataFrame:
    """Every non-null foreign key as (snapshot_id, target, ref, rule, key); each child table is read once for all its rules."""
    rules: dict[str, list] = {}
    for child, key, column, parent in R.FOREIGN_KEYS:
        rules.setdefault(child, []).append(F.struct(
            F.lit(parent).alias("target"), F.col(column).alias("ref"), F.lit(f"{child}.{column}").alias("rule"), F.col(key).alias("key")))
    return union_all([tables[child].select("snapshot_id", F.inline(F.array(*structs))).filter("ref IS NOT NULL") for child, structs in rules.items()])


def orphans(tables: Tables) -> DataFrame:
    """References that resolve to nothing, over all foreign keys.

    Keys and references of all rules go through one aggregate on (snapshot, table, id), as 128 bits of hash and combined before
    the shuffle, so a parent that many rows name costs one short row a task. The ids that are missing are written; only
    rows naming one are looked up, and where few are missing the optimizer's size check broadcasts them.
    """
    identity = ["snapshot_id", "target", "ref"]

    def told(frame: DataFrame) -> DataFrame:
        # The second hash starts elsewhere: one of the same columns would follow from the first.
        return frame.withColumns({"h1": F.xxhash64(*identity), "h2": F.xxhash64(F.lit("2"), *identity)})

    named = told(references(tables))
    parents = union_all([tables[parent].select("snapshot_id", F.lit(parent).alias("target"), F.col("id").alias("ref"))
                         for parent in sorted({rule[3] for rule in R.FOREIGN_KEYS})])
    found = told(parents.filter("ref IS NOT NULL")).select("h1", "h2", F.lit(1).alias("present")).unionByName(
        named.select("h1", "h2", F.lit(0).alias("present")))
    missing = cut_lineage(found.groupBy("h1", "h2").agg(F.max("present").alias("present")).filter("present = 0"))
    lost = sieve(named.filter("snapshot_id IS NOT NULL"), "h1", missing).join(missing.select("h1", "h2"), ["h1", "h2"])
    return finding(lost, "referential_integrity", "ORPHAN", F.col("rule"), F.col("key"), F.col("ref"))


def relationship_evidence(relationships: DataFrame, records: DataFrame) -> DataFrame:
    """The declared resolution of each link is what the archived record set supports."""
    # Ids travel packed. Where packing does not keep their order, they are compared as texts.
    code, unlike = packed("id"), F.col("id").startswith(DEFAULT_PREFIX) & (F.substring(packed("id"), len(DEFAULT_PREFIX) + 1, 1) != F.lit(b"\x00"))
    known = records.groupBy("snapshot_id", "source_id").agg(F.max(F.when(_no(unlike), code)).alias("code"), F.max(F.when(unlike, F.col("id"))).alias("other")).select(
        "snapshot_id", "source_id", packed(F.greatest(unpacked("code"), "other")).alias("archived"))
    joined = relationships.select("snapshot_id", "resolution_state", packed("id").alias("id"), "from_source_id", "to_source_id",
                                  *[packed(f"{end}_record_id").alias(f"{end}_record_id") for end in ("from", "to")])
    for end in ("from", "to"):
        joined = joined.join(known.select("snapshot_id", F.col("source_id").alias(f"{end}_source_id"),
                                          F.col("archived").alias(f"{end}_archived")),
                             ["snapshot_id", f"{end}_source_id"], "left")
    complete = (F.coalesce("from_source_id", F.lit("")) != "") & (F.coalesce("to_source_id", F.lit("")) != "")
    rules, outside = [(~complete, "ENDPOINT_MISSING")], F.lit(False)
    for end in ("from", "to"):
        archived, stored = F.col(f"{end}_archived"), F.col(f"{end}_record_id")
        rules += [(complete & archived.isNotNull() & stored.isNull(), f"{end.upper()}_LEFT_UNRESOLVED"),
                  (complete & (archived != stored), f"{end.upper()}_WRONG_TARGET"),
                  (complete & archived.isNull() & stored.isNotNull(), f"{end.upper()}_RESOLVED_BUT_EXTERNAL")]
        outside = outside | (archived.isNull() & stored.isNull())
    resolved = F.col("resolution_state") == "RESOLVED"
    rules += [(complete & ~outside & _no(resolved), "STATE_UNDERSTATES"), (complete & outside & resolved, "STATE_OVERSTATES")]
    return coded(joined, "referential_integrity", rules, "relationships", unpacked("id"))


def cycle_findings(tables: Tables) -> DataFrame:
    """Nodes on or leading into a parent cycle, over containers, records and comments in one walk."""
    nodes = union_all([tables[t].select("snapshot_id", F.concat_ws("/", F.lit(t), "id").alias("node"),
                                        F.when(F.col(c).isNotNull(), F.concat_ws("/", F.lit(t), c)).alias("parent"))
                       for t, c in R.PARENT_COLUMNS])
    found = parent_cycles(nodes)
    return finding(found, "referential_integrity", "PARENT_CYCLE", F.substring_index("node", "/", 1),
                   F.substring_index("node", "/", -1))


def single_workspace(workspaces: DataFrame) -> DataFrame:
    """The workspace of each snapshot that has exactly one."""
    return workspaces.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("only_workspace")).filter(
        "n = 1").select("snapshot_id", "only_workspace")


def ownership(tables: Tables) -> DataFrame:
    """Rows of a workspace that is not the only one of their snapshot.

    What is joined to the workspaces are the few different workspaces the rows name, not the rows.
    """
    owned = union_all([tables[t].select("snapshot_id", F.lit(t).alias("table"), "id", F.struct("workspace_id").alias("workspace"))
                       for t in R.WORKSPACE_OWNED])
    named = owned.select("snapshot_id", "workspace").distinct()
    # Written, so that its size is known before the rows are: they stay where they are if it is small.
    foreign = cut_lineage(named.join(single_workspace(tables["workspaces"]), "snapshot_id").filter(
        _no(F.col("workspace.workspace_id") == F.col("only_workspace"))).select("snapshot_id", "workspace"))
    return finding(owned.join(foreign, ["snapshot_id", "workspace"], "left_semi"), "referential_integrity", "FOREIGN_WORKSPACE",
                   F.col("table"), F.col("id"), F.col("workspace.workspace_id"))


def referential_integrity(tables: Tables, entities: DataFrame | None = None) -> DataFrame:
    """Orphans, ownership, repeated source keys, cycles and relationship evidence."""
    repeated = duplicate_sources(entities if entities is not None else entity_index(tables))
    return union_findings([
        orphans(tables), ownership(tables),
        finding(repeated, "referential_integrity", "DUPLICATE_SOURCE", F.col("type"), F.col("source_id")),
        cycle_findings(tables), relationship_evidence(tables["relationships"], tables["records"])])


# --- attachments and fields

def attachment_integrity(attachments: DataFrame, manifest_attachments: DataFrame, listed: DataFrame,
                         files: DataFrame) -> DataFrame:
    """Tables, manifest and files agree about every binary.

    Codes that start with UNRESOLVED_ only make the archive incomplete; all others fail it.
    """
    check = "attachment_integrity"
    differs = {"source_id": "SOURCE_ID", "record_id": "RECORD", "status": "STATUS", "local_path": "LOCAL_PATH",
               "checksum": "CHECKSUM", "archived_size": "ARCHIVED_SIZE", "expected_size": "EXPECTED_SIZE"}
    sealed = manifest_attachments.select("snapshot_id", "id", F.lit(True).alias("_sealed"), *[
        F.col(c).alias(f"m_{c}") for c in (*differs, "error")])
    stored = attachments.select("snapshot_id", "id", F.lit(True).alias("_stored"), "source_id", "record_id",
                                F.col("download_status").alias("status"), "local_path", "checksum", "archived_size",
                                "expected_size", "error")
    both = stored.join(sealed, ["snapshot_id", "id"], "full")
    rules = [(~F.col(c).eqNullSafe(F.col(f"m_{c}")), f"DIFFERS_{name}") for c, name in differs.items()]
    rules.append((F.col("error").isNull() != F.col("m_error").isNull(), "DIFFERS_REASON"))
    against = F.when(F.col("_sealed").isNull(), "NOT_IN_MANIFEST").when(F.col("_stored").isNull(), "ONLY_IN_MANIFEST").otherwise(
        first_code(rules))
    manifest_side = finding(both.withColumn("code", against).filter("code IS NOT NULL"), check, F.col("code"), "attachment",
                            F.col("id"))

    status = F.col("status")
    complete = F.col("local_path").isNotNull() & F.col("archived_size").isNotNull() & F.col("checksum").isNotNull()
    outside = ~F.col("local_path").startswith("attachments/") | F.col("local_path").contains("..")
    claiming = (status == "RETRIEVED") & complete & ~outside
    landed = files.select("snapshot_id", F.col("path").alias("local_path"), F.lit(True).alias("_present"),
                          F.col("bytes").alias("f_bytes"), F.col("checksum").alias("f_sum"))
    recorded = listed.groupBy("snapshot_id", F.col("path").alias("local_path")).agg(
        F.min(F.struct("bytes", "checksum")).alias("r"))
    judged = stored.join(landed, ["snapshot_id", "local_path"], "left").join(recorded, ["snapshot_id", "local_path"], "left")
    present = claiming & F.coalesce("_present", F.lit(False))
    file_rules = [
        (_no(status.isin("RETRIEVED", "UNRESOLVED")), "STATUS_UNKNOWN"),
        ((status == "UNRESOLVED") & (F.col("local_path").isNotNull() | F.col("archived_size").isNotNull()
                                     | F.col("checksum").isNotNull()), "UNRETRIEVED_BUT_CLAIMS_FILE"),
        (status == "UNRESOLVED", "UNRESOLVED_ATTACHMENT"),
        ((status == "RETRIEVED") & ~complete, "RETRIEVED_WITHOUT_EVIDENCE"),
        ((status == "RETRIEVED") & complete & outside, "PATH_OUTSIDE"),
        (claiming & F.col("_present").isNull(), "FILE_MISSING"),
        (present & (F.col("f_bytes") != F.col("archived_size")), "FILE_SIZE_DIFFERS"),
        (present & (F.col("f_sum") != F.col("checksum")), "FILE_CHECKSUM_DIFFERS"),
        (present & (F.col("expected_size") != F.col("archived_size")), "EXPECTED_SIZE_DIFFERS"),
        (present & F.col("r").isNotNull() & ~F.col("r").eqNullSafe(
            F.struct(F.col("archived_size").alias("bytes"), F.col("checksum"))), "RECORDED_DIFFERENTLY")]
    claimed = stored.filter(claiming).select("snapshot_id", F.col("local_path").alias("path"))
    unclaimed = files.filter(F.col("path").startswith("attachments/")).join(claimed, ["snapshot_id", "path"], "left_anti")
    return union_findings([
        manifest_side, coded(judged, check, file_rules, "attachment", F.col("id")),
        finding(unclaimed, check, "FILE_NOT_CLAIMED", "file", F.col("path"))])


def definition_findings(definitions: DataFrame) -> DataFrame:
    """The archived definition carries the id, name and type stored beside it."""
    check = "custom_field_evidence"
    checked = definitions.withColumn("_valid", valid_json(F.col("definition_json")))
    parsed, members = with_members(checked, "definition_json", ["id", "name", "type"], "definition")
    is_object = F.col("_valid") & F.ltrim("definition_json").startswith("{")
    rules = [(~is_object, "DEFINITION_INVALID"),
             (is_object & members["id"].absent, "DEFINITION_WITHOUT_ID"),
             (is_object & ~members["id"].absent & _no(raw_string(members["id"]) == F.col("source_id")), "DEFINITION_ID_DIFFERS")]
    for member, column in (("type", "field_type"), ("name", "name")):
        rules.append((is_object & ~raw_string(members[member]).eqNullSafe(F.col(column)), f"DEFINITION_{member.upper()}_DIFFERS"))
    rules += [(_no(F.col("semantics_state").isin("SOURCE_DEFINITION_ONLY", "OBSERVED_ONLY_NO_EXECUTION")), "SEMANTICS_UNKNOWN"),
              (is_object & (F.col("semantics_state") == "OBSERVED_ONLY_NO_EXECUTION"), "UNPROVEN_COMPUTED_FIELD")]
    return coded(parsed, check, rules, "field_definitions", F.col("source_id"))


def custom_field_evidence(definitions: DataFrame, values: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Definitions are consistent and no observed value contradicts its definition.

    `verdicts` has (snapshot_id, record_id, field_id, verdict, reason) for the values a connector could judge.
    Codes that start with UNPROVEN_ are limitations; all others fail the check.
    """
    check = "custom_field_evidence"
    known = definitions.select("snapshot_id", F.col("id").alias("field_id"), F.lit(True).alias("known"))
    judged = values.join(known, ["snapshot_id", "field_id"], "left")
    observed = judged.filter("known AND semantics_state = 'OBSERVED_ONLY'").withColumn(
        "_valid", valid_json(F.col("observed_value_json")))
    key = F.concat_ws("/", "record_id", "field_id")
    broken = coded(judged, check, [
        (F.col("known").isNull(), "FIELD_NOT_ARCHIVED"),
        (F.col("known") & _no(F.col("semantics_state") == "OBSERVED_ONLY"), "STRONGER_SEMANTICS_CLAIMED")],
        "record_field_values", key)
    contradicted = finding(verdicts.filter("verdict = 'INVALID'"), check, "VALUE_CONTRADICTS_DEFINITION", "record_field_values",
                           key, F.col("reason"))
    proven = verdicts.filter("verdict IN ('VALID', 'INVALID')").select("snapshot_id", "record_id", "field_id")
    open_values = observed.filter("_valid").join(proven, ["snapshot_id", "record_id", "field_id"], "left_anti")
    unproven = open_values.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    return union_findings([
        definition_findings(definitions), broken,
        finding(observed.filter("NOT _valid"), check, "VALUE_NOT_JSON", "record_field_values", key), contradicted,
        finding(unproven, check, "UNPROVEN_VALUES", "record_field_values", F.lit("count"), F.col("n"))])


def field_value_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("snapshot_id").agg(
        F.count_if(F.col("verdict") == "VALID").alias("validated"), F.count_if(F.col("verdict") == "INVALID").alias("invalid"),
        F.count_if(F.col("verdict") == "UNPROVEN").alias("unproven"))


# --- reconciliation

def discrepancy_reconciliation(attachments: DataFrame, relationships: DataFrame, declared: DataFrame) -> DataFrame:
    """The manifest discloses exactly what the data shows: nothing invented, nothing hidden."""
    key = ["snapshot_id", "kind", "source_id"]
    shown = discrepancies(attachments, relationships).select(*key).distinct().withColumn("shown", F.lit(True))
    stated = declared.select(*key).distinct().withColumn("stated", F.lit(True))
    return coded(shown.join(stated, key, "full"), "discrepancy_reconciliation", [
        (F.col("stated").isNull(), "NOT_DISCLOSED"), (F.col("shown").isNull(), "NOT_SUPPORTED")],
        F.col("kind"), F.col("source_id"))


def source_objects_of(entities: DataFrame) -> DataFrame:
    """Archived source objects as (snapshot_id, type, id, table, portable); records count under their kind."""
    objects = entities.filter(F.col("table") != "identities")
    kind = F.when(F.col("table") == "records", F.col("kind")).otherwise(F.col("source_type"))
    return objects.groupBy("snapshot_id", kind.alias("type"), F.col("source_id").alias("id")).agg(
        F.min(F.struct("table", F.col("id").alias("portable"))).alias("o")).select(
        "snapshot_id", "type", "id", "o.table", "o.portable")


def match_source_objects(index: DataFrame, entities: DataFrame) -> DataFrame:
    """Expected and archived source objects side by side: (snapshot_id, type, id, expected, archived)."""
    expected = index.select("snapshot_id", "type", "id").distinct().withColumn("expected", F.lit(True))
    archived = source_objects_of(entities).select("snapshot_id", "type", "id").withColumn("archived", F.lit(True))
    joined = expected.join(archived, ["snapshot_id", "type", "id"], "full")
    return joined.withColumns({"expected": F.coalesce("expected", F.lit(False)), "archived": F.coalesce("archived", F.lit(False))})


def source_object_reconciliation(index: DataFrame, entities: DataFrame) -> DataFrame:
    """Expected objects that are missing and archived objects that were never observed."""
    matched = match_source_objects(index, entities)
    return coded(matched, "source_object_reconciliation", [
        (~F.col("archived"), "MISSING"), (~F.col("expected"), "UNEXPECTED")], F.col("type"), F.col("id"))


def source_object_summary(index: DataFrame, entities: DataFrame) -> DataFrame:
    """Missing, unexpected and matched counts per snapshot and type."""
    return match_source_objects(index, entities).groupBy("snapshot_id", "type").agg(
        F.count_if(~F.col("archived")).alias("missing"), F.count_if(~F.col("expected")).alias("unexpected"),
        F.count_if(F.col("archived") & F.col("expected")).alias("matched"))


# Where each table keeps its parent and its owner.
POINTERS = {"workspaces": (None, None), "containers": ("parent_id", "workspace_id"), "collections": ("container_id", "workspace_id"),
            "records": ("parent_record_id", "collection_id"), "comments": ("parent_comment_id", "record_id"),
            "attachments": ("record_id", None), "field_definitions": (None, None), "relationships": (None, None)}


def stored_pointers(tables: Tables) -> DataFrame:
    """Archived source objects with the parent (`stored`) and owner their row points at; ids are packed."""
    def pointer(column):
        return packed(column) if column else F.lit(None).cast("binary")

    rows = union_all([tables[table].select(
        "snapshot_id", (F.col("kind") if table == "records" else F.col("source_type")).alias("type"), F.col("source_id"),
        F.struct(F.lit(table).alias("table"), packed("id").alias("portable"), pointer(parent).alias("stored"), pointer(owner).alias("owner")).alias("o"))
        for table, (parent, owner) in POINTERS.items()])
    return rows.groupBy("snapshot_id", "type", F.col("source_id").alias("id")).agg(F.min("o").alias("o")).select("snapshot_id", "type", "id", "o.*")


# Nested tables and the table their rows are owned by.
OWNERS = {"records": "collections", "comments": "records"}


def rooted_rows(placed: DataFrame) -> DataFrame:
    """(snapshot_id, table, portable, rooted): the owner that nested rows lead to, in one walk over archived objects.

    A row directly under an owner starts out settled, so owners are no nodes of the walk and both tables share it.
    """
    nested = placed.filter(F.col("table").isin(*OWNERS))
    owner_table = F.element_at(F.create_map(*[F.lit(name) for pair in OWNERS.items() for name in pair]), F.col("table"))
    rows = nested.groupBy("snapshot_id", "table", "portable").agg(F.min(F.struct("above", F.col("under") == F.col("table"), F.col("under") == owner_table)).alias("p"))
    rows = rows.select(F.struct("snapshot_id", "table", "portable").alias("id"), "table", F.col("p.above").alias("above"),
                       F.coalesce(F.col("p.col2"), F.lit(False)).alias("inside"), F.coalesce(F.col("p.col3"), F.lit(False)).alias("owned"))
    walk = climb(rows.select(
        "id", F.when(F.col("inside"), F.struct("id.snapshot_id", "table", F.col("above").alias("portable"))).alias("jump"),
        F.when(F.col("owned"), F.col("above")).alias("ancestor"),
        F.when(F.col("owned"), "FOUND").when(~F.col("inside"), "NO_PARENT").alias("outcome")))
    return walk.filter("outcome = 'FOUND'").select("id.*", F.col("ancestor").alias("rooted"))


def hierarchy_reconstruction(index: DataFrame, tables: Tables) -> DataFrame:
    """Stored parent pointers reproduce the source index, nested rows by ancestry.

    Objects that are not archived are left to source_object_reconciliation.
    """
    named = index.withColumn("declares", F.coalesce("parent_type", F.lit("")) != "").select(
        "snapshot_id", "type", "id", "parent_type", "parent_id", "declares")
    # Each join is written by itself, so that what it has shuffled goes before the next, and objects are gathered once.
    objects = cut_lineage(stored_pointers(tables).join(named, ["snapshot_id", "type", "id"], "left"))
    parents = objects.groupBy("snapshot_id", F.col("type").alias("parent_type"), F.col("id").alias("parent_id")).agg(
        F.first(F.struct("table", "portable")).alias("p")).select(
        "snapshot_id", "parent_type", "parent_id", F.col("p.table").alias("under"), F.col("p.portable").alias("above"))
    # Read by the walk and by the rules.
    placed = cut_lineage(objects.join(parents, ["snapshot_id", "parent_type", "parent_id"], "left").select(
        "snapshot_id", "type", "id", "table", "portable", "stored", "owner", "declares", "under", "above"))
    # Only rows inside a row of their own table depend on the walk.
    inside = F.col("table").isin(*OWNERS) & F.col("under").eqNullSafe(F.col("table"))
    walked = placed.filter(inside).join(rooted_rows(placed), ["snapshot_id", "table", "portable"], "left")
    only = single_workspace(tables["workspaces"]).withColumn("only_workspace", packed("only_workspace"))
    collections = placed.filter("table = 'collections'").join(only, "snapshot_id", "left")
    rest = placed.filter(~inside & (F.col("table") != "collections"))
    rows = rest.unionByName(walked, allowMissingColumns=True).unionByName(collections, allowMissingColumns=True)

    indexed = F.col("declares").isNotNull() & (~F.col("declares") | F.col("under").isNotNull())
    top, above, under, own, stored = F.col("under").isNull(), F.col("above"), F.coalesce("under", F.lit("")), F.col("owner"), F.col("stored")

    def rules(table: str, *broken: tuple[Column, str]) -> list:
        return [(indexed & (F.col("table") == table) & condition, code) for condition, code in broken]

    def nesting(table: str) -> list:
        owner_table = OWNERS[table]
        return rules(
            table, (top, "NO_RECORDED_PARENT"), ((under == owner_table) & stored.isNotNull(), "NESTED_BUT_DIRECT"),
            ((under == owner_table) & _no(own == above), "WRONG_OWNER"), ((under == table) & _no(stored == above), "WRONG_PARENT"),
            ((under == table) & F.col("rooted").isNull(), "NOT_TRACEABLE"), ((under == table) & (F.col("rooted") != own), "OWNER_NOT_SUPPORTED"),
            (~top & ~under.isin(table, owner_table), "UNSUPPORTED_PARENT"))

    return coded(rows, "hierarchy_reconstruction", [
        (F.col("declares") & top, "PARENT_NOT_ARCHIVED"),
        *rules("workspaces", (~top, "WORKSPACE_HAS_PARENT")),
        *rules("containers", (top & stored.isNotNull(), "UNRECORDED_PARENT"), ((under == "workspaces") & stored.isNotNull(), "NESTED_BUT_DIRECT"),
               ((under == "workspaces") & _no(own == above), "WRONG_OWNER"), ((under == "containers") & _no(stored == above), "WRONG_PARENT"),
               (~top & ~under.isin("workspaces", "containers"), "UNSUPPORTED_PARENT")),
        *rules("collections", (under != "containers", "NOT_IN_CONTAINER"), ((under == "containers") & _no(stored == above), "WRONG_PARENT"),
               (own != F.col("only_workspace"), "WRONG_OWNER")),
        *nesting("records"), *nesting("comments"),
        *rules("attachments", (under != "records", "NOT_ON_RECORD"), ((under == "records") & _no(stored == above), "WRONG_OWNER"))],
        F.col("type"), F.col("id"))


def raw_evidence_references(entities: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct raw paths that are empty, point outside the raw evidence, or do not exist."""
    paths = entities.groupBy("snapshot_id", F.coalesce("source_raw_path", F.lit("")).alias("path")).agg(
        F.count(F.lit(1)).alias("n"))
    present = files.select("snapshot_id", "path").distinct().withColumn("present", F.lit(True))
    empty = F.col("path") == ""
    outside = ~F.col("path").startswith("raw/") | F.col("path").contains("..")
    judged = paths.join(present, ["snapshot_id", "path"], "left")
    return coded(judged, "raw_evidence_references", [
        (empty, "EMPTY"), (~empty & outside, "OUTSIDE"), (~empty & ~outside & F.col("present").isNull(), "MISSING")],
        "file", F.col("path"))


def reconciliation(expected: DataFrame, tables: Tables, manifest_inventory: DataFrame) -> DataFrame:
    """Expected, stored and claimed counts per entity the extraction or the neutral model names.

    Status: FAIL when any two disagree, INCOMPLETE when all is represented but not all retrieved, else PASS.
    """
    key = ["snapshot_id", "entity"]
    counts = archived_counts(tables).select(*key, "archived", "total")
    claimed = manifest_inventory.select(*key, F.lit(True).alias("claimed"), F.col("expected").alias("c_expected"),
                                        F.col("archived").alias("c_archived"), F.col("unresolved").alias("c_unresolved"))
    joined = expected.join(counts, key, "left").join(claimed, key, "left")
    archived, total = F.coalesce("archived", zero()), F.coalesce("total", zero())
    disagrees = ((F.col("expected") != total) | F.col("claimed").isNull() | _no(F.col("c_expected") == F.col("expected"))
                 | _no(F.col("c_archived") == archived) | _no(F.col("c_unresolved") == total - archived))
    return joined.select(*key, "expected", archived.alias("archived"), (total - archived).alias("unresolved"),
                         total.alias("total"), "claimed", "c_expected", "c_archived", "c_unresolved",
                         F.when(disagrees, R.FAIL).when(archived != total, R.INCOMPLETE).otherwise(R.PASS).alias("status"))


def count_reconciliation(reconciled: DataFrame, tables: Tables, manifest_observed: DataFrame, snapshots: DataFrame) -> DataFrame:
    check, key = "count_reconciliation", ["snapshot_id", "entity"]
    stated = F.col("claimed")
    rules = [(F.col("expected") != F.col("total"), "STORED_DIFFERS"), (stated.isNull(), "NOT_CLAIMED"),
             (stated & (F.col("c_expected") != F.col("expected")), "CLAIMED_EXPECTED_DIFFERS"),
             (stated & (F.col("c_archived") != F.col("archived")), "CLAIMED_ARCHIVED_DIFFERS"),
             (stated & (F.col("c_unresolved") != F.col("unresolved")), "CLAIMED_UNRESOLVED_DIFFERS")]
    names = F.explode(F.array(*[F.lit(name) for name in R.OBSERVED_ENTITIES]))
    observed = (snapshots.select("snapshot_id", names.alias("entity"))
                .join(observed_counts(tables), key, "left")
                .join(manifest_observed.select(*key, F.col("n").alias("c_n")), key, "left"))
    return union_findings([
        coded(reconciled, check, rules, "inventory", F.col("entity")),
        coded(observed, check, [(F.col("c_n").isNull(), "NOT_CLAIMED"),
                                (F.col("c_n") != F.coalesce("n", zero()), "OBSERVED_DIFFERS")], "observed", F.col("entity"))])


# --- raw evidence, scope and limitations

def raw_evidence_integrity(runs: DataFrame, ledger: DataFrame, evidence_findings: DataFrame, manifest: DataFrame,
                           digests: DataFrame, raw_capabilities: DataFrame, sealed_capabilities: DataFrame) -> DataFrame:
    """Bodies, ledger, digests, identity and capability contract of the raw evidence agree with the manifest.

    `runs` has the run record (status, connector, workspace_id and the request summary), `digests` the recomputed
    logical_digest and capability_digest per snapshot.
    """
    check = "raw_evidence_integrity"
    recomputed = digests.select("snapshot_id", F.col("logical_digest").alias("got_logical"),
                                F.col("capability_digest").alias("got_capability"))
    header = (manifest.select("snapshot_id", "connector", "workspace_id", "logical_digest", "capability_digest",
                              "capability_schema_version")
              .join(runs.select("snapshot_id", F.col("status").alias("run_status"), F.col("connector").alias("run_connector"),
                                F.col("workspace_id").alias("run_workspace")), "snapshot_id", "left")
              .join(recomputed, "snapshot_id", "left"))
    rules = [(_no(F.col("run_status") == "COMPLETE"), "RUN_NOT_COMPLETE"),
             (_no(F.col("run_connector") == F.col("connector")), "CONNECTOR_DIFFERS"),
             (_no(F.col("run_workspace") == F.col("workspace_id")), "WORKSPACE_DIFFERS"),
             (~F.col("got_logical").eqNullSafe(F.col("logical_digest")), "LOGICAL_DIGEST_DIFFERS"),
             (~F.col("got_capability").eqNullSafe(F.col("capability_digest")), "CAPABILITY_DIGEST_DIFFERS")]
    def renamed(frame):
        return frame.withColumn("check_name", F.lit(check))

    return union_findings([
        coded(header, check, rules, "evidence", F.col("snapshot_id")), renamed(evidence_findings),
        renamed(ledger_contiguity(ledger, runs)), compare_capabilities(raw_capabilities, sealed_capabilities)])


def source_consistency_scope(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """Point-in-time consistency cannot be claimed for a non-atomic extraction."""
    recorded = metadata.filter("key = 'source_snapshot_atomic' AND value <> ''").select("snapshot_id", "value")
    joined = manifest.join(recorded, "snapshot_id", "left")
    disagrees = F.col("value") != F.col("atomic").cast("string")
    return coded(joined, "source_consistency_scope", [
        (disagrees, "ATOMICITY_DISPUTED"), (_no(disagrees) & _no(F.col("atomic")), "UNPROVEN_NOT_ATOMIC")],
        "manifest", F.col("snapshot_id"))


def access_scope_completeness(manifest: DataFrame) -> DataFrame:
    """Whether the credential could see everything is never provable from the archive."""
    unnamed = is_blank(F.col("extracted_by_id"))
    return coded(manifest, "access_scope_completeness", [
        (F.lit(True), "UNPROVEN_ACCESS_SCOPE"), (unnamed, "UNPROVEN_ACCOUNT_UNKNOWN")], "manifest", F.col("snapshot_id"),
        F.when(~unnamed, F.col("extracted_by_id")))


def limitation_preservation(manifest: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Source limitations stay exactly as the connector reported them."""
    check = "limitation_preservation"
    invalid = validate_capabilities(capabilities, manifest)
    silent = manifest.join(capabilities.select("snapshot_id").distinct(), "snapshot_id", "left_anti")
    versioned = capabilities.join(manifest.select("snapshot_id", "capability_schema_version"), "snapshot_id")
    label = F.coalesce("id", "name")
    return union_findings([
        invalid.withColumn("check_name", F.lit(check)),
        finding(silent, check, "NO_CAPABILITIES", "capability", F.col("snapshot_id")),
        coded(versioned, check, [
            (F.col("state").isin([s for s in R.CAPABILITY_STATES if s != "SUPPORTED"]), "UNPROVEN_NOT_SUPPORTED"),
            ((F.col("capability_schema_version") == 1) & _no(F.col("availability") == "AVAILABLE"), "UNPROVEN_NOT_AVAILABLE")],
            "capability", label, F.concat_ws("/", "state", "availability"))])
