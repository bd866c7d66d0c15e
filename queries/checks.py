"""The named verification checks and their parts (F1-F21), and ancestry (D5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.columns import CONTIGUITY, LEDGER, damaged_ledger
from queries.mapping import pid, text
from queries.oracle import pid as sql_pid, s
from queries.registry import coded, findings, query
from queries.seal import COUNTED, OBSERVED, SHOWN, capability_rules
from sealcheck import rules as R
from sealcheck.connectors import clickup, notion
from sealcheck.operators import checks as K, seal as S
from sealcheck.operators.findings import union_findings
from sealcheck.operators.trees import parent_cycles, resolve_ancestor
from sealcheck.schemas import ENTITY_TABLES, PORTABLE_COLUMNS, portable_columns


@query("d05_resolve_ancestor", """ch AS (SELECT o_orderkey, o_custkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev,
  min(o_orderkey) OVER (PARTITION BY o_custkey) AS root, o_custkey % 50 = 0 AS looped FROM orders)
---
SELECT 's1' AS snapshot_id, o_orderkey AS node, CASE WHEN NOT looped AND o_orderkey <> root THEN root END AS ancestor,
  CASE WHEN looped THEN 'CYCLE' WHEN o_orderkey = root THEN 'NO_PARENT' ELSE 'FOUND' END AS outcome FROM ch""")
def ancestors(m):
    """Orders chained per customer; the first order is the accepted root, and of every 50th customer it loops onto itself."""
    nodes = chained_orders(m)
    return resolve_ancestor(nodes, F.col("root"))


def chained_orders(m):
    """Each order's parent is the previous order of the same customer, by a self-join on the running number."""
    from sealcheck.skew import ordered_positions
    numbered = ordered_positions(m.read("orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"])
    previous = numbered.select("o_custkey", (F.col("position") + 1).alias("position"), F.col("o_orderkey").alias("prev"))
    looped = F.col("o_custkey") % 50 == 0
    return numbered.join(previous, ["o_custkey", "position"], "left").select(
        F.lit("s1").alias("snapshot_id"), F.col("o_orderkey").alias("node"),
        F.when(F.col("prev").isNull() & looped, F.col("o_orderkey")).otherwise(F.col("prev")).alias("parent"),
        (F.col("prev").isNull() & ~looped).alias("root"))


@query("f01_archive_structure", findings(
    "archive_structure", ("'FILE_MISSING'", "'file'", "name", "NULL",
                          "(SELECT snapshot_id, name FROM snaps, (VALUES ('manifest.json'), ('schema.json')) v(name)) w WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.snapshot_id = w.snapshot_id AND f.path = w.name)"),
    ("'DIRECTORY_MISSING'", "'file'", "name", "NULL",
     "(SELECT snapshot_id, name FROM snaps, (VALUES ('raw/'), ('attachments/')) v(name)) w WHERE NOT EXISTS (SELECT 1 FROM files f WHERE f.snapshot_id = w.snapshot_id AND starts_with(f.path, w.name))")))
def structure(m):
    return K.archive_structure(m.snapshots, m.files)


@query("f02_manifest_integrity", """head AS (SELECT snapshot_id, CASE WHEN g % 7 = 0 THEN 4 ELSE 3 END AS schema_version, CASE WHEN g % 11 = 0 THEN ' ' ELSE 'tpch' END AS connector,
  CASE g % 3 WHEN 0 THEN 'CREATED_UNVERIFIED' WHEN 1 THEN 'INCOMPLETE' ELSE CASE WHEN g % 5 = 0 THEN 'FAILED' ELSE 'ODD' END END AS status,
  CASE WHEN g % 13 <> 0 THEN 'NOT_RUN' END AS verification_status FROM (SELECT DISTINCT 'p' || (p_partkey // 8) AS snapshot_id, p_partkey // 8 AS g FROM part)),
inv AS (""" + capability_rules("manifest_integrity") + """)
---
""" + coded("manifest_integrity", [("schema_version > 3", "VERSION_UNSUPPORTED"), ("connector = ' '", "CONNECTOR_MISSING"), ("status = 'FAILED'", "STATUS_FAILED"),
                                   ("status = 'ODD'", "STATUS_UNKNOWN"), ("verification_status IS NULL", "VERIFICATION_STATUS_MISSING")],
            "'manifest'", "snapshot_id", "head", "status") + " UNION ALL SELECT * FROM inv UNION ALL " + findings(
    "manifest_integrity", ("'CLEAN_BUT_UNAVAILABLE'", "'capability'", "id", "availability", """capabilities c WHERE requirement = 'REQUIRED' AND availability <> 'AVAILABLE'
      AND snapshot_id IN (SELECT snapshot_id FROM head WHERE status = 'CREATED_UNVERIFIED') AND snapshot_id NOT IN (SELECT snapshot_id FROM inv)""")))
def manifest(m):
    return K.manifest_integrity(group_manifest(m), m.capabilities)


def group_manifest(m):
    g = F.substring("snapshot_id", 2, 20).cast("long")
    status = F.when(g % 3 == 0, "CREATED_UNVERIFIED").when(g % 3 == 1, "INCOMPLETE").otherwise(F.when(g % 5 == 0, "FAILED").otherwise("ODD"))
    return m.capability_snapshots.select(
        "snapshot_id", "capability_schema_version", F.when(g % 7 == 0, 4).otherwise(3).alias("schema_version"),
        F.when(g % 11 == 0, " ").otherwise("tpch").alias("connector"), F.lit("w1").alias("workspace_id"), status.alias("status"),
        F.when(g % 13 != 0, "NOT_RUN").alias("verification_status"))


@query("f03_manifest_file_inventory", """cnt AS (SELECT snapshot_id, path, count(*) AS k FROM manifest_files WHERE path <> 'manifest.json' GROUP BY 1, 2),
safe AS (SELECT * FROM cnt WHERE path NOT LIKE '%..%'), fl AS (SELECT DISTINCT snapshot_id, path FROM files WHERE path <> 'manifest.json')
---
""" + findings("manifest_file_inventory", ("'LISTS_ITSELF'", "'file'", "path", "NULL", "manifest_files WHERE path = 'manifest.json'"),
               ("'LISTED_TWICE'", "'file'", "path", "NULL", "safe WHERE k > 1"), ("'UNSAFE_PATH'", "'file'", "path", "NULL", "cnt WHERE path LIKE '%..%'"),
               ("'LISTED_BUT_MISSING'", "'file'", "path", "NULL", "safe a WHERE NOT EXISTS (SELECT 1 FROM fl b WHERE b.snapshot_id = a.snapshot_id AND b.path = a.path)"),
               ("'NOT_LISTED'", "'file'", "path", "NULL", "fl a WHERE NOT EXISTS (SELECT 1 FROM safe b WHERE b.snapshot_id = a.snapshot_id AND b.path = a.path)")))
def file_inventory(m):
    return K.manifest_file_inventory(m.manifest_files, m.files)


@query("f04_file_checksums", findings(
    "file_checksums", ("CASE WHEN l.bytes <> f.bytes THEN 'SIZE_DIFFERS' ELSE 'CHECKSUM_DIFFERS' END", "'file'", "path", "NULL",
                       "manifest_files l JOIN files f USING (snapshot_id, path) WHERE path <> 'manifest.json' AND (l.bytes <> f.bytes OR l.checksum <> f.checksum)")))
def checksums(m):
    return K.file_checksums(m.manifest_files, m.files)


CONSTRAINT_COLUMNS = {  # columns whose nulls or repeats the damaged tables below can show
    "record_tags": (["record_id", "position"], ["record_id", "name", "position"]),
    "record_field_values": (["record_id", "field_id"], ["record_id", "field_id", "observed_value_json", "semantics_state"])}


def damaged_tables(m):
    """The mapped tables with repeated tags, null values and contradicting attachments in s2, beyond the usual damage."""
    bad = F.col("snapshot_id") == "s2"
    tags = m.record_tags.withColumn("_t", F.explode(F.sequence(F.lit(1), F.when(bad & F.col("record_id").rlike("[05]$"), 2).otherwise(1)))).drop("_t")
    values = m.record_field_values.withColumn("observed_value_json", F.when(~(bad & F.col("record_id").rlike("7$")), F.col("observed_value_json")))
    files = m.attachments.withColumns({
        "download_status": F.when(bad & F.col("id").rlike("3$"), "PENDING").otherwise(F.col("download_status")),
        "error": F.when(bad & F.col("id").rlike("4$"), "left over").otherwise(F.col("error"))})
    return {**m.tables, "record_tags": tags, "record_field_values": values, "attachments": files}


def sql_unique(table: str, columns: list[str], source: str) -> tuple:
    key = " || '/' || ".join(columns)
    return ("'DUPLICATE_KEY'", f"'{table}'", key, f"'{'+'.join(columns)}'",
            f"(SELECT snapshot_id, {', '.join(columns)} FROM {source} GROUP BY ALL HAVING count(*) > 1)")


CONSTRAINED = """tg AS (SELECT r.* FROM record_tags r JOIN snaps USING (snapshot_id), (VALUES (1), (2)) t(times) WHERE times = 1 OR (bad AND regexp_matches(record_id, '[05]$'))),
vl AS (SELECT v.* REPLACE (CASE WHEN NOT (bad AND regexp_matches(record_id, '7$')) THEN observed_value_json END AS observed_value_json) FROM record_field_values v JOIN snaps USING (snapshot_id)),
fl AS (SELECT a.* REPLACE (CASE WHEN bad AND regexp_matches(id, '3$') THEN 'PENDING' ELSE download_status END AS download_status,
  CASE WHEN bad AND regexp_matches(id, '4$') THEN 'left over' ELSE error END AS error) FROM attachments a JOIN snaps USING (snapshot_id))
---
"""
SOURCES = {"record_tags": "tg", "record_field_values": "vl", "attachments": "fl"}


def sql_constraints() -> str:
    parts = []
    for table in ("workspaces", "containers", "collections", "records", "identities", "record_identities", "record_tags", "comments",
                  "field_definitions", "record_field_values", "relationships", "attachments"):
        source = SOURCES.get(table, table)
        keys = [R.PRIMARY_KEYS.get(table, ["id"])] + R.UNIQUE_KEYS.get(table, [])
        keys += [["source_provider", "source_type", "source_id"]] if table in ENTITY_TABLES else []
        parts += [sql_unique(table, columns, source) for columns in keys]
        label = " || '/' || ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in keys[0])
        parts += [(f"'NULL_{c.upper()}'", f"'{table}'", label, "NULL", f"{source} WHERE {c} IS NULL")
                  for c in portable_columns(table) if c not in R.NULLABLE.get(table, [])]
    parts.append(("'STATUS_NOT_ALLOWED'", "'attachments'", "id", "NULL", "fl WHERE download_status NOT IN ('RETRIEVED', 'UNRESOLVED')"))
    parts.append(("'STATUS_CONTRADICTS_COLUMNS'", "'attachments'", "id", "NULL", """fl WHERE (download_status = 'RETRIEVED' AND NOT (local_path IS NOT NULL AND archived_size IS NOT NULL
      AND checksum IS NOT NULL AND error IS NULL)) OR (download_status = 'UNRESOLVED' AND NOT (local_path IS NULL AND archived_size IS NULL AND checksum IS NULL AND error IS NOT NULL))"""))
    return findings("table_constraints", *parts)


@query("f05_table_constraints", CONSTRAINED + sql_constraints())
def constraints(m):
    return K.table_constraints(damaged_tables(m))


def sealed_digests(m, capabilities):
    """(manifest, recomputed): the manifest holds the digests of the index and of the capabilities as they were sealed; of what is
    read again, the index of s2 has lost its last line."""
    last = m.index.filter("type = 'line'").agg(F.max("id").alias("last"))
    damaged = m.index.join(F.broadcast(last), (F.col("snapshot_id") == "s2") & (F.col("type") == "line") & (F.col("id") == F.col("last")), "left_anti")
    kept = S.capability_digest(capabilities).select("snapshot_id", F.col("digest").alias("capability_digest"))

    def of(index):
        return S.logical_digest(index).select("snapshot_id", F.col("digest").alias("logical_digest")).join(kept, "snapshot_id")

    return m.manifest.drop("logical_digest", "capability_digest").join(of(m.index), "snapshot_id"), of(damaged)


@query("f06_raw_evidence_integrity", LEDGER.replace("---\n", "") .rstrip().rstrip(",") + """,
cap AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 's1' ELSE 's2' END AS snapshot_id, 'cap_' || p_partkey AS id, p_name AS name, p_partkey % 2 = 1 AS bad, p_partkey AS k, p_type FROM part),
rw AS (SELECT *, CASE p_type WHEN 'SMALL' THEN 'UNKNOWN' ELSE 'AVAILABLE' END AS availability FROM cap WHERE NOT (bad AND k % 19 = 0)),
sl AS (SELECT snapshot_id, id, CASE WHEN bad AND k % 17 = 0 THEN 'changed' ELSE name END AS name, CASE WHEN bad AND k % 23 = 0 THEN 'FAILED' ELSE 'AVAILABLE' END AS availability FROM cap WHERE NOT (bad AND k % 29 = 0)),
cc AS (SELECT coalesce(rw.snapshot_id, sl.snapshot_id) AS snapshot_id, coalesce(rw.id, sl.id) AS id, rw.id AS r, sl.id AS l, rw.name AS rn, sl.name AS ln, rw.availability AS ra, sl.availability AS la FROM rw FULL JOIN sl ON rw.snapshot_id = sl.snapshot_id AND rw.id = sl.id)
---
""" + findings("raw_evidence_integrity", *CONTIGUITY, ("'RUN_NOT_COMPLETE'", "'evidence'", "snapshot_id", "NULL", "snaps WHERE bad"),
               ("'WORKSPACE_DIFFERS'", "'evidence'", "snapshot_id", "NULL", "snaps WHERE bad"),
               ("'LOGICAL_DIGEST_DIFFERS'", "'evidence'", "snapshot_id", "NULL", "snaps WHERE bad"),
               ("'BYTES_DIFFER'", "'body'", "path", "NULL", "(SELECT * FROM landed, snaps) WHERE bad AND path LIKE 'raw/page/%' AND number % 7 = 0"),
               ("'CAPABILITY_ABSENT'", "'capability'", "id", "NULL", "cc WHERE l IS NULL"), ("'CAPABILITY_ADDED'", "'capability'", "id", "NULL", "cc WHERE r IS NULL"),
               ("'CAPABILITY_CHANGED'", "'capability'", "id", "NULL", "cc WHERE r = l AND rn <> ln"),
               ("'AVAILABILITY_CHANGED'", "'capability'", "id", "NULL", "cc WHERE r = l AND ra <> 'UNKNOWN' AND ra <> la")))
def raw_evidence(m):
    ledger, run = damaged_ledger(m)
    bad = F.col("snapshot_id") == "s2"
    runs = run.withColumns({"status": F.when(bad, "RUNNING").otherwise("COMPLETE"), "connector": F.lit("tpch"),
                            "workspace_id": F.when(bad, "w9").otherwise("w1")})
    broken = m.both(m.landed).filter("bad AND path LIKE 'raw/page/%' AND number % 7 = 0")
    bodies = K.finding(broken, "read_evidence", "BYTES_DIFFER", "body", F.col("path"))
    key = F.col("p_partkey")
    declared = m.read("part").select(
        F.when(key % 2 == 0, "s1").otherwise("s2").alias("snapshot_id"), F.concat(F.lit("cap_"), text("p_partkey")).alias("id"), F.col("p_name").alias("name"),
        F.lit("REQUIRED").alias("requirement"), F.lit("SUPPORTED").alias("implementation"), F.lit("SUPPORTED").alias("state"), F.lit("").alias("note"), "p_type", "p_partkey")
    odd = key % 2 == 1
    raw = declared.filter(~(odd & (key % 19 == 0))).withColumn("availability", F.when(F.col("p_type") == "SMALL", "UNKNOWN").otherwise("AVAILABLE"))
    sealed = declared.filter(~(odd & (key % 29 == 0))).withColumns({
        "name": F.when(odd & (key % 17 == 0), "changed").otherwise(F.col("name")), "availability": F.when(odd & (key % 23 == 0), "FAILED").otherwise("AVAILABLE")})
    manifest, digests = sealed_digests(m, raw)
    return K.raw_evidence_integrity(runs, ledger, bodies, manifest, digests, raw, sealed)


DOCUMENTED = "(SELECT CAST(o_orderkey AS VARCHAR) AS snapshot_id, o_orderkey AS k FROM orders) d"


@query("f07_schema_consistency", findings(
    "schema_consistency", ("'TABLE_MISSING'", "'comments'", "'comments'", "NULL", f"{DOCUMENTED} WHERE k % 5 = 0"),
    ("'COLUMNS_DIFFER'", "'record_tags'", "'record_tags'", "NULL", f"{DOCUMENTED} WHERE k % 7 = 0"), ("'COLUMNS_DIFFER'", "'records'", "'records'", "NULL", f"{DOCUMENTED} WHERE k % 13 = 0"),
    ("'TABLE_NOT_DECLARED'", "'extra' || k % 3", "'extra' || k % 3", "NULL", f"{DOCUMENTED} WHERE k % 11 = 0")))
def schema(m):
    """Each order is a snapshot with a schema document; its key decides which table is gone, cut, reordered or new."""
    key = F.col("o_orderkey")
    orders = m.read("orders").select(text("o_orderkey").alias("snapshot_id"), "o_orderkey")
    names = {table: ["snapshot_id", *portable_columns(table)] for table in PORTABLE_COLUMNS}
    known = F.array(*[F.struct(F.lit(t).alias("table_name"), F.array(*map(F.lit, c)).alias("columns")) for t, c in names.items()])
    known = F.filter(known, lambda t: ~((t["table_name"] == "comments") & (key % 5 == 0)))
    size = F.size("t.columns")
    columns = (F.when((F.col("t.table_name") == "record_tags") & (key % 7 == 0), F.slice("t.columns", 1, size - 1))
               .when((F.col("t.table_name") == "records") & (key % 13 == 0), F.reverse("t.columns")).otherwise(F.col("t.columns")))
    stored = orders.withColumn("t", F.explode(known)).select("snapshot_id", F.col("t.table_name").alias("table_name"), columns.alias("columns"))
    extra = orders.filter(key % 11 == 0).select("snapshot_id", F.concat(F.lit("extra"), (key % 3).cast("string")).alias("table_name"), F.array(F.lit("x")).alias("columns"))
    return K.stored_schema_findings(orders.select("snapshot_id"), stored.union(extra))


OWNED = "(SELECT 'c' || c_custkey AS snapshot_id, c_custkey AS k FROM customer) c"


@query("f08_archive_metadata_consistency", findings(
    "archive_metadata_consistency", ("'VALUE_DIFFERS'", "'archive_metadata'", "'connector'", "NULL", f"{OWNED} WHERE k % 5 = 0"),
    ("'KEY_MISSING'", "'archive_metadata'", "'source_snapshot_logical_digest'", "NULL", f"{OWNED} WHERE k % 7 = 0"),
    ("'VALUE_DIFFERS'", "'archive_metadata'", "'source_snapshot_logical_digest'", "NULL", f"{OWNED} WHERE k % 7 <> 0 AND k % 23 = 0"),
    ("'KEY_MISSING'", "'archive_metadata'", "'verification_status'", "NULL", f"{OWNED} WHERE k % 11 = 0"),
    ("'WORKSPACE_COUNT'", "'workspaces'", "snapshot_id", "NULL", f"{OWNED} WHERE k % 13 = 0 OR k % 19 = 0"),
    ("'WORKSPACE_DIFFERS'", "'workspaces'", "snapshot_id", "NULL", f"{OWNED} WHERE k % 17 = 0 AND k % 13 <> 0 AND k % 19 <> 0")))
def metadata(m):
    """Each customer is a snapshot. The manifest's digest is computed over the customer's orders, the stored one again over
    them or, for some, over all but the first."""
    key = F.col("k")
    orders = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice")))
    owned = m.read("customer").join(m.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(orders.alias("own")), "c_custkey", "left")
    whole = F.sha2(F.concat_ws(",", F.col("c_custkey").cast("string"), F.to_json("own")), 256)
    part = F.sha2(F.concat_ws(",", F.concat(F.lit("-"), text("c_custkey")), F.to_json(F.slice("own", 2, 1_000_000))), 256)
    rows = owned.select(F.concat(F.lit("c"), text("c_custkey")).alias("snapshot_id"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("connector"),
                        F.concat(F.lit("w"), text("c_nationkey")).alias("workspace_id"), whole.alias("logical_digest"), F.when(F.col("c_custkey") % 23 == 0, part).otherwise(whole).alias("again"),
                        F.lit("COMPLETE").alias("status"), F.lit("1").alias("writer_version"), F.lit(3).alias("schema_version"), (F.col("c_acctbal") > 0).alias("atomic"))
    pairs = {"connector": F.when(key % 5 == 0, "other").otherwise(F.col("connector")), "source_workspace_id": F.col("workspace_id"),
             "source_snapshot_logical_digest": F.when(key % 7 != 0, F.col("again")), "archive_status": F.col("status"), "writer_version": F.col("writer_version"),
             "archive_schema_version": F.col("schema_version").cast("string"), "source_snapshot_atomic": F.col("atomic").cast("string"),
             "verification_status": F.when(key % 11 == 0, "").otherwise("NOT_RUN")}
    stored = rows.select("snapshot_id", F.explode(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs.items()])).alias("p")).select("snapshot_id", "p.*")
    copies = F.when(key % 19 == 0, F.array().cast("array<int>")).when(key % 13 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    spaces = rows.select("snapshot_id", F.when(key % 17 == 0, "elsewhere").otherwise(F.col("workspace_id")).alias("source_id"), F.explode(copies))
    return K.archive_metadata_consistency(rows.drop("again", "k"), stored.filter("value IS NOT NULL"), spaces)


DERIVED = "('sc_' || sha256(source_provider || chr(0) || CASE WHEN tbl = 'identities' THEN 'identity' ELSE source_type END || chr(0) || source_id))"


@query("f09_portable_identifier_derivation", findings(
    "portable_identifier_derivation", ("'NOT_DERIVABLE'", "tbl", "id", "NULL", f"all_entities WHERE id IS DISTINCT FROM {DERIVED}"),
    ("'KIND_DIFFERS'", "'containers'", "id", "NULL", "all_entities WHERE tbl = 'containers' AND kind <> source_type")))
def derivation(m):
    return K.portable_identifier_derivation(K.entity_index(m.tables))


ORPHANS = [("'ORPHAN'", f"'{child}.{column}'", f"a.{key}", f"a.{column}", f"{child} a WHERE a.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent} b WHERE b.snapshot_id = a.snapshot_id AND b.id = a.{column})")
           for child, key, column, parent in R.FOREIGN_KEYS]
OWNERSHIP = [("'FOREIGN_WORKSPACE'", f"'{t}'", "id", "workspace_id", f"{t} WHERE workspace_id <> {sql_pid('workspace', chr(39) + 'w1' + chr(39))}")
             for t in R.WORKSPACE_OWNED]
DUPLICATE = ("'DUPLICATE_SOURCE'", "type", "source_id", "NULL", "(SELECT snapshot_id, CASE WHEN tbl = 'records' THEN kind ELSE source_type END AS type, source_id FROM all_entities WHERE tbl <> 'identities' GROUP BY ALL HAVING count(*) > 1)")
# The only loops in the mapping are orders that are their own parent; their lines lead into them.
CYCLES = ("'PARENT_CYCLE'", "'records'", "a.id", "NULL", "records a WHERE a.parent_record_id = a.id OR EXISTS (SELECT 1 FROM records b WHERE b.snapshot_id = a.snapshot_id AND b.id = a.parent_record_id AND b.parent_record_id = b.id)")
EVIDENCE = """rk AS (SELECT snapshot_id, source_id, max(id) AS archived FROM records GROUP BY 1, 2),
rl AS (SELECT r.*, f.archived AS fa, t.archived AS ta FROM relationships r LEFT JOIN rk f ON f.snapshot_id = r.snapshot_id AND f.source_id = r.from_source_id
  LEFT JOIN rk t ON t.snapshot_id = r.snapshot_id AND t.source_id = r.to_source_id)
---
"""
LINK_RULES = [(f"{a} IS NOT NULL AND {c} IS NULL", f"{e}_LEFT_UNRESOLVED") for e, a, c in (("FROM", "fa", "from_record_id"), ("TO", "ta", "to_record_id"))] + \
    [(f"{a} <> {c}", f"{e}_WRONG_TARGET") for e, a, c in (("FROM", "fa", "from_record_id"), ("TO", "ta", "to_record_id"))] + \
    [(f"{a} IS NULL AND {c} IS NOT NULL", f"{e}_RESOLVED_BUT_EXTERNAL") for e, a, c in (("FROM", "fa", "from_record_id"), ("TO", "ta", "to_record_id"))] + \
    [("NOT ((fa IS NULL AND from_record_id IS NULL) OR (ta IS NULL AND to_record_id IS NULL)) AND resolution_state <> 'RESOLVED'", "STATE_UNDERSTATES"),
     ("((fa IS NULL AND from_record_id IS NULL) OR (ta IS NULL AND to_record_id IS NULL)) AND resolution_state = 'RESOLVED'", "STATE_OVERSTATES")]
LINKS = coded("referential_integrity", LINK_RULES, "'relationships'", "id", "rl")


@query("f10_referential_integrity", EVIDENCE + findings("referential_integrity", *ORPHANS, *OWNERSHIP, DUPLICATE, CYCLES) + " UNION ALL " + LINKS)
def referential(m):
    return K.referential_integrity(m.tables)


@query("f11_parent_cycles", """ch AS (SELECT o_orderkey, o_custkey FROM orders)
---
SELECT 's1' AS snapshot_id, o_orderkey AS node FROM ch WHERE o_custkey % 50 = 0""")
def cycles(m):
    return parent_cycles(chained_orders(m))


@query("f12_relationship_evidence", EVIDENCE + LINKS)
def evidence(m):
    return K.relationship_evidence(m.relationships, m.records)


ATTACHED = """st AS (SELECT *, download_status = 'RETRIEVED' AND local_path IS NOT NULL AS claiming FROM attachments),
jd AS (SELECT st.*, f.path IS NOT NULL AS there, f.bytes AS fb, f.checksum AS fs, r.bytes AS rb, r.checksum AS rs, r.path IS NOT NULL AS rec FROM st
  LEFT JOIN files f ON f.snapshot_id = st.snapshot_id AND f.path = st.local_path
  LEFT JOIN (SELECT snapshot_id, path, min(bytes) AS bytes, min(checksum) AS checksum FROM manifest_files GROUP BY 1, 2) r ON r.snapshot_id = st.snapshot_id AND r.path = st.local_path),
mf AS (SELECT st.snapshot_id, st.id, CASE WHEN m.status <> st.download_status THEN 'DIFFERS_STATUS' WHEN m.local_path IS DISTINCT FROM st.local_path THEN 'DIFFERS_LOCAL_PATH'
  WHEN m.checksum IS DISTINCT FROM st.checksum THEN 'DIFFERS_CHECKSUM' WHEN m.archived_size IS DISTINCT FROM st.archived_size THEN 'DIFFERS_ARCHIVED_SIZE' END AS code
  FROM st JOIN manifest_attachments m ON m.snapshot_id = st.snapshot_id AND m.id = st.id)
---
"""
ATTACHMENT_PARTS = [
    ("code", "'attachment'", "id", "NULL", "mf WHERE code IS NOT NULL"),
    ("'UNRESOLVED_ATTACHMENT'", "'attachment'", "id", "NULL", "jd WHERE download_status = 'UNRESOLVED'"),
    ("'FILE_MISSING'", "'attachment'", "id", "NULL", "jd WHERE claiming AND NOT there"),
    ("'FILE_SIZE_DIFFERS'", "'attachment'", "id", "NULL", "jd WHERE claiming AND there AND fb <> archived_size"),
    ("'FILE_CHECKSUM_DIFFERS'", "'attachment'", "id", "NULL", "jd WHERE claiming AND there AND fs <> checksum"),
    ("'EXPECTED_SIZE_DIFFERS'", "'attachment'", "id", "NULL", "jd WHERE claiming AND there AND expected_size <> archived_size"),
    ("'RECORDED_DIFFERENTLY'", "'attachment'", "id", "NULL", "jd WHERE claiming AND there AND rec AND (rb <> archived_size OR rs <> checksum)"),
    ("'FILE_NOT_CLAIMED'", "'file'", "path", "NULL", "files f WHERE path LIKE 'attachments/%' AND NOT EXISTS (SELECT 1 FROM st WHERE st.snapshot_id = f.snapshot_id AND claiming AND st.local_path = f.path)")]


@query("f13_attachment_integrity", ATTACHED + findings("attachment_integrity", *ATTACHMENT_PARTS))
def attachments(m):
    return K.attachment_integrity(m.attachments, m.manifest_attachments, m.manifest_files, m.files)


JUDGED = """jv AS (SELECT v.snapshot_id, v.record_id, v.field_id, v.observed_value_json AS o, v.semantics_state AS st, d.id IS NOT NULL AS known, d.definition_json LIKE '%"id":"1"%' AS two
  FROM record_field_values v LEFT JOIN field_definitions d ON d.snapshot_id = v.snapshot_id AND d.id = v.field_id),
vd AS (SELECT snapshot_id, record_id, field_id, CASE WHEN o = '0' OR (o = '1' AND two) THEN 'VALID' ELSE 'INVALID' END AS verdict FROM jv WHERE known AND st = 'OBSERVED_ONLY' AND o <> '{oops')
---
"""
FIELD_KEY = "record_id || '/' || field_id"
FIELD_PARTS = [
    ("'DEFINITION_NAME_DIFFERS'", "'field_definitions'", "source_id", "NULL", "field_definitions WHERE name = 'renamed'"),
    ("'FIELD_NOT_ARCHIVED'", "'record_field_values'", FIELD_KEY, "NULL", "jv WHERE NOT known"),
    ("'STRONGER_SEMANTICS_CLAIMED'", "'record_field_values'", FIELD_KEY, "NULL", "jv WHERE known AND st <> 'OBSERVED_ONLY'"),
    ("'VALUE_NOT_JSON'", "'record_field_values'", FIELD_KEY, "NULL", "jv WHERE known AND st = 'OBSERVED_ONLY' AND o = '{oops'"),
    ("'VALUE_CONTRADICTS_DEFINITION'", "'record_field_values'", FIELD_KEY, "'OPTION_NOT_DEFINED'", "vd WHERE verdict = 'INVALID'")]


def verdicts(m):
    return clickup.validate_field_values(m.record_field_values, m.field_definitions)


@query("f14_custom_field_evidence", JUDGED + findings("custom_field_evidence", *FIELD_PARTS))
def fields(m):
    return K.custom_field_evidence(m.field_definitions, m.record_field_values, verdicts(m))


@query("f15_discrepancy_reconciliation", f"""sh AS (SELECT DISTINCT snapshot_id, kind, source_id FROM ({SHOWN})), st AS (SELECT DISTINCT snapshot_id, kind, source_id FROM manifest_discrepancies)
---
""" + findings("discrepancy_reconciliation", ("'NOT_DISCLOSED'", "kind", "source_id", "NULL", "(SELECT * FROM sh EXCEPT SELECT * FROM st)"),
               ("'NOT_SUPPORTED'", "kind", "source_id", "NULL", "(SELECT * FROM st EXCEPT SELECT * FROM sh)")))
def discrepancy(m):
    return K.discrepancy_reconciliation(m.attachments, m.relationships, m.manifest_discrepancies)


MATCHED = """mt AS (SELECT coalesce(i.snapshot_id, o.snapshot_id) AS snapshot_id, coalesce(i.type, o.type) AS type, coalesce(i.id, o.id) AS id, i.id IS NOT NULL AS expected, o.id IS NOT NULL AS archived
  FROM (SELECT DISTINCT snapshot_id, type, id FROM source_index) i FULL JOIN objects o ON o.snapshot_id = i.snapshot_id AND o.type = i.type AND o.id = i.id)
---
"""


@query("f16_source_object_reconciliation", MATCHED + coded("source_object_reconciliation", [("NOT archived", "MISSING"), ("NOT expected", "UNEXPECTED")], "type", "id", "mt"))
def objects(m):
    return K.source_object_reconciliation(m.index, K.entity_index(m.tables))


@query("f16_source_object_summary", MATCHED + """SELECT snapshot_id, type, count(*) FILTER (WHERE NOT archived) AS missing, count(*) FILTER (WHERE NOT expected) AS unexpected,
  count(*) FILTER (WHERE archived AND expected) AS matched FROM mt GROUP BY 1, 2""")
def object_summary(m):
    return K.source_object_summary(m.index, K.entity_index(m.tables))


HIERARCHY = f"""ob AS (SELECT * FROM objects), ix AS (SELECT * FROM source_index),
pl AS (SELECT c.snapshot_id, c.type, c.id, c.tbl, c.portable, i.parent_type AS pt, i.parent_id AS pi, p.tbl AS under, p.portable AS above FROM ob c
  JOIN ix i ON i.snapshot_id = c.snapshot_id AND i.type = c.type AND i.id = c.id
  LEFT JOIN ob p ON p.snapshot_id = c.snapshot_id AND p.type = i.parent_type AND p.id = i.parent_id),
ok AS (SELECT * FROM pl WHERE pt IS NULL OR under IS NOT NULL),
rc AS (SELECT k.*, r.parent_record_id AS stored, r.collection_id AS owner, CASE WHEN k.under = 'records' THEN up.above END AS rooted FROM ok k
  JOIN records r ON r.snapshot_id = k.snapshot_id AND r.id = k.portable
  LEFT JOIN pl up ON k.under = 'records' AND up.snapshot_id = k.snapshot_id AND up.type = k.pt AND up.id = k.pi AND up.under = 'collections' WHERE k.tbl = 'records'),
chain AS (SELECT snapshot_id, turn_id, conv_id, bool_or(bad AND dropped) OVER (PARTITION BY snapshot_id, conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut
  FROM turns, snaps),
cm AS (SELECT k.*, c.parent_comment_id AS stored, c.record_id AS owner, CASE WHEN NOT coalesce(ch.cut, FALSE) THEN o.portable END AS rooted FROM ok k
  JOIN comments c ON c.snapshot_id = k.snapshot_id AND c.id = k.portable JOIN chain ch ON ch.snapshot_id = k.snapshot_id AND ch.turn_id = k.id
  LEFT JOIN ob o ON o.snapshot_id = k.snapshot_id AND o.type = 'order' AND o.id = CAST(ch.conv_id AS VARCHAR) WHERE k.tbl = 'comments'),
ct AS (SELECT k.*, c.parent_id AS stored, c.workspace_id AS owner FROM ok k JOIN containers c ON c.snapshot_id = k.snapshot_id AND c.id = k.portable WHERE k.tbl = 'containers'),
cl AS (SELECT k.*, c.container_id AS stored, c.workspace_id AS owner FROM ok k JOIN collections c ON c.snapshot_id = k.snapshot_id AND c.id = k.portable WHERE k.tbl = 'collections'),
fa AS (SELECT k.*, c.record_id AS stored FROM ok k JOIN attachments c ON c.snapshot_id = k.snapshot_id AND c.id = k.portable WHERE k.tbl = 'attachments')
---
"""


def hierarchy_sql() -> str:
    check = "hierarchy_reconstruction"
    def nest(source, own_table, owner_table):
        return coded(check, [(f"under = '{owner_table}' AND stored IS NOT NULL", "NESTED_BUT_DIRECT"), (f"under = '{owner_table}' AND owner IS DISTINCT FROM above", "WRONG_OWNER"),
                             (f"under = '{own_table}' AND stored IS DISTINCT FROM above", "WRONG_PARENT"), (f"under = '{own_table}' AND rooted IS NULL", "NOT_TRACEABLE"),
                             (f"under = '{own_table}' AND rooted <> owner", "OWNER_NOT_SUPPORTED")], "type", "id", source)
    return " UNION ALL ".join([
        findings(check, ("'PARENT_NOT_ARCHIVED'", "type", "id", "NULL", "pl WHERE pt IS NOT NULL AND under IS NULL")),
        coded(check, [("under = 'workspaces' AND stored IS NOT NULL", "NESTED_BUT_DIRECT"), ("under = 'containers' AND stored IS DISTINCT FROM above", "WRONG_PARENT")], "type", "id", "ct"),
        coded(check, [("under = 'containers' AND stored IS DISTINCT FROM above", "WRONG_PARENT")], "type", "id", "cl"),
        nest("rc", "records", "collections"), nest("cm", "comments", "records"),
        coded(check, [("under = 'records' AND stored IS DISTINCT FROM above", "WRONG_OWNER")], "type", "id", "fa")])


@query("f17_hierarchy_reconstruction", HIERARCHY + hierarchy_sql())
def hierarchy(m):
    return K.hierarchy_reconstruction(m.index, m.tables)


@query("f18_raw_evidence_references", """rp AS (SELECT DISTINCT snapshot_id, coalesce(source_raw_path, '') AS path FROM all_entities)
---
""" + findings("raw_evidence_references", ("'EMPTY'", "'file'", "path", "NULL", "rp WHERE path = ''"), ("'OUTSIDE'", "'file'", "path", "NULL", "rp WHERE path <> '' AND NOT starts_with(path, 'raw/')"),
               ("'MISSING'", "'file'", "path", "NULL", "rp a WHERE starts_with(path, 'raw/') AND NOT EXISTS (SELECT 1 FROM files f WHERE f.snapshot_id = a.snapshot_id AND f.path = a.path)")))
def raw_paths(m):
    return K.raw_evidence_references(K.entity_index(m.tables), m.files)


RECONCILED = COUNTED + """,
rcn AS (SELECT e.snapshot_id, e.entity, e.expected, coalesce(c.archived, 0) AS archived, coalesce(c.total, 0) - coalesce(c.archived, 0) AS unresolved, coalesce(c.total, 0) AS total,
  i.entity IS NOT NULL AS claimed, i.expected AS ce, i.archived AS ca, i.unresolved AS cu FROM expected e
  LEFT JOIN counted c ON c.snapshot_id = e.snapshot_id AND c.entity = e.entity LEFT JOIN manifest_inventory i ON i.snapshot_id = e.snapshot_id AND i.entity = e.entity),
rcs AS (SELECT *, CASE WHEN expected <> total OR NOT claimed OR ce <> expected OR ca <> archived OR cu <> unresolved THEN 'FAIL' WHEN archived <> total THEN 'INCOMPLETE' ELSE 'PASS' END AS status FROM rcn),
obd AS (""" + " UNION ALL ".join(f"SELECT snapshot_id, '{e}' AS entity, (SELECT count(*) FROM {t} x WHERE x.snapshot_id = snaps.snapshot_id) AS n FROM snaps" for e, t in OBSERVED.items()) + """),
obs AS (SELECT o.snapshot_id, o.entity, o.n, m.n AS cn FROM obd o LEFT JOIN manifest_observed m ON m.snapshot_id = o.snapshot_id AND m.entity = o.entity)
"""
COUNT_PARTS = coded("count_reconciliation", [("expected <> total", "STORED_DIFFERS"), ("claimed AND ce <> expected", "CLAIMED_EXPECTED_DIFFERS"),
                                             ("claimed AND ca <> archived", "CLAIMED_ARCHIVED_DIFFERS"), ("claimed AND cu <> unresolved", "CLAIMED_UNRESOLVED_DIFFERS")], "'inventory'", "entity", "rcn") + \
    " UNION ALL " + coded("count_reconciliation", [("cn IS NULL", "NOT_CLAIMED"), ("cn <> n", "OBSERVED_DIFFERS")], "'observed'", "entity", "obs")


@query("f19_count_reconciliation", RECONCILED + "---\n" + COUNT_PARTS)
def counts(m):
    reconciled = K.reconciliation(m.expected, m.tables, m.manifest_inventory)
    return K.count_reconciliation(reconciled, m.tables, m.manifest_observed, m.snapshots)


@query("f19_reconciliation", RECONCILED + "---\nSELECT snapshot_id, entity, expected, archived, unresolved, status FROM rcs")
def reconciliation(m):
    return K.reconciliation(m.expected, m.tables, m.manifest_inventory).select("snapshot_id", "entity", "expected", "archived", "unresolved", "status")


LIMITED = """lim AS (SELECT c.* FROM capabilities c)
---
"""
SCOPE_PARTS = findings("source_consistency_scope", ("'UNPROVEN_NOT_ATOMIC'", "'manifest'", "snapshot_id", "NULL", "snaps")) + " UNION ALL " + findings(
    "access_scope_completeness", ("'UNPROVEN_ACCESS_SCOPE'", "'manifest'", "snapshot_id", "extracted_by_id", "manifest"),
    ("'UNPROVEN_ACCOUNT_UNKNOWN'", "'manifest'", "snapshot_id", "NULL", "manifest WHERE extracted_by_id IS NULL"))


@query("f20_scope_and_limitations", SCOPE_PARTS + " UNION ALL " + capability_rules("limitation_preservation") + " UNION ALL " + findings(
    "limitation_preservation", ("'UNPROVEN_NOT_SUPPORTED'", "'capability'", "id", "state || '/' || availability", "capabilities WHERE state IN ('PARTIAL', 'UNSUPPORTED')"),
    ("'UNPROVEN_NOT_AVAILABLE'", "'capability'", "id", "state || '/' || availability", "capabilities WHERE availability <> 'AVAILABLE'")))
def scope(m):
    return union_findings([K.source_consistency_scope(m.manifest, m.archive_metadata), K.access_scope_completeness(m.manifest),
                           K.limitation_preservation(m.capability_snapshots, m.capabilities)])


@query("f21_validate_field_values", JUDGED + "SELECT snapshot_id, record_id, field_id, verdict FROM vd")
def field_verdicts(m):
    return verdicts(m).select("snapshot_id", "record_id", "field_id", "verdict")


@query("f21_validate_property_values", """SELECT 's1' AS snapshot_id, CAST(o_orderkey AS VARCHAR) AS record_id, CASE o_orderkey % 3 WHEN 0 THEN 'select' WHEN 1 THEN 'multi' ELSE 'text' END AS field_id,
  CASE WHEN o_orderkey % 3 = 2 THEN 'UNPROVEN' WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'VALID' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'VALID' ELSE 'INVALID' END AS verdict FROM orders""")
def property_verdicts(m):
    """The second connector's rule: every observed option name is declared by the property."""
    key = F.col("o_orderkey")
    options = '{"options":[{"name":"1-URGENT"},{"name":"2-HIGH"}]}'
    names = m.read("region").agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(
        F.struct(F.lit("select").alias("id"), F.lit("select").alias("field_type"), F.lit('{"select":' + options + "}").alias("definition_json")),
        F.struct(F.lit("multi").alias("id"), F.lit("multi_select").alias("field_type"), F.lit('{"multi_select":' + options + "}").alias("definition_json")),
        F.struct(F.lit("text").alias("id"), F.lit("rich_text").alias("field_type"), F.lit("{}").alias("definition_json")))).alias("d"))
    definitions = names.select(F.lit("s1").alias("snapshot_id"), "d.*")
    name = F.concat(F.lit('{"name":"'), "o_orderpriority", F.lit('"}'))
    observed = (F.when(key % 3 == 0, F.when(key % 2 == 0, '{"select":null}').otherwise(F.concat(F.lit('{"select":'), name, F.lit("}"))))
                .when(key % 3 == 1, F.concat(F.lit('{"multi_select":['), name, F.lit(',{"name":"2-HIGH"}]}'))).otherwise('{"rich_text":[]}'))
    values = m.read("orders").select(F.lit("s1").alias("snapshot_id"), text("o_orderkey").alias("record_id"),
                                     F.when(key % 3 == 0, "select").when(key % 3 == 1, "multi").otherwise("text").alias("field_id"),
                                     observed.alias("observed_value_json"), F.lit("OBSERVED_ONLY").alias("semantics_state"))
    return notion.validate_field_values(values, definitions).select("snapshot_id", "record_id", "field_id", "verdict")
