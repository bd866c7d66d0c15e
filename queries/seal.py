"""Inventory, discrepancies, digests and capabilities (E), and the source index (D1, D2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.mapping import text
from queries.registry import coded, findings, query
from sealcheck.functions.ids import table_digest
from sealcheck.operators import capabilities as C, health as H, normalize as N, seal as S

OBSERVED = {"workspaces": "workspaces", "identities": "identities", "record_identity_roles": "record_identities",
            "record_tags": "record_tags", "record_field_values": "record_field_values"}

COUNTED = "counted AS (" + " UNION ALL ".join(
    f"SELECT snapshot_id, '{entity}' AS entity, {archived} AS archived, {total} AS total FROM {table} GROUP BY 1"
    for entity, table, archived, total in [
        ("containers", "containers", "count(*)", "count(*)"), ("collections", "collections", "count(*)", "count(*)"),
        ("records", "records", "count(*)", "count(*)"), ("nested_records", "records", "count(parent_record_id)", "count(parent_record_id)"),
        ("comments", "comments", "count(*)", "count(*)"),
        ("attachments", "attachments", "count(*) FILTER (WHERE download_status = 'RETRIEVED')", "count(*)"),
        ("custom_fields", "field_definitions", "count(*)", "count(*)"), ("relationships", "relationships", "count(*)", "count(*)")]) + \
    " UNION ALL " + " UNION ALL ".join(f"SELECT snapshot_id, '{label}:' || kind, count(*), count(*) FROM {table} GROUP BY 1, 2"
                                       for label, table in (("container", "containers"), ("record", "records"))) + ")"


@query("a04_inventory_counts", """c AS (SELECT p_partkey, p_partkey % 2 = 0 AS old, p_size AS x, p_partkey % 10 AS y FROM part)
---
SELECT 'p' || p_partkey AS snapshot_id, entity, CAST(v AS BIGINT) AS expected FROM c, LATERAL (SELECT * FROM (VALUES
  ('containers', CASE WHEN old THEN x + y ELSE x END), ('collections', x * 2), ('records', CASE WHEN old THEN x * 3 + y ELSE x * 3 END),
  ('nested_records', CASE WHEN old THEN y ELSE 0 END), ('comments', y), ('attachments', 0), ('custom_fields', 1), ('relationships', 0)) v(entity, v)
  UNION ALL SELECT * FROM (VALUES ('container:space', x), ('container:folder', y), ('record:task', x * 3), ('record:subtask', y)) v(entity, v) WHERE old
  UNION ALL SELECT * FROM (VALUES ('container:board', x), ('record:item', x * 3)) v(entity, v) WHERE NOT old)""")
def inventory_counts(m):
    old, x, y = F.col("p_partkey") % 2 == 0, F.col("p_size").cast("long"), F.col("p_partkey") % 10
    def kinds(name, value):
        return F.when(~old, F.create_map(F.lit(name), value))
    return S.read_inventory_counts(m.read("part").select(
        F.concat(F.lit("p"), text("p_partkey")).alias("snapshot_id"), F.when(old, x).alias("spaces"), F.when(old, y).alias("folders"),
        F.when(old, x * 2).alias("lists"), F.when(old, x * 3).alias("tasks"), F.when(old, y).alias("subtasks"),
        F.when(~old, x).alias("containers"), F.when(~old, x * 2).alias("collections"), F.when(~old, x * 3).alias("records"),
        F.lit(None).cast("long").alias("nested_records"), y.alias("comments"), F.lit(None).cast("long").alias("attachments"),
        F.lit(1).cast("long").alias("custom_fields"), F.lit(None).cast("long").alias("relationships"),
        kinds("board", x).alias("container_kinds"), kinds("item", x * 3).alias("record_kinds")))


@query("d01_build_source_index", "SELECT * FROM source_index")
def source_index(m):
    return m.index


DAMAGED_INDEX = """dmg AS (SELECT snapshot_id, CASE WHEN bad AND type = 'customer' AND TRY_CAST(id AS BIGINT) % 89 = 3 THEN ' ' ELSE id END AS id, type, parent_type,
  CASE WHEN bad AND type = 'document' AND TRY_CAST(id AS BIGINT) % 71 = 0 THEN NULL ELSE parent_id END AS parent_id
  FROM entities JOIN snaps USING (snapshot_id), (VALUES (1), (2)) t(times)
  WHERE NOT coalesce(bad AND type = 'order' AND TRY_CAST(id AS BIGINT) % 83 = 0, FALSE) AND (times = 1 OR (bad AND type = 'nation')))
---
"""


@query("d02_validate_source_index", DAMAGED_INDEX + findings(
    "source_index", ("'EMPTY_IDENTITY'", "type", "id", "NULL", "dmg WHERE trim(id) = ''"),
    ("'HALF_PARENT'", "type", "id", "NULL", "dmg WHERE parent_type IS NOT NULL AND parent_id IS NULL"),
    ("'DUPLICATE_OBJECT'", "type", "id", "k", "(SELECT snapshot_id, type, id, count(*) AS k FROM dmg GROUP BY 1, 2, 3 HAVING count(*) > 1)"),
    ("'PARENT_NOT_INDEXED'", "type", "id", "parent_type || '/' || parent_id", """dmg a WHERE parent_type IS NOT NULL AND parent_id IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM dmg b WHERE b.snapshot_id = a.snapshot_id AND b.type = a.parent_type AND b.id = a.parent_id)""")))
def validate_index(m):
    bad, kind, number = F.col("snapshot_id") == "s2", F.col("type"), F.col("id").try_cast("bigint")
    dropped = F.coalesce(bad & (kind == "order") & (number % 83 == 0), F.lit(False))
    frame = m.entities.filter(~dropped).withColumn("_t", F.explode(F.sequence(F.lit(1), F.when(bad & (kind == "nation"), 2).otherwise(1))))
    lost_parent = F.coalesce(bad & (kind == "document") & (number % 71 == 0), F.lit(False))
    blank = F.coalesce(bad & (kind == "customer") & (number % 89 == 3), F.lit(False))
    return N.validate_source_index(frame.withColumns({
        "parent_id": F.when(~lost_parent, F.col("parent_id")), "id": F.when(blank, " ").otherwise(F.col("id"))}))


@query("e01_inventory", COUNTED + """
---
SELECT coalesce(e.snapshot_id, c.snapshot_id) AS snapshot_id, coalesce(e.entity, c.entity) AS entity, coalesce(expected, 0) AS expected,
  coalesce(archived, 0) AS archived, CASE WHEN coalesce(e.entity, c.entity) = 'attachments' THEN coalesce(expected, 0) - coalesce(archived, 0) ELSE 0 END AS unresolved
FROM expected e FULL JOIN counted c ON c.snapshot_id = e.snapshot_id AND c.entity = e.entity""")
def inventory(m):
    return S.inventory(m.tables, m.expected)


@query("e02_observed_counts", " UNION ALL ".join(f"SELECT snapshot_id, '{e}' AS entity, count(*) AS n FROM {t} GROUP BY 1" for e, t in OBSERVED.items()))
def observed(m):
    return S.observed_counts(m.tables)


@query("e03_reconcile_kinds", """want AS (SELECT o_custkey // 10 AS g, o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2),
got AS (SELECT o_custkey // 10 AS g, o_orderpriority AS kind, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2),
j AS (SELECT CAST(coalesce(want.g, got.g) AS VARCHAR) AS snapshot_id, coalesce(want.kind, got.kind) AS kind, want.n AS w, got.n AS a
  FROM want FULL JOIN got ON want.g = got.g AND want.kind = got.kind)
---
""" + findings("reconcile_kinds", ("'UNDECLARED_KIND'", "'order'", "kind", "coalesce(w, 0) || '/' || coalesce(a, 0)", "j WHERE w IS NULL"),
               ("'COUNT_DIFFERS'", "'order'", "kind", "coalesce(w, 0) || '/' || coalesce(a, 0)", "j WHERE w IS NOT NULL AND w <> coalesce(a, 0)")))
def kinds(m):
    rows = m.read("orders").select(F.expr("CAST(o_custkey div 10 AS STRING)").alias("snapshot_id"), F.col("o_orderpriority").alias("kind"), "o_orderstatus")
    def counted(skip):
        return rows.filter(F.col("o_orderstatus") != skip).groupBy("snapshot_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return S.reconcile_kinds(counted("F"), counted("P"), "order")


SHOWN = """SELECT snapshot_id, 'ATTACHMENT_UNRESOLVED' AS kind, source_id, coalesce(error, 'attachment unresolved') AS message FROM attachments WHERE download_status <> 'RETRIEVED'
UNION ALL SELECT snapshot_id, 'RELATIONSHIP_' || resolution_state, source_id, 'at least one endpoint lies outside the archived record set; its source ids are kept'
FROM relationships WHERE resolution_state <> 'RESOLVED'"""


@query("e04_discrepancies", SHOWN)
def discrepancies(m):
    return S.discrepancies(m.attachments, m.relationships)


@query("e05_archive_status", """grp AS (SELECT DISTINCT snapshot_id FROM capabilities), att AS (SELECT 'p' || (doc_id // 8) AS snapshot_id, bool_or(n_chars > 3000) AS missing FROM documents GROUP BY 1),
unmet AS (SELECT snapshot_id, bool_or(requirement = 'REQUIRED' AND availability <> 'AVAILABLE') AS unmet FROM capabilities GROUP BY 1)
---
SELECT snapshot_id, CASE WHEN coalesce(missing, FALSE) OR coalesce(unmet, FALSE) THEN 'INCOMPLETE' ELSE 'CREATED_UNVERIFIED' END AS archive_status
FROM grp LEFT JOIN att USING (snapshot_id) LEFT JOIN unmet USING (snapshot_id)""")
def status(m):
    return S.archive_status(m.capability_snapshots, group_attachments(m), m.capabilities)


def group_attachments(m):
    """Documents as attachments of the part groups; long ones count as not retrieved."""
    return m.read("documents").select(F.concat(F.lit("p"), F.expr("doc_id div 8").cast("string")).alias("snapshot_id"),
                                      F.when(F.col("n_chars") > 3000, "UNRESOLVED").otherwise("RETRIEVED").alias("download_status"))


@query("e06_observe_capability", """held AS (SELECT 'p' || (doc_id // 8) AS snapshot_id, bool_and(n_chars <= 3000) AS ok FROM documents GROUP BY 1)
---
SELECT snapshot_id, id, name, CASE WHEN id = 'attachment_content' THEN CASE WHEN coalesce(ok, TRUE) THEN 'AVAILABLE' ELSE 'FAILED' END ELSE availability END AS availability, NULL AS code
FROM capabilities LEFT JOIN held USING (snapshot_id)
UNION ALL SELECT snapshot_id, 'attachment_content', NULL, NULL, 'CAPABILITY_NOT_DECLARED' FROM held a
WHERE NOT EXISTS (SELECT 1 FROM capabilities c WHERE c.snapshot_id = a.snapshot_id AND c.id = 'attachment_content')""")
def observe(m):
    refined, undeclared = S.observe_capability(m.capabilities, group_attachments(m))
    none = F.lit(None).cast("string")
    return refined.select("snapshot_id", "id", "name", "availability", none.alias("code")).unionByName(
        undeclared.select("snapshot_id", F.col("entity").alias("id"), none.alias("name"), none.alias("availability"), "code"))


def sql_digest(columns: list[str], source: str, group: str = "snapshot_id") -> str:
    row = " || ".join(f"coalesce('=' || strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in columns)
    # Tables of up to 256 * 4096 rows a group have one level of buckets.
    return f"""SELECT {group}, CAST(sum(n) AS BIGINT) AS n_rows, 'sha256:' || sha256(CAST(sum(n) AS VARCHAR) || ',' || sha256(string_agg(prefix || '=' || node, ',' ORDER BY prefix))) AS digest
      FROM (SELECT {group}, substr(h, 1, 2) AS prefix, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h)) AS node
        FROM (SELECT {group}, h, count(*) AS n FROM (SELECT {group}, sha256({row}) AS h FROM {source}) GROUP BY ALL) GROUP BY ALL) GROUP BY 1"""


@query("e07_table_digest", sql_digest(["id", "kind", "collection_id", "parent_record_id", "title", "status"], "records"))
def digest_of_records(m):
    return table_digest(m.records, ["id", "kind", "collection_id", "parent_record_id", "title", "status"])


@query("e07_logical_digest", sql_digest(["type", "id", "parent_type", "parent_id", "composite"], "source_index"))
def digest_of_index(m):
    return S.logical_digest(m.index)


@query("e08_capability_digest", sql_digest(["id", "name", "requirement", "implementation", "availability", "state", "note"], "capabilities"))
def digest_of_capabilities(m):
    return S.capability_digest(m.capabilities)


def capability_rules(check: str) -> str:
    allowed = "('SUPPORTED', 'PARTIAL', 'UNSUPPORTED', 'UNAVAILABLE', 'UNKNOWN', 'FAILED')"
    return coded(check, [("trim(name) = ''", "NAME_INVALID"), (f"state NOT IN {allowed}", "STATE_UNKNOWN"),
                         ("NOT regexp_full_match(id, '[a-z0-9_]+')", "ID_INVALID"),
                         ("implementation NOT IN ('SUPPORTED', 'PARTIAL', 'UNSUPPORTED', 'UNKNOWN')", "IMPLEMENTATION_UNKNOWN"),
                         ("state <> implementation", "STATE_CONFLICTS"),
                         ("availability NOT IN ('AVAILABLE', 'UNAVAILABLE', 'UNKNOWN', 'FAILED')", "AVAILABILITY_UNKNOWN")],
                 "'capability'", "id", "capabilities") + " UNION ALL " + findings(
        check, ("'DUPLICATE_IDENTITY'", "'capability'", "id", "NULL", "(SELECT snapshot_id, id FROM capabilities GROUP BY 1, 2 HAVING count(*) > 1)"))


@query("e09_validate_capabilities", capability_rules("validate_capabilities"))
def validate(m):
    return C.validate_capabilities(m.capabilities, m.capability_snapshots)


def sql_aggregate(source: str, by: str = "snapshot_id") -> str:
    """SQL of the worst health per group; `source` has id, requirement, state, reason, retryable."""
    return f"""SELECT {by}, CASE worst WHEN 0 THEN 'HEALTHY' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'DEGRADED' ELSE 'UNAVAILABLE' END AS state,
  CASE WHEN worst = 0 THEN 'NONE' ELSE arg_min(reason, id) FILTER (WHERE lvl = worst) END AS reason,
  worst > 0 AND bool_or(retryable AND lvl = worst) AS retryable
FROM (SELECT *, max(lvl) OVER (PARTITION BY {by}) AS worst FROM (SELECT *, CASE WHEN requirement = 'OPTIONAL' AND state = 'UNAVAILABLE' THEN 2
  WHEN state = 'UNAVAILABLE' THEN 3 WHEN state = 'DEGRADED' THEN 2 WHEN state = 'UNKNOWN' THEN 1 ELSE 0 END AS lvl FROM {source})) GROUP BY {by}, worst"""


OBSERVATIONS = """obs AS (SELECT snapshot_id, id || '_' || key AS id, requirement, CASE availability WHEN 'AVAILABLE' THEN 'HEALTHY' WHEN 'FAILED' THEN 'UNAVAILABLE' WHEN 'UNAVAILABLE' THEN 'UNAVAILABLE' ELSE 'UNKNOWN' END AS state,
  CASE availability WHEN 'AVAILABLE' THEN 'NONE' WHEN 'FAILED' THEN 'CAPABILITY_FAILED' WHEN 'UNAVAILABLE' THEN 'CAPABILITY_REMOVED' ELSE 'UNKNOWN_FAILURE' END AS reason,
  availability IN ('FAILED', 'UNAVAILABLE') AS retryable FROM (SELECT *, row_number() OVER (PARTITION BY snapshot_id, id ORDER BY note, name, availability) AS key FROM capabilities))
"""


@query("e10_backup_health", """obs AS (SELECT snapshot_id, min(id) AS id, requirement, CASE availability WHEN 'AVAILABLE' THEN 'HEALTHY' WHEN 'FAILED' THEN 'UNAVAILABLE' WHEN 'UNAVAILABLE' THEN 'UNAVAILABLE' ELSE 'UNKNOWN' END AS state,
  CASE availability WHEN 'AVAILABLE' THEN 'NONE' WHEN 'FAILED' THEN 'CAPABILITY_FAILED' WHEN 'UNAVAILABLE' THEN 'CAPABILITY_REMOVED' ELSE 'UNKNOWN_FAILURE' END AS reason,
  availability IN ('FAILED', 'UNAVAILABLE') AS retryable FROM capabilities WHERE regexp_full_match(id, 'cap_[1-9]|attachment_content') GROUP BY ALL)
---
""" + sql_aggregate("obs"))
def backup_health(m):
    sound = m.capabilities.filter(F.col("id").rlike("^(cap_[1-9]|attachment_content)$"))
    return H.backup_health(sound, sound.select("snapshot_id").distinct())


@query("e11_reconcile_counts", COUNTED + """,
kinds AS (SELECT coalesce(e.snapshot_id, c.snapshot_id) AS snapshot_id, coalesce(e.entity, c.entity) AS entity, expected, total FROM
  (SELECT * FROM expected WHERE entity LIKE '%:%') e FULL JOIN (SELECT * FROM counted WHERE entity LIKE '%:%') c ON c.snapshot_id = e.snapshot_id AND c.entity = e.entity),
totals AS (SELECT e.snapshot_id, e.entity, expected, coalesce(total, 0) AS total FROM expected e LEFT JOIN counted c ON c.snapshot_id = e.snapshot_id AND c.entity = e.entity WHERE e.entity NOT LIKE '%:%')
---
""" + findings("reconcile_counts", ("'COUNT_DIFFERS'", "entity", "expected", "total", "totals WHERE expected <> total")) + " UNION ALL " + findings(
    "reconcile_kinds", ("CASE WHEN expected IS NULL THEN 'UNDECLARED_KIND' ELSE 'COUNT_DIFFERS' END", "split_part(entity, ':', 1)", "split_part(entity, ':', 2)",
                        "coalesce(expected, 0) || '/' || coalesce(total, 0)", "kinds WHERE coalesce(expected, -1) <> coalesce(total, 0)")))
def reconcile_counts(m):
    return S.reconcile_counts(m.expected, m.tables)
