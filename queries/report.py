"""Folding findings into checks and verdicts (F22-F25), whole verification, and the report (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.checks import sealed_digests
from queries.columns import damaged_ledger
from queries.mapping import text
from queries.registry import ORACLES, query
from sealcheck import connectors
from sealcheck import rules as R
from sealcheck.operators import report as G, verdict as V
from sealcheck.operators.findings import finding
from sealcheck.plans.verify import Sealed, verify


def group_findings(m):
    """Findings per group of customers: one per order, of a kind its priority decides."""
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "BROKEN").when(F.col("o_orderpriority") == "2-HIGH", "UNRESOLVED_ATTACHMENT").otherwise("UNPROVEN_X")
    rows = m.read("orders").withColumn("snapshot_id", F.concat(F.lit("g"), F.expr("o_custkey div 100").cast("string")))
    checks = F.when(F.col("o_orderstatus") == "F", "file_checksums").when(F.col("o_orderstatus") == "O", "attachment_integrity").otherwise("custom_field_evidence")
    return finding(rows.withColumn("c", checks), "x", F.when((F.col("o_orderstatus") == "P") & (code == "BROKEN"), "UNPROVEN_Y").otherwise(code), "order",
                   text("o_orderkey")).join(rows.select(F.col("o_orderkey").cast("string").alias("key"), checks.alias("c")), "key").withColumn("check_name", F.col("c")).drop("c")


FOUND = """fd AS (SELECT 'g' || (o_custkey // 100) AS snapshot_id, CASE o_orderstatus WHEN 'F' THEN 'file_checksums' WHEN 'O' THEN 'attachment_integrity' ELSE 'custom_field_evidence' END AS check_name,
  CASE WHEN o_orderpriority = '1-URGENT' THEN CASE WHEN o_orderstatus = 'P' THEN 'UNPROVEN_Y' ELSE 'BROKEN' END WHEN o_orderpriority = '2-HIGH' THEN 'UNRESOLVED_ATTACHMENT' ELSE 'UNPROVEN_X' END AS code,
  CAST(o_orderkey AS VARCHAR) AS key FROM orders),
lv AS (SELECT *, code || ' order ' || key AS message, CASE WHEN code LIKE 'UNPROVEN%' THEN 1 WHEN code = 'UNRESOLVED_ATTACHMENT' THEN 2 ELSE 3 END AS lvl FROM fd),
wr AS (SELECT *, max(lvl) OVER (PARTITION BY snapshot_id, check_name) AS worst FROM lv),
rk AS (SELECT snapshot_id, check_name, message, row_number() OVER (PARTITION BY snapshot_id, check_name ORDER BY message) AS position, count(*) OVER (PARTITION BY snapshot_id, check_name) AS n FROM wr WHERE lvl = worst)
---
"""


@query("f22_collect_checks", FOUND + """SELECT snapshot_id, check_name, position, message FROM rk WHERE position <= 20
UNION ALL SELECT DISTINCT snapshot_id, check_name, 21, '... and ' || (n - 20) || ' further findings' FROM rk WHERE n > 20""")
def collect(m):
    return V.collect_checks(group_findings(m))


@query("f23_verdict", "SELECT snapshot_id, result FROM verdicts")
def verdicts(m):
    return m.verdicts


def availability(m):
    """Inputs per group of customers, readable or not; some groups lack a row."""
    group = F.concat(F.lit("g"), F.expr("c_custkey div 5").cast("string"))
    names = F.array(F.lit("manifest"), F.lit("database"), F.lit("evidence"))
    return m.read("customer").filter("c_custkey % 5 < 3 AND c_custkey % 11 <> 4").select(
        group.alias("snapshot_id"), F.element_at(names, (F.col("c_custkey") % 5 + 1).cast("int")).alias("input"), (F.col("c_nationkey") % 4 != 0).alias("readable"))


NEEDS = ", ".join(f"('{check}', '{need}')" for check, needs in R.CHECK_INPUTS for need in needs)
GATED = f"""av AS (SELECT 'g' || (c_custkey // 5) AS snapshot_id, CASE c_custkey % 5 WHEN 0 THEN 'manifest' WHEN 1 THEN 'database' ELSE 'evidence' END AS input, c_nationkey % 4 <> 0 AS readable
  FROM customer WHERE c_custkey % 5 < 3 AND c_custkey % 11 <> 4),
gs AS (SELECT DISTINCT 'g' || (c_custkey // 5) AS snapshot_id FROM customer), nd AS (SELECT * FROM (VALUES {NEEDS}) v(check_name, input)),
bl AS (SELECT gs.snapshot_id, nd.check_name, bool_or(NOT coalesce(readable, FALSE)) AS blocked FROM gs CROSS JOIN nd LEFT JOIN av ON av.snapshot_id = gs.snapshot_id AND av.input = nd.input GROUP BY 1, 2),
gt AS (SELECT gs.snapshot_id, n.check_name, n.check_order, NOT coalesce(blocked, FALSE) AS evaluated FROM gs CROSS JOIN check_names n LEFT JOIN bl ON bl.snapshot_id = gs.snapshot_id AND bl.check_name = n.check_name)
"""


def customer_groups(m):
    return m.read("customer").select(F.concat(F.lit("g"), F.expr("c_custkey div 5").cast("string")).alias("snapshot_id")).distinct()


@query("f24_gate", GATED + "---\nSELECT snapshot_id, check_name, check_order, evaluated FROM gt")
def gate(m):
    return V.gate(customer_groups(m), availability(m)).withColumn("check_order", F.col("check_order").cast("long"))


@query("f24_check_results", GATED + "," + FOUND.replace("---\n", "").rstrip().rstrip(",") + """,
ct AS (SELECT snapshot_id, check_name, count(*) AS n, max(lvl) AS lvl FROM lv GROUP BY 1, 2)
---
SELECT gt.snapshot_id, gt.check_name, CASE WHEN NOT evaluated THEN 'NOT_EVALUATED' WHEN lvl = 3 THEN 'FAIL' WHEN lvl = 2 THEN 'INCOMPLETE' WHEN lvl = 1 THEN 'UNPROVEN' ELSE 'PASS' END AS status,
  coalesce(n, 0) AS n_findings FROM gt LEFT JOIN ct ON ct.snapshot_id = gt.snapshot_id AND ct.check_name = gt.check_name""")
def results(m):
    return V.check_results(V.gate(customer_groups(m), availability(m)), group_findings(m)).drop("check_order")


@query("f25_limitations", """cl AS (SELECT c.snapshot_id, c.* EXCLUDE (snapshot_id) FROM capabilities c),
gr AS (SELECT DISTINCT 'p' || (p_partkey // 8) AS snapshot_id FROM part)
---
SELECT snapshot_id, 'integrity is established from archived evidence only; the live source was not read again' AS limitation FROM gr
UNION SELECT snapshot_id, 'sealed by ' || name FROM cl
UNION SELECT snapshot_id, 'capability ' || name || ' remains ' || state || ': ' || note FROM cl WHERE state <> 'SUPPORTED'
UNION SELECT snapshot_id, 'capability ' || name || ' was ' || availability || ' for this archive' FROM cl WHERE availability <> 'AVAILABLE'
UNION SELECT snapshot_id, 'whether the credential could see the whole workspace is not established' FROM gr""")
def limitations(m):
    checks = m.capability_snapshots.select("snapshot_id", F.explode(F.array(
        F.struct(F.lit("access_scope_completeness").alias("check_name"), F.lit("UNPROVEN").alias("status")),
        F.struct(F.lit("file_checksums").alias("check_name"), F.lit("PASS").alias("status")))).alias("c")).select("snapshot_id", "c.*")
    stated = m.capabilities.select("snapshot_id", F.concat(F.lit("sealed by "), "name").alias("limitation"))
    return V.limitations(stated, m.capabilities, checks)


def sealed(m) -> Sealed:
    """Everything a verification of both snapshots reads."""
    bad = F.col("snapshot_id") == "s2"
    declared = connectors.declared_capabilities("clickup", m.snapshots)
    ledger, run = damaged_ledger(m)
    runs = run.withColumns({"status": F.lit("COMPLETE"), "connector": F.lit("tpch"), "workspace_id": F.lit("w1")})
    broken = m.both(m.landed).filter("bad AND path LIKE 'raw/page/%' AND number % 7 = 0")
    manifest, digests = sealed_digests(m, declared)
    stored = m.archive_metadata.join(manifest.select("snapshot_id", "logical_digest"), "snapshot_id").withColumn(
        "value", F.when(F.col("key") == "source_snapshot_logical_digest", F.col("logical_digest")).otherwise(F.col("value"))).drop("logical_digest")
    observed = connectors.observe(declared, [c[0] for c in connectors.clickup.CAPABILITIES])
    readable = m.snapshots.select("snapshot_id", F.explode(F.array(F.lit("manifest"), F.lit("database"), F.lit("evidence"))).alias("input"), F.lit(True).alias("readable"))
    return Sealed("clickup", m.snapshots, {**m.tables, "archive_metadata": stored}, m.index, m.expected, m.files, manifest, m.manifest_files, m.manifest_attachments, m.manifest_inventory,
                  m.manifest_observed, m.manifest_discrepancies, observed, declared, runs, ledger,
                  finding(broken, "read_evidence", "BYTES_DIFFER", "body", F.col("path")), digests, readable)


def parts_of(*names: str) -> str:
    """Codes of other queries' SQL, each in its own scope."""
    return " UNION ALL ".join(f"SELECT snapshot_id, check_name, code FROM ({ORACLES[name]})" for name in names)


WHOLE = """all_codes AS (""" + parts_of("f01_archive_structure", "f03_manifest_file_inventory", "f04_file_checksums", "f09_portable_identifier_derivation",
                                       "f10_referential_integrity", "f13_attachment_integrity", "f14_custom_field_evidence", "f15_discrepancy_reconciliation",
                                       "f16_source_object_reconciliation", "f17_hierarchy_reconstruction", "f18_raw_evidence_references", "f19_count_reconciliation") + """
  UNION ALL SELECT snapshot_id, 'raw_evidence_integrity', code FROM (""" + ORACLES["c09_ledger_contiguity"] + """)
  UNION ALL SELECT snapshot_id, 'table_constraints', 'DUPLICATE_KEY' FROM (SELECT snapshot_id FROM record_field_values GROUP BY snapshot_id, record_id, field_id HAVING count(*) > 1)
  UNION ALL SELECT snapshot_id, 'raw_evidence_integrity', 'BYTES_DIFFER' FROM snaps WHERE bad UNION ALL SELECT snapshot_id, 'raw_evidence_integrity', 'LOGICAL_DIGEST_DIFFERS' FROM snaps WHERE bad
  UNION ALL SELECT snapshot_id, 'archive_metadata_consistency', 'VALUE_DIFFERS' FROM manifest WHERE schema_version <> 3 OR workspace_id <> CASE WHEN bad THEN 'w2' ELSE 'w1' END
  UNION ALL SELECT snapshot_id, 'manifest_integrity', 'VERSION_UNSUPPORTED' FROM snaps WHERE bad UNION ALL SELECT snapshot_id, 'manifest_integrity', 'VERIFICATION_STATUS_MISSING' FROM snaps WHERE bad
  UNION ALL SELECT snapshot_id, c, 'UNPROVEN_X' FROM snaps, (VALUES ('source_consistency_scope'), ('access_scope_completeness'), ('limitation_preservation')) v(c)),
lvl AS (SELECT snapshot_id, check_name, max(CASE WHEN starts_with(code, 'UNPROVEN_') THEN 1 WHEN code = 'UNRESOLVED_ATTACHMENT' THEN 2 ELSE 3 END) AS l FROM all_codes GROUP BY 1, 2)
---
SELECT s.snapshot_id, n.check_name, CASE l WHEN 3 THEN 'FAIL' WHEN 2 THEN 'INCOMPLETE' WHEN 1 THEN 'UNPROVEN' ELSE 'PASS' END AS status
FROM snaps s CROSS JOIN check_names n LEFT JOIN lvl ON lvl.snapshot_id = s.snapshot_id AND lvl.check_name = n.check_name"""


@query("f26_verify", WHOLE)
def whole(m):
    """Status of all twenty checks for both snapshots, in one run."""
    return verify(sealed(m)).checks.select("snapshot_id", "check_name", "status")


# --- report

CLAIM_ROWS = ", ".join(f"({n}, '{claim}', '{check}', {pos})" for n, (claim, _, needed) in enumerate(R.CLAIMS, 1) for pos, check in enumerate(needed))


@query("g01_recovery_claims", f"""cr AS (SELECT * FROM (VALUES {CLAIM_ROWS}) v(claim_order, claim, based_on, pos)),
jn AS (SELECT g.snapshot_id, cr.*, c.status FROM check_groups g CROSS JOIN cr LEFT JOIN checks c ON c.snapshot_id = g.snapshot_id AND c.check_name = cr.based_on)
---
SELECT snapshot_id, claim_order, claim, bool_and(coalesce(status = 'PASS', FALSE)) AS proven, string_agg(CASE WHEN status IS NULL THEN based_on || ' was not run' WHEN status <> 'PASS' THEN based_on || ' is ' || status END, ' and ' ORDER BY pos) AS reason
FROM jn GROUP BY 1, 2, 3""")
def claims(m):
    return G.recovery_claims(m.check_groups, m.checks)


@query("g02_content_statement", """it AS (SELECT snapshot_id, entity, archived || ' ' || replace(entity, '_', ' ') AS part, row_number() OVER (PARTITION BY snapshot_id ORDER BY entity) AS r, count(*) OVER (PARTITION BY snapshot_id) AS n FROM counts),
st AS (SELECT g.snapshot_id, arg_min(based_on || ' is ' || coalesce(status, 'NOT_RUN'), pos) AS reason FROM (SELECT DISTINCT snapshot_id FROM counts) g
  CROSS JOIN (VALUES ('table_constraints', 0), ('count_reconciliation', 1)) b(based_on, pos) LEFT JOIN checks c ON c.snapshot_id = g.snapshot_id AND c.check_name = b.based_on WHERE coalesce(status <> 'PASS', TRUE) GROUP BY 1)
---
SELECT it.snapshot_id, 'The archive holds ' || string_agg(CASE WHEN r = 1 THEN '' WHEN r = n THEN ' and ' ELSE ', ' END || part, '' ORDER BY r) || '.' AS statement, st.snapshot_id IS NULL AS proven, any_value(reason) AS reason
FROM it LEFT JOIN st ON st.snapshot_id = it.snapshot_id GROUP BY it.snapshot_id, st.snapshot_id""")
def content(m):
    return G.content_statement(m.counts, m.checks)


@query("g03_coverage", "SELECT snapshot_id, entity, expected, archived, unresolved, status FROM counts")
def coverage(m):
    return G.coverage(m.counts)


def group_verdicts(m):
    g = F.substring("snapshot_id", 2, 20).cast("long") % 4
    return m.capability_snapshots.select("snapshot_id", F.element_at(F.array(*[F.lit(r) for r in R.RESULTS]), (g + 1).cast("int")).alias("result"))


@query("g04_capability_report", "vr AS (SELECT DISTINCT snapshot_id, CASE CAST(snapshot_id[2:] AS BIGINT) % 4 WHEN 0 THEN 'VERIFIED' WHEN 1 THEN 'VERIFIED_WITH_LIMITATIONS' WHEN 2 THEN 'INCOMPLETE' ELSE 'FAILED' END AS result FROM capabilities)\n---\n"
       "SELECT snapshot_id, id, name, state, CASE state " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in G.MEANING.items()) + f" ELSE '{G.UNRECOGNISED}' END AS meaning, "
       "CASE WHEN availability <> 'AVAILABLE' THEN 'AVAILABILITY_' || availability " + " ".join(f"WHEN state = '{a}' AND result = '{b}' THEN '{v}'" for (a, b), v in G.EVIDENCE.items())
       + " ELSE 'NOT_ARCHIVED' END AS evidence FROM capabilities JOIN vr USING (snapshot_id)")
def capability_report(m):
    return G.capability_report(m.capabilities, group_verdicts(m))


@query("g05_attachment_summary", """SELECT g.snapshot_id, coalesce(c.expected, 0) AS expected, coalesce(c.archived, 0) AS retrieved, coalesce(c.unresolved, 0) AS unresolved, coalesce(k.status, 'NOT_RUN') AS integrity
FROM check_groups g LEFT JOIN counts c ON c.snapshot_id = g.snapshot_id AND c.entity = 'attachments' LEFT JOIN checks k ON k.snapshot_id = g.snapshot_id AND k.check_name = 'attachment_integrity'""")
def attachment_summary(m):
    return G.attachment_summary(m.check_groups, m.counts, m.checks)


@query("g05_unresolved_attachments", "SELECT snapshot_id, source_id, filename, expected_size, coalesce(error, 'no reason recorded') AS reason FROM attachments WHERE download_status <> 'RETRIEVED'")
def unresolved(m):
    return G.unresolved_attachments(m.attachments.withColumnRenamed("download_status", "status"))


@query("g06_report_discrepancies", """bd AS (SELECT * FROM checks WHERE status NOT IN ('PASS', 'UNPROVEN'))
---
SELECT snapshot_id, kind, source_id, message, 'manifest' AS origin FROM manifest_discrepancies
UNION ALL SELECT snapshot_id, upper(check_name), NULL, CASE status WHEN 'INCOMPLETE' THEN 'UNRESOLVED_ATTACHMENT' ELSE 'BROKEN' END || ' part ' || i, 'verification'
  FROM bd, range(1, 41) r(i) WHERE check_order % 2 = 0 AND status IN ('FAIL', 'INCOMPLETE')
UNION ALL SELECT snapshot_id, upper(check_name), NULL, check_name || ' is ' || status, 'verification' FROM bd WHERE NOT (check_order % 2 = 0 AND status IN ('FAIL', 'INCOMPLETE'))""")
def report_discrepancies(m):
    """Twice as many findings as a listing shows, all of which reach the report, and findings of a lesser status, which do not."""
    some = m.checks.filter("check_order % 2 = 0").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(41))))
    code = F.when(F.col("i") == 41, "UNPROVEN_PART").when(F.col("status") == "INCOMPLETE", "UNRESOLVED_ATTACHMENT").otherwise("BROKEN")
    findings = some.select("snapshot_id", "check_name", code.alias("code"), F.lit("part").alias("entity"), text("i").alias("key"), F.lit(None).cast("string").alias("detail"))
    return G.report_discrepancies(m.manifest_discrepancies, m.checks, findings)


RULES = [(10, "ARCHIVE_IS_PROVEN_SOURCE", "coalesce(result NOT IN ('VERIFIED', 'VERIFIED_WITH_LIMITATIONS'), TRUE)"), (20, "POINT_IN_TIME", "g % 3 = 0"), (30, "ANY_CONTENT", "g % 3 = 2"),
         (40, "EXECUTABLE_FIELD_SEMANTICS", "TRUE"), (50, "REPRODUCES_SOURCE_APPLICATION", "TRUE"), (70, "UNRESOLVED_ATTACHMENTS_PRESERVED", "unresolved > 0"),
         (80, "EVERY_LINK_ENDPOINT_ARCHIVED", "g % 5 = 0"), (90, "EVERYTHING_OBSERVED_IS_ARCHIVED", "NOT coalesce(sor = 'PASS', FALSE)"), (100, "SOURCE_TODAY", "TRUE")]


@query("g07_must_not_claim", """fl AS (SELECT v.snapshot_id, CAST(v.snapshot_id[2:] AS BIGINT) AS g, result, coalesce(c.unresolved, 0) AS unresolved, k.status AS sor FROM verdicts v
  LEFT JOIN counts c ON c.snapshot_id = v.snapshot_id AND c.entity = 'attachments' LEFT JOIN checks k ON k.snapshot_id = v.snapshot_id AND k.check_name = 'source_object_reconciliation')
---
""" + " UNION ALL ".join(f"SELECT snapshot_id, '{code}' AS claim, {n} AS position FROM fl WHERE {when}" for n, code, when in RULES) +
       " UNION ALL SELECT DISTINCT 'o' || snapshot_id[2:], 'CAPABILITY ' || id || ' ' || state, 60 FROM capabilities WHERE state <> 'SUPPORTED'")
def must_not_claim(m):
    g = F.substring("snapshot_id", 2, 20).cast("long")
    manifest = m.check_groups.filter(g % 3 != 2).select("snapshot_id", (g % 3 != 0).alias("atomic"))
    items = m.check_groups.filter(g % 5 == 0).select("snapshot_id", F.lit("RELATIONSHIP_PARTIAL_EXTERNAL").alias("kind")).unionByName(
        m.check_groups.select("snapshot_id", F.lit("RELATIONSHIP_RESOLVED").alias("kind")))
    capabilities = m.capabilities.withColumn("snapshot_id", F.concat(F.lit("o"), F.substring("snapshot_id", 2, 20)))
    return G.must_not_claim(m.check_groups, m.verdicts, manifest, capabilities, G.attachment_summary(m.check_groups, m.counts, m.checks), items, m.checks)


@query("g08_conclusion", """oc AS (SELECT snapshot_id, count(*) AS n_checks, count(*) FILTER (WHERE status = 'PASS') AS n_established,
  coalesce(string_agg(CASE WHEN status NOT IN ('PASS', 'UNPROVEN') THEN check_name END, ', ' ORDER BY check_order), '') AS not_established FROM checks GROUP BY 1),
tm AS (SELECT 'o' || (o_orderkey // 20) AS snapshot_id, CAST(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS BIGINT) AS d, o_orderkey // 20 AS g FROM orders GROUP BY 1, 3)
---
SELECT v.snapshot_id, v.result, CASE v.result """ + " ".join(f"WHEN '{k}' THEN '{t}'" for k, t in G.VERDICT_SENTENCE.items()) + """ END AS sentence, n_checks, n_established, not_established,
  coalesce(c.unresolved, 0) AS unresolved, CASE WHEN g % 2 = 0 THEN d ELSE -d END AS lag_seconds, g % 2 = 1 AND d > 0 AS lag_unexplained
FROM verdicts v LEFT JOIN oc ON oc.snapshot_id = v.snapshot_id LEFT JOIN counts c ON c.snapshot_id = v.snapshot_id AND c.entity = 'attachments' LEFT JOIN tm ON tm.snapshot_id = v.snapshot_id""")
def conclusion(m):
    times = m.read("orders").groupBy(F.expr("o_orderkey div 20").alias("g")).agg(
        F.min(F.col("o_orderdate").cast("timestamp")).alias("a"), F.max(F.col("o_orderdate").cast("timestamp")).alias("b"))
    even = F.col("g") % 2 == 0
    manifest = times.select(F.concat(F.lit("o"), F.col("g").cast("string")).alias("snapshot_id"), F.when(even, F.col("b")).otherwise(F.col("a")).alias("archive_completed_at"),
                            F.when(even, F.col("a")).otherwise(F.col("b")).alias("source_snapshot_completed_at"))
    return G.conclusion(m.verdicts, m.checks, G.attachment_summary(m.check_groups, m.counts, m.checks), manifest)
