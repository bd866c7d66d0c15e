"""The mapping of `mapping.py` stated in SQL, and a helper that puts the needed parts in front of a query."""

from __future__ import annotations

import re

from sealcheck.rules import CHECKS

PREFIX = "sc_"


def pid(namespace: str, identifier: str) -> str:
    """SQL of a portable id; `namespace` is a literal, `identifier` an expression."""
    return f"('{PREFIX}' || sha256('tpch' || chr(0) || '{namespace}' || chr(0) || {identifier}))"


def digest(expression: str) -> str:
    return f"('sha256:' || sha256({expression}))"


def s(expression: str) -> str:
    return f"CAST({expression} AS VARCHAR)"


WS = pid("workspace", "'w1'")


def tail(kind: str, identifier: str, path: str, composite: str = "FALSE") -> str:
    return (f"'tpch' AS source_provider, '{kind}' AS source_type, {identifier} AS source_id, {path} AS source_raw_path, "
            f"{composite} AS source_id_composite")


def n(table: str, entities: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{e}' AS entity, count(*) AS expected FROM {table}" for e in entities)


def raw(table: str, key: str, folder: str, size: int) -> str:
    return (f"SELECT 'raw/{folder}/' || ({key} // {size}) || '.json', strlen({s('count(*)')}), {digest(s('count(*)'))}, "
            f"({key} // {size})::BIGINT FROM {table} GROUP BY {key} // {size}")


ORDER_ID, LINE_ID, TURN_ID = pid("order", s("o_orderkey")), pid("line", "line_id"), pid("turn", "turn_id")

ATTACHMENTS = """SELECT snapshot_id, {id} AS id, {ws} AS workspace_id, {rec} AS record_id, 'doc-' || doc_id || '.' || lang AS filename,
  'text/plain' AS media_type, n_chars AS expected_size, NULL::VARCHAR AS source_url,
  CASE WHEN {bad} AND doc_id % 17 = 0 THEN 'UNRESOLVED' ELSE 'RETRIEVED' END AS download_status,
  CASE WHEN NOT ({bad} AND doc_id % 17 = 0) THEN 'attachments/' || doc_id || '.txt' END AS local_path,
  CASE WHEN NOT ({bad} AND doc_id % 17 = 0) THEN strlen(text) END AS archived_size,
  CASE WHEN {bad} AND doc_id % 17 = 0 THEN NULL WHEN {bad} AND doc_id % 13 = 0 THEN 'sha256:' || repeat('0', 64) ELSE {sum} END AS checksum,
  CASE WHEN {bad} AND doc_id % 17 = 0 THEN 'download failed' END AS error, {tail}
  FROM documents, snaps"""


def attachments(bad: str) -> str:
    return ATTACHMENTS.format(id=pid("document", s("doc_id")), ws=WS, rec=pid("order", s("doc_id")), bad=bad, sum=digest("text"),
                              tail=tail("document", s("doc_id"), "'raw/document/' || (doc_id // 10) || '.json'"))


def node(table: str, kind: str, identifier: str, parent_type: str = "NULL", parent_id: str = "NULL") -> str:
    return (f"SELECT snapshot_id, '{kind}' AS type, {s(identifier)} AS id, {s(parent_type)} AS parent_type, {s(parent_id)} AS parent_id, "
            f"FALSE AS composite FROM {table}, snaps")


CTES = {
    "snaps": "SELECT * FROM (VALUES ('s1', FALSE), ('s2', TRUE)) v(snapshot_id, bad)",
    "workspaces": f"SELECT snapshot_id, {WS} AS id, 'tpch' AS name, {tail('workspace', chr(39) + 'w1' + chr(39), chr(39) + 'raw/inventory.json' + chr(39))} FROM snaps",
    "containers": f"""SELECT snapshot_id, {pid('region', s('r_regionkey'))} AS id, 'region' AS kind, {WS} AS workspace_id, NULL::VARCHAR AS parent_id,
      r_name AS name, {tail('region', s('r_regionkey'), "'raw/region.json'")} FROM region, snaps
    UNION ALL SELECT snapshot_id, {pid('nation', s('n_nationkey'))}, 'nation', {WS}, {pid('region', s('n_regionkey'))}, n_name,
      {tail('nation', s('n_nationkey'), "'raw/nation.json'")} FROM nation, snaps WHERE NOT (bad AND n_nationkey % 7 = 0)""",
    "collections": f"""SELECT snapshot_id, {pid('customer', s('c_custkey'))} AS id, {WS} AS workspace_id,
      {pid('nation', s('CASE WHEN bad AND c_custkey % 101 = 0 THEN (c_nationkey + 1) % 25 ELSE c_nationkey END'))} AS container_id, c_name AS name,
      {tail('customer', s('c_custkey'), "'raw/customer/' || (c_custkey // 100) || '.json'")} FROM customer, snaps""",
    "lines": "SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, l_orderkey || '-' || l_linenumber AS line_id FROM lineitem GROUP BY 1, 2",
    "records": f"""SELECT snapshot_id, CASE WHEN bad AND o_orderkey % 401 = 0 THEN 'bad_' || o_orderkey ELSE {ORDER_ID} END AS id, 'order' AS kind,
      {WS} AS workspace_id,
      {pid('customer', s('CASE WHEN bad AND o_orderkey % 101 = 0 THEN o_custkey + 1 - 2 * (o_custkey % 2) ELSE o_custkey END'))} AS collection_id,
      CASE WHEN bad AND o_orderkey % 499 = 0 THEN {ORDER_ID} END AS parent_record_id, 'Order ' || o_orderkey AS title, o_orderstatus AS status,
      o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m-%d') AS date_created_source,
      {tail('order', s('o_orderkey'), "'raw/order/' || (o_orderkey // 100) || '.json'")}
    FROM orders, snaps WHERE NOT (bad AND o_orderkey % 211 = 0)
    UNION ALL SELECT snapshot_id, {LINE_ID}, 'line', {WS}, {pid('customer', s('o_custkey'))}, {pid('order', s('l_orderkey'))}, 'Line ' || line_id,
      NULL, NULL, NULL, {tail('line', 'line_id', "'raw/line/' || (l_orderkey // 100) || '.json'")}
    FROM lines JOIN orders ON o_orderkey = l_orderkey, snaps WHERE NOT (bad AND (l_orderkey * 7 + l_linenumber) % 509 = 0)""",
    "identities": f"""SELECT snapshot_id, {pid('identity', s('s_suppkey'))} AS id, s_name AS username, NULL::VARCHAR AS email,
      {tail('supplier', s('s_suppkey'), "CASE WHEN bad AND s_suppkey % 23 = 0 THEN '' WHEN bad AND s_suppkey % 19 = 0 THEN 'elsewhere/x.json' ELSE 'raw/supplier/' || (s_suppkey // 10) || '.json' END")}
    FROM supplier, snaps WHERE NOT (bad AND s_suppkey % 13 = 0)""",
    "record_identities": f"SELECT snapshot_id, {LINE_ID} AS record_id, {pid('identity', s('l_suppkey'))} AS identity_id, 'supplier' AS role, 0::BIGINT AS position FROM lines, snaps",
    "record_tags": f"""SELECT snapshot_id, {ORDER_ID} AS record_id, o_orderstatus AS name, 0::BIGINT AS position FROM orders, snaps
    UNION ALL SELECT snapshot_id, {ORDER_ID}, o_orderpriority, 1 FROM orders, snaps""",
    "turns": "SELECT *, conv_id || '-' || turn AS turn_id, (conv_id * 31 + turn) % 37 = 0 AS dropped FROM conversations",
    "comments": f"""SELECT snapshot_id, {TURN_ID} AS id, CASE WHEN bad AND conv_id % 43 = 0 THEN 'sc_other' ELSE {WS} END AS workspace_id,
      {pid('order', s('CASE WHEN bad AND conv_id % 41 = 0 AND turn = 0 THEN conv_id + 1 ELSE conv_id END'))} AS record_id,
      CASE WHEN turn > 0 THEN {pid('turn', "(conv_id || '-' || (turn - 1))")} END AS parent_comment_id, NULL::VARCHAR AS author_identity_id,
      text AS body_text, NULL::VARCHAR AS body_json, CASE WHEN turn % 3 <> 2 THEN lpad({s('turn')}, 4, '0') END AS date_created_source,
      {tail('turn', 'turn_id', "'raw/turn/' || (conv_id // 10) || '.json'")} FROM turns, snaps WHERE NOT (bad AND dropped)""",
    "attachments": attachments("bad"),
    "field_names": "SELECT * FROM (VALUES ('quality'), ('toxic'), ('ghost')) v(field)",
    "field_definitions": f"""SELECT snapshot_id, {pid('field', 'field')} AS id, CASE WHEN bad AND field = 'quality' THEN 'renamed' ELSE field END AS name,
      'drop_down' AS field_type, 'SOURCE_DEFINITION_ONLY' AS semantics_state,
      '{{"id":"' || field || '","name":"' || field || '","type":"drop_down","type_config":{{"options":[' ||
      CASE WHEN bad AND field = 'toxic' THEN '{{"id":"0","orderindex":0}}' ELSE '{{"id":"0","orderindex":0}},{{"id":"1","orderindex":1}}' END || ']}}}}' AS definition_json,
      {tail('field', 'field', "'raw/field.json'")} FROM field_names, snaps WHERE bad OR field <> 'ghost'""",
    "raw_values": """SELECT doc_id, 'quality' AS field, CAST(quality AS VARCHAR) AS value FROM labels
    UNION ALL SELECT doc_id, 'toxic', CAST(toxic AS VARCHAR) FROM labels""",
    "record_field_values": f"""SELECT snapshot_id, {pid('order', s('doc_id'))} AS record_id,
      {pid('field', "(CASE WHEN bad AND doc_id % 37 = 0 THEN 'nowhere' ELSE field END)")} AS field_id,
      CASE WHEN bad AND doc_id % 31 = 0 THEN '{{oops' ELSE value END AS observed_value_json,
      CASE WHEN bad AND doc_id % 29 = 0 THEN 'EXECUTED' ELSE 'OBSERVED_ONLY' END AS semantics_state FROM raw_values, snaps""",
    "edges": "SELECT a.o_orderkey, a.o_orderkey * 7 + 3 AS to_key, b.o_orderkey IS NOT NULL AS there, a.o_orderkey || '->' || (a.o_orderkey * 7 + 3) AS link FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey * 7 + 3",
    "relationships": f"""SELECT snapshot_id, {pid('relationship.depends_on', 'link')} AS id, 'depends_on' AS kind, {ORDER_ID} AS from_record_id,
      CASE WHEN there AND NOT (bad AND o_orderkey % 107 = 0) THEN {pid('order', s('to_key'))} END AS to_record_id,
      {s('o_orderkey')} AS from_source_id, {s('to_key')} AS to_source_id,
      CASE WHEN there OR (bad AND o_orderkey % 103 = 0) THEN 'RESOLVED' ELSE 'PARTIAL_EXTERNAL' END AS resolution_state,
      '{{"from":"' || o_orderkey || '"}}' AS source_metadata_json,
      {tail('relationship.depends_on', 'link', "'raw/order/' || (o_orderkey // 100) || '.json'", 'TRUE')} FROM edges, snaps""",
    "archive_metadata": """SELECT snapshot_id, key, value FROM snaps, (VALUES ('connector', 'tpch', 'tpch'), ('source_workspace_id', 'w1', 'w2'),
      ('source_snapshot_logical_digest', 'sha256:d', 'sha256:d'), ('archive_status', 'INCOMPLETE', 'CREATED_UNVERIFIED'), ('writer_version', '1', '1'),
      ('archive_schema_version', '3', '3'), ('source_snapshot_atomic', 'false', 'false'), ('verification_status', 'NOT_RUN', NULL)) m(key, v1, v2),
      LATERAL (SELECT CASE WHEN bad THEN v2 ELSE v1 END AS value) WHERE value IS NOT NULL""",
    "entities": " UNION ALL ".join([
        "SELECT snapshot_id, 'workspace' AS type, 'w1' AS id, NULL::VARCHAR AS parent_type, NULL::VARCHAR AS parent_id, FALSE AS composite FROM snaps",
        node("region", "region", "r_regionkey", "'workspace'", "'w1'"), node("nation", "nation", "n_nationkey", "'region'", "n_regionkey"),
        node("customer", "customer", "c_custkey", "'nation'", "c_nationkey"), node("orders", "order", "o_orderkey", "'customer'", "o_custkey"),
        node("lines", "line", "line_id", "'order'", "l_orderkey"),
        node("turns", "turn", "turn_id", "CASE WHEN turn = 0 THEN 'order' ELSE 'turn' END",
             "CASE WHEN turn = 0 THEN CAST(conv_id AS VARCHAR) ELSE conv_id || '-' || (turn - 1) END"),
        node("documents", "document", "doc_id", "'order'", "doc_id"),
        node("(SELECT field FROM field_names WHERE field <> 'ghost')", "field", "field")]),
    "source_index": f"""SELECT * FROM entities UNION ALL SELECT snapshot_id, 'relationship.depends_on', link, 'order', {s('o_orderkey')}, TRUE FROM edges, snaps""",
    "all_entities": " UNION ALL ".join(
        f"SELECT snapshot_id, '{t}' AS tbl, id, {'kind' if t in ('containers', 'records') else 'source_type'} AS kind, source_provider, source_type, source_id, source_raw_path FROM {t}"
        for t in ("workspaces", "containers", "collections", "records", "identities", "comments", "field_definitions", "relationships", "attachments")),
    "objects": """SELECT snapshot_id, CASE WHEN tbl = 'records' THEN kind ELSE source_type END AS type, source_id AS id, min(tbl) AS tbl, min(id) AS portable
    FROM all_entities WHERE tbl <> 'identities' GROUP BY ALL""",
    "landed": f"""SELECT 'attachments/' || doc_id || '.txt' AS path, strlen(text) AS bytes, {digest('text')} AS checksum, doc_id AS number FROM documents
    UNION ALL SELECT 'raw/page/' || page_id || '.html', strlen(html), {digest('html')}, page_id FROM pages
    UNION ALL SELECT p, strlen(n), {digest('n')}, 1 FROM (SELECT CAST(count(*) AS VARCHAR) AS n FROM region),
      (VALUES ('manifest.json'), ('schema.json'), ('raw/inventory.json'), ('raw/region.json'), ('raw/nation.json'), ('raw/field.json')) v(p)
    UNION ALL {raw('customer', 'c_custkey', 'customer', 100)} UNION ALL {raw('orders', 'o_orderkey', 'order', 100)}
    UNION ALL {raw('lineitem', 'l_orderkey', 'line', 100)} UNION ALL {raw('supplier', 's_suppkey', 'supplier', 10)}
    UNION ALL {raw('conversations', 'conv_id', 'turn', 10)} UNION ALL {raw('documents', 'doc_id', 'document', 10)}""",
    "files": f"""SELECT snapshot_id, path, bytes + CASE WHEN bad AND path LIKE 'attachments/%' AND number % 23 = 0 THEN 1 ELSE 0 END AS bytes,
      CASE WHEN bad AND (path LIKE 'attachments/%' AND number % 23 = 0 OR path LIKE 'raw/page/%' AND number % 7 = 0) THEN {digest("'altered'")} ELSE checksum END AS checksum
    FROM landed, snaps WHERE NOT (bad AND (path LIKE 'attachments/%' AND number % 19 = 0 OR path LIKE 'raw/customer/%' AND number % 5 = 0 OR path = 'schema.json'))""",
    "manifest_files": """SELECT snapshot_id, CASE WHEN bad AND path = 'raw/field.json' THEN '../field.json' ELSE path END AS path, bytes, checksum
    FROM landed, snaps, (VALUES (1), (2)) t(times)
    WHERE (path <> 'manifest.json' OR bad) AND NOT (bad AND path LIKE 'raw/page/%' AND number % 11 = 0)
      AND (times = 1 OR (bad AND path LIKE 'raw/page/%' AND number % 17 = 0))""",
    "clean_attachments": attachments("FALSE"),
    "manifest_attachments": "SELECT snapshot_id, id, source_id, record_id, filename, media_type, expected_size, download_status AS status, local_path, archived_size, checksum, error FROM clean_attachments",
    "expected": f"""SELECT snapshot_id, entity, CAST(sum(expected) AS BIGINT) AS expected FROM ({n('region', ['containers', 'container:region'])}
    UNION ALL {n('nation', ['containers', 'container:nation'])} UNION ALL {n('customer', ['collections'])}
    UNION ALL {n('orders', ['records', 'record:order', 'relationships'])} UNION ALL {n('lines', ['records', 'nested_records', 'record:line'])}
    UNION ALL {n('conversations', ['comments'])} UNION ALL {n('documents', ['attachments'])} UNION ALL SELECT 'custom_fields', 2), snaps GROUP BY 1, 2""",
    "manifest_inventory": """SELECT snapshot_id, entity, expected, expected + CASE WHEN snapshot_id = 's2' AND entity = 'collections' THEN 5 ELSE 0 END AS archived,
      0::BIGINT AS unresolved FROM expected""",
    "manifest_observed": """SELECT snapshot_id, entity, n + CASE WHEN bad AND entity = 'record_tags' THEN 1 ELSE 0 END AS n FROM (
      SELECT 'workspaces' AS entity, 1 AS n UNION ALL SELECT 'identities', count(*) FROM supplier UNION ALL SELECT 'record_identity_roles', count(*) FROM lines
      UNION ALL SELECT 'record_tags', 2 * count(*) FROM orders UNION ALL SELECT 'record_field_values', 2 * count(*) FROM labels), snaps
    WHERE NOT bad OR entity <> 'workspaces'""",
    "manifest_discrepancies": """SELECT snapshot_id, 'RELATIONSHIP_PARTIAL_EXTERNAL' AS kind, link AS source_id, 'endpoint outside' AS message FROM edges, snaps
    WHERE NOT there AND NOT (bad AND o_orderkey % 53 = 0)
    UNION ALL SELECT snapshot_id, 'ATTACHMENT_UNRESOLVED', CAST(doc_id AS VARCHAR), 'stated' FROM documents, snaps WHERE bad AND doc_id % 50 = 1""",
    "manifest": """SELECT snapshot_id, bad, CASE WHEN bad THEN 4 ELSE 3 END AS schema_version, 'tpch' AS connector, 'w1' AS workspace_id,
      CASE WHEN bad THEN 'CREATED_UNVERIFIED' ELSE 'INCOMPLETE' END AS status, CASE WHEN NOT bad THEN 'NOT_RUN' END AS verification_status,
      1 AS capability_schema_version, FALSE AS atomic, 'sha256:d' AS logical_digest, 'sha256:c' AS capability_digest, '1' AS writer_version,
      CASE WHEN NOT bad THEN 'u1' END AS extracted_by_id, t AS source_snapshot_completed_at,
      CASE WHEN bad THEN t - INTERVAL 90 SECOND ELSE t + INTERVAL 2 HOUR END AS archive_completed_at
    FROM (SELECT max(o_orderdate) AS t FROM orders), snaps""",
    "capabilities": """SELECT 'p' || (p_partkey // 8) AS snapshot_id,
      CASE WHEN p_size = 47 THEN 'Bad-Id' WHEN p_partkey % 8 = 7 THEN 'attachment_content' WHEN p_size = 46 THEN 'cap_0' ELSE 'cap_' || (p_partkey % 8) END AS id,
      CASE WHEN p_size = 45 THEN '' ELSE p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 'OPTIONAL' ELSE 'REQUIRED' END AS requirement,
      CASE WHEN p_size = 44 THEN 'PARTIAL' ELSE state END AS implementation,
      CASE WHEN p_type = 'ECONOMY' THEN 'FAILED' WHEN p_type = 'PROMO' THEN 'UNAVAILABLE' WHEN p_type = 'SMALL' THEN 'UNKNOWN'
        WHEN p_size = 48 THEN 'SOMETIMES' ELSE 'AVAILABLE' END AS availability, state, p_brand AS note
    FROM (SELECT *, CASE WHEN p_size % 5 = 0 THEN 'PARTIAL' WHEN p_size % 11 = 0 THEN 'UNSUPPORTED' WHEN p_size = 49 THEN 'GREAT' ELSE 'SUPPORTED' END AS state FROM part)""",
}
CTES |= {
    "event_log": """SELECT event_id, 2 AS schema_version, CASE event_type WHEN 'view' THEN 'operation.started' WHEN 'purchase' THEN 'operation.completed'
      WHEN 'error' THEN 'operation.failed' WHEN 'signup' THEN 'verification.recorded' ELSE 'connector.unhealthy' END AS type, lpad(CAST(user_id AS VARCHAR), 10, '0') AS operation_id,
      row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence, ts AS recorded_at, 'tpch' AS connector, 'w' || (user_id % 10) AS workspace_id, '/b/' || (user_id % 10) AS destination,
      CASE event_type WHEN 'view' THEN 'STARTED' WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' WHEN 'signup' THEN 'SUCCEEDED' END AS outcome, 'props ' || props AS message,
      CASE WHEN event_type = 'signup' OR (event_type = 'purchase' AND event_id % 3 <> 0) THEN '/a/' || event_id END AS archive_path,
      CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 4 = 0 THEN 'FAILED' ELSE 'VERIFIED' END END AS result FROM events""",
    "check_groups": "SELECT DISTINCT 'o' || (o_orderkey // 20) AS snapshot_id FROM orders",
    "check_names": "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{name}')" for i, name in enumerate(CHECKS, 1)) + ") v(check_order, check_name)",
    "checks": """SELECT 'o' || (o_orderkey // 20) AS snapshot_id, o_orderkey % 20 + 1 AS check_order, check_name,
      CASE WHEN (o_orderkey // 20) % 4 = 3 AND o_custkey % 8 = 0 THEN 'FAIL' WHEN (o_orderkey // 20) % 4 = 3 AND o_custkey % 8 = 3 THEN 'NOT_EVALUATED'
        WHEN (o_orderkey // 20) % 4 >= 2 AND o_custkey % 8 = 2 THEN 'INCOMPLETE' WHEN (o_orderkey // 20) % 4 >= 1 AND o_custkey % 8 = 1 THEN 'UNPROVEN' ELSE 'PASS' END AS status
    FROM orders JOIN check_names ON check_order = o_orderkey % 20 + 1 WHERE o_custkey % 31 <> 0""",
    "counts": """SELECT *, expected - archived AS unresolved, CASE WHEN expected > archived THEN 'INCOMPLETE' ELSE 'PASS' END AS status FROM (SELECT 'o' || (o_custkey // 5) AS snapshot_id,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'attachments' WHEN '2-HIGH' THEN 'nested_records' ELSE 'record:' || o_orderpriority[1] END AS entity, count(*) AS expected,
      count(*) FILTER (WHERE o_orderstatus <> 'F') AS archived FROM orders GROUP BY 1, 2)""",
    "verdicts": """SELECT snapshot_id, CASE WHEN bool_or(coalesce(status, 'FAIL') IN ('FAIL', 'NOT_EVALUATED')) THEN 'FAILED' WHEN bool_or(status = 'INCOMPLETE') THEN 'INCOMPLETE'
      WHEN bool_or(status = 'UNPROVEN') THEN 'VERIFIED_WITH_LIMITATIONS' ELSE 'VERIFIED' END AS result FROM check_groups LEFT JOIN checks USING (snapshot_id) GROUP BY 1""",
}

_NAMES = re.compile(r"\b(" + "|".join(sorted(CTES, key=len, reverse=True)) + r")\b")


def with_mapping(body: str, recursive: bool = False) -> str:
    """Put the parts of the mapping that `body` names, and those they name, in front of it.

    `body` may start with its own WITH list, written without the keyword as `name AS (...), ... SELECT`; then it
    begins with a comma-free list and ends in a SELECT after a line holding only `---`.
    """
    own, _, final = body.rpartition("---")
    needed, queue = set(), _NAMES.findall(body)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue += _NAMES.findall(CTES[name])
    parts = [f"{name} AS MATERIALIZED ({CTES[name]})" for name in CTES if name in needed]
    if own.strip():
        parts.append(own.strip().rstrip(","))
    head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" if parts else ""
    return head + final.strip()
