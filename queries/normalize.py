"""Normalization of landed response bodies (D). The bodies are JSON derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from queries.mapping import Mapping, pid, text
from queries.oracle import WS, digest, pid as sql_pid, s
from queries.registry import findings, query
from sealcheck.functions.ids import digest as spark_digest
from sealcheck.operators import normalize as N
from sealcheck.operators.findings import union_all
from sealcheck.schemas import SOURCE_OBJECT

INDEX = StructType([StructField("snapshot_id", StringType()), *SOURCE_OBJECT.fields])
VOCABULARY = N.Vocabulary(
    provider="tpch", named_pages=(("list regions", "regions", "region"), ("list nations", "nations", "nation"), ("list customers", "customers", "customer")),
    container_types=("region", "nation"), collection_type="customer", record_types=("order", "line"), record_namespace="record",
    detail_operation="get record", comment_operations=("list turns",), comment_type="turn", attachment_type="document",
    field_operation="list fields", field_type="field",
    links=(N.Link("depends_on", "dependencies", "task_id", "depends_on"), N.Link("next", "linked_tasks", "task_id", "link_id", directed=False)))


def named(m: Mapping, table: str, key: str, name: str, operation: str, array: str, folder: str) -> DataFrame:
    """Pages of 100 named objects each."""
    item = F.struct(F.col(key).alias("id"), F.col(name).alias("name"))
    pages = m.read(table).groupBy(F.expr(f"{key} div 100").alias("p")).agg(F.array_sort(F.collect_list(item)).alias(array))
    return pages.select(F.lit(operation).alias("operation"), F.concat(F.lit(f"{folder}/"), text("p"), F.lit(".json")).alias("raw_path"),
                        F.to_json(F.struct(array)).alias("body"), F.col("p").cast("long").alias("sequence"))


def evidence(m: Mapping) -> DataFrame:
    """(snapshot_id, sequence, operation, raw_path, body) of everything landed for one snapshot."""
    key = F.col("o_orderkey")
    labels = m.read("labels").select(F.col("doc_id").alias("o_orderkey"), "quality", "toxic")
    documents = m.read("documents").select(F.col("doc_id").alias("o_orderkey"), "lang", "n_chars")
    rows = m.read("orders").join(labels, "o_orderkey", "left").join(documents, "o_orderkey", "left")
    number = F.when(key % 2 == 0, text("o_orderkey")).otherwise(F.concat(F.lit('"'), text("o_orderkey"), F.lit('"')))
    creator = F.when(key % 100 == 0, "renamed").otherwise(F.concat(F.lit("user "), text("o_custkey")))
    tag = F.when(key % 50 == 0, '{"x":1}').otherwise(F.concat(F.lit('{"name":"'), "o_orderpriority", F.lit('"}')))
    toxic = F.when(key % 5 == 0, "").when(key % 3 == 0, ',"value":null').otherwise(F.concat(F.lit(',"value":"'), text("toxic"), F.lit('"')))
    fields = F.when(F.col("quality").isNotNull(), F.concat(
        F.lit(',"custom_fields":[{"id":"quality","value":'), text("quality"), F.lit('},{"id":"'), F.when(key % 7 == 0, "nope").otherwise("toxic"), F.lit('"'), toxic, F.lit("}]"))).otherwise("")
    size = F.when(key % 11 == 0, '"x"').otherwise(text("n_chars"))
    url = F.when(key % 9 == 0, "").otherwise(F.concat(F.lit(',"url":"https://files.example/'), text("o_orderkey"), F.lit('?token=1#p"')))
    files = F.when(F.col("lang").isNotNull(), F.concat(
        F.lit(',"attachments":[{"id":"'), text("o_orderkey"), F.lit('","title":"a.'), "lang", F.lit('","size":'), size, url, F.lit("}]"))).otherwise("")
    orders = F.concat(
        F.lit('{"id":'), number, F.when(key % 77 == 0, F.lit("")).otherwise(F.concat(F.lit(',"name":"Order '), text("o_orderkey"), F.lit('"'))),
        F.lit(',"status":{"status":"'), "o_orderstatus", F.lit('","type":"custom"},"priority":{"priority":"'), "o_orderpriority",
        F.lit('"},"archived":'), (key % 4 == 0).cast("string"), F.lit(',"date_created":"'), F.date_format("o_orderdate", "yyyyMMdd"),
        F.lit('","time_estimate":'), F.when(key % 13 == 0, '"soon"').otherwise(text("o_custkey")), F.lit(',"points":'), text("o_custkey"),
        F.lit(',"creator":{"id":"c'), text("o_custkey"), F.lit('","username":"'), creator, F.lit('"},"tags":[{"name":"'), "o_orderstatus", F.lit('"},'), tag,
        F.lit('],"dependencies":[{"task_id":"'), text("o_orderkey"), F.lit('","depends_on":"'), (key * 7 + 3).cast("string"),
        F.lit('"}],"linked_tasks":[{"task_id":"'), text("o_orderkey"), F.lit('","link_id":"'), (key + 1).cast("string"), F.lit('"},{"task_id":"'),
        F.greatest(key - 1, F.lit(0)).cast("string"), F.lit('","link_id":"'), text("o_orderkey"), F.lit('"}]'), fields, files, F.lit("}"))
    lines = F.concat(F.lit('{"id":"'), "line_id", F.lit('","name":"Line '), "line_id", F.lit('","assignees":[{"id":'), text("l_suppkey"),
                     F.lit(',"username":"s","email":"s'), text("l_suppkey"), F.lit('@x"}]}'))
    user = F.concat(F.lit('{"id":"'), "role", F.lit('","username":"'), "role", F.lit('"}'))
    parts = F.to_json(F.array(F.struct("text"), F.struct(F.col("role").alias("text"))))
    body = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('"comment_text":'), F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))).otherwise(
        F.concat(F.lit('"comment":'), parts))
    turns = F.concat(F.lit('{"comments":[{"id":"'), "turn_id", F.lit('","date":'), text("turn"), F.lit(',"user":'), user, F.lit(","), body, F.lit("}]}"))
    definitions = ('{"fields":[{"type":"drop_down","name":"quality","id":"quality","v":1.50},{"id":"toxic","name":"toxic","type":"labels"},'
                   '{"id":"calc","name":"calc","type":"Rollup"}]}')

    def landed(frame, operation, path, document, sequence):
        return frame.select(F.lit(operation).alias("operation"), path.alias("raw_path"), document.alias("body"), sequence.cast("long").alias("sequence"))

    pages = m.read("labels").agg(F.count("quality").alias("n")).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("p"))
    return union_all([
        named(m, "region", "r_regionkey", "r_name", "list regions", "regions", "region"),
        named(m, "nation", "n_nationkey", "n_name", "list nations", "nations", "nation"),
        named(m, "customer", "c_custkey", "c_name", "list customers", "customers", "customer"),
        landed(rows, "get record", F.concat(F.lit("order/"), text("o_orderkey"), F.lit(".json")), orders, key),
        landed(m.lines, "get record", F.concat(F.lit("line/"), "line_id", F.lit(".json")), lines, F.col("l_orderkey")),
        landed(m.turns, "list turns", F.concat(F.lit("turn/"), "turn_id", F.lit(".json")), turns, F.col("turn")),
        landed(pages, "list fields", F.concat(F.lit("field/"), text("p"), F.lit(".json")), F.lit(definitions), F.col("p"))]).withColumn("snapshot_id", F.lit("s1"))


def parts(m: Mapping):
    index = m.index.filter("snapshot_id = 's1'")
    owner = m.snapshots.filter("NOT bad").select("snapshot_id", F.lit("w1").alias("workspace_source_id"))
    return m.evidence, index, owner


def details(m: Mapping, *wanted: str):
    return N.record_details(m.evidence, VOCABULARY, wanted=wanted)[0]


def rid(expression: str) -> str:
    return sql_pid("record", expression)


ORDER, LINE = rid(s("o_orderkey")), rid("line_id")
ORDER_PATH, LINE_PATH = "'raw/order/' || o_orderkey || '.json'", "'raw/line/' || line_id || '.json'"


@query("d03_normalize_containers", f"""SELECT {sql_pid('region', s('r_regionkey'))} AS id, 'region' AS kind, {WS} AS workspace_id, NULL AS parent_id, r_name AS name,
  'raw/region/' || (r_regionkey // 100) || '.json' AS source_raw_path FROM region
UNION ALL SELECT {sql_pid('nation', s('n_nationkey'))}, 'nation', {WS}, {sql_pid('region', s('n_regionkey'))}, n_name, 'raw/nation/' || (n_nationkey // 100) || '.json' FROM nation""")
def containers(m):
    responses, index, owner = parts(m)
    table, _ = N.normalize_containers(index, N.observed_names(responses, VOCABULARY)[0], owner, VOCABULARY)
    return table.select("id", "kind", "workspace_id", "parent_id", "name", "source_raw_path")


@query("d03_normalize_collections", f"""SELECT {sql_pid('customer', s('c_custkey'))} AS id, {sql_pid('nation', s('c_nationkey'))} AS container_id, c_name AS name,
  'raw/customer/' || (c_custkey // 100) || '.json' AS source_raw_path FROM customer""")
def collections(m):
    responses, index, owner = parts(m)
    table, _ = N.normalize_collections(index, N.observed_names(responses, VOCABULARY)[0], owner, VOCABULARY)
    return table.select("id", "container_id", "name", "source_raw_path")


@query("d04_normalize_records", f"""SELECT {ORDER} AS id, 'order' AS kind, {sql_pid('customer', s('o_custkey'))} AS collection_id, NULL AS parent_record_id,
  CASE WHEN o_orderkey % 77 <> 0 THEN 'Order ' || o_orderkey END AS title, o_orderstatus AS status, 'custom' AS status_type, o_orderpriority AS priority, o_orderkey % 4 = 0 AS archived,
  strftime(o_orderdate, '%Y%m%d') AS date_created_source, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey END AS time_estimate_ms, o_custkey AS points, {ORDER_PATH} AS source_raw_path FROM orders
UNION ALL SELECT {LINE}, 'line', {sql_pid('customer', s('o_custkey'))}, {rid(s('l_orderkey'))}, 'Line ' || line_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {LINE_PATH}
FROM lines JOIN orders ON o_orderkey = l_orderkey""")
def records(m):
    responses, index, owner = parts(m)
    table, _ = N.normalize_records(index, details(m, *N.RECORD_MEMBERS), owner, VOCABULARY)
    return table.select("id", "kind", "collection_id", "parent_record_id", "title", "status", "status_type", "priority", "archived", "date_created_source",
                        "time_estimate_ms", F.col("points").cast("long").alias("points"), "source_raw_path")


@query("d04_record_findings", """SELECT 's1' AS snapshot_id, 'normalize_records' AS check_name, CASE t WHEN 1 THEN 'TITLE_MISSING' ELSE 'TIME_ESTIMATE_INVALID' END AS code, 'order' AS entity,
  CAST(o_orderkey AS VARCHAR) AS key, NULL AS detail FROM orders, (VALUES (1), (2)) v(t) WHERE (t = 1 AND o_orderkey % 77 = 0) OR (t = 2 AND o_orderkey % 13 = 0)""")
def record_findings(m):
    responses, index, owner = parts(m)
    return N.normalize_records(index, details(m, *N.RECORD_MEMBERS), owner, VOCABULARY)[1]


@query("d06_normalize_comments", f"""SELECT {sql_pid('turn', 'turn_id')} AS id, {rid(s('conv_id'))} AS record_id, CASE WHEN turn > 0 THEN {sql_pid('turn', "(conv_id || '-' || (turn - 1))")} END AS parent_comment_id,
  {sql_pid('identity', 'role')} AS author_identity_id, CASE WHEN turn % 2 = 0 THEN text ELSE text || role END AS body_text, turn % 2 = 1 AS has_json, CAST(turn AS VARCHAR) AS date_created_source,
  'raw/turn/' || turn_id || '.json' AS source_raw_path FROM turns""")
def comments(m):
    responses, index, owner = parts(m)
    table, _ = N.normalize_comments(index, N.observed_comments(responses, VOCABULARY)[0], owner, VOCABULARY)
    return table.select("id", "record_id", "parent_comment_id", "author_identity_id", "body_text", F.col("body_json").isNotNull().alias("has_json"),
                        "date_created_source", "source_raw_path")


PEOPLE = f"""ppl AS (SELECT 'c' || o_custkey AS person, CASE WHEN o_orderkey % 100 = 0 THEN 'renamed' ELSE 'user ' || o_custkey END AS username, NULL AS email, {ORDER_PATH} AS path, {ORDER} AS record_id, 'creator' AS role FROM orders
  UNION ALL SELECT CAST(l_suppkey AS VARCHAR), 's', 's' || l_suppkey || '@x', {LINE_PATH}, {LINE}, 'assignee' FROM lines)
---
"""


def people(m):
    return N.observed_people(details(m, *[member for _, member, _ in N.ROLES]))


@query("d07_normalize_identities", PEOPLE + f"""SELECT {sql_pid('identity', 'person')} AS id, arg_min(username, path) AS username, min(email) AS email, min(path) AS source_raw_path, min(username) <> max(username) AS conflict
FROM ppl GROUP BY person""")
def identities(m):
    table, found = N.normalize_identities(people(m).select("snapshot_id", "person_id", "username", "email", "raw_path"), VOCABULARY)
    bad = found.filter("code = 'CONFLICTING_METADATA'").select(pid("identity", F.col("key")).alias("id"), F.lit(True).alias("conflict"))
    return table.select("id", "username", "email", "source_raw_path").join(bad, "id", "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))


@query("d08_normalize_roles", PEOPLE + f"SELECT record_id, {sql_pid('identity', 'person')} AS identity_id, role, 0 AS position FROM ppl")
def roles(m):
    return N.normalize_roles(people(m), VOCABULARY).drop("snapshot_id")


@query("d09_normalize_tags", f"""SELECT {ORDER} AS record_id, o_orderstatus AS name, 0 AS position, NULL AS code FROM orders
UNION ALL SELECT {ORDER}, o_orderpriority, 1, NULL FROM orders WHERE o_orderkey % 50 <> 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, 1, 'NAME_MISSING' FROM orders WHERE o_orderkey % 50 = 0""")
def tags(m):
    table, found = N.normalize_tags(details(m, "tags"), VOCABULARY)
    return table.select("record_id", "name", "position", F.lit(None).cast("string").alias("code")).unionByName(
        found.select(F.col("key").alias("record_id"), F.lit(None).cast("string").alias("name"), F.col("detail").cast("long").alias("position"), "code"))


FIELD = "CASE WHEN p_size % 3 = 0 THEN 'Rollup' ELSE p_brand END"
FIELD_ID = sql_pid("field", "'p' || p_partkey")


@query("d10_normalize_field_definitions", f"""SELECT {FIELD_ID} AS id, p_name AS name, {FIELD} AS field_type, CASE WHEN p_size % 3 = 0 THEN 'OBSERVED_ONLY_NO_EXECUTION' ELSE 'SOURCE_DEFINITION_ONLY' END AS semantics_state,
  '{{"id":"p' || p_partkey || '","name":"' || p_name || '","type":"' || {FIELD} || '","v":' || p_size || '.50}}' AS definition_json, 'raw/field/' || (p_partkey // 50) || '.json' AS source_raw_path, NULL AS code
  FROM part WHERE p_partkey % 10 <> 0
UNION ALL SELECT 'p' || p_partkey, NULL, NULL, NULL, NULL, NULL, 'EVIDENCE_MISSING' FROM part WHERE p_partkey % 10 = 0
UNION ALL SELECT 'p' || p_partkey, NULL, NULL, NULL, NULL, NULL, 'CONFLICTING_DEFINITION' FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 7 = 0""")
def definitions(m):
    """Every part is a field. Pages of 50 state them in any key order; some are stated again otherwise, some nowhere."""
    key, kind = F.col("p_partkey"), F.when(F.col("p_size") % 3 == 0, "Rollup").otherwise(F.col("p_brand"))
    part = m.read("part")
    shown = part.filter(key % 10 != 0).withColumn("element", F.concat(
        F.lit('{"type":"'), kind, F.lit('", "name":"'), "p_name", F.lit('","id":"p'), text("p_partkey"), F.lit('","v":'), text("p_size"), F.lit(".50}")))
    again = shown.filter(key % 7 == 0).withColumn("element", F.concat(F.lit('{"id":"p'), text("p_partkey"), F.lit('","name":"another"}')))

    def pages(frame, folder, first):
        grouped = frame.groupBy(F.expr("p_partkey div 50").alias("p")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "element"))).alias("items"))
        return grouped.select(F.lit("s1").alias("snapshot_id"), (F.col("p") + first).cast("long").alias("sequence"), F.lit("list fields").alias("operation"),
                              F.concat(F.lit(f"{folder}/"), text("p"), F.lit(".json")).alias("raw_path"),
                              F.concat(F.lit('{"fields":['), F.array_join(F.transform("items", lambda x: x["element"]), ","), F.lit("]}")).alias("body"))

    responses = pages(shown, "field", 0).union(pages(again, "again", 1_000_000_000))
    held = {"snapshot_id": F.lit("s1"), "type": F.lit("field"), "id": F.concat(F.lit("p"), text("p_partkey"))}
    index = part.select(*[held.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INDEX])
    table, found = N.normalize_field_definitions(index, responses, VOCABULARY)
    none = F.lit(None).cast("string")
    columns = ["name", "field_type", "semantics_state", "definition_json", "source_raw_path"]
    return table.select("id", *columns, none.alias("code")).union(found.select("key", *[none.alias(c) for c in columns], "code"))


@query("d11_normalize_field_values", f"""lb AS (SELECT labels.* FROM labels JOIN orders ON o_orderkey = doc_id)
---
SELECT {rid(s('doc_id'))} AS record_id, {sql_pid('field', "'quality'")} AS field_id, CAST(quality AS VARCHAR) AS observed_value_json, NULL AS code FROM lb
UNION ALL SELECT {rid(s('doc_id'))}, {sql_pid('field', "'toxic'")}, CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"' || toxic || '"' END, NULL FROM lb WHERE doc_id % 7 <> 0 AND doc_id % 5 <> 0
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'nope', NULL, 'UNKNOWN_FIELD' FROM lb WHERE doc_id % 7 = 0""")
def values(m):
    responses, index, _ = parts(m)
    known, _ = N.normalize_field_definitions(index, responses, VOCABULARY)
    table, found = N.normalize_field_values(details(m, N.VALUES), known, VOCABULARY)
    return table.select("record_id", "field_id", "observed_value_json", F.lit(None).cast("string").alias("code")).unionByName(
        found.select(F.col("key").alias("record_id"), F.col("entity").alias("field_id"), F.lit(None).cast("string").alias("observed_value_json"), "code"))


@query("d12_normalize_attachments", f"""dc AS (SELECT documents.* FROM documents JOIN orders ON o_orderkey = doc_id)
---
SELECT {sql_pid('document', s('doc_id'))} AS id, {rid(s('doc_id'))} AS record_id, 'a.' || lang AS filename, CASE WHEN doc_id % 11 <> 0 THEN n_chars END AS expected_size,
  CASE WHEN doc_id % 9 <> 0 THEN 'https://files.example/' || doc_id END AS source_url, CASE WHEN doc_id % 9 = 0 THEN 'UNRESOLVED' ELSE 'PENDING' END AS download_status, NULL AS code FROM dc
UNION ALL SELECT CAST(doc_id AS VARCHAR), NULL, NULL, NULL, NULL, NULL, 'SIZE_INVALID' FROM dc WHERE doc_id % 11 = 0""")
def attachments(m):
    responses, _, owner = parts(m)
    table, found = N.normalize_attachments(details(m, "attachments"), owner, VOCABULARY)
    none = F.lit(None).cast("string")
    return table.select("id", "record_id", "filename", "expected_size", "source_url", "download_status", none.alias("code")).unionByName(found.select(
        F.col("key").alias("id"), none.alias("record_id"), none.alias("filename"), none.cast("long").alias("expected_size"), none.alias("source_url"),
        none.alias("download_status"), "code"))


MENTIONS = """mn AS (SELECT 'depends_on' AS kind, o_orderkey || '->' || (o_orderkey * 7 + 3) AS id, CAST(o_orderkey AS VARCHAR) AS f, CAST(o_orderkey * 7 + 3 AS VARCHAR) AS t FROM orders
  UNION SELECT 'next', least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)) || '<->' || greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR)), least(CAST(a AS VARCHAR), CAST(b AS VARCHAR)), greatest(CAST(a AS VARCHAR), CAST(b AS VARCHAR))
  FROM (SELECT o_orderkey AS a, o_orderkey + 1 AS b FROM orders UNION ALL SELECT greatest(o_orderkey - 1, 0), o_orderkey FROM orders)),
kn AS (SELECT CAST(o_orderkey AS VARCHAR) AS k FROM orders)
---
"""


@query("d13_normalize_relationships", MENTIONS + f"""SELECT 'sc_' || sha256('tpch' || chr(0) || 'relationship.' || kind || chr(0) || id) AS id, kind, CASE WHEN a.k IS NOT NULL THEN {rid('f')} END AS from_record_id,
  CASE WHEN b.k IS NOT NULL THEN {rid('t')} END AS to_record_id, f AS from_source_id, t AS to_source_id, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN 'RESOLVED' ELSE 'PARTIAL_EXTERNAL' END AS resolution_state
FROM mn LEFT JOIN kn a ON a.k = f LEFT JOIN kn b ON b.k = t""")
def relationships(m):
    mentions, _ = N.observed_links(details(m, *[link.array for link in VOCABULARY.links]), VOCABULARY)
    known = m.index.filter("snapshot_id = 's1' AND type IN ('order', 'line')").select("snapshot_id", "id")
    return N.normalize_relationships(mentions, known, VOCABULARY).select("id", "kind", "from_record_id", "to_record_id", "from_source_id", "to_source_id", "resolution_state")


@query("d14_attachment_outcomes", f"""SELECT CAST(doc_id AS VARCHAR) AS id, reason IS NULL AS retrieved, CASE WHEN reason IS NULL THEN 'attachments/' || doc_id || '.txt' END AS local_path,
  CASE WHEN reason IS NULL THEN b END AS archived_size, CASE WHEN reason IS NULL THEN sum END AS checksum, reason AS error FROM (SELECT doc_id, strlen(text) AS b, {digest('text')} AS sum,
  CASE WHEN doc_id % 23 = 0 THEN 'no download URL' WHEN n_chars > 5000 THEN 'expected size exceeds the limit of 5000 bytes' WHEN doc_id % 19 = 0 THEN 'no landed file'
    WHEN strlen(text) > 5000 THEN 'file exceeds the limit of 5000 bytes' WHEN n_chars <> strlen(text) THEN 'size mismatch: expected ' || n_chars || ' bytes, received ' || strlen(text)
    WHEN contains(text, 'the') THEN 'file holds a configured secret and was omitted' END AS reason FROM documents)""")
def outcomes(m):
    rows = m.read("documents")
    lost = F.col("doc_id") % 23 == 0
    none = F.lit(None).cast("string")
    pending = rows.select(F.lit("s1").alias("snapshot_id"), text("doc_id").alias("id"), F.col("n_chars").alias("expected_size"),
                          F.when(lost, "UNRESOLVED").otherwise("PENDING").alias("download_status"), none.alias("local_path"),
                          none.cast("long").alias("archived_size"), none.alias("checksum"), F.when(lost, "no download URL").alias("error"))
    landed = rows.filter("doc_id % 19 <> 0").select(
        F.lit("s1").alias("snapshot_id"), text("doc_id").alias("attachment_id"), F.concat(F.lit("attachments/"), text("doc_id"), F.lit(".txt")).alias("path"),
        F.octet_length("text").cast("long").alias("bytes"), spark_digest(F.col("text")).alias("checksum"), F.contains(F.col("text"), F.lit("the")).alias("has_secret"))
    return N.attachment_outcomes(pending, landed, limit=5000).select(
        "id", (F.col("download_status") == "RETRIEVED").alias("retrieved"), "local_path", "archived_size", "checksum", "error")
