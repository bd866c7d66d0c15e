"""Projections and scalar transforms (B) and page-table rules (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.mapping import pid, text
from queries.oracle import pid as sql_pid, s
from queries.registry import coded, findings, query
from sealcheck.functions import jsonfn as J, text as X
from sealcheck.operators import pages as P
from sealcheck.rules import COMPUTED_FIELD_TYPES
from sealcheck.sources.files import spread

SPACES = r"[\s\x0b\x{85}\p{Z}]"


def trimmed(expression: str) -> str:
    return f"regexp_replace({expression}, '^{SPACES}+|{SPACES}+$', '', 'g')"


@query("b01_portable_id", f"SELECT o_orderkey, {sql_pid('order', s('o_orderkey'))} AS portable_id FROM orders")
def portable_ids(m):
    return m.read("orders").select("o_orderkey", pid("order", text("o_orderkey")).alias("portable_id"))


@query("b02_raw_scalars", """SELECT o_orderkey, o_orderstatus AS status, o_orderkey AS as_int, o_custkey AS twice_points, o_orderkey % 2 = 0 AS flag,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_custkey AS VARCHAR) END AS scalar, o_orderkey % 5 = 0 AS bad_name FROM orders""")
def raw_scalars(m):
    key = F.col("o_orderkey")
    document = F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","key":'), text("o_orderkey"), F.lit(',"points":'),
                        (F.col("o_custkey") * 0.5).cast("string"), F.lit(',"flag":'), (key % 2 == 0).cast("string"),
                        F.when(key % 3 == 0, F.concat(F.lit(',"scalar":'), text("o_custkey"))).otherwise(',"scalar":null'),
                        F.when(key % 5 == 0, ',"name":7').otherwise(',"name":"n"'), F.lit("}"))
    frame, members = J.with_members(spread(m.read("orders")).withColumn("doc", document), "doc",
                                    ["status", "key", "points", "flag", "scalar", "name"], "m")
    return frame.select("o_orderkey", J.raw_string(members["status"]).alias("status"), J.raw_int(members["key"]).alias("as_int"),
                        (J.raw_double(members["points"]) * 2).cast("long").alias("twice_points"), J.raw_bool(members["flag"]).alias("flag"),
                        J.raw_scalar(members["scalar"]).alias("scalar"),
                        J.mistyped(members["name"], J.raw_string(members["name"])).alias("bad_name"))


@query("b02_verbatim_scalars", """WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_custkey || '.50' WHEN 1 THEN o_custkey || 'e2' WHEN 2 THEN '-' || o_custkey || '.0E-03'
  ELSE CAST(o_custkey AS VARCHAR) END AS n FROM orders) SELECT o_orderkey, n AS scalar, n AS priority, '[' || n || ',"' || n || '"]' AS list FROM t""")
def verbatim_scalars(m):
    key, number = F.col("o_orderkey") % 4, text("o_custkey")
    spelled = (F.when(key == 0, F.concat(number, F.lit(".50"))).when(key == 1, F.concat(number, F.lit("e2")))
               .when(key == 2, F.concat(F.lit("-"), number, F.lit(".0E-03"))).otherwise(number))
    document = F.concat(F.lit('{"scalar":'), spelled, F.lit(',"priority":{"priority":'), spelled, F.lit('},"list":['), spelled, F.lit(',"'), spelled, F.lit('"]}'))
    frame, members = J.with_members(spread(m.read("orders")).withColumn("doc", document), "doc", ["scalar", "priority", "list"], "m")
    return frame.select("o_orderkey", J.raw_scalar(members["scalar"]).alias("scalar"), J.priority_field(members["priority"]).alias("priority"),
                        members["list"].text.alias("list"))


@query("b03_source_id", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'k' || o_orderkey WHEN 1 THEN CAST(o_orderkey AS VARCHAR) END AS source_id FROM orders""")
def source_ids(m):
    key, number = F.col("o_orderkey") % 5, text("o_orderkey")
    literal = (F.when(key == 0, F.concat(F.lit('"k'), number, F.lit('"'))).when(key == 1, number)
               .when(key == 2, F.concat(number, F.lit(".5"))).when(key == 3, F.concat(F.lit("-1"), number)).otherwise('"  "'))
    frame, members = J.with_members(spread(m.read("orders")).withColumn("doc", F.concat(F.lit('{"id":'), literal, F.lit("}"))), "doc", ["id"], "m")
    return frame.select("o_orderkey", J.source_id(members["id"]).alias("source_id"))


@query("b04_status_priority", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS status,
  CASE WHEN o_orderkey % 7 <> 0 THEN 'custom' END AS status_type, o_orderpriority AS priority FROM orders""")
def status_priority(m):
    status = F.when(F.col("o_orderkey") % 7 == 0, "null").otherwise(
        F.concat(F.lit('{"status":"'), "o_orderstatus", F.lit('","type":"custom"}')))
    document = F.concat(F.lit('{"status":'), status, F.lit(',"priority":{"priority":"'), "o_orderpriority", F.lit('"}}'))
    frame, members = J.with_members(spread(m.read("orders")).withColumn("doc", document), "doc", ["status", "priority"], "m")
    state, kind = J.status_fields(members["status"])
    return frame.select("o_orderkey", state.alias("status"), kind.alias("status_type"), J.priority_field(members["priority"]).alias("priority"))


@query("b05_canonical_json", """SELECT event_id, '{"a":{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '},"b":1.50,"c":"x\\u003cy"}' AS canonical, event_id % 9 <> 0 AS valid FROM events""")
def canonical(m):
    document = F.concat(F.lit('{ "c" : "x<y", "b": 1.50,\n"a": '), "props", F.lit("}"))
    return m.read("events").select("event_id", J.canonical_json(document).alias("canonical"), J.valid_json(
        F.when(F.col("event_id") % 9 == 0, F.concat("props", F.lit(" 2"))).otherwise(F.col("props"))).alias("valid"))


@query("b06_rich_text", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN text || role || text WHEN 1 THEN text END AS rich FROM conversations""")
def rich(m):
    turn = F.col("turn") % 3
    parts = F.to_json(F.array(F.struct(F.col("text")), F.struct(F.col("role").alias("text")), F.struct(F.col("text"))))
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    document = F.when(turn == 0, parts).when(turn == 1, quoted).otherwise("5")
    return m.read("conversations").select("conv_id", "turn", J.rich_text(document).alias("rich"))


@query("b07_typed_title", f"""SELECT conv_id, turn, CASE WHEN role <> 'system' THEN nullif({trimmed('text')}, '') END AS title FROM conversations""")
def title(m):
    kind = F.when(F.col("role") == "system", "rich_text").otherwise("title")
    properties = F.to_json(F.create_map(
        F.lit("Anything"), F.struct(F.lit("number").alias("type"), F.lit(None).cast("array<struct<plain_text:string>>").alias("title")),
        F.col("role"), F.struct(kind.alias("type"), F.array(F.struct(F.col("text").alias("plain_text"))).alias("title"))))
    return m.read("conversations").select("conv_id", "turn", J.typed_title(properties).alias("title"))


@query("b08_strip_url_query", "SELECT page_id, nullif(regexp_replace(url, '[?#].*$', ''), '') AS url FROM pages")
def strip_url(m):
    return m.read("pages").select("page_id", X.strip_url_query(F.col("url")).alias("url"))


@query("b09_field_semantics", """SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'OBSERVED_ONLY_NO_EXECUTION' ELSE 'SOURCE_DEFINITION_ONLY' END AS state FROM part""")
def field_semantics(m):
    kind = F.when(F.col("p_size") % 7 == 0, F.element_at(F.array(*[F.lit(t.upper()) for t in COMPUTED_FIELD_TYPES]),
                                                        (F.col("p_size") % 5 + 1).cast("int"))).otherwise(F.col("p_type"))
    return m.read("part").select("p_partkey", J.field_semantics_state(kind).alias("state"))


def plain_name(expression: str) -> str:
    masked = f"regexp_replace({trimmed(expression)}, '[\\p{{Cc}}<>:\"/\\\\|?*]', '_', 'g')"
    return f"regexp_replace(regexp_replace({masked}, '{SPACES}+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"


def cut(expression: str, limit: int) -> str:
    return (f"left({expression}, coalesce(list_max(list_filter(range(0, {limit + 1}), lambda i: strlen(left({expression}, i)) <= {limit})), 0))")


@query("b10_safe_component", f"""plain AS (SELECT doc_id, {plain_name('text')} AS plain FROM documents),
cut AS (SELECT doc_id, regexp_replace({cut('plain', 78)}, '[ .]+$', '') AS name FROM plain),
named AS (SELECT doc_id, CASE WHEN name = '' THEN 'unnamed' ELSE name END AS name FROM cut)
---
SELECT doc_id, CASE WHEN regexp_matches(upper(regexp_replace(name, '\\.[^.]*$', '')), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' ELSE '' END
  || name || '--' || substr(sha256('tpch' || chr(0) || 'document' || chr(0) || CAST(doc_id AS VARCHAR)), 1, 16) AS component FROM named""")
def component(m):
    return m.read("documents").select("doc_id", X.safe_component(F.col("text"), pid("document", text("doc_id"))).alias("component"))


@query("b11_safe_text", f"""clean AS (SELECT doc_id, {trimmed("regexp_replace(text, '[\\x00-\\x1f\\x7f]', ' ', 'g')")} AS t FROM documents)
---
SELECT doc_id, CASE WHEN strlen(t) <= 512 THEN t ELSE {cut('t', 509)} || '...' END AS safe FROM clean""")
def safe(m):
    return m.read("documents").select("doc_id", X.safe_text(F.col("text")).alias("safe"))


SECRETS = ["the", "Ein", "a.b"]


@query("b12_redact", f"""SELECT doc_id, sha256({trimmed("regexp_replace(replace(replace(replace(text, 'the', '[REDACTED]'), 'Ein', '[REDACTED]'), 'a.b', '[REDACTED]'), '[\\x00-\\x08\\x0a-\\x1f]', ' ', 'g')")}) AS redacted,
  contains(text, 'the') OR contains(text, 'Ein') OR contains(text, 'a.b') AS has_secret FROM documents""")
def redacted(m):
    return m.read("documents").select("doc_id", F.sha2(X.redact(F.col("text"), SECRETS), 256).alias("redacted"),
                                      X.contains_secret([F.col("text")], SECRETS).alias("has_secret"))


@query("b13_markdown", """SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '`', '&#96;'), chr(13), ' '), chr(10), ' ')) AS inline,
  sha256('    ' || replace(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(10) || '    ') || chr(10)) AS block FROM pages""")
def markdown(m):
    return m.read("pages").select("page_id", F.sha2(X.inline_markdown(F.col("html")), 256).alias("inline"),
                                  F.sha2(X.code_block(F.col("html")), 256).alias("block"))


@query("b14_safe_extension", "SELECT page_id, regexp_extract(lower(url), '(\\.[a-z0-9]{1,11})$', 1) AS url_ext, '.' || CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'h' END AS ext FROM pages")
def extension(m):
    name = F.concat(F.lit("Page.Name."), F.when(F.col("page_id") % 2 == 0, "HTML").otherwise("h"))
    return m.read("pages").select("page_id", X.safe_extension(F.col("url")).alias("url_ext"), X.safe_extension(name).alias("ext"))


# --- page tables

def order_pages(m):
    """Orders in pages of 100 keys; some pages lack their array."""
    item = F.struct("o_orderkey", "o_custkey")
    grouped = m.read("orders").groupBy(F.expr("o_orderkey div 100").alias("page_no")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.when(F.col("page_no") % 7 == 0, '{"orders":null}').when(F.col("page_no") % 11 == 0, '{"orders":[]}').otherwise(
        F.concat(F.lit('{"orders":'), F.to_json("items"), F.lit("}")))
    return grouped.select(F.lit("s1").alias("snapshot_id"), "page_no", F.concat(F.lit("p/"), text("page_no")).alias("raw_path"), body.alias("body"))


@query("c01_explode_pages", """SELECT 'p/' || (o_orderkey // 100) AS raw_path, row_number() OVER (PARTITION BY o_orderkey // 100 ORDER BY o_orderkey) - 1 AS position,
  o_orderkey AS id, NULL AS code FROM orders WHERE (o_orderkey // 100) % 7 <> 0 AND (o_orderkey // 100) % 11 <> 0
UNION ALL SELECT DISTINCT 'p/' || (o_orderkey // 100), NULL, NULL, 'REQUIRED_ARRAY_MISSING' FROM orders WHERE (o_orderkey // 100) % 7 = 0""")
def explode_pages(m):
    elements, missing = P.explode_pages(order_pages(m), "orders")
    none = F.lit(None)
    return elements.select("raw_path", F.col("position").cast("long").alias("position"),
                           F.get_json_object("element", "$.o_orderkey").cast("long").alias("id"), none.cast("string").alias("code")).unionByName(
        missing.select(F.col("key").alias("raw_path"), none.cast("long").alias("position"), none.cast("long").alias("id"), "code"))


@query("c01_explode_pages_exact", """WITH e AS (SELECT event_id // 50 AS page_no, event_id, value, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) - 1 AS position FROM events)
SELECT 'p/' || page_no AS raw_path, position, CASE WHEN event_id % 13 = 0 THEN 5001 ELSE 1 END AS depth, NULL AS code FROM e WHERE page_no % 5 <> 0 AND event_id % 17 <> 0
UNION ALL SELECT 'p/' || page_no || '#' || position, NULL, NULL, 'ELEMENT_NOT_JSON' FROM e WHERE page_no % 5 <> 0 AND event_id % 17 = 0
UNION ALL SELECT DISTINCT 'p/' || page_no, NULL, NULL, 'BODY_NOT_JSON' FROM e WHERE page_no % 5 = 0""")
def explode_pages_exact(m):
    """Bodies with NaN in one element, an element nested 5 001 levels deep, and text after the end."""
    deep = F.concat(F.repeat(F.lit("["), 5000), F.to_json(F.struct("event_id")), F.repeat(F.lit("]"), 5000))
    item = F.when(F.col("event_id") % 17 == 0, '{"v":NaN}').when(F.col("event_id") % 13 == 0, deep).otherwise(F.to_json(F.struct("event_id", "value")))
    grouped = m.read("events").groupBy(F.expr("event_id div 50").alias("page_no")).agg(F.array_sort(F.collect_list(F.struct("event_id", item.alias("item")))).alias("items"))
    body = F.concat(F.lit('{"list":['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.when(F.col("page_no") % 5 == 0, "]} x").otherwise("]}"))
    pages = grouped.select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("p/"), text("page_no")).alias("raw_path"), body.alias("body"))
    elements, missing = P.explode_pages(pages, "list", exact=True)
    depth = F.length("element") - F.length(F.ltrim("element", F.lit("["))) + 1
    none = F.lit(None)
    return elements.select("raw_path", F.col("position").cast("long").alias("position"), depth.cast("long").alias("depth"), none.cast("string").alias("code")).unionByName(
        missing.select(F.col("key").alias("raw_path"), none.cast("long").alias("position"), none.cast("long").alias("depth"), "code"))


@query("c02_first_or_conflict", """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, arg_min(l_suppkey, l_partkey * 1000000000 + l_suppkey) AS l_suppkey,
  count(*) AS n_seen, min(l_suppkey) <> max(l_suppkey) AS conflict FROM lineitem GROUP BY 1, 2""")
def first_or_conflict(m):
    rows = m.read("lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_suppkey",
                                     F.struct("l_partkey", "l_suppkey").alias("seen"))
    return P.first_or_conflict(rows, ["l_orderkey", "l_linenumber"], ["l_suppkey"], "seen")


@query("c03_duplicates_across_pages", """SELECT 's1' AS snapshot_id, l_orderkey AS scope, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS n_seen
FROM lineitem GROUP BY 2, 3 HAVING count(*) > 1""")
def duplicates(m):
    rows = m.read("lineitem").select(F.lit("s1").alias("snapshot_id"), F.col("l_orderkey").alias("scope"), F.col("l_linenumber").cast("long").alias("l_linenumber"))
    return P.duplicates_across_pages(rows, ["l_linenumber"])


NUMBERED = """pg AS (SELECT 's1' AS snapshot_id, CAST(l_orderkey AS VARCHAR) AS scope, l_linenumber - 1 AS page_no,
  CASE WHEN CAST(l_quantity AS BIGINT) % 3 = 0 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS n_items FROM lineitem),
sm AS (SELECT snapshot_id, scope, min(page_no) AS low, max(page_no) AS high FROM pg GROUP BY 1, 2),
lst AS (SELECT pg.snapshot_id, pg.scope, high, max(n_items) AS last_items FROM pg JOIN sm ON pg.scope = sm.scope AND page_no = high GROUP BY 1, 2, 3)
---
"""


@query("c04_numbered_termination", NUMBERED + findings(
    "page_termination", ("'FIRST_PAGE_MISSING'", "scope", "low", "NULL", "sm WHERE low <> 0"),
    ("'NOT_TERMINATED'", "scope", "high", "NULL", "lst WHERE last_items > 0"),
    ("'PAGE_REPEATED'", "scope", "page_no", "NULL", "(SELECT snapshot_id, scope, page_no FROM pg GROUP BY 1, 2, 3 HAVING count(*) > 1)"),
    ("'PAGE_AFTER_END'", "scope", "page_no", "NULL", "(SELECT pg.* FROM pg JOIN sm ON pg.scope = sm.scope WHERE n_items = 0 AND page_no < high)"),
    ("'PAGE_GAP'", "scope", "page_no", "NULL", "(SELECT DISTINCT snapshot_id, scope, page_no FROM pg a WHERE page_no > 0 AND NOT EXISTS (SELECT 1 FROM pg b WHERE b.scope = a.scope AND b.page_no = a.page_no - 1))")))
def numbered(m):
    quantity = F.col("l_quantity").cast("long")
    return P.numbered_termination(m.read("lineitem").select(
        F.lit("s1").alias("snapshot_id"), text("l_orderkey").alias("scope"), (F.col("l_linenumber") - 1).alias("page_no"),
        F.when(quantity % 3 == 0, 0).otherwise(quantity).alias("n_items")))


CURSOR = """pg AS (SELECT 's1' AS snapshot_id, CAST(user_id AS VARCHAR) AS scope, event_id AS page_no, event_type <> 'signup' AS has_more,
  CASE WHEN event_type <> 'error' THEN props END AS next_cursor FROM events)
---
"""


@query("c04_cursor_termination", CURSOR + findings(
    "page_termination", ("'CURSOR_MISSING'", "scope", "page_no", "NULL", "pg WHERE has_more AND next_cursor IS NULL"),
    ("'CURSOR_REPEATED'", "scope", "next_cursor", "NULL", "(SELECT snapshot_id, scope, next_cursor FROM pg WHERE has_more AND next_cursor IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) > 1)"),
    ("'NOT_TERMINATED'", "scope", "page_no", "NULL", "(SELECT snapshot_id, scope, max(page_no) AS page_no, arg_max(has_more, page_no) AS h FROM pg GROUP BY 1, 2) WHERE h")))
def cursors(m):
    return P.cursor_termination(m.read("events").select(
        F.lit("s1").alias("snapshot_id"), text("user_id").alias("scope"), F.col("event_id").alias("page_no"),
        (F.col("event_type") != "signup").alias("has_more"), F.when(F.col("event_type") != "error", F.col("props")).alias("next_cursor")))


CHAIN = """pg AS (SELECT 's1' AS snapshot_id, CAST(conv_id AS VARCHAR) AS scope, turn AS page_no, CASE WHEN turn > 0 OR conv_id % 19 = 0 THEN CAST(turn - 1 AS VARCHAR) END AS start,
  CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1 + CASE WHEN strlen(text) % 5 = 0 THEN 1 ELSE 0 END) END AS start_id, CAST(turn AS VARCHAR) AS last_date, conv_id || '-' || turn AS last_id,
  CASE WHEN role = 'user' THEN 0 ELSE 1 END AS n_items FROM conversations)
---
"""


@query("c04_chained_termination", CHAIN + findings(
    "page_termination", ("'CHAIN_BROKEN'", "a.scope", "a.page_no", "NULL", """(SELECT a.* FROM pg a LEFT JOIN pg b ON b.scope = a.scope AND b.page_no = a.page_no - 1
      WHERE a.page_no > 0 AND (b.scope IS NULL OR a.start IS DISTINCT FROM b.last_date OR a.start_id IS DISTINCT FROM b.last_id)) a"""),
    ("'FIRST_PAGE_NOT_AT_START'", "scope", "page_no", "NULL", "pg WHERE page_no = 0 AND (start IS NOT NULL OR start_id IS NOT NULL)"),
    ("'NOT_TERMINATED'", "scope", "page_no", "NULL", "(SELECT snapshot_id, scope, max(page_no) AS page_no, arg_max(n_items, page_no) AS h FROM pg GROUP BY 1, 2) WHERE h > 0")))
def chained(m):
    turn, conv = F.col("turn"), F.col("conv_id")
    shift = F.when(F.octet_length("text") % 5 == 0, 1).otherwise(0)
    return P.chained_termination(m.read("conversations").select(
        F.lit("s1").alias("snapshot_id"), conv.cast("string").alias("scope"), turn.alias("page_no"),
        F.when((turn > 0) | (conv % 19 == 0), (turn - 1).cast("string")).alias("start"),
        F.when(turn > 0, F.concat_ws("-", conv, turn - 1 + shift)).alias("start_id"), turn.cast("string").alias("last_date"),
        F.concat_ws("-", conv, turn).alias("last_id"), F.when(F.col("role") == "user", 0).otherwise(1).alias("n_items")))


@query("c05_declared_vs_returned", """SELECT 's1' AS snapshot_id, o_orderkey AS parent_id, o_custkey % 8 AS declared, coalesce(n, 0) AS returned FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_custkey % 8 <> coalesce(n, 0)""")
def declared(m):
    one = F.lit("s1").alias("snapshot_id")
    return P.declared_vs_returned(m.read("orders").select(one, F.col("o_orderkey").alias("parent_id"), (F.col("o_custkey") % 8).alias("declared")),
                                  m.read("lineitem").select(one, F.col("l_orderkey").alias("parent_id")))


@query("c06_list_vs_detail", "l AS (SELECT * FROM records WHERE snapshot_id = 's1'), d AS (SELECT * FROM records WHERE snapshot_id = 's2'),\n"
       "j AS (SELECT 's1' AS snapshot_id, coalesce(l.id, d.id) AS id, l.id AS li, d.id AS di, l.collection_id AS lc, d.collection_id AS dc, l.parent_record_id AS lp, d.parent_record_id AS dp FROM l FULL JOIN d ON l.id = d.id)\n---\n"
       + coded("list_vs_detail", [("di IS NULL", "DETAIL_MISSING"), ("li IS NULL", "LIST_MISSING"),
                                  ("li = di AND lc IS DISTINCT FROM dc", "COLLECTION_ID_DIFFERS"),
                                  ("li = di AND lp IS DISTINCT FROM dp", "PARENT_RECORD_ID_DIFFERS")], "'record'", "id", "j"))
def list_vs_detail(m):
    return P.list_vs_detail(m.records.filter("snapshot_id = 's1'"), m.records.filter("snapshot_id = 's2'").withColumn("snapshot_id", F.lit("s1")),
                            ["collection_id", "parent_record_id"])


@query("c07_truncation_limits", """SELECT 's1' AS snapshot_id, CAST(user_id AS VARCHAR) AS scope, arg_min(CASE WHEN event_id % 2 = 0 THEN props ELSE 'query result limit reached' END, event_id) AS reason
FROM events WHERE event_type = 'error' GROUP BY 2""")
def truncation(m):
    return P.truncation_limits(m.read("events").select(
        F.lit("s1").alias("snapshot_id"), text("user_id").alias("scope"), F.col("event_id").alias("page_no"),
        F.when(F.col("event_type") == "error", "incomplete").alias("status_type"),
        F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(" ").alias("status_reason"))).drop("limitation")


def ledger(m, scope):
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "FAILED_ATTEMPT").when(kind == "click", "WRITE_FAILED").otherwise("SUCCESS")
    return m.read("events").select(scope.alias("snapshot_id"), (F.col("event_id") + 1).alias("sequence"), outcome.alias("outcome"),
                                   (F.col("event_id") % 2 == 0).alias("retrying"))


@query("c08_ledger_summary", """SELECT CAST(user_id AS VARCHAR) AS snapshot_id, count(*) AS attempts, count(*) FILTER (WHERE event_type NOT IN ('error', 'click')) AS successful_responses,
  count(*) FILTER (WHERE event_type IN ('error', 'click')) AS failed_attempts, count(*) FILTER (WHERE event_type = 'error' AND event_id % 2 = 0) AS retried_attempts FROM events GROUP BY 1""")
def summary(m):
    return P.ledger_summary(ledger(m, text("user_id")))


LEDGER = """lg AS (SELECT snapshot_id, event_id + 1 AS sequence, event_id % 2 = 0 AS retrying,
  CASE WHEN bad AND event_id % 101 = 0 THEN 'PENDING' WHEN event_type = 'error' THEN 'FAILED_ATTEMPT' ELSE 'SUCCESS' END AS outcome
  FROM events, snaps WHERE NOT (bad AND event_id % 97 = 0)),
run AS (SELECT snapshot_id, count(*) AS a, count(*) FILTER (WHERE event_type <> 'error') AS s, count(*) FILTER (WHERE event_type = 'error') AS f,
  count(*) FILTER (WHERE event_type = 'error' AND event_id % 2 = 0) AS r FROM events, snaps GROUP BY 1),
got AS (SELECT snapshot_id, count(*) AS ga, count(*) FILTER (WHERE outcome = 'SUCCESS') AS gs, count(*) FILTER (WHERE outcome <> 'SUCCESS') AS gf,
  count(*) FILTER (WHERE outcome = 'FAILED_ATTEMPT' AND retrying) AS gr FROM lg GROUP BY 1),
cmp AS (SELECT * FROM run JOIN got USING (snapshot_id))
---
"""
CONTIGUITY = [("'SEQUENCE_GAP'", "'ledger'", "sequence", "NULL", "lg a WHERE sequence > 1 AND NOT EXISTS (SELECT 1 FROM lg b WHERE b.snapshot_id = a.snapshot_id AND b.sequence = a.sequence - 1)"),
              ("'UNRESOLVED_OUTCOME'", "'ledger'", "sequence", "outcome", "lg WHERE outcome = 'PENDING'"),
              ("'ATTEMPTS_DIFFERS'", "'run'", "snapshot_id", "NULL", "cmp WHERE a <> ga"),
              ("'SUCCESSFUL_RESPONSES_DIFFERS'", "'run'", "snapshot_id", "NULL", "cmp WHERE s <> gs"),
              ("'FAILED_ATTEMPTS_DIFFERS'", "'run'", "snapshot_id", "NULL", "cmp WHERE f <> gf"),
              ("'RETRIED_ATTEMPTS_DIFFERS'", "'run'", "snapshot_id", "NULL", "cmp WHERE r <> gr")]


def damaged_ledger(m):
    """(ledger, run record): the ledger of s2 has gaps and unresolved outcomes its run record does not know of."""
    key, failed = F.col("event_id"), F.col("event_type") == "error"
    rows = m.both("events")
    run = rows.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("attempts"), F.count_if(~failed).alias("successful_responses"),
                                          F.count_if(failed).alias("failed_attempts"), F.count_if(failed & (key % 2 == 0)).alias("retried_attempts"))
    outcome = F.when(F.col("bad") & (key % 101 == 0), "PENDING").when(failed, "FAILED_ATTEMPT").otherwise("SUCCESS")
    kept = rows.filter(~(F.col("bad") & (key % 97 == 0))).select("snapshot_id", (key + 1).alias("sequence"), outcome.alias("outcome"),
                                                                 (key % 2 == 0).alias("retrying"))
    return kept, run


@query("c09_ledger_contiguity", LEDGER + findings("ledger_contiguity", *CONTIGUITY))
def contiguity(m):
    return P.ledger_contiguity(*damaged_ledger(m))


@query("c10_required_membership", """SELECT o_orderkey, o_orderkey + CASE WHEN o_custkey % 13 = 0 THEN 1 ELSE 0 END AS from_key, o_orderkey * 7 + 3 AS to_key FROM orders WHERE o_custkey % 13 = 0""")
def membership(m):
    key = F.col("o_orderkey")
    links = m.read("orders").select("o_orderkey", (key + F.when(F.col("o_custkey") % 13 == 0, 1).otherwise(0)).alias("from_key"), (key * 7 + 3).alias("to_key"))
    return P.required_membership(links, "o_orderkey", ["from_key", "to_key"])
