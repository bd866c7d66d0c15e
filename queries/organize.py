"""Organized view (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.columns import plain_name
from queries.mapping import Tables
from queries.registry import findings, query
from sealcheck.operators import organize as O



def clean(m):
    """The tables of the undamaged snapshot, as only a verified archive is organized."""
    def table(name):
        return lambda: m.tables[name].filter("snapshot_id = 's1'")

    return Tables({name: table(name) for name in m.tables})




def component(name: str, identifier: str) -> str:
    """SQL of a path component for names that need no byte cut and are not reserved, as all names here."""
    return f"({plain_name(name)} || '--' || substr(substr({identifier}, 4), 1, 16))"


TREE = """ws AS (SELECT * FROM workspaces WHERE snapshot_id = 's1'), co AS (SELECT * FROM containers WHERE snapshot_id = 's1'),
cl AS (SELECT * FROM collections WHERE snapshot_id = 's1'), rd AS (SELECT * FROM records WHERE snapshot_id = 's1'),
cv AS (SELECT c.snapshot_id, c.id, c.kind, c.name, c.workspace_id, c.parent_id, c.source_provider, c.source_type, c.source_id, c.source_raw_path,
  p.kind AS parent_kind, p.name AS parent_name, p.source_id AS parent_source_id FROM co c LEFT JOIN co p ON p.id = c.parent_id),
clv AS (SELECT x.snapshot_id, x.id, x.name, x.workspace_id, x.container_id, x.source_provider, x.source_type, x.source_id, x.source_raw_path,
  cv.kind AS container_kind, cv.name AS container_name, cv.parent_id, cv.parent_kind, cv.parent_name FROM cl x JOIN cv ON cv.id = x.container_id),
rv AS (SELECT r.snapshot_id, r.id, r.kind, r.title, r.workspace_id, r.collection_id, r.parent_record_id, r.source_provider, r.source_type, r.source_id, r.source_raw_path,
  clv.name AS collection_name, clv.container_id, clv.container_kind, clv.container_name, clv.parent_id, clv.parent_kind, clv.parent_name FROM rd r JOIN clv ON clv.id = r.collection_id),
"""
ROOT = "(SELECT " + component("name", "id") + " FROM ws)"
PATHS = TREE + f"""cop AS (SELECT id, {ROOT} || '/' || CASE WHEN parent_kind IS NOT NULL THEN parent_kind || 's/' || {component('parent_name', 'parent_id')} || '/' ELSE '' END
  || kind || 's/' || {component('name', 'id')} AS dir FROM cv),
clp AS (SELECT cl.id, cop.dir || '/collections/' || {component('cl.name', 'cl.id')} AS dir FROM cl JOIN cop ON cop.id = cl.container_id),
rdp AS (SELECT rd.id, rd.collection_id, clp.dir || '/records/' || {component('rd.title', 'rd.id')} AS dir FROM rd JOIN clp ON clp.id = rd.collection_id),
vp AS (SELECT 's1' AS snapshot_id, 'workspaces' AS "table", id, {component('name', 'id')} || '/index.md' AS path FROM ws
  UNION ALL SELECT 's1', 'containers', id, dir || '/index.md' FROM cop UNION ALL SELECT 's1', 'collections', id, dir || '/index.md' FROM clp
  UNION ALL SELECT 's1', 'records', id, dir || '/record.md' FROM rdp),
"""
END = "fin AS (SELECT 1)\n---\n"


@query("h01_container_view", TREE + END + "SELECT * FROM cv")
def containers(m):
    return O.container_view(clean(m))


@query("h02_collection_view", TREE + END + "SELECT * FROM clv")
def collections(m):
    return O.collection_view(clean(m))


@query("h03_record_view", TREE + END + "SELECT * FROM rv")
def records(m):
    return O.record_view(clean(m))


@query("h04_view_paths", PATHS + END + "SELECT * FROM vp")
def paths(m):
    return O.view_paths(clean(m))


@query("h04_path_collisions", findings("view_paths", ("'PATH_COLLISION'", "'records'", "p", "n", """(SELECT snapshot_id, o_custkey || '/' || o_orderpriority || '/' || o_orderstatus AS p, count(*) AS n
  FROM orders, snaps GROUP BY ALL HAVING count(*) > 1)""")))
def collisions(m):
    """Orders named by customer, priority and status only, so that names collide."""
    return O.path_collisions(m.both("orders").select("snapshot_id", F.lit("records").alias("table"),
                                                     F.concat_ws("/", "o_custkey", "o_orderpriority", "o_orderstatus").alias("path")))


def esc(expression: str) -> str:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("`", "&#96;")):
        expression = f"replace({expression}, '{old}', '{new}')"
    return f"replace(replace({expression}, chr(13), ' '), chr(10), ' ')"


def meta(label: str, expression: str) -> str:
    return f"'* {label} = `' || {esc(expression)} || '`' || chr(10)"


def code(expression: str) -> str:
    return f"'    ' || replace(replace(replace({expression}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10), chr(10) || '    ') || chr(10)"


def item(number: int, section: str, record: str, keys: list[str], text: str, source: str) -> str:
    keys = keys + ["''"] * (3 - len(keys))
    return (f"SELECT 's1' AS snapshot_id, {record} AS record_id, {number} AS section_no, '{section}' AS section, "
            + ", ".join(f"{k} AS k{n}" for n, k in enumerate(keys, 1)) + f", {text} AS text FROM {source}")


NL = "chr(10)"
ITEMS = {
    "tags": item(1, "tags", "record_id", ["lpad(CAST(position AS VARCHAR), 19, '0')", "name"], f"'* ' || {esc('name')} || ' (no. ' || position || ')' || {NL}", "record_tags WHERE snapshot_id = 's1'"),
    "people": item(2, "people", "record_id", ["role", "lpad(CAST(position AS VARCHAR), 19, '0')", "identity_id"],
                   f"'* ' || {esc('username')} || ' as ' || {esc('role')} || ' no. ' || position || {NL} || '  `' || identity_id || '`, at origin `' || {esc('i.source_id')} || '`, read from `' || {esc('i.source_raw_path')} || '`' || {NL}",
                   "record_identities r JOIN identities i ON i.snapshot_id = r.snapshot_id AND i.id = r.identity_id WHERE r.snapshot_id = 's1'"),
    "fields": item(3, "fields", "record_id", ["field_id"], f"{NL} || '### ' || {esc('d.name')} || {NL} || {NL} || {meta('field id here', 'field_id')} || {meta('sort of field', 'field_type')} || "
                   f"{meta('how to read it', 'v.semantics_state')} || {meta('id at origin', 'd.source_id')} || {meta('read from', 'd.source_raw_path')} || {code('observed_value_json')}",
                   "record_field_values v JOIN field_definitions d ON d.snapshot_id = v.snapshot_id AND d.id = v.field_id WHERE v.snapshot_id = 's1'"),
    "comments": item(4, "comments", "record_id", ["CASE WHEN date_created_source IS NULL THEN '1' ELSE '0' END", "coalesce(date_created_source, '')", "id"],
                     f"{NL} || '### Said in ' || id || {NL} || {NL} || {meta('id at origin', 'source_id')} || {meta('read from', 'source_raw_path')} || "
                     f"coalesce({meta('answers comment', 'parent_comment_id')}, '') || coalesce({meta('made', 'date_created_source')}, '') || {code('body_text')}",
                     "comments WHERE snapshot_id = 's1'"),
    "links": item(5, "links", "e", ["id"], f"'* `' || from_source_id || '` = ' || coalesce(from_record_id, 'outside') || ' -- ' || kind || ' --> `' || to_source_id || '` = ' || coalesce(to_record_id, 'outside') || {NL} || '  ' || "
                  f"resolution_state || ', link `' || id || '`, read from `' || source_raw_path || '`' || {NL}",
                  "(SELECT *, from_record_id AS e FROM relationships UNION ALL SELECT *, to_record_id FROM relationships WHERE to_record_id IS DISTINCT FROM from_record_id) WHERE snapshot_id = 's1' AND e IS NOT NULL"),
    "attachments": item(6, "attachments", "record_id", ["id"], f"'* ' || {esc('filename')} || ' (' || media_type || '): ' || download_status || ', sum `' || checksum || '`' || {NL} || '  `' || id || '`, at origin `' || source_id || '`, "
                        f"read from `' || source_raw_path || '`' || {NL}", "attachments WHERE snapshot_id = 's1'")}
HEADER = item(0, "record", "id", [], f"'# ' || {esc('title')} || {NL} || {NL} || {meta('is a', 'kind')} || {meta('id here', 'id')} || {meta('type at origin', 'source_type')} || {meta('id at origin', 'source_id')} || "
              f"{meta('read from', 'source_raw_path')} || coalesce({meta('inside record', 'parent_record_id')}, '') || coalesce({meta('state', 'status')}, '') || "
              f"coalesce({meta('urgency', 'priority')}, '') || coalesce({meta('made', 'date_created_source')}, '')", "records WHERE snapshot_id = 's1'")
SECTION_FUNCTIONS = {"tags": O.record_tags_section, "people": O.record_people_section, "fields": O.record_fields_section,
                     "comments": O.record_comments_section, "links": O.record_links_section, "attachments": O.record_attachments_section}


def section_query(name: str):
    @query(f"h05_record_{name}_section", ITEMS[name])
    def section(m):
        return SECTION_FUNCTIONS[name](clean(m)).withColumn("section_no", F.col("section_no").cast("long"))
    return section


for _name in ITEMS:
    section_query(_name)

HEADINGS = {1: "Labels', 2", 2: "Who', 2", 3: "Values of fields', 1", 4: "Talk', 1", 5: "Ties', 2", 6: "Files', 2"}
HEADING = "CASE section_no " + " ".join(f"WHEN {n} THEN chr(10) || '## {v.split(chr(39))[0]}' || repeat(chr(10), {v[-1]})" for n, v in HEADINGS.items()) + " END"


DOCUMENTS = PATHS + "items AS (" + " UNION ALL ".join(ITEMS.values()) + f"""),
blk AS ({HEADER} UNION ALL SELECT DISTINCT snapshot_id, record_id, section_no, section, '', '', '', {HEADING} FROM items UNION ALL SELECT * FROM items),
doc AS (SELECT record_id, string_agg(text, '' ORDER BY section_no, k1, k2, k3) AS content FROM blk GROUP BY 1)
---
SELECT 's1' AS snapshot_id, rdp.collection_id, record_id, rdp.dir || '/record.md' AS path, 0 AS part, sha256(content) AS content FROM doc JOIN rdp ON rdp.id = doc.record_id"""


@query("h06_record_documents", DOCUMENTS)
def documents(m):
    return O.record_documents(clean(m)).withColumn("content", F.sha2("content", 256))


@query("h06_index_documents", PATHS + f"""ent AS (SELECT id, 'Workspace' AS label, name, NULL AS aid, NULL AS asrc, source_type, source_id, source_raw_path FROM ws
  UNION ALL SELECT id, upper(kind[1]) || kind[2:], name, CASE WHEN parent_kind IS NOT NULL THEN parent_id END, parent_source_id, source_type, source_id, source_raw_path FROM cv
  UNION ALL SELECT cl.id, 'Collection', cl.name, cl.container_id, co.source_id, cl.source_type, cl.source_id, cl.source_raw_path FROM cl JOIN co ON co.id = cl.container_id)
---
SELECT vp.snapshot_id, vp."table", vp.id, vp.path, '# ' || {esc('name')} || chr(10) || chr(10) || {meta('is a', 'label')} || {meta('id here', 'ent.id')} || {meta('type at origin', 'source_type')} ||
  {meta('id at origin', 'source_id')} || {meta('read from', 'source_raw_path')} || coalesce({meta('inside', 'aid')}, '') || coalesce({meta('inside, at origin', 'asrc')}, '') AS content
FROM vp JOIN ent ON ent.id = vp.id WHERE vp."table" <> 'records'""")
def index_documents(m):
    return O.index_documents(clean(m))


COPIES = PATHS + f"""att AS (SELECT a.*, rdp.dir || '/attachments/' || {component("regexp_replace(filename, '[.][^.]*$', '')", 'a.id')} || regexp_extract(filename, '[.][^.]*$') AS path
  FROM attachments a JOIN rdp ON rdp.id = a.record_id WHERE a.snapshot_id = 's1'),
"""


@query("h08_attachment_copy_plan", COPIES + END + """SELECT snapshot_id, id, source_provider, source_type, source_id, source_raw_path, local_path AS source_path, checksum, path,
  CASE WHEN download_status <> 'RETRIEVED' THEN 'UNRESOLVED' END AS problem FROM att""")
def copy_plan(m):
    return O.attachment_copy_plan(clean(m))


@query("h07_provenance_index", COPIES + """ent AS (SELECT id, source_provider, source_type, source_id, source_raw_path FROM ws UNION ALL SELECT id, source_provider, source_type, source_id, source_raw_path FROM co
  UNION ALL SELECT id, source_provider, source_type, source_id, source_raw_path FROM cl UNION ALL SELECT id, source_provider, source_type, source_id, source_raw_path FROM rd)
---
SELECT vp.snapshot_id, vp.path, vp.id AS portable_id, source_provider, source_type, source_id, source_raw_path, NULL AS attachment_checksum FROM vp JOIN ent ON ent.id = vp.id
UNION ALL SELECT snapshot_id, 'README.md', id, source_provider, source_type, source_id, source_raw_path, NULL FROM ws
UNION ALL SELECT snapshot_id, path, id, source_provider, source_type, source_id, source_raw_path, checksum FROM att WHERE download_status = 'RETRIEVED'""")
def provenance(m):
    return O.provenance_index(clean(m))


@query("h09_publishable", """vb AS (SELECT o_orderkey AS snapshot_id, o_orderstatus AS st, o_custkey AS c FROM orders)
---
SELECT CAST(snapshot_id AS VARCHAR) AS snapshot_id, CASE st WHEN 'F' THEN 'VERIFIED' ELSE 'VERIFIED_WITH_LIMITATIONS' END AS result, 'c' || c AS manifest_checksum FROM vb WHERE st <> 'P' AND c % 7 <> 0 AND c % 5 <> 0""")
def publishable(m):
    status, customer = F.col("o_orderstatus"), F.col("o_custkey")
    result = F.when(status == "F", "VERIFIED").when(status == "O", "VERIFIED_WITH_LIMITATIONS").otherwise("FAILED")
    rows = m.read("orders").select(F.col("o_orderkey").cast("string").alias("snapshot_id"), result.alias("result"), customer.alias("c"))
    before = rows.withColumn("manifest_checksum", F.concat(F.lit("c"), "c"))
    customer = F.col("c")
    after = rows.withColumn("manifest_checksum", F.when(customer % 7 == 0, "changed").otherwise(F.concat(F.lit("c"), "c"))).withColumn(
        "result", F.when(customer % 5 == 0, "INCOMPLETE").otherwise(F.col("result")))
    return O.publishable(before.drop("c"), after.drop("c"))
