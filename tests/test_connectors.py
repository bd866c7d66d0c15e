"""Both connectors on small landed responses, the registry, and version refusal."""

import json
import re

import pytest
from pyspark.sql import functions as F

from sealcheck import connectors
from sealcheck.connectors import clickup, notion
from sealcheck.operators import normalize as N
from sealcheck.sources import evidence as E
from tests import archive


def test_first_connector(spark, tmp_path):
    archive.land(str(tmp_path))
    tables, problems, *_ = archive.normalized(spark, str(tmp_path))
    assert problems.collect() == []
    records = {r.source_id: r for r in tables["records"].collect()}
    assert records["hole"].parent_record_id == records["rose"].id and records["depth"].parent_record_id == records["hole"].id
    assert len({records[r].collection_id for r in ("rose", "hole", "depth")}) == 1 != records["rake"].collection_id
    assert records["rose"].date_created_source == "1600" and records["rose"].points == 2.25 and records["hole"].priority == "low"
    comments = {r.source_id: r for r in tables["comments"].collect()}
    assert comments["r"].record_id == records["hole"].id and comments["q"].body_text == "How deep?"
    assert comments["r"].parent_comment_id == comments["q"].id
    roles = [(r.role, r.position) for r in tables["record_identities"].orderBy("role", "position").collect()]
    assert roles == [("assignee", 0), ("assignee", 1), ("creator", 0), ("watcher", 0)]
    assert tables["identities"].count() == 2 and [r.name for r in tables["record_tags"].orderBy("position").collect()] == ["thorns", "sun"]
    attachment = tables["attachments"].first()
    assert (attachment.download_status, attachment.source_url) == ("PENDING", "https://files/plan")
    assert {(r.kind, r.source_id, r.resolution_state) for r in tables["relationships"].collect()} == {
        ("task_dependency", "hole->rake", "RESOLVED"), ("task_link", "rake<->rose", "RESOLVED")}
    values = {r.observed_value_json for r in tables["record_field_values"].collect()}
    assert values == {'"clay"', '["red","white"]', "null"}
    verdicts = connectors.field_verdicts("clickup", tables["record_field_values"], tables["field_definitions"])
    assert {r.verdict for r in verdicts.collect()} == {"VALID"}


def test_evidence_findings(spark, tmp_path):
    archive.land(str(tmp_path))
    raw = tmp_path / "healthy" / "raw"
    (raw / "lists-g.json").unlink()
    (raw / "top.json").write_bytes((raw / "top.json").read_bytes().replace(b'"Garden"', b'"Barren"'))
    ledger = json.loads((raw / "requests.json").read_text())
    ledger[2]["raw_path"] = "../up.json"
    (raw / "requests.json").write_text(json.dumps(ledger))
    responses, found = E.read_evidence(spark, str(tmp_path))
    assert {(r.code, r.key) for r in found.collect()} == {("BODY_MISSING", "lists-g.json"), ("CHECKSUM_DIFFERS", "top.json"), ("PATH_UNSAFE", "../up.json")}
    assert responses.count() == len(archive.BODIES) - 3


def test_newer_inventory_is_refused(spark, tmp_path):
    archive.land(str(tmp_path))
    path = tmp_path / "healthy" / "raw" / "inventory.json"
    path.write_text(json.dumps(json.loads(path.read_text()) | {"schema_version": 3}))
    readable, refused = E.read_inventory(spark, str(tmp_path))
    assert readable.count() == 0 and refused.count() == 1


def listing(results):
    return json.dumps({"results": results, "has_more": False})


def test_second_connector(spark):
    properties = {"Name": {"id": "p1", "type": "title", "title": {}}, "Kind": {"id": "p2", "type": "select", "select": {"options": [{"name": "A"}]}}}
    page = {"object": "page", "id": "pg", "archived": False, "in_trash": True, "created_time": "t1", "last_edited_time": "t2",
            "properties": {"Name": {"type": "title", "title": [{"plain_text": " My "}, {"plain_text": "page"}]}, "Kind": {"type": "select", "select": {"name": "B"}}, "Odd": {}}}
    def block(name, kind, body):
        return {"object": "block", "id": name, "type": kind, kind: body}
    responses = [
        (1, "get database", "/databases/db", "db.json", json.dumps({"title": [{"plain_text": "Base"}]})),
        (2, "get data source", "/data_sources/ds", "ds.json", json.dumps({"name": "Rows", "properties": properties})),
        (3, "query data source", "/data_sources/ds/query", "q.json", listing([page])),
        (4, "get block children", "/blocks/pg/children", "b1.json", listing([block("b1", "paragraph", {"rich_text": [{"plain_text": "hello"}]})])),
        (5, "get block children", "/blocks/b1/children", "b2.json", listing([block("b2", "image", {"caption": [{"plain_text": "cap"}]})]))]
    frame = spark.createDataFrame([("s", *r) for r in responses], "snapshot_id string, sequence long, operation string, path string, raw_path string, body string")
    index = spark.createDataFrame([
        ("s", "workspace", "w", None, None, False), ("s", "database", "db", None, None, False), ("s", "data_source", "ds", "database", "db", False),
        ("s", "property", "ds/p1", "data_source", "ds", False), ("s", "property", "ds/p2", "data_source", "ds", False), ("s", "page", "pg", "data_source", "ds", False),
        ("s", "block", "b1", "page", "pg", False), ("s", "block", "b2", "block", "b1", False)],
        "snapshot_id string, type string, id string, parent_type string, parent_id string, composite boolean")
    workspaces = spark.createDataFrame([("s", "w", "Space")], "snapshot_id string, workspace_source_id string, workspace_name string")
    tables, problems = notion.normalize(frame, index, workspaces)
    assert problems.collect() == []
    records = {r.source_id: r for r in tables["records"].collect()}
    assert (records["pg"].title, records["pg"].archived) == ("My page", True)
    assert (records["b1"].text_content, records["b2"].text_content) == ("hello", "cap")
    assert records["b2"].parent_record_id == records["b1"].id and records["b2"].collection_id == records["pg"].collection_id
    definitions = {r.name: r for r in tables["field_definitions"].collect()}
    assert definitions["Kind"].source_id == "ds/p2" and json.loads(definitions["Kind"].definition_json)["id"] == "ds/p2"
    verdicts = {r.field_id: r.verdict for r in connectors.field_verdicts("notion", tables["record_field_values"], tables["field_definitions"]).collect()}
    assert verdicts == {definitions["Kind"].id: "INVALID", definitions["Name"].id: "UNPROVEN"}


def test_unknown_connector(spark):
    with pytest.raises(KeyError):
        connectors.normalizer("nobody")
    values = spark.createDataFrame([("s", "r", "f", "1", "OBSERVED_ONLY")], "snapshot_id string, record_id string, field_id string, observed_value_json string, semantics_state string")
    assert connectors.field_verdicts("nobody", values, values).first().verdict == "UNPROVEN"
    assert connectors.names() == ["clickup", "notion"]
    assert connectors.declared_capabilities("notion", spark.createDataFrame([("s",)], "snapshot_id string")).filter(F.col("availability") != "UNKNOWN").count() == 0


def test_bodies_are_parsed_once(spark, tmp_path):
    """Tables are read from what was parsed, not from bodies, and agree with tables taken alone."""
    archive.land(str(tmp_path))
    responses, _ = E.read_evidence(spark, str(tmp_path))
    header, index = E.read_source_objects(spark, str(tmp_path))
    workspaces = E.read_runs(spark, str(tmp_path)).selectExpr("snapshot_id", "workspace_id AS workspace_source_id", "workspace_name")
    tables, _ = clickup.normalize(responses, index, workspaces)
    for name in ("records", "identities", "record_identities", "record_tags", "comments", "relationships", "attachments"):
        plan = tables[name]._jdf.queryExecution().optimizedPlan().toString()
        assert not re.search(r"(?<![a-z_])(body|content)#", plan), name
    details, _ = N.record_details(responses, clickup.VOCABULARY)
    alone = N.observed_people(details)
    assert {(r.record, r.role, r.position, r.person_id) for r in alone.collect()} == {
        ("rose", "creator", 0, "31"), ("rose", "assignee", 0, "32"), ("rose", "assignee", 1, "31"), ("rake", "watcher", 0, "32")}
    assert N.normalize_roles(alone, clickup.VOCABULARY).count() == tables["record_identities"].count() == 4


@pytest.mark.parametrize("table", ["records", "comments"])
def test_parsed_bodies_are_not_broadcast(spark, table):
    from queries.normalize import VOCABULARY
    index = spark.createDataFrame([("s", "customer", "c", None, None, False), ("s", "order", "1", "customer", "c", False), ("s", "turn", "t", "order", "1", False)],
                                  "snapshot_id string, type string, id string, parent_type string, parent_id string, composite boolean")
    owner = spark.createDataFrame([("s", "w1")], "snapshot_id string, workspace_source_id string")
    operation, body = {"records": ("get record", '{"id":"1","name":"One"}'), "comments": ("list turns", '{"comments":[{"id":"t","comment_text":"hi"}]}')}[table]
    responses = spark.createDataFrame([("s", 1, operation, "x.json", body)], "snapshot_id string, sequence long, operation string, raw_path string, body string")
    if table == "records":
        normalized, found = N.normalize_records(index, N.record_details(responses, VOCABULARY)[0], owner, VOCABULARY)
    else:
        normalized, found = N.normalize_comments(index, N.observed_comments(responses, VOCABULARY)[0], owner, VOCABULARY)
    joins = [re.findall(r"(\w+Join) \[snapshot_id#\d+, id#\d+\], \[snapshot_id#\d+, id#\d+\], (?:Inner|LeftOuter)", frame._jdf.queryExecution().sparkPlan().toString())
             for frame in (normalized, found)]
    # The outermost join of each is that with the bodies.
    assert [names[0] for names in joins] == ["SortMergeJoin", "SortMergeJoin"]
    assert [r.source_id for r in normalized.collect()] == ["1" if table == "records" else "t"] and found.collect() == []


def test_people_are_made_once_for_identities_and_findings(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(path):
        made.add(1)
        return path

    rows = [("s1", "p1", "a", None, "raw/1"), ("s1", "p1", "b", None, "raw/2"), ("s1", "p2", "c", "c@x", "raw/3"), ("s1", " ", "d", None, "raw/4")]
    people = spark.createDataFrame(rows, "snapshot_id string, person_id string, username string, email string, path string")
    people = people.select("snapshot_id", "person_id", "username", "email", F.udf(seen, "string").asNondeterministic()("path").alias("raw_path"))
    table, found = N.normalize_identities(people, clickup.VOCABULARY)
    assert {(r.source_id, r.username, r.source_raw_path) for r in table.collect()} == {("p1", "a", "raw/1"), ("p2", "c", "raw/3")}
    assert {(r.code, r.key) for r in found.collect()} == {("CONFLICTING_METADATA", "p1"), ("INVALID_ID", "raw/4")}
    assert made.value == len(rows)
