"""A healthy archive of a garden club: a folder level, two lists, records three levels deep, a labels field and both kinds of link."""

import hashlib
import json
import os

from pyspark.sql import functions as F

from sealcheck import connectors
from sealcheck.connectors import clickup
from sealcheck.operators.seal import capability_digest, logical_digest, read_inventory_counts
from sealcheck.plans.seal import seal
from sealcheck.plans.verify import Sealed
from sealcheck.sources import evidence as E

IRIS, OLE = {"id": 31, "username": "iris"}, {"id": 32, "username": "ole", "email": "ole@garden"}
BODIES = [
    ("list Spaces", "top.json", {"spaces": [{"id": "g", "name": "Garden"}]}),
    ("list Folders", "folders-g.json", {"folders": [{"id": "spring", "name": "Spring"}]}),
    ("list Lists in Folder", "lists-spring.json", {"lists": [{"id": "beds", "name": "Beds"}]}),
    ("list folderless Lists", "lists-g.json", {"lists": [{"id": "shed", "name": "Shed"}]}),
    ("list Custom Fields", "fields-beds.json", {"fields": [
        {"id": "soil", "name": "Soil", "type": "drop_down", "type_config": {"options": [{"id": "sand", "name": "Sand", "orderindex": 0}, {"id": "clay", "name": "Clay", "orderindex": 1}]}},
        {"id": "hue", "name": "Hue", "type": "labels", "type_config": {"options": [{"id": "red", "label": "Red"}, {"id": "white", "label": "White"}]}}]}),
    ("get Task inventory details", "rose.json", {
        "id": "rose", "name": "Plant roses", "status": {"status": "dug", "type": "custom"}, "date_created": "1600", "points": 2.25, "creator": IRIS, "assignees": [OLE, IRIS],
        "tags": [{"name": "thorns"}, {"name": "sun"}], "custom_fields": [{"id": "soil", "value": "clay"}, {"id": "hue", "value": ["red", "white"]}],
        "linked_tasks": [{"task_id": "rose", "link_id": "rake"}]}),
    ("get Task inventory details", "hole.json", {"id": "hole", "name": "Dig a hole", "priority": {"priority": "low"}, "attachments": [
        {"id": "plan", "title": "plan.txt", "size": 5, "url": "https://files/plan?key=9"}]}),
    ("get Task inventory details", "depth.json", {"id": "depth", "name": "Measure its depth", "custom_fields": [{"id": "hue", "value": None}]}),
    ("get Task inventory details", "rake.json", {"id": "rake", "name": "Mend the rake", "watchers": [OLE], "dependencies": [{"task_id": "hole", "depends_on": "rake"}],
                                                 "linked_tasks": [{"task_id": "rake", "link_id": "rose"}]}),
    ("list Task comments", "talk-hole.json", {"comments": [{"id": "q", "date": "5", "user": OLE, "comment": [{"text": "How "}, {"text": "deep?"}]}]}),
    ("list threaded comment replies", "talk-q.json", {"comments": [{"id": "r", "date": "6", "user": IRIS, "comment_text": "Two spades"}]})]
OBJECTS = [("workspace", "w1", None, None), ("space", "g", "workspace", "w1"), ("folder", "spring", "space", "g"), ("list", "beds", "folder", "spring"), ("list", "shed", "space", "g"),
           ("task", "rose", "list", "beds"), ("subtask", "hole", "task", "rose"), ("subtask", "depth", "subtask", "hole"), ("task", "rake", "list", "shed"),
           ("comment", "q", "subtask", "hole"), ("comment", "r", "comment", "q"), ("attachment", "plan", "subtask", "hole"), ("custom_field", "soil", None, None),
           ("custom_field", "hue", None, None), ("relationship.task_dependency", "hole->rake", "task", "rake"), ("relationship.task_link", "rake<->rose", "task", "rake")]
COUNTS = {"containers": 2, "collections": 2, "records": 4, "nested_records": 2, "comments": 2, "attachments": 1, "custom_fields": 2,
          "relationships": 2, "container_kinds": {"space": 1, "folder": 1}, "record_kinds": {"task": 2, "subtask": 2}}
FILE = b"12345"


def sha(content: bytes) -> str:
    return "sha256:" + hashlib.sha256(content).hexdigest()


def land(root: str, snapshot: str = "healthy") -> None:
    """Write run record, inventory, ledger and bodies of one snapshot."""
    raw = os.path.join(root, snapshot, "raw")
    os.makedirs(raw)
    ledger = []
    for number, (operation, name, body) in enumerate(BODIES, 1):
        content = json.dumps(body).encode()
        with open(os.path.join(raw, name), "wb") as file:
            file.write(content)
        ledger.append({"sequence": number, "operation": operation, "method": "GET", "path": "/x", "attempt": 1, "status_code": 200, "outcome": "SUCCESS",
                       "raw_path": name, "bytes": len(content), "sha256": sha(content)})
    run = {"schema_version": 2, "kind": "raw_extraction_run", "status": "COMPLETE", "connector": "clickup", "source": {"workspace_id": "w1", "workspace_name": "W"},
           "started_at": "2024-01-01T00:00:00Z", "finished_at": "2024-01-01T00:01:00Z", "source_consistency": {"atomic": False, "note": "n"},
           "requests": {"attempts": len(ledger), "successful_responses": len(ledger), "failed_attempts": 0, "retried_attempts": 0}}
    objects = [{"type": t, "id": i, "composite": t.startswith("relationship."), **({"parent_type": pt, "parent_id": p} if pt else {})} for t, i, pt, p in OBJECTS]
    inventory = {"schema_version": 2, "kind": "raw_source_inventory", "connector": "clickup", "workspace_id": "w1", "counts": COUNTS, "source_objects": objects}
    for name, document in (("run.json", run), ("inventory.json", inventory), ("requests.json", ledger)):
        with open(os.path.join(raw, name), "w") as file:
            json.dump(document, file)


def normalized(spark, root: str):
    """(tables, findings, index, header, workspaces) of the landed snapshots."""
    responses, found = E.read_evidence(spark, root)
    header, index = E.read_source_objects(spark, root)
    workspaces = E.read_runs(spark, root).select("snapshot_id", F.col("workspace_id").alias("workspace_source_id"), "workspace_name")
    tables, problems = clickup.normalize(responses, index, workspaces)
    return tables, found.unionByName(problems), index, header, workspaces


def sealed(spark, root: str) -> Sealed:
    tables, problems, index, header, _ = normalized(spark, root)
    snapshots = header.select("snapshot_id")
    landed = tables["attachments"].select("snapshot_id", F.col("id").alias("attachment_id"), F.concat(F.lit("attachments/"), "id", F.lit(".txt")).alias("path"),
                                          F.lit(len(FILE)).cast("long").alias("bytes"), F.lit(sha(FILE)).alias("checksum"), F.lit(False).alias("has_secret"))
    expected = read_inventory_counts(header)
    declared = connectors.observe(connectors.declared_capabilities("clickup", snapshots), [c[0] for c in clickup.CAPABILITIES if c[0] != "attachment_content"])
    settled, manifest = seal(tables, landed, expected, declared, snapshots)
    digests = logical_digest(index).select("snapshot_id", F.col("digest").alias("logical_digest")).join(
        capability_digest(declared).select("snapshot_id", F.col("digest").alias("capability_digest")), "snapshot_id")
    head = digests.join(manifest.status, "snapshot_id").select(
        "snapshot_id", F.lit(3).alias("schema_version"), F.lit("clickup").alias("connector"), F.lit("w1").alias("workspace_id"),
        F.col("archive_status").alias("status"), F.lit("NOT_RUN").alias("verification_status"), F.lit(1).alias("capability_schema_version"), F.lit(False).alias("atomic"),
        "logical_digest", "capability_digest", F.lit("1").alias("writer_version"), F.lit("31").alias("extracted_by_id"))
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value")) for k, c in (
        ("connector", "connector"), ("source_workspace_id", "workspace_id"), ("source_snapshot_logical_digest", "logical_digest"), ("archive_status", "status"),
        ("writer_version", "writer_version"), ("archive_schema_version", "schema_version"), ("source_snapshot_atomic", "atomic"),
        ("verification_status", "verification_status"))])
    settled["archive_metadata"] = head.select("snapshot_id", F.explode(pairs).alias("p")).select("snapshot_id", "p.*")
    members = [n for _, n, _ in BODIES] + ["inventory.json"]
    files = snapshots.select("snapshot_id", F.explode(F.array(*[F.lit(p) for p in ["manifest.json", "schema.json", *["raw/" + n for n in members]]])).alias("path")).select(
        "snapshot_id", "path", F.lit(1).cast("long").alias("bytes"), F.lit("sha256:f").alias("checksum")).unionByName(landed.select("snapshot_id", "path", "bytes", "checksum"))
    readable = snapshots.select("snapshot_id", F.explode(F.array(F.lit("manifest"), F.lit("database"), F.lit("evidence"))).alias("input"), F.lit(True).alias("readable"))
    return Sealed("clickup", snapshots, settled, index, expected, files, head, files.filter("path <> 'manifest.json'"), manifest.attachments, manifest.inventory,
                  manifest.observed, manifest.discrepancies, manifest.capabilities, declared, E.read_runs(spark, root), E.read_ledger(spark, root), problems, digests, readable)
