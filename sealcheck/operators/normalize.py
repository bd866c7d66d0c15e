"""From landed response bodies and a source index to the portable tables.

Every operator returns (table, findings). A row that cannot be normalized is a finding; it is never dropped
silently and nothing is invented for it.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.functions.ids import DEFAULT_PREFIX, NUL, portable_id
from sealcheck.functions.jsonfn import (RawField, canonical_arrays, canonical_member, field_semantics_state, json_items, mistyped, priority_field, raw_bool,
                                        raw_double, raw_int, raw_scalar, raw_string, restored, rich_text, source_id,
                                        status_fields, stored, with_members)
from sealcheck.functions.text import is_blank, strip_url_query
from sealcheck.operators.findings import coded, finding, union_all, union_findings
from sealcheck.operators.pages import explode_pages, first_or_conflict
from sealcheck.operators.trees import resolve_ancestor
from sealcheck.schemas import portable_columns
from sealcheck.session import cut_lineage

Result = tuple[DataFrame, DataFrame]
KEY = ["snapshot_id", "id"]


@dataclass(frozen=True)
class Link:
    """A kind of relationship: the array that lists it and the members naming its endpoints."""

    kind: str
    array: str
    left: str
    right: str
    directed: bool = True


@dataclass(frozen=True)
class Vocabulary:
    """A connector's own names for the parts of the portable model."""

    provider: str
    named_pages: tuple[tuple[str, str, str], ...]  # (operation, array, source type)
    container_types: tuple[str, ...]
    collection_type: str
    record_types: tuple[str, ...]
    record_namespace: str
    detail_operation: str
    comment_operations: tuple[str, ...] = ()
    comment_type: str = "comment"
    attachment_type: str = "attachment"
    field_operation: str = ""
    field_type: str = "custom_field"
    person_type: str = "user"
    links: tuple[Link, ...] = ()
    prefix: str = DEFAULT_PREFIX

    def id_of(self, namespace, source) -> Column:
        namespace = F.lit(namespace) if isinstance(namespace, str) else namespace
        return portable_id(F.lit(self.provider), namespace, source, self.prefix)

    def workspace(self) -> Column:
        return self.id_of("workspace", F.col("workspace_source_id"))


def source_key(kind, identifier) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.concat(kind, F.lit(NUL), identifier)


def tail(vocabulary: Vocabulary, kind, identifier: Column, raw_path: Column, composite: bool = False) -> dict:
    return {"source_provider": F.lit(vocabulary.provider),
            "source_type": F.lit(kind) if isinstance(kind, str) else kind,
            "source_id": identifier, "source_raw_path": raw_path, "source_id_composite": F.lit(composite)}


def shaped(frame: DataFrame, table: str, values: dict) -> DataFrame:
    """Project to the declared columns of a portable table; columns without a value are null."""
    from sealcheck.schemas import portable_schema
    types = {field.name: field.dataType for field in portable_schema(table)}
    return frame.select("snapshot_id", *[
        values.get(name, F.lit(None)).cast(types[name]).alias(name) for name in portable_columns(table)])


def archive_path(raw_path: str = "raw_path") -> Column:
    return F.concat(F.lit("raw/"), F.col(raw_path))


def operation(responses: DataFrame, *names: str) -> DataFrame:
    return responses.filter(F.col("operation").isin(*names))


# --- source index

def build_source_index(entities: DataFrame, links: DataFrame, record_types: tuple[str, ...]) -> DataFrame:
    """Typed nodes with their parent; a link hangs on its first endpoint that exists.

    `entities` has (snapshot_id, type, id, parent_type, parent_id, composite), `links` has
    (snapshot_id, kind, id, from_id, to_id).
    """
    records = entities.filter(F.col("type").isin(*record_types)).select("snapshot_id", "id", "type")
    left = records.select("snapshot_id", F.col("id").alias("from_id"), F.col("type").alias("from_type"))
    right = records.select("snapshot_id", F.col("id").alias("to_id"), F.col("type").alias("to_type"))
    placed = links.join(left, ["snapshot_id", "from_id"], "left").join(right, ["snapshot_id", "to_id"], "left")
    on_from = F.col("from_type").isNotNull()
    nodes = placed.select(
        "snapshot_id", F.concat(F.lit("relationship."), "kind").alias("type"), "id",
        F.coalesce("from_type", "to_type", F.lit(record_types[0])).alias("parent_type"),
        F.when(on_from, F.col("from_id")).otherwise(F.col("to_id")).alias("parent_id"),
        F.lit(True).alias("composite"))
    return entities.select(*nodes.columns).unionByName(nodes)


def validate_source_index(index: DataFrame) -> DataFrame:
    """Empty type or id, repeated (type, id), half a parent reference, or a parent that is not indexed."""
    check = "source_index"
    blank_parent = F.coalesce("parent_type", F.lit("")) == ""
    blank_parent_id = F.coalesce("parent_id", F.lit("")) == ""
    seen = index.groupBy("snapshot_id", "type", "id").agg(F.count(F.lit(1)).alias("n"))
    parents = seen.select("snapshot_id", F.col("type").alias("parent_type"), F.col("id").alias("parent_id"))
    orphans = index.filter(~blank_parent & ~blank_parent_id).join(
        parents, ["snapshot_id", "parent_type", "parent_id"], "left_anti")
    return union_findings([
        coded(index, check, [(is_blank(F.col("type")) | is_blank(F.col("id")), "EMPTY_IDENTITY"),
                             (blank_parent != blank_parent_id, "HALF_PARENT")], F.col("type"), F.col("id")),
        finding(seen.filter("n > 1"), check, "DUPLICATE_OBJECT", F.col("type"), F.col("id"), F.col("n")),
        finding(orphans, check, "PARENT_NOT_INDEXED", F.col("type"), F.col("id"),
                F.concat_ws("/", "parent_type", "parent_id"))])


# --- named objects: containers and collections

def observed_names(responses: DataFrame, vocabulary: Vocabulary) -> Result:
    """First observed name and raw path per named object; repeats must agree on the name."""
    observed, findings = [], []
    for name, array, kind in vocabulary.named_pages:
        elements, missing = explode_pages(operation(responses, name), array)
        parsed, members = with_members(elements, "element", ["id", "name"], "named")
        observed.append(parsed.select("snapshot_id", F.lit(kind).alias("type"), source_id(members["id"]).alias("id"),
                                      raw_string(members["name"]).alias("name"), archive_path().alias("raw_path"),
                                      F.struct("sequence", "position").alias("seen")))
        findings.append(missing)
        findings.append(coded(parsed, "named_objects", [(source_id(members["id"]).isNull(), "INVALID_ID"),
                                                        (mistyped(members["name"], raw_string(members["name"])),
                                                         "INVALID_NAME")], kind, F.col("raw_path")))
    named = union_all(observed).filter("id IS NOT NULL")
    first = named.groupBy("snapshot_id", "type", "id").agg(
        F.min_by(F.struct("name", "raw_path"), "seen").alias("first"), F.min(F.struct("name")).alias("low"),
        F.max(F.struct("name")).alias("high"))
    conflicts = first.filter(~F.col("low").eqNullSafe(F.col("high")))
    findings.append(finding(conflicts, "named_objects", "CONFLICTING_NAME", F.col("type"), F.col("id")))
    return (first.select("snapshot_id", "type", "id", "first.name", "first.raw_path"), union_findings(findings))


def _indexed(index: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    return index.filter(F.col("type").isin(*kinds))


def normalize_containers(index: DataFrame, names: DataFrame, workspaces: DataFrame, vocabulary: Vocabulary) -> Result:
    """Containers in their tree. `workspaces` has (snapshot_id, workspace_source_id)."""
    joined = (_indexed(index, vocabulary.container_types).join(names, ["snapshot_id", "type", "id"], "left")
              .join(workspaces, "snapshot_id"))
    nested = F.col("parent_type").isin(*vocabulary.container_types)
    table = shaped(joined.filter("raw_path IS NOT NULL"), "containers", {
        "id": vocabulary.id_of(F.col("type"), F.col("id")), "kind": F.col("type"),
        "workspace_id": vocabulary.workspace(),
        "parent_id": F.when(nested, vocabulary.id_of(F.col("parent_type"), F.col("parent_id"))),
        "name": F.col("name"), **tail(vocabulary, F.col("type"), F.col("id"), F.col("raw_path"))})
    return table, finding(joined.filter("raw_path IS NULL"), "normalize_containers", "EVIDENCE_MISSING",
                          F.col("type"), F.col("id"))


def normalize_collections(index: DataFrame, names: DataFrame, workspaces: DataFrame, vocabulary: Vocabulary) -> Result:
    joined = (_indexed(index, (vocabulary.collection_type,)).join(names, ["snapshot_id", "type", "id"], "left")
              .join(workspaces, "snapshot_id"))
    contained = F.coalesce(F.col("parent_type").isin(*vocabulary.container_types), F.lit(False))
    table = shaped(joined.filter(F.col("raw_path").isNotNull() & contained), "collections", {
        "id": vocabulary.id_of(F.col("type"), F.col("id")), "workspace_id": vocabulary.workspace(),
        "container_id": vocabulary.id_of(F.col("parent_type"), F.col("parent_id")), "name": F.col("name"),
        **tail(vocabulary, F.col("type"), F.col("id"), F.col("raw_path"))})
    return table, coded(joined, "normalize_collections", [(F.col("raw_path").isNull(), "EVIDENCE_MISSING"),
                                                          (~contained, "UNSUPPORTED_PARENT")],
                        F.col("type"), F.col("id"))


# --- records

DATES = {"date_created_source": "date_created", "date_updated_source": "date_updated",
         "date_closed_source": "date_closed", "date_done_source": "date_done",
         "start_date_source": "start_date", "due_date_source": "due_date"}
RECORD_MEMBERS = ["name", "description", "text_content", "status", "priority", "archived", "time_estimate",
                  "time_spent", "points", *DATES.values()]
ROLES = (("creator", "creator", False), ("assignee", "assignees", True), ("watcher", "watchers", True))
# Arrays whose elements are read from the text of the body, and those that keep number literals and so are read in Python.
PLAIN_ARRAYS = [*[member for _, member, many in ROLES if many], "tags", "attachments"]
VALUES = "custom_fields"


def exact_arrays(vocabulary: Vocabulary) -> list[str]:
    return list(dict.fromkeys([VALUES, *[link.array for link in vocabulary.links]]))


def record_details(responses: DataFrame, vocabulary: Vocabulary, once: bool = False, wanted: Sequence[str] | None = None) -> Result:
    """One row per record with every member the portable tables take from its detail body; a repeated id is a finding.

    This is the only place a body is parsed: `m_<member>` holds text and kind of a member, `exact` the canonical elements
    of the arrays in `exact_arrays`. With `once` the rows are written, and all tables of a normalization are read from
    them; a table taken alone can name the only members `wanted`, the others then read as absent.
    """
    exact, plain = exact_arrays(vocabulary), [*RECORD_MEMBERS, *[member for _, member, many in ROLES if not many], *PLAIN_ARRAYS]
    taken = [name for name in (*plain, *exact) if wanted is None or name in wanted]
    parsed, members = with_members(operation(responses, vocabulary.detail_operation), "body", ["id", *taken], "head")
    holds, nothing = F.lit(False), F.lit(None).cast("string")
    for name in taken:
        holds |= (members[name].kind == "array") if name in exact else F.lit(False)
    items = canonical_arrays(F.when(holds, F.col("body")), F.array(*map(F.lit, exact)))

    def kept(name: str) -> Column:
        if name not in taken:
            return F.struct(nothing.alias("text"), F.lit("null").alias("kind"))
        return stored(members[name]) if name in plain else F.struct(nothing.alias("text"), members[name].kind.alias("kind"))

    detail = parsed.select(
        "snapshot_id", raw_scalar(members["id"]).alias("id"), archive_path().alias("raw_path"), "sequence",
        *[kept(name).alias(f"m_{name}") for name in (*plain, *exact)],
        items.alias("exact"))
    detail = cut_lineage(detail) if once else detail
    usable = detail.filter(~is_blank(F.col("id")))
    repeated = usable.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return usable, union_findings([
        finding(detail.filter(is_blank(F.col("id"))), "record_details", "INVALID_ID", "record", F.col("raw_path")),
        finding(repeated, "record_details", "DUPLICATE_DETAIL", "record", F.col("id"))])


def member(name: str) -> RawField:
    """A member of a record's body, as `record_details` holds it."""
    return restored(F.col(f"m_{name}"))


def unbroadcast(parsed: DataFrame) -> DataFrame:
    """Parsed bodies for a join with their index, of which they are as many: merged, whatever the optimizer takes them for.

    The generator that parses keeps the size of its input in the estimate, and the few columns taken from its wide row then
    count as a small part of that, so millions of bodies would be broadcast.
    """
    return parsed.hint("merge")


def record_collections(index: DataFrame, vocabulary: Vocabulary) -> Result:
    """Collection each record belongs to, by ancestry in the source index."""
    kinds = (*vocabulary.record_types, vocabulary.collection_type)
    nodes = _indexed(index, kinds).select(
        "snapshot_id", "type", source_key(F.col("type"), F.col("id")).alias("node"),
        source_key(F.col("parent_type"), F.col("parent_id")).alias("parent"))
    walked = resolve_ancestor(nodes, F.col("type") == vocabulary.collection_type)
    split = walked.withColumns({"type": F.split_part("node", F.lit(NUL), F.lit(1)),
                                "id": F.split_part("node", F.lit(NUL), F.lit(2))})
    records = split.filter(F.col("type").isin(*vocabulary.record_types))
    found = records.filter("outcome = 'FOUND'").select(
        "snapshot_id", "type", "id", F.split_part("ancestor", F.lit(NUL), F.lit(2)).alias("collection_source_id"))
    return found, finding(records.filter("outcome <> 'FOUND'"), "record_ancestry", F.col("outcome"),
                          F.col("type"), F.col("id"))


def normalize_records(index: DataFrame, details: DataFrame, workspaces: DataFrame, vocabulary: Vocabulary) -> Result:
    """Records with verbatim timestamps; a title is required."""
    collections, unplaced = record_collections(index, vocabulary)
    joined = (_indexed(index, vocabulary.record_types).join(collections, ["snapshot_id", "type", "id"], "left")
              .join(unbroadcast(details.drop("sequence")), KEY, "left").join(workspaces, "snapshot_id"))
    parsed, members = joined, {name: member(name) for name in RECORD_MEMBERS}
    status, status_type = status_fields(members["status"])
    values = {"title": raw_string(members["name"]), "description": raw_string(members["description"]),
              "text_content": raw_string(members["text_content"]), "status": status, "status_type": status_type,
              "priority": priority_field(members["priority"]), "archived": raw_bool(members["archived"]),
              "time_estimate_ms": raw_int(members["time_estimate"]), "time_spent_ms": raw_int(members["time_spent"]),
              "points": raw_double(members["points"])}
    dates = {column: raw_scalar(members[member]) for column, member in DATES.items()}
    nested = F.col("parent_type").isin(*vocabulary.record_types)
    seen = F.col("raw_path").isNotNull()
    table = shaped(parsed.filter(seen & F.col("collection_source_id").isNotNull()), "records", {
        **values, **dates, "id": vocabulary.id_of(vocabulary.record_namespace, F.col("id")), "kind": F.col("type"),
        "workspace_id": vocabulary.workspace(),
        "collection_id": vocabulary.id_of(vocabulary.collection_type, F.col("collection_source_id")),
        "parent_record_id": F.when(nested, vocabulary.id_of(vocabulary.record_namespace, F.col("parent_id"))),
        **tail(vocabulary, vocabulary.record_namespace, F.col("id"), F.col("raw_path"))})
    typed = [(members["description"], values["description"], "DESCRIPTION"),
             (members["text_content"], values["text_content"], "TEXT_CONTENT"),
             (members["archived"], values["archived"], "ARCHIVED"),
             (members["time_estimate"], values["time_estimate_ms"], "TIME_ESTIMATE"),
             (members["time_spent"], values["time_spent_ms"], "TIME_SPENT"), (members["points"], values["points"], "POINTS"),
             *[(members[m], dates[c], m.upper()) for c, m in DATES.items()]]
    rules = [(~seen, "DETAIL_MISSING"), (seen & values["title"].isNull(), "TITLE_MISSING"),
             (~members["status"].kind.isin("null", "object"), "STATUS_INVALID"),
             (~members["priority"].kind.isin("null", "object"), "PRIORITY_INVALID"),
             *[(mistyped(member, value), f"{code}_INVALID") for member, value, code in typed]]
    return table, union_findings([unplaced, coded(parsed, "normalize_records", rules, F.col("type"), F.col("id"))])


def _items(name: str, vocabulary: Vocabulary) -> Column:
    """The elements of an array member as JSON texts; null if it is none."""
    exact = exact_arrays(vocabulary)
    return F.get(F.col("exact"), F.lit(exact.index(name))) if name in exact else json_items(member(name).text)


def _elements(details: DataFrame, name: str, vocabulary: Vocabulary) -> tuple[DataFrame, DataFrame]:
    """(elements, findings) of one optional array of the detail bodies; one whose element is no JSON is a finding."""
    kind = member(name).kind
    exploded = details.filter(kind == "array").select(
        "snapshot_id", F.col("id").alias("record"), "raw_path", "sequence", F.posexplode(_items(name, vocabulary)).alias("position", "element"))
    wrong = finding(details.filter(~kind.isin("null", "array")), "record_details", "NOT_AN_ARRAY", name, F.col("id"))
    if name not in exact_arrays(vocabulary):
        return exploded, wrong
    unread = finding(exploded.filter("element IS NULL"), "record_details", "ELEMENT_NOT_JSON", name, F.concat_ws("#", "raw_path", "position"))
    return exploded.filter("element IS NOT NULL"), union_findings([wrong, unread])


def observed_people(details: DataFrame, roles=ROLES) -> DataFrame:
    """Every person a record names, with role and position, all roles in one pass."""
    def named(role: str, position: Column, person: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), position.cast("long").alias("position"), person.alias("person"))

    def each(role: str):
        return lambda person, position: named(role, position, person)

    none, lists = F.array().cast("array<struct<role:string,position:bigint,person:string>>"), []
    for role, name, many in roles:
        field = member(name)
        if many:
            found = F.transform(F.when(field.kind == "array", json_items(field.text)), each(role))
        else:
            found = F.when(field.kind == "object", F.array(named(role, F.lit(0), field.text)))
        lists.append(F.coalesce(found, none))
    people = details.select("snapshot_id", F.col("id").alias("record"), "raw_path", F.explode(F.concat(*lists)).alias("p")).select(
        "snapshot_id", "record", "raw_path", "p.*")
    parsed, members = with_members(people, "person", ["id", "username", "email"], "who")
    return parsed.select("snapshot_id", "record", "raw_path", "role", "position",
                         raw_scalar(members["id"]).alias("person_id"), raw_string(members["username"]).alias("username"),
                         raw_string(members["email"]).alias("email"))


def normalize_identities(people: DataFrame, vocabulary: Vocabulary) -> Result:
    """Distinct people; observations must agree on name and address.

    `people` has (snapshot_id, person_id, username, email, raw_path), over records and comments.
    """
    # Written, as all that follows reads it: the bodies people come from would be parsed for each reader.
    people = cut_lineage(people.select("snapshot_id", "person_id", "username", "email", "raw_path"))
    known = people.filter(~is_blank(F.col("person_id")))
    # The smallest raw path stands for the first observation.
    merged = first_or_conflict(known, ["snapshot_id", "person_id"], ["username", "email"], "raw_path")
    paths = known.groupBy("snapshot_id", "person_id").agg(F.min("raw_path").alias("raw_path"))
    table = shaped(merged.join(paths, ["snapshot_id", "person_id"]), "identities", {
        "id": vocabulary.id_of("identity", F.col("person_id")), "username": F.col("username"), "email": F.col("email"),
        **tail(vocabulary, vocabulary.person_type, F.col("person_id"), F.col("raw_path"))})
    return table, union_findings([
        finding(merged.filter("conflict"), "normalize_identities", "CONFLICTING_METADATA", "identity", F.col("person_id")),
        finding(people.filter(is_blank(F.col("person_id"))), "normalize_identities", "INVALID_ID", "identity",
                F.col("raw_path"))])


def normalize_roles(people: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Creator, assignee and watcher rows with their array position."""
    return shaped(people.filter(~is_blank(F.col("person_id"))), "record_identities", {
        "record_id": vocabulary.id_of(vocabulary.record_namespace, F.col("record")),
        "identity_id": vocabulary.id_of("identity", F.col("person_id")), "role": F.col("role"),
        "position": F.col("position")})


def normalize_tags(details: DataFrame, vocabulary: Vocabulary) -> Result:
    exploded, findings = _elements(details, "tags", vocabulary)
    parsed, members = with_members(exploded, "element", ["name"], "tag")
    name = raw_string(members["name"])
    table = shaped(parsed.filter(name.isNotNull()), "record_tags", {
        "record_id": vocabulary.id_of(vocabulary.record_namespace, F.col("record")), "name": name,
        "position": F.col("position")})
    return table, union_findings([findings, finding(parsed.filter(name.isNull()), "normalize_tags", "NAME_MISSING",
                                                    "tag", F.col("record"), F.col("position"))])


def normalize_field_definitions(index: DataFrame, responses: DataFrame, vocabulary: Vocabulary) -> Result:
    """Definitions as canonical JSON; a repeated definition must be identical."""
    elements, missing = explode_pages(operation(responses, vocabulary.field_operation), "fields", exact=True)
    parsed, members = with_members(elements, "element", ["id"], "head")
    observed = parsed.select("snapshot_id", raw_scalar(members["id"]).alias("id"),
                             F.col("element").alias("definition"), archive_path().alias("raw_path"),
                             F.struct("sequence", "position").alias("seen"))
    grouped = observed.filter("id IS NOT NULL").groupBy(*KEY).agg(
        F.min_by(F.struct("definition", "raw_path"), "seen").alias("first"),
        (F.min("definition") != F.max("definition")).alias("conflict"))
    joined = _indexed(index, (vocabulary.field_type,)).join(
        unbroadcast(grouped.select(*KEY, "first.definition", "first.raw_path", "conflict")), KEY, "left")
    named, head = with_members(joined, "definition", ["name", "type"], "field")
    field_type = raw_string(head["type"])
    table = shaped(named.filter("definition IS NOT NULL"), "field_definitions", {
        "id": vocabulary.id_of(vocabulary.field_type, F.col("id")), "name": raw_string(head["name"]),
        "field_type": field_type, "semantics_state": field_semantics_state(field_type),
        "definition_json": F.col("definition"),
        **tail(vocabulary, vocabulary.field_type, F.col("id"), F.col("raw_path"))})
    return table, union_findings([missing, coded(named, "normalize_field_definitions", [
        (F.col("definition").isNull(), "EVIDENCE_MISSING"), (F.col("conflict"), "CONFLICTING_DEFINITION"),
        (mistyped(head["name"], raw_string(head["name"])), "NAME_INVALID"),
        (mistyped(head["type"], field_type), "TYPE_INVALID")], "field", F.col("id"))])


def normalize_field_values(details: DataFrame, definitions: DataFrame, vocabulary: Vocabulary) -> Result:
    """One row per (record, field) that is present. An explicit null is kept; an absent key is skipped."""
    exploded, findings = _elements(details, VALUES, vocabulary)
    parsed, members = with_members(exploded, "element", ["id"], "value")
    values = parsed.select("snapshot_id", "record", raw_scalar(members["id"]).alias("field"),
                           canonical_member(F.col("element"), F.lit("value")).alias("observed"))
    known = definitions.select("snapshot_id", F.col("source_id").alias("field"), F.lit(True).alias("known"))
    joined = values.join(known, ["snapshot_id", "field"], "left")
    kept = joined.filter("known AND observed IS NOT NULL")
    repeated = kept.groupBy("snapshot_id", "record", "field").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    table = shaped(kept, "record_field_values", {
        "record_id": vocabulary.id_of(vocabulary.record_namespace, F.col("record")),
        "field_id": vocabulary.id_of(vocabulary.field_type, F.col("field")),
        "observed_value_json": F.col("observed"), "semantics_state": F.lit("OBSERVED_ONLY")})
    return table, union_findings([
        findings, finding(joined.filter("known IS NULL"), "normalize_field_values", "UNKNOWN_FIELD", F.col("field"),
                          F.col("record")),
        finding(repeated, "normalize_field_values", "DUPLICATE_VALUE", F.col("field"), F.col("record"))])


def normalize_attachments(details: DataFrame, workspaces: DataFrame, vocabulary: Vocabulary) -> Result:
    """Attachment metadata with a sanitized URL; UNRESOLVED when the source offers no download URL."""
    exploded, findings = _elements(details, "attachments", vocabulary)
    names = ["id", "title", "mimetype", "size", "url", "url_w_query"]
    joined, members = with_members(exploded.join(workspaces, "snapshot_id"), "element", names, "file")
    identifier, size = raw_scalar(members["id"]), raw_int(members["size"])
    url = raw_string(members["url"])
    download = F.coalesce(raw_string(members["url_w_query"]), url)
    valid = joined.filter(~is_blank(identifier))
    repeated = valid.groupBy("snapshot_id", identifier.alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    table = shaped(valid, "attachments", {
        "id": vocabulary.id_of(vocabulary.attachment_type, identifier), "workspace_id": vocabulary.workspace(),
        "record_id": vocabulary.id_of(vocabulary.record_namespace, F.col("record")),
        "filename": raw_string(members["title"]), "media_type": raw_string(members["mimetype"]), "expected_size": size,
        "source_url": strip_url_query(url),
        "download_status": F.when(is_blank(download), "UNRESOLVED").otherwise("PENDING"),
        "error": F.when(is_blank(download), "no download URL in the source metadata"),
        **tail(vocabulary, vocabulary.attachment_type, identifier, F.col("raw_path"))})
    return table, union_findings([
        findings, coded(joined, "normalize_attachments", [
            (is_blank(identifier), "INVALID_ID"), (mistyped(members["size"], size), "SIZE_INVALID"),
            *[(mistyped(members[m], raw_string(members[m])), f"{m.upper()}_INVALID") for m in
              ("title", "mimetype", "url", "url_w_query")]], "attachment", F.col("record"), F.col("position")),
        finding(repeated, "normalize_attachments", "DUPLICATE_ID", "attachment", F.col("id"))])


# --- comments

def observed_comments(responses: DataFrame, vocabulary: Vocabulary, once: bool = False) -> Result:
    """Comments as the pages list them, with their author; with `once` they are written and pages are parsed no more."""
    elements, missing = explode_pages(operation(responses, *vocabulary.comment_operations), "comments", exact=True)
    parsed, members = with_members(elements, "element",
                                   ["id", "date", "user", "comment", "comment_text"], "comment")
    who, person = with_members(parsed.withColumn("person", F.when(members["user"].kind == "object", members["user"].text)),
                               "person", ["id", "username", "email"], "who")
    body = F.when(~members["comment"].absent, canonical_member(F.col("element"), F.lit("comment")))
    written = F.when(~members["comment_text"].absent, raw_string(members["comment_text"])).otherwise(
        F.when(~members["comment"].absent, rich_text(members["comment"].json)))
    observed = who.select("snapshot_id", raw_scalar(members["id"]).alias("id"), archive_path().alias("raw_path"),
                          raw_scalar(members["date"]).alias("date"), body.alias("body_json"), written.alias("body_text"),
                          raw_scalar(person["id"]).alias("person_id"), raw_string(person["username"]).alias("username"),
                          raw_string(person["email"]).alias("email"))
    observed = cut_lineage(observed) if once else observed
    repeated = observed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 AND id IS NOT NULL")
    return observed.filter("id IS NOT NULL"), union_findings([
        missing, finding(observed.filter("id IS NULL"), "observed_comments", "INVALID_ID", "comment", F.col("raw_path")),
        finding(repeated, "observed_comments", "DUPLICATE_ID", "comment", F.col("id"))])


def comment_records(index: DataFrame, vocabulary: Vocabulary) -> Result:
    """Record at the root of each comment thread."""
    kinds = (vocabulary.comment_type, *vocabulary.record_types)
    nodes = _indexed(index, kinds).select(
        "snapshot_id", "type", source_key(F.col("type"), F.col("id")).alias("node"),
        F.when(F.col("type") == vocabulary.comment_type, source_key(F.col("parent_type"), F.col("parent_id")))
        .alias("parent"))
    walked = resolve_ancestor(nodes, F.col("type").isin(*vocabulary.record_types)).filter(
        F.split_part("node", F.lit(NUL), F.lit(1)) == vocabulary.comment_type).withColumn(
        "id", F.split_part("node", F.lit(NUL), F.lit(2)))
    found = walked.filter("outcome = 'FOUND'").select(
        *KEY, F.split_part("ancestor", F.lit(NUL), F.lit(2)).alias("record"))
    return found, finding(walked.filter("outcome <> 'FOUND'"), "comment_ancestry", F.col("outcome"), "comment", F.col("id"))


def normalize_comments(index: DataFrame, observed: DataFrame, workspaces: DataFrame, vocabulary: Vocabulary) -> Result:
    roots, unplaced = comment_records(index, vocabulary)
    joined = (_indexed(index, (vocabulary.comment_type,)).join(roots, KEY, "left").join(unbroadcast(observed), KEY, "left")
              .join(workspaces, "snapshot_id"))
    reply = F.col("parent_type") == vocabulary.comment_type
    table = shaped(joined.filter("raw_path IS NOT NULL AND record IS NOT NULL"), "comments", {
        "id": vocabulary.id_of(vocabulary.comment_type, F.col("id")), "workspace_id": vocabulary.workspace(),
        "record_id": vocabulary.id_of(vocabulary.record_namespace, F.col("record")),
        "parent_comment_id": F.when(reply, vocabulary.id_of(vocabulary.comment_type, F.col("parent_id"))),
        "author_identity_id": vocabulary.id_of("identity", F.col("person_id")), "body_text": F.col("body_text"),
        "body_json": F.col("body_json"), "date_created_source": F.col("date"),
        **tail(vocabulary, vocabulary.comment_type, F.col("id"), F.col("raw_path"))})
    return table, union_findings([unplaced, finding(joined.filter("raw_path IS NULL"), "normalize_comments",
                                                    "EVIDENCE_MISSING", "comment", F.col("id"))])


# --- relationships

def observed_links(details: DataFrame, vocabulary: Vocabulary) -> Result:
    """Links listed on records, one row per mention: id `a->b`, or `min<->max` for an undirected link."""
    def each(n: int):
        return lambda element, position: F.struct(F.lit(n).alias("link"), position.alias("position"), element.alias("element"))

    exact, findings, lists = exact_arrays(vocabulary), [], []
    for n, link in enumerate(vocabulary.links):
        kind = member(link.array).kind
        findings.append(finding(details.filter(~kind.isin("null", "array")), "record_details", "NOT_AN_ARRAY", link.array, F.col("id")))
        items = F.get(F.col("exact"), F.lit(exact.index(link.array)))
        lists.append(F.coalesce(F.transform(items, each(n)), F.array().cast("array<struct<link:int,position:int,element:string>>")))
    listed = details.select("snapshot_id", F.col("id").alias("record"), "raw_path", F.explode(F.concat(*lists)).alias("x")).select(
        "snapshot_id", "record", "raw_path", "x.*")
    parsed, members = with_members(listed.filter("element IS NOT NULL"), "element",
                                   list(dict.fromkeys(end for link in vocabulary.links for end in (link.left, link.right))), "link")

    def by_link(value) -> Column:
        return F.element_at(F.array(*map(value, vocabulary.links)), F.col("link") + 1)

    left, right = by_link(lambda k: raw_scalar(members[k.left])), by_link(lambda k: raw_scalar(members[k.right]))
    directed, kind, array = by_link(lambda k: F.lit(k.directed)), by_link(lambda k: F.lit(k.kind)), by_link(lambda k: F.lit(k.array))
    ends = parsed.select("snapshot_id", "record", "position", "element", "raw_path", kind.alias("kind"), directed.alias("directed"),
                         F.when(directed, left).otherwise(F.least(left, right)).alias("from_id"), F.when(directed, right).otherwise(F.greatest(left, right)).alias("to_id"),
                         (is_blank(left) | is_blank(right)).alias("lacks"))
    arrow = F.when(F.col("directed"), "->").otherwise("<->")
    mentions = ends.filter("NOT lacks").select("snapshot_id", "kind", F.concat("from_id", arrow, "to_id").alias("id"), "from_id", "to_id", "record", "position", "element", "raw_path")
    unread = finding(listed.filter("element IS NULL").withColumn("array", array), "record_details", "ELEMENT_NOT_JSON", F.col("array"), F.concat_ws("#", "raw_path", "position"))
    lacking = finding(ends.filter("lacks"), "observed_links", "ENDPOINT_MISSING", F.col("kind"), F.col("record"), F.col("position"))
    return mentions, union_findings([*findings, unread, lacking])


def normalize_relationships(mentions: DataFrame, records: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """First mention of each link, endpoints resolved against `records` (snapshot_id, id): RESOLVED only if both are."""
    first = mentions.groupBy("snapshot_id", "kind", "id").agg(F.min_by(
        F.struct("from_id", "to_id", "element", "raw_path"), F.struct("record", "position")).alias("m")).select(
        "snapshot_id", "kind", "id", "m.*")
    known = records.select("snapshot_id", "id").distinct()
    joined = (first.join(known.select("snapshot_id", F.col("id").alias("from_id"), F.lit(True).alias("has_from")),
                         ["snapshot_id", "from_id"], "left")
              .join(known.select("snapshot_id", F.col("id").alias("to_id"), F.lit(True).alias("has_to")),
                    ["snapshot_id", "to_id"], "left"))
    kind = F.concat(F.lit("relationship."), "kind")
    return shaped(joined, "relationships", {
        "id": vocabulary.id_of(kind, F.col("id")), "kind": F.col("kind"),
        "from_record_id": F.when(F.col("has_from"), vocabulary.id_of(vocabulary.record_namespace, F.col("from_id"))),
        "to_record_id": F.when(F.col("has_to"), vocabulary.id_of(vocabulary.record_namespace, F.col("to_id"))),
        "from_source_id": F.col("from_id"), "to_source_id": F.col("to_id"),
        "resolution_state": F.when(F.col("has_from") & F.col("has_to"), "RESOLVED").otherwise("PARTIAL_EXTERNAL"),
        "source_metadata_json": F.col("element"),
        **tail(vocabulary, kind, F.col("id"), F.col("raw_path"), composite=True)})


# --- attachments against landed files

def attachment_outcomes(attachments: DataFrame, files: DataFrame, limit: int | None = None) -> DataFrame:
    """RETRIEVED only when a landed file exists, has the expected size and holds no secret.

    `files` has (snapshot_id, attachment_id, path, bytes, checksum, has_secret). Local columns of an unresolved
    attachment are cleared and it carries a reason.
    """
    from sealcheck.rules import MAX_ATTACHMENT_BYTES
    limit = limit or MAX_ATTACHMENT_BYTES
    landed = files.select("snapshot_id", F.col("attachment_id").alias("id"), F.col("path").alias("_path"),
                          F.col("bytes").alias("_bytes"), F.col("checksum").alias("_sum"), F.col("has_secret").alias("_bad"))
    joined = attachments.join(landed, KEY, "left")
    reason = (F.when(F.col("download_status") == "UNRESOLVED", F.col("error"))
              .when(F.col("expected_size") > limit, F.lit(f"expected size exceeds the limit of {limit} bytes"))
              .when(F.col("_path").isNull(), "no landed file")
              .when(F.col("_bytes") > limit, F.lit(f"file exceeds the limit of {limit} bytes"))
              .when(F.col("expected_size") != F.col("_bytes"), F.concat(
                  F.lit("size mismatch: expected "), F.col("expected_size").cast("string"), F.lit(" bytes, received "),
                  F.col("_bytes").cast("string")))
              .when(F.col("_bad"), "file holds a configured secret and was omitted"))
    kept = reason.isNull()
    return joined.withColumns({
        "download_status": F.when(kept, "RETRIEVED").otherwise("UNRESOLVED"),
        "local_path": F.when(kept, F.col("_path")), "archived_size": F.when(kept, F.col("_bytes")),
        "checksum": F.when(kept, F.col("_sum")), "error": reason}).select(*attachments.columns)
