"""A browsable, denormalized view of every record, with provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck import rules as R
from sealcheck.functions.ids import DEFAULT_PREFIX, packed, unpacked
from sealcheck.functions.text import (attachment_component, code_block, escapes_root, inline_markdown, or_else,
                                      plural_kind, safe_component)
from sealcheck.operators.findings import coded, finding, union_all
from sealcheck.session import cut_lineage
from sealcheck.skew import running_total

Tables = dict[str, DataFrame]
PROVENANCE = ["source_provider", "source_type", "source_id", "source_raw_path"]
CONTAINER = ["id", "kind", "name"]


def _prefixed(frame: DataFrame, prefix: str, columns: list[str]) -> DataFrame:
    return frame.select("snapshot_id", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def container_view(tables: Tables) -> DataFrame:
    """Every container with its parent container."""
    parents = _prefixed(tables["containers"], "parent", [*CONTAINER, "source_id"])
    own = tables["containers"].select("snapshot_id", *CONTAINER, "workspace_id", "parent_id", *PROVENANCE)
    return own.join(parents, ["snapshot_id", "parent_id"], "left")


def collection_view(tables: Tables) -> DataFrame:
    """Every collection with its container and that container's parent."""
    containers = container_view(tables).select(
        "snapshot_id", F.col("id").alias("container_id"), F.col("kind").alias("container_kind"),
        F.col("name").alias("container_name"), "parent_id", "parent_kind", "parent_name")
    own = tables["collections"].select("snapshot_id", "id", "name", "workspace_id", "container_id", *PROVENANCE)
    return own.join(containers, ["snapshot_id", "container_id"])


RECORD_COLUMNS = ["id", "kind", "title", "workspace_id", "collection_id", "parent_record_id", *PROVENANCE]


def record_view(tables: Tables, columns: list[str] | None = None) -> DataFrame:
    """Every record with its collection, container and parent container."""
    collections = collection_view(tables).select(
        "snapshot_id", F.col("id").alias("collection_id"), F.col("name").alias("collection_name"), "container_id",
        "container_kind", "container_name", "parent_id", "parent_kind", "parent_name")
    own = tables["records"].select("snapshot_id", *(columns or RECORD_COLUMNS))
    return own.join(collections, ["snapshot_id", "collection_id"])


# --- paths

def _component(name: str, fallback: Column, identifier: str, prefix: str) -> Column:
    return safe_component(or_else(F.col(name), fallback), F.col(identifier), prefix)


def _container_path(prefix: str, kind="container_kind", name="container_name", identifier="container_id") -> Column:
    own = F.concat_ws("/", plural_kind(F.col(kind)), _component(name, F.col(kind), identifier, prefix))
    above = F.concat_ws("/", plural_kind(F.col("parent_kind")), _component("parent_name", F.col("parent_kind"), "parent_id", prefix))
    return F.when(F.col("parent_kind").isNotNull(), F.concat_ws("/", above, own)).otherwise(own)


def workspace_paths(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    return tables["workspaces"].select("snapshot_id", F.col("id").alias("workspace_id"), safe_component(
        or_else(F.col("name"), F.lit("Workspace")), F.col("id"), prefix).alias("root"))


def collection_paths(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Directory of each collection. Computed once per collection, not once per record."""
    view = collection_view(tables).join(workspace_paths(tables, prefix), ["snapshot_id", "workspace_id"])
    return view.select("snapshot_id", F.col("id").alias("collection_id"), *PROVENANCE, F.concat_ws(
        "/", "root", _container_path(prefix), F.lit("collections"), _component("name", F.lit("Collection"), "id", prefix)).alias("directory"))


def record_paths(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """(snapshot_id, record_id, collection_id, directory) of each record."""
    # Ids travel packed.
    parents = collection_paths(tables, prefix).select("snapshot_id", packed("collection_id").alias("collection_id"), F.col("directory").alias("above"))
    own = tables["records"].select("snapshot_id", packed("id").alias("record_id"), packed("collection_id").alias("collection_id"), "kind", "title", *PROVENANCE)
    joined = own.join(parents, ["snapshot_id", "collection_id"]).withColumns({name: unpacked(name) for name in ("record_id", "collection_id")})
    return joined.select(
        "snapshot_id", "record_id", "collection_id", *PROVENANCE,
        F.concat_ws("/", "above", F.lit("records"), _component("title", F.col("kind"), "record_id", prefix)).alias("directory"))


def index_paths(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Path of every index page: (snapshot_id, table, id, path)."""
    roots = workspace_paths(tables, prefix)
    containers = container_view(tables).join(roots, ["snapshot_id", "workspace_id"]).select(
        "snapshot_id", F.lit("containers").alias("table"), "id",
        F.concat_ws("/", "root", _container_path(prefix, "kind", "name", "id"), F.lit("index.md")).alias("path"))
    return union_all([
        roots.select("snapshot_id", F.lit("workspaces").alias("table"), F.col("workspace_id").alias("id"),
                     F.concat_ws("/", "root", F.lit("index.md")).alias("path")),
        containers,
        collection_paths(tables, prefix).select("snapshot_id", F.lit("collections").alias("table"), F.col("collection_id").alias("id"),
                                                F.concat_ws("/", "directory", F.lit("index.md")).alias("path"))])


def view_paths(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Path of every generated document: (snapshot_id, table, id, path)."""
    records = record_paths(tables, prefix).select("snapshot_id", F.lit("records").alias("table"), F.col("record_id").alias("id"),
                                                  F.concat_ws("/", "directory", F.lit("record.md")).alias("path"))
    return index_paths(tables, prefix).unionByName(records)


def path_collisions(paths: DataFrame) -> DataFrame:
    """Paths claimed more than once. They are reported, never merged."""
    shared = paths.groupBy("snapshot_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("table").alias("table")).filter("n > 1")
    return finding(shared, "view_paths", "PATH_COLLISION", F.col("table"), F.col("path"), F.col("n"))


# --- sections: one row per list item, ordered by (section_no, k1, k2, k3)

def _item(frame: DataFrame, number: int, section: str, text: Column, keys: list) -> DataFrame:
    padded = [F.coalesce(key.cast("string"), F.lit("")) if isinstance(key, Column) else F.lit(key) for key in keys]
    padded += [F.lit("")] * (3 - len(padded))
    return frame.select("snapshot_id", "record_id", F.lit(number).alias("section_no"), F.lit(section).alias("section"),
                        *[key.alias(f"k{n}") for n, key in enumerate(padded, 1)], text.alias("text"))


def _number_key(value: Column) -> Column:
    """Text that sorts like the non-negative number it stands for."""
    return F.lpad(value.cast("string"), 19, "0")


def _meta(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"* {label} = `"), inline_markdown(value), F.lit("`\n"))


def _optional(label: str, value: Column) -> Column:
    return F.coalesce(_meta(label, value), F.lit(""))


def record_tags_section(tables: Tables) -> DataFrame:
    tags = tables["record_tags"]
    return _item(tags, 1, "tags", F.concat(F.lit("* "), inline_markdown(F.col("name")), F.lit(" (no. "), F.col("position").cast("string"), F.lit(")\n")),
                 [_number_key(F.col("position")), F.col("name")])


def record_people_section(tables: Tables) -> DataFrame:
    people = tables["identities"].select("snapshot_id", F.col("id").alias("identity_id"), "username", "email", "source_id", "source_raw_path")
    joined = tables["record_identities"].join(people, ["snapshot_id", "identity_id"])
    text = F.concat(F.lit("* "), inline_markdown(or_else(F.col("username"), F.lit("(no name)"))),
                    F.coalesce(F.concat(F.lit(" <"), inline_markdown(F.col("email")), F.lit(">")), F.lit("")), F.lit(" as "), inline_markdown(F.col("role")),
                    F.lit(" no. "), F.col("position").cast("string"), F.lit("\n  `"), inline_markdown(F.col("identity_id")), F.lit("`, at origin `"),
                    inline_markdown(F.col("source_id")), F.lit("`, read from `"), inline_markdown(F.col("source_raw_path")), F.lit("`\n"))
    return _item(joined, 2, "people", text, [F.col("role"), _number_key(F.col("position")), F.col("identity_id")])


def record_fields_section(tables: Tables) -> DataFrame:
    fields = tables["field_definitions"].select("snapshot_id", F.col("id").alias("field_id"), "name", "field_type", "source_id", "source_raw_path")
    joined = tables["record_field_values"].join(fields, ["snapshot_id", "field_id"])
    text = F.concat(F.lit("\n### "), inline_markdown(or_else(F.col("name"), F.lit("(no name)"))), F.lit("\n\n"),
                    _meta("field id here", F.col("field_id")), _optional("sort of field", F.col("field_type")),
                    _meta("how to read it", F.col("semantics_state")), _meta("id at origin", F.col("source_id")),
                    _meta("read from", F.col("source_raw_path")), code_block(F.col("observed_value_json")))
    return _item(joined, 3, "fields", text, [F.col("field_id")])


def record_comments_section(tables: Tables) -> DataFrame:
    """Comments by date, those without a date last, then by id."""
    people = tables["identities"].select("snapshot_id", F.col("id").alias("author_identity_id"), F.col("username").alias("author"),
                                         F.col("source_id").alias("author_source_id"))
    joined = tables["comments"].join(people, ["snapshot_id", "author_identity_id"], "left")
    body = F.coalesce(code_block(F.col("body_text")), code_block(F.col("body_json")), F.lit("*(nothing to read was kept)*\n"))
    text = F.concat(F.lit("\n### Said in "), inline_markdown(F.col("id")), F.lit("\n\n"), _meta("id at origin", F.col("source_id")),
                    _meta("read from", F.col("source_raw_path")),
                    _optional("answers comment", F.col("parent_comment_id")),
                    _optional("made", F.col("date_created_source")), _optional("by", F.col("author")),
                    _optional("by, at origin", F.col("author_source_id")), body)
    return _item(joined, 4, "comments", text, [F.when(F.col("date_created_source").isNull(), "1").otherwise("0"),
                                               F.col("date_created_source"), F.col("id")])


def record_links_section(tables: Tables) -> DataFrame:
    """Links that touch the record at either end; a link from a record to itself is listed once."""
    links = tables["relationships"].withColumn("record_id", F.explode(F.array_distinct(F.filter(
        F.array("from_record_id", "to_record_id"), lambda end: end.isNotNull()))))
    outside = F.lit("outside")
    def end(side):
        return [F.lit("`"), inline_markdown(F.col(f"{side}_source_id")), F.lit("` = "), inline_markdown(or_else(F.col(f"{side}_record_id"), outside))]

    text = F.concat(F.lit("* "), *end("from"), F.lit(" -- "), inline_markdown(F.col("kind")), F.lit(" --> "), *end("to"), F.lit("\n  "),
                    inline_markdown(F.col("resolution_state")), F.lit(", link `"), inline_markdown(F.col("id")), F.lit("`, read from `"),
                    inline_markdown(F.col("source_raw_path")), F.lit("`\n"))
    return _item(links, 5, "links", text, [F.col("id")])


def record_attachments_section(tables: Tables) -> DataFrame:
    text = F.concat(F.lit("* "), inline_markdown(or_else(F.col("filename"), F.lit("(no name)"))),
                    F.coalesce(F.concat(F.lit(" ("), inline_markdown(F.col("media_type")), F.lit(")")), F.lit("")), F.lit(": "), inline_markdown(F.col("download_status")),
                    F.coalesce(F.concat(F.lit(", sum `"), inline_markdown(F.col("checksum")), F.lit("`")), F.lit("")), F.lit("\n  `"), inline_markdown(F.col("id")),
                    F.lit("`, at origin `"), inline_markdown(F.col("source_id")), F.lit("`, read from `"), inline_markdown(F.col("source_raw_path")), F.lit("`\n"))
    return _item(tables["attachments"], 6, "attachments", text, [F.col("id")])


SECTIONS = [(record_tags_section, "\n## Labels\n\n"), (record_people_section, "\n## Who\n\n"),
            (record_fields_section, "\n## Values of fields\n"), (record_comments_section, "\n## Talk\n"),
            (record_links_section, "\n## Ties\n\n"), (record_attachments_section, "\n## Files\n\n")]
ITEM_KEYS = ["section_no", "k1", "k2", "k3"]


def record_header(records: DataFrame) -> DataFrame:
    """First block of each document: title, columns of the record, description and text."""
    def long_text(label, column):
        return F.coalesce(F.concat(F.lit(f"\n## {label}\n\n"), code_block(F.col(column))), F.lit(""))

    dates = [("made", "date_created_source"), ("changed", "date_updated_source"),
             ("closed", "date_closed_source"), ("finished", "date_done_source"),
             ("begins", "start_date_source"), ("due by", "due_date_source")]
    text = F.concat(
        F.lit("# "), inline_markdown(or_else(F.col("title"), F.col("kind"))), F.lit("\n\n"), _meta("is a", F.col("kind")),
        _meta("id here", F.col("id")), _meta("type at origin", F.col("source_type")), _meta("id at origin", F.col("source_id")),
        _meta("read from", F.col("source_raw_path")), _optional("inside record", F.col("parent_record_id")),
        _optional("state", F.col("status")), _optional("state group", F.col("status_type")), _optional("urgency", F.col("priority")),
        _optional("put away", F.col("archived").cast("string")), *[_optional(label, F.col(column)) for label, column in dates],
        _optional("planned ms", F.col("time_estimate_ms").cast("string")),
        _optional("worked ms", F.col("time_spent_ms").cast("string")), _optional("weight", F.col("points").cast("string")),
        long_text("What it is about", "description"), long_text("Plain text", "text_content"))
    return _item(records.withColumn("record_id", F.col("id")), 0, "record", text, [])


def section_headings(items: DataFrame) -> DataFrame:
    """One heading for each section a record has. Combined before the shuffle, so a hot record costs little."""
    heading = F.lit("")
    for number, (_, title) in enumerate(SECTIONS, 1):
        heading = F.when(F.col("section_no") == number, title).otherwise(heading)
    # The empty keys sort before those of any item.
    sections = items.select("snapshot_id", "record_id", "section_no", "section").distinct()
    return sections.select("snapshot_id", "record_id", "section_no", "section", *[F.lit("").alias(k) for k in ("k1", "k2", "k3")],
                           heading.alias("text"))


def document_blocks(tables: Tables) -> DataFrame:
    """Every record document as ordered text blocks: the content of a document is its blocks by ITEM_KEYS.

    A record with any number of children stays many small rows; nothing is collected.
    """
    items = union_all([section(tables) for section, _ in SECTIONS])
    return union_all([record_header(tables["records"]), section_headings(items), items])


PART_BYTES = 32 << 20


def document_parts(blocks: DataFrame, part_bytes: int = PART_BYTES, about: DataFrame | None = None) -> DataFrame:
    """Blocks joined to (snapshot_id, record_id, part, content), no part above `part_bytes` bytes of UTF-8.

    A part begins at each half of the bound and takes the blocks that start there. A block above half the bound is cut
    between characters, so a part ends within the next half. The parts of a document in order are its content. Offsets are
    running sums over as many tasks as a document needs; one that ends within the first half has part 0 alone, without sums.
    Equal blocks all stay. `part_bytes` is at least 8, for a character may take four bytes. Where `about` is given, one row
    per (snapshot_id, record_id), its columns are added and documents it does not name are left out.
    """
    if part_bytes < 8:
        raise ValueError(f"part_bytes is {part_bytes}")
    key, half = ["snapshot_id", "record_id"], part_bytes // 2
    # Equal blocks are told apart by their place in the written frame, so that their pieces stay together.
    blocks = cut_lineage(blocks.withColumns({"record_id": packed("record_id"), "bytes": F.octet_length("text").cast("long"), "tie": F.xxhash64("text")})
                         .withColumn("row", F.monotonically_increasing_id()))
    about = None if about is None else about.withColumn("record_id", packed("record_id"))
    # Sizes are first summed by a short hash of the record. Few documents are large, and without one no block travels for this.
    own = F.xxhash64(*key).alias("own")
    heavy = cut_lineage(blocks.groupBy(own).agg(F.sum("bytes").alias("n")).filter(F.col("n") > half).select("own"))
    large = cut_lineage(blocks.select(*key, "bytes", own).join(heavy, "own", "left_semi").groupBy(*key).agg(F.sum("bytes").alias("n"))
                        .filter(F.col("n") > half).select(*key))

    def joined(frame, group, order):
        grouped = frame.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("blocks"))
        content = grouped.select(*group, F.array_join(F.transform("blocks", lambda b: b["text"]), "").alias("content"))
        return content if about is None else content.join(about, key)

    # Grouped by the key of the join with `about`, so that contents are not shuffled once more.
    small = joined(blocks.join(large, key, "left_anti"), key, [*ITEM_KEYS, "tie"]).withColumn("part", F.lit(0).cast("long"))
    pieces = F.when(F.col("bytes") > half, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{half // 4}}}"), F.lit(0))).otherwise(F.array("text"))
    cut = blocks.join(large, key, "left_semi").select(*key, *ITEM_KEYS, "tie", "row", F.posexplode(pieces).alias("piece", "text"))
    size = F.octet_length("text").cast("long")
    placed = running_total(cut, key, [*ITEM_KEYS, "tie", "row", "piece"], size, "end")
    parts = joined(placed.withColumn("part", F.floor((F.col("end") - size) / half).cast("long")), [*key, "part"], [*ITEM_KEYS, "tie", "row", "piece"])
    return small.unionByName(parts).withColumn("record_id", unpacked("record_id"))


def record_documents(tables: Tables, prefix: str = DEFAULT_PREFIX, part_bytes: int = PART_BYTES) -> DataFrame:
    """Markdown documents as (snapshot_id, collection_id, record_id, path, part, content); a document is its parts in order."""
    paths = record_paths(tables, prefix).select("snapshot_id", "record_id", "collection_id",
                                                F.concat_ws("/", "directory", F.lit("record.md")).alias("path"))
    return document_parts(document_blocks(tables), part_bytes, paths).select(
        "snapshot_id", "collection_id", "record_id", "path", "part", "content")


def index_documents(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Index page of every workspace, container and collection."""
    columns = ["snapshot_id", "table", "id", "label", "name", "above_id", "above_source", *PROVENANCE]
    none = F.lit(None).cast("string")
    workspaces = tables["workspaces"].select("snapshot_id", F.lit("workspaces").alias("table"), "id", F.lit("Workspace").alias("label"),
                                             "name", none.alias("above_id"), none.alias("above_source"), *PROVENANCE)
    title = F.concat(F.upper(F.substring("kind", 1, 1)), F.expr("substring(kind, 2)"))
    containers = container_view(tables).select("snapshot_id", F.lit("containers").alias("table"), "id", title.alias("label"), "name",
                                               F.when(F.col("parent_kind").isNotNull(), F.col("parent_id")).alias("above_id"),
                                               F.col("parent_source_id").alias("above_source"), *PROVENANCE)
    owners = tables["containers"].select("snapshot_id", F.col("id").alias("container_id"), F.col("source_id").alias("above_source"))
    collections = tables["collections"].join(owners, ["snapshot_id", "container_id"]).select(
        "snapshot_id", F.lit("collections").alias("table"), "id", F.lit("Collection").alias("label"), "name",
        F.col("container_id").alias("above_id"), "above_source", *PROVENANCE)
    rows = union_all([f.select(*columns) for f in (workspaces, containers, collections)])
    text = F.concat(F.lit("# "), inline_markdown(or_else(F.col("name"), F.col("label"))), F.lit("\n\n"), _meta("is a", F.col("label")),
                    _meta("id here", F.col("id")), _meta("type at origin", F.col("source_type")), _meta("id at origin", F.col("source_id")),
                    _meta("read from", F.col("source_raw_path")), _optional("inside", F.col("above_id")),
                    _optional("inside, at origin", F.col("above_source")))
    return rows.join(index_paths(tables, prefix), ["snapshot_id", "table", "id"]).select("snapshot_id", "table", "id", "path", text.alias("content"))


def attachment_copy_plan(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Target path of each attachment with its expected checksum; `problem` marks what must not be copied."""
    paths = record_paths(tables, prefix).select("snapshot_id", packed("record_id").alias("record_id"), "directory")
    joined = tables["attachments"].withColumn("record_id", packed("record_id")).join(paths, ["snapshot_id", "record_id"])
    unresolved = ((F.col("download_status") != "RETRIEVED") | F.col("local_path").isNull() | F.col("checksum").isNull())
    name = attachment_component(or_else(F.col("filename"), F.lit("attachment")), F.col("id"), prefix)
    return joined.select(
        "snapshot_id", "id", *PROVENANCE, F.col("local_path").alias("source_path"), "checksum",
        F.concat_ws("/", "directory", F.lit("attachments"), name).alias("path"),
        F.when(unresolved, "UNRESOLVED").when(escapes_root(F.col("local_path")), "UNSAFE_PATH").alias("problem"))


def copy_plan_findings(plan: DataFrame) -> DataFrame:
    return coded(plan, "attachment_copy_plan", [(F.col("problem").isNotNull(), "NOT_COPIED")], "attachment", F.col("id"), F.col("problem"))


def provenance_index(tables: Tables, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Path to portable and source identity, for every document and copied attachment."""
    entities = union_all([tables[t].select("snapshot_id", F.lit(t).alias("table"), packed("id").alias("id"), *PROVENANCE)
                          for t in ("workspaces", "containers", "collections", "records")])
    paths = view_paths(tables, prefix).withColumn("id", packed("id"))
    documents = paths.join(entities, ["snapshot_id", "table", "id"]).select(
        "snapshot_id", "path", unpacked("id").alias("portable_id"), *PROVENANCE, F.lit(None).cast("string").alias("attachment_checksum"))
    readme = tables["workspaces"].select("snapshot_id", F.lit("README.md").alias("path"), F.col("id").alias("portable_id"), *PROVENANCE,
                                         F.lit(None).cast("string").alias("attachment_checksum"))
    files = attachment_copy_plan(tables, prefix).filter("problem IS NULL").select(
        "snapshot_id", "path", F.col("id").alias("portable_id"), *PROVENANCE, F.col("checksum").alias("attachment_checksum"))
    return union_all([readme, documents, files])


def publishable(before: DataFrame, after: DataFrame) -> DataFrame:
    """Snapshots that verified both times with an unchanged manifest.

    Both sides have (snapshot_id, result, manifest_checksum).
    """
    good = F.col("result").isin(R.VERIFIED, R.LIMITED)
    left = before.filter(good).select("snapshot_id", "result", "manifest_checksum")
    right = after.filter(good).select("snapshot_id", F.col("manifest_checksum").alias("_checksum"))
    return left.join(right, "snapshot_id").filter(F.col("manifest_checksum").eqNullSafe(F.col("_checksum"))).drop("_checksum")
