"""The driver's tables as two snapshots of one archive.

Snapshot s1 is the tables as they are. Snapshot s2 is a damaged copy: rows that meet a rule on their key are
dropped, moved or altered, so that every check has something to find. Both snapshots hold all rows of all
tables; the rules decide what is damaged, not what is read. `oracle.py` states the same mapping in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping as AnyMapping
from functools import cached_property, partial
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealcheck.functions.ids import digest, portable_id
from sealcheck.operators.findings import union_all
from sealcheck.operators.normalize import build_source_index
from sealcheck.operators.verdict import verdict
from sealcheck.rules import CHECKS
from sealcheck.schemas import portable_columns, portable_schema
from sealcheck.skew import ordered_positions
from sealcheck.session import CODEC, configure, ensure_checkpoint_dir

PROVIDER = "tpch"
E = F.expr


def pid(namespace, identifier) -> Column:
    namespace = F.lit(namespace) if isinstance(namespace, str) else namespace
    return portable_id(F.lit(PROVIDER), namespace, identifier)


def text(column: str) -> Column:
    return F.col(column).cast("string")


_WRITTEN: dict[tuple[str, str, str], tuple] = {}


def stored(build):
    """Rows behind the mapped tables that are written once per application and then read.

    They lie in the shared checkpoint folder, so every query of a session scans columns of the same files. Only what takes
    a join or an aggregate is written, as the keys it yields; ids and texts are derived from those when a table is read.
    """
    name = build.__name__

    def read(self) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _WRITTEN:
            ensure_checkpoint_dir(self.spark)
            path = f"{self.spark.sparkContext.getCheckpointDir()}/mapping-{uuid4().hex}/{name}"
            frame = build(self)
            frame.write.parquet(path, compression=CODEC)
            _WRITTEN[key] = (path, frame.schema)
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)

    return cached_property(read)


class Tables(AnyMapping):
    """Tables by name, each made when it is first asked for: a query pays for the tables it reads alone."""

    def __init__(self, make: dict[str, Callable[[], DataFrame]]):
        self.make, self.made = make, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.make[name]()
        return self.made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.make)

    def __len__(self) -> int:
        return len(self.make)


class Mapping:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def both(self, name_or_frame) -> DataFrame:
        """The rows once per snapshot."""
        frame = self.read(name_or_frame) if isinstance(name_or_frame, str) else name_or_frame
        return frame.withColumn("snapshot_id", F.explode(F.array(F.lit("s1"), F.lit("s2")))).withColumn(
            "bad", F.col("snapshot_id") == "s2")

    def shaped(self, frame: DataFrame, table: str, source_kind: str, identifier, raw_path, composite=False, **values) -> DataFrame:
        types = {f.name: f.dataType for f in portable_schema(table)}
        values |= {"source_provider": F.lit(PROVIDER), "source_type": F.lit(source_kind), "source_id": identifier,
                   "source_raw_path": raw_path, "source_id_composite": F.lit(composite)}
        return frame.select("snapshot_id", *[values.get(c, F.lit(None)).cast(types[c]).alias(c) for c in portable_columns(table)])

    # --- the 13 tables

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.both(self.read("region").agg(F.count(F.lit(1)).alias("n_regions"))).select("snapshot_id", "bad")

    @cached_property
    def workspaces(self) -> DataFrame:
        return self.shaped(self.snapshots, "workspaces", "workspace", F.lit("w1"), F.lit("raw/inventory.json"),
                           id=pid("workspace", F.lit("w1")), name=F.lit(PROVIDER))

    @cached_property
    def containers(self) -> DataFrame:
        ws = pid("workspace", F.lit("w1"))
        regions = self.shaped(self.both("region"), "containers", "region", text("r_regionkey"), F.lit("raw/region.json"),
                              id=pid("region", text("r_regionkey")), kind=F.lit("region"), workspace_id=ws, name=F.col("r_name"))
        kept = self.both("nation").filter(~(F.col("bad") & (F.col("n_nationkey") % 7 == 0)))
        nations = self.shaped(kept, "containers", "nation", text("n_nationkey"), F.lit("raw/nation.json"),
                              id=pid("nation", text("n_nationkey")), kind=F.lit("nation"), workspace_id=ws,
                              parent_id=pid("region", text("n_regionkey")), name=F.col("n_name"))
        return regions.unionByName(nations)

    @cached_property
    def collections(self) -> DataFrame:
        moved = F.col("bad") & (F.col("c_custkey") % 101 == 0)
        nation = F.when(moved, (F.col("c_nationkey") + 1) % 25).otherwise(F.col("c_nationkey")).cast("string")
        return self.shaped(self.both("customer"), "collections", "customer", text("c_custkey"),
                           F.concat(F.lit("raw/customer/"), E("c_custkey div 100").cast("string"), F.lit(".json")),
                           id=pid("customer", text("c_custkey")), workspace_id=pid("workspace", F.lit("w1")),
                           container_id=pid("nation", nation), name=F.col("c_name"))

    @stored
    def line_keys(self) -> DataFrame:
        return self.read("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"))

    @staticmethod
    def with_line_id(frame: DataFrame) -> DataFrame:
        return frame.withColumn("line_id", F.concat_ws("-", "l_orderkey", "l_linenumber"))

    @cached_property
    def lines(self) -> DataFrame:
        """One row per (order, line number); the source repeats about a third of these keys."""
        return self.with_line_id(self.line_keys)

    @stored
    def placed_lines(self) -> DataFrame:
        """Lines with the customer of their order."""
        owners = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        return self.line_keys.select("l_orderkey", "l_linenumber").join(owners, "l_orderkey")

    @staticmethod
    def order_path(column: str, folder: str = "order") -> Column:
        return F.concat(F.lit(f"raw/{folder}/"), E(f"{column} div 100").cast("string"), F.lit(".json"))

    @cached_property
    def records(self) -> DataFrame:
        key, bad = F.col("o_orderkey"), F.col("bad")
        own = pid("order", text("o_orderkey"))
        customer = F.when(bad & (key % 101 == 0), F.col("o_custkey") + 1 - 2 * (F.col("o_custkey") % 2)).otherwise(F.col("o_custkey"))
        orders = self.shaped(
            self.both("orders").filter(~(bad & (key % 211 == 0))), "records", "order", text("o_orderkey"), self.order_path("o_orderkey"),
            id=F.when(bad & (key % 401 == 0), F.concat(F.lit("bad_"), text("o_orderkey"))).otherwise(own), kind=F.lit("order"),
            workspace_id=pid("workspace", F.lit("w1")), collection_id=pid("customer", customer.cast("string")),
            parent_record_id=F.when(bad & (key % 499 == 0), own), title=F.concat(F.lit("Order "), text("o_orderkey")),
            status=F.col("o_orderstatus"), priority=F.col("o_orderpriority"),
            date_created_source=F.date_format("o_orderdate", "yyyy-MM-dd"))
        placed = self.both(self.with_line_id(self.placed_lines))
        lines = self.shaped(
            placed.filter(~(bad & ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 509 == 0))), "records", "line", F.col("line_id"),
            self.order_path("l_orderkey", "line"), id=pid("line", F.col("line_id")), kind=F.lit("line"),
            workspace_id=pid("workspace", F.lit("w1")), collection_id=pid("customer", text("o_custkey")),
            parent_record_id=pid("order", text("l_orderkey")), title=F.concat(F.lit("Line "), F.col("line_id")))
        return orders.unionByName(lines)

    @cached_property
    def identities(self) -> DataFrame:
        key, bad = F.col("s_suppkey"), F.col("bad")
        path = F.when(bad & (key % 23 == 0), "").when(bad & (key % 19 == 0), "elsewhere/x.json").otherwise(
            F.concat(F.lit("raw/supplier/"), E("s_suppkey div 10").cast("string"), F.lit(".json")))
        return self.shaped(self.both("supplier").filter(~(bad & (key % 13 == 0))), "identities", "supplier", text("s_suppkey"), path,
                           id=pid("identity", text("s_suppkey")), username=F.col("s_name"))

    @cached_property
    def record_identities(self) -> DataFrame:
        return self.both(self.lines).select("snapshot_id", pid("line", F.col("line_id")).alias("record_id"),
                                            pid("identity", text("l_suppkey")).alias("identity_id"), F.lit("supplier").alias("role"),
                                            F.lit(0).cast("long").alias("position"))

    @cached_property
    def record_tags(self) -> DataFrame:
        return self.both("orders").select("snapshot_id", pid("order", text("o_orderkey")).alias("record_id"),
                                          F.posexplode(F.array("o_orderstatus", "o_orderpriority")).alias("position", "name")).select(
            "snapshot_id", "record_id", "name", F.col("position").cast("long").alias("position"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.read("conversations").withColumn("turn_id", F.concat_ws("-", "conv_id", "turn"))

    @staticmethod
    def turn_dropped() -> Column:
        return (F.col("conv_id") * 31 + F.col("turn")) % 37 == 0

    @cached_property
    def comments(self) -> DataFrame:
        bad, conv, turn = F.col("bad"), F.col("conv_id"), F.col("turn")
        kept = self.both(self.turns).filter(~(bad & self.turn_dropped()))
        record = F.when(bad & (conv % 41 == 0) & (turn == 0), conv + 1).otherwise(conv).cast("string")
        return self.shaped(
            kept, "comments", "turn", F.col("turn_id"), F.concat(F.lit("raw/turn/"), E("conv_id div 10").cast("string"), F.lit(".json")),
            id=pid("turn", F.col("turn_id")),
            workspace_id=F.when(bad & (conv % 43 == 0), "sc_other").otherwise(pid("workspace", F.lit("w1"))),
            record_id=pid("order", record), parent_comment_id=F.when(turn > 0, pid("turn", F.concat_ws("-", "conv_id", turn - 1))),
            body_text=F.col("text"), date_created_source=F.when(turn % 3 != 2, F.lpad(turn.cast("string"), 4, "0")))

    def _attachments(self, damaged: bool) -> DataFrame:
        key = F.col("doc_id")
        bad = F.col("bad") & F.lit(damaged)
        lost, altered = bad & (key % 17 == 0), bad & (key % 13 == 0)
        return self.shaped(
            self.both("documents"), "attachments", "document", text("doc_id"),
            F.concat(F.lit("raw/document/"), E("doc_id div 10").cast("string"), F.lit(".json")), id=pid("document", text("doc_id")),
            workspace_id=pid("workspace", F.lit("w1")), record_id=pid("order", text("doc_id")),
            filename=F.concat(F.lit("doc-"), text("doc_id"), F.lit("."), F.col("lang")), media_type=F.lit("text/plain"),
            expected_size=F.col("n_chars"), download_status=F.when(lost, "UNRESOLVED").otherwise("RETRIEVED"),
            local_path=F.when(~lost, F.concat(F.lit("attachments/"), text("doc_id"), F.lit(".txt"))),
            archived_size=F.when(~lost, F.octet_length("text")),
            checksum=F.when(~lost, F.when(altered, F.concat(F.lit("sha256:"), F.repeat(F.lit("0"), 64))).otherwise(digest(F.col("text")))),
            error=F.when(lost, "download failed"))

    @cached_property
    def attachments(self) -> DataFrame:
        return self._attachments(True)

    @cached_property
    def field_definitions(self) -> DataFrame:
        names = self.read("labels").agg(F.count("quality").alias("quality"), F.count("toxic").alias("toxic")).select(
            F.explode(F.array(F.lit("quality"), F.lit("toxic"), F.lit("ghost"))).alias("field"))
        rows = self.both(names).filter("bad OR field <> 'ghost'")
        both = '{"id":"0","orderindex":0},{"id":"1","orderindex":1}'
        options = F.when(F.col("bad") & (F.col("field") == "toxic"), '{"id":"0","orderindex":0}').otherwise(both)
        definition = F.concat(F.lit('{"id":"'), "field", F.lit('","name":"'), "field", F.lit('","type":"drop_down","type_config":{"options":['),
                              options, F.lit("]}}"))
        return self.shaped(rows, "field_definitions", "field", F.col("field"), F.lit("raw/field.json"), id=pid("field", F.col("field")),
                           name=F.when(F.col("bad") & (F.col("field") == "quality"), "renamed").otherwise(F.col("field")),
                           field_type=F.lit("drop_down"), semantics_state=F.lit("SOURCE_DEFINITION_ONLY"), definition_json=definition)

    @cached_property
    def record_field_values(self) -> DataFrame:
        rows = self.both("labels").withColumn("v", F.explode(F.array(
            F.struct(F.lit("quality").alias("field"), text("quality").alias("value")),
            F.struct(F.lit("toxic").alias("field"), text("toxic").alias("value")))))
        bad, key = F.col("bad"), F.col("doc_id")
        return rows.select(
            "snapshot_id", pid("order", text("doc_id")).alias("record_id"),
            pid("field", F.when(bad & (key % 37 == 0), "nowhere").otherwise(F.col("v.field"))).alias("field_id"),
            F.when(bad & (key % 31 == 0), "{oops").otherwise(F.col("v.value")).alias("observed_value_json"),
            F.when(bad & (key % 29 == 0), "EXECUTED").otherwise("OBSERVED_ONLY").alias("semantics_state"))

    @stored
    def edges(self) -> DataFrame:
        """The link of each order, and whether the order it leads to exists."""
        known = self.read("orders").select(F.col("o_orderkey").alias("to_key"), F.lit(True).alias("there"))
        return self.read("orders").select("o_orderkey", (F.col("o_orderkey") * 7 + 3).alias("to_key")).join(known, "to_key", "left")

    @cached_property
    def relationships(self) -> DataFrame:
        key, bad = F.col("o_orderkey"), F.col("bad")
        link = F.concat(text("o_orderkey"), F.lit("->"), text("to_key"))
        resolved = F.col("there").isNotNull()
        return self.shaped(
            self.both(self.edges), "relationships", "relationship.depends_on", link, self.order_path("o_orderkey"), True,
            id=pid("relationship.depends_on", link), kind=F.lit("depends_on"), from_record_id=pid("order", text("o_orderkey")),
            to_record_id=F.when(resolved & ~(bad & (key % 107 == 0)), pid("order", text("to_key"))),
            from_source_id=text("o_orderkey"), to_source_id=text("to_key"),
            resolution_state=F.when(resolved | (bad & (key % 103 == 0)), "RESOLVED").otherwise("PARTIAL_EXTERNAL"),
            source_metadata_json=F.concat(F.lit('{"from":"'), text("o_orderkey"), F.lit('"}')))

    @cached_property
    def archive_metadata(self) -> DataFrame:
        """What the tables say about themselves; in s2 one value is wrong and one key is missing."""
        stored = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (
            ("connector", F.lit(PROVIDER)), ("source_workspace_id", F.when(F.col("bad"), "w2").otherwise("w1")),
            ("source_snapshot_logical_digest", F.lit("sha256:d")), ("archive_status", F.col("status")),
            ("writer_version", F.lit("1")), ("archive_schema_version", F.lit("3")), ("source_snapshot_atomic", F.lit("false")),
            ("verification_status", F.when(~F.col("bad"), "NOT_RUN")))])
        return self.manifest.select("snapshot_id", F.explode(stored).alias("m")).select("snapshot_id", "m.*").filter("value IS NOT NULL")

    @cached_property
    def tables(self) -> Tables:
        return Tables({name: partial(getattr, self, name) for name in (
            "archive_metadata", "workspaces", "containers", "collections", "records", "identities", "record_identities", "record_tags",
            "comments", "field_definitions", "record_field_values", "relationships", "attachments")})

    # --- source index

    @cached_property
    def entities(self) -> DataFrame:
        """Typed nodes the extraction saw, without links."""
        def node(frame, kind, identifier, parent_type=None, parent_id=None):
            return self.both(frame).select(
                "snapshot_id", F.lit(kind).alias("type"), identifier.cast("string").alias("id"),
                (parent_type if isinstance(parent_type, Column) else F.lit(parent_type)).cast("string").alias("parent_type"),
                (parent_id if parent_id is not None else F.lit(None)).cast("string").alias("parent_id"), F.lit(False).alias("composite"))

        fields = self.read("labels").agg(F.count("quality").alias("n")).select(F.explode(F.array(F.lit("quality"), F.lit("toxic"))).alias("f"))
        first = F.col("turn") == 0
        return union_all([
            node(self.snapshots.filter("NOT bad").drop("snapshot_id", "bad").select(F.lit("w1").alias("w")), "workspace", F.col("w")),
            node("region", "region", F.col("r_regionkey"), "workspace", F.lit("w1")),
            node("nation", "nation", F.col("n_nationkey"), "region", F.col("n_regionkey")),
            node("customer", "customer", F.col("c_custkey"), "nation", F.col("c_nationkey")),
            node("orders", "order", F.col("o_orderkey"), "customer", F.col("o_custkey")),
            node(self.lines, "line", F.col("line_id"), "order", F.col("l_orderkey")),
            node(self.turns, "turn", F.col("turn_id"), F.when(first, "order").otherwise("turn"),
                 F.when(first, text("conv_id")).otherwise(F.concat_ws("-", "conv_id", F.col("turn") - 1))),
            node("documents", "document", F.col("doc_id"), "order", F.col("doc_id")),
            node(fields, "field", F.col("f"))])

    @cached_property
    def links(self) -> DataFrame:
        return self.both("orders").select("snapshot_id", F.lit("depends_on").alias("kind"), F.concat(
            text("o_orderkey"), F.lit("->"), (F.col("o_orderkey") * 7 + 3).cast("string")).alias("id"),
            text("o_orderkey").alias("from_id"), (F.col("o_orderkey") * 7 + 3).cast("string").alias("to_id"))

    @stored
    def index(self) -> DataFrame:
        return build_source_index(self.entities, self.links, ("order", "line"))

    # --- files and manifest

    @cached_property
    def landed(self) -> DataFrame:
        """Every file of the undamaged archive: (path, bytes, checksum, number)."""
        def files(frame, path, content, number):
            return frame.select(path.alias("path"), F.octet_length(content).cast("long").alias("bytes"), digest(content).alias("checksum"),
                                number.cast("long").alias("number"))

        def raw(name, key, folder, size):
            grouped = self.read(name).groupBy(E(f"{key} div {size}").alias("number")).agg(F.count(F.lit(1)).alias("n"))
            return files(grouped, F.concat(F.lit(f"raw/{folder}/"), text("number"), F.lit(".json")), text("n"), F.col("number"))

        single = self.read("region").agg(F.count(F.lit(1)).alias("n")).select("n", F.explode(F.array(*[
            F.lit(p) for p in ("manifest.json", "schema.json", "raw/inventory.json", "raw/region.json", "raw/nation.json", "raw/field.json")])).alias("p"))
        return union_all([
            files(self.read("documents"), F.concat(F.lit("attachments/"), text("doc_id"), F.lit(".txt")), F.col("text"), F.col("doc_id")),
            files(self.read("pages"), F.concat(F.lit("raw/page/"), text("page_id"), F.lit(".html")), F.col("html"), F.col("page_id")),
            files(single, F.col("p"), text("n"), F.lit(1)), raw("customer", "c_custkey", "customer", 100), raw("orders", "o_orderkey", "order", 100),
            raw("lineitem", "l_orderkey", "line", 100), raw("supplier", "s_suppkey", "supplier", 10), raw("conversations", "conv_id", "turn", 10),
            raw("documents", "doc_id", "document", 10)])

    @cached_property
    def files(self) -> DataFrame:
        """Files found; in s2 some are missing and some altered."""
        bad, n, path = F.col("bad"), F.col("number"), F.col("path")
        attached = path.startswith("attachments/")
        gone = bad & ((attached & (n % 19 == 0)) | (path.startswith("raw/customer/") & (n % 5 == 0)) | (path == "schema.json"))
        changed = bad & attached & (n % 23 == 0)
        return self.both(self.landed).filter(~gone).select(
            "snapshot_id", "path", F.when(changed, F.col("bytes") + 1).otherwise(F.col("bytes")).alias("bytes"),
            F.when(changed | (bad & (path.startswith("raw/page/")) & (n % 7 == 0)), digest(F.lit("altered"))).otherwise(F.col("checksum")).alias("checksum"))

    @cached_property
    def manifest_files(self) -> DataFrame:
        """Files the manifest lists; in s2 it hides some, repeats some and lists one outside the archive."""
        bad, n, page = F.col("bad"), F.col("number"), F.col("path").startswith("raw/page/")
        listed = self.both(self.landed).filter((F.col("path") != "manifest.json") | bad).filter(~(bad & page & (n % 11 == 0)))
        times = F.when(bad & page & (n % 17 == 0), 2).otherwise(1)
        repeated = listed.withColumn("_t", F.explode(F.sequence(F.lit(1), times)))
        path = F.when(bad & (F.col("path") == "raw/field.json"), "../field.json").otherwise(F.col("path"))
        return repeated.select("snapshot_id", path.alias("path"), "bytes", "checksum")

    @cached_property
    def manifest_attachments(self) -> DataFrame:
        return self._attachments(False).select("snapshot_id", "id", "source_id", "record_id", "filename", "media_type", "expected_size",
                                               F.col("download_status").alias("status"), "local_path", "archived_size", "checksum", "error")

    @cached_property
    def expected(self) -> DataFrame:
        """What the extraction counted: (snapshot_id, entity, expected)."""
        def n(frame, entities):
            frame = self.read(frame) if isinstance(frame, str) else frame
            return frame.agg(F.count(F.lit(1)).alias("expected")).select("expected", F.explode(F.array(*[F.lit(e) for e in entities])).alias("entity"))

        parts = union_all([
            n("region", ["containers", "container:region"]), n("nation", ["containers", "container:nation"]), n("customer", ["collections"]),
            n("orders", ["records", "record:order", "relationships"]), n(self.lines, ["records", "nested_records", "record:line"]),
            n("conversations", ["comments"]), n("documents", ["attachments"]),
            self.read("labels").agg(F.count(F.lit(1)).alias("n")).select(F.lit(2).cast("long").alias("expected"), F.lit("custom_fields").alias("entity"))])
        return self.both(parts.groupBy("entity").agg(F.sum("expected").alias("expected"))).select("snapshot_id", "entity", "expected")

    @cached_property
    def manifest_inventory(self) -> DataFrame:
        inflated = F.when((F.col("snapshot_id") == "s2") & (F.col("entity") == "collections"), 5).otherwise(0)
        return self.expected.select("snapshot_id", "entity", "expected", (F.col("expected") + inflated).alias("archived"),
                                    F.lit(0).cast("long").alias("unresolved"))

    @cached_property
    def manifest_observed(self) -> DataFrame:
        def n(frame, entity, times=1):
            frame = self.read(frame) if isinstance(frame, str) else frame
            return frame.agg((F.count(F.lit(1)) * times).alias("n")).select(F.lit(entity).alias("entity"), "n")

        rows = self.both(union_all([
            self.read("region").agg(F.count(F.lit(1)).alias("r")).select(F.lit("workspaces").alias("entity"), F.lit(1).cast("long").alias("n")),
            n("supplier", "identities"), n(self.lines, "record_identity_roles"), n("orders", "record_tags", 2), n("labels", "record_field_values", 2)]))
        return rows.filter("NOT bad OR entity <> 'workspaces'").select("snapshot_id", "entity", F.when(
            F.col("bad") & (F.col("entity") == "record_tags"), F.col("n") + 1).otherwise(F.col("n")).alias("n"))

    @cached_property
    def manifest_discrepancies(self) -> DataFrame:
        """Links to orders that do not exist; s2 hides some and invents one per 50 documents."""
        known = self.read("orders").select((F.col("o_orderkey")).alias("to_key"))
        open_links = self.read("orders").select("o_orderkey", (F.col("o_orderkey") * 7 + 3).alias("to_key")).join(known, "to_key", "left_anti")
        stated = self.both(open_links).filter(~(F.col("bad") & (F.col("o_orderkey") % 53 == 0))).select(
            "snapshot_id", F.lit("RELATIONSHIP_PARTIAL_EXTERNAL").alias("kind"),
            F.concat(text("o_orderkey"), F.lit("->"), text("to_key")).alias("source_id"), F.lit("endpoint outside").alias("message"))
        invented = self.both("documents").filter("bad AND doc_id % 50 = 1").select(
            "snapshot_id", F.lit("ATTACHMENT_UNRESOLVED").alias("kind"), text("doc_id").alias("source_id"), F.lit("stated").alias("message"))
        return stated.unionByName(invented)

    @cached_property
    def manifest(self) -> DataFrame:
        """Header row per snapshot; times come from the data."""
        times = self.read("orders").agg(F.max("o_orderdate").alias("source_snapshot_completed_at"))
        bad = F.col("bad")
        return self.both(times).select(
            "snapshot_id", "bad", F.when(bad, 4).otherwise(3).alias("schema_version"), F.lit(PROVIDER).alias("connector"),
            F.lit("w1").alias("workspace_id"), F.when(bad, "CREATED_UNVERIFIED").otherwise("INCOMPLETE").alias("status"),
            F.when(~bad, "NOT_RUN").alias("verification_status"), F.lit(1).alias("capability_schema_version"), F.lit(False).alias("atomic"),
            F.lit("sha256:d").alias("logical_digest"), F.lit("sha256:c").alias("capability_digest"), F.lit("1").alias("writer_version"),
            F.when(~bad, "u1").alias("extracted_by_id"), "source_snapshot_completed_at",
            F.when(bad, F.col("source_snapshot_completed_at") - E("INTERVAL 90 SECONDS")).otherwise(
                F.col("source_snapshot_completed_at") + E("INTERVAL 2 HOURS")).alias("archive_completed_at"))

    # --- capabilities and health, from parts: eight per group

    @cached_property
    def capabilities(self) -> DataFrame:
        """Eight capability rows per part group; values from the part, some of them not allowed."""
        size, key = F.col("p_size"), F.col("p_partkey")
        state = F.when(size % 5 == 0, "PARTIAL").when(size % 11 == 0, "UNSUPPORTED").when(size == 49, "GREAT").otherwise("SUPPORTED")
        availability = (F.when(F.col("p_type") == "ECONOMY", "FAILED").when(F.col("p_type") == "PROMO", "UNAVAILABLE")
                        .when(F.col("p_type") == "SMALL", "UNKNOWN").when(size == 48, "SOMETIMES").otherwise("AVAILABLE"))
        return self.read("part").select(
            F.concat(F.lit("p"), E("p_partkey div 8").cast("string")).alias("snapshot_id"),
            F.when(size == 47, "Bad-Id").when(key % 8 == 7, "attachment_content").when(size == 46, "cap_0").otherwise(
                F.concat(F.lit("cap_"), (key % 8).cast("string"))).alias("id"),
            F.when(size == 45, "").otherwise(F.col("p_name")).alias("name"),
            F.when(size % 3 == 0, "OPTIONAL").otherwise("REQUIRED").alias("requirement"),
            F.when(size == 44, "PARTIAL").otherwise(state).alias("implementation"), availability.alias("availability"), state.alias("state"),
            F.col("p_brand").alias("note"))

    @cached_property
    def capability_snapshots(self) -> DataFrame:
        return self.read("part").select(F.concat(F.lit("p"), E("p_partkey div 8").cast("string")).alias("snapshot_id"),
                                        F.lit(1).alias("capability_schema_version")).distinct()

    @cached_property
    def evidence(self) -> DataFrame:
        from queries.normalize import evidence
        return evidence(self)

    # --- event log: one operation per user, ten scopes

    @stored
    def event_log(self) -> DataFrame:
        """Events in the log's own columns. Positions come from a range-partitioned numbering, as a user may be hot."""
        numbered = ordered_positions(self.read("events"), ["user_id"], ["event_id"], "sequence")
        kind = F.col("event_type")

        def by_kind(**values):
            out = F.lit(None).cast("string")
            for name, value in values.items():
                out = F.when(kind == name, value).otherwise(out)
            return out

        place = (F.col("user_id") % 10).cast("string")
        path = F.concat(F.lit("/a/"), text("event_id"))
        empty = F.create_map().cast("map<string,string>")
        metadata = (F.when((kind == "purchase") & (F.col("event_id") % 3 != 0), F.create_map(F.lit("archive_path"), path))
                    .when(kind == "error", F.create_map(F.lit("reason"), F.lit("NETWORK_FAILURE")))
                    .when(kind == "signup", F.create_map(F.lit("result"), F.when(F.col("event_id") % 4 == 0, "FAILED").otherwise("VERIFIED"),
                                                         F.lit("archive_path"), path, F.lit("manifest_checksum"), F.lit("sha256:c")))
                    .when(kind == "click", F.create_map(F.lit("health_state"), F.lit("DEGRADED"), F.lit("reason"), F.lit("RATE_LIMITED"))).otherwise(empty))
        return numbered.select(
            "event_id", F.lit(2).alias("schema_version"),
            by_kind(view="operation.started", purchase="operation.completed", error="operation.failed", signup="verification.recorded",
                    click="connector.unhealthy").alias("type"),
            F.lpad(text("user_id"), 10, "0").alias("operation_id"), F.col("sequence").cast("int").alias("sequence"),
            F.col("ts").cast("timestamp").alias("recorded_at"), F.lit(PROVIDER).alias("connector"), F.concat(F.lit("w"), place).alias("workspace_id"),
            F.concat(F.lit("/b/"), place).alias("destination"), F.lit("backup").alias("operation"), F.lit("scan").alias("stage"),
            by_kind(view="STARTED", purchase="SUCCEEDED", error="FAILED", signup="SUCCEEDED").alias("outcome"),
            F.concat(F.lit("props "), "props").alias("message"), metadata.alias("metadata"))

    # --- checks and counts per group of orders, for verdicts and reports

    @cached_property
    def check_groups(self) -> DataFrame:
        return self.read("orders").select(F.concat(F.lit("o"), E("o_orderkey div 20").cast("string")).alias("snapshot_id")).distinct()

    @cached_property
    def checks(self) -> DataFrame:
        """Twenty checks per group of orders; the group decides how bad they can be, some did not run."""
        key, customer = F.col("o_orderkey"), F.col("o_custkey") % 8
        level = E("o_orderkey div 20") % 4
        status = (F.when((level == 3) & (customer == 0), "FAIL").when((level == 3) & (customer == 3), "NOT_EVALUATED")
                  .when((level >= 2) & (customer == 2), "INCOMPLETE").when((level >= 1) & (customer == 1), "UNPROVEN").otherwise("PASS"))
        names = F.array(*[F.lit(name) for name in CHECKS])
        return self.read("orders").filter("o_custkey % 31 <> 0").select(
            F.concat(F.lit("o"), E("o_orderkey div 20").cast("string")).alias("snapshot_id"), ((key % 20) + 1).alias("check_order"),
            F.element_at(names, ((key % 20) + 1).cast("int")).alias("check_name"), status.alias("status"))

    @cached_property
    def counts(self) -> DataFrame:
        """Reconciled counts per group of customers and entity."""
        entity = F.when(F.col("o_orderpriority") == "1-URGENT", "attachments").when(F.col("o_orderpriority") == "2-HIGH", "nested_records").otherwise(
            F.concat(F.lit("record:"), F.substring("o_orderpriority", 1, 1)))
        grouped = self.read("orders").groupBy(F.concat(F.lit("o"), E("o_custkey div 5").cast("string")).alias("snapshot_id"), entity.alias("entity")).agg(
            F.count(F.lit(1)).alias("expected"), F.count_if(F.col("o_orderstatus") != "F").alias("archived"))
        return grouped.withColumn("unresolved", F.col("expected") - F.col("archived")).withColumn(
            "status", F.when(F.col("unresolved") > 0, "INCOMPLETE").otherwise("PASS"))

    @cached_property
    def verdicts(self) -> DataFrame:
        return verdict(self.checks, self.check_groups)
