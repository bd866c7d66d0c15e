"""What queries leave on disk while they run: only what they read again, in a codec that packs ids."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from queries import load, mapping
from queries.mapping import Mapping, Tables
from sealcheck.functions.ids import packed, unpacked
from sealcheck.operators import organize as O
from sealcheck.operators.checks import relationship_evidence
from sealcheck.operators.trees import parent_cycles
from sealcheck.session import cut_lineage
from sealcheck.skew import sieve

DATA = "/root/testdata/sf0.001"


def ids(spark, n=2000):
    return spark.range(n).select(F.lit("s1").alias("snapshot_id"), F.concat(F.lit("sc_"), F.sha2(F.col("id").cast("string"), 256)).alias("id"))


def test_written_ids_take_less_than_their_digits(spark):
    frame = cut_lineage(ids(spark).coalesce(1))
    size = sum(Path(path.removeprefix("file:")).stat().st_size for path in frame.inputFiles())
    assert frame.count() == 2000 and size < 2000 * 45
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "true"


def test_tables_are_made_when_asked_for():
    made = []
    tables = Tables({name: lambda name=name: made.append(name) or name for name in ("a", "b")})
    assert list(tables) == ["a", "b"] and len(tables) == 2 and not made
    assert (tables["b"], tables["b"], made) == ("b", "b", ["b"])
    assert {**tables, "a": 1} == {"a": 1, "b": "b"}


@pytest.mark.parametrize("name, written", [
    ("f19_reconciliation", {"line_keys", "placed_lines", "edges"}), ("e01_inventory", {"line_keys", "placed_lines", "edges"}),
    ("h06_index_documents", set()), ("h05_record_attachments_section", set()), ("h04_view_paths", {"line_keys", "placed_lines"}),
    ("d10_normalize_field_definitions", set())])
def test_queries_write_keys_only(spark, monkeypatch, name, written):
    monkeypatch.setattr(mapping, "_WRITTEN", {})
    load().QUERIES[name](spark, DATA)
    assert {key[2] for key in mapping._WRITTEN} == written


def test_index_pages_need_no_records(spark):
    tables = Mapping(spark, DATA).tables
    some = {name: tables[name].filter("snapshot_id = 's1'") for name in ("workspaces", "containers", "collections")}
    assert O.index_documents(some).filter("table = 'collections'").count() == some["collections"].count()


def test_packed_ids_come_back(spark):
    good = "sc_" + "0a" * 32
    texts = [good, good.upper(), "sc_" + "0A" * 32, good[:-1], good + "0", "sc_", "s", "", "bad_1", "sc_\x00x", "sc_\x01x", "sc_" + "g" * 64, "ümlaut", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", packed("t").alias("p")).select("t", "p", unpacked("p").alias("back")).collect()
    assert [r.back for r in rows] == texts
    assert len({bytes(r.p) for r in rows if r.p is not None}) == len(texts) - 1 and len(rows[0].p) == 36
    ordered = sorted(r.t for r in ids(spark, 50).select(F.col("id").alias("t")).collect())
    assert [r.t for r in spark.createDataFrame([(t,) for t in ordered], "t string").orderBy(packed("t")).collect()] == ordered


def test_repeated_keys_are_found_after_their_hashes(spark):
    """Nodes that repeat with another parent: the smallest parent counts, also where it leads nowhere."""
    rows = [("s", "a", "b"), ("s", "b", "a"), ("s", "c", "a"), ("s", "d", "c"), ("s", "e", "f"), ("s", "f", None), ("s", "g", "0"), ("s", "g", "a"), ("s", "h", "g"), (None, "x", "x")]
    found = parent_cycles(spark.createDataFrame(rows, "snapshot_id string, node string, parent string"))
    assert sorted((r.snapshot_id or "", r.node) for r in found.collect()) == [("", "x"), ("s", "a"), ("s", "b"), ("s", "c"), ("s", "d")]


def test_sieve_keeps_what_is_wanted(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("own"))
    wanted = rows.filter("id % 100 = 7")
    left = {r.id for r in sieve(rows, "own", wanted.select("own"), 1 << 20).collect()}
    assert {r.id for r in wanted.collect()} <= left and len(left) < 400
    assert sieve(rows, "own", wanted.filter("id < 0").select("own")).count() == 0


def test_relationship_evidence_keeps_the_largest_id(spark):
    """Of ids that share a source the largest text counts, whether or not it can be packed as a digest."""
    good, other = "sc_" + "ff" * 32, "sc_zz"
    records = spark.createDataFrame([("s", "a", good), ("s", "a", other), ("s", "b", "bad"), ("s", "b", good)], "snapshot_id string, source_id string, id string")
    links = spark.createDataFrame([("s", "l1", "a", "b", other, good, "RESOLVED"), ("s", "l2", "a", "b", good, "bad", "RESOLVED"), ("s", "l3", "a", "c", other, None, "RESOLVED")],
                                  "snapshot_id string, id string, from_source_id string, to_source_id string, from_record_id string, to_record_id string, resolution_state string")
    found = sorted((r.key, r.code) for r in relationship_evidence(links, records).collect())
    assert found == [("l2", "FROM_WRONG_TARGET"), ("l2", "TO_WRONG_TARGET"), ("l3", "STATE_OVERSTATES")]
