"""Ancestors, cycles and positions against brute force, with and without the hot-key path."""

import random
from collections import Counter

import pytest
from pyspark.sql import Window, functions as F

from sealcheck import rules as R
from sealcheck.operators import trees
from sealcheck.operators.checks import orphans, ownership
from sealcheck.operators.organize import document_parts
from sealcheck.operators.trees import parent_cycles, resolve_ancestor
from sealcheck.skew import ordered_positions, running_total


def forest(seed):
    chance = random.Random(seed)
    parents = {f"n{i}": f"n{chance.randrange(i)}" if i and chance.random() < 0.95 else None for i in range(150)}
    parents |= {f"d{i}": f"d{i - 1}" if i else "n3" for i in range(200)}       # a deep chain
    parents |= {f"h{i}": "n1" for i in range(150)}                              # a hot parent
    parents |= {"c0": "c2", "c1": "c0", "c2": "c1", "c3": "c0", "c4": "c3", "self": "self", "lost": "gone", "below": "lost"}
    return parents


def walk(parents, start, accepted):
    seen, node = {start}, start
    while True:
        parent = parents[node]
        if parent is None:
            return None, "NO_PARENT"
        if parent not in parents:
            return None, "MISSING_PARENT"
        if parent in accepted:
            return parent, "FOUND"
        if parent in seen:
            return None, "CYCLE"
        seen.add(parent)
        node = parent


@pytest.mark.parametrize("seed,floor", [(1, 1_000_000), (2, 20)])
def test_ancestors_match_a_plain_walk(spark, seed, floor):
    parents = forest(seed)
    accepted = {"n0", "n5", "d100", "c3"}
    frame = spark.createDataFrame([("s", n, p, n in accepted) for n, p in parents.items()], "snapshot_id string, node string, parent string, ok boolean")
    got = {r.node: (r.ancestor, r.outcome) for r in resolve_ancestor(frame, F.col("ok"), share=4, floor=floor).collect()}
    assert got == {n: walk(parents, n, accepted) for n in parents}


def test_a_round_carries_only_what_it_found(spark, monkeypatch):
    """64 chains of different depth beside 3000 flat nodes: what rounds write falls with the live nodes."""
    rows = [("s", f"c{c}-{i}", f"c{c}-{i - 1}" if i else None) for c in range(64) for i in range(1 + c)] + [("s", f"f{i}", None) for i in range(3000)]
    frame = spark.createDataFrame(rows, "snapshot_id string, node string, parent string")
    written = []

    def counted(part):
        stored = cut(part)
        written.append((stored.count(), stored.filter("jump IS NOT NULL").count()))
        return stored

    cut = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", counted)
    got = trees.resolve_ancestor(frame, F.lit(False))
    assert got.count() == len(rows) and got.filter("outcome <> 'NO_PARENT'").count() == 0
    rounds = written[1:]
    assert [live for _, live in rounds] == [sum(max(0, c + 1 - 2 ** k) for c in range(64)) for k in range(7)]
    assert all(size <= 2 * live for (size, _), (_, live) in zip(rounds[1:], rounds))


def test_cycles_include_nodes_that_lead_in(spark):
    parents = forest(3)
    frame = spark.createDataFrame([("s", n, p) for n, p in parents.items()], "snapshot_id string, node string, parent string")
    assert {r.node for r in parent_cycles(frame).collect()} == {"c0", "c1", "c2", "c3", "c4", "self"}


@pytest.mark.parametrize("seed,floor", [(4, 1_000_000), (5, 20)])
def test_cycles_of_random_graphs(spark, seed, floor):
    """Every node has any parent, also one that is no node; a repeated node counts with its smallest parent."""
    chance = random.Random(seed)
    rows = [(f"s{n % 2}", f"n{n}", chance.choice([None, "gone", "n1"] + [f"n{chance.randrange(400)}"] * 9)) for n in range(400)]
    rows += [("s0", "n2", "n0"), ("s0", "n2", "n2")]
    parents = {}
    for snapshot, node, parent in rows:
        old = parents.get((snapshot, node))
        parents[snapshot, node] = old if parent is None else parent if old is None else min(old, parent)
    want = set()
    for start in parents:
        at, steps = start, 0
        while at in parents and parents[at] is not None and steps <= len(parents):
            at, steps = (at[0], parents[at]), steps + 1
        if steps > len(parents):
            want.add(start)
    frame = spark.createDataFrame(rows, "snapshot_id string, node string, parent string")
    got = [(r.snapshot_id, r.node) for r in parent_cycles(frame, share=4, floor=floor).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_orphans_of_all_keys_against_a_plain_lookup(spark):
    """A hot parent, a hot missing id, an id that exists in another snapshot or table only, nulls and repeated rows."""
    chance, columns = random.Random(6), {}
    for child, key, column, parent in R.FOREIGN_KEYS:
        columns.setdefault(child, {"id"}).update({key, column})
        columns.setdefault(parent, {"id"})
    ids = [None, "p0", "p0", "p0", "gone", "gone"] + [f"p{n}" for n in range(12)]
    rows = {table: [{"snapshot_id": f"s{n % 2}", **{c: chance.choice(ids) for c in sorted(names)}, "id": f"p{n % 9}"} for n in range(40)]
            for table, names in columns.items()}
    tables = {table: spark.createDataFrame(found, ", ".join(f"{c} string" for c in found[0])) for table, found in rows.items()}
    have = {(table, r["snapshot_id"], r["id"]) for table, found in rows.items() for r in found}
    want = Counter((r["snapshot_id"], f"{child}.{column}", r[key], r[column]) for child, key, column, parent in R.FOREIGN_KEYS
                   for r in rows[child] if r[column] is not None and (parent, r["snapshot_id"], r[column]) not in have)
    assert Counter((r.snapshot_id, r.entity, r.key, r.detail) for r in orphans(tables).collect()) == want and want


def test_ownership_of_rows(spark):
    """Only snapshots with exactly one workspace are judged; a row without workspace is in the wrong one."""
    spaces = spark.createDataFrame([("one", "w"), ("two", "w"), ("two", "v")], "snapshot_id string, id string")
    owned = spark.createDataFrame([("one", "a", "w"), ("one", "b", "x"), ("one", "c", None), ("one", "d", ""), ("two", "e", "x"), ("none", "f", "x")],
                                  "snapshot_id string, id string, workspace_id string")
    found = ownership({"workspaces": spaces, **{table: owned for table in R.WORKSPACE_OWNED}}).collect()
    assert {(r.entity, r.key, r.detail) for r in found} == {(t, k, d) for t in R.WORKSPACE_OWNED for k, d in (("b", "x"), ("c", None), ("d", ""))}
    assert len(found) == 3 * len(R.WORKSPACE_OWNED)


def test_positions_of_a_hot_group(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("g"), (F.col("id") * 37 % 3000).alias("o"))
    want = rows.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("o")))
    got = ordered_positions(rows, ["g"], ["o"], partitions=16)
    assert got.exceptAll(want).count() == 0 and got.count() == 3000


def test_totals_of_a_null_group_over_many_ranges(spark):
    rows = spark.range(2000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 5).alias("g"), F.col("id").alias("o"))
    want = rows.withColumn("total", F.sum(F.col("o") % 7).over(Window.partitionBy("g").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)))
    got = running_total(rows, ["g"], ["o"], F.col("o") % 7, "total", partitions=16)
    assert got.exceptAll(want).count() == 0 and got.count() == 2000


BLOCKS = "snapshot_id string, record_id string, section_no int, section string, k1 string, k2 string, k3 string, text string"


def block(record, key, text, section=4):
    return "s", record, section, "comments", key, "", "", text


@pytest.mark.parametrize("bound", [9, 64, 500, 4001, 100_000])
def test_parts_stay_within_their_bytes_and_are_the_document(spark, bound):
    """Many small blocks, long ones of wide characters, equal long ones with equal keys, an empty one, an empty document."""
    chance = random.Random(bound)
    rows = [block("big", f"{n:05d}", f"<{n}>" + "ä€😀\n"[n % 4] * chance.randrange(9)) for n in range(600)]
    rows += [block("wide", f"{n}", "".join(chance.choice("aß€😀") for _ in range(700))) for n in range(4)] + [block("wide", "2b", "")]
    rows += [block("twins", "0", "".join(map(str, range(900)))) for _ in range(3)] + [block("small", "0", "t", 1), block("empty", "0", "")]
    want = {record: "".join(r[7] for r in sorted(r for r in rows if r[1] == record)) for record in ("big", "wide", "twins", "small", "empty")}
    parts = document_parts(spark.createDataFrame(rows, BLOCKS), bound).orderBy("record_id", "part").collect()
    got = {record: [r for r in parts if r.record_id == record] for record in want}
    assert {record: "".join(r.content for r in found) for record, found in got.items()} == want
    assert all([r.part for r in found] == list(range(len(found))) for found in got.values())
    assert max(len(r.content.encode()) for r in parts) <= bound


def test_one_very_long_block_is_cut(spark):
    rows = spark.range(1).select(F.lit("s").alias("snapshot_id"), F.lit("r").alias("record_id"), F.lit(0).alias("section_no"), F.lit("record").alias("section"),
                                 F.lit("").alias("k1"), F.lit("").alias("k2"), F.lit("").alias("k3"), F.expr("repeat('0123456789', 10000000)").alias("text"))
    sizes = [r.n for r in document_parts(rows, 8 << 20).select("part", F.octet_length("content").alias("n")).orderBy("part").collect()]
    assert sum(sizes) == 100_000_000 and max(sizes) <= 8 << 20
