"""Trees of shared conversation openings by ROLLUP over positional turn ids (operator 11)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.llm.common import running
from sealcheck.session import cut_lineage
from sealcheck.skew import lookup

WIDTH = 4
CHUNK = 1000
SPACE = "[^\\x20\\x09-\\x0D]+"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, position, turn_id, words) of every turn: position from 1, turn_id 16 bytes that tell (role, text) apart.

    Turns stand in the order of `turn`, null first; equal ones by turn_id. Null role or text is empty text, rows
    without conv_id belong to no conversation, equal rows are turns of their own. Texts stay behind: only ids travel.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("turn_id"),
        F.regexp_count(text, F.lit(SPACE)).cast("long").alias("words"), F.lit(1).cast("long").alias("one"))
    return running(rows, ["conv_id"], ["turn", "turn_id"], {"position": "one"}).select("conv_id", "position", "turn_id", "words")


def turn_texts(conversations: DataFrame) -> DataFrame:
    """(turn_id, role, text): what each turn_id stands for."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.select(F.unhex(F.md5(F.concat(F.length(role), F.lit(":"), role, text))).alias("turn_id"), role.alias("role"), text.alias("text")).dropDuplicates(["turn_id"])


def regraft(sequences: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Conversations whose opening is that of a neighbour, in the shape of `turns`.

    With h = crc32(conv_id) % most, conversation c takes the first h turns of conversation c - c % every (all, if it
    has fewer; none, if there is no such conversation) and goes on with its own turns after its first h. One that has
    no turn then is a row with null position.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % every
    sizes = cut_lineage(sequences.groupBy("conv_id").agg(F.max("position").alias("size")))
    lent = sequences.filter((F.col("conv_id") % every == 0) & (F.col("position") < most)).withColumnRenamed("conv_id", "base")
    taking = sizes.select("conv_id", "size", h.alias("h"), base.alias("base")).join(
        sizes.select(F.col("conv_id").alias("base"), F.least("size", F.lit(most - 1).cast("long")).alias("lends")), "base", "left")
    taking = cut_lineage(taking.select("conv_id", "size", "h", "base", F.least("h", F.coalesce("lends", F.lit(0).cast("long"))).alias("taken")))
    opening = taking.join(lent, "base").filter("position <= h").select("conv_id", "position", "turn_id", "words")
    # Where a neighbour lends all h turns, the rest keeps its places; only other conversations are looked up.
    moved = taking.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("back"))
    rest = sequences.filter(F.col("position") > h).join(moved, "conv_id", "left").select(
        "conv_id", (F.col("position") - F.coalesce("back", F.lit(0).cast("long"))).alias("position"), "turn_id", "words")
    bare = taking.filter("taken = 0 AND size <= h").selectExpr("conv_id", "CAST(NULL AS BIGINT) AS position", "CAST(NULL AS BINARY) AS turn_id", "CAST(NULL AS BIGINT) AS words")
    return opening.union(rest).union(bare)


def _marks(position: Column, turn_id: Column) -> list[Column]:
    """Two 64-bit hashes of a turn at its place; those of a prefix are combined by exclusive or, so any part can be taken alone."""
    return [F.xxhash64(F.lit(seed), position, turn_id) for seed in (1, 2)]


def _roll(blocks: DataFrame, width: int, values: str) -> DataFrame:
    """All prefixes of all blocks in one aggregation: ROLLUP over the block's turn ids under the node the block hangs from."""
    ids = ", ".join(f"t{j}" for j in range(1, width + 1))
    rolled = blocks.sparkSession.sql(f"""
        SELECT block, before1, before2, {ids}, {width} - bit_count(grouping_id()) AS level, {values}
        FROM {{blocks}} GROUP BY block, before1, before2, ROLLUP ({ids})""", blocks=blocks)
    # A conversation that ends inside a block has null ids behind; the root is the empty prefix of first blocks.
    last = F.element_at(F.array(*[F.col(f"t{j}") for j in range(1, width + 1)]), F.when(F.col("level") > 0, F.col("level")))
    rolled = rolled.withColumn("turn_id", last).filter("turn_id IS NOT NULL OR (level = 0 AND block = 0)")
    node, above = [F.col("before1"), F.col("before2")], [F.col("before1"), F.col("before2")]
    for j in range(1, width + 1):
        for i, mark in enumerate(_marks(F.col("block") * width + j, F.col(f"t{j}"))):
            node[i] = node[i].bitwiseXOR(F.when(F.col("level") >= j, mark).otherwise(F.lit(0)))
            above[i] = above[i].bitwiseXOR(F.when(F.col("level") > j, mark).otherwise(F.lit(0)))
    depth = F.col("block") * width + F.col("level")
    return rolled.withColumns({"node": F.struct(node[0].alias("a"), node[1].alias("b")), "depth": depth,
                               "parent": F.when(depth > 0, F.struct(above[0].alias("a"), above[1].alias("b")))})


def _hash_lists(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's list, whose pieces come in order; only the state of one hash is held."""
    held, state = None, None
    for batch in batches:
        done = []
        for a, b, piece in zip(batch["a"], batch["b"], batch["piece"]):
            if (a, b) == held:
                state.update(b"," + piece.encode())
                continue
            if held is not None:
                done.append((*held, state.hexdigest()))
            held, state = (a, b), hashlib.sha256(piece.encode())
        yield pd.DataFrame(done, columns=["a", "b", "digest"])
    if held is not None:
        yield pd.DataFrame([(*held, state.hexdigest())], columns=["a", "b", "digest"])


def _ends(blocks: DataFrame, chunk: int) -> DataFrame:
    """(node, digest): hash of the ids of all conversations that end at a node, however many: in pieces of `chunk`."""
    ends = blocks.groupBy("conv_id").agg(F.bit_xor("x1").alias("a"), F.bit_xor("x2").alias("b")).withColumn("one", F.lit(1).cast("long"))
    pieces = running(ends, ["a", "b"], ["conv_id"], {"n": "one"}).groupBy("a", "b", F.expr(f"(n - 1) DIV {chunk}").alias("chunk")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("piece"))
    hashed = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "chunk").mapInPandas(_hash_lists, "a long, b long, digest string")
    return hashed.select(F.struct("a", "b").alias("node"), "digest")


def prefix_tree(sequences: DataFrame, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """The tree of all openings that conversations share, one row per node; `sequences` has the shape `turns` gives.

    A node is a distinct sequence of first turns, told apart by 128 bits; the root is the empty one. A conversation is
    a member of every node it starts with. Columns: conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves (childless nodes in the subtree, itself included), saved_tokens (over the subtree, words
    of a node's last turn times members but one), ends_sha256 (over the ascending ids of conversations that end there)
    and turn_id (null at the root).

    Conversations are cut into blocks of `width` turns, one column each; a block hangs from the node its conversation has
    reached before, so one ROLLUP gives all nodes at any depth, and grouping_id says how deep. What a subtree holds is
    summed without walking it: a node belongs to its smallest member, and the nodes one conversation owns are the end of
    its path. So the subtree of a node is all that its members own, less what its owner owns above it; a second ROLLUP
    adds that up.

    A conversation without turns is a row with null position and a member of the root alone. Equal conversations are
    members each. No conversation or node is held in one task: places, hashes and sums run over ranges of rows.
    An empty table gives no row, not even a root.
    """
    marks = _marks(F.col("position"), F.col("turn_id"))
    place = F.expr(f"(position - 1) % {width}")
    blocks = sequences.groupBy("conv_id", F.expr(f"coalesce((position - 1) DIV {width}, 0L)").alias("block")).agg(
        *[F.max(F.when(place == j - 1, F.col("turn_id"))).alias(f"t{j}") for j in range(1, width + 1)],
        *[F.max(F.when(place == j - 1, F.col("words"))).alias(f"w{j}") for j in range(1, width + 1)],
        *[F.coalesce(F.bit_xor(F.when(F.col("position").isNotNull(), m)), F.lit(0).cast("long")).alias(f"x{i + 1}") for i, m in enumerate(marks)])
    blocks = running(blocks, ["conv_id"], ["block"], xors={"y1": "x1", "y2": "x2"})
    blocks = cut_lineage(blocks.withColumns({f"before{i}": F.col(f"y{i}").bitwiseXOR(F.col(f"x{i}")) for i in (1, 2)}).drop("y1", "y2"))

    nodes = _roll(blocks, width, ", ".join(["count(1) AS n_convs", "min(conv_id) AS conv_id", *[f"max(w{j}) AS w{j}" for j in range(1, width + 1)]]))
    words = F.coalesce(F.element_at(F.array(*[F.col(f"w{j}") for j in range(1, width + 1)]), F.when(F.col("level") > 0, F.col("level"))), F.lit(0).cast("long"))
    nodes = cut_lineage(nodes.select("node", "parent", F.col("depth").cast("long").alias("depth"), "conv_id", "n_convs", "turn_id",
                                     ((F.col("n_convs") - 1) * words).alias("saved")))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))

    owned = cut_lineage(nodes.groupBy("conv_id").agg(F.sum("saved").alias("own_saved"), F.count_if(F.col("n_children") == 0).alias("own_leaves")))
    below = _roll(blocks.join(owned, "conv_id"), width, "sum(own_saved) AS all_saved, sum(own_leaves) AS n_leaves").select("node", "all_saved", "n_leaves")
    nodes = running(nodes, ["conv_id"], ["depth"], {"upto": "saved"})
    nodes = nodes.join(below, "node").join(_ends(blocks, chunk), "node", "left")
    nodes = cut_lineage(nodes.select("node", "parent", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "turn_id", "digest",
                                     (F.col("all_saved") - F.col("upto") + F.col("saved")).alias("saved_tokens")))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return lookup(nodes, above, "parent", nodes.count()).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"), "turn_id")
