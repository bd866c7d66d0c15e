"""Keys, text columns and connected components shared by the operators of this package."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from sealcheck.session import cut_lineage

KEY = "_row_key"


def row_key(*columns: str) -> Column:
    """16 bytes that tell rows apart by the values of `columns`; null and empty text differ, equal rows share a key."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.length(F.col(c).cast("string")), F.lit(":"),
                                                                     F.col(c).cast("string"))) for c in columns]
    return F.unhex(F.md5(F.concat(*parts)))


def whole_row(docs: DataFrame) -> Column:
    """All columns as one struct `row`, so that their names cannot clash with an operator's own."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row")


def held_out(divisor: int) -> Column:
    """The fold that learning leaves out: crc32 of doc_id as text, a null id counted as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % divisor == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the end points of edges (a, b): component is the smallest node reachable.

    Large-star and small-star steps in turn, each a grouped minimum and one join, until the edges stay as they
    are. Edges never meet in one task: minima combine before the shuffle. Every round is written to the shared
    folder. Null ends are dropped; an edge from a node to itself only names the node.
    """
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = cut_lineage(edges.distinct())
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while (now := edges.agg(mark.alias("m")).first()["m"]) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.union(edges.filter("a = b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        edges = cut_lineage(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).filter("a >= b").distinct())
    return edges.union(edges.select("b", "b")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))


def running(frame: DataFrame, group: list[str], order: list[str], sums: dict[str, str] | None = None, xors: dict[str, str] | None = None) -> DataFrame:
    """Running totals along `order` inside each group, the row itself included, also when one group spans many tasks.

    `sums` and `xors` name new columns and the column each adds up, or combines by exclusive or. Rows are dealt to ranges
    over group and order together, so a hot group takes as many ranges as it needs; what it holds in earlier ranges is
    added to each row. At most one group crosses each border, so these shifts are at most twice as many as ranges.
    Rows that are equal in group and order may stand in any order among themselves.
    """
    wanted = [(new, old, F.sum, lambda a, b: a + b) for new, old in (sums or {}).items()]
    wanted += [(new, old, F.bit_xor, lambda a, b: a.bitwiseXOR(b)) for new, old in (xors or {}).items()]
    ranges = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(frame.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(*group, "_range").agg(*[total(old).alias(new) for new, old, total, _ in wanted])
    shifts = parts.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("_range").alias("_at"), *[total(new).over(before).alias(f"_{new}") for new, _, total, _ in wanted])
    shifts = shifts.filter(" OR ".join(f"_{new} IS NOT NULL" for new, *_ in wanted))
    out = placed.select("*", *[total(old).over(inside).alias(new) for new, old, total, _ in wanted])
    same = F.col("_range") == F.col("_at")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = out.join(F.broadcast(shifts), same, "left")
    return out.select(*frame.columns, *[join(F.col(new), F.coalesce(f"_{new}", F.lit(0))).alias(new) for new, _, _, join in wanted])


def by_group(batches, key: str, columns: list[str]):
    """Whole groups of rows that come sorted by `key`, one frame per group, whatever the batches cut."""
    held = []
    for batch in batches:
        if not len(batch):
            continue
        values = batch[key].to_numpy()
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:]):
            part = batch.iloc[a:b]
            if held and held[0][key].iloc[0] != part[key].iloc[0]:
                yield pd.concat(held)[columns] if len(held) > 1 else held[0][columns]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held)[columns] if len(held) > 1 else held[0][columns]
