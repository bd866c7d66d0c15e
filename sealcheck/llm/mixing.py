"""Mixing sources to target weights by Pfair scheduling (operator 3)."""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sealcheck.llm.common import row_key, whole_row
from sealcheck.session import cut_lineage

BLOCK_ROWS = 16
TEMPERATURE = 0.5
PERIOD = 1024
PLAN_ROWS = 50_000
BUCKET_ROWS = 20_000


def shares(weights: list[float], period: int = PERIOD) -> list[int]:
    """Weights as whole blocks per period, each at least one, by largest remainder."""
    period = max(period, 8 * len(weights))
    total = sum(weights)
    exact = [w * period / total for w in weights]
    out = [max(1, int(x)) for x in exact]
    order = sorted(range(len(out)), key=lambda i: (out[i] - exact[i], i))
    i = 0
    while (gap := period - sum(out)) != 0:
        k = order[i % len(order)] if gap > 0 else max(range(len(out)), key=lambda j: (out[j] - exact[j] if out[j] > 1 else -1e300, j))
        out[k] += 1 if gap > 0 else -1
        i += 1
    return out


def period_slots(blocks: list[int]) -> list[list[int]]:
    """Slots of each source in one period: block k may start at floor(k*D/a) and must end by ceil((k+1)*D/a);
    of the released blocks the one with the earliest deadline takes the slot."""
    period = sum(blocks)
    release: list[list[tuple[int, int]]] = [[] for _ in range(period)]
    for s, a in enumerate(blocks):
        for k in range(a):
            release[k * period // a].append((-(-(k + 1) * period // a), s))
    slots: list[list[int]] = [[] for _ in blocks]
    ready: list[tuple[int, int]] = []
    for t in range(period):
        for item in release[t]:
            heapq.heappush(ready, item)
        deadline, s = heapq.heappop(ready)
        if t >= deadline:
            raise AssertionError("a block missed its deadline")
        slots[s].append(t)
    return slots


def schedule(sizes: list[int], weights: list[float]) -> Iterator[tuple[int, int, int, int, int]]:
    """(source, block, release, slot, deadline) of every block, slot by slot; all weights are above zero.

    The ideal mix pours every source at its weight, and shares the weight of one that has run out among the others in
    proportion. At level v source s has given min(w*v, n), so block k is poured between the slots T(k/w) and
    T((k+1)/w), T(v) being the sum over all sources. Release is the floor of the first, deadline the ceiling of the
    second, in whole numbers without rounding. The ideal mix meets these windows, so the earliest deadline among the
    released blocks meets them too, and no source is a whole block ahead or behind at any slot. Memory grows with
    the sources, not with the blocks.
    """
    exact = [Fraction(w) for w in weights]
    scale = math.lcm(*[x.denominator for x in exact])
    w = [int(x * scale) for x in exact]
    order = sorted(range(len(w)), key=lambda s: Fraction(sizes[s], w[s]))
    ends = [sizes[s] / w[s] for s in order]
    gone = [0, *itertools.accumulate(sizes[s] for s in order)]
    rest = [sum(w) - x for x in [0, *itertools.accumulate(w[s] for s in order)]]

    def poured(s: int, k: int) -> int:
        """T(k/w) times w of source s."""
        i = bisect.bisect_right(ends, k / w[s])
        while i < len(order) and sizes[order[i]] * w[s] <= k * w[order[i]]:
            i += 1
        while i and sizes[order[i - 1]] * w[s] > k * w[order[i - 1]]:
            i -= 1
        return gone[i] * w[s] + k * rest[i]

    coming = [(0, s, 0) for s, n in enumerate(sizes) if n]
    ready: list[tuple[int, int, int, int]] = []
    for slot in range(sum(sizes)):
        while coming and coming[0][0] <= slot:
            release, s, k = heapq.heappop(coming)
            end = poured(s, k + 1)
            heapq.heappush(ready, (-(-end // w[s]), s, k, release))
            if k + 1 < sizes[s]:
                heapq.heappush(coming, (end // w[s], s, k + 1))
        deadline, s, k, release = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield s, k, release, slot, deadline


def _plan(shared):
    """The schedule in frames of bounded size; sources without weight follow the others in equal shares."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in batches:
            keys, sizes, weights = shared.value
            base = 0
            for group, weight in (([s for s, x in enumerate(weights) if x > 0], None), ([s for s, x in enumerate(weights) if not x > 0], 1.0)):
                blocks = schedule([sizes[s] for s in group], [weights[s] if weight is None else weight for s in group]) if group else iter(())
                while part := list(itertools.islice(blocks, PLAN_ROWS)):
                    source, block, *times = zip(*part)
                    yield pd.DataFrame({"key": [keys[group[s]] for s in source], "block": block,
                                        **{c: [base + t for t in x] for c, x in zip(("release", "slot", "deadline"), times)}})
                base += sum(sizes[s] for s in group)
    return run


def mix(docs: DataFrame, weights: dict | None = None, block_rows: int = BLOCK_ROWS, temperature: float = TEMPERATURE,
        bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All rows of docs with mix_slot, mix_release, mix_deadline and mix_position: reading by position meets the weights.

    Rows of a source are put in hash order and cut into blocks of `block_rows`. Every block has a release slot and
    a deadline from the weight of its source, and the earliest deadline goes first, so at any slot a source is
    less than one block ahead or behind its weight, until it runs out (see `schedule`). `weights` gives a weight
    for each source (null under None); left out, a source of n rows weighs n^temperature. Sources without weight
    follow in equal shares. The last block of a source may be short.

    The driver holds one row per source. One task works out the slots, one after the other, and streams them out; the
    rows are dealt to them by source and block. A null source is a source. Equal rows get adjoining places in
    no fixed order. Empty input gives no rows. Columns of the same four names are replaced.
    """
    names = ["mix_slot", "mix_release", "mix_deadline", "mix_position"]
    docs = docs.drop(*names)
    packed = docs.select(whole_row(docs), F.col("source").cast("string").alias("source"),
                         F.xxhash64(row_key("doc_id", "text")).alias("hash"))
    packed = packed.withColumn("key", F.coalesce(F.concat(F.lit("+"), "source"), F.lit("-")))
    counted = sorted(packed.groupBy("key", "source").count().collect(), key=lambda r: r["key"])
    rows = [r["count"] for r in counted]
    # Hash buckets of bounded size give every row its rank in its source without one task per source.
    bits = max(0, (max(rows, default=1) // bucket_rows).bit_length())
    packed = packed.withColumn("bucket", F.expr(f"pmod(hash, {1 << bits})"))
    sizes = packed.groupBy("key", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = packed.withColumn("rank", F.row_number().over(Window.partitionBy("key", "bucket").orderBy("hash")))
    target = [float(weights.get(r["source"], 0)) if weights is not None else r["count"] ** temperature for r in counted]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(([r["key"] for r in counted], [-(-n // block_rows) for n in rows], target))
    plan = cut_lineage(spark.range(0, 1, 1, 1).mapInPandas(_plan(shared), "key string, block long, release long, slot long, deadline long"))
    placed = (ranked.join(sizes, ["key", "bucket"]).withColumn("rank", F.col("rank") + F.col("before") - 1)
              .withColumn("block", F.floor(F.col("rank") / block_rows)).join(plan, ["key", "block"]))
    placed = placed.select("row", F.col("slot").alias("mix_slot"), F.col("release").alias("mix_release"), F.col("deadline").alias("mix_deadline"),
                           (F.col("slot") * block_rows + F.col("rank") % block_rows).alias("mix_position"))
    return placed.select("row.*", *names)
