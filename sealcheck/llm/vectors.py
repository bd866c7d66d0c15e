"""Near-duplicate vectors by cross-polytope hashing (operator 7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from sealcheck.llm.common import by_group, components
from sealcheck.session import cut_lineage

THRESHOLD = 0.95
TABLES = 4
PROBES = 4
BLOCK = 1500
SEED = 20_240_601


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        step *= 2
    return x.reshape(n, width) / np.sqrt(width)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


def buckets(x: np.ndarray, depth: int, tables: int, probes: int) -> np.ndarray:
    """For each unit row the buckets it enters: per table its own and the `probes` - 1 next likely ones.

    A table hashes with `depth` cross-polytopes: three rounds of random signs and a Hadamard transform, then the
    largest coordinate and its sign. The next buckets change one polytope to its next largest coordinate, or two
    to their second, in order of the squared length lost. A hash depends on the row alone, not on its batch.
    """
    n, dim = x.shape
    width = 1 << max(1, dim - 1).bit_length()
    wide = np.zeros((n, width))
    wide[:, :dim] = x
    out = np.empty((n, tables * probes), np.uint64)
    top = min(probes + 1, width)
    for t in range(tables):
        places, sizes = [], []
        for k in range(depth):
            y = wide
            for r in range(3):
                y = hadamard(y * np.random.default_rng([SEED, dim, t, k, r]).choice([-1.0, 1.0], width))
            size = np.abs(y)
            first = np.argsort(-size, axis=1, kind="stable")[:, :top]
            places.append(_mix((2 * first + (np.take_along_axis(y, first, 1) < 0) + 1).astype(np.uint64) * np.uint64(2 * k + 0x51ED270B) + np.uint64(dim << 16)))
            sizes.append(np.take_along_axis(size, first, 1) ** 2)
        own = sum(p[:, 0] * np.uint64(2 * k + 1) for k, p in enumerate(places))
        moved = [[(p[:, j] - p[:, 0]) * np.uint64(2 * k + 1) for j in range(top)] for k, p in enumerate(places)]
        names, lost = [own], [np.full(n, -1.0)]
        for k in range(depth):
            for j in range(1, top):
                names.append(own + moved[k][j])
                lost.append(sizes[k][:, 0] - sizes[k][:, j])
            for m in range(k):
                if top > 1:
                    names.append(own + moved[k][1] + moved[m][1])
                    lost.append(sizes[k][:, 0] - sizes[k][:, 1] + sizes[m][:, 0] - sizes[m][:, 1])
        best = np.argsort(np.stack(lost, 1), axis=1, kind="stable")[:, :probes]
        chosen = np.take_along_axis(np.stack(names, 1), best, 1)
        if chosen.shape[1] < probes:
            chosen = np.concatenate([chosen, np.repeat(chosen[:, :1], probes - chosen.shape[1], 1)], 1)
        out[:, t * probes:(t + 1) * probes] = _mix(chosen + np.uint64(t * 0x9E3779B97F4A7C15 % 2 ** 64))
    return out.view(np.int64)


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _enter(depth: int, tables: int, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["embedding"].map(len)):
                found = buckets(_unit(part["embedding"].tolist()), depth, tables, probes)
                # A bucket reached twice is entered once.
                found = np.sort(found, axis=1)
                fresh = np.concatenate([np.ones((len(part), 1), bool), found[:, 1:] != found[:, :-1]], 1)
                yield pd.DataFrame({"vid": np.repeat(part["vid"].to_numpy(), fresh.sum(1)), "bucket": found[fresh]})
    return run


def _link(threshold: float, depth: int, tables: int, probes: int):
    """Links of one bucket (or of two blocks of a large one), each pair counted in the smallest bucket it shares."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in by_group(batches, "task", ["vid", "bucket", "embedding", "copies", "block", "low", "high"]):
            if len(batch) < 2:
                continue
            x = _unit(batch["embedding"].tolist())
            near = x @ x.T >= threshold
            np.fill_diagonal(near, False)
            if batch["low"].iloc[0] != batch["high"].iloc[0]:
                block = batch["block"].to_numpy()
                near &= block[:, None] != block[None, :]
            i, j = np.nonzero(np.triu(near))
            if not len(i):
                continue
            used = np.unique(np.concatenate([i, j]))
            where = np.zeros(len(batch), int)
            where[used] = np.arange(len(used))
            entered = buckets(x[used], depth, tables, probes)
            count, copies = np.zeros(len(batch), np.int64), batch["copies"].to_numpy()
            for s in range(0, len(i), 50_000):
                a, b = i[s:s + 50_000], j[s:s + 50_000]
                left, right = entered[where[a]], entered[where[b]]
                least = np.full(len(a), np.iinfo(np.int64).max)
                for c in range(left.shape[1]):
                    shared = (right == left[:, c:c + 1]).any(1)
                    least = np.where(shared, np.minimum(least, left[:, c]), least)
                own = least == batch["bucket"].iloc[0]
                count += np.bincount(a[own], copies[b[own]], len(batch)).astype(np.int64) + np.bincount(b[own], copies[a[own]], len(batch)).astype(np.int64)
            label = np.arange(len(batch))
            while True:
                low = np.minimum.reduceat(np.concatenate([label[j], label[i]])[o := np.argsort(ends := np.concatenate([i, j]), kind="stable")],
                                          np.flatnonzero(np.diff(ends[o], prepend=-1)))
                new = label.copy()
                new[used] = np.minimum(label[used], low)
                if (new == label).all():
                    break
                label = new
            vid = batch["vid"].to_numpy()
            yield pd.DataFrame({"vid": vid[used], "n": count[used], "near": vid[label[used]]})
    return run


def similar_vectors(vectors: DataFrame, threshold: float = THRESHOLD, tables: int = TABLES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept. `vectors` has vec_id and embedding.

    Rows link if the cosine of their vectors, in double precision, reaches the threshold; every link returned is
    verified, none below it. n_links counts the other rows linked directly, component_id is the smallest vec_id
    reachable by links, kept says that it is the row's own. Equal vectors are hashed once and counted as copies.
    Hashing depth follows the number of vectors, so buckets stay small as it grows. Pairs are compared inside tasks
    in blocks of bounded size, also where one bucket is very large, and leave them only as counts and one edge per
    vector.

    Null vectors, zero vectors and those with null or non-finite components link with nothing; their component is
    their own vec_id. Vectors of different length never link. A null vec_id is never the smallest of others. Equal
    rows are copies. An empty table gives no row; further columns are ignored.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    sound = F.expr("size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)")
    # 0.0 and -0.0 are equal, so they get one name.
    name = F.unhex(F.md5(F.transform("embedding", lambda x: x + F.lit(0.0)).cast("string")))
    rows = cut_lineage(rows.withColumn("vid", F.when(sound, name)))
    different = cut_lineage(rows.filter("vid IS NOT NULL").groupBy("vid").agg(
        F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("low_id")))
    size, width = different.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    corners, depth = 2 * (1 << max(1, (width or 2) - 1).bit_length()), 2
    while corners ** depth * 64 < (size or 0):
        depth += 1
    tables *= depth - 1
    entered = cut_lineage(different.select("vid", "embedding").mapInPandas(_enter(depth, tables, probes), "vid binary, bucket long"))
    crowds = entered.groupBy("bucket").count().filter("count > 1").select("bucket", F.ceil(F.col("count") / block).alias("blocks"))
    placed = entered.join(crowds, "bucket").withColumn("block", F.expr("pmod(xxhash64(vid), blocks)"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    placed = placed.join(different.select("vid", "embedding", "copies"), "vid").withColumn("task", F.xxhash64("bucket", "low", "high"))
    linked = placed.repartition("task").sortWithinPartitions("task", "bucket").select("task", "vid", "bucket", "embedding", "copies", "block", "low", "high")
    linked = cut_lineage(linked.mapInPandas(_link(threshold, depth, tables, probes), "vid binary, n long, near binary"))
    groups = components(linked.select(F.col("vid").alias("a"), F.col("near").alias("b")))
    lowest = (different.select("vid", "low_id").join(groups.withColumnRenamed("node", "vid"), "vid"))
    lowest = lowest.join(lowest.groupBy("component").agg(F.min("low_id").alias("component_id")), "component").select("vid", "component_id")
    counts = linked.groupBy("vid").agg(F.sum("n").alias("n"))
    known = (different.select("vid", "copies", "low_id").join(counts, "vid", "left").join(lowest, "vid", "left")
             .select("vid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "low_id").alias("component_id")))
    out = rows.join(known, "vid", "left")
    component = F.when(F.col("vid").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
