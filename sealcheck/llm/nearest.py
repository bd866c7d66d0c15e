"""Approximate nearest neighbours by an inverted multi-index (operator 13)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sealcheck.session import cut_lineage

NEIGHBOURS = 20
# Bounds of the index: vectors the centroids are fitted on, centroids of a half (cells are their square), queries that set the depth.
FIT_ROWS = 8192
MAX_CENTROIDS = 256
CELL_ROWS = 16
TRIALS = 100
RECALL = 0.96
BLOCK = 4096
QUERY_BLOCK = 2048
ROUNDS = 12


@dataclass(frozen=True)
class MultiIndex:
    """Centroids of the two halves, size and first block of each cell (first half major), and how many entries a search visits."""

    left: np.ndarray
    right: np.ndarray
    sizes: np.ndarray
    starts: np.ndarray
    depth: int
    block: int

    def parts(self, cell) -> np.ndarray:
        return np.maximum(1, -(-self.sizes[cell] // self.block))


def _nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids * centroids).sum(1)).argmax(1)


def _centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from evenly spread rows of the sample, which comes in the order of its hashes."""
    found = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _nearest_centroid(x, found)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(found)
        np.add.at(sums, near, x)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def _cells(x: np.ndarray, index: MultiIndex) -> np.ndarray:
    half = index.left.shape[1]
    return _nearest_centroid(x[:, :half], index.left) * len(index.right) + _nearest_centroid(x[:, half:], index.right)


def traverse(query: np.ndarray, index: MultiIndex, depth: float) -> list[int]:
    """Non-empty cells by falling sum of both halves' inner products, until they hold `depth` entries.

    Both centroid lists are sorted, and a heap holds the border of the pairs taken so far: (i, j) enters when (i - 1, j)
    and (i, j - 1) have left, so pairs come in order and each once.
    """
    half = index.left.shape[1]
    a, b = index.left @ query[:half], index.right @ query[half:]
    order_a, order_b = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b, order_a, order_b, sizes = a[order_a].tolist(), b[order_b].tolist(), order_a.tolist(), order_b.tolist(), index.sizes
    width, found, taken, reached = len(b), [], 0, [-1] * len(a)
    heap = [(-(a[0] + b[0]), 0, 0)]
    while heap and taken < depth:
        _, i, j = heapq.heappop(heap)
        reached[i] = j
        cell = order_a[i] * width + order_b[j]
        if size := sizes[cell]:
            found.append(cell)
            taken += size
        if j + 1 < width and (i == 0 or reached[i - 1] > j):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j - 1:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
    return found


def _assign(index: MultiIndex):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"vid": batch["vid"], "embedding": batch["embedding"], "ids": batch["ids"],
                                    "cell": _cells(np.array(batch["embedding"].tolist(), np.float64), index)})
    return run


def _trial(names: list, x: np.ndarray, k: int):
    """The cells of each trial query's k nearest among this task's rows, itself left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [[] for _ in names]
        for batch in batches:
            scores = x @ np.array(batch["embedding"].tolist(), np.float64).T if len(batch) else np.zeros((len(names), 0))
            rows = [bytes(v) for v in batch["vid"]]
            cells = batch["cell"].tolist()
            for q, name in enumerate(names):
                few = np.argpartition(-scores[q], k)[:k + 1] if len(rows) > k + 1 else range(len(rows))
                best[q] = heapq.nlargest(k, best[q] + [(float(scores[q, i]), cells[i]) for i in few if rows[i] != name])
        yield pd.DataFrame([(q, score, cell) for q, part in enumerate(best) for score, cell in part], columns=["q", "score", "cell"])
    return run


def _probe(index: MultiIndex):
    """One row for each query and block it visits, with the cells it wants there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vid, embedding in zip(batch["vid"], batch["embedding"]):
                cells = np.sort(traverse(np.asarray(embedding, np.float64), index, index.depth))
                parts = index.parts(cells)
                blocks = np.repeat(index.starts[cells], parts) + np.concatenate([np.arange(p) for p in parts])
                cells = np.repeat(cells, parts)
                order = np.argsort(blocks, kind="stable")
                cuts = np.flatnonzero(np.diff(blocks[order])) + 1
                out += [(vid, embedding, int(b[0]), c) for b, c in zip(np.split(blocks[order], cuts), np.split(cells[order], cuts))]
            yield pd.DataFrame(out, columns=["vid", "embedding", "block", "cells"])
    return run


def _rerank(k: int):
    """The k + 1 best rows a query finds in one block; scores are summed in double precision, term by term of the originals."""
    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        names, best, scores = [], [], []
        if len(queries) and len(entries):
            e, ids = np.array(entries["embedding"].tolist(), np.float64), entries["ids"].tolist()
            cells, place = np.unique(entries["cell"].to_numpy(), return_inverse=True)
            for start in range(0, len(queries), 256):
                part = queries.iloc[start:start + 256]
                q = np.array(part["embedding"].tolist(), np.float64)
                wanted = np.stack([np.isin(cells, c) for c in part["cells"]])
                near = np.where(wanted[:, place], q @ e.T, -np.inf)
                for row, vid in enumerate(part["vid"]):
                    line = near[row]
                    least = -np.partition(-line, k)[k] if len(line) > k + 1 else -np.inf
                    # Rounding of the product may not decide a tie, so all rows beside the border are scored again.
                    few = np.flatnonzero((line >= least - 1e-9 * (1 + abs(least)) if np.isfinite(least) else True) & (line > -np.inf))
                    exact = (q[row] * e[few]).sum(1).tolist()
                    hits = sorted((-s, i) for s, f in zip(exact, few) for i in ids[f])[:k + 1]
                    names += [vid] * len(hits)
                    best += [i for _, i in hits]
                    scores += [-s for s, _ in hits]
        return pd.DataFrame({"vid": names, "vec_id": np.array(best, np.int64), "score": np.array(scores, np.float64)})
    return run


def fit_index(entries: DataFrame, width: int, block: int = BLOCK) -> tuple[MultiIndex, DataFrame]:
    """The index of different vectors (vid, embedding, ids) of one width, and the vectors with their cells, written once.

    Centroids are fitted on the FIT_ROWS vectors of smallest hash; every vector is entered. Their number grows with the
    square root of the vectors up to MAX_CENTROIDS, so the driver holds at most its square of cell sizes.
    """
    sample = [r.embedding for r in entries.orderBy(F.xxhash64("vid"), "vid").limit(FIT_ROWS).select("embedding").collect()]
    rows = entries.count()
    x = np.array(sample, np.float64)
    k = int(min(MAX_CENTROIDS, len(x), max(1, 2 ** round(np.log2(max(1.0, rows / CELL_ROWS)) / 2))))
    half = width // 2
    none = np.zeros(0, np.int64)
    index = MultiIndex(_centroids(x[:, :half], k) if half else np.zeros((1, 0)), _centroids(x[:, half:], k), none, none, 0, block)
    placed = cut_lineage(entries.select("vid", "embedding", "ids").mapInPandas(_assign(index), "vid binary, embedding array<double>, ids array<long>, cell long"))
    sizes = np.zeros(len(index.left) * len(index.right), np.int64)
    for cell, count in placed.groupBy("cell").count().collect():
        sizes[cell] = count
    # Cells in a row share a block until it is full; a crowded cell takes blocks of its own.
    starts, at, room = np.zeros(len(sizes), np.int64), 0, block
    for cell in np.flatnonzero(sizes).tolist():
        size = int(sizes[cell])
        if size > room:
            at, room = at + (room < block), block
        starts[cell] = at
        at, room = (at, room - size) if size <= room else (at - (-size // block), block)
    return MultiIndex(index.left, index.right, sizes, starts, 0, block), placed


def search_depth(index: MultiIndex, placed: DataFrame, queries: DataFrame, k: int, recall: float = RECALL) -> int:
    """Entries a search has to visit so that, of the true neighbours of TRIALS queries compared with all rows, this share is met."""
    trials = queries.orderBy(F.xxhash64("vid"), "vid").limit(TRIALS).select("vid", "embedding").collect()
    names, x = [bytes(t.vid) for t in trials], np.array([t.embedding for t in trials], np.float64)
    found = placed.select("vid", "embedding", "cell").mapInPandas(_trial(names, x, k), "q int, score double, cell long")
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))).filter(F.col("place") <= k)
    needs = []
    for q, cells in best.groupBy("q").agg(F.collect_list("cell").alias("cells")).collect():
        order = traverse(x[q], index, np.inf)
        upto = dict(zip(order, np.cumsum(index.sizes[order]).tolist()))
        needs += [upto[c] for c in cells]
    needs.sort()
    return max(k + 1, needs[min(len(needs) - 1, int(np.ceil(recall * len(needs))) - 1)] if needs else 0)


def nearest(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS, recall: float = RECALL, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k nearest rows of each query by inner product: query_id, rank, vec_id, score; `vectors` has vec_id and embedding.

    Queries are the rows whose vec_id is divisible by `every`; a query's candidates are all other rows. Each half of a
    vector is quantised on its own; a search takes pairs of centroids by the sum of their inner products with the
    query's halves until it has met enough entries, and scores those on the original vectors in double precision. How
    many are enough is measured: some queries are compared with all rows, and the depth is set so that searches meet
    `recall` of their neighbours. Nearest first, ties to the smaller vec_id; a query has fewer rows only if there are
    fewer candidates.

    Equal vectors are indexed and searched once. A cell is cut into blocks of at most about `block` entries, the
    queries of a block into parts of at most about `query_block`, so a hot cell is many small tasks; all its entries
    are scored. Only centroids, cell sizes and the sample are on the driver.

    Rows with null vec_id, and vectors that are null, empty, zero or hold null or non-finite components, take no part.
    A vec_id counts once: equal rows are one, of different vectors under one vec_id the one of smallest hash stays.
    Vectors of other lengths than the query's are no candidates. An empty table gives no row; further columns are
    ignored.
    """
    sound = "vec_id IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) AND exists(embedding, x -> x != 0)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter(sound)
    rows = rows.withColumn("vid", F.unhex(F.md5(F.transform("embedding", lambda x: x + F.lit(0.0)).cast("string"))))
    rows = cut_lineage(rows.groupBy("vec_id").agg(F.min(F.struct("vid", "embedding")).alias("x")).select("vec_id", "x.*"))
    # Of equal vectors no query can return more than its k + 1 smallest ids.
    place = F.row_number().over(Window.partitionBy("vid").orderBy("vec_id"))
    low = rows.select("vid", "vec_id", place.alias("place")).filter(F.col("place") <= k + 1).groupBy("vid").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = cut_lineage(rows.groupBy("vid").agg(F.first("embedding").alias("embedding")).join(low, "vid"))
    asking = rows.filter(F.col("vec_id") % every == 0).select("vid", F.col("vec_id").alias("query_id"))
    hits = None
    for (width,) in sorted(entries.select(F.size("embedding")).distinct().collect()):
        part = _search(entries.filter(F.size("embedding") == width), asking, width, k, recall, block, query_block)
        hits = part if hits is None else hits.union(part)
    if hits is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    best = Window.partitionBy("vid").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).drop("place")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return asking.join(hits, "vid").filter("query_id != vec_id").withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _search(entries: DataFrame, asking: DataFrame, width: int, k: int, recall: float, block: int, query_block: int) -> DataFrame:
    index, placed = fit_index(entries, width, block)
    queries = cut_lineage(placed.select("vid", "embedding").join(asking.select("vid").distinct(), "vid"))
    index = MultiIndex(index.left, index.right, index.sizes, index.starts, search_depth(index, placed, queries, k, recall), block)
    probes = cut_lineage(queries.mapInPandas(_probe(index), "vid binary, embedding array<double>, block long, cells array<long>"))
    # Blocks are known from the cell, so entries are dealt out by the two short lists of the index.
    cells = placed.sparkSession.createDataFrame(pd.DataFrame({"cell": (used := np.flatnonzero(index.sizes)), "start": index.starts[used], "parts": index.parts(used)}))
    dealt = placed.join(F.broadcast(cells), "cell").withColumn("block", F.col("start") + F.pmod(F.xxhash64("vid"), "parts"))
    crowd = probes.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / query_block).alias("shares"))
    asked = probes.join(crowd, "block").withColumn("share", F.pmod(F.xxhash64("vid"), "shares")).select("block", "share", "vid", "embedding", "cells")
    dealt = dealt.join(crowd, "block").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    dealt = dealt.select("block", "share", "embedding", "ids", "cell")
    return asked.groupBy("block", "share").cogroup(dealt.groupBy("block", "share")).applyInPandas(_rerank(k), "vid binary, vec_id long, score double")
