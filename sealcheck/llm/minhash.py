"""Near-duplicate documents by BagMinHash signatures (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from sealcheck.llm.common import KEY, by_group, components, row_key, whole_row
from sealcheck.llm.words import mix, shingles, word_hashes
from sealcheck.session import cut_lineage

WORDS = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
SMALL = 8
BLOCK = 1000
# Of 125 components a pair at 0.8 agrees in 100, give or take 4.5; this is 4.5 times that below.
AGREE = 0.64
HUB_ROWS = 500
SIGN_ITEMS = 100_000
STEP = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)


def bag(text: str | None, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The different word runs of a text and how often each stands there."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique(shingles(word_hashes(text.lower().encode("utf-8", "surrogatepass"))[0], words), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """BagMinHash of bags with whole weights: two bags agree in a component with the probability of their weighted Jaccard.

    Each item has one Poisson process per weight interval [0,1), [1,2), [2,4), [4,8), ... with rate `size` times
    the interval's width. A point has a time, a component and a weight level inside the interval; it counts if
    the level lies below the item's weight. A component keeps its earliest point. Points come in order of time up
    to a limit that suits the bag's total weight, which is raised until every component has a point: no later one
    could change the outcome, so a heavy bag costs no more points than a light one. Bags must not be empty.
    """
    items, weights = (np.concatenate(x) for x in zip(*bags))
    bag_of = np.repeat(np.arange(len(bags)), [len(i) for i, _ in bags])
    limit = (np.log(size) + 1) / np.bincount(bag_of, weights, len(bags))
    count = 1 + np.ceil(np.log2(weights)).astype(np.int64)
    owner = np.repeat(np.arange(len(items)), count)
    level = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    low = np.where(level == 0, 0, 1 << np.maximum(level - 1, 0))
    width = np.maximum(low, 1)
    seed = mix(items[owner] + (level.astype(np.uint64) + np.uint64(1)) * STEP)
    weight, bag_of, rate = weights[owner], bag_of[owner], size * width.astype(float)
    best, name = np.full(len(bags) * size, np.inf), np.zeros(len(bags) * size, np.uint64)

    def draw(seed, number):
        u = mix(seed + number * STEP)
        return u, -np.log(((u >> np.uint64(11)).astype(float) + 0.5) / 2.0 ** 53)

    number = np.ones(len(owner), np.uint64)
    u, gap = draw(seed, number)
    time, live = gap / rate, np.arange(len(owner))
    while True:
        # A process whose next point is beyond the limit rests until the limit is raised.
        live = live[time[live] <= limit[bag_of[live]]]
        if not len(live):
            short = ~np.isfinite(best).reshape(len(bags), size).all(axis=1)
            if not short.any():
                return name.reshape(len(bags), size)
            limit[short] *= 1.5
            live = np.flatnonzero(short[bag_of])
            continue
        more = mix(u[live] ^ STEP)
        part, when, who = bag_of[live] * size + (((more & LOW) * np.uint64(size)) >> np.uint64(32)).astype(np.int64), time[live], u[live]
        wide = np.flatnonzero(width[live] > 1)
        if len(wide):
            ok = np.ones(len(live), bool)
            ok[wide] = low[live[wide]] + (more[wide] >> np.uint64(40)).astype(np.int64) % width[live[wide]] < weight[live[wide]]
            part, when, who = part[ok], when[ok], who[ok]
        np.minimum.at(best, part, when)
        won = best[part] == when
        name[part[won]] = who[won]
        number[live] += np.uint64(1)
        u[live], gap = draw(seed[live], number[live])
        time[live] += gap / rate[live]


def _sign(words: int, bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor = (np.arange(rows, dtype=np.uint64) + np.uint64(1)) * STEP
        for batch in batches:
            found = [bag(t, words) for t in batch["text"]]
            keys, sketches = [None] * len(found), [None] * len(found)
            full = [i for i, (items, _) in enumerate(found) if len(items)]
            ends = np.cumsum([len(found[i][0]) for i in full])
            for part in np.split(np.array(full, int), np.searchsorted(ends, np.arange(SIGN_ITEMS, ends[-1], SIGN_ITEMS))) if full else []:
                if len(part):
                    names = signatures([found[i] for i in part], bands * rows)
                    band = mix(names.reshape(-1, bands, rows) + factor).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * STEP
                    for i, k, sketch in zip(part.tolist(), mix(band).view(np.int64), (names & np.uint64(255)).astype(np.uint8)):
                        keys[i], sketches[i] = k, sketch.tobytes()
            yield pd.DataFrame({KEY: batch[KEY], "tid": batch["tid"], "bands": keys, "sketch": sketches})
    return run


def _jaccard(a: tuple, b: tuple) -> float:
    """Weighted Jaccard of two bags (items in order, counts, sum of counts)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    both = a[0][at] == b[0]
    shared = np.minimum(a[1][at[both]], b[1][both]).sum()
    return shared / (a[2] + b[2] - shared)


def _join_up(threshold: int, similarity: float):
    """Links between the components of one large bucket (or of two blocks of it), enough to connect what is near.

    Pairs whose sketches agree often enough are verified on their bags in order of agreement, unless links found
    before connect them already. Members of the largest component are not compared with each other.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, "task", ["tid", "sketch", "items", "counts", "component", "block", "low", "high"]):
            component = np.unique(group["component"].to_numpy(), return_inverse=True)[1]
            if component.max() == 0:
                continue
            sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1)
            block, crossed = group["block"].to_numpy(), group["low"].iloc[0] != group["high"].iloc[0]
            bags = [(np.frombuffer(i, np.uint64), n := np.frombuffer(c, np.uint32).astype(np.int64), n.sum()) for i, c in zip(group["items"], group["counts"])]
            root = list(range(int(component.max()) + 1))
            tid, out = group["tid"].to_numpy(), []

            def top(x: int) -> int:
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            main = np.bincount(component).argmax()
            for i in np.flatnonzero(component != main).tolist():
                agree = (sketch == sketch[i]).sum(axis=1)
                # Two nodes outside the largest component are met once.
                ok = (agree >= threshold) & (component != component[i]) & ((component == main) | (np.arange(len(group)) < i))
                if crossed:
                    ok &= block != block[i]
                near = np.flatnonzero(ok)
                for j in near[np.argsort(-agree[near], kind="stable")].tolist():
                    x, y = top(component[i]), top(component[j])
                    if x != y and _jaccard(bags[i], bags[j]) >= similarity - 1e-12:
                        root[x] = y
                        out.append((tid[i], tid[j]))
            yield pd.DataFrame(out, columns=["a", "b"])
    return run


def _bags(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [bag(t, words) for t in batch["text"]]
            yield pd.DataFrame({"tid": batch["tid"], "items": [i.tobytes() for i, _ in found],
                                "counts": [n.astype(np.uint32).tobytes() for _, n in found]})
    return run


def _verify(similarity: float):
    """Pairs of a hub with its candidates that reach the similarity; the hub's bag comes first in its group."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in by_group(batches, "task", ["hub", "tid", "items", "counts"]):
            hub, out = None, []
            for h, tid, items, counts in zip(*[group[c] for c in ("hub", "tid", "items", "counts")]):
                items, counts = np.frombuffer(items, np.uint64), np.frombuffer(counts, np.uint32).astype(np.int64)
                if h == tid:
                    hub = (h, items, counts, counts.sum())
                    continue
                if _jaccard(hub[1:], (items, counts, counts.sum())) >= similarity - 1e-12:
                    out.append((tid, hub[0]))
            yield pd.DataFrame(out, columns=["a", "b"])
    return run


def verified(pairs: DataFrame, bags: DataFrame, similarity: float, hub_rows: int) -> DataFrame:
    """Pairs (a, b) whose bags reach the weighted Jaccard; b's bag travels once per `hub_rows` pairs, a's once per pair."""
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(1 << 20)))
    sizes = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / hub_rows).alias("salts"))
    salted = salted.join(sizes, "b").select(F.col("b").alias("hub"), F.col("a").alias("tid"), (F.col("salt") % F.col("salts")).alias("salt"))
    hubs = sizes.select(F.col("b").alias("hub"), F.col("b").alias("tid"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    rows = salted.union(hubs).join(bags, "tid").withColumn("task", F.xxhash64("hub", "salt")).withColumn("first", F.col("hub") != F.col("tid"))
    rows = rows.repartition("task").sortWithinPartitions("task", "first").select("task", "hub", "tid", "items", "counts")
    return rows.mapInPandas(_verify(similarity), "a binary, b binary")


def near_duplicates(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
                    small: int = SMALL, block: int = BLOCK, agree: float = AGREE, hub_rows: int = HUB_ROWS) -> DataFrame:
    """One row per document: row key, doc_id, class_id, kept, copies (rows of equal id and text).

    Documents link if the weighted Jaccard of their bags of five-word runs (lower case, split at ASCII white
    space) is 0.8 or more; classes are what links connect. A class is named after its smallest doc_id, null last,
    and keeps that document, of equal ids the one with the smallest text hash. Signatures of 125 components in 25
    bands miss a pair at 0.8 with probability 5e-5; every link used is verified on whole bags.

    Equal texts are one node. Pairs of buckets of at most `small` nodes are all verified. In a larger bucket every
    node is verified against the one that shares most buckets, so a large group of copies costs one comparison a
    member. Where a bucket then still holds several components, sketches of the signatures (one byte each) are
    compared across them inside tasks, in blocks of bounded size, and pairs that agree in a share of `agree` or
    more, which a pair at 0.8 misses with probability 3e-6, are verified there. Only links leave a task.

    Texts shorter than five words are one run of all their words. Null texts and those without a word stand
    alone. Equal rows are in one class and are both kept here. An empty table gives no row; columns other than
    doc_id and text are ignored.
    """
    told = docs.select(row_key("doc_id", "text").alias(KEY), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("tid"), "text")
    signed = cut_lineage(told.mapInPandas(_sign(words, bands, rows), f"{KEY} binary, tid binary, bands array<long>, sketch binary"))
    nodes = signed.filter("bands IS NOT NULL").groupBy("tid").agg(F.first("bands").alias("bands"))
    entered = nodes.select("tid", F.explode("bands").alias("bucket")).distinct()
    crowds = entered.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = cut_lineage(entered.join(crowds, "bucket"))
    asked = shared.groupBy("tid").agg(F.sum("n").alias("degree"))
    bags = told.select("tid", "text").join(asked.select("tid"), "tid").groupBy("tid").agg(F.first("text").alias("text"))
    bags = cut_lineage(bags.mapInPandas(_bags(words), "tid binary, items binary, counts binary"))

    few, many = shared.filter(F.col("n") <= small).select("bucket", "tid"), shared.filter(F.col("n") > small)
    pairs = few.withColumnRenamed("tid", "a").join(few.withColumnRenamed("tid", "b"), "bucket").filter("a > b").select("a", "b")
    many = cut_lineage(many.select("bucket", "tid", "n").join(asked, "tid"))
    hubs = many.groupBy("bucket").agg(F.min(F.struct((-F.col("degree")).alias("d"), "tid")).alias("h"))
    stars = many.select("bucket", "tid").join(hubs, "bucket").filter("tid != h.tid").select(F.col("tid").alias("a"), F.col("h.tid").alias("b"))
    tested = cut_lineage(pairs.union(stars).distinct())
    links = cut_lineage(verified(tested, bags, similarity, hub_rows))
    groups = components(links).withColumnRenamed("node", "tid")
    state = many.select("bucket", "tid", "n").join(groups, "tid", "left").withColumn("component", F.coalesce("component", "tid"))
    # A bucket is open while its nodes are in more than one component.
    mixed = state.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("bucket")
    state = cut_lineage(state.join(mixed, "bucket"))
    if not state.isEmpty():
        sketches = signed.select("tid", "sketch").groupBy("tid").agg(F.first("sketch").alias("sketch"))
        blocks = F.ceil(F.col("n") / block)
        state = state.withColumn("block", F.pmod(F.xxhash64("tid"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        state = state.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).withColumn("task", F.xxhash64("bucket", "low", "high"))
        state = state.join(sketches, "tid").join(bags, "tid").select("task", "tid", "sketch", "items", "counts", "component", "block", "low", "high")
        state = state.repartition("task").sortWithinPartitions("task")
        links = links.union(cut_lineage(state.mapInPandas(_join_up(round(agree * bands * rows), similarity), "a binary, b binary").distinct()))
    groups = components(links).withColumnRenamed("node", "tid")
    place = F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id"), F.col("tid"), F.col(KEY))
    # A text without words is a node of its own row.
    named = docs.select("doc_id", row_key("doc_id", "text").alias(KEY)).groupBy(KEY).agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))
    node = F.when(F.col("bands").isNull(), F.col(KEY)).otherwise(F.coalesce("component", "tid"))
    named = named.join(signed.groupBy(KEY).agg(F.first("tid").alias("tid"), F.first("bands").alias("bands")), KEY).join(groups, "tid", "left").select(
        KEY, "doc_id", "tid", "copies", node.alias("node"))
    named = cut_lineage(named)
    first = named.groupBy("node").agg(F.min(place).alias("class"))
    named = named.join(first, "node")
    return named.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(
        KEY, "doc_id", F.col("class.doc_id").alias("class_id"), (F.col(KEY) == F.col(f"class.{KEY}")).alias("kept"), "copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one document of each class: the one its class is named after; of equal rows one stays."""
    kept = near_duplicates(docs, **options).filter("kept").select(KEY, "copies").distinct()
    rows = docs.select(whole_row(docs), row_key("doc_id", "text").alias(KEY)).join(kept, KEY)
    single, several = rows.filter("copies = 1").select(KEY, "row"), rows.filter("copies > 1").select(KEY, "row").dropDuplicates([KEY])
    return single.union(several).select("row.*")
