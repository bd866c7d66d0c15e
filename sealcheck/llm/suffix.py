"""Removal of long repeated byte strings by a Burrows-Wheeler transform (operator 6).

Every window of `length` bytes belongs to one anchor, the k-gram of smallest hash in it, the leftmost of equals. Equal
windows have equal anchors at the same place, so they meet in the group of that k-gram. The windows of one anchor
are consecutive; the text they cover is its region. Only regions whose k-gram stands elsewhere too are fetched,
equal regions once with their count, and the transform is built per group of regions, never over a whole corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sealcheck.llm.common import KEY, row_key
from sealcheck.session import cut_lineage

LENGTH = 400
GRAM = 64
GROUP_REGIONS = 1500
CHUNK_BYTES = 1 << 19
PLACE = np.uint64((1 << 24) - 1)
PIECE = 1 << 23
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all byte k-grams: doubling steps join neighbouring blocks, so a k-gram costs log2(k) operations."""
    h = (data.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    h ^= h >> np.uint64(29)
    size, whole, done = 1, None, 0
    while True:
        if gram & size:
            whole = h[:len(data) - size + 1].copy() if whole is None else (
                whole[:len(data) - done - size + 1] * MULTIPLIER + h[done:len(data) - size + 1])
            whole ^= whole >> np.uint64(31)
            done += size
        if done == gram:
            return whole
        h = h[:-size] * MULTIPLIER + h[size:]
        h ^= h >> np.uint64(32)
        size *= 2


def anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k-gram hash, its place, first window, last window) of each anchor of a text of at least `length` bytes."""
    width, parts = length - gram + 1, []
    for begin in range(0, len(data) - length + 1, PIECE):
        h = gram_hashes(data[begin:begin + PIECE + length - 1], gram)
        n = len(h) - width + 1
        # A place in the low bits makes the leftmost of equal hashes the smallest, so a minimum names its place.
        ranked = (h & ~PLACE) | np.arange(len(h), dtype=np.uint64)
        # Sliding minimum by blocks of `width`: suffix minima of one block and prefix minima of the next.
        padded = np.concatenate([ranked, np.full(-len(h) % width, np.iinfo(np.uint64).max)]).reshape(-1, width)
        prefix = np.minimum.accumulate(padded, axis=1).ravel()
        suffix = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        low = np.minimum(suffix[:n], prefix[width - 1:width - 1 + n])
        first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
        last = np.concatenate([first[1:], [n]]) - 1
        place = (low[first] & PLACE).astype(np.int64)
        parts.append((h[place], place + begin, first + begin, last + begin))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """Places by symbol, in order among equals; end symbols differ but need no order among themselves."""
    return np.argsort(np.maximum(symbols, -1).astype(np.int16), kind="stable")


def suffix_order(symbols: np.ndarray, length: int) -> np.ndarray:
    """Order of all suffixes by their first `length` symbols at least: ranks of doubling prefixes.

    Each region ends in a symbol of its own, so no comparison runs past a region.
    """
    n = len(symbols)
    order = _by_symbol(symbols)
    new = np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]])
    # A rank is the place of the first suffix that shares the prefix.
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    size, todo, bits = 1, np.arange(n), n.bit_length()
    while size < length:
        # Only suffixes that still share their rank with another need sorting.
        todo = todo[np.bincount(rank, minlength=n)[rank[todo]] > 1]
        if not len(todo):
            break
        if 3 * bits <= 63:
            # Both ranks and the suffix in one number: sorting numbers is faster than sorting their places.
            key = np.sort((rank[todo] << 2 * bits) | (rank[todo + size] << bits) | todo)
            part, key = key & ((1 << bits) - 1), key >> bits
        else:
            key = rank[todo] * (n + 1) + rank[todo + size]
            by = np.argsort(key)
            part, key = todo[by], key[by]
        old = rank[part]
        places = np.arange(len(part))
        group = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), places, 0))
        fresh = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), places, 0))
        rank[part] = old + fresh - group
        size *= 2
    return np.argsort(rank)


def common_prefixes(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Marks of places in suffix order whose common prefix with the place before has `length` symbols or more.

    Intervals of the transform are expanded breadth first by one symbol to the left. An interval of depth d sets
    the prefix length after its end to d - 1 the first time that place is met, and only such intervals go on, so
    lengths come in increasing order; what is unset when depth exceeds `length` is long enough.
    """
    n = len(symbols)
    bwt = symbols[order - 1]
    lf = np.empty(n, np.int64)
    lf[_by_symbol(bwt)] = np.arange(n)
    unset = np.ones(n + 1, bool)
    unset[n] = unset[0] = False
    # Depth 1: one interval per symbol. End symbols are never extended over.
    ends = symbols[order] < 0
    lows = np.flatnonzero(np.concatenate([[True], symbols[order][1:] != symbols[order][:-1]]))
    highs = np.concatenate([lows[1:], [n]])
    unset[highs] = False
    for _ in range(length - 1):
        sizes = highs - lows
        total = int(sizes.sum())
        if not total:
            break
        owner = np.repeat(np.arange(len(lows)), sizes)
        places = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(lows, sizes)
        open_ = bwt[places] >= 0
        # Inside an interval equal symbols map to consecutive places.
        key = np.sort((owner[open_] << 32) | lf[places[open_]])
        target = key & 0xFFFFFFFF
        char = symbols[order[target]]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] >> 32 != key[:-1] >> 32) | (char[1:] != char[:-1])])) if len(key) else np.zeros(0, int)
        lows = target[first]
        highs = lows + np.diff(np.concatenate([first, [len(key)]]))
        fresh = unset[highs]
        lows, highs = lows[fresh], highs[fresh]
        unset[highs] = False
    marks = unset[:n]
    marks &= ~ends
    return marks


def repeated_starts(regions: list[bytes], counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each region, which of its windows stand more than once among all regions, copies counted."""
    sizes = np.array([len(r) for r in regions]) + 1
    offsets = np.cumsum(sizes) - sizes
    symbols = np.empty(int(sizes.sum()), np.int64)
    for i, (r, at) in enumerate(zip(regions, offsets)):
        symbols[at:at + len(r)] = np.frombuffer(r, np.uint8)
        symbols[at + len(r)] = -1 - i
    order = suffix_order(symbols, length)
    long = common_prefixes(symbols, order, length)
    again = np.zeros(len(symbols), bool)
    again[order] = long | np.concatenate([long[1:], [False]])
    return [np.ones(len(r) - length + 1, bool) if c > 1 else again[at:at + len(r) - length + 1] for r, c, at in zip(regions, counts, offsets)]


def _find_anchors(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for key, text in zip(batch[KEY], batch["text"]):
                raw = text.encode("utf-8", "surrogatepass")
                if len(raw) < length:
                    continue
                value, place, first, last = anchors(np.frombuffer(raw, np.uint8), length, gram)
                content = np.array([xxhash.xxh3_64_intdigest(raw[a:b + length]) for a, b in zip(first.tolist(), last.tolist())], np.uint64)
                parts.append(pd.DataFrame({"anchor": value.view(np.int64), "content": content.view(np.int64), KEY: key,
                                           "first": first.astype(np.int32), "last": last.astype(np.int32), "lead": (place - first).astype(np.int32)}))
            if parts:
                yield pd.concat(parts, ignore_index=True)
    return run


def _fetch(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["wanted"]):
                raw = text.encode("utf-8", "surrogatepass")
                out += [(w["anchor"], w["content"], w["copies"], w["lead"], raw[w["first"]:w["last"] + length]) for w in wanted]
            yield pd.DataFrame(out, columns=["anchor", "part", "copies", "lead", "region"])
    return run


def _split(length: int):
    """Each region in two halves by the place of the anchor in a window, grouped anew by the bytes all windows of a half share."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for anchor, part, lead, r0, r1, copies, region in zip(*[batch[c] for c in ("anchor", "part", "lead", "r0", "r1", "copies", "region")]):
                n, mid = len(region) - length + 1, (r0 + r1) // 2
                for low, high in ((r0, mid), (mid, r1)):
                    a, b = max(0, lead - high + 1), min(n, lead - low + 1)
                    if a < b:
                        piece = region[a:b - 1 + length]
                        shared = region[lead - low:lead - high + 1 + length]
                        out.append((anchor, part, a, xxhash.xxh3_64_intdigest(shared, low * 1024 + high) - 2 ** 63,
                                    xxhash.xxh3_64_intdigest(piece) - 2 ** 63, lead - a, low, high, copies, piece))
            yield pd.DataFrame(out, columns=["up_anchor", "up_part", "low", "anchor", "part", "lead", "r0", "r1", "copies", "region"])
    return run


def _expand(length: int, chunk: int):
    """Windows that repeat, as runs (content, first, last), for whole groups gathered into chunks of bounded size."""
    def solve(groups: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(groups, ignore_index=True)
        marks = repeated_starts(list(frame["region"]), frame["copies"].to_numpy(), length)
        out = []
        for anchor, part, mark in zip(frame["anchor"], frame["part"], marks):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.view(np.int8), [0]])))
            out += [(anchor, part, a, b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return pd.DataFrame(out, columns=["anchor", "part", "first", "last"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come in order of the group; a chunk is worked on once it is large enough and its last group ends."""
        held, size = [], 0
        for batch in batches:
            batch = batch[["anchor", "part", "copies", "region"]]
            while len(batch):
                if size >= chunk:
                    other = np.flatnonzero(batch["anchor"].to_numpy() != held[-1]["anchor"].iloc[-1])
                    cut = int(other[0]) if len(other) else len(batch)
                    if cut:
                        held.append(batch.iloc[:cut])
                    batch = batch.iloc[cut:]
                    if len(other):
                        yield solve(held)
                        held, size = [], 0
                else:
                    grown = size + batch["region"].map(len).cumsum().to_numpy()
                    cut = min(len(batch), int(np.searchsorted(grown, chunk)) + 1)
                    held.append(batch.iloc[:cut])
                    size = int(grown[cut - 1])
                    batch = batch.iloc[cut:]
        if held:
            yield solve(held)
    return run


def repeated_windows(docs: DataFrame, length: int, gram: int, group_regions: int, chunk: int) -> DataFrame:
    """(row key, first, last): runs of window starts whose `length` bytes also start elsewhere; docs has the row key and text.

    A group of more than `group_regions` different regions is split: each region is cut into two halves of its
    windows, grouped by the bytes those share, with equal halves counted once, and their runs are given back to
    all of them. In the end a half is one window and equal ones are one row, so groups become small whatever the
    data, and no region is dropped.
    """
    found = cut_lineage(docs.select(KEY, "text").mapInPandas(
        _find_anchors(length, gram), f"anchor long, content long, {KEY} binary, first int, last int, lead int"))
    kinds = found.groupBy("anchor", "content").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(KEY, "first", "last", "lead")).alias("at"))
    groups = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.sum("copies").alias("total")).filter("total > 1")
    kinds = cut_lineage(kinds.join(groups, "anchor"))
    # A group of one kind of region is settled: all its windows repeat. Of other kinds one region each is fetched.
    wanted = kinds.filter("kinds > 1").select(F.col("at")[KEY].alias(KEY), F.struct("anchor", "content", "copies", "at.first", "at.last", "at.lead").alias("w"))
    once = docs.select(KEY, "text").join(wanted.groupBy(KEY).agg(F.collect_list("w").alias("wanted")), KEY)
    regions = cut_lineage(once.mapInPandas(_fetch(length), "anchor long, part long, copies long, lead int, region binary")
                          .dropDuplicates(["anchor", "part"]).withColumn("r0", F.lit(0)).withColumn("r1", F.lit(length - gram + 1)))
    levels, members = [], []
    while True:
        crowded = cut_lineage(regions.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > group_regions).select("anchor"))
        more = not crowded.isEmpty()
        calm = regions.join(crowded, "anchor", "left_anti") if more else regions
        calm = calm.select("anchor", "part", "copies", "region").repartition("anchor").sortWithinPartitions("anchor")
        levels.append(cut_lineage(calm.mapInPandas(_expand(length, chunk), "anchor long, part long, first int, last int")))
        if not more:
            break
        halves = cut_lineage(regions.join(crowded, "anchor", "left_semi").mapInPandas(
            _split(length), "up_anchor long, up_part long, low int, anchor long, part long, lead int, r0 int, r1 int, copies long, region binary"))
        members.append(halves.select("up_anchor", "up_part", "low", "anchor", "part"))
        same = halves.groupBy("anchor", "part", "lead", "r0", "r1").agg(F.sum("copies").alias("copies"), F.first("region").alias("region"))
        kinds_of = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"))
        same = cut_lineage(same.join(kinds_of, "anchor"))
        settled = same.filter("kinds = 1 AND copies > 1").select("anchor", "part", F.lit(0).alias("first"), (F.length("region") - length).alias("last"))
        levels.append(settled)
        regions = same.filter("kinds > 1").drop("kinds")
    runs = levels.pop()
    while members:
        runs = runs.union(levels.pop())
        up = members.pop().join(runs, ["anchor", "part"])
        runs = levels.pop().union(up.select("up_anchor", "up_part", F.col("first") + F.col("low"), F.col("last") + F.col("low")))
    places = found.select("anchor", "content", KEY, "first", "last").join(kinds.select("anchor", "content", "kinds", "copies"), ["anchor", "content"])
    whole = places.filter("kinds = 1 OR copies > 1").select(KEY, "first", "last")
    part = (places.filter("kinds > 1 AND copies = 1").withColumnRenamed("first", "at").drop("last")
            .join(runs.withColumnRenamed("part", "content"), ["anchor", "content"]))
    return whole.union(part.select(KEY, F.col("at") + F.col("first"), F.col("at") + F.col("last")))


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, runs in zip(batch["text"], batch["runs"]):
                raw = text.encode("utf-8", "surrogatepass")
                spans = []
                for first, last in sorted((r["first"], r["last"]) for r in (runs if runs is not None else ())):
                    if spans and first <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], last + length)
                    else:
                        spans.append([first, last + length])
                at, kept = 0, []
                for a, b in spans:
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                kept = b"".join(kept)
                out.append((len(raw), len(raw) - len(kept), [{"start": a, "end": b} for a, b in spans], hashlib.sha256(kept).hexdigest(), kept))
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), pd.DataFrame(out, columns=["n_bytes", "n_removed", "spans", "kept_sha256", "kept"])], axis=1)
    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group_regions: int = GROUP_REGIONS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (start, end of each maximal removed run), kept_sha256, kept.

    Every byte covered by a string of `length` bytes that starts anywhere else too, same document included, is
    removed; strings are judged on the input. Texts are UTF-8 bytes and matches never cross documents. Null text is
    empty. Rows that are equal are copies of each other. Texts shorter than `length` stay whole. An empty table
    gives no row; columns other than doc_id and text are ignored. `kept` are the remaining bytes, which need not
    be valid UTF-8 where a run ends inside a character.
    """
    if not 8 <= gram <= length <= gram + 1023:
        raise ValueError("the anchor's length must lie within the window's")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), row_key("doc_id", "text").alias(KEY))
    runs = repeated_windows(docs, length, gram, group_regions, chunk).toDF(KEY, "first", "last").distinct()
    runs = runs.groupBy(KEY).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # Ids travel as text: a null among whole numbers would turn them into fractions.
    return docs.join(runs, KEY, "left").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "runs").mapInPandas(
        _cut(length), "doc_id string, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string, kept binary"
    ).withColumn("doc_id", F.col("doc_id").cast(kind))
