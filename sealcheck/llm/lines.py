"""Near-duplicate lines by a segment-partition edit join (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from sealcheck.llm.common import KEY, by_group, components, row_key, whole_row
from sealcheck.llm.words import BASE, mix, powers
from sealcheck.session import cut_lineage

MAX_EDITS = 2
CHARS_PER_EDIT = 10
GROUP_LINES = 256
MAX_DEPTH = 4
EMIT_CHARS = 1_000_000


def edits_allowed(length: int, max_edits: int, per: int) -> int:
    """How many edits the shorter of two lines allows: one for every `per` characters, at most `max_edits`."""
    return min(max_edits, length // per)


@lru_cache(maxsize=100_000)
def segments(lengths: tuple[int, ...], edits: int) -> tuple[tuple[int, int, int], ...]:
    """edits + 1 disjoint segments (piece, start, length) in order, spread over the pieces by their length; none if too short."""
    if sum(lengths) <= edits:
        return ()
    counts = [0] * len(lengths)
    for _ in range(edits + 1):
        k = max(range(len(lengths)), key=lambda i: (lengths[i] / (counts[i] + 1) if lengths[i] > counts[i] else -1, -i))
        counts[k] += 1
    return tuple((k, j * n // c, (j + 1) * n // c - j * n // c) for k, (n, c) in enumerate(zip(lengths, counts)) for j in range(c))


class Keys:
    """Keys under which a line stands in the index or is looked up.

    A state is what is left of a line once some segments matched: pieces of the line, the lengths of the same
    pieces in the indexed line, the edits allowed, and whether the line is the indexed one itself. Segment i is
    looked up at shifts that leave at most i edits before it and the others after it, so every pair within the
    edits shares a key. A key names its parent, the lengths, the segment and its characters.
    """

    def __init__(self, max_edits: int, per: int):
        self.max_edits, self.per = max_edits, per

    def first(self, lines: list[str]) -> list[tuple[np.ndarray, np.ndarray, tuple]]:
        """First keys of many lines at once, as parts (line, key, what): substring hashes are differences of running sums."""
        size = np.array([len(x) for x in lines])
        begin = np.cumsum(size) - size
        points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        power, inverse = powers(len(points) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points + np.uint64(1)) * power[:len(points)])])
        out = []
        for gap in range(self.max_edits + 1):
            allowed = np.minimum(self.max_edits, (size - gap) // self.per)
            for edits in range(max(1, gap), self.max_edits + 1):
                who = np.flatnonzero((allowed == edits) & (size > gap))
                length = size[who] - gap
                for i in range(edits + 1 if len(who) else 0):
                    start, end = i * length // (edits + 1), (i + 1) * length // (edits + 1)
                    for shift in range(max(-i, gap - edits + i), min(i, gap + edits - i) + 1):
                        if abs(shift) + abs(gap - shift) > edits:
                            continue
                        a, b = begin[who] + start + shift, begin[who] + end + shift
                        name = (length * 64 + i * 8 + edits).astype(np.uint64) * np.uint64(BASE)
                        out.append((who, mix((total[b] - total[a]) * inverse[a] + mix(name)).view(np.int64), (gap, edits, i, shift)))
        return out

    def states(self, line: str) -> list[tuple[int, tuple]]:
        """First keys of one line, each with what is left of it."""
        out = []
        for who, key, (gap, edits, i, shift) in self.first([line]):
            if len(who):
                n = len(line) - gap
                start, end = i * n // (edits + 1), (i + 1) * n // (edits + 1)
                out.append((int(key[0]), ((line[:start + shift], line[end + shift:]), (start, n - end), edits, gap == shift == 0)))
        return out

    def children(self, states: list[tuple], parent: int) -> list[tuple[int, tuple]]:
        out = []
        for pieces, lengths, edits, indexed in states:
            for i, (k, start, size) in enumerate(segments(lengths, edits)):
                piece, gap = pieces[k], len(pieces[k]) - lengths[k]
                name = f"{parent}|{edits}|{i}|{lengths}|"
                for shift in range(max(-i, gap - edits + i, -start), min(i, gap + edits - i, len(piece) - size - start) + 1):
                    at = start + shift
                    key = xxhash.xxh3_64_intdigest(name + piece[at:at + size]) - 2 ** 63
                    left = (*pieces[:k], piece[:at], piece[at + size:], *pieces[k + 1:])
                    over = (*lengths[:k], start, lengths[k] - start - size, *lengths[k + 1:])
                    if sum(abs(len(p) - n) for p, n in zip(left, over)) <= edits:
                        out.append((key, (left, over, edits, indexed and shift == 0)))
            if sum(lengths) <= edits:
                out.append((parent, (pieces, lengths, edits, indexed)))
        return out

    def below(self, line: str, path: list[int]) -> set[int]:
        """Keys one level below a path."""
        found = self.states(line)
        for key in path:
            found = self.children([s for k, s in found if k == key], key)
        return {k for k, _ in found}

    def first_met(self, a: str, b: str, path: list[int]) -> bool:
        """Whether a path is the one among all paths of its depth on which a pair is to be counted: least key first."""
        ca, cb = self.states(a), self.states(b)
        for depth, key in enumerate(path):
            if depth:
                ca, cb = (self.children([s for k, s in c if k == path[depth - 1]], path[depth - 1]) for c in (ca, cb))
            ia, ib = {k for k, s in ca if s[3]}, {k for k, s in cb if s[3]}
            both = ia & {k for k, _ in cb} | ib & {k for k, _ in ca}
            if not both or min(both) != key:
                return False
        return True


def _distance(a: list, b: list) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def verify(lines: list[np.ndarray], a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """`within`, after the ends that two lines have in common are cut off, which changes no distance."""
    out, middle, todo = np.zeros(len(a), bool), [], []
    for n, (i, j, k) in enumerate(zip(a.tolist(), b.tolist(), edits.tolist())):
        x, y = lines[i], lines[j]
        differ = np.flatnonzero(x != y[:len(x)])
        low = int(differ[0]) if len(differ) else len(x)
        x, y = x[low:], y[low:]
        differ = np.flatnonzero(x[::-1] != y[::-1][:len(x)])
        cut = int(differ[0]) if len(differ) else len(x)
        x, y = x[:len(x) - cut], y[:len(y) - cut]
        if len(x) <= 2 * k:
            out[n] = (_distance(x.tolist(), y.tolist()) if len(y) <= 3 * k else k + 1) <= k
        else:
            todo.append(n)
            middle += [x, y]
    if todo:
        at = np.arange(0, len(middle), 2)
        out[todo] = within(middle, at, at + 1, edits[todo])
    return out


def within(lines: list[np.ndarray], a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Which pairs (a, b) of lines are within their number of edits; a is never longer than b, nor shorter by more.

    Banded bit-parallel edit distance over all pairs at once: a column of the band is one machine word whose top
    bit is the diagonal `edits` below the main one. Pairs leave once their distance cannot come back.
    """
    out = np.zeros(len(a), bool)
    if not len(a):
        return out
    sizes = np.array([len(x) for x in lines])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate([*lines, np.zeros(1, np.uint32)])
    one, full = np.uint64(1), ~np.uint64(0)
    live = np.arange(len(a))
    k = edits.astype(np.int64)
    vp, vn = full << (np.uint64(63) - k.astype(np.uint64)), np.zeros(len(a), np.uint64)
    dist, m, n, at_a, at_b = k.copy(), sizes[a], sizes[b], starts[a], starts[b]
    limit = k + n - (m - k)
    i, width = 0, int(k.max())
    while len(live):
        char = flat[at_b + i]
        eq = np.zeros(len(live), np.uint64)
        for t in range(2 * width + 1):
            row = i + k - t
            ok = (row >= 0) & (row < m) & (t <= 2 * k)
            eq |= np.where(ok & (flat[np.where(ok, at_a + row, 0)] == char), one << np.uint64(63 - t), np.uint64(0))
        d0 = (((eq & vp) + vp) ^ vp) | eq | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        diagonal = i < m - k
        mask = one << (np.uint64(62) - np.where(diagonal, 0, i - (m - k)).astype(np.uint64))
        dist = dist + np.where(diagonal, (d0 >> np.uint64(63)) == 0, ((hp & mask) != 0).astype(np.int64) - ((hn & mask) != 0))
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
        i += 1
        ended = i == n
        out[live[ended]] = dist[ended] <= k[ended]
        keep = ~ended & (dist <= limit)
        if not keep.all():
            live, k, vp, vn, dist, m, n, at_a, at_b, limit = (x[keep] for x in (live, k, vp, vn, dist, m, n, at_a, at_b, limit))
    return out


def _emit(keys: Keys):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, lines = batch["line_id"].to_numpy(), batch["line"].tolist()
            ends = np.cumsum([len(x) for x in lines])
            for part in np.split(np.arange(len(lines)), np.searchsorted(ends, np.arange(EMIT_CHARS, ends[-1], EMIT_CHARS))) if len(lines) else []:
                found = keys.first([lines[i] for i in part.tolist()]) if len(part) else []
                if found:
                    who, key = (np.concatenate(x) for x in list(zip(*found))[:2])
                    order = np.lexsort((key, who))
                    who, key = who[order], key[order]
                    fresh = np.concatenate([[True], (who[1:] != who[:-1]) | (key[1:] != key[:-1])]) if len(who) else np.zeros(0, bool)
                    yield pd.DataFrame({"key": key[fresh], "line_id": ids[part[who[fresh]]]})
    return run


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose key stands more than once; rows come sorted by key, and only one row is ever held back."""
    last, told = None, True
    for batch in batches:
        key, ids = batch["key"].to_numpy(), batch["line_id"].to_numpy()
        if not len(key):
            continue
        same = key[1:] == key[:-1]
        first_same = last is not None and last[0] == key[0]
        with_before = np.concatenate([[first_same], same])
        with_next = np.concatenate([same, [False]])
        keep = with_before | with_next
        if first_same and not told:
            yield pd.DataFrame({"key": [last[0]], "line_id": [last[1]]})
        if keep.any():
            yield pd.DataFrame({"key": key[keep], "line_id": ids[keep]})
        last, told = (key[-1], ids[-1]), bool(keep[-1])


def _deepen(keys: Keys):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [([*path, key], i) for path, i, line in zip(batch["path"], batch["line_id"], batch["line"]) for key in sorted(keys.below(line, list(path)))]
            yield pd.DataFrame(out, columns=["path", "line_id"])
    return run


def _join(keys: Keys):
    """Links of groups or of two blocks of a large one: per line how many are its own to count, and its least neighbour."""
    def pairs(group: pd.DataFrame) -> tuple:
        size = group["line"].map(len).to_numpy()
        order = np.argsort(size, kind="stable")
        allow = np.minimum(size // keys.per, keys.max_edits)
        ends = np.searchsorted(size[order], size[order] + allow[order], side="right")
        count = np.maximum(ends - np.arange(len(order)) - 1, 0)
        i = np.repeat(np.arange(len(order)), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        a, b = order[i], order[j]
        if group["low"].iloc[0] != group["high"].iloc[0]:
            block = group["block"].to_numpy()
            cross = block[a] != block[b]
            a, b = a[cross], b[cross]
        return a, b, allow[a]

    def solve(held: list[tuple]) -> Iterator[pd.DataFrame]:
        """Pairs of all groups held are verified together."""
        lines = [x for group, *_ in held for x in group["line"]]
        points = [np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in lines]
        starts = np.cumsum([0, *[len(group) for group, *_ in held]])
        a, b = (np.concatenate([x[k] + at for x, at in zip(held, starts)]) for k in (1, 2))
        near = verify(points, a, b, np.concatenate([x[3] for x in held]))
        apart = np.split(near, np.cumsum([len(x[1]) for x in held])[:-1])
        # The first keys of all lines that link, found at once.
        linked = sorted({text for (group, x, y, _), part in zip(held, apart) if part.any() for text in group["line"].iloc[np.unique([x[part], y[part]])]})
        first: dict[str, dict[int, bool]] = {text: {} for text in linked}
        for who, key, (gap, _, _, shift) in keys.first(linked) if linked else ():
            for w, k in zip(who.tolist(), key.tolist()):
                mine = first[linked[w]]
                mine[k] = mine.get(k, False) or gap == shift == 0

        def least(a: dict[int, bool], b: dict[int, bool]) -> int | None:
            return min((k for k in a.keys() & b.keys() if a[k] or b[k]), default=None)

        for (group, *_), part, x, y in zip(held, apart, [x[1] for x in held], [x[2] for x in held]):
            if not part.any():
                continue
            x, y, path, texts = x[part], y[part], list(group["path"].iloc[0]), group["line"].tolist()
            own = np.array([least(first[texts[i]], first[texts[j]]) == path[0] and (len(path) == 1 or keys.first_met(texts[i], texts[j], path))
                            for i, j in zip(x.tolist(), y.tolist())], bool)
            n = np.bincount(np.concatenate([x[own], y[own]]), minlength=len(group))
            label = np.arange(len(group))
            while True:
                new = label.copy()
                np.minimum.at(new, x, label[y])
                np.minimum.at(new, y, label[x])
                if (new == label).all():
                    break
                label = new
            used, ids = np.unique(np.concatenate([x, y])), group["line_id"].to_numpy()
            yield pd.DataFrame({"line_id": ids[used], "n": n[used].astype(np.int64), "near": ids[label[used]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for group in by_group(batches, "task", ["path", "line_id", "line", "block", "low", "high"]):
            found = pairs(group)
            if len(found[0]):
                held.append((group, *found))
                size += len(found[0])
            if size > 20_000:
                yield from solve(held)
                held, size = [], 0
        if held:
            yield from solve(held)
    return run


def edit_join(lines: DataFrame, max_edits: int = MAX_EDITS, per: int = CHARS_PER_EDIT, group_lines: int = GROUP_LINES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(line_id, n, near): links between different lines within the edits that the shorter one allows.

    `lines` has line_id (unique) and line (different texts). n are the links of a line that this row counts, each
    link counted once over all rows; near is a line it is connected with. Lines that share a key are compared
    inside a task. A key shared by more than `group_lines` lines is divided by the keys of what is left of the
    lines beside the matched segment, down to `max_depth` segments; what still shares one is compared in blocks of
    bounded size. No line is dropped and no pair leaves a task.
    """
    keys = Keys(max_edits, per)
    found = lines.mapInPandas(_emit(keys), "key long, line_id long")
    found = found.repartition("key").sortWithinPartitions("key").mapInPandas(_shared, "key long, line_id long")
    level = cut_lineage(found.select(F.array("key").alias("path"), "line_id"))
    out = []
    for depth in range(1, max_depth + 1):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        level = level.join(sizes, "path")
        small = level if depth == max_depth else level.filter(F.col("size") <= group_lines)
        blocks = F.ceil(F.col("size") / group_lines)
        small = small.withColumn("block", F.pmod(F.xxhash64("line_id"), blocks))
        small = small.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        small = (small.join(lines, "line_id").withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
                 .withColumn("task", F.xxhash64("path", "low", "high")))
        small = small.select("task", "path", "line_id", "line", "block", "low", "high").repartition("task").sortWithinPartitions("task", "path", "low", "high", "line_id")
        out.append(cut_lineage(small.mapInPandas(_join(keys), "line_id long, n long, near long")))
        crowded = level.filter(F.col("size") > group_lines)
        if depth == max_depth or crowded.isEmpty():
            break
        level = cut_lineage(crowded.join(lines, "line_id").select("path", "line_id", "line").mapInPandas(_deepen(keys), "path array<long>, line_id long"))
    links = out[0]
    for more in out[1:]:
        links = links.union(more)
    return links


def near_lines(docs: DataFrame, min_chars: int = CHARS_PER_EDIT, **options) -> DataFrame:
    """One row per line of at least `min_chars` characters: row key, doc_id, line_no (from 0), class_doc, class_line, n_links, kept.

    Lines are what newlines separate. Different lines link if their edit distance is at most one per ten
    characters of the shorter, two at most; classes are what links connect. Lines under ten characters allow no edit:
    with `min_chars` below ten, equal ones are a class without any join, and blank ones are layout and have no row. The class is named after its first
    line, by doc_id (null last) and line number; kept says that a line is that one. n_links counts the different
    lines linked. Null text has no line; equal rows have the same lines, which are kept in each of them. An empty
    table gives no row; columns other than doc_id and text are ignored.
    """
    rows = docs.select(row_key("doc_id", "text").alias(KEY), "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    per = options.get("per", CHARS_PER_EDIT)
    rows = rows.filter((F.length("line") >= min_chars) & ((F.length("line") >= per) | F.col("line").rlike(r"\S")))
    place = F.struct(F.col("doc_id").isNull().alias("lost"), F.col("doc_id"), F.col("line_no"))
    lines = cut_lineage(rows.groupBy("line").agg(F.min(place).alias("first")).select(
        F.monotonically_increasing_id().alias("line_id"), "line", "first"))
    links = edit_join(lines.filter(F.length("line") >= per).select("line_id", "line"), **options)
    groups = components(links.select(F.col("line_id").alias("a"), F.col("near").alias("b"))).withColumnRenamed("node", "line_id")
    groups = cut_lineage(groups.join(lines.select("line_id", "first"), "line_id"))
    named = groups.join(groups.groupBy("component").agg(F.min("first").alias("class")), "component").select("line_id", "class")
    counts = links.groupBy("line_id").agg(F.sum("n").alias("n_links"))
    told = lines.select("line_id", "first", F.unhex(F.md5("line")).alias("name")).join(named, "line_id", "left").join(counts, "line_id", "left")
    told = told.select("name", F.coalesce("class", "first").alias("class"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = rows.select(KEY, "doc_id", "line_no", F.unhex(F.md5("line")).alias("name")).join(told, "name")
    return out.select(KEY, "doc_id", "line_no", F.col("class.doc_id").alias("class_doc"), F.col("class.line_no").alias("class_line"), "n_links",
                      (F.col("doc_id").eqNullSafe(F.col("class.doc_id")) & (F.col("line_no") == F.col("class.line_no"))).alias("kept"))


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines that near-duplicate an earlier one; documents left without any line of substance go.

    A document goes only if it lost a line and no other than blank ones are left. All columns are kept; n_chars,
    if there is one, follows the text.
    """
    columns = docs.columns
    lost = near_lines(docs, **options).filter("NOT kept").select(KEY, "line_no").distinct().groupBy(KEY).agg(F.collect_list("line_no").alias("lost"))
    packed = docs.select(whole_row(docs), row_key("doc_id", "text").alias(KEY)).join(lost, KEY, "left")
    kept = F.filter(F.split("row.text", "\n", -1), lambda line, i: ~F.array_contains("lost", i))
    left = packed.withColumn("text", F.when(F.col("lost").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n")))
    left = left.filter(F.col("lost").isNull() | F.col("text").rlike(r"\S"))
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in columns:
        row = row.withField("n_chars", F.when(F.col("lost").isNull(), F.col("row.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return left.select(row.alias("row")).select("row.*")
