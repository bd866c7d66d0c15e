"""Phrases that words form more often than chance, from a weighted de Bruijn graph (operator 12)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sealcheck.session import cut_lineage

LONGEST = 3
MIN_COUNT = 10
KEEP = 2000
HELD = 1_000_000
# Words and nodes above this share of a sample of so many texts are dealt out in parts. The sample moves rows, never a result.
HOT_SHARE = 1 / 5000
SAMPLE = 2000
ROUTES = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
PIECE_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
GRAMS = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())])


def _grams(longest: int, held: int):
    """Counts of each text's longest grams, and of the shorter ones that end a piece; combined in the task up to `held`."""
    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, grams in counts.items():
            names = sorted(grams)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), pa.array(names, pa.binary()).cast(pa.string()),
                                              pa.array([grams[g] for g in names], pa.int64())], schema=GRAMS)
        counts.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
                grams, some = counts.setdefault(lang, Counter()), []
                for piece in PIECE_ENDS.split(text.as_buffer().to_pybytes().translate(LOWER)):
                    words = piece.split()
                    some += map(b" ".join, zip(*[words[i:] for i in range(longest)]))
                    some += [b" ".join(words[-k:]) for k in range(1, min(longest - 1, len(words)) + 1)]
                    if len(some) > held:
                        grams.update(some)
                        some = []
                        if len(grams) > held:
                            yield from emit(counts)
                            grams = counts.setdefault(lang, Counter())
                grams.update(some)
                if sum(map(len, counts.values())) > held:
                    yield from emit(counts)
        yield from emit(counts)
    return run


def _hot(texts: DataFrame, longest: int) -> list[list[str]]:
    """Words and, if grams are longer, pairs that hold more than HOT_SHARE of a sample of texts: 1 / HOT_SHARE of each at most."""
    rows = texts.count()
    some = texts.sample(min(1.0, SAMPLE / max(rows, 1)), seed=1).mapInArrow(_grams(longest, HELD), "lang string, gram string, n long")
    out = []
    for size in range(1, min(longest, 3)):
        # Every place starts one gram, so a phrase is counted by the grams it starts.
        starts = some.filter(F.size(F.split("gram", " ")) >= size).groupBy("lang", F.substring_index("gram", " ", size).alias("start")).agg(F.sum("n").alias("n"))
        total = F.sum("n").over(Window.partitionBy(F.lit(1)))
        out.append(sorted({r.start for r in starts.withColumn("all", total).filter(F.col("n") > F.col("all") * HOT_SHARE).select("start").collect()}))
    return out


def phrase_counts(documents: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, held: int = HELD) -> DataFrame:
    """(lang, gram, size, n): every phrase of up to `longest` words that occurs min_count times or more, and size 0: all words.

    Texts lose A-Z case and part at `.,;:!?` and line ends into pieces, those at spaces and tabs into words; phrases
    never cross pieces. Null text is empty, null lang is `und`.

    Only the longest grams are counted in the texts: edges of a de Bruijn graph whose nodes are one word shorter. What
    leaves a node is the sum of its edges, and a piece that ends there adds one; so each shorter count is derived from
    the counts one word longer, down to the single words and their sum. An edge below min_count goes into its node at
    once and leaves no row.
    """
    texts = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_grams(longest, held), "lang string, gram string, n long").withColumn("size", F.size(F.split("gram", " ")))
    # Grams are combined in the tasks already and sorted, so they go straight to where their first word is at home, and
    # most nodes are whole there. Hot words go by node, hot nodes by gram.
    route = F.substring_index("gram", " ", 1)
    hot = _hot(texts, longest)
    for size, many in enumerate(hot, 1):
        route = F.when(F.substring_index("gram", " ", size).isin(many), F.substring_index("gram", " ", size + 1)).otherwise(route) if many else route
    rows = counted.withColumn("route", F.pmod(F.xxhash64("lang", route), F.lit(ROUTES)).cast("int")).repartition("route")
    rows = rows.groupBy("route", "lang", "gram", "size").agg(F.sum("n").alias("n")).withColumn("known", F.lit(False))
    for size in range(longest, 0, -1):
        whole = ~F.col("gram").isin(hot[size - 1]) if size <= len(hot) and hot[size - 1] else F.lit(True)
        rows = _flow(rows, size, whole, min_count, ["route", "lang"])
    # What is left unknown are hot phrases, counted in several places.
    rows = rows.groupBy("lang", "gram", "size", "known").agg(F.sum("n").alias("n"))
    for size in range(longest - 1, 0, -1):
        rows = _flow(rows, size, F.lit(True), min_count, ["lang"])
    return cut_lineage(rows.select("lang", "gram", "size", "n"))


def _flow(rows: DataFrame, size: int, whole: Column, min_count: int, keys: list[str]) -> DataFrame:
    """Whole counts of one size become known, if they are frequent, and flow into the phrase without its last word."""
    here = (F.col("size") == size) & ~F.col("known") & whole
    shorter = F.substring_index("gram", " ", size - 1) if size > 1 else F.lit("")
    keep = F.struct("gram", "size", "n", F.lit(True).alias("known"))
    flow = F.struct(shorter.alias("gram"), F.lit(size - 1).alias("size"), "n", F.lit(False).alias("known"))
    split = F.when(here & (F.col("n") >= min_count), F.array(keep, flow)).when(here, F.array(flow)).otherwise(F.array(F.struct("gram", "size", "n", "known")))
    return rows.select(*keys, F.explode(split).alias("x")).groupBy(*keys, "x.gram", "x.size", "x.known").agg(F.sum("x.n").alias("n"))


def _drop_first(gram: str, size: int):
    return F.substring_index(gram, " ", 1 - size) if size > 1 else F.lit("")


def neighbours(counts: DataFrame, size: int) -> DataFrame:
    """(lang, gram, most_in, most_out): the heaviest phrases of size + 1 words that end, and that start, with one of `size`."""
    longer = counts.filter(F.col("size") == size + 1)
    none = F.lit(None).cast("long")
    ends = F.array(F.struct(_drop_first("gram", size + 1).alias("gram"), F.col("n").alias("into"), none.alias("out")),
                   F.struct(F.substring_index("gram", " ", size).alias("gram"), none.alias("into"), F.col("n").alias("out")))
    return longer.select("lang", F.explode(ends).alias("x")).groupBy("lang", "x.gram").agg(F.max("x.into").alias("most_in"), F.max("x.out").alias("most_out"))


def _follow(links: DataFrame) -> DataFrame:
    """(lang, at, to, steps): where the chain of links from `at` ends, by pointers that double each round."""
    state, before = cut_lineage(links.select("lang", "at", "to", F.lit(1).cast("long").alias("steps"))), None
    while True:
        ahead = state.select("lang", F.col("at").alias("to"), F.col("to").alias("far"), F.col("steps").alias("more"))
        moved = cut_lineage(state.join(ahead, ["lang", "to"], "left"))
        live = moved.filter("far IS NOT NULL").count()
        state = moved.select("lang", "at", F.coalesce("far", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0).cast("long"))).alias("steps"))
        # A chain without end would keep as many live pointers; texts end, so there is none.
        if live in (0, before):
            return state
        before = live


def compact(counts: DataFrame, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Unary paths of the graph of `phrase_counts`: (inner nodes, edges with their path).

    A node is inner if all it holds comes in by one edge and leaves by one: no piece starts or ends there and no other
    word stands beside it. Edges around inner nodes form one path, along which every count is the same. Inner nodes have
    (lang, gram); edges have lang, gram, path (the first edge), place (from 0) and path_words.
    """
    nodes = counts.filter(F.col("size") == longest - 1).join(neighbours(counts, longest - 1), ["lang", "gram"])
    inner = cut_lineage(nodes.filter("most_in = n AND most_out = n").select("lang", "gram"))
    edges = counts.filter(F.col("size") == longest).select("lang", F.col("gram").alias("edge"))
    into = edges.select("lang", F.col("edge").alias("at"), _drop_first("edge", longest).alias("gram")).join(inner, ["lang", "gram"])
    out = edges.select("lang", F.col("edge").alias("to"), F.substring_index("edge", " ", longest - 1).alias("gram"))
    links = cut_lineage(into.join(out, ["lang", "gram"]).select("lang", "at", "to"))
    ahead = _follow(links).select("lang", F.col("at").alias("edge"), F.col("steps").alias("ahead"))
    behind = _follow(links.select("lang", F.col("to").alias("at"), F.col("at").alias("to"))).select(
        "lang", F.col("at").alias("edge"), F.col("to").alias("path"), F.col("steps").alias("place"))
    placed = edges.join(ahead, ["lang", "edge"], "left").join(behind, ["lang", "edge"], "left")
    zero = F.lit(0).cast("long")
    return inner, placed.select("lang", F.col("edge").alias("gram"), F.coalesce("path", "edge").alias("path"), F.coalesce("place", zero).alias("place"),
                                (F.coalesce("place", zero) + F.coalesce("ahead", zero) + longest).alias("path_words"))


def mine_phrases(documents: DataFrame, longest: int = LONGEST, min_count: int = MIN_COUNT, keep: int = KEEP, held: int = HELD) -> DataFrame:
    """Each language's `keep` best phrases: lang, rank, phrase, a, l, r, n, score, path_words.

    Candidates are phrases of 2 to `longest` words with a = count >= min_count. Cut after its first k words, one scores
    floor(1000000 * a * a / (l * r)), l and r the counts of both parts; its lowest cut counts, ties to the smallest k.
    A candidate inside a longer one that occurs at least half as often is dropped; inner nodes of the compacted graph
    are such, so only its branching nodes are scored. n counts all words of the language. Order: score and a
    descending, phrase ascending by UTF-8 bytes. path_words is the length of the unary path a phrase of `longest` words
    lies on, else the phrase's own. Numbers are exact up to counts of 10^14.

    Null text is empty, null lang is `und`; equal documents count each; an empty table gives no row; further columns
    are ignored.
    """
    return rank_phrases(phrase_counts(documents, longest, min_count, held), longest, keep)


def rank_phrases(counts: DataFrame, longest: int = LONGEST, keep: int = KEEP) -> DataFrame:
    """`mine_phrases` from the counts of `phrase_counts`."""
    inner, edges = compact(counts, longest)
    phrases = counts.filter("size > 1").join(inner, ["lang", "gram"], "left_anti")
    for size in range(2, longest):
        near = neighbours(counts, size).select("lang", "gram", F.lit(size).alias("size"), F.greatest("most_in", "most_out").alias("most"))
        phrases = phrases.join(near, ["lang", "gram", "size"], "left").filter("most IS NULL OR 100 * most < 50 * n").drop("most")
    cuts = phrases.select("lang", F.col("gram").alias("phrase"), "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    words = F.split("phrase", " ")
    cuts = cuts.withColumns({"first": F.array_join(F.slice(words, 1, F.col("k")), " "), "rest": F.array_join(F.slice(words, F.col("k") + 1, F.col("size")), " ")})
    parts = counts.filter("size > 0")
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("gram").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = {c: F.col(c).cast("decimal(15,0)") for c in "alr"}
    cuts = cuts.withColumns(wide).withColumn("score", F.expr("(a * a * CAST(1000000 AS DECIMAL(8,0))) DIV (l * r)"))
    best = cuts.groupBy("lang", "phrase", "size").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x"))
    order = Window.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("x.a"), "phrase")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= keep)
    best = best.join(counts.filter("size = 0").select("lang", "n"), "lang").join(
        edges.select("lang", F.col("gram").alias("phrase"), "path_words"), ["lang", "phrase"], "left")
    return best.select("lang", "rank", "phrase", *[F.col(f"x.{c}").cast("long").alias(c) for c in "alr"], "n", F.col("x.score").alias("score"),
                       F.coalesce("path_words", F.col("size").cast("long")).alias("path_words"))
