"""Merkle fixity audit of archived records (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.session import cut_lineage

BITS = 6


def warc_record(url: str, payload: str) -> Column:
    """A WARC response record as text: header lines, the payload and the closing blank lines; null parts are empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def _digests(records: DataFrame) -> DataFrame:
    """One row per position and content, with its copies: payloads stay in the scan, only digests move."""
    return cut_lineage(records.select("position", F.sha2(F.col("record").cast("binary"), 256).alias("digest"))
                       .groupBy("position", "digest").agg(F.count(F.lit(1)).alias("copies")))


def _node(key: list, *items: str) -> Column:
    return F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws(":", *items)))), 256).alias("hash")


def _tree(digests: DataFrame, shifts: list[int], first: int) -> list[DataFrame]:
    """Levels from the leaves up, each (node, hash); a leaf is a range of positions and the start of the digest.

    The digest part splits a range that holds very many different records, so no leaf grows with one position.
    """
    place = F.shiftright("position", shifts[0]) - first
    leaf = cut_lineage(digests.groupBy(place.alias("range"), F.substring("digest", 1, 3).alias("part"))
                       .agg(_node([], "position", "digest", "copies")))
    levels = [leaf.select(F.struct("range", "part").alias("node"), "hash")]
    nodes = leaf.groupBy(F.col("range").alias("node")).agg(_node([], "part", "hash"))
    for low, high in zip(shifts, [*shifts[1:], None]):
        levels.append(nodes := cut_lineage(nodes))
        if high is not None:
            nodes = nodes.groupBy(F.shiftright("node", high - low).alias("up")).agg(_node([], "node", "hash")).withColumnRenamed("up", "node")
    return levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    b = b.select("node", F.col("hash").alias("other"))
    return a.join(b, "node", "full").filter(~F.col("hash").eqNullSafe(F.col("other"))).select("node")


def fixity_audit(primary: DataFrame, replica: DataFrame, bits: int = BITS) -> DataFrame:
    """Where two replicas differ: (position, digest, n_primary, n_replica, range_start, range_end).

    Both inputs are (position long, record string or binary): the ordered place of a record and its bytes. Records
    are hashed where they lie, ranges of 2^bits positions form leaves, 2^bits nodes form a parent, up to one root.
    The roots are compared first; below, only children of mismatching nodes are. Each row returned is a record
    content whose number of copies differs: an altered record gives its old and its new digest.

    Null positions stand one after the last position and are returned as null. Null records count as
    empty. Repeated rows count as copies. Either input may be empty; two equal ones give no row. Further columns
    are ignored.
    """
    primary, replica = [f.select(F.col("position").cast("long").alias("position"), F.coalesce(F.col("record").cast("binary"), F.lit(b"")).alias("record"))
                        for f in (primary, replica)]
    a, b = _digests(primary), _digests(replica)
    span = a.select("position").union(b.select("position")).agg(F.min("position"), F.max("position")).first()
    low, high = span[0] or 0, span[1] or 0
    null, first = high + 1, low >> bits
    a, b = [f.withColumn("position", F.coalesce("position", F.lit(null))) for f in (a, b)]
    shifts = [bits]
    while ((null >> bits) - first) >> (shifts[-1] - bits):
        shifts.append(shifts[-1] + bits)
    left, right = _tree(a, shifts, first), _tree(b, shifts, first)
    bad = _differing(left[-1], right[-1])
    for level in range(len(shifts) - 1, 0, -1):
        up = shifts[level] - shifts[level - 1]
        bad = bad.withColumnRenamed("node", "up")
        below = [t[level].withColumn("up", F.shiftright("node", up)).join(bad, "up", "left_semi") for t in (left, right)]
        bad = cut_lineage(_differing(*below))
    bad = bad.withColumnRenamed("node", "range")
    below = [t[0].withColumn("range", F.col("node.range")).join(bad, "range", "left_semi") for t in (left, right)]
    leaves = cut_lineage(_differing(*below))

    def records(digests: DataFrame, name: str) -> DataFrame:
        node = F.struct((F.shiftright("position", bits) - first).alias("range"), F.substring("digest", 1, 3).alias("part"))
        return digests.withColumn("node", node).join(leaves, "node", "left_semi").select("position", "digest", F.col("copies").alias(name))

    start = F.shiftleft(F.shiftright("position", bits), bits)
    return (records(a, "n_primary").join(records(b, "n_replica"), ["position", "digest"], "full")
            .na.fill(0, ["n_primary", "n_replica"]).filter("n_primary != n_replica")
            .select(F.when(F.col("position") != null, F.col("position")).alias("position"), "digest", "n_primary", "n_replica",
                    start.alias("range_start"), (start + (1 << bits)).alias("range_end")))
