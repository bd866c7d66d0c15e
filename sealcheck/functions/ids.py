"""Identifiers and digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.session import cut_lineage

NUL = "\x00"
DEFAULT_PREFIX = "sc_"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def hashed(*parts: Column) -> Column:
    """Hex SHA-256 over parts joined by a NUL character. Null when any part is null."""
    joined = parts[0]
    for part in parts[1:]:
        joined = F.concat(joined, F.lit(NUL), part)
    return F.sha2(joined, 256)


def portable_id(provider, namespace, source_id, prefix: str = DEFAULT_PREFIX) -> Column:
    """Deterministic id of a source object: prefix + sha256(provider NUL namespace NUL id)."""
    return F.concat(F.lit(prefix), hashed(_col(provider), _col(namespace), _col(source_id)))


def packed(identifier, prefix: str = DEFAULT_PREFIX) -> Column:
    """An id as bytes, for joins and shuffles: the digest of a portable id in binary takes half of its digits.

    Any text can be packed, two texts never give the same bytes, and `unpacked` returns the text. Portable ids keep their
    order among each other and towards texts without the prefix; they sort before all other texts with the prefix.
    """
    text = _col(identifier)
    raw, head = F.encode(text, "UTF-8"), F.encode(F.lit(prefix), "UTF-8")
    code = F.unhex(F.substring(text, len(prefix) + 1, 64))
    sound = (F.length(text) == len(prefix) + 64) & (F.concat(F.lit(prefix), F.lower(F.hex(code))) == text)
    tagged = F.concat(head, F.lit(b"\x01"), F.substring(raw, len(prefix.encode()) + 1, 1 << 30))
    return F.when(sound, F.concat(head, F.lit(b"\x00"), code)).otherwise(F.when(text.startswith(prefix), tagged).otherwise(raw))


def unpacked(code, prefix: str = DEFAULT_PREFIX) -> Column:
    """The text that `packed` was given."""
    code, size = _col(code), len(prefix.encode())
    rest = F.substring(code, size + 2, 1 << 30)
    tag = F.when(F.substring(code, 1, size) == F.encode(F.lit(prefix), "UTF-8"), F.substring(code, size + 1, 1))
    return (F.when(tag == F.lit(b"\x00"), F.concat(F.lit(prefix), F.lower(F.hex(rest))))
            .when(tag == F.lit(b"\x01"), F.concat(F.lit(prefix), F.decode(rest, "UTF-8"))).otherwise(F.decode(code, "UTF-8")))


def digest(content: Column) -> Column:
    """`sha256:<hex>` of a string or binary column."""
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def scope_key(connector, workspace_id, destination) -> Column:
    """First 32 hex characters over the trimmed scope, stable and safe as a file name."""
    from sealcheck.functions.text import clean_path, trim_space
    parts = [F.lit("v1"), trim_space(_col(connector)), trim_space(_col(workspace_id)),
             clean_path(trim_space(_col(destination)))]
    return F.substring(hashed(*parts), 1, 32)


def idempotency_key(operation_id, sequence, event_type, version: int = 1) -> Column:
    """Identity of one transition, so that a receiver can drop a repeat."""
    parts = [F.lit(str(version)), _col(operation_id), _col(sequence).cast("string"), _col(event_type)]
    return F.substring(hashed(*parts), 1, 32)


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of one row. Null and empty text differ, and no two column splits collide."""
    fields = []
    for name in columns:
        text = F.col(name).cast("string")
        fields.append(F.coalesce(F.concat(F.lit("="), F.octet_length(text).cast("string"), F.lit(":"), text),
                                 F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


# Row hashes a leaf of the digest tree holds on average at most, and children of a node.
LEAF_ROWS = 4096
FAN_OUT = 256
MAX_LEVELS = 6


def _listed(parts: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), ","), 256)


def table_digest(frame: DataFrame, columns: Sequence[str], by: Sequence[str] = ("snapshot_id",), leaf: int = LEAF_ROWS) -> DataFrame:
    """Order-free digest of a table's content per group: (by, n_rows, digest).

    The root of a tree over sorted row hashes, so another table with the same digest is a SHA-256 collision. Equal
    hashes are counted first, also in the map tasks. Leaves are buckets by hash prefix: the sorted hashes with their
    counts are hashed as one list. Nodes are hashed the same way over their children, one per two hex digits. A group
    gets as many levels as its rows need for leaves of `leaf` rows, so its digest depends on its own rows alone and no
    task holds more than one leaf or 256 children. An empty group has no digest.
    """
    def per_group(other: DataFrame, **extra: Column) -> DataFrame:
        return other.select(*[F.col(c).alias(f"_{c}") for c in by], *[c.alias(n) for n, c in extra.items()])

    def same() -> Column:
        both = F.lit(True)
        for c in by:
            both &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        return both

    sizes = cut_lineage(frame.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")))
    levels = F.lit(MAX_LEVELS)
    for n in range(MAX_LEVELS - 1, 0, -1):
        levels = F.when(F.col("n_rows") <= leaf * FAN_OUT ** n, n).otherwise(levels)
    deepest = sizes.agg(F.max(levels)).first()[0] or 1
    hashes = frame.select(*by, row_hash(columns).alias("h")).groupBy(*by, "h").agg(F.count(F.lit(1)).alias("n"))
    placed = hashes.join(per_group(sizes, levels=levels), same())
    nodes = placed.groupBy(*by, F.substring("h", 1, 2 * F.col("levels")).alias("prefix")).agg(_listed(F.concat("h", F.lit(":"), F.col("n").cast("string"))).alias("node"))
    for level in range(deepest, 0, -1):
        # Groups with fewer levels wait as they are until theirs is reached.
        here = F.length("prefix") == 2 * level
        above = F.when(here, F.substring("prefix", 1, 2 * level - 2)).otherwise(F.col("prefix"))
        nodes = nodes.groupBy(*by, above.alias("above"), here.alias("here")).agg(
            _listed(F.concat("prefix", F.lit("="), "node")).alias("joined"), F.first("node").alias("node"))
        nodes = nodes.select(*by, F.col("above").alias("prefix"), F.when(F.col("here"), F.col("joined")).otherwise(F.col("node")).alias("node"))
    return nodes.join(per_group(sizes, n_rows=F.col("n_rows")), same()).select(*by, "n_rows", digest(F.concat_ws(",", "n_rows", "node")).alias("digest"))
