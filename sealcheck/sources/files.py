"""Files of any size: listed by Spark as rows, read inside the tasks in pieces of bounded size.

Only paths and results move between tasks. A file is opened where its row is: local paths directly, others through the
file systems of pyarrow (hdfs, s3, gs, abfs). Where that knows the store not, as with mounts only Spark resolves, hashing
falls back to Spark's whole-file reader, which ends at 2 GiB a file.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructType

from sealcheck.functions.ids import digest
from sealcheck.functions.text import contains_secret

PIECE_BYTES = 8 << 20
_REMOTE = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*)://([^/]*)(/.*)")


def open_file(path: str):
    """A seekable binary stream of a path as Spark lists it."""
    remote = _REMOTE.fullmatch(path)
    if remote is None or remote[1] == "file":
        return open(re.sub(r"^file:/+", "/", path), "rb")
    from pyarrow.fs import FileSystem
    store, base = FileSystem.from_uri(f"{remote[1]}://{remote[2]}/")
    return store.open_input_file(base.rstrip("/") + remote[3])


def readable_in_tasks(path: str) -> bool:
    """Whether `open_file` knows the store of a path; decided by its scheme, without reading."""
    remote = _REMOTE.match(path)
    return remote is None or remote[1] in ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of every file below; nothing is opened."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    return files.select("path", F.col("length").alias("bytes"))


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Short rows that stand for long work, dealt to as many tasks as a shuffle has; without the number they would be packed together again."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def _scan(secrets: Sequence[bytes], piece_bytes: int):
    """Size, SHA-256 and presence of any secret, in one pass. Overlaps of pieces are as long as the longest secret but one byte."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, overlap = None, max(map(len, secrets), default=1) - 1
        if secrets:
            import ahocorasick
            automaton = ahocorasick.Automaton()
            for secret in secrets:
                automaton.add_word(secret.decode("latin-1"), True)
            automaton.make_automaton()
        for batch in batches:
            out = []
            for path in batch["path"]:
                total, size, hit, tail = hashlib.sha256(), 0, False, b""
                with open_file(path) as file:
                    while piece := file.read(piece_bytes):
                        total.update(piece)
                        size += len(piece)
                        if automaton is not None and not hit:
                            window = tail + piece
                            hit = next(automaton.iter(window.decode("latin-1")), None) is not None
                            tail = window[max(0, len(window) - overlap):]
                out.append((path, size, f"sha256:{total.hexdigest()}", hit))
            yield pd.DataFrame(out, columns=["path", "bytes", "checksum", "has_secret"])
    return run


def scan_files(files: DataFrame, secrets: Sequence[str] = (), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(path, bytes, checksum, has_secret) of listed files, each read once from end to end, whatever the number of secrets.

    Secrets are the UTF-8 bytes of the given texts, found anywhere in a file, also across pieces; empty ones are none.
    A file that cannot be read fails the job: nothing is proven about it.
    """
    known = sorted({s.encode() for s in secrets if s})
    return spread(files.select("path"), "path").mapInPandas(_scan(known, piece_bytes), "path string, bytes long, checksum string, has_secret boolean")


def scan_tree(spark: SparkSession, pattern: str, secrets: Sequence[str] = (), piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """`scan_files` over everything below a path."""
    if readable_in_tasks(pattern):
        return scan_files(list_files(spark, pattern), secrets, piece_bytes)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern)
    found = contains_secret([(F.col("content"), True)], list(secrets)) if any(secrets) else F.lit(False)
    return files.select("path", F.col("length").alias("bytes"), digest(F.col("content")).alias("checksum"), found.alias("has_secret"))


def _fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(len(batch)):
            one = batch.iloc[at:at + 1].copy()
            with open_file(one["file"].iloc[0]) as file:
                one["content"] = [file.read()]
            yield one


def with_content(rows: DataFrame) -> DataFrame:
    """Adds `content`, the bytes of the file each row names in `file`; meant for bodies, which fit in memory one by one."""
    first = rows.select("file").first()
    if first is None or readable_in_tasks(first.file):
        return spread(rows, "file").mapInPandas(_fetch, StructType(rows.schema.fields).add("content", BinaryType()))
    bodies = rows.sparkSession.read.format("binaryFile").load([r.file for r in rows.select("file").collect()])
    return rows.join(bodies.select(F.col("path").alias("file"), "content"), "file")


def located(root: str, path: Column, inside: str) -> tuple[Column, Column]:
    """(snapshot_id, path below `inside`) of a file below the root."""
    bare = re.sub(r"^[A-Za-z0-9+.-]+:/+", "/", root).rstrip("/")
    pattern = rf"\Q{bare}\E/([^/]+)/{inside}(.+)$"
    return F.regexp_extract(path, pattern, 1), F.regexp_extract(path, pattern, 2)
