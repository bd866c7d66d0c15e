"""Deduplication and state projection over the event stream.

Order is (operation_id, sequence), never the clock, so no watermark decides a result.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from sealcheck.operators.events import POSITION
from sealcheck.operators.state import SCOPE, project_state


def dedupe_stream(events: DataFrame) -> DataFrame:
    """First event per position. State grows with the number of positions, as exact deduplication must."""
    return events.dropDuplicates(POSITION)


def dedupe_stream_within(events: DataFrame, delay: str) -> DataFrame:
    """Bounded-state deduplication: repeats that arrive within `delay` of each other are dropped.

    An explicit approximation; a later repeat passes.
    """
    return events.withWatermark("recorded_at", delay).dropDuplicatesWithinWatermark(POSITION)


def state_stream(events: DataFrame) -> DataFrame:
    """Latest state per scope, as in batch. Write it in update mode.

    The state per scope is a maximum by position, which a repeated event does not change, so repeats need no
    separate deduplication. Spark combines events per task before the shuffle, so a hot scope costs one row per
    task and micro-batch, and keeps the state in its own store.
    """
    return project_state(events)


def _store(spark: SparkSession, path: str):
    """(file system, path) of a target, on whatever store it is."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _versions(spark: SparkSession, target: str) -> list[int]:
    """Versions of a merged target that were written whole, oldest first: those with the mark Spark leaves at the end."""
    store, place = _store(spark, target)
    found = [status.getPath() for status in store.listStatus(place)] if store.exists(place) else []
    whole = [p.getName() for p in found if p.getName().startswith("version=") and store.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(name.partition("=")[2]) for name in whole)


def append_batch(target: str) -> Callable[[DataFrame, int], None]:
    """Each batch fills a folder named by its id. One that is repeated after a failure replaces what it left, so every row is there once."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")
    return write


def merge_batch(target: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """Rows of a batch replace those of the same key; each batch makes a new version from the last one before it.

    A version counts once it is written whole, and a reader sees the newest such, never a part. A batch repeated after a
    failure starts from the same version as at first; one that was finished is not written again. The version before
    stays until the next batch, for readers that have it open.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark, done = batch.sparkSession, _versions(batch.sparkSession, target)
        if number in done:
            # Run all the same, because the stream's own state moves on only with its batches.
            batch.write.format("noop").mode("overwrite").save()
            return
        before = [v for v in done if v < number]
        merged = batch
        if before:
            old = spark.read.schema(batch.schema).parquet(f"{target}/version={before[-1]}")
            same = [old[k].eqNullSafe(batch[k]) for k in keys]
            merged = old.join(batch, reduce(lambda a, b: a & b, same), "left_anti").unionByName(batch)
        merged.write.mode("overwrite").parquet(f"{target}/version={number}")
        for version in before[:-1]:
            store, place = _store(spark, f"{target}/version={version}")
            store.delete(place, True)
    return write


def read_appended(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.parquet(target).drop("batch")


def read_merged(spark: SparkSession, target: str) -> DataFrame:
    """The newest whole version."""
    return spark.read.parquet(f"{target}/version={_versions(spark, target)[-1]}")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "update", keys: Sequence[str] = SCOPE) -> None:
    """Process everything available into Parquet at `target`, then stop; every event counts once, also after failures.

    In update mode changed rows are merged by `keys`, for `read_merged`; in append mode rows are added, for `read_appended`.
    """
    write = merge_batch(target, keys) if mode == "update" else append_batch(target)
    query = (stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(write).start())
    query.awaitTermination()
