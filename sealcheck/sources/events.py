"""The event log as JSON lines, rotated files and the current one, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sealcheck.functions.text import clean_path, trim_space
from sealcheck.operators.events import event_rules
from sealcheck.schemas import EVENT, EVENT_VERSIONS

MAX_LINE_BYTES = 64 * 1024
KNOWN_KEYS = [field.name for field in EVENT]
SOURCE_KEYS = [field.name for field in EVENT["source"].dataType]
CURRENT_FILE = "events.jsonl"


def parse_lines(lines: DataFrame, writer_key: str | None = None, max_line_bytes: int | None = MAX_LINE_BYTES) -> DataFrame:
    """Lines to event columns; `unreadable` marks damaged, oversized, newer or invalid lines.

    `lines` has `value` and any other columns, which are kept. Blank lines are skipped. A key that no event has is
    refused, also inside the source; `writer_key` names one more that the writer may add at the top. Older
    versions are lifted to the current one.
    """
    lines = lines.filter(trim_space(F.col("value")) != "")
    parsed = F.from_json("value", EVENT, {"mode": "PERMISSIVE"})
    kept = [name for name in lines.columns if name != "value"]
    keys = F.map_keys(F.from_json("value", "map<string,string>"))
    inner = F.map_keys(F.from_json("value", "struct<source:map<string,string>>")["source"])
    known = KNOWN_KEYS + ([writer_key] if writer_key else [])
    strange = F.exists(keys, lambda key: ~key.isin(known)) | F.coalesce(F.exists(inner, lambda key: ~key.isin(SOURCE_KEYS)), F.lit(False))
    long = F.lit(False) if max_line_bytes is None else F.octet_length("value") > max_line_bytes
    whole = lines.select(*kept, parsed.alias("e"), keys.isNull().alias("_broken"), strange.alias("_strange"), long.alias("_long"))
    flat = whole.select(
        *kept, "_broken", "_strange", "_long", "e.schema_version", "e.type", "e.operation_id", "e.sequence", "e.recorded_at",
        trim_space(F.col("e.source.connector")).alias("connector"), trim_space(F.col("e.source.workspace_id")).alias("workspace_id"),
        clean_path(trim_space(F.col("e.source.destination"))).alias("destination"), "e.operation", "e.stage", "e.outcome", "e.message",
        "e.metadata")
    readable = F.coalesce(F.col("schema_version").between(*EVENT_VERSIONS), F.lit(False))
    broken: Column = F.col("_broken") | F.coalesce("_strange", F.lit(False)) | F.col("_long") | ~readable
    for condition, _ in event_rules():
        broken = broken | F.coalesce(condition, F.lit(False))
    lifted = F.when(readable, F.lit(EVENT_VERSIONS[1])).otherwise(F.col("schema_version"))
    return flat.withColumn("unreadable", broken).withColumn("schema_version", lifted).drop("_broken", "_strange", "_long")


def read_events(spark: SparkSession, folder: str, current: str = CURRENT_FILE, writer_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, unreadable count). Damaged lines are counted, not fatal.

    `arrival` orders lines as they were written: rotated files by name, then the one called `current`, and within
    a file by place. Names survive a copy to other storage, times of change do not.
    """
    name = F.col("_metadata.file_name")
    lines = spark.read.text(folder).select("value", F.struct(
        (name == current).alias("current"), name.alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line")).alias("arrival"))
    parsed = parse_lines(lines, writer_key)
    counted = parsed.filter("unreadable").agg(F.count(F.lit(1)).alias("unreadable"))
    return parsed.filter("NOT unreadable").drop("unreadable"), counted


def stream_events(spark: SparkSession, folder: str, files_per_trigger: int | None = None, writer_key: str | None = None) -> DataFrame:
    """The same lines as a stream; `unreadable` routes damaged ones aside."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_lines(reader.load(folder), writer_key)
