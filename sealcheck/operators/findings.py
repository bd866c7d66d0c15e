"""The common finding row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from sealcheck.schemas import FINDING_COLUMNS


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def finding(frame: DataFrame, check: str, code, entity, key, detail=None) -> DataFrame:
    """Project a frame to finding rows; plain strings are literals."""
    return frame.select(
        F.col("snapshot_id").cast("string").alias("snapshot_id"), F.lit(check).alias("check_name"),
        as_column(code).cast("string").alias("code"), as_column(entity).cast("string").alias("entity"),
        as_column(key).cast("string").alias("key"), as_column(detail).cast("string").alias("detail"))


def coded(frame: DataFrame, check: str, rules: list[tuple[Column, str]], entity, key, detail=None) -> DataFrame:
    """One finding per rule a row breaks, in one pass over the frame.

    The codes of a row are joined to one text first: that stays in generated code, where an array filtered by a
    lambda would be interpreted.
    """
    codes = F.concat_ws(",", *[F.when(broken, F.lit(code)) for broken, code in rules])
    hit = frame.withColumn("_codes", codes).filter("_codes <> ''")
    return finding(hit.withColumn("_code", F.explode(F.split("_codes", ","))), check, F.col("_code"), entity, key, detail)


def first_code(rules: list[tuple[Column, str]]) -> Column:
    """Code of the first rule that is broken, in order."""
    return F.coalesce(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(code)) for broken, code in rules])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda left, right: left.unionByName(right), frames)


def union_findings(frames: list[DataFrame]) -> DataFrame:
    return union_all([frame.select(*FINDING_COLUMNS) for frame in frames])
