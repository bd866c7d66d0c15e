"""Helpers that keep one hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sealcheck.session import cut_lineage

# A key is hot when it holds more than 1/HOT_SHARE of the rows, so fewer than HOT_SHARE keys can be hot.
HOT_SHARE = 1000
MIN_HOT_ROWS = 1_000_000


def hot_keys(frame: DataFrame, key: str, rows: int, share: int = HOT_SHARE, floor: int = MIN_HOT_ROWS) -> DataFrame:
    """Keys holding more than rows/share rows. At most `share` of them exist, whatever the data size."""
    limit = max(rows // share, floor)
    return frame.groupBy(key).count().filter(F.col("count") > limit).select(key)


def lookup(facts: DataFrame, unique: DataFrame, key: str, rows: int, how: str = "left", share: int = HOT_SHARE,
           floor: int = MIN_HOT_ROWS) -> DataFrame:
    """Join of a large frame to one row per key, safe for hot keys.

    Rows of hot keys are joined by broadcasting just the matching rows of `unique`, of which fewer than `share`
    can exist; all other rows take the ordinary shuffle join. Both parts together are the whole result.
    """
    if rows <= floor:
        return facts.join(unique, key, how)
    hot = F.broadcast(hot_keys(facts, key, rows, share, floor))
    hot_rows = facts.join(hot, key, "left_semi").join(F.broadcast(unique.join(hot, key, "left_semi")), key, how)
    return hot_rows.unionByName(facts.join(hot, key, "left_anti").join(unique, key, how))


# Bits of a sieve: 16 MiB, whatever it holds.
SIEVE_BITS = 1 << 27


def sieve(rows: DataFrame, own: str, wanted: DataFrame, bits: int = SIEVE_BITS) -> DataFrame:
    """Rows whose hash `own` may be among those of `wanted`, told without a shuffle; all that are stay, and few others.

    The hashes become a bitmap of bounded size that every task reads. It narrows what an exact join has to move, nothing else.
    That join is best an inner one to unique keys, as a semi join would be moved below the sieve.
    """
    def place(frame: DataFrame) -> DataFrame:
        bit = F.pmod(F.col(own), F.lit(bits))
        return frame.withColumns({"_bucket": F.bitmap_bucket_number(bit), "_bit": F.bitmap_bit_position(bit)})

    maps = place(wanted.select(own)).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.conv(F.hex(F.substring(F.col("_map"), F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    inside = F.getbit(byte.cast("long"), (F.col("_bit") % 8).cast("int")) == 1
    return place(rows).join(F.broadcast(maps), "_bucket").filter(inside).select(*rows.columns)


def running_total(frame: DataFrame, group: Sequence[str], order: Sequence[str], amount: Column, name: str,
                  partitions: int | None = None) -> DataFrame:
    """Sum of `amount` over the rows of a group up to and with each row, also when one group spans many tasks.

    Rows are range-partitioned by group and order together, so a hot group is spread over as many ranges as it
    needs. Sums are first made inside a range, then shifted by what the same group has in earlier ranges. Only a
    group that crosses a range boundary needs a shift, at most one per boundary. `order` must be total within a group.
    """
    spark = frame.sparkSession
    ranges = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(frame.withColumn("_amount", amount.cast("long")).repartitionByRange(ranges, *group, *order)
                         .withColumn("_range", F.spark_partition_id()))
    inside = Window.partitionBy("_range", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*group, "_range").agg(F.sum("_amount").alias("_sum"))
    # One row per range boundary that lies inside a group: fewer than the number of ranges.
    shifts = sums.withColumn("_shift", F.sum("_sum").over(earlier)).filter("_shift IS NOT NULL").drop("_sum")
    # A struct is never null, so groups with a null key find their shift too.
    key = F.struct("_range", *group).alias("_key")
    summed = placed.withColumn("_inside", F.sum("_amount").over(inside)).withColumn("_key", key)
    return (summed.join(F.broadcast(shifts.select(key, "_shift")), "_key", "left")
            .withColumn(name, F.col("_inside") + F.coalesce("_shift", F.lit(0)))
            .drop("_key", "_range", "_inside", "_shift", "_amount"))


def ordered_positions(frame: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "position",
                      partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group, by `running_total`."""
    return running_total(frame, group, order, F.lit(1), name, partitions)
