"""Sets of slots as bitmaps of a bounded size that are broadcast, so that only rows that may meet a table of keys are shuffled to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits a key in a filter, and the fewest and most that one has: 2^28 bits are 32 MB.
BITS_A_KEY, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 28


def slot_bitmaps(slots: DataFrame) -> DataFrame:
    """The set of slots (column ``slot``, counted from 1) as (bucket, bitmap) rows of 4 KB."""
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap"))


def with_bit(rows: DataFrame, slot: Column, bitmaps: DataFrame, name: str) -> DataFrame:
    """``rows`` with a boolean: whether the slot is in the set. The bitmaps are broadcast: at most MOST_BITS bits."""
    place = F.bitmap_bit_position(slot)
    met = rows.withColumn("bucket", F.bitmap_bucket_number(slot)).join(F.broadcast(bitmaps), "bucket", "left")
    byte = F.conv(F.hex(F.substring("bitmap", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return met.withColumn(name, F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))).drop("bucket", "bitmap")


def apart(rows: DataFrame, keys: DataFrame, key: str, most: int = MOST_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is surely not among ``keys``, rows where it may be): the first have moved nowhere. ``keys`` has that one column, and should be stored."""
    bits, n = LEAST_BITS, keys.count()
    while bits < min(BITS_A_KEY * n, most):
        bits *= 2
    slot = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    met = with_bit(rows, slot, slot_bitmaps(keys.select(slot.alias("slot"))), "_maybe")
    return met.filter(~F.col("_maybe")).drop("_maybe"), met.filter("_maybe").drop("_maybe")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is among ``keys``, exactly; others are not shuffled."""
    return apart(rows, keys, key)[1].join(keys, key, "left_semi")


def not_among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not among ``keys``, exactly; only those that may be are shuffled."""
    sure, maybe = apart(rows, keys, key)
    return sure.unionByName(maybe.join(keys, key, "left_anti"))
