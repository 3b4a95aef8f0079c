"""Exact dedup by two passes over a Bloom filter, in DataFrame operations only.

Pass one counts how many rows fall on each slot of the filter and keeps the slots hit more than once as a
bitmap. Pass two tests every row against it: a row with a slot that no other row hit is unique and passes
straight through; only the others shuffle, by the hash of their text. Where one filter would grow past
MOST_BITS, hashes are dealt out to residue classes, each stored apart and with a filter of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bitmaps import slot_bitmaps, with_bit
from ..sources.tables import fresh_path
from .common import attach, fold_case

PROBES = 2
#: Bits a row in a filter, and the most that one may have: 2^28 bits are 32 MB, the bound of what is broadcast at a time.
BITS_A_ROW, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28


def filter_bits(n_rows: int, most: int = MOST_BITS) -> tuple[int, int]:
    """(bits of a filter, number of classes) for so many rows: classes double where one filter would be too large."""
    bits, classes = LEAST_BITS, 1
    while bits < min(BITS_A_ROW * n_rows, most):
        bits *= 2
    while bits * classes < BITS_A_ROW * n_rows:
        classes *= 2
    return bits, classes


def _slots(digest: Column, bits: int) -> Column:
    return F.array_distinct(F.array(*[F.pmod(F.xxhash64(digest, F.lit(k)), F.lit(bits)) + 1 for k in range(PROBES)]))


def repeated_slots(hashes: DataFrame, bits: int) -> DataFrame:
    """The Bloom filter of pass one as (bucket, bitmap) rows of 4 KB: bits of slots that two rows or more hit."""
    return slot_bitmaps(hashes.select(F.explode(_slots(F.col("text_sha256"), bits)).alias("slot")).groupBy("slot").count().filter("count > 1"))


def maybe_repeated(hashes: DataFrame, bloom: DataFrame, bits: int) -> DataFrame:
    """``hashes`` with a boolean ``maybe``; false only for rows whose text no other row has."""
    out = hashes.withColumn("_slots", _slots(F.col("text_sha256"), bits))
    maybe = F.lit(True)
    for k in range(PROBES):
        out = with_bit(out, F.coalesce(F.get("_slots", F.lit(k)), F.get("_slots", F.lit(0))), bloom, f"_bit{k}")
        maybe = maybe & F.col(f"_bit{k}")
    return out.withColumn("maybe", maybe).drop("_slots", *[f"_bit{k}" for k in range(PROBES)])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_bits: int = MOST_BITS) -> DataFrame:
    """One row a document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical after lower-casing A to Z; null counts as empty. Of equal texts the
    largest id stays (a null id is below every other; rows alike in id and text are all marked kept).
    Equality is that of SHA-256. Other columns are ignored, and an empty table gives an empty result.
    A group that holds more than a two-thousandth of all rows never meets in one task (see `attach`).
    """
    spark = docs.sparkSession
    hashes = docs.select(F.col(id_col).alias("doc_id"), F.sha2(fold_case(F.col(text_col)), 256).alias("text_sha256"))
    path = fresh_path(spark, "hashes")
    hashes.write.option("compression", "zstd").parquet(path)
    hashes = spark.read.schema(hashes.schema).parquet(path)
    n_rows = hashes.count()
    bits, classes = filter_bits(n_rows, most_bits)
    told_path = fresh_path(spark, "told")
    if classes > 1:  # a folder a class, so that each pass reads its own alone; one shuffle, whose large classes are split, keeps files few
        path = fresh_path(spark, "classes")
        hashes.withColumn("class", F.pmod(F.xxhash64("text_sha256", F.lit(PROBES)), F.lit(classes))).hint("rebalance", "class").write.option("compression", "zstd").partitionBy("class").parquet(path)
        hashes = spark.read.parquet(path)
    for k in range(classes):
        some = hashes.filter(F.col("class") == k).drop("class") if classes > 1 else hashes
        maybe_repeated(some, repeated_slots(some, bits), bits).write.mode("append").option("compression", "zstd").parquet(told_path)
    told = spark.read.schema("doc_id " + docs.select(id_col).dtypes[0][1] + ", text_sha256 string, maybe boolean").parquet(told_path)
    alone = told.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256")
    shared = told.filter("maybe").drop("maybe")
    groups = shared.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    out = alone.unionByName(attach(shared, groups, "text_sha256", "group_size", n_rows).select(*alone.columns))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
