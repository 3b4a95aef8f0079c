"""Change capture: snapshots of files compared, and tables of derived output keyed by what it was derived from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def snapshot_diff(previous: DataFrame | None, current: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, kind): added, modified (another mtime) or deleted; without a previous snapshot all are added."""
    if previous is None:
        return current.select(*keys, F.lit("added").alias("kind"))
    a, b = previous.select(*keys, F.col("mtime").alias("_was"), F.lit(1).alias("_a")), current.select(*keys, F.col("mtime").alias("_is"), F.lit(1).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_was").eqNullSafe(F.col("_is")), "modified")
    return a.join(b, list(keys), "full_outer").select(*keys, kind.alias("kind")).filter("kind IS NOT NULL")


def change_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "modified", "deleted")])


def stale_ids(diff: DataFrame) -> DataFrame:
    """What derived output is out of date for: modified and deleted."""
    return diff.filter("kind <> 'added'").select("path")


def cache_hits(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted rows with the cached value whose whole key is equal."""
    return wanted.join(cache, keys)


def cache_misses(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(cache.select(*keys), keys, "left_anti")


def cache_upsert(cache: DataFrame, fresh: DataFrame, path: list[str]) -> DataFrame:
    """One entry a path, the newest (column ``saved``); of one time the fresh one."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*path).orderBy(F.desc("saved"), F.desc("_new")))
    return both.withColumn("_n", last).filter("_n = 1").drop("_n", "_new")
