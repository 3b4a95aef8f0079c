"""Tables that outlive a run: rows in hash buckets of their key, changed by rewriting touched buckets only, published by version.

A change writes its buckets beside the old ones and then puts down a manifest, a small file that names the version of each
bucket. Readers take the last manifest, so they see a change whole or not at all, and a run that dies before its
manifest leaves the table as it was. Of two changes at a time the second finds the manifest's name taken, and fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import fresh_path, names_in, put_text, remove, stored, text_of

BUCKETS = 64
#: Every so many versions of a table all rows of touched buckets are dealt anew, so that files stay few.
DEAL = 8


class KeyedTable:
    """Rows of ``schema`` below ``path``, dealt by the hash of ``key``. The number of buckets holds for the table's life."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        self.schema = T._parse_datatype_string(schema)
        names = self._manifests()
        self.buckets = json.loads(text_of(spark, f"{self.path}/manifest/{names[-1]}"))["buckets"] if names else buckets

    def _manifests(self) -> list[str]:
        return sorted(x for x in names_in(self.spark, f"{self.path}/manifest") if x.endswith(".json"))

    def _last(self) -> tuple[int, dict[str, int]]:
        names = self._manifests()
        return (int(names[-1][:-5]), json.loads(text_of(self.spark, f"{self.path}/manifest/{names[-1]}"))["of"]) if names else (0, {})

    @property
    def version(self) -> int:
        return self._last()[0]

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets that some keys fall into: a bounded number."""
        return sorted(r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect())

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets; no other bucket is opened."""
        _, of = self._last()
        places = [f"{self.path}/data/v={v:012d}/_b={b}" for b, v in of.items() if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*places) if places else self.spark.createDataFrame([], self.schema)

    def change(self, keys: DataFrame, make: Callable[[DataFrame], DataFrame | tuple[DataFrame, DataFrame]]) -> int:
        """Replace the rows of the buckets that ``keys`` touch by what ``make`` makes of them; the new version.

        ``make`` may only return rows whose keys fall into these buckets. It may return two tables: old rows
        that no shuffle has moved, which are written by the tasks that read them, and rows to be dealt to their buckets.
        """
        buckets = self.touched(keys)
        n, of = self._last()
        if not buckets:
            return n
        made = make(self.read(buckets))
        stay, move = made if isinstance(made, tuple) else (None, made)
        if stay is not None and (n + 1) % DEAL == 0:
            stay, move = None, stay.unionByName(move)
        placed = lambda rows: rows.select(*self.schema.names).withColumn("_b", self._bucket())
        rows = placed(move).hint("rebalance", "_b")  # large buckets are split over tasks and files
        rows = rows if stay is None else placed(stay).unionByName(rows)
        at = f"{self.path}/data/v={n + 1:012d}"
        rows.write.mode("overwrite").option("compression", "zstd").partitionBy("_b").parquet(at)
        there = {x.partition("=")[2] for x in names_in(self.spark, at) if x.startswith("_b=")}
        of = {b: v for b, v in of.items() if int(b) not in buckets} | {b: n + 1 for b in there}
        put_text(self.spark, f"{self.path}/manifest/{n + 1:012d}.json", json.dumps({"buckets": self.buckets, "key": self.key, "of": of}))
        return n + 1

    def vacuum(self, keep: int = 2) -> int:
        """Drop what only versions before the last ``keep`` name; how many folders of buckets went."""
        names = self._manifests()
        if not names:
            return 0
        used = {(b, v) for x in names[-keep:] for b, v in json.loads(text_of(self.spark, f"{self.path}/manifest/{x}"))["of"].items()}
        gone = 0
        for x in names[:-keep]:
            remove(self.spark, f"{self.path}/manifest/{x}")
        for v in names_in(self.spark, f"{self.path}/data"):
            n = int(v.partition("=")[2])
            if n > int(names[-1][:-5]):  # of a run that died, or of one under way
                continue
            for b in [x for x in names_in(self.spark, f"{self.path}/data/{v}") if x.startswith("_b=")]:
                if (b.partition("=")[2], n) not in used:
                    remove(self.spark, f"{self.path}/data/{v}/{b}")
                    gone += 1
        return gone


class Cache:
    """Derived output that survives runs: one entry a path, good only while its whole stamp is equal.

    ``path`` columns say what an entry is of (a vault among them keeps vaults apart), ``stamp`` columns what it was made
    from: a time, a content's hash, a model, a version of the code.
    """

    def __init__(self, spark: SparkSession, folder: str, path: str = "vault string, node_id string", stamp: str = "mtime long, model string", value: str = "response string", buckets: int = BUCKETS):
        names = lambda s: T._parse_datatype_string(s).names
        self.path, self.keys, self.value = names(path), names(path) + names(stamp), names(value)
        self.table = KeyedTable(spark, folder, f"{path}, {stamp}, {value}, saved timestamp", self.path, buckets)

    def entries(self, wanted: DataFrame | None = None) -> DataFrame:
        return self.table.read(None if wanted is None else self.table.touched(wanted))

    def hits(self, wanted: DataFrame) -> DataFrame:
        """Wanted rows with the cached value whose whole key is equal; only buckets that they touch are read."""
        return wanted.join(self.entries(wanted).drop("saved"), self.keys)

    def misses(self, wanted: DataFrame) -> DataFrame:
        return wanted.join(self.entries(wanted).select(*self.keys), self.keys, "left_anti")

    def save(self, fresh: DataFrame) -> int:
        """Put entries down, each in place of the one of its path; of several of a path one stays. The new version."""
        fresh = stored(fresh.select(*self.keys, *self.value).dropDuplicates(self.path), "fresh").withColumn("saved", F.current_timestamp())
        return self.table.change(fresh, lambda old: old.join(fresh.select(*self.path), self.path, "left_anti").unionByName(fresh))

    def load_or_build(self, wanted: DataFrame, build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int, int]:
        """(rows with their value, how many were there, how many were built). ``build`` gets what is missing, and is not called for nothing."""
        missing = stored(self.misses(wanted), "missing")
        n_built, n = missing.count(), wanted.count()
        if n_built:
            self.save(build(missing))
        return self.hits(wanted), n - n_built, n_built


def cache_at(spark: SparkSession, **options) -> Cache:
    """A cache in a folder of its own, which goes when the application ends."""
    return Cache(spark, fresh_path(spark, "cache"), **options)
