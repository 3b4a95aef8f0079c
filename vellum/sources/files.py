"""Files in and out: folders of notes, lists of queries, the usage log, snapshots, pages, query logs, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import usage
from ..operators.corpus import numbered
from .tables import names_in


def scan_notes(spark: SparkSession, root: str, vault: str = "main", folder: str | None = None) -> DataFrame:
    """Markdown files below a folder: (vault, node_id, title, body, mtime, sha), ids being paths relative to the root.

    Names that begin with ``.`` are left out, and by Spark's file sources those that begin with ``_`` as well.
    A folder that does not exist is an error. Modification times have milliseconds only, so caches also key
    on the hash of the content.
    """
    at = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(f"{at}/{folder.strip('/')}" if folder else at)
    base = at.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    kept = files.filter(~F.exists(F.split(path, "/"), lambda p: p.startswith(".")))
    name = F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"\.md$", "")
    return kept.select(F.lit(vault).alias("vault"), path.alias("node_id"), name.alias("title"), F.decode("content", "UTF-8").alias("body"), F.col("modificationTime").alias("mtime"), F.sha2("content", 256).alias("sha"))


def list_notes(spark: SparkSession, root: str, folder: str | None = None) -> DataFrame:
    """(path, mtime) of the notes below a folder, as `scan_notes` finds them, without opening any; none if the folder does not exist."""
    at = root.rstrip("/")
    if not names_in(spark, f"{at}/{folder.strip('/')}" if folder else at):
        return spark.createDataFrame([], "path string, mtime timestamp")
    return scan_notes(spark, root, folder=folder).select(F.col("node_id").alias("path"), "mtime")  # contents are pruned


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(pos, query): lines that are neither blank nor begin with ``#``, in the order of the file.

    The file is read in splits; where a line stands in it is told by its block's place and its row in the split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return query_lines(lines, "value", ["file", "block", "row"]).select("pos", tx.strip(F.col("value")).alias("query"))


def query_lines(lines: DataFrame, line: str, order: list[str]) -> DataFrame:
    """The lines that are queries, numbered from 1 in ``order`` as ``pos``."""
    text = tx.strip(F.col(line))
    return numbered(lines.filter((text != "") & ~text.startswith("#")), [], order, "pos", 1)


def write_usage(events: DataFrame, path: str) -> None:
    """Append events, one folder a day, so that retention drops folders and time bounds prune them."""
    events.withColumn("day", F.to_date("ts")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def retain_usage(spark: SparkSession, path: str, rollup_path: str, cutoff: date) -> int:
    """Roll up the days of a log before the cutoff day, then drop their folders; how many days went.

    The rollup is stored before anything is dropped, under the name of the cutoff, so a run that was cut off can be repeated.
    """
    log = spark.read.parquet(path)
    old = log.filter(F.col("day") < F.lit(cutoff))  # prunes folders
    days = [r[0] for r in old.select("day").distinct().collect()]  # a row a day
    if days:
        usage.rollup_daily(old.drop("day")).write.mode("overwrite").parquet(f"{rollup_path}/cutoff={cutoff}")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for day in days:
            store.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at, f"day={day}"), True)
        spark.catalog.refreshByPath(path)
    return len(days)


def clear_usage(spark: SparkSession, path: str) -> int:
    """Empty the log; how many events there were."""
    events = spark.read.parquet(path)
    n = events.count()
    events.limit(0).write.mode("overwrite").parquet(path)
    return n


def write_snapshot(current: DataFrame, path: str, snapshot_id: int) -> None:
    """A snapshot as a version of its own; readers see the last whole one."""
    current.write.mode("overwrite").parquet(f"{path}/snapshot_id={snapshot_id:012d}")


def load_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The last snapshot, of those before a version if one is given; None if there is none, or if its files cannot be read.

    Names tell which is the last; no other is opened.
    """
    there = [x for x in sorted(names_in(spark, path)) if x.startswith("snapshot_id=")]
    there = [x for x in there if before is None or int(x.partition("=")[2]) < before]
    if not there:
        return None
    try:
        return spark.read.option("mergeSchema", "true").parquet(f"{path}/{there[-1]}")  # looks at the footer of every file
    except Exception as e:
        if any(x in str(e) for x in ("UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "not a Parquet file", "Could not read footer")):
            return None
        raise


def write_pages(pages: DataFrame, index: DataFrame, log: DataFrame, path: str) -> None:
    """Pages and index replace those of the last run, the log grows."""
    pages.write.mode("overwrite").parquet(f"{path}/pages")
    index.write.mode("overwrite").parquet(f"{path}/index")
    log.write.mode("append").parquet(f"{path}/log")


def write_query_log(results: DataFrame, path: str) -> None:
    results.write.mode("append").parquet(path)


def export_batch(results: DataFrame) -> DataFrame:
    """Answers (pos, query, answer, error) as sections of a report, in order; errors as ``[ERROR] …``."""
    said = F.when(F.col("error").isNotNull(), F.concat(F.lit("[ERROR] "), "error")).otherwise(F.col("answer"))
    return results.orderBy("pos").select("pos", F.concat(F.lit("## "), "query", F.lit("\n\n"), said, F.lit("\n")).alias("value"))
