"""Tables in the shared folder: where jobs cut their lineage and keep derived output."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on a local master, where it may be unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = getattr(spark, "_vellum_shared", None) or tempfile.mkdtemp(prefix="spark-vellum-")
        spark._vellum_shared = folder
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the application's own folder in the shared one, which goes when the application ends."""
    base = f"{shared_dir(spark)}/vellum-{spark.sparkContext.applicationId}"
    if getattr(spark.sparkContext, "_vellum_base", None) != base:
        spark.sparkContext._vellum_base = base
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return f"{base}/{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: a short plan that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in any store; none if it does not exist."""
    store, at = _at(spark, path)
    return [x.getPath().getName() for x in store.listStatus(at)] if store.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    store, at = _at(spark, path)
    store.delete(at, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    """Give a folder or file its final name, at which nothing may be yet."""
    store, at = _at(spark, path)
    _, there = _at(spark, to)
    if store.exists(there) or not store.rename(at, there):
        raise FileExistsError(f"{to} is there already")


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not there at all; an error if another has been put there."""
    store, at = _at(spark, f"{path}.{uuid.uuid4().hex}")
    out = store.create(at)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        move(spark, at.toString(), path)
    except FileExistsError:
        store.delete(at, False)
        raise


def text_of(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
