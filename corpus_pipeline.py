"""A corpus pipeline of five stages, each over all that its predecessor kept.

Language ID, near-dedup by Jaccard similarity, benchmark decontamination, mixing to target weights, sharding. All stages but
the last return the columns of ``documents``; extra columns are dropped by the first. An empty table goes
through to an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontamination, langid, mixing, near_copies, sharding
from vellum.llm.common import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, texts without letters) go; a missing label becomes the predicted one."""
    model = langid.fit(docs)
    told = langid.identify(docs, model, keep=tuple(COLUMNS[1:]))
    if model.languages:  # a corpus without any label teaches nothing to reject by
        told = told.filter(F.col("lang_pred") != "und")
    return told.withColumn("lang", F.coalesce("lang", F.when(F.col("lang_pred") != "und", F.col("lang_pred")))).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (Jaccard similarity of five-word shingles 0.8 or more, or steps of it) one row stays: that with the least id, any id before none.

    SimHash finds candidates, MinHash bands those that it misses, and their shingles are compared.
    Rows are told apart by a stored number and not by their id: unlike texts under one id, or without an id, all stay.
    """
    rows = materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = near_copies.row_groups(rows, "_row").join(rows.select(F.col("_row").alias("row_id"), "doc_id"), "row_id")
    keep = groups.groupBy("group_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_id")).alias("least")).select(F.col("least.row_id").alias("_row"))
    return rows.join(keep, "_row", "left_semi").select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, those without an id too; of several under one id, or none, only the rows that hold one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = materialize(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")
    held = decontamination.find_items(rows, items, doc_id="_row").select(F.col("doc_id").alias("_row")).distinct()
    held = materialize(held, "held")  # few of them are broadcast, their size being known
    return rows.join(held, "_row", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document; whole documents are its blocks here."""
    documents, draws = mixing.mix(docs, block_words=None, carry=tuple(COLUMNS[1:]))
    return documents.join(draws.select("row_id"), "row_id").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row of the mix."""
    return sharding.shard_rows(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: Fingerprints, language scores and hash permutations are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
