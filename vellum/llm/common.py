"""What the training-data operators share: durable intermediates and a join that a hot key cannot stall."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import fresh_path

#: White space of the word rule: space and the controls from tab to carriage return.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER_AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: At most this many keys are ever broadcast as hot: a key is hot only with over 1/HOT_SHARE of all rows.
HOT_SHARE = 2000


def materialize(df: DataFrame, name: str, **options: str | int) -> DataFrame:
    """Cut the lineage: write ``df`` as a table in the shared folder, with options of its format, and read it back."""
    path = fresh_path(df.sparkSession, name)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_case(text: Column) -> Column:
    """Null as empty; A to Z, and nothing else, in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER_AZ, UPPER_AZ.lower())


def words_of(text: Column) -> Column:
    """The words of a text: maximal runs free of white space."""
    return F.filter(F.split(text, SPACE_CLASS), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, wherever the optimizer moves the expression; lambdas would compute it anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def shingles_of(words: Column, k: int, make) -> Column:
    """``make(list of k word columns)`` for each run of k words, repeats included; for fewer words an empty array."""
    last = F.size(words) - k
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: make([F.get(words, i + j) for j in range(k)])))


def attach(rows: DataFrame, stats: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """``rows`` left-joined with ``stats`` (one row a key; ``weight`` counts the key's rows).

    Keys with over 1/HOT_SHARE of the ``n_rows`` rows, so fewer than HOT_SHARE of them, are broadcast and
    their rows never move. What is left shuffles by key, and no key of it is large.
    """
    least = max(64, n_rows // HOT_SHARE)
    added = [c for c in stats.columns if c != key]
    hot = stats.filter(F.col(weight) > least).select(key, F.struct(*added).alias("_hot"))
    cold = stats.filter(F.col(weight) <= least)
    seen = rows.join(F.broadcast(hot), key, "left")
    there = seen.filter(F.col("_hot").isNotNull()).select(*rows.columns, *[F.col("_hot")[c].alias(c) for c in added])
    rest = seen.filter(F.col("_hot").isNull()).select(*rows.columns).join(cold, key, "left").select(*rows.columns, *added)
    return there.unionByName(rest)


def tokenizer_path(given: str | None, name: str) -> str:
    """Where a tokenizer's file is: as given, else the installed package of public vocabularies."""
    if given:
        return given
    try:
        import public_tokenizers
    except ModuleNotFoundError as e:
        raise FileNotFoundError(f"no package of tokenizers is installed here: name the file {name}") from e
    return public_tokenizers.path(name)


def share_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Put a file of bounded size into the shared folder and hand it to every executor, later ones too; tasks find it with ``SparkFiles.get``."""
    path = fresh_path(spark, f"{name}-{uuid.uuid4().hex}")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]
