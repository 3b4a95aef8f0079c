"""Mixing sources to target weights.

Documents are cut into blocks of words. A source's target fixes how many of its blocks the mix takes, exactly;
a splitting tree of multivariate-hypergeometric draws deals those quotas over the output shards; and each
shard draws its own stretch of the source's permuted blocks, so that no two shards draw the same one. What
the shards draw is the mix. Inside a shard blocks are ordered by a hash of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_CLASS, WORD_CLASS, materialize

#: A weight belongs to each source, so the list of sources is small; more than this is an error, not a cut.
MOST_SOURCES = 100_000
BLOCK_WORDS = 128
#: Blocks that one task permutes at a time, on average.
BUCKET_BLOCKS = 20_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_CLASS)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], budget: float, cap: float = 2.0) -> list[float]:
    """Shares of the budget by weight; none above ``cap`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while open_:
        lift = left / sum(weights[i] for i in open_)
        full = [i for i in sorted(open_) if weights[i] * lift > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = weights[i] * lift
            break
        for i in full:
            out[i] = cap * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def _log_binomial(x: np.ndarray, n: int, p: float) -> np.ndarray:
    """log P(X = x) of a binomial variable up to a constant, exact to rounding for large n too: Loader's saddle-point form, 0 < x < n."""
    x = np.asarray(x, dtype=np.float64)

    def deviance(k: np.ndarray, mean: float) -> np.ndarray:
        return k * np.log1p((k - mean) / mean) - (k - mean)

    error = lambda k: (1 / 12 - (1 / 360 - 1 / 1260 / k**2) / k**2) / k
    return -error(x) - error(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p)) - 0.5 * (np.log(x) + np.log(n - x))


def hypergeometric(rng: np.random.Generator, good: int, bad: int, take: int) -> int:
    """How many of ``take`` items drawn without replacement from ``good + bad`` are good.

    Beyond the range of numpy's sampler by rejection: a binomial proposal for one kind, accepted with the
    probability, relative to its greatest, that a binomial of the other kind makes up the rest.
    """
    if not take or not good:
        return 0
    if take == good + bad:
        return good
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, take))
    if good > bad:
        return take - hypergeometric(rng, bad, good, take)
    p = take / (good + bad)
    mode = np.clip(np.floor((bad + 1) * p), 1, bad - 1)
    while True:
        a = rng.binomial(good, p, 64)
        a = a[(a < take) & (take - a < bad)]
        odds = _log_binomial(take - a, bad, p) - _log_binomial(mode, bad, p)
        kept = a[np.log(rng.random(len(a))) < odds]
        if len(kept):
            return int(kept[0])


def _draw(rng: np.random.Generator, quotas: np.ndarray, take: int) -> np.ndarray:
    """How many of each source are among ``take`` blocks drawn from all quotas without replacement."""
    out, left = np.zeros_like(quotas), int(quotas.sum())
    for i, have in enumerate(map(int, quotas)):
        n = hypergeometric(rng, have, left - have, take)
        out[i], take, left = n, take - n, left - have
    return out


def splitting_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (row) for each shard (column): rows add up to the quotas, columns are even."""
    out = np.zeros((len(quotas), shards), dtype=np.int64)

    def split(have: np.ndarray, low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = have
            return
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        left = _draw(rng, have, int(have.sum()) * (mid - low) // (high - low))
        split(left, low, mid)
        split(have - left, mid, high)

    split(np.asarray(quotas, dtype=np.int64), 0, shards)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, shards: int = 8, block_words: int | None = BLOCK_WORDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(documents, draws) of a mix.

    Sources in the order of code points, null last as a source of its own, get the weights in turn and
    share ``share`` times all words; no source gets over ``cap`` times its words. ``documents`` has a row for
    each document: ``row_id, doc_id, size, source_size, target`` and the columns to ``carry``; ``draws`` a
    row for each block that the mix takes: ``row_id, block, words, copy, shard, shard_key``, to be read in
    the order of ``shard_key`` inside a shard. A block is ``block_words`` words of a document, or with None
    the whole document; it is drawn at most ``cap`` times (rounded up to whole passes over the source).

    Null and empty texts have no words and are never drawn. Repeated rows are documents of their own. No
    other column is read; an empty table gives empty results. The same rows give the same mix in whatever
    order they come: blocks are permuted by hashes of id, text and place, and rows alike in all are alike.
    """
    spark = docs.sparkSession
    slim = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("text_hash"), *[F.col(c).alias(f"_{c}") for c in carry],
    )
    slim = materialize(slim, "word_counts")
    per = F.ceil(F.col("size") / block_words) if block_words else F.when(F.col("size") > 0, 1).otherwise(0)
    totals = slim.groupBy("source").agg(F.sum("size"), F.sum(per)).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: weights are per source")
    totals.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r[1]) for r in totals]
    given = [float(weights[i % len(weights)]) for i in range(len(totals))]
    targets = capped_targets(sizes, given, share * sum(sizes), cap)
    whole = [int(t // s) if s else 0 for t, s in zip(targets, sizes, strict=True)]
    schema = "sid int, source string, source_size long, target double, passes int, rest double, n_blocks long"
    source = spark.createDataFrame([(i, r[0], s, t, w, t - w * s, int(r[2])) for i, (r, s, t, w) in enumerate(zip(totals, sizes, targets, whole, strict=True))], schema)
    known = slim.withColumn("_s", F.struct("source")).join(F.broadcast(source.select(F.struct("source").alias("_t"), "sid", "source_size", "target")), F.col("_s").eqNullSafe(F.col("_t")))
    documents = known.select("row_id", "doc_id", "size", "source_size", "target", *[F.col(f"_{c}").alias(c) for c in carry])

    n_blocks = sum(int(r[2]) for r in totals)
    bits = 8
    while (1 << bits) * BUCKET_BLOCKS < n_blocks:
        bits += 1
    cut = known.filter("size > 0").select("row_id", "doc_id", "text_hash", "sid", "size", F.explode(F.sequence(F.lit(0).cast("long"), per.cast("long") - 1)).alias("block"))
    long = F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words) if block_words else F.col("size")
    cut = cut.withColumn("words", long.cast("long")).withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "block")).withColumn("bucket", F.shiftrightunsigned("turn", 64 - bits).cast("int"))
    buckets = cut.groupBy("sid", "bucket").agg(F.sum("words").alias("w"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    buckets = buckets.select("sid", "bucket", F.coalesce(F.sum("w").over(before), zero).alias("w0"), F.coalesce(F.sum("n").over(before), zero).alias("n0"))
    inside = Window.partitionBy("sid", "bucket").orderBy("turn", "text_hash", "block", "row_id")
    ranked = cut.join(buckets, ["sid", "bucket"]).select(
        "row_id", "sid", "block", "words",
        (F.col("n0") + F.row_number().over(inside) - 1).alias("rank"),
        (F.col("w0") + F.coalesce(F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero)).alias("ahead"),
    )
    small = F.broadcast(source.select("sid", "passes", "rest", "n_blocks"))
    ranked = ranked.join(small, "sid").withColumn("extra", F.col("ahead") + F.col("words") / 2 <= F.col("rest"))
    ranked = materialize(ranked.select("row_id", "sid", "block", "words", "rank", "extra"), "blocks")

    # whole passes over a source, and of one more pass the blocks that reach its target
    extra = {r[0]: int(r[1]) for r in ranked.groupBy("sid").agg(F.count_if("extra")).collect()}  # a row a source
    quotas = [w * int(r[2]) + extra.get(i, 0) for i, (w, r) in enumerate(zip(whole, totals, strict=True))]
    dealt = splitting_tree(quotas, shards, seed)
    ends = np.cumsum(dealt, axis=1)
    schema = T.StructType([T.StructField("sid", T.IntegerType()), T.StructField("n_blocks", T.LongType()), T.StructField("ends", T.ArrayType(T.LongType()))])
    stretch = spark.createDataFrame([(i, int(totals[i][2]), [int(x) for x in row]) for i, row in enumerate(ends)], schema)
    drawn = ranked.join(F.broadcast(stretch), "sid")
    # a block stands at its rank in each pass over the permuted source; the shards draw the passes' places one stretch after another
    last = F.element_at("ends", -1) - 1
    drawn = drawn.filter(F.col("rank") <= last).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((last - F.col("rank")) / F.col("n_blocks")))))
    drawn = drawn.withColumn("draw", F.col("copy") * F.col("n_blocks") + F.col("rank"))
    drawn = drawn.withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("draw"))))
    return documents, drawn.select("row_id", "block", "words", F.col("copy").cast("int").alias("copy"), "shard", F.xxhash64(F.lit(seed), "shard", "sid", "draw").alias("shard_key"))


def mix_counts(docs: DataFrame, shards: int = 8, **options) -> DataFrame:
    """One row a document: ``doc_id, size, source_size, target, taken`` (words that the shards draw, repeats counted), ``by_shard`` (words that each draws)."""
    documents, draws = mix(docs, shards=shards, **options)
    zero = F.lit(0).cast("long")
    by_shard = F.array(*[F.coalesce(F.sum(F.when(F.col("shard") == k, F.col("words"))), zero) for k in range(shards)])
    taken = draws.groupBy("row_id").agg(F.sum("words").alias("taken"), by_shard.alias("by_shard"))
    none = F.array_repeat(zero, shards)
    return documents.join(taken, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", zero).alias("taken"), F.coalesce("by_shard", none).alias("by_shard"))


def mix_texts(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The blocks that the mix takes, with their words: ``shard, shard_key, doc_id, block, copy, text``."""
    step = options.get("block_words", BLOCK_WORDS)
    documents, draws = mix(docs, text_col=text_col, carry=(text_col,), **options)
    words = F.filter(F.split(F.col(text_col), SPACE_CLASS), lambda w: w != "")
    text = F.array_join(F.slice(words, (F.col("block") * step + 1).cast("int"), F.lit(step)), " ") if step else F.col(text_col)
    return documents.join(draws, "row_id").select("shard", "shard_key", "doc_id", "block", "copy", text.alias("text"))
