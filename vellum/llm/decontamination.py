"""Benchmark decontamination: short test items inside long documents, in DataFrame operations only.

Search: items are partitioned by size (powers of two of their number of shingles). An item is represented by
its bottom-m MinHash, the m smallest of its shingle hashes, with m set per size class so that a document that
holds 80 % of the item's shingles must hold one of those m: of n shingles at most n - ceil(0.8 n) are missing.
So the search loses nothing. Documents are probed only with hashes below the largest in any sketch, and only
against classes that they are long enough for. Candidates are verified by exact shingle containment.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.bitmaps import slot_bitmaps, with_bit
from .common import attach, fold_case, let, materialize, shingles_of, words_of
from .exact_dedup import filter_bits

WORDS = 5
THRESHOLD = 0.8
#: Sketches and items are broadcast up to these many hashes and shingles (about 32 bytes each); beyond, they are joined by a shuffle.
MOST_BROADCAST = 200_000


def sketch_size(size_class: int, threshold: float = THRESHOLD) -> int:
    """Hashes that represent an item of fewer than 2^(size_class+1) shingles."""
    most = (1 << (size_class + 1)) - 1
    return most - math.ceil(threshold * most) + 1


def _hashes(words: Column, k: int) -> Column:
    return F.coalesce(shingles_of(words, k, lambda ws: F.xxhash64(*ws)), F.array().cast("array<bigint>"))


def _texts(words: Column, k: int) -> Column:
    return F.coalesce(shingles_of(words, k, lambda ws: F.concat_ws(" ", *ws)), F.array().cast("array<string>"))


def _by_length(k: Column, of) -> Column:
    out = of(WORDS)
    for n in range(1, WORDS):
        out = F.when(k == n, of(n)).otherwise(out)
    return out


def item_shingles(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, k, shingles, hashes): distinct shingles of k words; k is five, or all words of a shorter item."""
    cut = items.select(F.col(id_col).alias("item_id"), words_of(fold_case(F.col(text_col))).alias("words")).filter(F.size("words") > 0)
    cut = cut.withColumn("k", F.least(F.size("words"), F.lit(WORDS)))
    cut = cut.withColumn("shingles", F.array_distinct(_by_length(F.col("k"), lambda n: _texts(F.col("words"), n))))
    return cut.withColumn("hashes", F.array_sort(F.array_distinct(_by_length(F.col("k"), lambda n: _hashes(F.col("words"), n))))).drop("words")


def find_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Pairs ``doc_id, item_id, n_shingles, n_found, containment``: documents that hold at least ``threshold`` of an item's shingles.

    A-Z are lower-cased, words are runs free of white space, shingles are five words (an item of fewer words
    is one shingle of all its words) and count once. Null, empty and blank texts hold nothing and are held by
    nothing. Repeated rows give one pair. A null id is an id like others, on either side. Other columns are ignored; empty tables give an empty result.
    """
    cut = item_shingles(items, item_id, item_text)
    sizes = {c: sketch_size(c, threshold) for c in range(32)}
    size_class = F.floor(F.log2(F.size("shingles"))).cast("int")
    m = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), size_class)
    need = F.ceil(F.lit(threshold) * F.pow(F.lit(2.0), size_class)).cast("int")
    sketch = cut.select("item_id", "k", need.alias("need"), F.explode(F.slice("hashes", F.lit(1), m)).alias("hash"))
    facts = sketch.agg(F.count(F.lit(1)), F.max("hash"), F.collect_set("k")).first()
    n_hashes, ceiling, lengths = int(facts[0]), facts[1], sorted(facts[2] or [WORDS])
    small = n_hashes <= most_broadcast and (cut.agg(F.sum(F.size("shingles"))).first()[0] or 0) <= most_broadcast
    put = F.broadcast if small else lambda df: df

    def low(words: Column) -> Column:
        every = F.concat(*[_hashes(words, k) for k in lengths])
        return F.filter(every, lambda h: h <= F.lit(ceiling)) if ceiling is not None else F.slice(every, 1, 0)

    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    found = texts.select("doc_id", let(words_of(fold_case(F.col("text"))), lambda words: F.struct(F.size(words).alias("n"), low(words).alias("hashes"))).alias("w"))
    probes = found.select("doc_id", F.col("w.n").alias("n_words"), F.explode("w.hashes").alias("hash"))
    wanted = sketch.select("item_id", "hash", "need")
    if small:
        near = probes.join(F.broadcast(wanted), "hash")
    else:  # probes that no sketch can have drop where they are made; a passage that many documents share is one hot hash: its probes stay too
        bits, _ = filter_bits(n_hashes)
        slot = F.pmod("hash", F.lit(bits)) + 1
        probes = materialize(with_bit(probes, slot, slot_bitmaps(sketch.select(slot.alias("slot"))), "_in").filter("_in").drop("_in"), "probes")
        met = wanted.join(probes.groupBy("hash").agg(F.count(F.lit(1)).alias("n")), "hash")
        near = attach(probes, met, "hash", "n", probes.count()).filter("n IS NOT NULL")
    near = near.filter(F.col("n_words") >= F.col("need"))
    # Candidates are stored first: with their size known, few of them are broadcast and no text is shuffled.
    near = materialize(near.select(F.col("doc_id").alias("_id"), F.col("item_id").alias("_item")).distinct(), "candidates")
    pairs = texts.join(near, F.col("doc_id").eqNullSafe(F.col("_id"))).join(put(cut.select("item_id", "k", "shingles")), F.col("item_id").eqNullSafe(F.col("_item")))
    same = let(words_of(fold_case(F.col("text"))), lambda words: F.size(F.array_intersect(_by_length(F.col("k"), lambda n: _texts(words, n)), F.col("shingles"))))
    pairs = pairs.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_shingles"), same.cast("long").alias("n_found"))
    share = F.col("n_found") / F.col("n_shingles")
    return pairs.groupBy("doc_id", "item_id", "n_shingles").agg(F.max("n_found").alias("n_found")).filter(share >= threshold).withColumn("containment", share)
