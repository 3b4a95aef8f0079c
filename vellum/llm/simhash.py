"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code: a product of repetition codes, one over each of s stretches of
the 64 bits, whose radius is the sum of half the stretches. A fingerprint is replicated to anchors within the
covering radius plus the threshold. Not to all: two fingerprints at two differing bits have a point between
them, at most one bit from either, and they meet at the anchor that covers this point. So the anchors that
cover some point within one bit of a fingerprint are enough, and no link is lost. Fingerprints are compared
anchor by anchor.

Anchors with many fingerprints go over to the finest covering code, the whole cube with radius 0. There a
fingerprint has 65 anchors (itself and its neighbours), an anchor has at most 65 fingerprints, and all of
them are linked, so no group is large and nothing is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, attach, fold_case, let, materialize, shingles_of, words_of

BITS, WORDS, THRESHOLD = 64, 3, 2
#: Fingerprints that are compared with each other in one go (4 M comparisons); larger anchors use the finest code.
MOST_AT_ANCHOR = 2048
CHUNK = 200_000


def _majorities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id and hashes in, doc_id and fingerprint out; memory is bounded by CHUNK hashes at a time."""
    for batch in batches:
        column = batch.column("hashes")
        offsets = column.offsets.to_numpy().astype(np.int64)
        base, offsets = offsets[0], offsets - offsets[0]
        hashes = column.values.to_numpy(zero_copy_only=False)[base : base + offsets[-1]].view(np.uint64)
        counts = np.zeros((len(column), BITS), dtype=np.int32)
        for low in range(0, len(hashes), CHUNK):
            part = hashes[low : low + CHUNK]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            first = int(np.searchsorted(offsets, low, side="right")) - 1
            last = int(np.searchsorted(offsets, low + len(part), side="left"))
            at = np.maximum(offsets[first:last] - low, 0)
            full = np.append(at[1:], len(part)) > at  # documents with a hash in this part
            counts[first:last][full] += np.add.reduceat(bits, at[full], axis=0, dtype=np.int32)
        over = counts * 2 > np.diff(offsets)[:, None]
        fingerprint = np.packbits(over, axis=1).view(">u8").astype(np.uint64).view(np.int64).reshape(-1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprint, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: bit b of fp is set if it is set in over half the XXH64 hashes of the three-word shingles.

    Shingles count with repeats; fewer than three words are one shingle; no words give 0.
    """

    def hashes(words: Column) -> Column:
        short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.coalesce(shingles_of(words, WORDS, lambda ws: F.xxhash64(F.concat_ws(" ", *ws))), short)

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), let(words_of(fold_case(F.col(text_col))), hashes).alias("hashes"))
    return cut.mapInArrow(_majorities, "doc_id long, fp long")


def stretches(n: int) -> list[tuple[int, int]]:
    """(first bit, length) of n stretches of the 64 bits."""
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def anchors_of(fp: Column, n: int) -> Column:
    """The anchors that cover a point within one bit of the fingerprint, as n-bit numbers: its own first."""
    home, near = F.lit(0).cast("long"), []
    for i, (first, length) in enumerate(stretches(n)):
        ones = F.bit_count(F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << length) - 1)))
        home = home + F.when(ones * 2 > length, F.lit(1 << i)).otherwise(0)
        turns = ((ones * 2 <= length) & ((ones + 1) * 2 > length)) | ((ones * 2 > length) & ((ones - 1) * 2 <= length))
        near.append(F.when(turns, F.lit(1 << i).cast("long")))
    flips = F.filter(F.array(F.lit(0).cast("long"), *near), lambda x: x.isNotNull())
    return F.struct(home.alias("home"), flips.alias("flips"))


def _link(fps: np.ndarray) -> np.ndarray:
    """For each fingerprint of one anchor the least one that it is linked with, through others if need be."""
    linked = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= THRESHOLD
    if linked.sum() == len(fps):
        return np.arange(len(fps))
    label = np.arange(len(fps))
    while True:
        lower = np.where(linked, label[None, :], len(fps)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            return label
        label = lower


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor in; (a, b) links out, as a star around the least of those linked at an anchor.

    Of an anchor with over ``most`` fingerprints no more than that is ever held: its fingerprints come
    out as (a, null), to be linked by the finest code.
    """
    anchor, held, over = None, [], False

    def done() -> tuple[list[int], list[int | None]]:
        if over or len(held) < 2:
            return [], []
        fps = np.unique(np.array(held, dtype=np.int64))
        label = _link(fps.view(np.uint64))
        moved = np.flatnonzero(label != np.arange(len(fps)))
        return fps[moved].tolist(), fps[label[moved]].tolist()

    def out(a: list[int], b: list[int | None]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    for batch in batches:
        keys, fps = batch.column("anchor").to_numpy(), batch.column("fp").to_numpy()
        if not len(keys):
            continue
        a: list[int] = []
        b: list[int | None] = []
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if keys[low] != anchor:
                x, y = done()
                a += x
                b += y
                anchor, held, over = keys[low], [], False
            held += fps[low:high].tolist()
            if over or len(held) > most:
                over = True
                a += held
                b += [None] * len(held)
                held = []
        yield out(a, b)
    yield out(*done())


def links(distinct: DataFrame, n_distinct: int, most: int = MOST_AT_ANCHOR) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that connect all at THRESHOLD or fewer differing bits.

    Anchors with over ``most`` fingerprints go over to the finest code.
    """
    n = min(32, max(8, n_distinct.bit_length()))
    found = distinct.select("fp", anchors_of(F.col("fp"), n).alias("c"))
    spread = found.select("fp", F.explode(F.transform("c.flips", lambda x: F.col("c.home").bitwiseXOR(x))).alias("anchor"))
    spread = materialize(spread, "anchors")
    # Anchors with over 1/HOT_SHARE of all replicas, so fewer than HOT_SHARE of them, do not even meet.
    hot = F.broadcast(spread.groupBy("anchor").count().filter(F.col("count") > max(most, spread.count() // HOT_SHARE)).select("anchor"))
    met = spread.join(hot, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(lambda batches: _compare(batches, most), "a long, b long")
    met = materialize(met, "met")
    dense = spread.join(hot, "anchor", "left_semi").select("fp").unionByName(met.filter("b IS NULL").select(F.col("a").alias("fp"))).distinct()
    cube = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long")) for i in range(BITS)])
    cells = dense.select("fp", F.explode(cube).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = cells.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a <> b")
    return met.filter("b IS NOT NULL").unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node that each node of an edge reaches; least neighbours, then pointer jumps, until nothing moves."""
    both = materialize(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    n_nodes = labels.count()
    while True:
        over = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(over, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        step = materialize(step, "steps")  # a large component has one label: its rows do not meet
        jump = step.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), "label")
        step = materialize(attach(step, jump, "label", "n", n_nodes).select("node", "was", F.least("label", "far").alias("label")), "labels")
        labels = step.select("node", "label")
        if step.filter("label <> was").isEmpty():
            return labels


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (least doc_id reachable over links).

    Null and blank texts have fingerprint zero and are linked like others. Repeated rows are in one
    component; a null id never names one unless all its ids are null. Other columns are ignored; an empty
    table gives an empty result.
    """
    slim = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    n_rows = slim.count()
    distinct = materialize(slim.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    n_distinct = distinct.count()
    labels = components(links(distinct.select("fp"), n_distinct))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    comps = named.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_fp"))
    named = attach(named, comps, "label", "n_fp", n_distinct).select("fp", "n", "component_id")
    out = attach(slim, named, "fp", "n", n_rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
