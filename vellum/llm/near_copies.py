"""Near copies by exact Jaccard similarity of word shingles; SimHash and MinHash bands find the candidates.

SimHash alone cannot find them all: at a similarity of 0.8 fingerprints of 64 bits differ in about ten bits, give or take
three, and within a radius that holds nearly all such pairs there are ever more pairs of unrelated texts.

1. Texts with the same set of shingles are one node.
2. A node has BANDS keys of ROWS minima each. Two nodes at similarity s share a key with probability
   1 - (1 - s^ROWS)^BANDS: 0.9999 at 0.8. Those that share a key are candidates.
   Beside these a node has the component of its SimHash as a key: what `simhash` links is compared too.
3. Keys with the same nodes count once. All candidates of a key are compared by their sets; a key with more
   than a block of them is dealt out as pairs of blocks, so that no key is large and no pair is left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, fold_case, let, materialize, shingles_of, words_of
from .simhash import components, simhash_groups

WORDS, THRESHOLD = 5, 0.8
ROWS, BANDS, SEED = 5, 24, 23
#: A block of candidates has about so many nodes, and shingles, at most.
BLOCK_NODES, BLOCK_SHINGLES = 256, 2_000_000
#: Shingles that are counted in one go when the nodes of a block are compared.
SLAB = 8192


def shingle_hashes(text: Column, k: int) -> Column:
    """XXH64 of each run of k words, with repeats; fewer words are one shingle; no words, or a null text, have none."""

    def hashes(words: Column) -> Column:
        short = F.when(F.size(words) > 0, F.array(F.xxhash64(F.array_join(words, " ")))).otherwise(F.array().cast("array<bigint>"))
        return F.coalesce(shingles_of(words, k, lambda ws: F.xxhash64(F.concat_ws(" ", *ws))), short)

    return let(words_of(fold_case(text)), hashes)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists as unsigned numbers, and the offsets of the lists."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].view(np.uint64)
    return values, offsets - offsets[0]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row_id and hashes in; out row_id, a digest of the set of hashes, their number, and the keys of the bands (none for an empty set)."""
    rng = np.random.default_rng(SEED)
    turn = rng.integers(0, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64)
    turn[:, 0] = turn[:, 0] * np.uint64(2) + np.uint64(1)
    step = np.uint64(0x9E3779B97F4A7C15)
    for batch in batches:
        values, offsets = _lists(batch.column("hashes"))
        sets = [np.unique(values[a:b]) for a, b in zip(offsets, offsets[1:], strict=False)]
        full = np.flatnonzero(np.diff(offsets))
        keys = np.zeros((len(full), BANDS), dtype=np.uint64)
        for i in range(BANDS * ROWS if len(full) else 0):
            least = np.minimum.reduceat(values * turn[i, 0] + turn[i, 1], offsets[:-1][full])
            own = (keys[:, i // ROWS] + np.uint64(i + 1)) * step
            keys[:, i // ROWS] = own ^ (own >> np.uint64(29)) ^ least
        has = np.zeros(len(sets), dtype=np.int32)
        has[full] = BANDS
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(has)), pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
        digests = pa.array([hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), digests, pa.array([len(x) for x in sets], pa.int64()), lists], ["row_id", "digest", "size", "keys"])


def _links(nodes: list[int], sets: list[np.ndarray], threshold: float) -> tuple[list[int], list[int]]:
    """Links (a, b) of nodes whose sets are alike, as a star around the least of those linked, through others if need be."""
    order = np.argsort(nodes)
    nodes = np.array(nodes, dtype=np.int64)[order]
    sets = [sets[i] for i in order]
    size = np.array([len(x) for x in sets], dtype=np.int64)
    owner = np.repeat(np.arange(len(sets)), size)
    _, code, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often > 1  # the others are in no intersection
    place = np.cumsum(shared) - 1
    owner, at = owner[shared[code]], place[code[shared[code]]]
    by = np.argsort(at, kind="stable")
    owner, at = owner[by], at[by]
    both = np.zeros((len(sets), len(sets)))
    for low in range(0, int(shared.sum()), SLAB):
        a, b = np.searchsorted(at, [low, low + SLAB])
        there = np.zeros((len(sets), SLAB), dtype=np.float32)
        there[owner[a:b], at[a:b] - low] = 1
        both += there @ there.T
    linked = both / (size[:, None] + size[None, :] - both) >= threshold
    np.fill_diagonal(linked, True)
    label = np.arange(len(sets))
    while True:
        lower = np.where(linked, label[None, :], len(sets)).min(axis=1)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    moved = np.flatnonzero(label != np.arange(len(sets)))
    return nodes[moved].tolist(), nodes[label[moved]].tolist()


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (key, low, high) in, links out; the sets of one pair of blocks are held."""
        own: tuple | None = None
        nodes: list[int] = []
        sets: list[np.ndarray] = []
        for batch in batches:
            values, offsets = _lists(batch.column("hashes"))
            a: list[int] = []
            b: list[int] = []
            for i, (*key, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "node")), strict=True)):
                if key != own:
                    if len(nodes) > 1:
                        x, y = _links(nodes, sets, threshold)
                        a += x
                        b += y
                    own, nodes, sets = key, [], []
                nodes.append(node)
                sets.append(values[offsets[i] : offsets[i + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if len(nodes) > 1:
            a, b = _links(nodes, sets, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def row_groups(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """One row a row: ``row_id, group_id``. Rows are in one group if steps of ``threshold`` or more in Jaccard similarity lead from one to the other.

    ``id_col`` is a stored integer that no two rows share. A-Z are lower-cased, words are runs free of white
    space, shingles are ``words`` words and count once; fewer words are one shingle. Null, empty and blank texts
    are equal. ``group_id`` is the least row id of a group. An empty table gives an empty result.
    """
    texts = rows.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))
    hashes = texts.select("row_id", shingle_hashes(F.col("text"), words).alias("hashes"))
    told = materialize(hashes.mapInArrow(_features, "row_id long, digest binary, size long, keys array<long>"), "features")
    named = materialize(told.groupBy("digest").agg(F.min("row_id").alias("node"), F.count(F.lit(1)).alias("n")), "nodes")
    spread = told.join(named.select("node"), F.col("row_id") == F.col("node"), "left_semi").select(F.col("row_id").alias("node"), "size", F.explode("keys").alias("key"))
    nodes_of = told.filter("size > 0").join(named.select("node"), F.col("row_id") == F.col("node"), "left_semi").select(F.col("row_id").alias("node"), "size")
    near = simhash_groups(texts, "row_id").select(F.col("doc_id").alias("node"), F.xxhash64("component_id", F.lit("simhash")).alias("key"))
    spread = materialize(spread.unionByName(near.join(nodes_of, "node").select("node", "size", "key")), "keys")
    sums = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"sum{i}") for i in range(2)]
    met = spread.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.sum("size").alias("total"), *sums).filter("members > 1")
    met = met.groupBy("members", "total", "sum0", "sum1").agg(F.min("key").alias("key"))
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK_NODES), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("long")
    met = materialize(met.select("key", "members", blocks.alias("blocks")), "met")
    found = attach(spread.select("node", "key"), met, "key", "members", spread.count()).filter("blocks IS NOT NULL")
    found = found.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks"))).select("node", "key", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    found = materialize(found.select("node", "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")), "candidates")
    needed = materialize(found.select(F.col("node").alias("row_id")).distinct(), "needed")
    sets = texts.join(needed, "row_id", "left_semi").select(F.col("row_id").alias("node"), F.array_distinct(shingle_hashes(F.col("text"), words)).alias("hashes"))
    dealt = found.join(materialize(sets, "sets"), "node").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    labels = components(materialize(dealt.mapInArrow(_compare(threshold), "a long, b long").distinct(), "links"))
    nodes = named.join(labels, "node", "left").select("digest", "n", F.coalesce("label", "node").alias("group_id"))
    return attach(told.select("row_id", "digest"), nodes, "digest", "n", told.count()).select("row_id", "group_id")
