"""Minimax contiguous sharding.

Groups of equal texts are atomic and ordered by the SHA-256 of their text. Its leading bits gather the groups
into at most 2^16 ordered cells, a table of bounded size whatever the input. The smallest shard capacity that
eight (or n) contiguous shards can do with is found by binary search with a greedy check; cells in which a cut
may fall are taken apart into smaller ones, level by level, until none of these holds two groups, so that the
result is that of a search over all groups. The order is cut there. Rows are then numbered inside shards
without any shard passing through one task.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Bits of the order that are used, those that tell the first cells apart, and those that each further level adds.
KEY_BITS, CELL_BITS, LEVEL_BITS = 60, 16, 8
#: Rows that are numbered together; cells with more are dealt by a hash of the document id. At most 2^20 units more come of it.
UNIT_ROWS, MOST_UNITS = 500, 1 << 20
FILE_ROWS = 100_000


def _reach(ends: np.ndarray, start: int, capacity: int) -> int:
    """How far a shard that begins after ``start`` cells gets within the capacity."""
    filled = ends[start - 1] if start else 0
    return int(np.searchsorted(ends, filled + capacity, side="right"))


def fits(ends: np.ndarray, shards: int, capacity: int) -> bool:
    at = 0
    for _ in range(shards):
        at = _reach(ends, at, capacity)
    return at >= len(ends)


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[list[int], int]:
    """Cell index at which each shard begins, and the smallest feasible capacity.

    Inside that capacity cuts are set as near to even shares as they can be, so that a huge atomic group does
    not leave the last shards empty.
    """
    if not len(sizes):
        return [0] * shards, 0
    ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
    total = int(ends[-1])
    low, high = max(int(np.max(sizes)), -(-total // shards)), total
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(ends, shards, mid) else (mid + 1, high)
    earliest = [len(sizes)] * (shards + 1)  # the least cell from which the shards j, j+1, ... can hold the rest
    for j in range(shards - 1, -1, -1):
        top = int(ends[earliest[j + 1] - 1]) if earliest[j + 1] else 0
        earliest[j] = int(np.searchsorted(np.concatenate([[0], ends]), top - low, side="left")) if top > low else 0
    cuts = [0]
    for j in range(1, shards):
        even = total * j / shards
        near = int(np.searchsorted(ends, even))
        before = int(ends[near - 1]) if near else 0
        near += int(near < len(ends) and abs(int(ends[near]) - even) < abs(before - even))
        cuts.append(max(cuts[-1], min(max(near, earliest[j]), _reach(ends, cuts[-1], low))))
    return cuts, low


def _walk(ends: np.ndarray, start: np.ndarray, atomic: np.ndarray, shards: int, capacity: int, whole: bool) -> np.ndarray:
    """Bytes up to which 1, 2, … shards get, filled one after another; with ``whole`` no cell is cut, else any that holds several groups."""
    out, at = [], 0
    for _ in range(shards):
        aim = at + capacity
        k = int(np.searchsorted(ends, aim, side="right"))  # the first cell that does not fit
        if k == len(ends):
            at = int(ends[-1])
        elif whole or atomic[k]:
            at = int(start[k])
        else:
            at = aim
        out.append(at)
    return np.array(out)


def unclear_cells(sizes: np.ndarray, atomic: np.ndarray, shards: int) -> np.ndarray:
    """Cells of several groups in which some cut may fall, whatever their groups are; none if the capacity is settled."""
    ends = np.cumsum(sizes)
    start, total = ends - sizes, int(ends[-1])
    _, high = minimax_cuts(sizes, shards)  # no cell cut: this capacity is enough
    low, most = max(-(-total // shards), int(sizes[atomic].max(initial=1))), high
    while low < most:  # cells cut anywhere: less than this is never enough
        mid = (low + most) // 2
        low, most = (low, mid) if _walk(ends, start, atomic, shards, mid, False)[-1] >= total else (mid + 1, most)
    if low == high:
        return np.array([], dtype=np.int64)
    least, far = _walk(ends, start, atomic, shards, low, True), _walk(ends, start, atomic, shards, high, False)
    open_ = np.zeros(len(sizes), dtype=bool)
    for a, b in zip(least, far, strict=True):
        open_ |= (start < b) & (ends > a)
    return np.flatnonzero(open_ & ~atomic)


def cells_of(slim: DataFrame, shards: int) -> list[tuple[int, int, int, int]]:
    """(first key, bits, bytes, rows) of ordered cells; those where cuts may fall are single groups."""
    table = []

    def put(rows: DataFrame, bits: int) -> None:
        cell = F.shiftright("key", KEY_BITS - bits).alias("cell")
        found = rows.groupBy(cell).agg(F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key")).collect()
        table.extend((int(r[0]) << (KEY_BITS - bits), bits, int(r[1]), int(r[2]), r[3] == r[4]) for r in found)
        table.sort()

    put(slim, CELL_BITS)  # at most 2^CELL_BITS rows
    while table:
        bad = unclear_cells(np.array([t[2] for t in table], dtype=np.int64), np.array([t[4] for t in table]), shards)
        if not len(bad):
            break
        bits = min(table[i][1] for i in bad)  # a few cells for each cut, each taken apart into at most 2^LEVEL_BITS
        apart = [table[i] for i in bad if table[i][1] == bits]
        table = [t for t in table if t not in set(apart)]
        put(slim.filter(F.shiftright("key", KEY_BITS - bits).isin([t[0] >> (KEY_BITS - bits) for t in apart])), min(KEY_BITS, bits + LEVEL_BITS))
    return [t[:4] for t in table]


def shard_rows(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``.

    The law is ``bytes``: sizes (UTF-8 bytes plus one; null has none) are near equal. Equal texts share a
    shard, null counts as empty there and in the checksum. Repeated rows get slots of their own; null ids
    sort first. Other columns are ignored; an empty table gives an empty result. The same rows give the same
    shards whatever their order.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("sha"))
    slim = materialize(slim.withColumn("key", F.conv(F.substring("sha", 1, KEY_BITS // 4), 16, 10).cast("long")), "sizes")
    table = cells_of(slim, shards)
    cuts, _ = minimax_cuts(np.array([t[2] for t in table], dtype=np.int64), shards)
    shard = sum((F.when(F.col("key") >= table[c][0] if c < len(table) else F.lit(False), 1).otherwise(0) for c in cuts[1:]), F.lit(0))
    rows: dict[int, int] = {}
    for first, _, _, n in table:
        cell = first >> (KEY_BITS - CELL_BITS)
        rows[cell] = rows.get(cell, 0) + n
    unit = max(UNIT_ROWS, sum(rows.values()) // MOST_UNITS)
    plan = docs.sparkSession.createDataFrame([(cell, -(-n // unit)) for cell, n in rows.items()], "cell int, parts int")
    dealt = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("row_id")))  # many null ids are not one part
    units = slim.withColumn("cell", F.shiftright("key", KEY_BITS - CELL_BITS).cast("int")).join(F.broadcast(plan), "cell")
    units = units.withColumn("shard", shard).withColumn("part", F.pmod(dealt, F.col("parts")).cast("int"))
    counts = units.groupBy("shard", "cell", "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("cell", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "cell", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("shard", "cell", "part").orderBy("sha", "doc_id"))
    return units.join(counts, ["shard", "cell", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("ahead") + inside - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The documents as Parquet, one folder a shard, rows of a file in slot order. Ids must be unique and not null."""
    put = shard_rows(docs, shards, id_col, text_col).select(F.col("doc_id").alias(id_col), "shard", "slot")
    docs.drop("shard", "slot").join(put, id_col).repartition("shard", F.floor(F.col("slot") / FILE_ROWS)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
