"""Phrase collocation mining: best-first branch and bound over a tree of prefixes, in jobs over encoded texts.

A phrase of two or three words scores by its weakest cut, a * a / (l * r). The count of its first word bounds
what grows from there: every phrase that begins with the words v w scores at most f(v w) / f(v), because its first
cut has a right part at least as frequent as the phrase. Steps, each a Spark job over the whole table:

1. Texts become chunks of one language: distinct words with counts, and the texts as indexes into these.
2. Words are counted over all chunks. Rare ones can be in no candidate; chunks keep the others alone.
3. Pairs of words are counted. Those that are frequent are candidates, and nodes of the tree with a bound.
4. The frontier of each language is expanded from the best bound on, down to a level: triples below open nodes,
   and around candidate pairs that a longer phrase may replace, are counted, scored, and settle what survives. A
   level that leaves fewer survivors than are asked for is lowered, and the search goes on. Once the last one asked
   for scores at least the level, no closed node can hold a phrase as good, ties included.

Which nodes are open is told to the tasks by bitmaps of a bounded size: a slot that two nodes share counts triples
that need not be, and never leaves one out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A phrase is a candidate from so many occurrences on, and gives way to a longer one with at least so many percent of them.
LEAST, COVERED = 10, 50
#: Scores are rounded down to this part of one.
UNIT = 1_000_000
CHUNK_BYTES = 12_000_000
#: A first level lets in so many times the phrases asked for, each further one LOWER times as many.
FIRST, LOWER = 2, 8
#: Bits a node in a bitmap, and the fewest and most that one has (the most are 32 MB).
BITS_A_NODE, LEAST_BITS, MOST_BITS = 16, 1 << 18, 1 << 28
#: Mixes two word ids into a slot without passing 64 bits: a modulus with no relation to the ids' own steps, and a factor.
MODULUS, FACTOR = 1_500_000_001, 1_000_003
#: Bytes that end a piece become a full stop, tabs blanks, A to Z lower case. No word has a full stop in it.
FOLD = bytes.maketrans(b",;:!?\n\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"......... abcdefghijklmnopqrstuvwxyz")
CHUNK = "chunk long, lang string, words array<binary>, counts array<long>, codes binary"


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def encode(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some texts, and the texts as indexes into them; -1 ends a piece, and nothing runs on into the next text."""
    joined = b".".join(texts).translate(FOLD).replace(b".", b" . ")
    split = pc.split_pattern(pa.array([joined], pa.large_binary()), b" ").flatten()
    told = split.filter(pc.greater(pc.binary_length(split), 0)).dictionary_encode()
    words, codes = told.dictionary, told.indices.to_numpy().astype(np.int32)
    stop = pc.index(words, pa.scalar(b".", words.type)).as_py()
    if stop >= 0:
        keep = np.arange(len(words)) != stop
        to = np.where(keep, np.cumsum(keep) - 1, -1).astype(np.int32)
        words, codes = words.filter(pa.array(keep)), to[codes]
    return words.cast(pa.binary()), codes


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, (chunk, texts) in held.items():
            words, codes = encode(texts)
            counts = np.bincount(codes[codes >= 0], minlength=len(words)).astype(np.int64)
            columns = {"chunk": pa.array([chunk], pa.int64()), "lang": pa.array([lang]), "words": _one(words), "counts": _one(pa.array(counts)), "codes": pa.array([codes.tobytes()], pa.binary())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    held: dict[str, list] = {}
    room = CHUNK_BYTES
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for row, lang, text in zip(batch.column("row_id").to_pylist(), batch.column("lang").to_pylist(), texts, strict=True):
            text = text.as_py()
            held.setdefault(lang, [row, []])[1].append(text)
            room -= len(text) + 1
            if room <= 0:
                yield from flush(held)
                held, room = {}, CHUNK_BYTES
    yield from flush(held)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with nothing but frequent words: ``codes`` index ``ids``, and all else ends a piece."""
    for batch in batches:
        for row in batch.to_pylist():
            codes, told = np.frombuffer(row["codes"], np.int32), row["told"]
            place, ids = (np.array([t[k] for t in told], np.int64) for k in ("place", "id"))
            to = np.full(int(max(codes.max(initial=-1), place.max(initial=-1))) + 2, -1, np.int32)
            to[place] = np.arange(len(place))
            codes = to[codes]  # -1, the end of a piece, reads the last entry
            gap = codes < 0
            codes = codes[~(gap & np.append(True, gap[:-1]))] if len(codes) else codes  # runs of gaps are one
            yield pa.RecordBatch.from_arrays([pa.array([codes.tobytes()], pa.binary()), _one(pa.array(ids))], ["codes", "ids"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for codes, ids in zip(batch.column("codes"), batch.column("ids"), strict=True):
            yield np.frombuffer(codes.as_py(), np.int32).astype(np.int64), ids.values.to_numpy()


def _counted(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], [*[f"w{k}" for k in range(1, len(columns))], "n"])


def _pairs_in(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places where a pair begins, the distinct pairs (first * width + second), the pair at each place, and how often each is there."""
    at = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0))
    pairs, kind, often = np.unique(codes[at] * width + codes[at + 1], return_inverse=True, return_counts=True)
    return at, pairs, kind, often


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for codes, ids in _runs(batches):
        _, pairs, _, often = _pairs_in(codes, len(ids) + 1)
        yield _counted(ids[pairs // (len(ids) + 1)], ids[pairs % (len(ids) + 1)], often)


def _slot(first, second, bits: int):
    """The same rule for columns and for arrays."""
    if isinstance(first, Column):
        return F.pmod(F.pmod(first, F.lit(MODULUS)) * FACTOR + F.pmod(second, F.lit(MODULUS)), F.lit(bits))
    return (first % MODULUS * FACTOR + second % MODULUS) % bits


def _bitmap(nodes: DataFrame) -> np.ndarray:
    """The slots of ``nodes`` (w1, w2) as bytes of bits; 32 MB at most reach the driver."""
    bits, n = LEAST_BITS, nodes.count()
    while bits < min(MOST_BITS, BITS_A_NODE * n):
        bits *= 2
    slot = _slot(F.col("w1"), F.col("w2"), bits) + 1
    rows = nodes.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"))
    out = np.zeros((bits // 32768, 4096), np.uint8)
    for bucket, some in rows.toLocalIterator():
        out[bucket - 1] = np.frombuffer(some, np.uint8)
    return out.reshape(-1)


def _has(bitmap: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    slot = _slot(first, second, 8 * len(bitmap))
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _triples(filters):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, open_, pending = filters.value
        for codes, ids in _runs(batches):
            width = len(ids) + 1
            at, pairs, kind, _ = _pairs_in(codes, width)
            first, second = ids[pairs // width], ids[pairs % width]
            often, grows, asked = (_has(x, first, second) for x in (frequent, open_, pending))
            here = np.flatnonzero(np.diff(at) == 1)  # a pair, and the next begins at its second word
            a, b = kind[here], kind[here + 1]
            wanted = often[a] & often[b] & (grows[a] | asked[b])
            a, b = a[wanted], b[wanted]
            found, n = np.unique(a * width + codes[at[here + 1] + 1][wanted], return_counts=True)
            yield _counted(first[found // width], second[found // width], ids[found % width], n)

    return count


def _wide(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(15,0)")


def _score(a: str, left: str, right: str) -> Column:
    """floor(UNIT * a * a / (left * right)), exact for counts of up to 15 digits."""
    up = _wide(a) * _wide(a) * F.lit(UNIT).cast("decimal(7,0)")
    return F.call_function("div", up, _wide(left) * _wide(right))


def _levels(scored: DataFrame, asked: int) -> DataFrame:
    """(lang, level): the score of the ``asked``-th best row of each language, 0 if there are fewer. Scores are whole, so a language has at most UNIT + 1 counts."""
    often = scored.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("k"))
    upto = often.withColumn("upto", F.sum("k").over(Window.partitionBy("lang").orderBy(F.col("score").desc())))
    return upto.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("upto") >= asked, F.col("score"))), F.lit(0).cast("long")).alias("level"))


def mine_phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = 2000, least: int = LEAST) -> DataFrame:
    """The best ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and these into words at blanks and tabs.
    A phrase is two or three words within a piece that are there ``least`` times or more. It scores by the lowest of
    its cuts, of like ones the first; one inside a longer phrase that has at least half of its occurrences drops.
    Ties of score go by count, then by the bytes of the phrase. A null language is ``und``, a null text empty;
    repeated rows count each; other columns are ignored, and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    chunks = materialize(rows.mapInArrow(_chunks, CHUNK), "chunks")
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("chunk", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("f"))
    counted = materialize(words.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    totals = materialize(counted.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    frequent = materialize(counted.filter(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "frequent")

    told = words.select("chunk", "lang", "place", "word").join(frequent.select("lang", "word", "id"), ["lang", "word"])
    told = told.groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("told"))  # no more than a chunk has words
    texts = materialize(chunks.select("chunk", "codes").join(told, "chunk").select("codes", "told").mapInArrow(_kept, "codes binary, ids array<long>"), "texts")

    pairs = texts.mapInArrow(_pairs, "w1 long, w2 long, n long").groupBy("w1", "w2").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
    for k in (1, 2):
        pairs = pairs.join(frequent.select(F.col("id").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *["lang"] * (k == 1)), f"w{k}")
    bound = F.call_function("div", _wide("a") * F.lit(UNIT).cast("decimal(7,0)"), _wide("f1"))
    pairs = materialize(pairs.withColumn("score", _score("a", "f1", "f2")).withColumn("bound", bound), "pairs")
    often = _bitmap(pairs)

    def expand(levels: DataFrame) -> DataFrame:
        """All surviving phrases that score their language's level or more."""
        at = materialize(pairs.join(levels, "lang"), "nodes")
        good = at.filter("score >= level")
        shared = spark.sparkContext.broadcast((often, _bitmap(at.filter("bound >= level")), _bitmap(good)))
        found = texts.mapInArrow(_triples(shared), "w1 long, w2 long, w3 long, n long").groupBy("w1", "w2", "w3").agg(F.sum("n").alias("a")).filter(F.col("a") >= least)
        first = at.select("w1", "w2", "lang", "level", "f1", F.col("a").alias("f12"))
        second = at.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f2").alias("f3"), F.col("a").alias("f23"))
        triples = found.join(first, ["w1", "w2"]).join(second, ["w2", "w3"])
        triples = materialize(triples.withColumn("early", _score("a", "f1", "f23")).withColumn("late", _score("a", "f12", "f3")), "triples")
        inside = F.explode(F.array(*[F.struct(F.col(x).alias("w1"), F.col(y).alias("w2"), F.col("a").alias("longer")) for x, y in (("w1", "w2"), ("w2", "w3"))]))
        longest = triples.select(inside.alias("p")).select("p.*").groupBy("w1", "w2").agg(F.max("longer").alias("longer"))
        keep = good.join(longest, ["w1", "w2"], "left").filter((F.col("longer") * 100 < F.col("a") * COVERED) | F.col("longer").isNull())
        two = keep.select("lang", "w1", "w2", F.lit(None).cast("long").alias("w3"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
        late = F.col("late") < F.col("early")
        three = triples.select("lang", "level", "w1", "w2", "w3", "a", F.when(late, F.col("f12")).otherwise(F.col("f1")).alias("l"), F.when(late, F.col("f3")).otherwise(F.col("f23")).alias("r"), F.least("early", "late").alias("score"))
        return materialize(two.unionByName(three.filter("score >= level").drop("level")), "settled")

    asked = FIRST * top
    levels = materialize(_levels(pairs, asked), "levels")
    while True:
        settled = expand(levels)
        have = settled.groupBy("lang").agg(F.count(F.lit(1)).alias("have"))
        short = levels.join(have, "lang", "left").select("lang", "level", (F.coalesce("have", F.lit(0)) < top).alias("short"))
        if short.filter("short AND level > 0").isEmpty():
            break
        asked *= LOWER
        lower = _levels(pairs, asked).withColumnRenamed("level", "lower")
        levels = materialize(short.join(lower, "lang").select("lang", F.when(F.col("short"), F.col("lower")).otherwise(F.col("level")).alias("level")), "levels")

    best = settled.join(_levels(settled, top), "lang").filter("score >= level").drop("level")
    for k in (1, 2, 3):
        best = best.join(frequent.select(F.col("id").alias(f"w{k}"), F.col("word").cast("string").alias(f"word{k}")), f"w{k}", "left")
    best = best.join(totals, "lang").select("lang", F.concat_ws(" ", "word1", "word2", "word3").alias("phrase"), "a", "l", "r", "n", "score")
    order = [F.col("score").desc(), F.col("a").desc(), "phrase"]
    # many may tie with the last: each of a number of parts first keeps its own best
    part = best.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top).drop("part", "rank")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return part.withColumn("rank", rank).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
