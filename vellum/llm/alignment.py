"""Alignment of the tokens of two tokenizers over a corpus, by byte offsets.

A is a byte-level vocabulary of the tokenizers library, B a sentencepiece model with byte fallback. The spans that
the libraries report are coarse cuts: A's are in characters, so the tokens of one multibyte character share a span,
and B's byte-fallback tokens have empty ones but for the last. Within such places tokens are cut by the bytes that
they decode to. Steps, each a Spark job over the whole table:

1. Texts are encoded by units (`units.py`), each distinct one once. A chunk of documents keeps its documents as units,
   the links of its units, and how often each pair of ids is linked in it.
2. Links are counted by pair of ids over all chunks, and the highest count of each B id.
3. Chunks meet the counts of their pairs again, a chunk at a time, and documents sum them up.

Whatever the size of the table, a task holds one slice of texts, the units that recur, and a chunk or two: chunks are
some megabytes each, so neither a batch, nor a row group, nor an aggregate may gather many of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import byte_of
from .common import materialize, tokenizer_path
from .units import Pool, Units, slices

TOKENIZER_A, TOKENIZER_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 8_000_000
#: With more units than this, or more bytes of them, a task forgets all but those that recurred, the most frequent so many, before its next slice.
MOST_KNOWN, KNOWN_BYTES, MOST_KEPT, KEPT_BYTES = 150_000, 16_000_000, 100_000, 4_000_000
#: Chunks in a row group: readers and writers hold a row group in memory.
CHUNKS_A_GROUP = 4
#: So many units go through the libraries at a time, as one text: no token reaches across them.
UNITS_AT_A_TIME = 1000
MARK = "▁"
CHUNK = """chunk long, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>,
    codes binary, lengths binary, links binary, sizes binary, a array<int>, b array<int>, often array<long>"""


class Tokenizers:
    """Both tokenizers, and their pieces as bytes."""

    made: dict[int, Tokenizers] = {}

    def __init__(self, a: str, b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True  # their strings in a text are ordinary text
        self.a.no_truncation()
        self.a.no_padding()
        byte = byte_of()
        self.pieces_a = [b""] * (self.a.get_vocab_size() + 1)
        for piece, i in self.a.get_vocab().items():
            self.pieces_a[i] = bytes(byte.get(c, 63) for c in piece)
        self.b = SentencePieceProcessor(model_proto=b)
        n = range(self.b.get_piece_size())
        text = [self.b.id_to_piece(i) for i in n]
        if any(MARK in t.lstrip(MARK) for t in text):
            raise ValueError("a piece reaches across a blank")
        self.pieces_b = [bytes([int(t[3:5], 16)]) if self.b.is_byte(i) else t.replace(MARK, " ").encode() for i, t in zip(n, text, strict=True)]
        self.blank = self.b.piece_to_id(MARK)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.pieces_a, self.pieces_b))
        self.digits = [b"%d" % i for i in range(max(len(self.pieces_a), len(self.pieces_b)))]
        self.is_byte = np.array([self.b.is_byte(i) for i in n], bool)

    @classmethod
    def of(cls, key: int, a: str, b: bytes) -> Tokenizers:
        if key not in cls.made:
            cls.made[key] = cls(a, b)
        return cls.made[key]

    def bytes_a(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces_a.__getitem__, ids.tolist()))

    def bytes_b(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces_b.__getitem__, ids.tolist()))

    def tokens_a(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends of the tokens of one text."""
        told = self.a.encode(text, add_special_tokens=False)
        ids = np.array(told.ids, np.int64)
        spans = np.fromiter(chain.from_iterable(told.offsets), np.int64, 2 * len(ids)).reshape(-1, 2)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        coarse = np.append(0, np.cumsum(size))[spans[:, 1]]
        # a character that the next token shares is cut by what its tokens decode to
        return ids, refined(coarse, np.append(spans[1:, 0] < spans[:-1, 1], False), self.size_a[ids])

    def tokens_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and byte ends of the tokens of one text that begins with a blank, which is the one that the model adds."""
        if len(text) == 1:  # to the model an empty text has no blank in front
            return np.array([self.blank]), np.array([1])
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        told = np.fromiter(chain.from_iterable((p.id, p.end) for p in pieces), np.int64, 2 * len(pieces)).reshape(-1, 2)
        ids, coarse = told[:, 0], told[:, 1] + 1
        # an empty span is a byte of a character that later tokens end, or the added blank alone
        empty = np.diff(np.append(0, told[:, 1])) == 0
        byte = self.is_byte[ids]
        return ids, refined(coarse, empty | byte & np.append(byte[1:] & empty[1:], False), self.size_b[ids])


def refined(coarse: np.ndarray, inside: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Byte ends: as told, but for tokens inside a character, which end so many bytes after the one before."""
    ends, total = coarse.copy(), np.cumsum(sizes)
    last = np.maximum.accumulate(np.where(inside, -1, np.arange(len(coarse))))  # the last token with a cut of its own
    base = np.where(last >= 0, coarse[last] - total[last], 0)
    ends[inside] = (base + total)[inside]
    return ends


def align(ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs (a << 32 | b) of tokens whose bytes overlap, in order, the byte end of each link, and the ends common to both.

    Between two ends of either sort lies one token of each, and no other stretch has both.
    """
    ends = np.sort(np.concatenate([ends_a, ends_b]), kind="stable")
    twice = np.append(ends[1:] == ends[:-1], False)
    every = ends[~twice]
    return ids_a[np.searchsorted(ends_a, every)] << 32 | ids_b[np.searchsorted(ends_b, every)], every, ends[twice]


class Aligner:
    """Units met so far: tokens, groups and links of each; ``same`` tells whether both tokenizers give back its bytes."""

    def __init__(self, tokenizers: Tokenizers):
        self.t = tokenizers
        self.units, self.links = Units(self._learn), Pool(np.int64)
        self.counts = np.zeros((0, 3), np.int32)  # tokens by A, by B, and groups
        self.text: list[bytes] = []
        self.same: list[bool] = []
        self.often = np.zeros(0, np.int64)  # times met

    def met(self, codes: np.ndarray) -> np.ndarray:
        """How often each unit occurs in a slice."""
        now = np.bincount(codes, minlength=len(self.units.codes))
        self.often = now + np.append(self.often, np.zeros(len(now) - len(self.often), np.int64))
        return now

    def forget(self) -> None:
        """Between two slices: units that recur stay known, the most frequent ones within bounds. Numbers of units change."""
        if len(self.units.codes) <= MOST_KNOWN and self.units.size <= KNOWN_BYTES:
            return
        kept = np.argsort(-self.often, kind="stable")[:MOST_KEPT]
        kept = kept[self.often[kept] > 1]
        kept = np.sort(kept[np.cumsum(self.units.bytes_of()[kept]) <= KEPT_BYTES])
        self.units.keep(kept)
        self.links.keep(kept)
        self.counts, self.often = self.counts[kept], self.often[kept]
        self.text, self.same = ([x[k] for k in kept.tolist()] for x in (self.text, self.same))

    def _learn(self, units: list[bytes]) -> None:
        self.counts = np.concatenate([self.counts, *[self._learn_some(units[k : k + UNITS_AT_A_TIME]) for k in range(0, len(units), UNITS_AT_A_TIME)]])

    def _learn_some(self, units: list[bytes]) -> np.ndarray:
        # a unit that ends in white space, or has the mark of a blank in it, would reach into one put behind it
        odd = [MARK.encode() in u or u[-4:].decode("utf-8", "ignore")[-1:].isspace() for u in units]
        even = [u for u, o in zip(units, odd, strict=True) if not o]
        told = iter(self._together(even) or map(self._alone, even))
        rows = [self._alone(u) if o else next(told) for u, o in zip(units, odd, strict=True)]
        self.links.add(np.concatenate([r[0] for r in rows]), [len(r[0]) for r in rows])
        self.text += [r[1] for r in rows]
        self.same += [r[3] for r in rows]
        return np.array([r[2] for r in rows], np.int32)

    def _alone(self, raw: bytes) -> tuple[np.ndarray, bytes, tuple[int, int, int], bool]:
        """Links, groups and counts of one unit, and whether both tokenizers give back its bytes."""
        text = raw.decode("utf-8", "replace")
        (ids_a, ends_a), (ids_b, ends_b) = self.t.tokens_a(text), self.t.tokens_b(text)
        if not self.t.bytes_a(ids_a) == raw == self.t.bytes_b(ids_b):
            return np.zeros(0, np.int64), b"", (0, 0, 0), False
        links, _, common = align(ids_a, ends_a, ids_b, ends_b)
        return links, b";".join(self._grouped(ids_a, ends_a, ids_b, ends_b, common)), (len(ids_a), len(ids_b), len(common)), True

    def _grouped(self, ids_a: np.ndarray, ends_a: np.ndarray, ids_b: np.ndarray, ends_b: np.ndarray, common: np.ndarray) -> list[bytes]:
        """The ids between common ends, as ``a1,a2|b1``."""
        a, b = (np.searchsorted(x, common, side="right").tolist() for x in (ends_a, ends_b))
        text_a, text_b = (list(map(self.t.digits.__getitem__, x.tolist())) for x in (ids_a, ids_b))
        join = b",".join
        return [join(text_a[p:q]) + b"|" + join(text_b[x:y]) for p, q, x, y in zip([0, *a], a, [0, *b], b, strict=False)]

    def _together(self, units: list[bytes]) -> list[tuple[np.ndarray, bytes, tuple[int, int, int], bool]] | None:
        """The same for many units put behind one another; None if the tokenizers don't give back the whole, or reach across units."""
        if not units:
            return []
        raw = b"".join(units)
        text = raw.decode("utf-8", "replace")
        (ids_a, ends_a), (ids_b, ends_b) = self.t.tokens_a(text), self.t.tokens_b(text)
        if not self.t.bytes_a(ids_a) == raw == self.t.bytes_b(ids_b):
            return None
        links, every, common = align(ids_a, ends_a, ids_b, ends_b)
        at = np.cumsum(list(map(len, units)))
        if (common[np.minimum(np.searchsorted(common, at), len(common) - 1)] != at).any():
            return None
        cuts = [np.searchsorted(x, at, side="right") for x in (every, common, ends_a, ends_b)]
        groups = self._grouped(ids_a, ends_a, ids_b, ends_b, common)
        link, group, n_a, n_b = (np.append(0, c).tolist() for c in cuts)
        return [(links[link[k] : link[k + 1]], b";".join(groups[group[k] : group[k + 1]]), (n_a[k + 1] - n_a[k], n_b[k + 1] - n_b[k], group[k + 1] - group[k]), True) for k in range(len(units))]


def _one(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(numbers: np.ndarray) -> pa.Array:
    """An array as one value: what moves between tasks is a third of what it would be, in memory as on disk."""
    return pa.array([pa.compress(numbers.astype(np.int32).tobytes(), codec="zstd", asbytes=True)], pa.binary())


def _unpacked(value: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(pa.input_stream(value.as_buffer(), compression="zstd").read(), np.int32)


def _chunk(aligner: Aligner, rows: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
    aligner.forget()
    codes, lengths = aligner.units([b" " + t if t else b"" for t in texts])
    codes = codes.astype(np.int32)
    # a text that one of the tokenizers does not give back has no tokens
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    bad = np.zeros(len(texts), bool)
    bad[doc[~np.array(aligner.same, bool)[codes]]] = True
    if bad.any():
        codes, lengths = codes[~bad[doc]], np.where(bad, 0, lengths)
    del doc
    ends = np.cumsum(lengths)
    often = aligner.met(codes)
    used = np.flatnonzero(often)
    local = np.zeros(len(often), np.int32)
    local[used] = np.arange(len(used))
    links, sizes = aligner.links.take(used)
    pairs, place = np.unique(links, return_inverse=True)
    del links
    total = np.bincount(place, weights=np.repeat(often[used], sizes), minlength=len(pairs)).astype(np.int64)
    packed = [_packed(x) for x in (local[codes], lengths, place, sizes)]
    del place
    sums = [np.diff(np.append(0, np.append(0, np.cumsum(x[codes], dtype=np.int64))[ends])) for x in (*aligner.counts.T, np.array(aligner.links.sizes, np.int32))]
    at = np.append(0, ends).tolist()
    sha = [hashlib.sha256(b";".join(map(aligner.text.__getitem__, codes[a:b].tolist()))).hexdigest() if b > a else "" for a, b in zip(at, at[1:], strict=False)]
    columns = [
        pa.array([rows.column("row_id")[0].as_py()], pa.int64()), _one(rows.column("doc_id")), *[_one(pa.array(x, pa.int64())) for x in sums], _one(pa.array(sha, pa.string())),
        *packed, _one(pa.array(pairs >> 32, pa.int32())), _one(pa.array(pairs & 0xFFFFFFFF, pa.int32())), _one(pa.array(total)),
    ]
    return pa.RecordBatch.from_arrays(columns, NAMES)


NAMES = [x.split()[0] for x in CHUNK.split(",")]


def _sums(chunk: pa.Table, told: pa.Table) -> pa.Table:
    """Documents of one chunk that has met the counts of its pairs."""
    codes, lengths, links, sizes = (_unpacked(chunk.column(c)[0]) for c in ("codes", "lengths", "links", "sizes"))
    ends, place = np.cumsum(lengths, dtype=np.int64), told.column("place").to_numpy()
    out = {c: chunk.column(c).combine_chunks().flatten() for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
    for name in ("best", "count"):
        of_pair = np.zeros(len(place), np.int64)
        of_pair[place] = told.column(name).to_numpy()
        of_unit = np.diff(np.append(0, np.append(0, np.cumsum(of_pair[links]))[np.cumsum(sizes, dtype=np.int64)]))
        out[name] = pa.array(np.diff(np.append(0, np.append(0, np.cumsum(of_unit[codes]))[ends])), pa.int64())
    return pa.table([out[c] for c in ("ids", "n_a", "n_b", "n_groups", "n_links", "best", "count", "groups_sha256")], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_a: str | None = None, tokenizer_b: str | None = None) -> DataFrame:
    """One row a document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    Tokens of a blank and the text by A, and of the text by B, which adds the blank. Byte offsets where tokens of both
    end cut them into groups; tokens whose bytes overlap are linked. A pair's count is how many links of the corpus
    have its ids; ``n_best`` counts links whose count is the highest of their B id, ``count_sum`` sums the counts.
    Texts that are null, empty, or not given back by both tokenizers have no tokens: zeros, and no digest. Repeated
    rows count and come back each, null ids too; other columns are ignored; an empty table gives an empty result.
    The tokenizers are files on the driver, from where they are sent to the tasks.
    """
    chunks = materialize(_encoded(docs, id_col, text_col, tokenizer_a, tokenizer_b), "chunks", **{"parquet.block.row.count.limit": CHUNKS_A_GROUP})
    pairs = chunks.select("chunk", F.posexplode(F.arrays_zip("a", "b", "often")).alias("place", "p")).select("chunk", "place", "p.*")
    counts = materialize(pairs.groupBy("a", "b").agg(F.sum("often").alias("count")), "pairs")
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))  # a row an entry of B's vocabulary
    counts = counts.join(F.broadcast(highest), "b").select("a", "b", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))
    told = pairs.select(F.col("chunk").alias("of"), "place", "a", "b").join(counts, ["a", "b"]).select("of", "place", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return chunks.drop("a", "b", "often").groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_sums, schema)


def _encoded(docs: DataFrame, id_col: str, text_col: str, tokenizer_a: str | None, tokenizer_b: str | None) -> DataFrame:
    context = docs.sparkSession.sparkContext
    with open(tokenizer_path(tokenizer_a, TOKENIZER_A), encoding="utf-8") as f, open(tokenizer_path(tokenizer_b, TOKENIZER_B), "rb") as g:
        models = context.broadcast((f.read(), g.read()))
    key = hash(models.value)
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(Tokenizers.of(key, *models.value))
        for some, texts in slices(batches, CHUNK_BYTES):
            yield _chunk(aligner, some, texts)

    return rows.mapInArrow(run, CHUNK)
