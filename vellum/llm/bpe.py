"""Byte-pair encoding and decoding of a corpus with a lexicon of its frequent words.

Words, which are the pre-tokenizer's stretches of a text, are counted over the whole corpus. The most frequent are
merged once and compiled into a transducer (`lexicon.py`); its file goes from the shared folder to every executor and
is mapped into memory there. Words that it does not have are merged where they are met, by the vocabulary's ranks, so
the ids are the same whichever words are in it.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, share_file, tokenizer_path
from .lexicon import Lexicon, compile_lexicon
from .units import Pool, Units, slices

TOKENIZER = "byte_bpe_50k.json"
#: The lexicon has at most so many words, the most frequent ones. Others are merged one by one.
LEXICON_WORDS = 1 << 16
SLICE_BYTES = 8_000_000
# The pattern of byte-level pre-tokenizers, with classes of letters, digits and white space to be put in, and
# a bound of code points below which all versions of Unicode class characters alike.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
SETTLED = "\u0250"
#: Words of at most so many bytes are merged together, as rows of matrices of these widths; longer ones one by one.
WIDTHS = (8, 16, 32, 64)


def settled_pattern(below: int) -> str:
    """The pattern for texts of code points below a bound, in classes that the standard library knows."""
    kind = lambda k: "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] == k)
    space = "".join(re.escape(chr(c)) for c in range(below) if chr(c).isspace() and not 0x1C <= c <= 0x1F)
    return PATTERN.format(L=kind("L"), N=kind("N"), S=space)


def byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the rest from 256 on in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """A byte-level vocabulary: its pieces as bytes, its merges, its special tokens, and the library's own pre-tokenizer."""

    made: dict[str, Merges] = {}

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        told = json.loads(spec)
        model, extra, byte = told["model"], told["added_tokens"], byte_of()
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("byte_fallback") or model.get("dropout") or told["normalizer"] or told["pre_tokenizer"]["type"] != "ByteLevel" or told["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("not a byte-level BPE vocabulary without normalizer")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in extra):
            raise ValueError("special tokens must be plain strings")
        vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in extra}
        self.cuts = re.compile(b"(" + b"|".join(re.escape(x.encode()) for x in sorted(self.special, key=len, reverse=True)) + b")") if extra else None
        self.pieces = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for piece, i in vocab.items():
            self.pieces[i] = bytes(map(byte.__getitem__, piece))
        for content, i in self.special.items():
            self.pieces[i] = content.encode()
        self.bytes = [vocab[c] for c, _ in sorted(byte.items(), key=lambda x: x[1])]
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        keys = np.array(list(self.merges), np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.joined = np.array([i for _, i in self.merges.values()], np.int32)  # by rank
        self._slow = Tokenizer.from_str(spec).pre_tokenizer.pre_tokenize_str
        self._ascii = re.compile(settled_pattern(128).encode()).findall
        self._fast = re.compile(settled_pattern(ord(SETTLED))).findall
        self.flat, self.sizes = np.frombuffer(b"".join(self.pieces), np.uint8), np.array(list(map(len, self.pieces)), np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, spec: str) -> Merges:
        if spec not in cls.made:
            cls.made[spec] = cls(spec)
        return cls.made[spec]

    def words(self, unit: bytes) -> list[bytes | int]:
        """The words of a unit, and ids where it has special tokens."""
        if unit[unit[:1] == b" " :].isalpha():  # of ASCII letters alone
            return [unit]
        if self.cuts and b">" in unit and self.cuts.search(unit):
            parts = self.cuts.split(unit)
            return [w for p in parts if p for w in ((self.special[p.decode()],) if p.decode() in self.special else self._plain(p))]
        return self._plain(unit)

    def _plain(self, unit: bytes) -> list[bytes]:
        if unit.isascii():
            return self._ascii(unit)
        part = unit.decode("utf-8", "replace")
        if max(part) >= SETTLED:  # which characters are letters is for the library to say
            return [part[a:b].encode() for _, (a, b) in self._slow(part)]
        return [unit] if part[part[0] == " " :].isalpha() else [w.encode() for w in self._fast(part)]

    def merge_all(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many words one after another, and how many each has. Words of like length are rows of a matrix, and a step joins one pair in each of them."""
        n = np.array(list(map(len, words)), np.int64)
        sizes = np.zeros(len(words), np.int64)
        parts, least = [], 0
        for width in WIDTHS:
            some = np.flatnonzero((n > least) & (n <= width))
            least = width
            for k in range(0, len(some), 20_000):
                rows = some[k : k + 20_000]
                ids = self._merge_rows([words[i] for i in rows.tolist()], width)
                sizes[rows] = (ids >= 0).sum(1)
                parts.append((rows, ids[ids >= 0]))
        for i in np.flatnonzero(n > least).tolist():
            ids = np.array(self.merge(words[i]), np.int32)
            sizes[i] = len(ids)
            parts.append((np.array([i]), ids))
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        for rows, ids in parts:
            m = sizes[rows]
            out[np.arange(len(ids)) - np.repeat(np.cumsum(m) - m - begin[rows], m)] = ids
        return out, sizes

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        none = np.int32(len(self.keys))
        if not none:
            return np.zeros(a.shape, np.int32)
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), none - 1)
        return np.where((a >= 0) & (b >= 0) & (self.keys[at] == key), self.ranks[at], none)

    def _merge_rows(self, words: list[bytes], width: int) -> np.ndarray:
        ids = np.full((len(words), width + 1), -1, np.int32)  # the last column stays empty
        n = np.array(list(map(len, words)))
        ids[:, :width][np.arange(width) < n[:, None]] = np.array(self.bytes, np.int32)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self._ranks_of(ids[:, :-1], ids[:, 1:])
        column, on = np.arange(width), np.arange(len(words))
        while len(on):
            at = ranks[on].argmin(1)
            best = ranks[on, at]
            go = best < len(self.keys)
            on, at, best = on[go], at[go], best[go]
            if not len(on):
                break
            back = np.minimum(column + (column > at[:, None]), width)
            rows, scores = ids[on], ranks[on]
            rows[:, :width] = np.take_along_axis(rows, back, 1)
            scores = np.take_along_axis(np.concatenate([scores, np.full((len(on), 1), len(self.keys), np.int32)], 1), back, 1)
            line = np.arange(len(on))
            rows[line, at] = self.joined[best]
            scores[line, at] = self._ranks_of(rows[line, at], rows[line, at + 1])
            inner = at > 0
            scores[line[inner], at[inner] - 1] = self._ranks_of(rows[line[inner], at[inner] - 1], rows[line[inner], at[inner]])
            ids[on], ranks[on] = rows, scores
        return ids

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word: of all adjacent pairs the one of least rank is joined, the first of like ones, until none is left."""
        ids, get = [self.bytes[b] for b in word], self.merges.get
        n = len(ids)
        ahead, behind = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, m[1], ids[i], ids[i + 1]) for i in range(n - 1) if (m := get(ids[i] << 32 | ids[i + 1]))]
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = ahead[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            ahead[i] = k = ahead[j]
            if k < n:
                behind[k] = i
                if m := get(new << 32 | ids[k]):
                    heapq.heappush(heap, (m[0], i, m[1], new, ids[k]))
            h = behind[i]
            if h >= 0 and (m := get(ids[h] << 32 | new)):
                heapq.heappush(heap, (m[0], h, m[1], ids[h], new))
        return [x for x in ids if x >= 0]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text, in UTF-8, of each stretch of ids; what is not UTF-8 becomes replacement characters."""
        n = self.sizes[ids]
        flat = self.flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - self.offsets[ids], n)].tobytes()
        at = np.append(0, np.cumsum(n))[np.append(0, ends)].tolist()
        return [flat[a:b].decode("utf-8", "replace").encode() for a, b in zip(at, at[1:], strict=False)]


class Encoder:
    """Texts to ids, by the lexicon where it has a word and by merging where it has not; units already met are not looked up again."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon
        self.reset()

    def reset(self) -> None:
        self.pool, self.units = Pool(np.int32), Units(self._learn)

    def _learn(self, units: list[bytes]) -> None:
        lists = list(map(self.merges.words, units))
        words = list(dict.fromkeys(w for x in lists for w in x if isinstance(w, bytes)))
        there, sizes, ids = self.lexicon.find(words)
        other = np.flatnonzero(~there)
        merged, more = self.merges.merge_all([words[i] for i in other.tolist()])
        pool = np.concatenate([ids, merged])
        begin = np.cumsum(sizes) - sizes
        begin[other], sizes[other] = len(ids) + np.cumsum(more) - more, more
        place = dict(zip(words, range(len(words)), strict=True))
        # a special token is one more entry of its own
        pool = np.append(pool, list(self.merges.special.values())).astype(np.int32)
        special = {i: len(words) + k for k, i in enumerate(self.merges.special.values())}
        begin, sizes = np.append(begin, len(pool) - len(special) + np.arange(len(special))), np.append(sizes, np.ones(len(special), np.int64))
        flat = np.array([place[w] if isinstance(w, bytes) else special[w] for x in lists for w in x], np.int64)
        n = sizes[flat]
        values = pool[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - begin[flat], n)]
        ends = np.append(0, np.cumsum(n))[np.cumsum(list(map(len, lists)), dtype=np.int64)]
        self.pool.add(values, np.diff(np.append(0, ends)).tolist())

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts one after another, and where each text ends."""
        if self.units.full:
            self.reset()
        codes, lengths = self.units(texts)
        ids, sizes = self.pool.take(codes)
        return ids, np.append(0, np.cumsum(sizes))[np.cumsum(lengths)]


def _count(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(spec.value)

        def told(units: Units, often: np.ndarray) -> pa.RecordBatch:
            words: Counter = Counter()
            for u, n in zip(units.codes, often.tolist(), strict=True):
                for w in merges.words(u) if n else ():
                    if isinstance(w, bytes):
                        words[w] += n
            return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], ["word", "n"])

        units, often = Units(lambda new: None), np.zeros(0, np.int64)
        for _, texts in slices(batches, SLICE_BYTES):
            more = np.bincount(units(texts)[0], minlength=len(units.codes))
            more[: len(often)] += often
            often = more
            if units.full:
                yield told(units, often)
                units, often = Units(lambda new: None), np.zeros(0, np.int64)
        yield told(units, often)

    return run


def frequent_words(docs: DataFrame, spec, most: int = LEXICON_WORDS) -> DataFrame:
    """At most ``most`` of the most frequent words with their ids; how many are as frequent decides, so reruns agree."""
    counts = docs.mapInArrow(_count(spec), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("level", F.floor(F.log2("n") * 16).cast("int")), "words")
    bar, room = 1 << 20, most
    for level, n in sorted(counts.groupBy("level").agg(F.count(F.lit(1))).collect(), reverse=True):  # at most 16 x 64 rows
        room -= n
        if room < 0:
            break
        bar = level

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(spec.value)
        for batch in batches:
            ids, sizes = merges.merge_all(batch.column("word").to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), lists], ["word", "ids"])

    return counts.filter(F.col("level") >= bar).select("word").mapInArrow(merged, "word binary, ids array<int>")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """One row a document: ``doc_id, ids array<int>, decoded string``.

    ``ids`` are those of the tokenizers library for the whole text, without special tokens added; a special token's
    string inside a text is that token, as there. ``decoded`` is made from the ids. A null text is empty and has no
    ids; repeated rows and null ids come back as they are; other columns are ignored; an empty table gives an empty
    result. ``tokenizer`` is a file on the driver, from where it is sent to the tasks.
    """
    return _encode(docs, id_col, text_col, tokenizer, lexicon_words, False)


def encode_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """`encode_texts` as digests, made where the ids are: ``doc_id, n_tokens, ids_sha256, decoded_sha256``."""
    return _encode(docs, id_col, text_col, tokenizer, lexicon_words, True)


def _encode(docs: DataFrame, id_col: str, text_col: str, tokenizer: str | None, lexicon_words: int, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    with open(tokenizer_path(tokenizer, TOKENIZER), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    told = frequent_words(rows.select("text"), spec, lexicon_words).toArrow()  # at most lexicon_words rows
    entries = sorted(zip(told.column("word").to_pylist(), map(tuple, told.column("ids").to_pylist()), strict=True))
    name = share_file(spark, "lexicon", compile_lexicon(entries))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges.of(spec.value)
        encoder = Encoder(merges, Lexicon.open(SparkFiles.get(name)))
        for rows, texts in slices(batches, SLICE_BYTES):
            ids, ends = encoder(texts)
            decoded = merges.decode(ids, ends)
            at = np.append(0, ends)
            if digest:
                raw, sha = ids.astype("<u4").tobytes(), lambda x: hashlib.sha256(x).hexdigest()
                hashes = [sha(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), ends.tolist(), strict=False)]
                columns = [pa.array(np.diff(at), pa.int64()), pa.array(hashes), pa.array(list(map(sha, decoded)))]
            else:
                columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *columns], names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    names = [x.split()[0] for x in schema.split(", ")]
    return rows.mapInArrow(run, schema)
