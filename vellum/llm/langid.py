"""Language identification of mixed-language text.

Ranges of scripts narrow down the languages that a word may be in. Character trigrams score each word in each
of them, and a Viterbi pass over the words with a penalty for each switch labels spans of one language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First and last code point of the main letter blocks of each script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x250, 0x2AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3134F)],
}
BUCKETS = 1 << 16
#: Labelled documents that a model learns from, for each language, on average. Larger corpora are sampled by a hash.
SAMPLE_A_LANGUAGE = 1000
MOST_LANGUAGES = 500
#: Log-odds that a switch of language must win; share of a language's letters from which on a script is one of its own.
SWITCH = 12.0
LEAST_SCRIPT = 0.01
#: Characters times languages that are held at a time; a longer text is a chunk of its own.
CHUNK_CELLS = 8_000_000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per code point: letter, part of a word (letters and their marks), lower case, script (0: other)."""
    n = 0x110000
    letter = np.fromiter((chr(c).isalpha() for c in range(n)), dtype=bool, count=n)
    part = letter | np.fromiter((unicodedata.category(chr(c))[0] == "M" for c in range(n)), dtype=bool, count=n)
    lower = np.arange(n, dtype=np.uint32)
    for c in range(0x20000):
        if letter[c] and len(x := chr(c).lower()) == 1:
            lower[c] = ord(x)
    script = np.zeros(n, dtype=np.uint8)
    for k, ranges in enumerate(SCRIPTS.values(), 1):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, part, lower, script


class Words:
    """The words of some texts, flat: for each its text, letters, script, and the trigram buckets of its characters."""

    def __init__(self, texts: list[str]):
        letter, part, lower, script = _tables()
        points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        inside = part[points]
        at = np.flatnonzero(inside)
        low = lower[points]
        low[~inside] = 1  # the edge of a word
        before, after = low[np.maximum(at - 1, 0)], low[np.minimum(at + 1, len(low) - 1)]
        if len(at) and at[0] == 0:
            before[0] = 1
        self.buckets = ((before * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)) >> np.uint32(16)).astype(np.int32)
        self.first = np.flatnonzero(before == 1) if len(at) else at
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, at[self.first], side="right")
        self.letters = np.add.reduceat(letter[points[at]].astype(np.int64), self.first) if len(at) else at
        self.script = script[points[at[self.first]]]
        self.per_text = np.bincount(self.text, minlength=len(texts))

    def sums(self, table: np.ndarray, start: int = 0, stop: int | None = None) -> np.ndarray:
        """For each word of a stretch the sum of its characters' rows of the table, gathered a number of characters at a time."""
        stop = len(self.first) if stop is None else stop
        first = self.first[start:stop]
        out = np.zeros((len(first), table.shape[1]), table.dtype)
        if not len(first):
            return out
        step, end = max(1, CHUNK_CELLS // table.shape[1]), self.first[stop] if stop < len(self.first) else len(self.buckets)
        for low in range(int(first[0]), int(end), step):
            some = self.buckets[low : min(low + step, end)]
            a, b = np.searchsorted(first, low, side="right") - 1, np.searchsorted(first, low + len(some), side="left")
            out[a:b] += np.add.reduceat(table[some], np.maximum(first[a:b] - low, 0), axis=0)
        return out


def viterbi_long(scores: Callable[[int, int], np.ndarray], length: int, n: int, penalty: float = SWITCH) -> np.ndarray:
    """`viterbi` of one sequence whose scores are made a stretch at a time.

    All that is kept of a word is the best label before it and, a bit a label, which labels switch from that one.
    """
    best, bits = np.zeros(length, np.int16), np.zeros((length, (n + 7) // 8), np.uint8)
    value, step = np.zeros(n, np.float32), max(1, CHUNK_CELLS // n)
    for low in range(0, length, step):
        some = scores(low, min(low + step, length))
        switched = np.zeros(some.shape, bool)
        for t in range(len(some)):
            k = value.argmax()
            over = value[k] - np.float32(penalty if low + t else 0)
            best[low + t], switched[t] = k, over > value
            value = np.maximum(value, over) + some[t]
        bits[low : low + len(some)] = np.packbits(switched, axis=1)
    out, label = np.zeros(length, np.int64), int(value.argmax()) if length else 0
    for t in range(length - 1, -1, -1):
        out[t] = label
        if bits[t, label >> 3] >> (7 - (label & 7)) & 1:
            label = int(best[t])
    return out


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of each word; sequences of the given lengths lie one after another and advance together."""
    n = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    active = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")  # sequences longer than t
    came = np.empty(scores.shape, dtype=np.int16)
    value = np.zeros((len(sizes), n), dtype=np.float32)
    keep = np.arange(n, dtype=np.int16)
    for t, k in enumerate(active):
        at = starts[:k] + t
        v = value[:k]
        best = v.argmax(axis=1)
        over = v[np.arange(k), best][:, None] - np.float32(penalty if t else 0)
        switch = over > v
        came[at] = np.where(switch, best[:, None], keep)
        value[:k] = np.where(switch, over, v) + scores[at]
    label = value.argmax(axis=1)
    out = np.zeros(len(scores), dtype=np.int64)
    for t in range(len(active) - 1, -1, -1):
        at = starts[: active[t]] + t
        now = label[: active[t]]
        out[at] = now
        label[: active[t]] = came[at, now]
    return out


class Model:
    """Languages, most frequent first; log-odds of trigram buckets; which scripts each language is written in."""

    def __init__(self, languages: list[str], weights: np.ndarray, scripts: np.ndarray):
        self.languages, self.weights, self.scripts = languages, weights, scripts

    def _labels(self, words: Words) -> np.ndarray:
        def scores(start: int, stop: int) -> np.ndarray:
            mine = self.scripts[words.script[start:stop]]
            return np.where(mine | ~mine.any(axis=1, keepdims=True), words.sums(self.weights, start, stop), np.float32(-1e4))

        n, languages = len(words.first), len(self.languages)
        if len(words.per_text) == 1 and n * languages > CHUNK_CELLS:  # one long text: a stretch of its scores at a time
            return viterbi_long(scores, n, languages)
        return viterbi(scores(0, n), words.per_text)

    def predict(self, texts: list[str]) -> list[tuple[str, float, int]]:
        """(language, share of the letters in its spans, number of spans) of each text."""
        if not self.languages:
            return [("und", 0.0, 0)] * len(texts)
        n = len(self.languages)
        words = Words(texts)
        label = self._labels(words)
        letters = np.bincount(words.text * n + label, weights=words.letters, minlength=len(texts) * n).reshape(-1, n)
        total = letters.sum(axis=1)
        best = letters.argmax(axis=1)
        new = np.ones(len(label), dtype=bool)
        new[1:] = (label[1:] != label[:-1]) | (words.text[1:] != words.text[:-1])
        spans = np.bincount(words.text[new], minlength=len(texts))
        return [(self.languages[b], float(letters[i, b] / total[i]), int(spans[i])) if total[i] else ("und", 0.0, 0) for i, b in enumerate(best)]

    def spans(self, text: str) -> list[tuple[str, int]]:
        """(language, number of words) of the spans of one text, in order."""
        label = self._labels(Words([text]))
        out: list[tuple[str, int]] = []
        for x in label:
            name = self.languages[x]
            out = [*out[:-1], (name, out[-1][1] + 1)] if out and out[-1][0] == name else [*out, (name, 1)]
        return out


def chunks(texts: list[str], languages: int) -> Iterator[list[int]]:
    """Indexes of texts, longest first, in chunks of about CHUNK_CELLS characters times languages."""
    held, size, most = [], 0, CHUNK_CELLS // max(1, languages)
    for i in sorted(range(len(texts)), key=lambda i: -len(texts[i])):
        held.append(i)
        size += len(texts[i]) + 1
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of labelled texts, per language: trigram buckets, and letters of each script as bucket -1 - script."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            for some in chunks(whole := list(texts), 4):
                words = Words([whole[i] for i in some])
                n = np.bincount(words.buckets, minlength=BUCKETS)
                letters = np.bincount(words.script, weights=words.letters, minlength=len(SCRIPTS) + 1).astype(np.int64)
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": np.concatenate([at, -1 - np.arange(len(letters))]), "n": np.concatenate([n[at], letters])})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages of labelled texts (null texts and labels aside). Its size is that of the languages, not of the corpus."""
    known = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna(subset=["text", "lang"])
    counts = known.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not counts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPTS) + 1, 0), bool))
    languages = [r[0] for r in sorted(counts, key=lambda r: (-r[1], r[0]))]
    bar = F.create_map(*[x for r in counts for x in (F.lit(r[0]), F.lit(int((1 << 20) * min(1.0, SAMPLE_A_LANGUAGE / r[1]))))])
    sample = known.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 20)) < F.element_at(bar, F.col("lang"))).select("lang", "text")
    told = sample.mapInPandas(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    seen = np.zeros((BUCKETS, len(languages)))
    letters = np.zeros((len(SCRIPTS) + 1, len(languages)))
    place = F.create_map(*[F.lit(x) for k, lang in enumerate(languages) for x in (lang, k)])
    told = told.select(F.element_at(place, F.col("lang")).alias("lang"), "bucket", "n").toArrow()  # at most languages x (BUCKETS + scripts) rows
    lang, bucket, n = (told.column(c).to_numpy() for c in ("lang", "bucket", "n"))
    seen[bucket[bucket >= 0], lang[bucket >= 0]] = n[bucket >= 0]
    letters[-1 - bucket[bucket < 0], lang[bucket < 0]] = n[bucket < 0]
    odds = np.log(seen + 0.5) - np.log(seen.sum(axis=0) + 0.5 * BUCKETS)
    odds -= odds.mean(axis=1, keepdims=True)
    odds[seen.sum(axis=1) == 0] = 0
    return Model(languages, odds.astype(np.float32), letters >= np.maximum(1, LEAST_SCRIPT * letters.sum(axis=0)))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a document: ``doc_id``, the columns to ``keep``, ``lang_pred``, ``score``, ``n_spans``.

    ``lang_pred`` is the language whose spans have most of the letters, the more frequent one on ties, and
    ``score`` their share. A text that is null or has no letters, and any text under a model that has learned
    nothing, is ``und`` with score 0. Words in scripts that no language is known for fit all alike. Repeated
    rows stay; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t or "" for t in pdf.pop("_text")]
            told: list = [None] * len(texts)
            for some in chunks(texts, len(shared.value.languages)):
                for i, x in zip(some, shared.value.predict([texts[i] for i in some]), strict=True):
                    told[i] = x
            yield pdf.assign(lang_pred=[x[0] for x in told], score=[x[1] for x in told], n_spans=[x[2] for x in told])

    slim = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "_text"]
    return slim.mapInPandas(predict, ", ".join([*kinds, "lang_pred string", "score double", "n_spans long"]))
