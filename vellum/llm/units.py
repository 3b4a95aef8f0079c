"""Texts as units: stretches that tokenizers encode alike whatever stands around them, each distinct one looked at once.

A unit ends where a character that is not white space meets a blank. Neither a byte-level pre-tokenizer nor a
vocabulary whose pieces have blanks in front alone reaches across such a place, so the tokens of a text are those
of its units one after another.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa

#: A table of units is dropped and begun anew once it has so many entries, or so many bytes of text.
MOST_UNITS, MOST_BYTES = 250_000, 32_000_000
CUT = re.compile(r"(?<=\S) ")


def cut(text: bytes) -> list[bytes]:
    """The units of one text; joined they are the text."""
    whole = text.decode("utf-8", "replace")
    at = [0, *(m.start() for m in CUT.finditer(whole)), len(whole)]
    return [whole[a:b].encode() for a, b in zip(at, at[1:], strict=False) if a < b]


class _Codes(dict):
    """Numbers units as they are met."""

    def __missing__(self, unit: bytes) -> int:
        self[unit] = n = len(self)
        return n


class Units:
    """Units met so far, numbered; ``learn`` is told of new ones and keeps what it makes of them in the same order."""

    def __init__(self, learn: Callable[[list[bytes]], None]):
        self.codes, self.learn, self.known, self.size = _Codes(), learn, 0, 0
        self.open: list[bool] = []  # ends in white space: what follows may belong to it

    @property
    def full(self) -> bool:
        return len(self.codes) > MOST_UNITS or self.size > MOST_BYTES

    def bytes_of(self) -> np.ndarray:
        return np.fromiter(map(len, self.codes), np.int64, len(self.codes))

    def keep(self, kept: np.ndarray) -> None:
        """Forget all units but some, given by number in order, which are numbered anew."""
        some = set(kept.tolist())
        self.codes = _Codes(zip((u for k, u in enumerate(self.codes) if k in some), range(len(some)), strict=True))
        self.open = [self.open[k] for k in kept.tolist()]
        self.known, self.size = len(some), sum(map(len, self.codes))

    def _add(self) -> None:
        if self.known == len(self.codes):
            return
        new = list(islice(self.codes, self.known, None))
        self.open += [u[-4:].decode("utf-8", "ignore")[-1:].isspace() for u in new]
        self.size += sum(map(len, new))
        self.known = len(self.codes)
        self.learn(new)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The units of some texts as numbers one after another, and how many each text has."""
        code, told = self.codes.__getitem__, []
        number = lambda parts: np.fromiter(map(code, parts), np.int64, len(parts))
        for text in texts:
            if b"\xff" in text:  # not UTF-8
                text = text.decode("utf-8", "replace").encode()
            parts = text.replace(b" ", b"\xff ").split(b"\xff")
            told.append(number(parts if parts[0] else parts[1:]))
        self._add()
        is_open = np.array(self.open, bool)
        for k, codes in enumerate(told):
            if is_open[codes[:-1]].any():  # white space before a blank: cut this text with care
                told[k] = number(cut(texts[k]))
        self._add()
        return np.concatenate(told) if told else np.zeros(0, np.int64), np.array(list(map(len, told)), np.int64)


class Pool:
    """Lists of numbers one after another, by the number of the list."""

    def __init__(self, dtype):
        self.flat, self.n = np.empty(1024, dtype), 0
        self.sizes: list[int] = []

    def add(self, values: list | np.ndarray, sizes: list[int]) -> None:
        while self.n + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(len(self.flat), self.flat.dtype)])
        self.flat[self.n : self.n + len(values)] = values
        self.n += len(values)
        self.sizes += sizes

    def keep(self, lists: np.ndarray) -> None:
        """Forget all lists but some, which are numbered anew."""
        values, sizes = self.take(lists)
        self.flat, self.n = np.empty(max(1024, len(values)), self.flat.dtype), 0
        self.sizes = []
        self.add(values, sizes.tolist())

    def take(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of some lists one after another, and the size of each."""
        sizes = np.array(self.sizes, np.int64)
        n, offset = sizes[lists], (np.cumsum(sizes) - sizes)[lists]
        return self.flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - offset, n)], n


def slices(batches: Iterator[pa.RecordBatch], room: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with their texts, in slices of about ``room`` bytes of text; a longer text is a slice of its own."""
    for batch in batches:
        column = batch.column(text).cast(pa.binary())
        sizes = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]) + 1) if len(column) else np.zeros(0)
        low = 0
        while low < len(batch):
            done = int(sizes[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, done + room, side="right")))
            yield batch.slice(low, high - low), column.slice(low, high - low).to_pylist()
            low = high
