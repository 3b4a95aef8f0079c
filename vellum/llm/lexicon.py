"""A minimal acyclic transducer: words in, sequences of ids out, with shared prefixes and suffixes, in a file that tasks map into memory."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Arrays of the file in order: arcs as state * 256 + byte, their targets and outputs; outputs of final states (-1: not final); where outputs begin in the pool, and the pool of ids.
LAYOUT = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("finals", np.int32), ("begins", np.int32), ("pool", np.int32))


def _shared(a: tuple, b: tuple) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


class _State:
    __slots__ = ("arcs", "final")

    def __init__(self):
        self.arcs: list[list] = []  # [byte, target, output]
        self.final: tuple | None = None


def compile_lexicon(entries: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of a lexicon. Entries come in the order of their bytes, each word once.

    States that can no longer change are looked up among those made before, so equal endings are kept once. An id
    is put out as early as all words behind an arc agree on it, which makes endings equal more often.
    """
    made: dict[tuple, int] = {}
    outputs: dict[tuple, int] = {(): 0}
    keys, targets, outs, finals = [], [], [], []

    def freeze(state: _State) -> int:
        key = (state.final, tuple(map(tuple, state.arcs)))
        if key not in made:
            made[key] = n = len(finals)
            finals.append(-1 if state.final is None else outputs.setdefault(state.final, len(outputs)))
            for byte, target, out in state.arcs:
                keys.append(n * 256 + byte)
                targets.append(target)
                outs.append(outputs.setdefault(out, len(outputs)))
        return made[key]

    path, last = [_State()], b""
    for word, ids in entries:
        same = _shared(tuple(last), tuple(word))
        for k in range(len(last), same, -1):
            path[k - 1].arcs[-1][1] = freeze(path.pop())
        for k in range(same):  # what both words put out stays on the way, the rest moves behind it
            arc, below = path[k].arcs[-1], path[k + 1]
            n = _shared(arc[2], ids)
            if n < len(arc[2]):
                rest, arc[2] = arc[2][n:], arc[2][:n]
                for x in below.arcs:
                    x[2] = rest + x[2]
                if below.final is not None:
                    below.final = rest + below.final
            ids = ids[n:]
        for byte in word[same:]:
            path[-1].arcs.append([byte, -1, ids])
            path.append(_State())
            ids = ()
        path[-1].final = ids
        last = word
    for k in range(len(last), 0, -1):
        path[k - 1].arcs[-1][1] = freeze(path.pop())
    root = freeze(path[0])
    begins = np.cumsum([0, *map(len, outputs)])
    arrays = [np.array(x, t) for x, (_, t) in zip((keys, targets, outs, finals, begins, [i for o in outputs for i in o]), LAYOUT, strict=True)]
    return np.array([root, *map(len, arrays)], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled lexicon, mapped into memory: all tasks of a machine share its pages."""

    opened: dict[str, Lexicon] = {}

    def __init__(self, path: str):
        head = np.memmap(path, np.int64, "r", 0, (1 + len(LAYOUT),))
        self.root, at = int(head[0]), head.nbytes
        for (name, kind), n in zip(LAYOUT, head[1:].tolist(), strict=True):
            setattr(self, name, np.memmap(path, kind, "r", at, (n,)) if n else np.zeros(0, kind))
            at += n * np.dtype(kind).itemsize

    @classmethod
    def open(cls, path: str) -> Lexicon:
        if path not in cls.opened:
            cls.opened[path] = cls(path)
        return cls.opened[path]

    def find(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For some words: whether each is in the lexicon, how many ids it has there, and all these ids one after another.

        All words walk together, a byte a step.
        """
        n = np.array(list(map(len, words)), np.int64)
        at = np.cumsum(n) - n
        text = np.frombuffer(b"".join(words), np.uint8)
        state = np.full(len(words), self.root, np.int64)
        on = np.arange(len(words)) if len(self.keys) else np.zeros(0, np.int64)
        steps = []
        for k in range(int(n.max(initial=0)) if len(on) else 0):
            on = on[n[on] > k]
            if not len(on):
                break
            key = state[on] * 256 + text[at[on] + k]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            state[on[~hit]] = -1
            on, arc = on[hit], arc[hit]
            state[on] = self.targets[arc]
            told = self.outputs[arc] > 0
            steps.append((on[told], self.outputs[arc[told]]))
        final = np.where(state >= 0, self.finals[np.maximum(state, 0)], -1)
        there = final >= 0
        if not len(self.keys):
            there &= n == 0
        steps.append((np.flatnonzero(there), final[there]))
        word, out = (np.concatenate([s[k] for s in steps]).astype(np.int64) for k in (0, 1))
        keep = there[word]
        order = np.argsort(word[keep], kind="stable")
        word, out = word[keep][order], out[keep][order]
        sizes = self.begins[out + 1] - self.begins[out]
        ids = self.pool[np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - self.begins[out], sizes)]
        return there, np.bincount(word, weights=sizes, minlength=len(words)).astype(np.int64), ids
