"""Language-model scoring: a causal self-attention model in numpy on subword ids, beside a word unigram base.

Steps, each a Spark job over the whole table:

1. Texts become chunks: each lists its distinct words once, and its documents as indexes into that list.
2. Words are counted over all training documents.
3. Classes of subwords come from all pairs of neighbours in training documents, and the attention model is fitted
   to every subword of them: first steps on the driver set out from a bounded sample of windows, then every task
   goes through its own documents, each subword a target once, and the models are averaged.
4. Chunks meet the counts of their words again and are scored.

The score of a word mixes the attention model with its frequency in the corpus. Beside that the model has a
memory: after one in MEMORY pairs of words, picked by a hash, the next RUN words are taken as one event, and
runs that training documents hold at least twice after this pair have the probability of their count.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CHUNK_BYTES = 6_000_000
#: A window that the driver may draw for its first steps begins at every so many words of each training document, wherever that falls.
STRIDE = 128
#: A window scores its last SCORED subwords and sees CONTEXT more before them. Sizes of vectors, hidden layer, subword list and classes.
CONTEXT, SCORED, DIM, HIDDEN, SUBWORDS, CLASSES = 8, 16, 16, 16, 2048, 64
WINDOW = CONTEXT + SCORED
#: The driver's first steps: their number, the windows they draw from, and passes over these at most. Then each task's rate, and the windows of a step.
WARM_STEPS, WARM_WINDOWS, WARM_PASSES, WARM_RATE, RATE, BATCH, STEP, SEED = 400, 25_000, 12, 0.01, 0.003, 256, 1024, 11
#: Share of a word's probability that its frequency in the corpus has.
MIX = 0.4
#: One in so many pairs of words is followed by a run of so many words that is counted as a whole.
MEMORY, RUN = 128, 16
#: Counts of the most frequent words, at most so many, are broadcast (some 24 bytes each); those of the others are joined.
TOP_WORDS = 1 << 18


class Subwords:
    """Subword ids of words, each with a blank in front; the id past the last is the end of a text."""

    made: dict[bytes, Subwords] = {}

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        # a word is encoded in stretches of at most 64 code points
        self.bpe = tiktoken.Encoding("subwords", pat_str=r"\s?\S{1,64}|\s+", mergeable_ranks=table, special_tokens={})
        self.end = max(table.values()) + 1
        #: Subwords that begin a word, and the end.
        self.starts = np.zeros(self.end + 1, dtype=bool)
        #: What ids are stored as.
        self.kind = np.uint16 if self.end < 1 << 16 else np.int32
        self.starts[[self.end, *(x for piece, x in table.items() if piece[:1] == b" ")]] = True

    @classmethod
    def of(cls, ranks: bytes) -> Subwords:
        if ranks not in cls.made:
            cls.made[ranks] = cls(ranks)
        return cls.made[ranks]

    def __call__(self, words: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The subwords of some words one after another, and how many each word has; a last word is the end."""
        text = " ".join(words) if isinstance(words, list) else pc.binary_join(_one(words), " ")[0].as_py()  # an array's words become no Python strings
        flat = np.array([*(self.bpe.encode_ordinary(" " + text) if len(words) else []), self.end], dtype=np.int32)
        return flat, self.sizes(flat)

    def sizes(self, flat: np.ndarray) -> np.ndarray:
        return np.diff(np.append(np.flatnonzero(self.starts[flat]), len(flat)))

    def stored(self, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Stored subwords of a chunk's words, and how many each word has."""
        ids = np.frombuffer(flat, self.kind).astype(np.int32)
        return ids, self.sizes(ids)


def _one(values: pa.Array) -> pa.ListArray:
    """A column of one row that lists the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def spread(flat: np.ndarray, size: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The subwords of a sequence of words, from those of a list of words and their numbers."""
    offsets = pa.array(np.append(0, np.cumsum(size)), pa.int64())
    return pa.LargeListArray.from_arrays(offsets, pa.array(flat)).take(pa.array(words)).flatten().to_numpy()


class Model:
    """One layer of causal attention over class-grouped subwords.

    P(subword | before) = P(class | before) P(subword | class): the first by attention over the window, the
    second from counts over all training documents. No class has both subwords that begin a word and others;
    rare subwords share the last class of either kind.
    """

    def __init__(self, counts: dict[int, int], starts: np.ndarray):
        rng = np.random.default_rng(SEED)
        n_ids, end = len(starts), len(starts) - 1
        top = sorted(counts, key=lambda t: (-counts[t], t))
        self.listed = [end, *[t for t in top if t != end][: SUBWORDS - 3]]
        self.k = k = len(self.listed) + 2
        self.of_id = np.where(starts, k - 2, k - 1).astype(np.int32)  # rare ones
        self.of_id[self.listed] = np.arange(k - 2)
        self.starts = np.append(starts[self.listed], [True, False])
        self.mass = np.ones(n_ids)
        for t, n in counts.items():
            self.mass[t] += n
        self.rng = rng
        self._classes(np.where(self.starts, 0, 1).astype(np.int32), rng.normal(0, 0.3, (k, DIM)))

    def _classes(self, group: np.ndarray, vectors: np.ndarray) -> None:
        draw = lambda *shape: self.rng.normal(0, 1 / math.sqrt(shape[0]), shape)
        self.group, self.n_classes = group, int(group.max()) + 1
        per = np.bincount(group[self.of_id], weights=self.mass, minlength=self.n_classes)
        self.in_class = (np.log(self.mass) - np.log(per[group[self.of_id]])).astype(np.float32)
        self.begins = np.zeros(self.n_classes, dtype=bool)
        self.begins[group] = self.starts
        self.p = {
            "E": vectors, "Q": draw(DIM, DIM), "K": draw(DIM, DIM), "V": draw(DIM, DIM) * 0.5, "B": np.zeros((SCORED, WINDOW)), "W1": draw(DIM, HIDDEN), "b1": np.zeros(HIDDEN),
            "W2": draw(HIDDEN, DIM) * 0.5, "U": draw(DIM, self.n_classes) * 0.5, "b": np.log((per + 1) / (per + 1).sum()),
        }
        self.p = {n: x.astype(np.float32) for n, x in self.p.items()}

    def set_classes(self, pairs: np.ndarray, often: np.ndarray) -> None:
        """Classes of subwords that have like neighbours, and first vectors: k-means on a low-rank view of counted pairs (a * k + b)."""
        k, rng = self.k, self.rng
        n = np.zeros(k * k)
        n[pairs] = often
        n = n.reshape(k, k)
        rows, cols = n.sum(1) + 1, n.sum(0) + 1
        near = np.sqrt(n) / np.sqrt(np.sqrt(rows)[:, None] * np.sqrt(cols)[None, :])

        def low(m: np.ndarray) -> np.ndarray:
            y = m @ rng.normal(size=(k, DIM))
            for _ in range(4):
                y = m @ (m.T @ np.linalg.qr(y)[0])
            y = np.linalg.qr(y)[0]
            return np.pad(y, ((0, 0), (0, DIM - y.shape[1])))  # of fewer subwords than dimensions

        view = np.concatenate([near @ low(near.T), near.T @ low(near)], axis=1)
        view /= np.linalg.norm(view, axis=1, keepdims=True) + 1e-9
        group = np.zeros(k, dtype=np.int32)  # class 0: the end of a text
        for kind in (True, False):
            inner = np.flatnonzero(self.starts[1 : k - 2] == kind) + 1  # the most frequent first
            heads = min((CLASSES - 3) // 2, len(inner))
            if heads:
                centre = view[inner[:heads]].copy()
                for _ in range(12):
                    own = (view[inner] @ centre.T).argmax(axis=1)
                    for c in range(heads):
                        if (own == c).any():
                            centre[c] = view[inner][own == c].mean(axis=0)
                            centre[c] /= np.linalg.norm(centre[c]) + 1e-9
                group[inner] = group.max() + 1 + np.unique(own, return_inverse=True)[1]
        group[k - 2], group[k - 1] = group.max() + 1, group.max() + 2
        out = view[:, :DIM] * 2 + view[:, DIM:]
        self._classes(group, out / (out.std() + 1e-9) * 0.5)

    def forward(self, ids: np.ndarray, valid: np.ndarray) -> tuple:
        p = self.p
        xq, xk = p["E"][ids[:, CONTEXT:]], p["E"][ids]
        q, k, v = xq @ p["Q"], xk @ p["K"], xk @ p["V"]
        s = q @ k.transpose(0, 2, 1) * np.float32(DIM**-0.5) + (p["B"] + MASK) + np.where(valid, np.float32(0), np.float32(-1e9))[:, None, :]
        a = np.exp(s - s.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        h = xq + a @ v
        z = h @ p["W1"] + p["b1"]
        o = h + np.maximum(z, 0) @ p["W2"]
        y = o @ p["U"] + p["b"]
        y -= y.max(axis=2, keepdims=True)
        y -= np.log(np.exp(y).sum(axis=2, keepdims=True))
        return y, (xq, xk, q, k, v, a, h, z, o)

    def gradients(self, ids: np.ndarray, valid: np.ndarray, target: np.ndarray, known: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of the classes of the targets (where known), and its gradients."""
        p, (y, (xq, xk, q, k, v, a, h, z, o)) = self.p, self.forward(ids, valid)
        n = max(1, int(known.sum()))
        want = self.group[target]
        loss = -float((np.take_along_axis(y, want[..., None], 2)[..., 0] * known).sum()) / n
        dy = np.exp(y)
        np.put_along_axis(dy, want[..., None], np.take_along_axis(dy, want[..., None], 2) - 1, 2)
        dy *= (known / np.float32(n))[..., None]
        over = lambda left, right: left.reshape(-1, left.shape[-1]).T @ right.reshape(-1, right.shape[-1])
        do = dy @ p["U"].T
        dz = (do @ p["W2"].T) * (z > 0)
        dh = do + dz @ p["W1"].T
        da = dh @ v.transpose(0, 2, 1)
        dv = a.transpose(0, 2, 1) @ dh
        ds = a * (da - (da * a).sum(axis=2, keepdims=True))
        scaled = ds * np.float32(DIM**-0.5)
        dq, dk = scaled @ k, scaled.transpose(0, 2, 1) @ q
        dx = dk @ p["K"].T + dv @ p["V"].T
        dx[:, CONTEXT:] += dh + dq @ p["Q"].T
        flat = ids.reshape(-1)
        order = np.argsort(flat, kind="stable")
        at, first = np.unique(flat[order], return_index=True)
        de = np.zeros_like(p["E"])
        de[at] = np.add.reduceat(dx.reshape(-1, DIM)[order], first, axis=0)
        return loss, {
            "E": de, "Q": over(xq, dq), "K": over(xk, dk), "V": over(xk, dv), "B": ds.sum(axis=0), "W1": over(h, dz), "b1": dz.sum(axis=(0, 1)),
            "W2": over(np.maximum(z, 0), do), "U": over(o, dy), "b": dy.sum(axis=(0, 1)),
        }

    def train(self, batches: Iterator[np.ndarray], rate) -> list[float]:
        """Adam on batches of windows of WINDOW + 1 subword ids, -1 where there is no text; ``rate`` of the step's number."""
        m, s = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2))
        losses = []
        for t, some in enumerate(batches, 1):
            at = self.of_id[np.maximum(some, 0)]
            loss, grads = self.gradients(at[:, :-1], some[:, :-1] >= 0, at[:, CONTEXT + 1 :], some[:, CONTEXT + 1 :] >= 0)
            losses.append(loss)
            for n, g in grads.items():
                m[n] = 0.9 * m[n] + 0.1 * g
                s[n] = 0.99 * s[n] + 0.01 * g * g
                self.p[n] = (self.p[n] - rate(t) * (m[n] / (1 - 0.9**t)) / (np.sqrt(s[n] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return losses

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Of each listed subword query, key, value and vector; what leads to the classes, with ``b`` below and classes that never come up to a multiple of 16; what leads from slopes of query, key and value to those of the vector; and whether all scores are so small that none overflows, so that no row needs its greatest taken off."""
        e, p = self.p["E"], self.p
        q, k, v = (e @ p[n] for n in "QKV")
        calm = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max() * DIM**-0.5 + np.abs(p["B"]).max()) < 60
        top = np.pad(np.vstack([p["U"], p["b"]]), ((0, 0), (0, -self.n_classes % 16)))
        top[DIM, self.n_classes :] = -1e9
        made = np.vstack([p["Q"].T * np.float32(DIM**-0.5), p["K"].T, p["V"].T])
        return np.hstack([q * np.float32(DIM**-0.5), k, v, e]), top, made, calm

    def _attend(self, tables: tuple, line: np.ndarray, base: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """For windows one after another on a line of subwords: what is told of each place of the line, weights before they are divided by their sums, these sums, and what comes of the attention and of the layer above it."""
        table, _, _, calm = tables
        n = len(first)
        tell = table.take(line, axis=0)
        q, k, v = _windows(tell, n, SCORED, CONTEXT, 0, DIM), _windows(tell, n, WINDOW, 0, DIM, DIM), _windows(tell, n, WINDOW, 0, 2 * DIM, DIM)
        a = q @ k.transpose(0, 2, 1)
        a += base
        a[first, :, :CONTEXT] = -1e9
        if not calm:
            a -= a.max(axis=2, keepdims=True)
        np.exp(a, out=a)
        total = a.reshape(-1, WINDOW) @ ONES[:WINDOW]
        got = (a @ v).reshape(-1, DIM)
        got /= total[:, None]
        h = got + tell[CONTEXT:, 3 * DIM :]
        z = h @ self.p["W1"]
        z += self.p["b1"]
        np.maximum(z, 0, out=z)
        o = np.empty((len(h), DIM + 1), dtype=h.dtype)
        o[:, DIM] = 1  # for "b"
        np.add(z @ self.p["W2"], h, out=o[:, :DIM])
        return tell, a, total, got, h, z, o

    def slopes(self, tables: tuple, x: np.ndarray, first: np.ndarray, want: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """What `gradients` gives, summed with a weight for each target, in as few passes as may be.

        ``x`` has the WINDOW subwords before and at each window's places, ``first`` says which windows begin a text,
        ``want`` has the classes of the targets. Windows adjoin: what one sees before its places, unless it begins
        a text, is the end of the window before it. So each place is looked up, and its slopes added, once.
        """
        p, n, (_, top, made, _) = self.p, len(x), tables
        line = np.append(x[0, :CONTEXT], x[:, CONTEXT:])
        tell, a, total, got, h, z, o = self._attend(tables, line, p["B"] + MASK, first)
        y = o @ top
        if y.max() > 60:
            y -= y.max(axis=1, keepdims=True)
        np.exp(y, out=y)
        per = y @ ONES[: y.shape[1]]
        y.reshape(-1)[np.arange(0, y.size, y.shape[1]) + want] -= per
        weight = (weight / per)[:, None]  # the same for all classes of a target, so narrower arrays take it
        last = (y.T @ (o * weight)).T
        do = y @ top[:DIM].T
        do *= weight
        dz = do @ p["W2"].T
        dz *= z > 0
        out = {"U": last[:DIM, : self.n_classes], "b": last[DIM, : self.n_classes], "W2": z.T @ do, "W1": h.T @ dz, "b1": ONES[: len(dz)] @ dz}
        dh = dz @ p["W1"].T
        dh += do
        q, k, v = _windows(tell, n, SCORED, CONTEXT, 0, DIM), _windows(tell, n, WINDOW, 0, DIM, DIM), _windows(tell, n, WINDOW, 0, 2 * DIM, DIM)
        down = dh / total[:, None]  # slopes of sums of values
        lost = (down * got) @ ONES[:DIM]  # by the division
        down = down.reshape(n, SCORED, DIM)
        ds = down @ v.transpose(0, 2, 1)
        ds -= lost.reshape(n, SCORED, 1)
        ds *= a
        out["B"] = (ONES[:n] @ ds.reshape(n, -1)).reshape(SCORED, WINDOW)
        told = np.empty((n, WINDOW, 2 * DIM), dtype=dh.dtype)  # slopes of keys and values
        np.matmul(ds.transpose(0, 2, 1), q, out=told[:, :, :DIM])
        np.matmul(a.transpose(0, 2, 1), down, out=told[:, :, DIM:])
        each = np.empty((len(line), 3 * DIM), dtype=dh.dtype)  # slopes of each place's query, key and value
        each[:CONTEXT] = 0
        np.matmul(ds, k, out=_windows(each, n, SCORED, CONTEXT, 0, DIM))
        own, before = _windows(each, n, SCORED, CONTEXT, DIM, 2 * DIM), _windows(each, n, CONTEXT, 0, DIM, 2 * DIM)
        own[:] = told[:, CONTEXT:]
        before += told[:, :CONTEXT]
        both = tell[:, 3 * DIM :].T @ each
        out |= {"Q": both[:, :DIM] * np.float32(DIM**-0.5), "K": both[:, DIM : 2 * DIM], "V": both[:, 2 * DIM :]}
        dx = each @ made
        dx[CONTEXT:] += dh
        place = PLACES.take(line, axis=0).reshape(-1)
        out["E"] = np.bincount(place, weights=dx.reshape(-1), minlength=self.k * DIM).reshape(self.k, DIM)
        return out

    def learn(self, texts: Iterator[tuple[np.ndarray, np.ndarray]], rate) -> int:
        """Adam on every subword of some texts, given as ``logs`` takes them, each a target once; how many there were."""
        m, s = ({n: np.zeros_like(x) for n, x in self.p.items()} for _ in range(2))
        rng, t, seen_ = np.random.default_rng(SEED), 0, 0
        for ids, lengths in texts:
            at, seen, first, opens, left = self._cut(ids, lengths)
            want, left = self.group[at], np.minimum(left, SCORED)
            blocks = rng.permutation(-(-len(first) // BLOCK)) * BLOCK  # of adjoining windows
            seen_ += len(at)
            for low in range(0, len(blocks), STEP // BLOCK):
                step, grads, tables = blocks[low : low + STEP // BLOCK], {}, self._tables()
                n = np.float32(1 / sum(left[f : f + BLOCK].sum() for f in step))
                for f in step:
                    line, place = _line(seen, first[f : f + BLOCK])
                    weight = (np.arange(SCORED) < left[f : f + BLOCK, None]).reshape(-1) * n
                    windows = np.ndarray((len(place), WINDOW), line.dtype, line, 0, (SCORED * line.itemsize, line.itemsize))
                    for name, g in self.slopes(tables, windows, opens[f : f + BLOCK], want.take(place).reshape(-1), weight).items():
                        grads[name] = grads[name] + g if name in grads else g
                t += 1
                for name, g in grads.items():
                    m[name] = 0.9 * m[name] + 0.1 * g
                    s[name] = 0.99 * s[name] + 0.01 * g * g
                    self.p[name] = (self.p[name] - rate(t) * (m[name] / (1 - 0.9**t)) / (np.sqrt(s[name] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return seen_

    def _cut(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Listed subwords of texts that lie one after another, and what stands before each; then of each window of SCORED the first place, whether it begins a text, and how many subwords the text has from there."""
        at = self.of_id[ids]
        n = lengths.astype(np.int64)
        starts = np.cumsum(n) - n
        per = -(-n // SCORED)
        text = np.repeat(np.arange(len(n)), per)
        w = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        seen = np.empty(len(at), dtype=np.int64)  # what stands before each id: the end of another text at first
        seen[1:] = at[:-1]
        seen[starts[n > 0]] = 0
        return at, seen, starts[text] + w * SCORED, w == 0, n[text] - w * SCORED

    def logs(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For texts whose subword ids, ends included, lie one after another: the log probability of each subword, and that of any beginning of a word in its place.

        Each subword is scored once, in one window, from at least CONTEXT subwords before it where the text has as many.
        """
        p, tables = self.p, self._tables()
        share = np.zeros((tables[1].shape[1], 2), dtype=np.float32)
        share[: self.n_classes] = np.stack([np.ones(self.n_classes), self.begins], axis=1)
        at, seen, first, opens, left = self._cut(ids, lengths)
        want, own = self.group[at], self.in_class[ids]
        base = (p["B"] + MASK).astype(np.float32)
        told, begun = np.empty((2, len(first), SCORED), dtype=np.float32)
        for low in range(0, len(first), BLOCK):  # blocks that stay in the cache
            line, place = _line(seen, first[low : low + BLOCK])
            y = self._attend(tables, line, base, opens[low : low + BLOCK])[-1] @ tables[1]
            if y.max() > 60:
                y -= y.max(axis=1, keepdims=True)
            got = y.reshape(-1).take(np.arange(0, y.size, y.shape[1]) + want.take(place).reshape(-1)).reshape(place.shape) + own.take(place)
            np.exp(y, out=y)
            both = np.log(y @ share).reshape(*place.shape, 2)
            np.subtract(got, both[:, :, 0], out=told[low : low + BLOCK])
            np.subtract(both[:, :, 1], both[:, :, 0], out=begun[low : low + BLOCK])
        real = np.arange(SCORED) < left[:, None]
        return told[real], begun[real]

    def words(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray, known: np.ndarray) -> np.ndarray:
        """log probability of each word and end, given the places where they begin and the log frequency of each of them in training documents.

        A word has the probability of its subwords and of a beginning after them, given that one is due; mixed with its frequency.
        """
        told, begun = self.logs(ids, lengths)
        own = np.add.reduceat(told, starts, dtype=np.float64) - begun[starts] if len(starts) else np.zeros(0)
        ends = np.append(starts[1:], len(ids))
        inner = np.append(ids[starts[1:] - 1] != len(self.of_id) - 1, False) if len(starts) else np.zeros(0, bool)  # after a text's end nothing is due
        own[inner] += begun[ends[inner]]
        return np.logaddexp(own + math.log(1 - MIX), known + math.log(MIX))


#: Causal: the i-th scored place sees the context and the places up to itself.
MASK = np.where(np.arange(WINDOW)[None, :] <= np.arange(SCORED)[:, None] + CONTEXT, 0, -1e9).astype(np.float32)
#: Places of a window by its first scored one; windows that are computed at a time; ones for sums; places of each listed subword's vector in all vectors.
CELL, BLOCK = np.arange(WINDOW) - CONTEXT, 128
ONES = np.ones(max(SUBWORDS, BLOCK * SCORED), dtype=np.float32)
PLACES = np.arange(SUBWORDS * DIM).reshape(SUBWORDS, DIM)


def _windows(rows: np.ndarray, n: int, size: int, row: int, low: int, wide: int) -> np.ndarray:
    """Of rows one after another a view: from a row on, n windows of so many rows, each SCORED rows after the one before, and so many columns from ``low`` on."""
    one, along = rows.itemsize, rows.strides[0]
    return np.ndarray((n, size, wide), rows.dtype, rows, row * along + low * one, (SCORED * along, along, one))


def _line(seen: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each place of adjoining windows, after CONTEXT more before the first of them; and the windows' places, where a text ends early some that do not count."""
    place = np.minimum(first[:, None] + CELL[CONTEXT:], len(seen) - 1)
    return np.append(seen.take(np.maximum(first[0] + CELL[:CONTEXT], 0)), seen.take(place)), place

CHUNK_SCHEMA = "chunk long, ids array<long>, out binary, lengths binary, codes binary, words array<string>, flat binary, tf array<long>, ends long, after array<long>, run array<long>, held array<long>, places binary"


def _chunks(batches: Iterator[pa.RecordBatch], subwords: Subwords) -> Iterator[pa.RecordBatch]:
    """Rows of texts in, chunks out: distinct words with their subwords and counts in training documents, and documents as lengths and indexes of words."""

    def chunk(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts)
        out = rows.column("held_out").to_numpy()
        split = pc.ascii_split_whitespace(pc.ascii_lower(rows.column("text").cast(pa.string()).combine_chunks()))
        split = split.combine_chunks() if isinstance(split, pa.ChunkedArray) else split
        words, offsets = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
        ends = np.append(0, np.cumsum(real))[offsets - offsets[0]]
        told = words.filter(pa.array(real)).dictionary_encode()
        lengths, codes = np.diff(ends), told.indices.to_numpy().astype(np.int32)
        tf = np.bincount(codes[np.repeat(~out, lengths)], minlength=len(told.dictionary))
        flat, _ = subwords(told.dictionary)
        columns = {
            "chunk": pa.array([rows.column("row_id")[0].as_py()], pa.int64()), "ids": _one(rows.column("doc_id").combine_chunks()), "out": pa.array([out.tobytes()], pa.binary()), "lengths": pa.array([lengths.astype(np.int64).tobytes()], pa.binary()),
            "codes": pa.array([codes.tobytes()], pa.binary()), "words": _one(told.dictionary), "flat": pa.array([flat.astype(subwords.kind).tobytes()], pa.binary()), "tf": _one(pa.array(tf.astype(np.int64))), "ends": pa.array([int((~out).sum())], pa.int64()),
        }
        at, size, after, run = anchors(told.dictionary, codes, lengths)
        _, first, place = np.unique(_mixed(after.view(np.uint64)) ^ run.view(np.uint64), return_index=True, return_inverse=True)
        held_in = np.bincount(place, weights=~np.repeat(out, lengths + 1)[at], minlength=len(first)).astype(np.int64)
        places = np.stack([at, size, place]).astype(np.int32)
        columns |= {"after": _one(pa.array(after[first])), "run": _one(pa.array(run[first])), "held": _one(pa.array(held_in)), "places": pa.array([places.tobytes()], pa.binary())}
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    held: list[pa.RecordBatch] = []
    room = CHUNK_BYTES
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy() + 1)
        low = 0
        while low < len(batch):
            done = int(sizes[low - 1]) if low else 0
            high = min(int(np.searchsorted(sizes, done + room)) + 1, len(batch))
            held.append(batch.slice(low, high - low))
            room -= int(sizes[high - 1]) - done
            low = high
            if room <= 0:
                yield chunk(held)
                held, room = [], CHUNK_BYTES
    if held:
        yield chunk(held)


def held_out(id_col: str, fold: int = 10) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % fold == 0, F.lit(False))


def _unpack(chunk: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(chunk["out"], bool), np.frombuffer(chunk["lengths"], np.int64), np.frombuffer(chunk["codes"], np.int32)


def _texts(batches: Iterator[pa.RecordBatch], subwords: Subwords) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each chunk the subwords of all its training documents one after another, ends included, and how many each document has."""
    for batch in batches:
        for i in range(len(batch)):
            out, lengths, codes = _unpack({c: batch.column(c)[i].as_py() for c in ("out", "lengths", "codes")})
            flat, size = subwords.stored(batch.column("flat")[i].as_py())
            every = np.insert(codes[np.repeat(~out, lengths)], np.cumsum(lengths[~out]), len(size) - 1)  # the end is the last "word"
            if len(every):
                doc = np.repeat(np.arange(int((~out).sum())), lengths[~out] + 1)
                yield spread(flat, size, every), np.bincount(doc, weights=size[every]).astype(np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D) >> np.uint64(1)


def anchors(words: pa.Array, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where runs of the memory begin among the words and ends of a chunk's documents, how long they are, and hashes of the pair before each and of the run.

    A run ends with its document, and the next one begins after it.
    """
    hashes = np.append(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False), np.uint64(1)) if len(words) else np.ones(1, dtype=np.uint64)
    all_ = hashes[np.insert(codes, np.cumsum(lengths), len(words))]
    last = np.cumsum(lengths + 1)
    pair = np.zeros(len(all_), dtype=np.uint64)
    pair[2:] = _mixed(all_[:-2] * np.uint64(0x9E3779B97F4A7C15) + all_[1:-1])
    picked = np.flatnonzero(pair % np.uint64(MEMORY) == 0)
    doc = np.searchsorted(last, picked, side="right")
    inside = picked - (last - lengths - 1)[doc] >= 2
    picked, doc = picked[inside], doc[inside]
    kept, free = [], 0
    for k, i in enumerate(picked.tolist()):
        if i >= free:
            kept.append(k)
            free = i + RUN
    at, doc = picked[kept], doc[kept]
    size = np.minimum(RUN, last[doc] - at)
    run = np.zeros(len(at), dtype=np.uint64)
    for j in range(RUN):
        run = _mixed(run * np.uint64(0xD6E8FEB86659FD93) + np.where(j < size, all_[np.minimum(at + j, len(all_) - 1)], np.uint64(0)) + np.uint64(j + 1))
    return at, size, pair[at].view(np.int64), run.view(np.int64)


def recalled(own: np.ndarray, at: np.ndarray, size: np.ndarray, often: np.ndarray, total: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """What each run adds to the log probability of its words: their ``own`` without the memory, and how often the run, all runs and different runs stood after its pair.

    All but one of the occurrences of each run count; what is left, one for each different run, goes to the words as they are.
    """
    sums = np.append(0, np.cumsum(own))
    plain = sums[at + size] - sums[at]
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(np.maximum(often - 1, 0) / total), np.log(kinds / total) + plain) - plain


def windows_of(ids: np.ndarray, out: np.ndarray, lengths: np.ndarray, codes: np.ndarray, words: list[str] | pa.Array, subwords: Subwords, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """A hash and WINDOW + 1 subword ids of windows of a chunk's training documents, that share of them which the hash picks; -1 before a text's beginning and after its end."""
    turn = _mixed(ids.astype(np.uint64))
    first = np.where(out, np.int64(1 << 62), (turn % np.uint64(STRIDE)).astype(np.int64))
    per = np.maximum(0, -(-(lengths + 1 - first) // STRIDE))  # the end is a word
    doc = np.repeat(np.arange(len(ids)), per)
    place = first[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
    own = _mixed(turn[doc] + place.astype(np.uint64))
    if share < 1:
        doc, place, own = (x[own % np.uint64(1 << 30) < share * (1 << 30)] for x in (doc, place, own))
    begin = place == 0
    n = np.minimum(WINDOW + 1, lengths[doc] + 1 - place)  # words, of which the last may be the end
    line = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(place, n)
    starts = np.cumsum(lengths) - lengths
    is_end = line == np.repeat(lengths[doc], n)
    some = np.where(is_end, -1, codes[np.minimum(np.repeat(starts[doc], n) + line, max(len(codes) - 1, 0))]) if len(codes) else np.full(len(line), -1)
    used = np.unique(some[some >= 0])
    flat, size = subwords(words.take(pa.array(used)) if isinstance(words, pa.Array) else [words[i] for i in used.tolist()])
    some = np.where(some >= 0, np.searchsorted(used, some), len(used))
    window = np.repeat(np.repeat(np.arange(len(doc)), n), size[some])
    ids_ = spread(flat, size, some)
    total = np.bincount(window, minlength=len(doc))
    at = np.arange(len(window)) - np.repeat(np.cumsum(total) - total, total)
    # a text's first window has the end of another text and no more before it; others begin within a word too
    at += np.where(begin, CONTEXT + 1, -(own % np.uint64(3)).astype(np.int64) * (total > 3))[window]
    told = np.full((len(doc), WINDOW + 1), -1, dtype=np.int32)
    told[begin, CONTEXT] = subwords.end
    inside = (at >= 0) & (at <= WINDOW)
    told[window[inside], at[inside]] = ids_[inside]
    return own.astype(np.int64), told


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Learns from documents whose crc32(id) mod ``fold`` is not 0. A-Z are lower-cased, tokens are words free
    of white space and an end. ``base_score`` is the unigram log10 probability, ``score`` the model's of the
    same words as subwords, with what it remembers of repeated runs; how much white space stood between words is not scored. A null text is empty: an
    end alone. Repeated rows count and are scored each. A null id is trained on and comes back null. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, fold).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    told = materialize(rows.mapInArrow(lambda batches: _chunks(batches, Subwords.of(ranks.value)), CHUNK_SCHEMA), "chunks")
    counts = told.select(F.explode(F.arrays_zip("words", "tf")).alias("w")).groupBy(F.col("w.words").alias("word")).agg(F.sum("w.tf").alias("c")).filter("c > 0")
    counts = materialize(counts.withColumn("level", F.floor(F.log2("c") * 8).cast("int")), "words")
    levels = sorted(counts.groupBy("level").agg(F.count(F.lit(1)), F.sum("c")).collect(), reverse=True)  # at most 8 x 64 rows
    n_ends = int(told.agg(F.coalesce(F.sum("ends"), F.lit(0))).first()[0])
    n, v = sum(int(r[2]) for r in levels) + n_ends, sum(int(r[1]) for r in levels) + (n_ends > 0)
    bar, room = 1 << 20, TOP_WORDS
    for level, distinct, _ in levels:
        room -= distinct
        if room < 0:
            break
        bar = level
    frequent = counts.filter(F.col("level") >= bar)
    top = spark.sparkContext.broadcast([x.combine_chunks() for x in frequent.select("word", "c").toArrow().columns])
    rest = told.select("chunk", F.posexplode("words").alias("idx", "word")).join(F.broadcast(frequent.select("word")), "word", "left_anti")
    rest = rest.join(counts.filter(F.col("level") < bar), "word").select(F.col("chunk").alias("of"), "idx", "c")

    runs = told.select("chunk", F.posexplode(F.arrays_zip("after", "run", "held")).alias("place", "r")).select("chunk", "place", "r.*")
    seen = materialize(runs.groupBy("after", "run").agg(F.sum("held").alias("often")).filter("often > 0"), "runs")
    after = seen.groupBy("after").agg(F.sum("often").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > kinds")  # pairs after which some run is repeated
    after = materialize(after, "repeated")
    n_runs = int(seen.agg(F.coalesce(F.sum("often"), F.lit(0))).first()[0])
    found = attach(runs.select("chunk", "place", "after", "run"), after, "after", "total", n_runs).filter("total IS NOT NULL")
    found = found.join(seen.join(after.select("after"), "after", "left_semi"), ["after", "run"], "left")
    found = found.select(F.col("chunk").alias("of"), (-1 - F.col("place")).alias("idx"), F.coalesce("often", F.lit(0).cast("long")).alias("c"), "total", "kinds")
    rest = rest.select("of", "idx", "c", *[F.lit(None).cast("long").alias(c) for c in ("total", "kinds")]).unionByName(found)

    model = spark.sparkContext.broadcast(_fit(told, ranks, n_ends, n))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        names = left.column("words").combine_chunks().flatten()
        ids = left.column("ids").combine_chunks().flatten()
        out, lengths, codes = _unpack({c: left.column(c)[0].as_py() for c in ("out", "lengths", "codes")})
        c = np.zeros(len(names) + 1, dtype=np.int64)
        at = pc.index_in(names, value_set=top.value[0]).fill_null(-1).to_numpy(zero_copy_only=False) if len(top.value[0]) else np.full(len(names), -1)
        c[:-1][at >= 0] = top.value[1].to_numpy()[at[at >= 0]]
        idx = right.column("idx").to_numpy()
        c[idx[idx >= 0]] = right.column("c").to_numpy()[idx >= 0]
        c[-1] = n_ends  # the end of a text is the last "word"
        flat, size = Subwords.of(ranks.value)(names)  # shuffled they would take 0.3 x the input of disk
        every = np.insert(codes, np.cumsum(lengths), len(names))  # with the end of each text
        doc = np.repeat(np.arange(len(ids)), lengths + 1)
        base = np.bincount(doc, weights=np.log10((c + 0.1) / (n + 0.1 * (v + 1)))[every], minlength=len(ids))
        known = np.bincount(doc, weights=c[every] > 0, minlength=len(ids)).astype(np.int64)
        own = np.bincount(doc, weights=size[every], minlength=len(ids)).astype(np.int64)
        with np.errstate(divide="ignore"):
            often = np.log(c / max(n, 1))
        starts = np.cumsum(size[every]) - size[every]
        logs = model.value.words(spread(flat, size, every), starts, own, often[every])
        total = np.bincount(doc, weights=logs, minlength=len(ids))
        old = right.filter(pa.array(idx < 0))
        if len(old):
            row = np.full(len(left.column("after")[0]), -1)
            row[-1 - old.column("idx").to_numpy()] = np.arange(len(old))
            at, long, place = np.frombuffer(left.column("places")[0].as_py(), np.int32).reshape(3, -1)
            hit = row[place] >= 0
            more = recalled(logs, at[hit], long[hit], *(old.column(x).to_numpy()[row[place[hit]]] for x in ("c", "total", "kinds")))
            total += np.bincount(doc[at[hit]], weights=more, minlength=len(ids))
        return pa.table({
            "doc_id": ids, "held_out": out, "n_tokens": lengths + 1, "n_known": known, "train_tokens": np.full(len(ids), n, dtype=np.int64),
            "base_score": base, "score": total / math.log(10),
        })

    left = told.select("chunk", "ids", "out", "lengths", "codes", "words", "after", "places").groupBy("chunk")
    return left.cogroup(rest.groupBy("of")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _fit(told: DataFrame, ranks, n_ends: int, n_tokens: int) -> Model:
    """The model of all training documents: counts and neighbours of all their subwords, and attention trained on every one of them where it lies."""
    spark = told.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(Subwords.of(ranks.value).end + 1, dtype=np.int64)
        for batch in batches:
            for i in range(len(batch)):
                flat, size = Subwords.of(ranks.value).stored(batch.column("flat")[i].as_py())
                tf = batch.column("tf").slice(i, 1).flatten().to_numpy()
                total += np.bincount(flat[:-1], weights=np.repeat(tf, size[:-1]), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["id", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids = batch.column("ids").slice(i, 1).flatten().fill_null(0).to_numpy(zero_copy_only=False)
                _, some = windows_of(ids, *_unpack({c: batch.column(c)[i].as_py() for c in ("out", "lengths", "codes")}), batch.column("words").slice(i, 1).flatten(), Subwords.of(ranks.value), share)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeBinaryArray.from_buffers(pa.binary(some.shape[1] * 4), len(some), [None, pa.py_buffer(some.tobytes())]).cast(pa.binary())], ["ids"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = first.value.k
        total = np.zeros(k * k, dtype=np.int64)
        for ids, lengths in _texts(batches, Subwords.of(ranks.value)):
            at, seen = first.value._cut(ids, lengths)[:2]  # the end of another text stands before each
            total += np.bincount(seen * k + at, minlength=k * k)
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], ["pair", "n"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = warm.value
        n = own.learn(_texts(batches, Subwords.of(ranks.value)), lambda t: RATE * min(1.0, t / 8))
        if n:
            flat = np.concatenate([own.p[x].reshape(-1) for x in sorted(own.p)])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64) * n), pa.array(np.full(len(flat), n))], ["at", "value", "n"])

    subwords = Subwords.of(ranks.value)
    found = {int(r[0]): int(r[1]) for r in told.select("flat", "tf").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n")).collect()}  # a row a subword
    model = Model(found | {subwords.end: n_ends}, subwords.starts)
    if not n_ends:
        return model
    first = spark.sparkContext.broadcast(model)
    texts = told.select("out", "lengths", "codes", "flat")
    seen = texts.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()  # at most SUBWORDS^2 rows
    order = np.argsort(seen.column("pair").to_numpy())
    model.set_classes(seen.column("pair").to_numpy()[order], seen.column("n").to_numpy()[order])
    share = min(1.0, WARM_WINDOWS * STRIDE / n_tokens)
    sample = told.select("ids", "out", "lengths", "codes", "words").mapInArrow(cut, "ids binary").toArrow()
    if len(sample):
        sample = np.frombuffer(b"".join(sorted(sample.column("ids").to_pylist())), dtype=np.int32).reshape(-1, WINDOW + 1)
        steps, rng = min(WARM_STEPS, WARM_PASSES * -(-len(sample) // BATCH)), np.random.default_rng(SEED)
        model.train((sample[rng.integers(0, len(sample), BATCH)] for _ in range(steps)), lambda t: WARM_RATE * min(1.0, t / 40) * (1 - 0.7 * t / steps))
    warm = spark.sparkContext.broadcast(model)
    mean = texts.mapInArrow(train, "at long, value double, n long").groupBy("at").agg((F.sum("value") / F.sum("n")).alias("value")).orderBy("at").toArrow()  # a row a parameter
    flat, low = mean.column("value").to_numpy().astype(np.float32), 0
    for name in sorted(model.p):
        shape = model.p[name].shape
        model.p[name] = flat[low : low + math.prod(shape)].reshape(shape)
        low += math.prod(shape)
    return model
