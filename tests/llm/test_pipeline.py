"""The whole pipeline over the smallest tables against plain Python, stage after stage."""

import hashlib
import re
from collections import Counter

import corpus_pipeline

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, k=5):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def test_run(spark, sf):
    docs = [d for d in spark.read.parquet(f"{sf}/documents.parquet").collect() if any(c.isalpha() for c in d.text or "")]
    sets = {d.doc_id: runs(d.text) for d in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = [d for d in docs if find(d.doc_id) == d.doc_id]
    assert len(kept) < len(docs)
    items = [(min(5, len(WORD.findall(r.text or ""))), runs(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    holds = lambda text: any(s and len(s & runs(text, k)) >= 0.8 * len(s) for k, s in items)
    clean = {d.doc_id: d for d in kept if not holds(d.text)}
    assert len(clean) < len(kept)

    rows = corpus_pipeline.run(spark, sf).collect()
    taken = Counter(r.doc_id for r in rows)
    size = {i: len(WORD.findall(d.text)) for i, d in clean.items()}
    assert set(taken) <= set(clean) and max(taken.values()) <= 2
    sources = sorted({d.source for d in clean.values()})
    total = {s: sum(size[i] for i, d in clean.items() if d.source == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 2 * total[s]}
        target |= {s: 2.0 * total[s] if s in over else weight[s] * unit for s in over or open_}
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s in sources:
        mine = [i for i, d in clean.items() if d.source == s]
        assert abs(sum(taken[i] * size[i] for i in mine) - target[s]) <= max(size[i] for i in mine)

    held = Counter()
    for r in rows:
        assert r["size"] == len(clean[r.doc_id].text.encode()) + 1
        held[r.shard] += r["size"]
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    groups = Counter()
    for r in rows:
        groups[hashlib.sha256(clean[r.doc_id].text.encode()).hexdigest()] += r["size"]
    order = [groups[k] for k in sorted(groups)]

    def enough(capacity):
        n, at = 1, 0
        for x in order:
            n, at = (n, at + x) if at + x <= capacity else (n + 1, x)
        return n <= 8

    assert max(held.values()) == next(c for c in range(max(order), sum(order) + 1) if enough(c))
