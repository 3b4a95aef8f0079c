"""Registered queries of the training-data operators against plain Python over the whole of a small table."""

import base64
import hashlib
import math
import random
import re
import string
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from vellum.llm import langid, lm, queries, secrets, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def by_id(spark, sf, name, key="doc_id"):
    rows = queries.QUERIES[name](spark, sf).collect()
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def crc(x):
    return zlib.crc32(str(x).encode())


def test_chat(spark, sf):
    got = by_id(spark, sf, "op1_chat_format", "conv_id")
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role, r.text or ""))
    turns[-7] = [(0, "user", queries.CONTROL_TEXT), (1, "assistant", queries.CONTROL_TEXT)]
    assert got.keys() == turns.keys()
    for c, t in turns.items():
        t.sort()
        loss = "".join(x for _, role, x in t if role == "assistant")
        assert got[c].n_turns == len(t)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in t).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_exact_dedup(spark, sf, docs):
    got = by_id(spark, sf, "op2_exact_dedup")
    groups = defaultdict(list)
    for d in docs:
        groups[(d.text or "").translate(LOW)].append(d.doc_id)
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i])[1:] == (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())


def test_language_id(spark, docs):
    sf = "/root/testdata/sf0.01"
    got = by_id(spark, sf, "op3_language_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = [d for d in docs if crc(d.doc_id) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {d.doc_id for d in held}
    assert all(0 <= r.score <= 1 for r in got.values())
    right = sum(got[d.doc_id].lang_pred == d.lang for d in held)
    assert right / len(held) > 0.97


def test_language_id_by_hand(spark, sf, docs, monkeypatch):
    """Language and score of each text by plain loops over its words, from the tables that were learned."""
    models, fit = [], langid.fit
    monkeypatch.setattr(langid, "fit", lambda *a, **k: models.append(fit(*a, **k)) or models[-1])
    got = by_id(spark, sf, "op3_language_id")
    (model,) = models
    n = len(model.languages)
    scripts = [(a, b, k) for k, ranges in enumerate(langid.SCRIPTS.values(), 1) for a, b in ranges]
    marks = lambda c: unicodedata.category(c)[0] == "M"
    hard = 0
    for d in docs:
        words = [w for w in re.split("\0", "".join(c if c.isalpha() or marks(c) else "\0" for c in d.text or "")) if w]
        if not any(c.isalpha() for w in words for c in w):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
            continue
        value, back = None, []
        for w in words:
            low = [ord(c.lower()) if c.isalpha() and len(c.lower()) == 1 and ord(c) < 0x20000 else ord(c) for c in w]
            padded, e = [1, *low, 1], np.zeros(n)
            for a, b, c in zip(padded, padded[1:], padded[2:]):
                e += model.weights[(a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32 >> 16]
            script = next((k for a, b, k in scripts if a <= ord(w[0]) <= b), 0)
            if model.scripts[script].any():
                e[~model.scripts[script]] = -1e4
            if value is None:
                value, came = e, None
            else:
                best = int(value.argmax())
                came = [best if value[best] - langid.SWITCH > value[k] else k for k in range(n)]
                value = np.array([max(value[best] - langid.SWITCH, value[k]) for k in range(n)]) + e
            back.append(came)
        label, letters = int(value.argmax()), np.zeros(n)
        near = np.diff(np.sort(value)[-2:])[0] < 1e-2  # paths as good as each other may end either way
        for w, came in zip(reversed(words), reversed(back)):
            letters[label] += sum(c.isalpha() for c in w)
            label = came[label] if came else label
        share = np.sort(letters)[::-1] / letters.sum()
        if near or (n > 1 and share[0] - share[1] < 0.02):
            continue
        hard += 1
        assert got[d.doc_id].lang_pred == model.languages[int(letters.argmax())]
        assert got[d.doc_id].score == pytest.approx(share[0], abs=0.02)
    assert hard > 0.9 * sum(bool(d.text) for d in docs)


def test_secrets(spark, sf, docs):
    got = by_id(spark, sf, "op4_secret_scan")
    assign = re.compile(r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for d in docs:
        t = d.text or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if m.end() - m.start() >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 24]
        said = [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans)]
        r = got[d.doc_id]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in spans) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("random")] == said


def test_secret_ownership(spark):
    """Spans that only look random, and how far each value has spread, by plain loops over a table with such values."""
    rng = random.Random(4)
    value = lambda: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789+/_-") for _ in range(rng.randint(20, 40)))
    one, two, three, five, six = (value() + "7x" for _ in range(5))
    rows = [(one, "en", "s0")] * 7 + [(two, "en", f"s{i % 2}") for i in range(6)] + [(three, "en", f"s{i}") for i in range(3)]
    rows += [(five, f"l{i % 5}", "s0") for i in range(10)] + [(six, f"l{i}", "s0") for i in range(6)]
    rows += [(rng.choice([one, three, six, value()]) + " " + rng.choice([two, five, value(), "f" * 30]), rng.choice([None, "en", "l1"]), rng.choice([None, "s0", "s1", "s5"])) for _ in range(300)]
    rows += [(f'api_key = "{rng.choice([two, three, "abcdef123"])}" {"a1" * 13} AKIA{"Z9" * 9}', "en", f"s{i}") for i in range(8)] + [("1" * 30, "en", "s0"), (None, None, None)]
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string").repartition(3)
    docs, got = table.collect(), {r.doc_id: r for r in secrets.find_secrets(table).collect()}
    owners, repos, found = defaultdict(set), defaultdict(set), {}
    kinds = [("assign", secrets.ASSIGN, 6), ("access", secrets.ACCESS, 20), ("hex", secrets.HEX, 24)]
    for d in docs:
        t = d.text or ""
        spans = [(m.start(), k, m.end(), m[m.lastindex or 0]) for k, (_, p, least) in enumerate(kinds) for m in p.finditer(t) if len(m[m.lastindex or 0]) >= least]
        for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", t):
            s, often = m[0], Counter(m[0])
            bits = -sum(x / len(s) * math.log2(x / len(s)) for x in often.values())
            if any(c in "0123456789" for c in s) and not s.isdigit() and bits >= 3.5 and not any(a < m.end() and b > m.start() for a, _, b, _ in spans[: len(spans)]):
                spans.append((m.start(), 3, m.end(), s))
        found[d.doc_id] = sorted(spans)
        for *_, v in spans:
            owners[v].add(d.source or "")
            repos[v].add((d.source or "", d.lang or ""))
    names = ("assign", "access", "hex", "random")
    seen = Counter()
    for i, spans in found.items():
        example = lambda v: len(owners[v]) >= 3 or len(repos[v]) >= 6
        kept = [(a, k, b, v) for a, k, b, v in spans if k < 3 or not example(v)]
        seen.update(names[k] for _, k, _, _ in kept)
        assert got[i].spans == ",".join(f"{names[k]}:{a}:{b}" for a, k, b, _ in kept)
        assert got[i].reach == ",".join(f"{len(owners[v])}:{len(repos[v])}" for *_, v in kept)
        assert (got[i].n_example, got[i].n_live) == (sum(example(v) for *_, v in kept), sum(len(owners[v]) == 1 and not example(v) for *_, v in kept))
    # one owner, two owners or five repositories are reported; three owners and six repositories are not
    alone = secrets.find_secrets(table.filter(F.col("doc_id") < 32)).collect()
    assert Counter((r.spans.startswith("random"), r.reach) for r in alone) == {(True, "1:1"): 7, (True, "2:2"): 6, (True, "1:5"): 10, (False, ""): 3 + 6}
    assert seen["assign"] and seen["random"] and seen["hex"] and seen["access"]


def test_warc(spark, sf):
    got = by_id(spark, sf, "op5_warc", "page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    first = {}
    for p in sorted(pages, key=lambda p: p.page_id):
        first.setdefault(p.html or "", p.page_id)
    assert got.keys() == {p.page_id for p in pages}
    for p in pages:
        data = (p.html or "").encode()
        to = first[p.html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert tuple(got[p.page_id]) == (p.page_id, len(data), digest, "response" if to == p.page_id else "revisit", None if to == p.page_id else to)


def test_decontamination(spark, sf, docs):
    cut = lambda t: WORD.findall((t or "").translate(LOW))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = {r.item_id: runs(cut(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for d in docs:
        have = runs(cut(d.text))
        want |= {(d.doc_id, i, len(s), len(s & have)) for i, s in items.items() if len(s & have) >= 0.8 * len(s)}
    assert {tuple(r)[:4] for r in queries.QUERIES["op6_decontamination"](spark, sf).collect()} == want


def test_mixing(spark, sf, docs):
    got = by_id(spark, sf, "op7_mixing")
    size = {d.doc_id: len(WORD.findall(d.text or "")) for d in docs}
    sources = sorted({d.source for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[d.doc_id] for d in docs if d.source == s) for s in sources}
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = {}, 1.5 * sum(total.values()), set(sources)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > 2 * total[s]}
        for s in over or open_:
            target[s] = 2.0 * total[s] if s in over else weight[s] * unit
        left -= sum(target[s] for s in over)
        open_ = open_ - over if over else set()
    for s in sources:
        mine = [d.doc_id for d in docs if d.source == s]
        assert all(got[i].source_size == total[s] and got[i].target == pytest.approx(target[s]) and got[i]["size"] == size[i] for i in mine)
        assert abs(sum(got[i].taken for i in mine) - target[s]) <= 128
        assert all(0 <= got[i].taken <= 2 * size[i] and sum(got[i].by_shard) == got[i].taken for i in mine)
    shards = [sum(r.by_shard[k] for r in got.values()) for k in range(8)]
    assert max(shards) < 1.2 * min(shards)
    again = by_id(spark, sf, "op7_mixing")
    assert got == again


def test_lm_scoring(spark, sf, docs, monkeypatch):
    """Counts and base scores, and the score of each text by plain attention, subword after subword."""
    models, fit = [], lm._fit
    monkeypatch.setattr(lm, "_fit", lambda *a: models.append(fit(*a)) or models[-1])
    got = by_id(spark, sf, "op8_lm_scoring")
    c, tokens = Counter(), {}
    for d in docs:
        tokens[d.doc_id] = [*WORD.findall((d.text or "").translate(LOW)), None]
        if crc(d.doc_id) % 10:
            c.update(tokens[d.doc_id])
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 10 == 0, len(ts), sum(c[t] > 0 for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts))
    # runs after picked pairs of words: how often each stands in training documents
    places, after = {}, defaultdict(Counter)
    for i, ts in tokens.items():
        names = sorted(set(ts[:-1]))
        at, long, _, _ = lm.anchors(pa.array(names, pa.string()), np.array([names.index(w) for w in ts[:-1]], dtype=np.int32), np.array([len(ts) - 1]))
        places[i] = [(tuple(ts[a - 2 : a]), a, tuple(ts[a : a + k])) for a, k in zip(at.tolist(), long.tolist(), strict=True)]
        assert all(len(r) == lm.RUN or r[-1] is None for _, _, r in places[i]) and all(b - a >= len(r) for (_, a, r), (_, b, _) in zip(places[i], places[i][1:], strict=False))
        if crc(i) % 10:
            for pair, _, r in places[i]:
                after[pair][r] += 1
    assert sum(map(len, places.values())) > sum(map(len, tokens.values())) / lm.MEMORY / 2
    recalled = 0
    (model,) = models
    p = {k: x.astype(float) for k, x in model.p.items()}
    with open(lm.TOKENIZER, "rb") as f:
        cut = lm.Subwords.of(f.read())
    share = {k: (model.group == k) for k in range(model.n_classes)}
    assert all(len(set(model.starts[at])) == 1 for at in share.values() if at.any())
    for i, ts in tokens.items():
        if len(ts) > 400:
            continue
        parts = [cut([w])[0][:-1].tolist() for w in ts[:-1]] + [[cut.end]]
        ids = [x for y in parts for x in y]
        before = p["E"][model.of_id[[cut.end, *ids]]]
        log, begun = [], []
        for t, x in enumerate(ids):
            low = t - t % lm.SCORED - lm.CONTEXT
            seen = range(max(0, low), t + 1)
            s = np.array([before[t] @ p["Q"] @ (before[j] @ p["K"]) / lm.DIM**0.5 + p["B"][t % lm.SCORED, j - low] for j in seen])
            a = np.exp(s - s.max())
            h = before[t] + (a / a.sum()) @ (before[seen.start : seen.stop] @ p["V"])
            y = (h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]) @ p["U"] + p["b"]
            y -= np.log(np.exp(y).sum())
            log.append(y[model.group[model.of_id[x]]] + model.in_class[x])
            begun.append(np.log(np.exp(y[model.begins]).sum()))
        each, at = [], 0
        for w, part in zip(ts, parts, strict=True):
            own = sum(log[at : at + len(part)]) - begun[at]
            at += len(part)
            own += begun[at] if w is not None else 0
            each.append(math.log10((1 - lm.MIX) * math.exp(own) + lm.MIX * c[w] / n))
        want = sum(each)
        for pair, at, r in places[i]:
            often, plain = after[pair], sum(each[at : at + len(r)])
            if sum(often.values()) > len(often):
                recalled += often[r] > 1
                want += math.log10(max(often[r] - 1, 0) / sum(often.values()) + len(often) / sum(often.values()) * 10**plain) - plain
        assert got[i].score == pytest.approx(want, rel=1e-3), i
    assert recalled
    # better on held-out texts than unigram counts of the same subwords
    ids = {i: [*cut(ts[:-1])[0]] for i, ts in tokens.items()}
    c = Counter(x for i, t in ids.items() if crc(i) % 10 for x in t)
    size = sum(c.values()) + cut.end + 1
    held = [i for i in ids if crc(i) % 10 == 0]
    assert sum(got[i].score for i in held) > 0.9 * sum(math.log10((c[x] + 1) / size) for i in held for x in ids[i])


def test_sharding(spark, sf, docs):
    got = by_id(spark, sf, "op9_sharding")
    shard, slots, bytes_ = {}, defaultdict(list), Counter()
    for d in docs:
        r, data = got[d.doc_id], (d.text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        assert shard.setdefault(d.text, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    group = Counter()
    for d in docs:
        group[d.text] += got[d.doc_id]["size"]
    # the largest shard is as small as any contiguous partition of the groups has it
    order = sorted(group, key=lambda t: hashlib.sha256((t or "").encode()).hexdigest())
    sizes = Counter()
    for t in order:
        sizes[hashlib.sha256((t or "").encode()).hexdigest()] += group[t]

    def enough(capacity):
        n, held = 1, 0
        for x in sizes.values():
            n, held = (n, held + x) if held + x <= capacity else (n + 1, x)
        return n <= 8

    best = next(c for c in range(max(-(-sum(sizes.values()) // 8), max(sizes.values())), sum(sizes.values()) + 1) if enough(c))
    assert max(bytes_.values()) == best


def test_simhash(spark, sf, docs):
    got = by_id(spark, sf, "op10_simhash")
    fps = {}
    for d in docs:
        w = WORD.findall((d.text or "").translate(LOW))
        runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in runs]
        fps[d.doc_id] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in fps}


def test_simhash_hot_anchor(spark):
    """Chains and balls of fingerprints are linked alike whether anchors are compared or go to the finest code."""
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for centre in list(fps)[:5]:
        fps |= {centre ^ (1 << i) for i in range(0, 64, 3)} | {centre ^ (1 << 63) ^ (1 << i) ^ (1 << j) for i in range(4) for j in range(4)}
        x = centre
        for i in range(0, 40, 2):
            x ^= (1 << i) | (1 << (i + 1))
            fps.add(x)
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = {}
    for f in fps:
        if f not in want:
            todo = [f]
            want[f] = f
            while todo:
                a = todo.pop()
                for b in fps:
                    if b not in want and ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                        want[b] = f
                        todo.append(b)
    for most in (2048, 3):  # with 3, crowded anchors overflow in the workers and go to the finest code
        edges = simhash.links(frame, len(fps), most)
        labels = {r.node: r.label for r in simhash.components(edges).collect()}
        assert {f: labels.get(f, f) for f in fps} == want
