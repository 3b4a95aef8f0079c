"""The near-dedup stage against brute force over all pairs, and groups dealt out in blocks."""

import random

import corpus_pipeline
from vellum.llm import near_copies

ALIKE = 0.8


def shingles(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)}).split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({" ".join(words)} if words else set())


def groups(texts, alike=ALIKE):
    """Least index of each text's group, and the number of unequal pairs that are alike."""
    sets, label, pairs = [shingles(x) for x in texts], list(range(len(texts))), 0

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            x, y = sets[i], sets[j]
            if x == y or (min(len(x), len(y)) >= alike * max(len(x), len(y)) and len(x & y) / len(x | y) >= alike):
                pairs += x != y
                low, high = sorted((top(i), top(j)))
                label[high] = low
    return [top(i) for i in range(len(texts))], pairs


def edited(rng, n):
    """Texts of about 100 words, each followed by copies with a few words changed."""
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(60, 140))]
        for changes in (0, 1, 1, 2, 3, 5):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(len(words))] = f"w{rng.randrange(5000)}"
            out.append(" ".join(words))
    return out[:n]


def frame(spark, texts):
    return spark.createDataFrame([(i, x, "en", "a", len(x or "")) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_stage_keeps_one_of_each_group_of_near_copies(spark, sf):
    texts = edited(random.Random(4), 600) + ["", None, " ", "a b c", "A b  c", "a b c d"]
    want, pairs = groups(texts)
    assert pairs > 200
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, texts), sf).collect()}
    assert kept == set(want)


def test_groups_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want, _ = groups([x for _, x in docs])
    got = {r.row_id: r.group_id for r in near_copies.row_groups(frame(spark, [x for _, x in docs]), "doc_id").collect()}
    assert [got[i] for i in range(len(docs))] == want


def test_blocks_lose_no_pair(spark, monkeypatch):
    """A chain: each text is near its neighbours only, and all share the keys' hot shingles."""
    rng = random.Random(9)
    words = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(120):
        words[rng.randrange(100)] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    want, _ = groups(texts)
    monkeypatch.setattr(near_copies, "BLOCK_NODES", 8)
    got = {r.row_id: r.group_id for r in near_copies.row_groups(frame(spark, texts), "doc_id").collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_stage_keeps_one_row_of_each_group_whatever_the_ids(spark, sf):
    a, b, c, d = ("alpha beta gamma delta one", "epsilon zeta eta theta two", "iota kappa lambda mu three", "nu xi omicron pi four")
    rows = [(None, a), (None, b), (None, b), (None, c), (5, c), (7, d), (7, "rho sigma tau upsilon five"), (3, "phi chi psi omega six"), (2, "phi chi psi omega six"), (2, "phi chi psi omega six")]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()), key=str)
    assert got == sorted([(None, a), (None, b), (5, c), (7, d), (7, rows[6][1]), (2, rows[7][1])], key=str)
