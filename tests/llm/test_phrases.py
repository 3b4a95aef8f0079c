"""Phrase mining against a count of every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vellum.llm import phrases

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, top, least=10):
    count, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total["und" if lang is None else lang] += len(words)
            for m in (1, 2, 3):
                count["und" if lang is None else lang].update(tuple(words[i : i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, c in count.items():
        rows = []
        for p, a in c.items():
            if len(p) > 1 and a >= least:
                score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                if len(p) == 3 or not any(100 * n >= 50 * a for q, n in longer(c, least).get(p, ())):
                    rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def longer(c, least, made={}):  # noqa: B006
    if id(c) not in made:
        made.clear()
        made[id(c)] = found = defaultdict(list)
        for q, n in c.items():
            if len(q) == 3 and n >= least:
                for part in {q[:2], q[1:]}:
                    found[part].append((q, n))
    return made[id(c)]


def test_random_texts(spark):
    """Few words and many ties; levels are lowered several times, since few phrases are let in at first."""
    rng = random.Random(1)
    word = lambda: rng.choice("abcdefghij") * rng.choice([1, 1, 2]) + rng.choice(["", "é", "B"])
    fixed = [" ".join(word() + "x" for _ in range(4)) for _ in range(6)]
    docs = []
    for i in range(400):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else word() for _ in range(rng.randint(0, 60))]
        docs.append(("".join(x + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ". "]) for x in parts), rng.choice(["en", "fr", None, "und"])))
    table = spark.createDataFrame(docs, "text string, lang string").repartition(5)
    for top in (3, 40, 2000):
        assert sorted(tuple(r) for r in phrases.mine_phrases(table, top=top).collect()) == brute(docs, top)


def test_a_longer_phrase_ends_what_is_inside_it_from_the_left_too(spark):
    docs = [("the big apple", "en")] * 12 + [("the big", "en")] * 30 + [("a pear", "en")] * 9 + [("big apple", "en")] * 12 + [("lone", "fr")] * 50
    got = [tuple(r) for r in phrases.mine_phrases(spark.createDataFrame(docs, "text string, lang string")).collect()]
    assert sorted(got) == brute(docs, 2000)
    assert {r[2] for r in got} == {"the big apple", "the big"}  # 12 of 24: half of "big apple" is inside


def test_edges(spark):
    """Nulls, empty and long texts, repeated rows, clashing columns, no rows."""
    long = "lorem ipsum dolor sit amet " * 20_000
    docs = [(None, None), ("", "en"), (" \t.\n", "en"), (long, "la"), (long, "la"), ("x" * 100_000, "en"), ("\x00 \x1f \x85 a b" * 12, None), ("ẞ ß " * 11, "de")]
    table = spark.createDataFrame(docs, "text string, lang string").withColumns({c: F.lit("clash") for c in ("word", "id", "chunk", "n", "score", "level", "row_id", "f")})
    assert sorted(tuple(r) for r in phrases.mine_phrases(table).collect()) == brute(docs, 2000)
    assert phrases.mine_phrases(table.limit(0)).count() == 0


def test_scores_of_counts_beyond_64_bits(spark):
    row = spark.createDataFrame([(999_999_999_999_999, 999_999_999_999_999, 1_000_000_000_000_000 - 1)], "a long, l long, r long").select(phrases._score("a", "l", "r").alias("s"))
    assert row.first().s == 1_000_000


def test_a_crowded_bitmap_counts_more_and_loses_nothing(spark):
    docs = [(f"w{i % 50} w{i % 50 + 1} w{i % 50 + 2} and w{i % 7}", "en") for i in range(1500)]
    table = spark.createDataFrame(docs, "text string, lang string")
    want = brute(docs, 30)
    was = phrases.LEAST_BITS, phrases.MOST_BITS
    phrases.LEAST_BITS = phrases.MOST_BITS = 1 << 15
    try:
        assert sorted(tuple(r) for r in phrases.mine_phrases(table, top=30).collect()) == want
    finally:
        phrases.LEAST_BITS, phrases.MOST_BITS = was
