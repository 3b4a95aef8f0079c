"""Encoding and decoding against the tokenizers library; the lexicon against a plain table."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import bpe, lexicon, queries, units

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Merges.of(f.read())


TEXTS = [
    None, "", " ", "  ", "   a", "a  ", "a  b", "a \n b", "a\n \n  b\t c", "\n\n x", "don't I'll we'Ve 'S", "x<|endoftext|> y", "<|endoftext|><|endoftext|>", " <|endoftext| >", "12 345é6 ½ Ⅷ", "日本語 テキスト。 ok", "é àb ‍\U0001f468‍\U0001f469", "\x00\x1c a\x85 b  c　 d᠎ e​ f",
    "�  \U0010ffff \U0001e4d0x ՘a \U0003134aö", "a" * 5000, " " * 5000 + "z", "ab " * 3000, "é" * 3000, "https://x.y/z?q=1&r=%20#f", "ÿ þ",
]


def test_whole_texts_against_the_library(spark, library):
    table = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] * 2 + [(None, "no id")], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n", "word", "ids", "level")}).repartition(3)
    got = sorted(((r.doc_id is None, r.doc_id, r.ids, r.decoded) for r in bpe.encode_texts(table, lexicon_words=20).collect()), key=str)
    want = []
    for i, t in [*enumerate(TEXTS)] * 2 + [(None, "no id")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i is None, i, ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=str)
    assert bpe.encode_digest(table.limit(0)).count() == 0


def test_query_against_the_library(spark, sf, library):
    got = {r.doc_id: tuple(r) for r in queries.op12_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert got[d.doc_id] == (d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_units_of_every_character(library, merges):
    """Every code point between letters, digits and blanks: units encode as the whole text does."""
    rng = random.Random(3)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 40_000):
        text = "".join(f"a{chr(c)} {rng.choice(['', ' ', 'b', '1', chr(10)])}" for c in points[k : k + 40_000])
        parts = units.cut(text.encode())
        assert b"".join(parts).decode() == text
        split = [w for u in parts for w in merges.words(u)]
        assert split == [text[a:b].encode() for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]
        codes, lengths = (table := units.Units(lambda new: None))([text.encode(), b"x", b"", b" y"])
        names = list(table.codes)
        assert [names[c] for c in codes] == [*parts, b"x", b" y"] and lengths.tolist() == [len(parts), 1, 0, 1]


def test_merging_words_against_the_library(library, merges):
    rng = random.Random(5)
    words = ["".join(rng.choice("aetinosrhl" if rng.random() < 0.7 else "zqé京ß") for _ in range(n)) for n in (1, 2, 5, 7, 8, 9, 20, 33, 400) for _ in range(60)]
    want = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [merges.merge(w.encode()) for w in words] == want
    ids, sizes = merges.merge_all([b"", *(w.encode() for w in words)])
    assert ids.tolist() == [i for x in want for i in x] and sizes.tolist() == [0, *map(len, want)]
    assert merges.merge_all([])[1].tolist() == []


def test_lexicon_finds_what_it_was_given_and_nothing_else(tmp_path):
    rng = random.Random(1)
    word = lambda: bytes(rng.choice(b"abc\xff\x00") for _ in range(rng.randint(0, 6)))
    for size in (0, 1, 30, 2000):
        told = {word(): tuple(rng.randint(0, 3) for _ in range(rng.randint(0, 4))) for _ in range(size)}
        path = tmp_path / f"lexicon{size}"
        path.write_bytes(lexicon.compile_lexicon(sorted(told.items())))
        asked = [*told, *(word() for _ in range(500)), b"a" * 50]
        there, sizes, ids = lexicon.Lexicon(str(path)).find(asked)
        ends = np.cumsum(sizes)
        assert [tuple(ids[e - n : e].tolist()) if t else None for t, n, e in zip(there, sizes, ends, strict=True)] == [told.get(w) for w in asked]


def test_lexicon_is_minimal(tmp_path):
    """Words with like endings share their states: no two states have the same words and outputs behind them."""
    words = sorted({(a + b + c).encode(): (len(a), 7) for a in ("re", "un", "de", "") for b in ("do", "tie", "pack") for c in ("", "s", "ed", "ing")}.items())
    path = tmp_path / "lexicon"
    path.write_bytes(lexicon.compile_lexicon(words))
    made = lexicon.Lexicon(str(path))
    behind = {}
    for state in range(len(made.finals)):  # states below come first
        arcs = [(int(k) & 255, int(t), int(o)) for k, t, o in zip(made.keys, made.targets, made.outputs, strict=True) if int(k) >> 8 == state]
        behind[state] = (int(made.finals[state]), tuple((b, behind[t], o) for b, t, o in arcs))
    assert len(set(behind.values())) == len(behind) < sum(len(w) for w, _ in words) / 5
