"""Alignment against whole texts through both libraries, byte by byte, in plain Python."""

import hashlib
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellum.llm import alignment, queries


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(docs, both):
    """Owners of each byte by either tokenizer; links and groups follow from these."""
    a, b = both
    byte = alignment.byte_of()
    told, pair = [], Counter()
    for i, text in docs:
        ids_a = a.encode(" " + (text or ""), add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in a.id_to_token(t)) for t in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(t)[3:5], 16)]) if b.is_byte(t) else b.id_to_piece(t).replace("▁", " ").encode() for t in ids_b]
        if not text or not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            told.append((i, [], [], [], []))
            continue
        own_a, own_b = ([k for k, x in enumerate(xs) for _ in x] for xs in (bytes_a, bytes_b))
        links = sorted(set(zip(own_a, own_b, strict=True)))
        pair.update((ids_a[x], ids_b[y]) for x, y in links)
        groups, from_a, from_b = [], 0, 0
        for k in range(len(own_a)):
            if k + 1 == len(own_a) or own_a[k] < own_a[k + 1] and own_b[k] < own_b[k + 1]:
                groups.append(",".join(map(str, ids_a[from_a : own_a[k] + 1])) + "|" + ",".join(map(str, ids_b[from_b : own_b[k] + 1])))
                from_a, from_b = own_a[k] + 1, own_b[k] + 1
        told.append((i, ids_a, ids_b, [(ids_a[x], ids_b[y]) for x, y in links], groups))
    best = Counter()
    for (_, y), n in pair.items():
        best[y] = max(best[y], n)
    return [(i, len(x), len(y), len(g), len(k), sum(pair[p] == best[p[1]] for p in k), sum(pair[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, x, y, k, g in told]


TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  ", "a  b   c", "x \n y\n z\t w", "\n", "<|endoftext|> <s> </s> <unk> <0x41>", "▁ a", "a▁b", "naïve café Ελλάδα 日本語テキスト 🙂🙃 ཀ་ཁ", "\x00\x01 a\x85 b  c　d", "\U0010ffff end", "don't 12345 3.14",
    "lorem ipsum dolor sit amet " * 3000, "é" * 3000, "🙂" * 2000, " " * 3000 + "x", "é ‍﻿ x", "ﬁ ½ ℌ",
]


def test_whole_texts(spark, both):
    docs = [*enumerate(TEXTS)] * 2 + [(None, "no id here"), (None, "no id here")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("a", "b", "chunk", "place", "count", "best", "told", "row_id")}).repartition(3)
    assert sorted(map(str, map(tuple, alignment.align_texts(table).collect()))) == sorted(map(str, brute(docs, both)))
    assert alignment.align_texts(table.limit(0)).count() == 0


def test_query(spark, sf, both):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_alignment(spark, sf).collect()) == sorted(brute(docs, both))


def test_small_chunks(spark, both, monkeypatch):
    """A chunk a document: pairs are counted over chunks, and each chunk gets back its own."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    docs = [(i, f"word{i % 7} and žluťoučký kůň {i % 3}") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    assert alignment._encoded(table, "doc_id", "text", None, None).count() == 60
    assert sorted(tuple(r) for r in alignment.align_texts(table).collect()) == sorted(brute(docs, both))


def test_only_recurring_units_stay_known(both, monkeypatch):
    """Units that a slice alone has are forgotten after it, whatever a task goes through; what is made of a slice stays the same."""
    for name, value in (("MOST_KNOWN", 300), ("MOST_KEPT", 100)):
        monkeypatch.setattr(alignment, name, value, raising=False)
    tokenizers = alignment.Tokenizers(both[0].to_str(), both[1].serialized_model_proto())
    aligner, most = alignment.Aligner(tokenizers), 0
    for k in range(5):
        docs = [f"the same words é \U0001f642 and{k}x{i} more{i % 7} ▁" for i in range(400)] + ["", "lone  blanks \n x"]
        rows = pa.RecordBatch.from_arrays([pa.array([k] * len(docs)), pa.array(range(len(docs)))], ["row_id", "doc_id"])
        texts = [d.encode() for d in docs]
        told, anew = (alignment._chunk(x, rows, texts) for x in (aligner, alignment.Aligner(tokenizers)))
        for c in ("chunk", "ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "a", "b", "often"):
            assert told.column(c).equals(anew.column(c)), c
        most = max(most, len(aligner.units.codes))
    assert most < 1000  # of over 2,000 units
    assert {b" same", b" words", b" more3"} <= set(aligner.units.codes)


def test_no_task_gathers_chunks(spark, both, monkeypatch):
    """A chunk is some megabytes: row groups have few of them, and no aggregate holds the pairs of many."""
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 40)
    made, materialize = [], alignment.materialize
    monkeypatch.setattr(alignment, "materialize", lambda df, name, **options: made.append((name, out := materialize(df, name, **options))) or out)
    docs = [(i, f"word{i % 7} and žluťoučký kůň {i % 3}") for i in range(60)]
    told = alignment.align_texts(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in dict(made)["chunks"].inputFiles()]
    sizes = [m.row_group(k).num_rows for m in files for k in range(m.num_row_groups)]
    assert sum(sizes) == 60 and max(sizes) <= 4
    assert "collect_list" not in told._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in told.collect()) == sorted(brute(docs, both))


def test_chunk_without_pairs(spark, both, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 1)
    docs = [(1, None), (2, ""), (3, "a▁b"), (4, None)]
    assert sorted(map(str, map(tuple, alignment.align_texts(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()))) == sorted(map(str, brute(docs, both)))
