"""Nulls, empty and very long texts, ties, repeated rows, empty tables, and extra columns whose names clash."""

import hashlib
import random
import struct
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import chat, common, decontamination, exact_dedup, langid, lm, mixing, queries, secrets, sharding, simhash, warc

EXTRA = ["hash", "slot", "bucket", "words", "anchor", "label", "fp", "shard", "text_sha256", "row_id", "kept", "value", "maybe", "found", "k", "size", "cell", "item_id", "key", "held_out", "chunk", "owner", "repo"]
LONG = "lorem ipsum dolor sit amet " * 20_000
DOCS = [
    (1, "Hello World again and again", "en", "a"), (2, "hello world AGAIN and again", "en", None), (3, None, None, "a"), (4, "", "en", "b"), (5, " \n\t", "de", "b"), (6, LONG, "la", "b"),
    (7, "Hello World again and again", "en", "a"), (7, "Hello World again and again", "en", "a"), (None, "no id here", None, None), (None, "nor has this one", None, "b"), (8, "1234 5678 !!", "en", "c"), (9, "Ünï çödé\x85x y ퟿\U0001f600", None, "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.createDataFrame([(*r, len(r[1] or "")) for r in DOCS], "doc_id long, text string, lang string, source string, n_chars long")
    return base.withColumns({c: F.lit("clash") for c in EXTRA})


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def test_chat(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 2, "assistant", "b<cut>\\h"), (1, 1, "user", None), (1, 2, "assistant", "b<cut>\\h"), (1, None, None, "x"), (1, 3, "a: ###", "</turn>\n### user: \\"), (None, 1, "assistant", ""), (2, 1, "assistant", "é" * 100_000)]
    told = chat.format_chats(spark.createDataFrame(rows, schema).withColumns({c: F.lit(0) for c in ("turns", "blocks", "starts", "formatted", "t")}))
    got = {r.conv_id: r for r in told.withColumn("back", chat.read_chats(F.col("formatted"))).collect()}
    assert [tuple(t) for t in got[1].back] == [("", "x"), ("user", ""), ("assistant", "b<cut>\\h"), ("assistant", "b<cut>\\h"), ("a: ###", "</turn>\n### user: \\")]
    assert [tuple(t) for t in got[None].back] == [("assistant", "")]
    assert got[1].formatted.count("### ") == 4  # the two assistant turns are one block
    digest = {r.conv_id: r.loss_sha256 for r in chat.chat_digest(told).collect()}
    bare = told.withColumn("loss_mask", F.transform("loss_mask", lambda x: F.struct(F.lit(0).alias("skip"), F.lit(0).alias("take"), x["loss"].alias("loss"))))
    assert {r.loss_chars for r in chat.chat_digest(bare).collect()} == {0}  # the mask alone says what counts
    for r in got.values():
        assert digest[r.conv_id] == hashlib.sha256("".join(t.text for t in r.back if t.role == "assistant").encode()).hexdigest()
        at, under = 0, []
        for run in r.loss_mask:
            at += run.skip
            under += [r.formatted[at : at + run.take]] * run.loss
            at += run.take
        plain = [x.replace("\\l", "<").replace("\\h", "#").replace("\\b", "\\") for x in under]
        assert plain == [t.text for t in r.back if t.role == "assistant"]
    assert chat.chat_digest(chat.format_chats(spark.createDataFrame([], schema))).count() == 0


def test_long_conversations(spark):
    """Sixteen thousand turns by turns of two roles, and of one role alone."""
    rows = spark.range(32_000).select((F.col("id") % 2).alias("conv_id"), F.col("id").alias("turn"), F.when((F.col("id") % 2 == 0) & (F.col("id") % 4 < 2), "user").otherwise("assistant").alias("role"), F.concat(F.lit("é#text "), F.repeat(F.lit("x"), 200), "id").alias("text"))
    began = time.monotonic()
    got = {r.conv_id: r for r in chat.chat_digest(chat.format_chats(rows)).collect()}
    assert time.monotonic() - began < 40
    for c in (0, 1):
        text = [f"é#text {'x' * 200}{i}" for i in range(c, 32_000, 2) if c or i % 4 >= 2]
        assert (got[c].n_turns, got[c].loss_sha256) == (16_000, hashlib.sha256("".join(text).encode()).hexdigest())


def test_exact_dedup(docs, none):
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs).collect())
    assert got == [(0, None, 1, True), (0, None, 1, True), (1, 7, 4, False), (2, 7, 4, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 4, True), (7, 7, 4, True), (8, 8, 1, True), (9, 9, 1, True)]
    assert exact_dedup.exact_groups(none).count() == 0


def test_bloom_lets_unique_rows_through_and_misses_no_repeat(spark):
    hashes = spark.range(4000).select(F.sha2((F.col("id") % 3500).cast("string"), 256).alias("text_sha256"), "id")
    bits, _ = exact_dedup.filter_bits(4000)
    told = exact_dedup.maybe_repeated(hashes, exact_dedup.repeated_slots(hashes, bits), bits).collect()
    maybe = {r.id for r in told if r.maybe}
    assert len(told) == 4000 and maybe >= {i for i in range(4000) if i % 3500 < 500} and len(maybe) < 1300
    assert exact_dedup.filter_bits(10**12) == (exact_dedup.MOST_BITS, 1 << 16)
    # several classes, each with a filter of its own, give the same groups as one
    rows = spark.range(9000).select((F.col("id") % 7000).cast("string").alias("text"), F.when(F.col("id") % 100 > 0, F.col("id")).alias("doc_id"))
    one, many = (sorted(map(str, exact_dedup.exact_groups(rows, most_bits=m).collect())) for m in (1 << 20, 1 << 16))
    assert exact_dedup.filter_bits(9000, 1 << 16)[1] == 4 and one == many and len(one) == 9000


def test_attach_routes_hot_keys(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("key"), "id")
    stats = rows.groupBy("key").agg(F.count("id").alias("n"), F.max("id").alias("m"))
    got = common.attach(rows, stats, "key", "n", 5000).collect()
    assert len(got) == 5000 and all(r.m == (4998 if r.key == 0 else r.id) for r in got if r.key or r.n > 1)


def test_language(docs, none, spark):
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == got[8].lang_pred == "und"
    assert got[6].lang_pred == "la" and got[1].lang_pred == "en" and got[1].score == 1.0
    cells = langid.CHUNK_CELLS
    words = langid.Words([t for _, t, _, _ in DOCS if t])
    try:
        langid.CHUNK_CELLS = 30 * len(model.languages)  # gathered in stretches of 30 characters
        short = words.sums(model.weights)
    finally:
        langid.CHUNK_CELLS = cells
    assert short == pytest.approx(words.sums(model.weights), abs=1e-2)
    assert langid.fit(none).languages == [] and langid.identify(none, model).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"}


def test_language_spans_and_scripts(spark):
    text = {"en": "the quick brown fox jumps over the lazy dog and then the other one", "de": "der schnelle braune fuchs springt über den faulen hund und dann noch einer", "ru": "быстрая лиса прыгает через ленивую собаку"}
    model = langid.fit(spark.createDataFrame([(i, t, k) for i, (k, t) in enumerate(text.items())], "doc_id long, text string, lang string"))
    assert model.spans(f"{text['en']}, {text['de']}! {text['ru']}.") == [("en", 14), ("de", 13), ("ru", 6)]
    # a single foreign word does not win a span
    assert [k for k, _ in model.spans("the quick brown hund jumps over the lazy dog")] == ["en"]


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5):
        e = rng.normal(0, 3, (n, 3)).astype(np.float32)
        paths = np.stack(np.meshgrid(*[range(3)] * n, indexing="ij"), -1).reshape(-1, n)
        value = e[np.arange(n), paths].sum(1) - 2.0 * (paths[:, 1:] != paths[:, :-1]).sum(1)
        assert langid.viterbi(e, np.array([n]), 2.0).tolist() == paths[value.argmax()].tolist()


def test_long_texts_in_many_languages_are_labelled_in_stretches(monkeypatch):
    rng = np.random.default_rng(7)
    model = langid.Model([f"l{k}" for k in range(40)], rng.normal(0, 1, (langid.BUCKETS, 40)).astype(np.float32), np.ones((len(langid.SCRIPTS) + 1, 40), bool))
    text = " ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(3000))
    whole = model.predict([text])
    monkeypatch.setattr(langid, "CHUNK_CELLS", 4000)
    assert model.predict([text]) == whole and model.predict(["", text[:300]])[0] == ("und", 0.0, 0)
    # a quarter of a million words in five hundred languages are 500 MB of scores, and half of that again of pointers
    monkeypatch.setattr(langid, "CHUNK_CELLS", 8_000_000)
    model = langid.Model([f"l{k}" for k in range(500)], rng.normal(0, 1, (langid.BUCKETS, 500)).astype(np.float32), np.ones((len(langid.SCRIPTS) + 1, 500), bool))
    tracemalloc.start()
    label = model._labels(langid.Words(["word and wort " * 83_000]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(label) == 249_000 and len(set(label[1000:-1000])) == 1 and peak < 200e6


def test_secrets(spark, docs, none):
    schema = "doc_id long, text string, lang string, source string"
    key, example, mine = "AKIA" + "Q" * 16, "xK9vQ2mB7zL4tR8wN3yP6", "Zr5cW1jH8dF3sG6aU9eM2"
    rows = [(i, f"id {example} end", "en", f"s{i % 5}") for i in range(10)] + [(20, f"only {mine}", "en", "s0"), (21, f"PASSWORD = 'abc' token:\"abcdef\" {key} {'a1' * 12}", "en", "s1"), (22, None, None, None)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[i].spans == "" and got[i].n_example == 0 for i in range(10))  # five owners have it: an example
    assert got[20].spans == "random:5:26" and got[20].n_live == 1
    assert got[21].spans == "assign:17:30,access:32:52,hex:53:77" and (got[21].n_assign, got[21].n_access, got[21].n_hex) == (1, 1, 1)
    assert (got[22].spans, got[22].base_sha256) == ("", hashlib.sha256(b"").hexdigest())
    assert (got[20].reach, got[21].reach) == ("1:1", "1:1,1:1,1:1")
    # two owners, but six repositories: an example; two of them: neither that nor live
    rows = [(i, f"id {example} end", f"l{i % 3}", f"s{i % 2}") for i in range(6)] + [(6 + i, f"id {mine} end", "en", f"s{i}") for i in range(2)]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[i].spans == "" for i in range(6)) and all((got[i].reach, got[i].n_live, got[i].n_example) == ("2:2", 0, 0) for i in (6, 7))
    assert secrets.find_secrets(docs).count() == len(DOCS) and secrets.find_secrets(none).count() == 0
    assert secrets.scan("ſecret=abcdef") == []  # only ASCII letters in either case


def test_warc(spark):
    schema = "page_id long, url string, html string"
    rows = [(5, "http://x/ \r\nWARC-Type: y", "same"), (2, None, "same"), (9, "u", None), (8, "u", ""), (-3, "é", "Ünï" * 50_000), (2, "u", "same"), (None, "u", "same"), (1, "u", "own")]
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in warc.round_trip(spark.createDataFrame(rows, schema).withColumn("key", F.lit(1))).collect())
    assert [(k[1], *rest) for k, *rest in got] == [(-3, 250_000, "response", None), (1, 3, "response", None), (2, 4, "response", None), (2, 4, "response", None), (5, 4, "revisit", 2), (8, 0, "response", None), (9, 0, "revisit", 8), (0, 4, "revisit", 2)]
    assert warc.round_trip(spark.createDataFrame([], schema)).count() == 0
    apart = warc.round_trip(spark.createDataFrame(rows, schema), min_bytes=5).collect()
    assert all(r.record_type == "response" for r in apart)


def test_warc_of_other_tools():
    """Records of each type as crawlers write them: chunks, no length, no payload digest, ids and digests of other sorts; errors only for damage."""
    sha = warc.sha1_base32

    def made(kind, block, *more, version="WARC/1.1", drop=""):
        head = [version, f"WARC-Type: {kind}", "WARC-Date: 2021-02-03T04:05:06Z", "WARC-Record-ID: <urn:uuid:12345678-1234-1234-1234-1234567890ab>", f"Content-Length: {len(block)}", *more]
        return "\r\n".join(x for x in head if not drop or not x.startswith(drop)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    http, page = b"HTTP/1.1 200 OK\r\nServer: x\r\n", b"<html>x</html>"
    chunked = http + b"Transfer-Encoding: chunked\r\n\r\n6\r\n<html>\r\n8;a=b\r\nx</html>\r\n0\r\n\r\n"
    good = {
        made("warcinfo", b"software: x\r\nformat: WARC\r\n", "Content-Type: application/warc-fields", version="WARC/1.0"): b"software: x\r\nformat: WARC\r\n",
        made("response", http + b"\r\n" + page, "Content-Type: application/http; msgtype=response"): page,
        made("response", http + b"\r\n" + page, f"WARC-Payload-Digest: sha1:{sha(page)}", "WARC-Concurrent-To: <urn:a>", "WARC-Concurrent-To: <urn:b>"): page,
        made("response", http + b"\r\n" + page, "WARC-Payload-Digest: md5:abc", "WARC-Block-Digest: md5:abc"): page,
        made("response", chunked, f"WARC-Payload-Digest: sha1:{sha(page)}"): page,
        made("response", chunked, f"WARC-Payload-Digest: sha1:{sha(chunked.partition(bytes([13, 10, 13, 10]))[2])}"): page,
        made("response", b"a dns answer", "Content-Type: text/dns"): b"a dns answer",
        made("request", b"GET / HTTP/1.1\r\nHost: x\r\n\r\n", "Content-Type: application/http; msgtype=request"): b"",
        made("metadata", b"via: y\r\n", "WARC-Refers-To: <urn:c>"): b"via: y\r\n", made("resource", page): page, made("conversion", b"text"): b"text", made("continuation", b"more"): b"more",
        made("revisit", http + b"\r\n", "WARC-Refers-To-Target-URI: http://x/", "WARC-Payload-Digest: sha1:ABC"): None,
    }
    for raw, payload in good.items():
        r = warc.parse_record(raw)
        assert (r["payload"], r["page_id"], r["refers_to"]) == (payload, None, None)
        assert payload is None or r["payload_bytes"] == len(payload)
    bad = [made("response", http + b"\r\n" + page, drop=x) for x in ("WARC-Type", "WARC-Date", "WARC-Record-ID", "Content-Length")]
    bad += [made("other", page), made("response", page), made("response", chunked[:-14]), made("response", http + b"Content-Length: 3\r\n\r\n" + page), made("revisit", http + b"\r\n"), made("resource", page, f"WARC-Block-Digest: sha1:{sha(b'')}")]
    for raw in bad:
        with pytest.raises(ValueError):
            warc.parse_record(raw)
    own = warc.parse_record(warc.record(None, "u", b"x", sha(b"x"), 1, None))
    assert own["page_id"] is None and warc.parse_record(warc.record(-5, "u", b"x", sha(b"x"), 1, None))["page_id"] == -5


def test_warc_finds_damage():
    rows = [warc.record(i, "u", b"data %d" % i, warc.sha1_base32(b"data %d" % i), 6, None) for i in range(3)]
    d = b"x" * 64
    zip_ = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), write_checksum=True)
    frames = [zip_.compress(r) for r in rows]
    for inner in (d, zstandard.ZstdCompressor().compress(d)):  # a plain and a compressed dictionary
        head = struct.pack("<II", warc.DICT_MAGIC, len(inner)) + inner
        assert [r["page_id"] for r in warc.read_archive(head + b"".join(frames))] == [0, 1, 2]
    cut = list(warc.read_archive(head + b"".join(frames)[:-3]))
    assert [r["page_id"] for r in cut] == [0, 1, None] and "cut frame" in cut[2]["error"]
    # frames without the size of their content, and skippable frames between records
    loose = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False)
    stream = loose.compressobj()
    skip = struct.pack("<II", warc.SKIP_MAGIC + 3, 5) + b"hello"
    mixed = head + skip + loose.compress(rows[0]) + skip + stream.compress(rows[1]) + stream.flush() + frames[2] + skip
    assert [(r["page_id"], r["error"]) for r in warc.read_archive(mixed)] == [(0, None), (1, None), (2, None)]
    # a damaged frame costs one record: reading goes on at the next
    for k in range(3):
        for broken in (frames[k][:-9] + b"\xff" * 9, frames[k][: len(frames[k]) // 2], b"\x00" * 7 + frames[k][5:]):
            told = list(warc.read_archive(head + b"".join([*frames[:k], broken, *frames[k + 1 :]])))
            assert [r["page_id"] for r in told if not r["error"]] == [i for i in range(3) if i != k] and sum(bool(r["error"]) for r in told) == 1
    for bad in (rows[0].replace(b"data 0", b"data 1"), rows[0].replace(b"WARC-Date", b"X"), rows[0].replace(b"Content-Length: ", b"Content-Length: 9"), b"nonsense"):
        (r,) = warc.read_archive(head + zip_.compress(bad))
        assert r["error"] and r["page_id"] is None


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "Hello world again and again"), (2, "hello"), (3, None), (4, " "), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l")], "item_id long, text string").withColumn("words", F.lit(1))
    got = {(r.doc_id, r.item_id) for r in decontamination.find_items(docs, items).collect()}
    assert got == {(d, i) for d in (1, 2, 7) for i in (1, 2)}
    near = spark.createDataFrame([(1, "x a b c d e f g h i j k y"), (2, "a b c d e f g h i z k l")], "doc_id long, text string")
    assert [(r.doc_id, r.n_shingles, r.n_found) for r in decontamination.find_items(near, items.filter("item_id = 5")).collect()] == [(1, 8, 7)]
    for most in (0, 1_000_000):  # joined by a shuffle, or broadcast
        assert {(r.doc_id, r.item_id) for r in decontamination.find_items(docs, items, most_broadcast=most).collect()} == got
    assert decontamination.find_items(none, items).count() == 0 and decontamination.find_items(docs, items.limit(0)).count() == 0


def test_shuffled_search_over_whole_tables(spark):
    """Beyond the bound of what is broadcast probes pass a bitmap of the sketches: the same pairs, from few stored probes."""
    sf = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{sf}/{name}.parquet") for name in ("documents", "benchmark"))
    one, many = (sorted(map(str, decontamination.find_items(docs, items, most_broadcast=m).collect())) for m in (1_000_000, 0))
    assert one and one == many
    slots = spark.createDataFrame([(1,), (8,), (9,), (32768,), (32769,), (65536,)], "slot long")
    told = exact_dedup.with_bit(spark.range(1, 65537), F.col("id"), exact_dedup.slot_bitmaps(slots), "there").filter("there")
    assert sorted(r.id for r in told.collect()) == [1, 8, 9, 32768, 32769, 65536]


def test_sketch_is_large_enough():
    import math

    for n in range(1, 3000):
        assert decontamination.sketch_size(n.bit_length() - 1) >= n - math.ceil(0.8 * n) + 1


def test_mixing(docs, none):
    got = mixing.mix_counts(docs).collect()
    assert len(got) == len(DOCS) and all(0 <= r.taken <= 2 * r["size"] for r in got)
    texts = mixing.mix_texts(docs).collect()
    assert sum(len(r.text.encode().split()) for r in texts) == sum(r.taken for r in got)  # bytes know ASCII white space only
    assert mixing.mix_counts(none).count() == 0
    whole = mixing.mix_counts(docs, block_words=None).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in whole)


def test_mixing_draws_are_disjoint_and_exact(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 600), f"s{i % 4}") for i in range(300)]
    documents, draws = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    seen = draws.groupBy("row_id", "block", "copy").count().filter("count > 1").count()
    per_shard = [r["count"] for r in draws.groupBy("shard").count().collect()]
    assert seen == 0 and len(per_shard) == 8 and max(per_shard) - min(per_shard) <= 3
    tree = mixing.splitting_tree([1000, 10, 0, 555], 7, 1)
    assert tree.sum(axis=1).tolist() == [1000, 10, 0, 555] and np.ptp(tree.sum(axis=0)) <= 3 and (tree >= 0).all()
    assert (mixing.splitting_tree([3_000_000_000, 1_000_000_000], 4, 1).sum(axis=1) == [3_000_000_000, 1_000_000_000]).all()


def test_hypergeometric_beyond_the_range_of_numpy():
    """The proposal's odds, summed over all outcomes, give the exact distribution; large draws have its mean and spread."""
    import math

    good, bad, take = 40, 60, 30
    p = take / (good + bad)
    a = np.arange(1, 30)
    log = np.array([math.lgamma(good + 1) - math.lgamma(x + 1) - math.lgamma(good - x + 1) + x * math.log(p) + (good - x) * math.log(1 - p) for x in a]) + mixing._log_binomial(take - a, bad, p)
    want = np.array([math.comb(good, x) * math.comb(bad, take - x) / math.comb(good + bad, take) for x in a])
    assert np.exp(log - log.max()) == pytest.approx(want / want[log.argmax()], rel=1e-5)
    rng = np.random.default_rng(5)
    x = np.array([mixing.hypergeometric(rng, 30_000_000_000, 50_000_000_000, 20_000_000_000) for _ in range(1500)])
    sd = math.sqrt(2e10 * 0.375 * 0.625 * 0.75)
    assert abs(x.mean() - 7.5e9) < 4 * sd / 1500**0.5 and abs(x.std() / sd - 1) < 0.08


def test_the_tree_decides_what_the_mix_takes(spark, monkeypatch):
    rows = [(None if i % 3 else 5, "w " * (i % 300), f"s{i % 4}") for i in range(300)]
    schema = "doc_id long, text string, source string"
    say = lambda got: sorted(map(str, got.collect()))
    plain = say(mixing.mix_counts(spark.createDataFrame(rows, schema)))
    assert plain == say(mixing.mix_counts(spark.createDataFrame(rows[::-1], schema).repartition(5)))  # in whatever order
    tree = mixing.splitting_tree
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, seed: np.eye(1, n, dtype=np.int64) * np.array(q)[:, None])
    first = mixing.mix_counts(spark.createDataFrame(rows, schema)).collect()
    assert all(r.by_shard[0] == r.taken and not any(r.by_shard[1:]) for r in first) and sorted(map(str, first)) != plain
    monkeypatch.setattr(mixing, "splitting_tree", lambda q, n, seed: tree(q, n, seed) // 2)
    assert sum(r.taken for r in mixing.mix_counts(spark.createDataFrame(rows, schema)).collect()) < 0.6 * sum(r.taken for r in first)


def test_lm(docs, none):
    got = lm.score_texts(docs).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(DOCS) and by[3].n_tokens == by[4].n_tokens == by[5].n_tokens == 1 and by[6].n_tokens == 100_001
    assert all(np.isfinite(r.score) and r.score < 0 and r.n_known <= r.n_tokens for r in got)
    assert lm.score_texts(none).count() == 0


def lm_model(k):
    """A model over k subwords, of which the even ones begin a word; the last is the end."""
    starts = np.arange(k + 1) % 2 == 0
    starts[k] = True
    model = lm.Model({i: i + 1 for i in range(k)}, starts)
    pairs, often = np.unique(np.random.default_rng(0).integers(0, model.k**2, 5000), return_counts=True)
    model.set_classes(pairs, often)
    return model


def test_lm_gradients():
    rng = np.random.default_rng(1)
    model = lm_model(50)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    ids, valid = rng.integers(0, 40, (2, lm.WINDOW)), rng.random((2, lm.WINDOW)) > 0.1
    target, known = rng.integers(0, 40, (2, lm.SCORED)), rng.random((2, lm.SCORED)) > 0.2
    _, grads = model.gradients(ids, valid, target, known)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, eps, losses = model.p[name][at], 1e-5, []
        for d in (eps, -eps):
            model.p[name][at] = old + d
            losses.append(model.gradients(ids, valid, target, known)[0])
        model.p[name][at] = old
        assert (losses[0] - losses[1]) / (2 * eps) == pytest.approx(g[at], rel=1e-2, abs=1e-4), name


def test_lm_scores_are_probabilities_and_do_not_depend_on_neighbours():
    model = lm_model(80)
    losses = model.train((np.random.default_rng(t).integers(0, 60, (64, lm.WINDOW + 1)) % 7 for t in range(60)), lambda t: 0.01)
    assert losses[-1] < losses[0]
    # all continuations of one text add up to one, and so do those that begin a word
    ones = np.concatenate([[4, 7, x] for x in range(81)])
    told, begun = model.logs(ones, np.full(81, 3))
    last = np.exp(told[2::3].astype(float))
    assert last.sum() == pytest.approx(1, abs=1e-4) and last[model.starts[model.of_id]].sum() == pytest.approx(np.exp(begun[2]), abs=1e-4)
    texts = [np.random.default_rng(k).integers(0, 81, n) for k, n in enumerate((1, 16, 17, 33, 100))]
    apart = [model.logs(t, np.array([len(t)])) for t in texts]
    both = model.logs(np.concatenate(texts), np.array([len(t) for t in texts]))
    for x, y in zip(both, zip(*apart, strict=True), strict=True):
        assert x == pytest.approx(np.concatenate(y), rel=1e-3, abs=1e-4)


def test_lm_windows_lie_at_every_stride_of_training_texts():
    with open(lm.TOKENIZER, "rb") as f:
        subwords = lm.Subwords.of(f.read())
    words = [f"w{i}x" for i in range(1000)]
    lengths, out = np.array([0, 1000, 700, 3]), np.array([False, False, True, False])
    codes = np.random.default_rng(3).integers(0, 1000, lengths.sum())
    found = []
    for k in range(0, 2000, 4):  # over many ids each place of a text is as likely as any other
        _, some = lm.windows_of(np.arange(k, k + 4), out, lengths, codes, words, subwords)
        found.append(len(some))
        for line in some.tolist():
            head = next(i for i, x in enumerate(line) if x >= 0)
            body = [x for x in line if x >= 0]
            assert head in (0, lm.CONTEXT) and (head == 0 or line[head] == subwords.end)
            assert all(x < 0 for x in line[head + len(body) :]) and (len(body) + head == len(line) or body[-1] == subwords.end)
            assert subwords.end not in body[head > 0 : -1]
    assert sum(found) / 500 == pytest.approx((1 + 1001 + 4) / lm.STRIDE, rel=0.05)


def test_lm_learns_from_every_subword():
    """Each subword of each text is a target once, with the same slopes as `gradients` gives."""
    model, rng = lm_model(60), np.random.default_rng(4)
    lengths = np.array([1, 16, 17, 0, 5, 900])
    ids = rng.integers(0, 60, lengths.sum())
    goals, slopes = [], []
    at, seen, first, opens, left = model._cut(ids, lengths)
    place = np.clip(first[:, None] + lm.CELL, 0, len(at) - 1)
    known = np.arange(lm.SCORED) < left[:, None]
    assert sorted(place[:, lm.CONTEXT :][known].tolist()) == list(range(len(ids)))
    valid = np.ones(place.shape, dtype=bool)
    valid[opens, : lm.CONTEXT] = False
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    _, want = model.gradients(seen[place], valid, at[place[:, lm.CONTEXT :]], known)
    got = model.slopes(model._tables(), seen[place], opens, model.group[at[place[:, lm.CONTEXT :]]].reshape(-1), known.reshape(-1) / known.sum())
    assert sorted(got) == sorted(want) and all(got[k] == pytest.approx(want[k], rel=1e-4, abs=1e-7) for k in want)
    model = lm_model(60)
    plain = model.slopes

    def told(tables, x, first, want, weight):
        goals.extend(want[weight > 0].tolist())
        slopes.append(weight.sum())
        return plain(tables, x, first, want, weight)

    model.slopes = told
    old = -model.logs(ids, lengths)[0].mean()
    assert model.learn(iter([(ids, lengths)] * 30), lambda t: 0.01) == 30 * len(ids)
    assert sorted(goals) == sorted(30 * model.group[model.of_id[ids]].tolist()) and sum(slopes) == pytest.approx(30)
    assert -model.logs(ids, lengths)[0].mean() < old


def test_lm_looks_each_place_up_once(monkeypatch):
    """Windows share what they see, in blocks of any size, and words come from Arrow as from a list."""
    model, rng = lm_model(60), np.random.default_rng(5)
    lengths = np.array([300, 1, 0, 40, 16, 200])
    ids = rng.integers(0, 60, lengths.sum())
    want, attend, looked = model.logs(ids, lengths), model._attend, []
    n = len(model._cut(ids, lengths)[2])
    model._attend = lambda tables, line, *more: looked.append(len(line)) or attend(tables, line, *more)
    for block in (1, 3, 128):
        monkeypatch.setattr(lm, "BLOCK", block)
        for x, y in zip(model.logs(ids, lengths), want, strict=True):
            assert x == pytest.approx(y, rel=1e-3, abs=1e-4)
        looked.clear()
        model.learn(iter([(ids, lengths)]), lambda t: 0.0)
        assert sum(looked) == n * lm.SCORED + -(-n // block) * lm.CONTEXT
    with open(lm.TOKENIZER, "rb") as f:
        subwords = lm.Subwords.of(f.read())
    for words in (["ab", "überall", "c" * 200, "語"], []):
        for x, y in zip(subwords(words), subwords(pa.array(words, pa.string())), strict=True):
            assert x.tolist() == y.tolist()


def test_lm_trains_on_whole_training_documents(spark):
    """What a task trains on is every training document, each to its end, and nothing held out."""
    rows = [(i, "ab cd " * (3 + i % 5)) for i in range(40)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.h for r in docs.select(lm.held_out("doc_id").alias("h")).collect()]
    with open(lm.TOKENIZER, "rb") as f:
        subwords = lm.Subwords.of(f.read())
    batch = docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", lm.held_out("doc_id").alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).coalesce(1).toArrow().combine_chunks().to_batches()
    ((ids, lengths),) = lm._texts(lm._chunks(iter(batch), subwords), subwords)
    want = [[*subwords((t or "").split())[0]] for (_, t), h in zip(rows, out, strict=True) if not h]
    assert lengths.tolist() == [len(x) for x in want] and ids.tolist() == [y for x in want for y in x] and any(out)


def test_sharding(docs, none):
    got = sharding.shard_rows(docs, 3).collect()
    assert len(got) == len(DOCS) and len({r.shard for r in got if r.doc_id in (1, 7)}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.shard_rows(none).count() == 0


def test_sharding_is_exact_over_groups(spark, monkeypatch):
    """With cells of two or four bits, which hold many groups, the largest shard is as small as over single groups."""
    monkeypatch.setattr(sharding, "LEVEL_BITS", 2)
    rng = random.Random(8)
    for bits, n, shards in ((2, 40, 3), (4, 300, 8), (2, 90, 5)):
        monkeypatch.setattr(sharding, "CELL_BITS", bits)
        texts = ["x" * rng.choice([1, 5, 30, 200]) + str(i) for i in range(n)]
        rows = [(i, rng.choice(texts)) for i in range(3 * n)] + [(None, None)] * 9
        got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards).collect()
        size = {}
        for _, t in rows:
            key = hashlib.sha256((t or "").encode()).hexdigest()
            size[key] = size.get(key, 0) + len(t or "") + 1
        _, best = sharding.minimax_cuts(np.array([size[k] for k in sorted(size)]), shards)
        held = [sum(r["size"] for r in got if r.shard == s) for s in range(shards)]
        assert max(held) <= best and len(got) == len(rows)
        for s in range(shards):
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_minimax_against_all_cuts():
    import itertools

    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 50]) for _ in range(rng.randint(1, 9))]
        n = rng.randint(1, 4)
        cuts, cap = sharding.minimax_cuts(np.array(sizes), n)
        best = min(max(sum(sizes[a:b]) for a, b in zip((0, *c), (*c, len(sizes)), strict=True)) for c in itertools.combinations_with_replacement(range(len(sizes) + 1), n - 1))
        ends = [*cuts[1:], len(sizes)]
        assert cap == best == max(sum(sizes[a:b]) for a, b in zip(cuts, ends, strict=True)) and cuts == sorted(cuts)


def test_simhash(docs, none):
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    assert got[3].fingerprint == got[4].fingerprint == got[5].fingerprint == "0" * 16 and {got[i].component_id for i in (3, 4, 5)} == {3}
    assert got[7].component_id == got[2].component_id == 1
    assert simhash.simhash_groups(docs).count() == len(DOCS) and simhash.simhash_groups(none).count() == 0


def test_pipeline(spark, docs, none, sf):
    out = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, sf)
        if name == "language_id":
            assert {r.doc_id for r in out.collect()} == {1, 2, 6, 7, 9, None}
        if name == "simhash_near_dedup":
            assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 6, 9, None, None]
        if name != "sharding":
            assert out.columns == corpus_pipeline.COLUMNS
            assert stage(spark, none.select(*corpus_pipeline.COLUMNS), sf).count() == 0
    assert out.count() >= 3


def test_pipeline_takes_out_copies_and_passages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.decontaminate(spark, docs, sf)
    leaks = {r.doc_id for r in queries.op6_decontamination(spark, sf).collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - leaks
    mixed = corpus_pipeline.mix_sources(spark, docs, sf)
    assert max(r["count"] for r in mixed.groupBy("doc_id").count().collect()) <= 2
    assert mixed.join(docs, ["doc_id", "text"], "left_anti").count() == 0
