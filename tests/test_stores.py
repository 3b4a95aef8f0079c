"""Tables that outlive a run: caches, budgets over waves, mentions; links and sections at sizes where products would show."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from vellum.operators import corpus, enrich, links, sections
from vellum.operators.mention_store import MentionStore
from vellum.sources import bitmaps, keyed
from vellum.sources.keyed import Cache, KeyedTable

ENTRY = "vault string, node_id string, mtime long, model string"


def wanted(spark, rows):
    return spark.createDataFrame([(v, n, m, k) for v, n, m, k in rows], ENTRY)


def test_cache_hits_only_on_an_equal_stamp(spark, tmp_path):
    """A first access misses; then a hit; another time, model or version of the code is a miss; the newest entry replaces the old one."""
    make = lambda: Cache(spark, str(tmp_path / "c"), stamp="mtime long, model string, version string", buckets=4)
    row = lambda m=1, k="m", v="v1": spark.createDataFrame([("a", "n.md", m, k, v)], ENTRY + ", version string")
    assert make().misses(row()).count() == 1 and make().hits(row()).count() == 0
    make().save(row().withColumn("response", F.lit("one")))
    assert [r.response for r in make().hits(row()).collect()] == ["one"]
    assert [make().hits(x).count() for x in (row(m=2), row(k="other"), row(v="v0"))] == [0, 0, 0]
    make().save(row(m=2).withColumn("response", F.lit("two")))
    assert [r.response for r in make().entries().collect()] == ["two"] and make().hits(row()).count() == 0


def test_load_or_build(spark, tmp_path):
    rows = wanted(spark, [("a", f"{i}.md", i, "m") for i in range(20)])
    cache = Cache(spark, str(tmp_path / "c"), buckets=4)
    told, hit, built = cache.load_or_build(rows, lambda missing: missing.withColumn("response", F.upper("node_id")))
    assert (told.count(), hit, built) == (20, 0, 20)

    def never(missing):
        raise AssertionError("nothing is missing")

    told, hit, built = Cache(spark, str(tmp_path / "c")).load_or_build(rows, never)
    assert (hit, built) == (20, 0) and {r.response for r in told.collect()} == {f"{i}.MD" for i in range(20)}
    assert Cache(spark, str(tmp_path / "c")).table.buckets == 4  # the number holds


def test_vaults_are_kept_apart(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), buckets=4)
    rows = wanted(spark, [("v1", "a.md", 1, "m"), ("v2", "a.md", 1, "m")])
    cache.save(rows.withColumn("response", F.col("vault")))
    assert {(r.vault, r.response) for r in cache.hits(rows).collect()} == {("v1", "v1"), ("v2", "v2")}


def test_a_change_rewrites_touched_buckets_only_and_a_killed_one_leaves_the_old_version(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, x string", ["k"], 8)
    rows = spark.range(100).select(F.col("id").alias("k"), F.lit("old").alias("x"))
    assert table.read().count() == 0 and table.change(rows, lambda old: rows) == 1
    one = spark.createDataFrame([(5, "new")], "k long, x string")
    put = lambda old: old.join(one, "k", "left_anti").unionByName(one)
    assert table.change(one, put) == 2 and len(os.listdir(tmp_path / "t" / "data" / "v=000000000002")) <= 3  # a bucket, and marks of the commit

    def dies(old):
        table_dir = tmp_path / "t" / "data" / "v=000000000003" / "_b=0"
        table_dir.mkdir(parents=True)
        (table_dir / "half").write_text("written")
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        table.change(rows, dies)
    again = KeyedTable(spark, str(tmp_path / "t"), "k long, x string", ["k"])
    assert again.version == 2 and sorted((r.k, r.x) for r in again.read().collect()) == [(k, "new" if k == 5 else "old") for k in range(100)]
    with pytest.raises(FileExistsError):  # two changes of one version: the second fails
        again.change(one, lambda old: (table.change(one, put), old)[1])
    assert again.version == 3 and again.change(spark.range(0).withColumnRenamed("id", "k"), put) == 3
    assert again.vacuum(keep=1) > 0 and again.read().count() == 100
    table.change(rows.filter("k < 50"), lambda old: old.filter("k >= 50"))
    assert sorted(r.k for r in table.read().collect()) == list(range(50, 100))


def notes_of(spark, n, body="a " * 1500):
    return spark.createDataFrame([("v", f"n{i:02d}.md", f"n{i}", body, "atomic", 1) for i in range(n)], "vault string, node_id string, title string, body string, tier string, mtime long")


def test_a_budget_stops_between_waves_by_real_tokens(spark, tmp_path):
    thousand = lambda batch: [enrich.Reply("summary", 1000, 100) for _ in batch]
    notes = notes_of(spark, 10)
    said, used, left = enrich.summarize_within(notes, 4500, thousand, wave=2)
    assert (said.count(), left) == (6, 4)  # after 4400 tokens one more wave begins
    assert used.agg(F.sum(F.col("prompt") + F.col("completion"))).first()[0] == 6600
    assert sorted(r.node_id for r in said.collect()) == [f"n{i:02d}.md" for i in range(6)]
    assert enrich.summarize_within(notes_of(spark, 5), 2500, thousand, wave=1)[0].count() == 3
    said, used, left = enrich.summarize_within(notes, 0, thousand, wave=3)
    assert (said.count(), used.count(), left) == (0, 0, 10)
    # what the cache has costs nothing, and a second run goes on where the first ended
    cache = Cache(spark, str(tmp_path / "c"), buckets=2)
    runs = [enrich.summarize_within(notes, 3000, thousand, wave=2, cache=cache) for _ in range(3)]
    assert [(r[0].count(), r[1].count(), r[2]) for r in runs] == [(4, 4, 6), (8, 4, 2), (10, 2, 0)]


def test_summaries_are_asked_once(spark, tmp_path):
    cache = Cache(spark, str(tmp_path / "c"), buckets=2)
    notes = notes_of(spark, 6)
    first, used = enrich.summarize_notes(notes, cache=cache)
    assert used.count() == 6 and {r.cached for r in first.collect()} == {False}
    again, used = enrich.summarize_notes(notes, cache=cache)
    assert used.count() == 0 and {r.cached for r in again.collect()} == {True}
    assert sorted(r.summary for r in again.collect()) == sorted(r.summary for r in first.collect())
    changed = notes.withColumn("mtime", F.when(F.col("node_id") == "n03.md", 2).otherwise(F.col("mtime")).cast("long"))
    assert enrich.summarize_notes(changed, cache=cache)[1].count() == 1
    assert enrich.summarize_notes(changed, cache=cache, model="other")[1].count() == 6


def test_models_that_report_tokens_and_take_the_system_part(spark):
    rows = spark.createDataFrame([(1, "abc" * 10)], "k long, prompt_text string")
    mixed = lambda batch: [enrich.Reply("x" * 30, None, 5) for _ in batch]
    r = enrich.ask(rows, mixed, "p", ["k"]).first()
    assert (r.prompt, r.completion, r.cacheable) == (10, 5, False)  # the estimate stands in for what is not reported
    apart = enrich.SystemModel(lambda pairs: [f"{len(s)} {u}" for s, u in pairs])
    r = enrich.ask(rows, apart, "final", ["k"], kind="answer").first()
    from vellum.operators import prompts

    system = prompts.SYSTEM["answer"]["en"]
    assert r.response == f"{len(system)} {'abc' * 10}" and r.cacheable and r.prompt == (len(system) + 30) // 3
    assert enrich.ask(rows, apart, "summarize", ["k"], kind="summary").first().response.startswith("0 ")  # a kind without a standing part


def test_mentions_after_change_sets_equal_a_full_run(spark, tmp_path):
    rng = random.Random(3)
    store = MentionStore(spark, str(tmp_path / "m"), buckets=4)
    notes: dict[str, list] = {}
    schema = "note_id string, pos long, key string, name string, category string, description string"
    for _ in range(4):
        diff = []
        for i in range(30):
            path, draw = f"{i:02d}.md", rng.random()
            if path in notes and draw < 0.25:
                del notes[path]
                diff.append((path, "deleted"))
            elif draw < 0.6:
                diff.append((path, "modified" if path in notes else "added"))
                notes[path] = [(path, p, k, f"{k.upper()} {path}", "c", f"d{rng.random()}") for p, k in enumerate(rng.choices(["hot", "hot", "a", "b", "c"], k=rng.randint(0, 4)))]
        fresh = [m for p, kind in diff if kind != "deleted" for m in notes[p]] + [("unchanged.md", 0, "no", "No", "c", "d")]
        store.apply(spark.createDataFrame(diff, "path string, kind string"), spark.createDataFrame(fresh, schema))
        every = [m for ms in notes.values() for m in ms]
        want = {k: min((m for m in every if m[2] == k), key=lambda m: m[:2]) for k in {m[2] for m in every}}
        want = sorted((k, m[3], m[4], m[5], sum(x[2] == k for x in every), m[0]) for k, m in want.items())
        assert sorted(map(tuple, store.entities().collect())) == want == sorted(map(tuple, store.recompiled().collect()))


def test_a_change_set_moves_only_texts_of_its_notes(spark, tmp_path, monkeypatch):
    """Of 300 notes two change: others are not dealt anew, except every DEAL-th time; texts are not kept a second time by entity."""
    dealt, rng, frame = [], random.Random(5), type(spark.range(0))
    plain = frame.hint

    def hint(self, name, *a):
        if "description" in self.columns:
            dealt.append(self.count())
        return plain(self, name, *a)

    monkeypatch.setattr(frame, "hint", hint)
    monkeypatch.setattr(keyed, "DEAL", 3)
    store = MentionStore(spark, str(tmp_path / "m"), "long", buckets=2)
    schema = "note_id long, pos long, key string, name string, category string, description string"
    said = lambda i: (i, 0, f"k{i % 250}", "N", "c", "".join(rng.choices("abcdefghijklmnop", k=2000)))
    notes = {i: said(i) for i in range(300)}
    path = "path long, kind string"
    store.apply(spark.createDataFrame([(i, "added") for i in notes], path), spark.createDataFrame([*notes.values()], schema))
    for k in range(1, 3):
        notes[k] = said(k)
        del notes[100 + k]
        store.apply(spark.createDataFrame([(k, "modified"), (100 + k, "deleted")], path), spark.createDataFrame([notes[k], said(200)], schema))
    assert dealt[0] == 300 and dealt[1] < 30 and dealt[2] > 100
    want = {key: min(m for m in notes.values() if m[2] == key) for key in {m[2] for m in notes.values()}}
    want = sorted((key, "N", "c", m[5], sum(x[2] == key for x in notes.values()), m[0]) for key, m in want.items())
    size = lambda part: sum(f.stat().st_size for f in (tmp_path / "m" / part / "data" / "v=000000000001").rglob("*.parquet"))
    assert size("entities") < size("mentions") / 5
    assert store.vacuum(1) > 0  # the last version is whole
    assert sorted(map(tuple, store.entities().collect())) == want == sorted(map(tuple, store.recompiled().collect()))


def test_joins_past_a_bitmap_are_exact(spark):
    """Also where every bit is set, and for nulls; what is surely no key has not been shuffled."""
    rows = spark.range(0, 3000, 1, 3).select(F.when(F.col("id") % 10 != 9, F.col("id")).alias("k"), F.col("id").alias("x"))
    keys = spark.range(0, 3000, 7).select(F.col("id").alias("k"))
    want = {i for i in range(0, 3000, 7) if i % 10 != 9}
    assert {r.x for r in bitmaps.among(rows, keys, "k").collect()} == want
    assert {r.x for r in bitmaps.not_among(rows, keys, "k").collect()} == {*range(3000)} - want
    sure, maybe = bitmaps.apart(rows, keys, "k")
    assert not want & {r.x for r in sure.collect()} and sure.count() + maybe.count() == 3000 and maybe.count() < len(want) + 100
    assert sure.rdd.getNumPartitions() == 3
    sure, maybe = bitmaps.apart(rows, keys, "k", 1)
    assert not want & {r.x for r in sure.collect()} and sure.count() + maybe.count() == 3000


def test_links_with_a_path_meet_only_notes_that_fit(spark):
    """Ten thousand notes of one title in folders of their own; links to some of them by path."""
    n = 10_000
    notes = spark.range(n).select(F.lit("v").alias("vault"), F.concat(F.lit("d"), "id", F.lit("/x/T.md")).alias("node_id"), F.lit("T").alias("title"))
    rows = spark.range(3000).select(F.lit("v").alias("vault"), F.concat(F.lit("s"), "id").alias("source_id"), F.lit("s").alias("source_title"), F.lit(0).cast("long").alias("pos"), F.concat(F.lit("d"), "id", F.lit("/x/T")).alias("raw_target"), F.lit(None).cast("string").alias("anchor"))
    began = time.monotonic()
    strict = links.resolve_links(rows, notes, strict=True)
    assert strict.filter(F.col("target_id") == F.concat("raw_target", F.lit(".md"))).count() == strict.count() == 3000
    assert time.monotonic() - began < 60  # thirty million pairs of a title are not made
    few = spark.createDataFrame([("v", "a/b/T.md", "T"), ("v", "cb/T.md", "t"), ("v", "T.md", "T"), ("v", "b/t.md", "t")], "vault string, node_id string, title string")
    one = lambda target: spark.createDataFrame([("v", "s", "s", 0, target, None)], rows.schema)
    hit = lambda target, strict: {r.target_id for r in links.resolve_links(one(target), few, strict).collect()}
    assert hit("b/T", False) == {"a/b/T.md", "cb/T.md"} and hit("b/T", True) == {"a/b/T.md"} and hit("cb/T", True) == {"cb/T.md"}
    assert hit("T", True) == {"a/b/T.md", "cb/T.md", "T.md", "b/t.md"} and hit("x/T", False) == set() and hit("/T", False) == {"a/b/T.md", "cb/T.md"}


def test_section_tree_against_a_stack(spark):
    rng = random.Random(9)
    bodies = ["\n".join(rng.choice(["text", "", "# A", "## B b", "### C", "###### D", "```", "#no", "  text"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    notes = spark.createDataFrame([("v", f"{i}.md", "t", b) for i, b in enumerate(bodies)], "vault string, node_id string, title string, body string")
    got = {}
    for r in sections.section_tree(notes).collect():
        got.setdefault(int(r.node_id[:-3]), []).append((r.seq, r.level, r.start_line, r.end_line, r.parent_seq, r.chars))
    for i, body in enumerate(bodies):
        lines, heads, fenced = body.split("\n"), [], False
        for k, line in enumerate(lines, 1):
            if line.strip().startswith("```"):
                fenced = not fenced
            elif not fenced and line.startswith("#") and line.lstrip("#")[:1] == " ":
                heads.append((len(line) - len(line.lstrip("#")), k))
        want = []
        for n, (level, at) in enumerate(heads):
            end = next((k for lv, k in heads[n + 1 :] if lv <= level), len(lines) + 1)
            parent = next((m + 1 for m in range(n - 1, -1, -1) if heads[m][0] < level), None)
            want.append((n + 1, level, at, end, parent, len("\n".join(lines[at - 1 : end - 1]))))
        assert sorted(got.get(i, [])) == want


def test_a_note_of_fifty_thousand_headings(spark):
    body = "\n".join(f"{'#' * (k % 6 + 1)} h{k}\ntext {k}" for k in range(50_000))
    notes = spark.createDataFrame([("v", "n.md", "t", body)], "vault string, node_id string, title string, body string")
    began = time.monotonic()
    tree = sections.section_tree(notes)
    n, last = tree.agg(F.count(F.lit(1)), F.max("end_line")).first()
    assert (n, last) == (50_000, 100_001) and time.monotonic() - began < 90
    kept = sections.section_ranges(sections.thin_sections(tree, least=10))
    assert kept.filter("end_line <= start_line").count() == 0


def test_numbers_go_on_over_tasks(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    got = corpus.numbered(rows, ["g"], ["id"], "n").collect()
    assert all(r.n == r.id // 3 for r in got)
