"""Sections, links, ranking, walks and files on small fixtures."""

import datetime
import os
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from vellum.operators import corpus, enrich, links, navigate, ranking, sections, usage
from vellum.sources import files
from vellum.streaming import usage_streams as us

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # models of tests run in workers, which cannot import this file


def frame(spark, rows):
    return spark.createDataFrame([("v", *r) for r in rows], "vault string, node_id string, title string, body string")


def stack_tree(body):
    """Sections by a plain stack."""
    lines, out, fenced = body.split("\n"), [], False
    for n, line in enumerate(lines, 1):
        if line.lstrip(" ").startswith("```"):
            fenced = not fenced
        level = len(line) - len(line.lstrip("#"))
        if not fenced and 1 <= level <= 6 and line[level : level + 1] == " " and line[level:].strip():
            out.append([level, line[level:].strip(), n, None, None])
    stack = []
    for i, h in enumerate(out):
        while stack and out[stack[-1]][0] >= h[0]:
            out[stack.pop()][3] = h[2]
        h[4] = stack[-1] + 1 if stack else None
        stack.append(i)
    for i in stack:
        out[i][3] = len(lines) + 1
    return [(i + 1, *h, len("\n".join(lines[h[2] - 1 : h[3] - 1]))) for i, h in enumerate(out)]


def test_section_tree_against_a_stack(spark):
    rng = random.Random(5)
    notes = []
    for k in range(60):
        lines = [rng.choice(["text", "", "```", "#no", "# "] + ["#" * rng.randint(1, 7) + f" h{i}"] * 4) for i in range(rng.randint(0, 25))]
        notes.append((f"n{k}.md", "t", "\n".join(lines)))
    got = {}
    for r in sections.section_tree(frame(spark, notes)).collect():
        got.setdefault(r.node_id, []).append((r.seq, r.level, r.title, r.start_line, r.end_line, r.parent_seq, r.chars))
    want = {n: t for n, _, body in notes if (t := stack_tree(body))}
    assert {n: sorted(v) for n, v in got.items()} == want


def test_flatten(spark):
    big = "word " * 400
    cases = {
        "a.md": ("Paper", f"# paper\nintro\n## One\n{big}\n## Two\n{big}", ["a.md#intro", "a.md#0002", "a.md#0003"]),
        "b.md": ("Paper", f"# Paper\n## One\n{big}", ["b.md#0002"]),
        "c.md": ("Paper", f"# Paper\n{big}\n# Other\n## x\n{big}", ["c.md#0001", "c.md#0002", "c.md#0003"]),
        "d.md": ("Paper", f"# Paper\n{big}", ["d.md#0001"]),
        "e.md": ("Else", f"# Paper\nintro\n## One\n{big}", ["e.md#0001", "e.md#0002"]),
    }
    notes = frame(spark, [(n, t, b) for n, (t, b, _) in cases.items()])
    got = {}
    for r in sections.flatten_title_section(sections.thin_sections(sections.section_tree(notes)), notes).orderBy("start_line", "section_id").collect():
        got.setdefault(r.node_id, []).append(r.section_id)
    assert {n: sorted(v) for n, v in got.items()} == {n: sorted(ids) for n, (_, _, ids) in cases.items()}


def test_links(spark):
    notes = frame(spark, [
        ("a.md", "a", "[[B]] [[x/b]] [[wrong/b]] [[gone]] [[b#Part]] [[b#none]]"), ("x/b.md", "b", "# Part\n[[a]]"), ("y/b.md", "b", ""), ("c.md", "c", ""), ("d.md", "d", "[[d]]"),
    ])
    found = links.note_links(notes)
    resolved = links.resolve_links(found, notes)
    assert sorted((r.pos, r.target_id) for r in resolved.filter("source_id = 'a.md'").collect()) == [(0, "x/b.md"), (0, "y/b.md"), (1, "x/b.md"), (4, "x/b.md"), (4, "y/b.md"), (5, "x/b.md"), (5, "y/b.md")]
    assert sorted(r.raw_target for r in links.dangling_links(found, notes).collect()) == ["gone", "wrong/b"]
    assert [r.node_id for r in links.orphan_notes(notes, resolved).collect()] == ["c.md"]
    kept = sections.thin_sections(sections.section_tree(notes))
    hit = {(r.pos, r.target_node) for r in links.anchor_links(resolved.filter("source_id = 'a.md'"), kept).filter("pos >= 4").collect()}
    assert hit == {(4, "x/b.md#0001"), (4, "y/b.md"), (5, "x/b.md"), (5, "y/b.md")}
    assert tuple(links.link_totals(found, notes).first()) == (9, 2, 1)
    strict = links.resolve_links(links.note_links(frame(spark, [("q.md", "q", "[[b/T]]")])), frame(spark, [("ab/T.md", "T", ""), ("b/T.md", "T", "")]), strict=True)
    assert [r.target_id for r in strict.collect()] == ["b/T.md"]


def test_ranking_keeps_order_without_hits(spark):
    asked = spark.createDataFrame([("q", "alpha beta beta"), ("z", "a b c")], "query_id string, query string")
    given = spark.createDataFrame([(q, i, f"n{i}", t) for q in "qz" for i, t in enumerate(["x y", "alpha alpha", "beta", ""])], "query_id string, position long, node_id string, text string")
    got = {}
    for r in ranking.rank_candidates(asked, given, ["node_id"]).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.node_id, round(r.score, 6)))
    beta, alpha = 2 * 2.2 / 2.2 + 0.98, 2 * 2.2 / 3.2 + 0.96
    assert got["q"] == [("n2", round(beta, 6)), ("n1", round(alpha, 6)), ("n0", 0.0), ("n3", 0.0)]
    assert [n for n, _ in got["z"]] == ["n0", "n1", "n2", "n3"]


def test_walk(spark):
    notes = frame(spark, [("f/one.md", "one", "apple only [[two]]"), ("g/two.md", "two", "pear apple"), ("three.md", "three", "")])
    told = corpus.build_notes(notes).withColumn("summary", F.col("body"))
    nodes = navigate.build_nodes(told.withColumn("summary", F.when(F.col("node_id") == "f/one.md", "apple apple").otherwise("pear")))
    folders = spark.createDataFrame([("f", "apple"), ("g", "none")], "node_id string, s string")
    nodes = nodes.join(folders, "node_id", "left").withColumn("summary", F.coalesce("s", "summary")).drop("s")
    found = links.resolve_links(links.note_links(notes), notes).select("vault", "source_id", "pos", "raw_target", "target_id")
    asked = spark.createDataFrame([("q", "v", "apple pear"), ("none", "v", "zzz")], "query_id string, vault string, query string")
    got = {r.query_id: r for r in navigate.navigate(asked, nodes, found).collect()}
    # into f, one.md is not enough, its link leads on to two.md, which completes the query
    assert got["q"].trace == ["enter f", "insufficient f/one.md", "sufficient g/two.md"]
    assert (got["q"].gathered, got["q"].steps, got["q"].reason) == (["f/one.md", "g/two.md"], 3, "sufficient")
    assert got["q"].cited == ["g/two.md", "f/one.md"]  # by how well they fit the query
    assert (got["none"].cited, got["none"].reason) == ([], "done")


class Scripted:
    """A model that gives its replies to select and evaluate prompts one after another, and keeps the prompts in a folder."""

    def __init__(self, path, select=(), evaluate=(), other="said"):
        self.path, self.select, self.evaluate, self.other = str(path), list(select), list(evaluate), other

    def __call__(self, batch):
        out = []
        for p in batch:
            kind = "select" if "action (SELECT" in p or "Reply SELECT" in p else "evaluate" if "sufficient (true" in p or "Reply SUFFICIENT" in p else "other"
            n = sum(x.startswith(kind) for x in os.listdir(self.path))
            with open(f"{self.path}/{kind}{n:03d}", "w") as f:
                f.write(p)
            if kind == "other" and self.other is None:
                raise RuntimeError("down")
            out.append(self.other if kind == "other" else getattr(self, kind)[n])
        return out

    def prompts(self, kind):
        return [open(f"{self.path}/{x}").read() for x in sorted(os.listdir(self.path)) if x.startswith(kind)]


@pytest.fixture
def garden(spark):
    """Two folders; the first note of the first links to its neighbour and to a note of the second."""
    notes = frame(spark, [("herbs/mint.md", "mint", "grows anywhere [[sage]] [[pear]]"), ("herbs/sage.md", "sage", "dry soil"), ("trees/pear.md", "pear", "needs years"), ("blank.md", "blank", " \n")])
    nodes = navigate.build_nodes(corpus.build_notes(notes))
    edges = links.resolve_links(links.note_links(notes), notes).select("vault", "source_id", "pos", "raw_target", "target_id")
    asked = spark.createDataFrame([("q", "v", "where does it grow")], "query_id string, vault string, query string")
    return asked, nodes, edges


def walk(garden, model, **options):
    kinds = {k: options.pop(k) for k in ("json", "shown", "retries", "strict") if k in options}
    (got,) = navigate.navigate(*garden, navigate.Model(model, **kinds), **options).collect()
    return got


def test_a_model_walks(garden, tmp_path):
    model = Scripted(tmp_path, ["SELECT: herbs", "SELECT: herbs/mint.md"], ["SUFFICIENT: it says so"])
    got = walk(garden, model)
    assert got.trace == ["enter herbs", "sufficient herbs/mint.md"] and (got.steps, got.gathered, got.reason) == (2, ["herbs/mint.md"], "sufficient")
    first, second = model.prompts("select")
    assert all(f"node_id: {x}" in first for x in ("herbs", "trees", "blank.md")) and "herbs/mint.md" in second and "So far: herbs" in second
    assert got.tokens > 0


def test_a_pick_from_the_references_goes_back_to_the_root(garden, tmp_path):
    # sage is both a child of the cursor and enqueued by mint's link: picking it leads back to the root
    model = Scripted(tmp_path, ["SELECT: herbs", "SELECT: herbs/mint.md", "SELECT: herbs/sage.md", "SELECT: trees", "SELECT: trees/pear.md"], ["INSUFFICIENT: no"] * 3)
    got = walk(garden, model)
    assert got.trace == ["enter herbs", "insufficient herbs/mint.md", "insufficient herbs/sage.md", "enter trees", "insufficient trees/pear.md"] and got.reason == "insufficient"
    third, fourth = model.prompts("select")[2:4]
    assert "[xref: mint → [[pear]]]" in third and "[xref: mint → [[sage]]]" not in third  # a child is no reference
    assert "node_id: trees\n" in fourth + "\n" and "herbs/sage.md" not in fourth


def test_unreadable_replies_are_asked_for_again(garden, tmp_path):
    folders = [tmp_path / str(i) for i in range(5)]
    for f in folders:
        f.mkdir()
    got = walk(garden, Scripted(folders[0], ["hm", "DONE: nothing fits"]))
    assert (got.trace, got.reason, got.steps) == (["done -"], "nothing fits", 1)
    got = walk(garden, model := Scripted(folders[1], ["hm", "well"]))
    assert (got.trace, got.reason) == (["unread -"], "unread") and "could not be read" in model.prompts("select")[1]
    got = walk(garden, Scripted(folders[2], ['{"action": "SELECT", "node_id": "herbs"}', "no", "DONE: read as text"]), json=True)
    assert got.trace == ["enter herbs", "done -"] and got.reason == "read as text"
    # an unreadable judgement keeps the note, but its links are not followed
    got = walk(garden, Scripted(folders[3], ["SELECT: herbs", "SELECT: herbs/mint.md", "DONE: x"], ["?"]))
    assert got.trace == ["enter herbs", "unreadable herbs/mint.md", "done -"] and got.gathered == ["herbs/mint.md"]
    got = walk(garden, Scripted(folders[4], ["SELECT: made/up.md", "SELECT: blank.md", "DONE: x"]))
    assert got.trace == ["invalid made/up.md", "empty blank.md", "done -"] and got.gathered == []


def test_walks_end(garden, spark, tmp_path):
    folders = [tmp_path / str(i) for i in range(4)]
    for f in folders:
        f.mkdir()
    asked, nodes, edges = garden
    (got,) = navigate.navigate(asked, nodes.limit(0), edges).collect()
    assert (got.trace, got.steps, got.reason) == (["exhausted -"], 1, "exhausted")  # the look that finds nothing counts
    one = nodes.filter("node_id in ('trees', 'trees/pear.md')")
    (got,) = navigate.navigate(asked, one, None, navigate.Model(Scripted(folders[0], ["SELECT: trees", "SELECT: trees/pear.md"], ["INSUFFICIENT: no"]))).collect()
    assert (got.trace, got.steps) == (["enter trees", "insufficient trees/pear.md", "reset -", "exhausted -"], 4)
    got = walk(garden, Scripted(folders[1], ["SELECT: herbs"] * 9), max_tokens=1)
    assert (got.trace, got.reason) == (["enter herbs", "budget -"], "budget")
    # with reuse_context what has been shown is left out while there is anything else
    model = Scripted(folders[2], ["SELECT: herbs", "SELECT: herbs/mint.md", "DONE: x"], ["INSUFFICIENT: no"])
    walk(garden, model, reuse_context=True)
    third = model.prompts("select")[2]
    assert "trees/pear.md" in third and "herbs/sage.md" not in third
    (got,) = navigate.navigate(*garden, navigate.Model(Scripted(folders[3], ["SELECT: herbs", "SELECT: herbs/mint.md", "SELECT: herbs/sage.md"], ["INSUFFICIENT: no"] * 2)), gathered=2).collect()
    assert got.gathered == ["herbs/mint.md", "herbs/sage.md"] and got.steps == 3


def test_sections_are_walked(spark, tmp_path):
    long = "word " * 400
    notes = frame(spark, [("long.md", "long", f"# Early\n{long}\n# Late\n{long} [[other]]"), ("other.md", "other", "end")])
    tree = sections.thin_sections(sections.section_tree(notes))
    texts = sections.section_texts(sections.section_ranges(tree), notes)
    nodes = navigate.build_nodes(corpus.build_notes(notes), texts)
    edges = links.resolve_links(links.note_links(notes), notes).select("vault", "source_id", "pos", "raw_target", "target_id")
    asked = spark.createDataFrame([("q", "v", "what is late")], "query_id string, vault string, query string")
    model = Scripted(tmp_path, ["SELECT: long.md", "SELECT: long.md#0002", "SELECT: other.md"], ["INSUFFICIENT: no", "SUFFICIENT: yes"])
    got = walk((asked, nodes, edges), model)
    assert got.trace == ["enter long.md", "insufficient long.md#0002", "sufficient other.md"]
    assert "# Early" not in model.prompts("evaluate")[0]


def test_answers_of_vaults_parts_and_sessions(garden, spark, tmp_path):
    asked, nodes, edges = garden
    folders = [tmp_path / str(i) for i in range(9)]
    for f in folders:
        f.mkdir()
    good = lambda k: Scripted(folders[k], ["SELECT: herbs", "SELECT: herbs/mint.md"], ["SUFFICIENT: y"])
    walks = navigate.navigate(*garden, navigate.Model(good(0)))
    (got,) = navigate.answers(walks, nodes, model := Scripted(folders[1], other=" anywhere ")).collect()
    assert (got.status, got.answer, got.error) == ("normal", "anywhere", None) and "--- mint ---" in model.prompts("other")[0]
    (got,) = navigate.answers(walks, nodes, max_tokens=1).collect()
    assert got.status == "partial" and "## mint" in got.answer and "grows anywhere" in got.answer
    (got,) = navigate.answers(walks, nodes, Scripted(folders[2], other=None)).collect()
    assert got.answer is None and "down" in got.error
    (got,) = navigate.answers(navigate.navigate(asked, nodes.limit(0)), nodes).collect()
    assert got.status == "none" and got.answer.startswith("[no evidence]")
    # a vault that is not there has no evidence; one whose model fails is named; all failing is an answer of its own
    vaults = spark.createDataFrame([(1, "v"), (2, "nowhere"), (3, "left out")], "pos int, vault string")
    (got,) = navigate.answer_vaults(asked, vaults, nodes, edges, navigate.Model(good(3)), Scripted(folders[4], other="yes"), exclude=("left out",)).collect()
    assert (got.answer, got.cited, got.with_evidence, got.failed) == ("yes", ["v::herbs/mint.md"], 1, [])
    (got,) = navigate.answer_vaults(asked, vaults, nodes, edges, navigate.Model(lambda b: 1 / 0), only=("v",)).collect()
    assert (got.answer, got.failed, got.cited) == ("[all vaults failed]", ["v"], [])
    with pytest.raises(Exception, match="division"):
        navigate.answer_vaults(asked, vaults, nodes, edges, navigate.Model(lambda b: 1 / 0, strict=True), only=("v",)).collect()
    # sub-queries of a model, each walked, made one
    split = lambda batch: ["SUB: mint grows\nSUB: pear years" if p.startswith("Split") else f"{p.count('###')} parts" if p.endswith("of these.") else "part" for p in batch]
    (got,) = navigate.answer_decomposed(asked, nodes.withColumn("summary", F.coalesce("content", F.when(F.col("node_id") == "herbs", "mint grows").when(F.col("node_id") == "trees", "pear years"))), edges, model_fn=split).collect()
    assert (got.answer, got.with_evidence, got.failed) == ("2 parts", 2, []) and {"herbs/mint.md", "trees/pear.md"} <= set(got.cited)
    # a session's next turn: rewritten with what was said, answered with it
    turns = spark.createDataFrame([(7, 1, "which herb", "mint")], "session_id long, turn long, question string, answer string")
    ask = spark.createDataFrame([(7, "v", "does it grow"), (8, "v", "mint grows")], "session_id long, vault string, question string")
    chat = lambda batch: ["mint grows anywhere" if "stands alone" in p else "with history" if p.startswith("Before:\nQ: which herb") else "without" for p in batch]
    rich = nodes.withColumn("summary", F.coalesce("content", F.lit("mint grows")))
    got = {r.session_id: r for r in navigate.chat_turn(turns, ask, rich, edges, model_fn=chat).collect()}
    assert (got[7].turn, got[7].rewritten, got[7].answer) == (2, "mint grows anywhere", "with history")
    assert (got[8].turn, got[8].rewritten, got[8].answer) == (1, "mint grows", "without")
    rows = spark.createDataFrame([(1, None), (2, "x"), (3, None), (4, "y")], "pos int, error string")
    assert sorted(r.pos for r in navigate.until_error(rows).collect()) == [1, 2] and navigate.until_error(rows.filter("error IS NULL")).count() == 2


def test_numbers_span_tasks(spark):
    rows = spark.createDataFrame([(g, i * 7 % 1000) for i in range(1000) for g in ("a", None)] + [("b", 5)], "g string, x int").repartition(7)
    got = corpus.numbered(rows, ["g"], ["x"], "n", 1).collect()
    assert sorted((str(r.g), r.x, r.n) for r in got) == sorted([(g, x, x + 1) for g in ("a", "None") for x in range(1000)] + [("b", 5, 1)])
    assert sorted((r.x, r.n) for r in corpus.numbered(rows.filter("g = 'a'").select("x"), [], ["x"], "n").collect()) == [(x, x) for x in range(1000)]
    assert corpus.numbered(rows.limit(0), ["g"], ["x"], "n").count() == 0


def test_enrich_asks_only_misses_and_survives_errors(spark):
    def model(batch):
        if any("bad" in p for p in batch):
            raise RuntimeError("no")
        return [p.upper() for p in batch]

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c")], "k long, prompt_text string")
    cache = spark.createDataFrame([(1, "old")], "k long, response string")
    out, used = enrich.enrich(rows, ["k"], model, "p", cache)
    got = {r.k: (r.response, r.error, r.cached) for r in out.collect()}
    assert got == {1: ("old", None, True), 2: (None, "RuntimeError: no", False), 3: ("C", None, False)}
    assert used.count() == 1


def test_enrich_retries_and_is_strict_if_asked(spark):
    def moody():
        calls = []

        def model(batch):
            calls.append(batch)
            if len(calls) < 4:
                raise RuntimeError("busy")
            return ["ok"] * len(batch)

        return model

    rows = spark.createDataFrame([(1, "a")], "k long, prompt_text string").coalesce(1)
    assert [r.response for r in enrich.ask(rows, moody(), "p", ["k"], retries=2).collect()] == ["ok"]
    assert [r.error for r in enrich.ask(rows, moody(), "p", ["k"], retries=1).collect()] == ["RuntimeError: busy"]
    with pytest.raises(Exception, match="busy"):
        enrich.ask(rows, moody(), "p", ["k"], strict=True).collect()
    with pytest.raises(ValueError):
        usage.parse_time_bound("yesterday")


def test_files(spark, tmp_path):
    (tmp_path / "f g").mkdir()
    (tmp_path / ".hid").mkdir()
    (tmp_path / "f g" / "h.md").write_text("# H\nx")
    (tmp_path / "a.md").write_text("é")
    (tmp_path / ".hid" / "b.md").write_text("no")
    (tmp_path / "c.txt").write_text("no")
    got = {(r.node_id, r.title, r.body) for r in files.scan_notes(spark, str(tmp_path)).collect()}
    assert got == {("f g/h.md", "h", "# H\nx"), ("a.md", "a", "é")}
    (tmp_path / "q").write_text("# c\n\nfirst\n second \n")
    assert [tuple(r) for r in files.read_queries(spark, str(tmp_path / "q")).collect()] == [(1, "first"), (2, "second")]
    (tmp_path / "many").write_text("\n".join(f"line {i}" if i % 3 else "# no" for i in range(3000)))
    got = files.read_queries(spark, str(tmp_path / "many")).orderBy("pos").collect()
    assert [r.query for r in got] == [f"line {i}" for i in range(3000) if i % 3] and [r.pos for r in got] == list(range(1, 2001))
    assert files.load_snapshot(spark, str(tmp_path / "none")) is None
    log = spark.range(60).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id") * 7200).alias("ts"), F.lit("p").alias("phase"), F.lit(1).cast("long").alias("prompt"), F.lit(2).cast("long").alias("completion"), F.lit(0.5).alias("elapsed"))
    path = str(tmp_path / "log")
    files.write_usage(log, path)
    days = sorted({str(r.day) for r in spark.read.parquet(path).collect()})
    cutoff = datetime.date.fromisoformat(days[2])
    assert files.retain_usage(spark, path, str(tmp_path / "rollup"), cutoff) == 2 and files.retain_usage(spark, path, str(tmp_path / "rollup"), cutoff) == 0
    left, gone = spark.read.parquet(path), spark.read.parquet(str(tmp_path / "rollup"))
    assert sorted({str(r.day) for r in left.collect()}) == days[2:] and left.count() + gone.agg(F.sum("calls")).first()[0] == 60
    assert not (tmp_path / "log" / f"day={days[0]}").exists()


def test_tail_says_that_it_is_alive_and_stops(spark, tmp_path):
    log = spark.range(30).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.col("id")).alias("ts"), F.lit("p").alias("phase"), F.lit(1).cast("long").alias("prompt"), F.lit(2).cast("long").alias("completion"))
    log.write.parquet(str(tmp_path / "log"))
    stream = us.read_stream(spark, str(tmp_path / "log"))
    n = us.follow(stream, str(tmp_path / "out"), str(tmp_path / "check"), log=log, backfill=4, seconds=9, heartbeat=1.5)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert n == 30 and sorted(r.event_id for r in got if r.kind == "backfill") == [26, 27, 28, 29] and sum(r.kind == "new" for r in got) == 30 and any(r.kind == "heartbeat" for r in got)
    assert us.follow(stream, str(tmp_path / "out2"), str(tmp_path / "check2"), most=11, seconds=60) == 11


def test_stream_of_sessions_goes_on_from_its_state(spark, tmp_path):
    at = lambda minutes: F.timestamp_seconds(F.lit(1_700_000_000 + 60 * minutes))
    one = spark.range(1)
    for k, batch in enumerate([[(1, 0), (1, 30), (2, 0)], [(1, 80), (2, 61), (1, 141)]]):
        rows = None
        for s, m in batch:
            row = one.select(F.lit(s).cast("long").alias("session_id"), at(m).alias("ts"))
            rows = row if rows is None else rows.unionByName(row)
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "turns"))
        us.stream_sessions(us.read_stream(spark, str(tmp_path / "turns") + "/"), str(tmp_path / "out"), str(tmp_path / "check"))
    got = us.open_sessions(spark.read.parquet(str(tmp_path / "out"))).collect()
    minutes = lambda t: int(t.timestamp() - 1_700_000_000) // 60
    assert sorted((r.session_id, minutes(r.start), minutes(r.last_active), r.turns) for r in got) == [(1, 0, 80, 3), (1, 141, 141, 1), (2, 0, 0, 1), (2, 61, 61, 1)]


def test_savings_and_rollup(spark):
    rows = [(i, f"2024-01-0{d} 10:00:0{i}", "s", p, i, 1, e, True) for i, (d, p, e) in enumerate([(1, "select", 1.0), (1, "select", 0.2), (3, "final", 0.1)])]
    log = spark.createDataFrame(rows, "event_id int, ts string, session_id string, phase string, prompt long, completion long, elapsed double, cacheable boolean").withColumn("ts", F.to_timestamp("ts"))
    s = usage.cache_savings(log).first()
    assert (s.first_call, s.rest_mean, s.hit_rate, s.samples) == (1.0, 0.15, 0.85, 3)
    days = {str(r.day): (r.calls, {k: v.calls for k, v in r.by_phase.items()}) for r in usage.rollup_daily(log).collect()}
    assert days == {"2024-01-01": (2, {"select": 2}), "2024-01-02": (0, {}), "2024-01-03": (1, {"final": 1})}
    assert usage.cacheable_ratio(log.limit(0)).first().ratio == 0.0
    assert tuple(usage.usage_totals(log.limit(0)).first()) == (0, 0, 0, 0.0)
