"""Walks over the smallest tables, step by step in plain Python, against the registered queries."""

import re

import pytest

from vellum.operators import enrich, navigate as nav, prompts
from vellum.plans import all_queries, job_queries
from vellum.plans.views import view

NOTE = "Question: {q}\n\nNote: {title}\n\n{content}\n\nReply SUFFICIENT: <reason> or INSUFFICIENT: <what is missing>."


def tokens(text):
    return [t for t in re.split(r"[\s,.;:!?\-()\[\]{}\"'`/\\]+", text.lower()) if len(t) >= 2]


def fit(asked, has):
    s = sum(has.count(q) * 2.2 / (has.count(q) + 1.2) for q in asked if q in has)
    return round(s + max(0.0, 1 - len(has) / 50), 6) if s else 0.0


@pytest.fixture(scope="module")
def tree(spark, sf):
    nodes, edges = job_queries.walk_inputs(spark, sf)
    by_id, below, out = {}, {}, {}
    for n in nodes.collect():
        by_id[n.vault, n.node_id] = n
        below.setdefault((n.vault, n.parent_id), []).append(n)
    for e in edges.orderBy("vault", "source_id", "pos").collect():
        out.setdefault((e.vault, e.source_id), []).append(re.sub("#[^#]*$", "", e.target_id))
    queries = job_queries.asked(spark, sf).collect()
    return by_id, below, out, queries


def walk(tree, vault, query, model=False):
    by_id, below, out, _ = tree
    asked, cursor, visited, pool, gathered, covered, trace = tokens(query), ".", set(), [], [], set(), []
    for _ in range(5):
        if len(gathered) >= 4:
            break
        kids = [n for n in below.get((vault, cursor), []) if n.node_id not in visited]
        refs = [by_id[vault, x] for x in pool if x not in visited and x not in {n.node_id for n in kids}]
        order = [(n.place, n) for n in kids] + [("2" + n.place, n) for n in refs]
        scored = sorted(((-fit(asked, tokens(" ".join(x for x in (n.title, n.summary) if x is not None))), p, n) for p, n in order), key=lambda x: x[:2])
        if not scored:
            if cursor == ".":
                trace.append("exhausted -")
                break
            cursor = "."
            trace.append("reset -")
            continue
        score, _, n = scored[0]
        if not model and score == 0:
            trace.append(f"done {n.node_id}")
            break
        visited.add(n.node_id)
        if n.node_id in pool:
            cursor = "."
        if n.kind == "folder" or (n.kind == "note" and n.has_children):
            cursor = n.node_id
            trace.append(f"enter {n.node_id}")
            continue
        if not (n.content or "").strip():
            trace.append(f"empty {n.node_id}")
            continue
        gathered.append(n.node_id)
        if model:
            enough = job_queries.guide([NOTE.format(q=query, title=n.title, content=n.content[:12_000])])[0].startswith("SUFFICIENT")
        else:
            covered |= set(tokens(n.content)) & set(asked)
            enough = len(covered) / max(1, len(set(asked))) >= nav.ENOUGH
        for x in out.get((vault, re.sub("#[^#]*$", "", n.node_id)), []):
            if x not in visited and x not in pool:
                pool.append(x)
        trace.append(f"{'sufficient' if enough else 'insufficient'} {n.node_id}")
        if enough:
            break
    by_fit = sorted(range(len(gathered)), key=lambda i: (-fit(asked, tokens(f"{by_id[vault, gathered[i]].title} {by_id[vault, gathered[i]].content[:2000]}")), i))
    return trace, gathered, [gathered[i] for i in by_fit]


@pytest.mark.parametrize(("name", "model"), [("navigate", False), ("navigate_model", True)])
def test_walks(spark, sf, tree, name, model):
    got = {r.query_id: r for r in all_queries()[name](spark, sf).collect()}
    kinds = set()
    assert got.keys() == {q.query_id for q in tree[3]}
    for q in tree[3]:
        trace, gathered, cited = walk(tree, q.vault, q.query, model)
        r = got[q.query_id]
        assert (r.trace, r.gathered, r.cited, r.steps) == (trace, gathered, cited, len(trace))
        kinds |= {t.split()[0] for t in trace}
    assert "enter" in kinds and kinds & {"sufficient", "insufficient"}


def test_trace_and_vaults(spark, sf, tree):
    rows = {(r.query_id, r.step): (r.phase, r.node_id) for r in all_queries()["navigate_trace"](spark, sf).collect()}
    assert rows == {(q.query_id, k): tuple(t.split(" ", 1)) for q in tree[3] for k, t in enumerate(walk(tree, q.vault, q.query)[0], 1)}
    vaults = sorted({v for v, _ in tree[0]})
    for r in all_queries()["navigate_vaults"](spark, sf).collect():
        query = next(q.query for q in tree[3] if q.query_id == r.query_id)
        walks = [(v, *walk(tree, v, query)) for v in vaults]
        assert r.cited == [f"{v}::{c}" for v, _, _, cited in walks for c in cited]
        assert (r.steps, r.with_evidence, r.failed) == (sum(len(t) for _, t, _, _ in walks), sum(bool(g) for _, _, g, _ in walks), [])


def filled(kind, fields):
    """A template filled in plain Python."""
    cut = prompts.CAPS.get(kind, {})
    return "".join(text + (str(fields[name])[: cut.get(name)] if name else "") for text, name in prompts.parts_of(kind))


def listed(by_id, vault, gathered):
    return "\n\n".join(f"--- {by_id[vault, g].title} ---\n{by_id[vault, g].content[: prompts.CAPS['answer']['content']]}" for g in gathered)


def answer(tree, vault, query, history="", model=None):
    """What the stand-in model answers from the notes of a walk, and the walk."""
    trace, gathered, cited = walk(tree, vault, query)
    if not gathered:
        return f"[no evidence] no note was found that bears on the question: {trace[-1].split()[0]}", "none", trace, cited
    fields = {"query": query, "notes": listed(tree[0], vault, gathered), "history": history}
    said = (model or enrich.echo_model)([filled("answer_history" if history else "answer", fields)])[0]
    return said.strip(), "normal", trace, cited


def test_answers(spark, sf, tree):
    """Every answer of a batch, the error where the model fails, and where a run that stops at the first error would end."""
    got = {r.pos: r for r in all_queries()["batch_answers"](spark, sf).collect()}
    want = {}
    for q in tree[3]:
        try:
            want[q.query_id] = answer(tree, q.vault, q.query, model=job_queries.moody)[0]
        except RuntimeError as e:
            want[q.query_id] = f"[ERROR] RuntimeError: {e}"
    assert {k: r.value for k, r in got.items()} == {q.query_id: f"## {q.query}\n\n{want[q.query_id]}\n" for q in tree[3]}
    failed = [k for k, v in want.items() if v.startswith("[ERROR]")]
    assert failed and all(r.before_stop == (k <= min(failed)) for k, r in got.items())


def merged(query, parts, failed="[all parts failed]"):
    """One answer of (title, answer, status) parts: that of the only one with evidence, or the model's of all that have."""
    found = [f"### {t}\n{said}" for t, said, status in parts if status != "none"]
    if len(found) > 1:
        cap = prompts.CAPS["synthesise"]["content"]
        return job_queries.guide([filled("synthesise", {"query": query, "parts": "\n\n".join(f[:cap] for f in found)})])[0].strip(), len(found)
    return next((said for _, said, status in parts if status != "none"), parts[0][1]), len(found)


def decomposed(tree, vault, query):
    subs = re.findall(r"SUB: (.*)", job_queries.guide([filled("decompose", {"n": 4, "query": query})])[0])
    parts = [(s, *answer(tree, vault, s, model=job_queries.guide)) for s in (subs if len(subs) > 1 else [query])]
    said, n = merged(query, [p[:3] for p in parts])
    return said, n, sum(len(t) for _, _, _, t, _ in parts), list(dict.fromkeys(c for *_, cited in parts for c in cited))


def test_decomposed(spark, sf, tree):
    """The model's parts are walked and answered each, and one answer is made of those with evidence; in one vault, and in every vault."""
    query = {q.query_id: q for q in tree[3]}
    for r in all_queries()["navigate_decomposed"](spark, sf).collect():
        q = query[r.query_id]
        assert ((r.answer, r.with_evidence, r.steps, r.cited), r.failed) == (decomposed(tree, q.vault, q.query), [])
    vaults = sorted({v for v, _ in tree[0]})
    rows = all_queries()["navigate_vaults_decomposed"](spark, sf).collect()
    assert {r.query_id for r in rows} == set(query)
    for r in rows:
        q = query[r.query_id].query
        each = [(v, *decomposed(tree, v, q)) for v in vaults]
        said, n = merged(q, [(v, text, "normal" if k else "none") for v, text, k, _, _ in each])
        assert (r.answer, r.with_evidence, r.failed) == (said, n, [])
        assert r.steps == sum(steps for *_, steps, _ in each) and r.cited == [f"{v}::{c}" for v, *_, cited in each for c in cited]


def test_status(spark, sf, tree):
    status = {r.status: r.queries for r in all_queries()["answer_status"](spark, sf).collect()}
    assert sum(status.values()) == len(tree[3])


def test_chat(spark, sf, tree):
    """The last question of every session: rewritten with the turns before, walked, and answered with them."""
    turns = {}
    for t in view(spark, sf, "turns_src").collect():
        turns.setdefault(t.session_id, []).append((t.turn, t.question, t.answer))
    got = {}
    for r in all_queries()["chat_answers"](spark, sf).collect():
        got.setdefault(r.session_id, {})[r.turn] = r
    for s, said in turns.items():
        said.sort()
        last, question = said[-1][0], said[-1][1]
        history = "\n".join(f"Q: {q}\nA: {a[:200]}" for _, q, a in said[-3:])
        asked = enrich.echo_model([filled("rewrite", {"history": history, "query": question})])[0].strip() or question
        text, _, _, cited = answer(tree, f"src{s % 20}", asked, history)
        assert sorted(got[s]) == [*(t for t, _, _ in said), last + 1]
        assert (got[s][last + 1].question, got[s][last + 1].answer, got[s][last + 1].cited) == (question, text, cited)
