"""Bounded multi-hop retrieval for tables of queries over the tree of notes and the link graph.

A state row per query and vault moves through at most five steps. In a step it looks at the children of its
cursor and at its cross-references; a policy picks one of them, or ends the walk; a picked note is loaded and
judged. The built-in policy is made of expressions: an inverted index tells it which children share a token with
the query, no others are met, and its best candidate is an aggregate that combines before it shuffles. The
model's policy asks in batches on the executors, and shows a bounded number of candidates. A walk's state is
stored after each step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import responses as rs
from ..functions import text as tx
from ..sources.tables import stored
from . import corpus, enrich, prompts
from .ranking import DIGITS, K1, MOST_TOKENS, SHORT, overlap_score, rerank_citations

# Fixed values of the walk.
MOST_STEPS, MOST_GATHERED, CHARS_PER_NOTE, PATH_SHOWN = 5, 4, 1000, 3
#: Share of a query's distinct tokens that gathered notes must hold to be enough; ours.
ENOUGH = 0.8
#: Candidates that a prompt shows at most, the best first; ours.
SHOWN = 200
ROOT = "."
KEY = ["query_id", "vault"]
PICK = "struct<node_id: string, kind: string, has_children: boolean, title: string>"


def build_nodes(notes: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """Folders, notes and top-level sections of long notes as (vault, node_id, parent_id, place, kind, title, summary, content, has_children).

    ``place`` orders the children of a node: folders by name, then notes by id; sections by number.
    """
    none = F.lit(None).cast("string")
    folders = corpus.folder_nodes(notes).select("vault", F.col("folder").alias("node_id"), F.col("parent").alias("parent_id"), F.concat(F.lit("0"), "folder").alias("place"), F.lit("folder").alias("kind"), F.regexp_replace("folder", "^.*/", "").alias("title"), none.alias("summary"), none.alias("content"), F.lit(True).alias("has_children"))
    base = notes.select("vault", "node_id", tx.parent_folder(F.col("node_id")).alias("parent_id"), F.concat(F.lit("1"), "node_id").alias("place"), F.lit("note").alias("kind"), "title", F.col("summary") if "summary" in notes.columns else none.alias("summary"), F.col("body").alias("content"))
    if sections is None:
        return folders.unionByName(base.withColumn("has_children", F.lit(False)))
    tops = sections.filter("parent_seq IS NULL").select("vault", F.col("section_id").alias("node_id"), F.col("node_id").alias("parent_id"), F.lpad(F.col("seq").cast("string"), 12, "0").alias("place"), F.lit("section").alias("kind"), "title", none.alias("summary"), F.col("text").alias("content"), F.lit(False).alias("has_children"))
    owners = tops.select("vault", F.col("parent_id").alias("node_id")).distinct().withColumn("has_children", F.lit(True))
    base = base.join(owners, ["vault", "node_id"], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))
    return folders.unionByName(base).unionByName(tops)


@dataclass
class Tree:
    """Nodes made ready for a table of walks.

    ``slim`` has no contents. ``postings`` are (vault, parent_id, token, tf) with the node that has the token, for the
    tokens that some query asks. ``firsts`` are the first children of each node, as many as a walk can have visited and one.
    """

    slim: DataFrame
    postings: DataFrame
    firsts: DataFrame
    contents: DataFrame
    edges: DataFrame | None


def index_nodes(nodes: DataFrame, edges: DataFrame | None, state: DataFrame, steps: int) -> Tree:
    slim = stored(nodes.select("vault", "node_id", "parent_id", "place", "kind", "title", "summary", "has_children", tx.tokenize(F.concat_ws(" ", "title", "summary")).alias("has")), "slim_nodes")
    tokens = stored(state.select(F.explode("asked").alias("token")).distinct(), "asked_tokens")
    put = F.broadcast if tokens.count() <= MOST_TOKENS else lambda df: df
    shown = ["node_id", "place", "kind", "has_children", "title"]
    each = slim.select("vault", "parent_id", *shown, F.size("has").alias("len"), F.explode("has").alias("token")).join(put(tokens), "token", "left_semi")
    postings = stored(each.groupBy("vault", "parent_id", "token", *shown, "len").agg(F.count(F.lit(1)).alias("tf")), "postings")
    rank = F.row_number().over(Window.partitionBy("vault", "parent_id").orderBy("place"))  # its limit is applied before the shuffle
    firsts = slim.withColumn("_n", rank).filter(F.col("_n") <= steps).groupBy("vault", "parent_id").agg(F.sort_array(F.collect_list(F.struct("place", *[c for c in shown if c != "place"]))).alias("first_children"))
    return Tree(slim, postings, stored(firsts, "firsts"), nodes.select("vault", "node_id", "content"), edges)


# Policies: choose() has a row for each walk with candidates, judge() for each loaded note.


@dataclass
class Overlap:
    """The built-in policy: the candidate with the best score, none if that is 0; enough is ``enough`` of the query's distinct tokens in all that was gathered."""

    enough: float = ENOUGH

    def choose(self, look: DataFrame, tree: Tree, reuse_context: bool) -> DataFrame:
        word = F.explode(F.transform(F.array_distinct("asked"), lambda t: F.struct(t.alias("token"), F.size(F.filter("asked", lambda x: x == t)).alias("n"))))
        want = look.select(*KEY, F.col("cursor").alias("parent_id"), "visited", word.alias("w")).select("*", "w.*")
        hits = want.join(tree.postings, ["vault", "parent_id", "token"]).filter(~F.array_contains("visited", F.col("node_id")))
        part = F.sum(F.col("n") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1))
        node = ["node_id", "kind", "has_children", "title"]
        hits = hits.groupBy(*KEY, "place", *node, "len").agg(part.alias("score"))
        hits = hits.select(*KEY, "place", *node, (F.col("score") + F.greatest(F.lit(0.0), 1 - F.col("len") / SHORT)).alias("score"))
        refs = references(look, tree.slim).withColumn("score", overlap_score(F.col("asked"), F.col("has")))
        both = hits.unionByName(refs.select(*KEY, "place", *node, "score"))
        order = F.struct(-F.round("score", DIGITS), F.col("place"))
        best = both.groupBy(*KEY).agg(F.min_by(F.struct(*node), order).alias("best"), F.max("score").alias("score"))
        left = F.get(F.filter("first_children", lambda c: ~F.array_contains("visited", c["node_id"])), F.lit(0))
        first = F.struct(*[left[c].alias(c) for c in node])
        told = look.select(*KEY, F.col("cursor").alias("parent_id"), "visited").join(tree.firsts, ["vault", "parent_id"], "left").join(best, KEY, "left")
        hit = F.col("score") > 0
        told = told.select(*KEY, F.when(hit, F.col("best")).when(left.isNotNull(), first).otherwise(F.col("best")).alias("pick"), F.coalesce(hit, F.lit(False)).alias("hit"))
        none = F.lit(None).cast("string")
        return told.filter("pick IS NOT NULL").select(*KEY, "pick", F.when(F.col("hit"), "SELECT").otherwise("DONE").alias("action"), F.when(F.col("hit"), F.col("pick.node_id")).alias("value"), none.alias("pick_error"), F.array().cast("array<string>").alias("listed"), F.lit(0).cast("long").alias("used"))

    def judge(self, loaded: DataFrame) -> DataFrame:
        got = F.array_intersect(F.array_distinct("asked"), tx.tokenize(F.col("content")))
        told = loaded.select(*KEY, F.array_union("covered", got).alias("covered"), F.greatest(F.lit(1), F.size(F.array_distinct("asked"))).alias("n"))
        return told.select(*KEY, F.when(F.size("covered") / F.col("n") >= self.enough, "sufficient").otherwise("insufficient").alias("verdict"), "covered", F.lit(0).cast("long").alias("used"))


@dataclass
class Model:
    """Asks a model what to pick and whether a note is enough.

    A reply that cannot be read is asked for once more; with ``json`` a second reply is also read as text. What
    still cannot be read ends the walk. A model that fails, after ``retries`` more calls, ends the walk with an
    error, or with ``strict`` the job.
    """

    model_fn: enrich.ModelFn
    lang: str = "en"
    json: bool = False
    shown: int = SHOWN
    retries: int = 0
    strict: bool = False

    def ask(self, rows: DataFrame, phase: str) -> DataFrame:
        return stored(enrich.ask(rows, self.model_fn, phase, KEY, self.retries, self.strict, phase, self.lang), phase).select(*KEY, "response", "error", (F.col("prompt") + F.col("completion")).alias("used"))

    def choose(self, look: DataFrame, tree: Tree, reuse_context: bool) -> DataFrame:
        scored = candidates(look, tree.slim, reuse_context)
        rank = F.row_number().over(Window.partitionBy(*KEY).orderBy(-F.round("score", DIGITS), "place"))
        none = F.lit(None).cast("string")
        line = tx.candidate_line(F.col("kind"), F.lit(None).cast("long"), F.array().cast("array<string>"), none, F.col("label"), F.col("title"), F.col("summary"), F.col("node_id"))
        few = scored.withColumn("rank", rank).filter(F.col("rank") <= self.shown).withColumn("line", line)
        few = few.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("rank", "node_id", "kind", "has_children", "title", "line"))).alias("cands"))
        few = stored(few.join(look.select(*KEY, "query", "path"), KEY), "candidates")
        told = few.select("*", prompts.build_prompt("select_json" if self.json else "select", {"query": F.col("query"), "path": F.array_join("path", " > "), "candidates": F.array_join(F.transform("cands", lambda c: c["line"]), "\n")}, self.lang).alias("prompt_text"))
        first = self.ask(told, "select")
        parse = rs.parse_select_json if self.json else rs.parse_select
        wrong = first.filter("error IS NULL").select(*KEY, parse(F.col("response"))["error"].alias("bad")).filter("bad IS NOT NULL")
        again = self.ask(told.join(wrong, KEY).select(*KEY, prompts.retry_prompt(F.col("prompt_text"), F.col("bad")).alias("prompt_text")), "select")
        again = again.select(*KEY, F.col("response").alias("second"), F.col("error").alias("second_error"), F.col("used").alias("second_used"))
        said = few.join(first, KEY).join(again, KEY, "left").withColumn("p", rs.parse_with_fallback(F.col("response"), F.col("second"), self.json))
        failed = F.coalesce("error", "second_error")
        said = said.withColumn("value", F.when(failed.isNull(), F.col("p.value")))
        pick = F.get(F.filter("cands", lambda c: c["node_id"] == F.col("value")), F.lit(0))
        return said.select(
            *KEY, F.struct(*[pick[c].alias(c) for c in ("node_id", "kind", "has_children", "title")]).alias("pick"), F.when(failed.isNotNull(), "ERROR").otherwise(F.coalesce("p.action", F.lit("UNREAD"))).alias("action"), "value", failed.alias("pick_error"),
            F.transform("cands", lambda c: c["node_id"]).alias("listed"), (F.col("used") + F.coalesce("second_used", F.lit(0).cast("long"))).alias("used"),
        )

    def judge(self, loaded: DataFrame) -> DataFrame:
        kind = "evaluate_json" if self.json else "evaluate"
        said = self.ask(loaded.select(*KEY, prompts.build_prompt(kind, {"query": F.col("query"), "title": F.col("title"), "content": F.col("content")}, self.lang).alias("prompt_text")), "evaluate")
        p = (rs.parse_evaluate_json if self.json else rs.parse_evaluate)(F.coalesce("response", F.lit("")))
        verdict = F.when(p["error"].isNotNull(), "unreadable").when(p["sufficient"], "sufficient").otherwise("insufficient")
        return said.select(*KEY, verdict.alias("verdict"), F.array().cast("array<string>").alias("covered"), "used")


def start(queries: DataFrame) -> DataFrame:
    """The state of (query_id, vault, query) rows before the first step."""
    none = F.array().cast("array<string>")
    refs = F.array().cast("array<struct<node_id: string, label: string>>")
    return queries.select(
        *KEY, "query", tx.tokenize(F.col("query")).alias("asked"), F.lit(ROOT).alias("cursor"), none.alias("path"), none.alias("visited"), none.alias("shown"), refs.alias("xref"), none.alias("cited"), none.alias("covered"),
        F.lit(0).alias("steps"), F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("done"), F.lit("").alias("reason"), F.lit(None).cast("string").alias("error"), none.alias("trace"),
    )


def references(look: DataFrame, slim: DataFrame) -> DataFrame:
    """The unvisited cross-references of each walk that are not children of its cursor, placed after these."""
    refs = look.select(*KEY, "asked", "visited", "cursor", "shown", F.explode("xref").alias("x")).select("*", "x.node_id", "x.label")
    refs = refs.filter(~F.array_contains("visited", F.col("node_id"))).join(slim, ["vault", "node_id"]).filter(F.coalesce(F.col("parent_id") != F.col("cursor"), F.lit(True)))
    return refs.withColumn("place", F.concat(F.lit("2"), "place"))


def candidates(look: DataFrame, slim: DataFrame, reuse_context: bool) -> DataFrame:
    """All that each walk may go to, for a prompt that shows it: unvisited children of its cursor, then its cross-references, scored against the query where they stand.

    With ``reuse_context`` those already shown are left out, unless none would be left.
    """
    look = look.select(*KEY, "asked", "cursor", "visited", "xref", "shown")
    carried = [*KEY, "asked", "node_id", "place", "kind", "title", "summary", "has_children", "has", "label", "shown"]
    below = look.join(slim.withColumnRenamed("parent_id", "cursor"), ["vault", "cursor"]).withColumn("label", F.lit(None).cast("string")).filter(~F.array_contains("visited", F.col("node_id")))
    both = below.select(*carried).unionByName(references(look, slim).select(*carried))
    both = both.withColumn("score", overlap_score(F.col("asked"), F.col("has")))
    if reuse_context:
        old = F.array_contains("shown", F.col("node_id"))
        both = both.withColumn("_fresh", F.count_if(~old).over(Window.partitionBy(*KEY))).filter(~old | (F.col("_fresh") == 0)).drop("_fresh")
    return both.drop("asked", "has", "shown")


def new_references(told: DataFrame, edges: DataFrame) -> DataFrame:
    """(KEY, links) of walks that have just read a note: the notes that it links to, in order, each with how it was reached."""
    source = F.when(F.col("pick.kind") == "section", tx.note_of_section(F.col("pick.node_id"), F.lit("section"))).otherwise(F.col("pick.node_id"))
    near = told.select(*KEY, source.alias("source_id")).join(edges, ["vault", "source_id"])
    stem = F.regexp_replace(F.regexp_replace("source_id", "^.*/", ""), r"\.md$", "")
    near = near.groupBy(*KEY, F.regexp_replace("target_id", "#[^#]*$", "").alias("node_id")).agg(F.min(F.struct("pos", F.concat(stem, F.lit(" → [["), "raw_target", F.lit("]]")).alias("label"))).alias("l"))
    near = near.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("l.pos", "node_id", "l.label"))).alias("links"))
    return near.withColumn("links", F.transform("links", lambda x: F.struct(x["node_id"].alias("node_id"), x["label"].alias("label"))))


def step(state: DataFrame, tree: Tree, policy: Overlap | Model, max_tokens: int | None = None, gathered: int = MOST_GATHERED, reuse_context: bool = False) -> DataFrame:
    """One step of every open walk: pick, then enter a folder or a note with sections, or load a note and judge whether it is enough."""
    going = ~F.col("done") & (F.size("cited") < gathered)
    broke = F.col("tokens") >= max_tokens if max_tokens is not None else F.lit(False)
    look = state.filter(going & ~broke)
    if reuse_context:
        last = F.concat(F.array(F.lit("…")), F.slice("path", F.greatest(F.size("path") - PATH_SHOWN + 1, F.lit(1)), F.lit(PATH_SHOWN)))
        look = look.withColumn("path", F.when(F.size("path") > PATH_SHOWN, last).otherwise(F.col("path")))
    told = stored(state.join(policy.choose(look, tree, reuse_context), KEY, "left"), "picks")
    stuck, picked = F.col("action").isNull(), F.coalesce((F.col("action") == "SELECT") & F.col("pick.node_id").isNotNull(), F.lit(False))
    deeper = F.coalesce((F.col("pick.kind") == "folder") | ((F.col("pick.kind") == "note") & F.col("pick.has_children")), F.lit(False))
    text = tree.contents.select("vault", F.col("node_id").alias("picked_id"), F.coalesce("content", F.lit("")).alias("content"))
    loaded = told.filter(picked & ~deeper).select(*KEY, "query", "asked", "covered", F.col("pick.title").alias("title"), F.col("pick.node_id").alias("picked_id")).join(text, ["vault", "picked_id"])
    judged = policy.judge(loaded.filter(tx.has_text(F.col("content")))).select(*KEY, "verdict", F.col("covered").alias("now"), F.col("used").alias("judge_used"))
    found = new_references(told.filter(picked & ~deeper), tree.edges) if tree.edges is not None else None
    told = told.join(judged, KEY, "left")
    if found is not None:  # a verdict that cannot be read follows no links
        told = told.join(found, KEY, "left").withColumn("links", F.when(F.col("verdict").isin("sufficient", "insufficient"), F.col("links")))
    else:
        told = told.withColumn("links", F.lit(None).cast("array<struct<node_id: string, label: string>>"))

    known = F.transform("xref", lambda x: x["node_id"])
    jump = picked & F.array_contains(known, F.col("pick.node_id"))  # what has been enqueued leads back to the root, wherever it was picked
    enter, load = picked & deeper, picked & ~deeper
    read = load & F.col("verdict").isNotNull()
    invalid = F.coalesce((F.col("action") == "SELECT") & ~picked, F.lit(False))
    over = F.coalesce(F.col("action").isin("DONE", "UNREAD", "ERROR"), F.lit(False))
    lost = stuck & ~broke & (F.col("cursor") == ROOT)
    reset = stuck & ~broke & ~lost
    seen = F.when(picked, F.array_append("visited", F.col("pick.node_id"))).when(invalid, F.array_append("visited", F.col("value"))).otherwise(F.col("visited"))
    more = F.filter(F.coalesce("links", F.col("xref")), lambda x: ~F.array_contains(known, x["node_id"]) & ~F.array_contains(F.array_append("visited", F.col("pick.node_id")), x["node_id"]))
    phase = (
        F.when(broke, "budget").when(lost, "exhausted").when(reset, "reset").when(over, F.lower("action")).when(invalid, "invalid")
        .when(enter, "enter").when(read, F.col("verdict")).otherwise("empty")
    )
    none = F.array().cast("array<string>")
    path = F.when(reset | jump, none).otherwise(F.col("path"))
    zero = F.lit(0).cast("long")
    move = {
        "cursor": F.when(enter, F.col("pick.node_id")).when(reset | jump, F.lit(ROOT)).otherwise(F.col("cursor")),
        "path": F.when(enter, F.array_append(path, F.col("pick.title"))).otherwise(path),
        "visited": seen,
        "shown": F.array_union("shown", F.coalesce("listed", none)) if reuse_context else F.col("shown"),
        "xref": F.when(read & F.col("links").isNotNull(), F.concat("xref", more)).otherwise(F.col("xref")),
        "cited": F.when(read, F.array_append("cited", F.col("pick.node_id"))).otherwise(F.col("cited")),
        "covered": F.coalesce("now", "covered"),
        "steps": (F.col("steps") + 1).cast("int"),
        "tokens": F.col("tokens") + F.coalesce("used", zero) + F.coalesce("judge_used", zero),
        "done": broke | lost | over | F.coalesce(F.col("verdict") == "sufficient", F.lit(False)),
        "reason": F.when(F.col("action") == "DONE", F.coalesce("value", F.lit("done"))).otherwise(phase),
        "error": F.coalesce("error", "pick_error"),
        "trace": F.array_append("trace", F.concat(phase, F.lit(" "), F.coalesce("pick.node_id", F.when(invalid, F.col("value")), F.lit("-")))),
    }
    return told.select(*KEY, "query", "asked", *[F.when(going, new).otherwise(F.col(name)).alias(name) for name, new in move.items()])


def navigate(queries: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, policy: Overlap | Model | None = None, steps: int = MOST_STEPS, max_tokens: int | None = None, gathered: int = MOST_GATHERED, reuse_context: bool = False) -> DataFrame:
    """(query_id, vault, query, cited, gathered, steps, tokens, reason, error, trace) of (query_id, vault, query) rows.

    ``edges`` are (vault, source_id, pos, raw_target, target_id) within a vault. Every look at the candidates is a
    step, a reset to the root and the look that finds nothing left too. ``gathered`` are the notes read, in order;
    ``cited`` the same by how well their beginnings fit the query. A walk that has used ``max_tokens`` takes no
    further step. Each step's state is stored, so plans stay short and no model is asked twice.
    """
    policy = policy or Overlap()
    state = stored(start(queries), "walk")
    tree = index_nodes(nodes, edges, state, steps)
    for _ in range(steps):
        state = stored(step(state, tree, policy, max_tokens, gathered, reuse_context), "walk")
        if state.filter(~F.col("done") & (F.size("cited") < gathered)).isEmpty():
            break
    read = state.select(*KEY, "query", F.posexplode("cited").alias("position", "node_id")).join(nodes.select("vault", "node_id", "title", "content"), ["vault", "node_id"])
    one = F.to_json(F.struct(*KEY))  # the re-rank knows queries by one column
    ranked = rerank_citations(state.select(one.alias("query_id"), "query"), read.select(one.alias("query_id"), F.col("position").cast("long").alias("position"), "node_id", "title", "content"))
    order = ranked.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("by_fit")).withColumnRenamed("query_id", "_one")
    out = state.join(order, one == F.col("_one"), "left")
    return out.select(*KEY, "query", F.coalesce("by_fit", F.array().cast("array<string>")).alias("cited"), F.col("cited").alias("gathered"), "steps", "tokens", "reason", "error", "trace")


def trace_rows(walks: DataFrame) -> DataFrame:
    """(query_id, vault, step, phase, node_id) of all steps."""
    each = walks.select(*KEY, F.posexplode("trace").alias("step", "t"))
    return each.select(*KEY, (F.col("step") + 1).cast("long").alias("step"), F.substring_index("t", " ", 1).alias("phase"), F.regexp_replace("t", "^[^ ]* ", "").alias("node_id"))


def answer_status(walks: DataFrame, max_tokens: int | None = None) -> DataFrame:
    """With each walk: none (no evidence), partial (it has used up its budget) or normal."""
    over = F.col("tokens") >= max_tokens if max_tokens is not None else F.lit(False)
    return walks.withColumn("status", F.when(F.size("gathered") == 0, "none").when(over, "partial").otherwise("normal"))


def answers(walks: DataFrame, nodes: DataFrame, model_fn: enrich.ModelFn = enrich.echo_model, lang: str = "en", max_tokens: int | None = None, history: DataFrame | None = None, retries: int = 0, strict: bool = False) -> DataFrame:
    """(query_id, vault, status, answer, error, cited): a model's answer from the notes that a walk has read.

    Without any, the answer says so and why; a walk over its budget gives the beginnings of its notes instead.
    ``history`` (query_id, vault, history) goes before the question.
    """
    told = answer_status(walks, max_tokens)
    read = told.select(*KEY, "status", F.posexplode("gathered").alias("position", "node_id")).join(nodes.select("vault", "node_id", "title", "content"), ["vault", "node_id"])
    one = F.to_json(F.struct(*KEY))
    notes = prompts.listed_notes(read.filter("status = 'normal'").select(one.alias("query_id"), "position", "title", "content")).withColumnRenamed("query_id", "_one")
    part = F.concat(F.lit("\n## "), "title", F.lit("\n"), F.substring("content", 1, CHARS_PER_NOTE))
    parts = read.filter("status = 'partial'").groupBy(*KEY).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", part.alias("t")))), lambda x: x["t"]), "\n").alias("parts"))
    ready = told.filter("status = 'normal'").join(notes, one == F.col("_one"))
    if history is not None:
        ready = ready.join(history, KEY, "left").withColumn("history", F.coalesce("history", F.lit("")))
        with_history = prompts.build_prompt("answer_history", {"history": F.col("history"), "query": F.col("query"), "notes": F.col("notes")}, lang)
        prompt = F.when(F.col("history") != "", with_history).otherwise(prompts.build_prompt("answer", {"query": F.col("query"), "notes": F.col("notes")}, lang))
    else:
        prompt = prompts.build_prompt("answer", {"query": F.col("query"), "notes": F.col("notes")}, lang)
    said = stored(enrich.ask(ready.select(*KEY, prompt.alias("prompt_text")), model_fn, "final", KEY, retries, strict, "answer", lang), "answers").select(*KEY, "response", F.col("error").alias("failed"))
    told = told.join(said, KEY, "left").join(parts, KEY, "left")
    none = F.concat(F.lit("[no evidence] no note was found that bears on the question: "), F.col("reason"))
    answer = F.when(F.col("status") == "none", none).when(F.col("status") == "partial", F.concat(F.lit("[over budget: notes only]"), F.coalesce("parts", F.lit("")))).otherwise(tx.strip(F.col("response")))
    return told.select(*KEY, "status", answer.alias("answer"), F.coalesce("error", "failed").alias("error"), "cited")


def until_error(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """Rows of a batch up to the first with an error, that one included; all of them if there is none."""
    first = rows.filter("error IS NOT NULL").agg(F.min(pos)).scalar()
    return rows.filter(F.coalesce(F.col(pos) <= first, F.lit(True)))


def answer_vaults(queries: DataFrame, vaults: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, policy: Overlap | Model | None = None, model_fn: enrich.ModelFn = enrich.echo_model, exclude: tuple[str, ...] = (), only: tuple[str, ...] = (), lang: str = "en", split: bool = False, **options) -> DataFrame:
    """Every query in every vault, each on its own, and one answer: (query_id, answer, cited as ``vault::id``, steps, vaults with evidence, failed vaults).

    ``vaults`` are (pos, vault); ``exclude`` and ``only`` restrict them. A vault whose walk ends with an error counts
    as failed and the others go on; if all fail, the answer says so. Answers of several vaults are made one by the model.
    With ``split`` a query is first split into parts, once for all vaults, and a vault's answer is made of those of its
    parts; a vault has then failed if all its parts have.
    """
    vaults = vaults.filter(F.col("vault").isin(*only)) if only else vaults
    vaults = vaults.filter(~F.col("vault").isin(*exclude)) if exclude else vaults
    every = vaults.agg(F.collect_list(F.struct("pos", "vault"))).scalar()  # vaults are few: every query meets every one of them
    asked = queries.select("query_id", "query", F.explode(every).alias("v")).select("query_id", "query", "v.*")
    if split:
        keyed = stored(asked.withColumn("key", F.concat_ws("/", "query_id", "vault")), "asked")
        subs = decompose(queries.withColumn("vault", F.lit("")), model_fn, lang=lang).select("query_id", "part", F.col("query").alias("sub"))
        subs = keyed.join(subs, "query_id").select(F.col("key").alias("query_id"), "vault", "part", F.col("sub").alias("query"))
        said = answer_decomposed(keyed.select(F.col("key").alias("query_id"), "vault", "query"), nodes, edges, policy, model_fn, subs, lang, **options)
        parts = subs.groupBy(F.col("query_id").alias("key")).agg(F.count(F.lit(1)).alias("n_parts"))
        said = said.select(F.col("query_id").alias("key"), "answer", "cited", "steps", F.when(F.col("with_evidence") > 0, "normal").otherwise("none").alias("status"), F.size("failed").alias("n_failed"))
        told = stored(keyed.join(said, "key").join(parts, "key").withColumn("error", F.when(F.col("n_failed") >= F.col("n_parts"), F.col("answer"))), "told")
        good = told.filter("error IS NULL").withColumn("cited", F.transform("cited", lambda c: F.concat("vault", F.lit("::"), c)))
        return _merged(queries, good, told, model_fn, lang, F.col("vault"), "failed", F.col("vault"), "[all vaults failed]")
    walks = stored(navigate(asked.select(*KEY, "query"), nodes, edges, policy, **options), "walks")
    said = answers(walks, nodes, model_fn, lang, options.get("max_tokens"))
    told = asked.join(said, KEY).join(walks.select(*KEY, "steps"), KEY)
    good = told.filter("error IS NULL").withColumn("cited", F.transform("cited", lambda c: F.concat("vault", F.lit("::"), c)))
    return _merged(queries, good, told, model_fn, lang, F.col("vault"), "failed", F.col("vault"), "[all vaults failed]")


def _merged(queries: DataFrame, good: DataFrame, told: DataFrame, model_fn: enrich.ModelFn, lang: str, title: Column, bad_name: str, bad_value: Column, all_failed: str) -> DataFrame:
    """One row a query from its parts (query_id, pos, answer, cited, steps, status): the only answer with evidence, or a synthesis of all; citations in order, each once."""
    entry = F.struct("pos", "status", F.concat(F.lit("### "), title, F.lit("\n"), F.coalesce("answer", F.lit(""))).alias("text"), "answer", "cited")
    per = good.groupBy("query_id").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    fails = told.groupBy("query_id").agg(F.sum("steps").alias("steps"), F.sort_array(F.collect_list(F.when(F.col("error").isNotNull(), bad_value))).alias(bad_name))
    per = stored(queries.select("query_id", "query").join(fails, "query_id").join(per, "query_id", "left").withColumn("l", F.coalesce("l", F.array().cast(per.schema["l"].dataType))), "parts")
    found = F.filter("l", lambda x: x["status"] != "none")
    several = per.filter(F.size(found) > 1).select("query_id", prompts.build_prompt("synthesise", {"query": F.col("query"), "parts": F.array_join(F.transform(found, lambda x: F.substring(x["text"], 1, prompts.CAPS["synthesise"]["content"])), "\n\n")}, lang).alias("prompt_text"))
    one = stored(enrich.ask(several, model_fn, "synthesise", ["query_id"], kind="synthesise", lang=lang), "synthesis").select("query_id", "response", F.col("error").alias("problem"))
    answer = (
        F.when(F.size("l") == 0, all_failed).when(F.size(found) == 0, F.get("l", F.lit(0))["answer"]).when(F.size(found) == 1, F.get(found, F.lit(0))["answer"])
        .otherwise(F.coalesce(tx.strip(F.col("response")), F.array_join(F.transform(found, lambda x: x["text"]), "\n\n")))
    )
    cited = F.array_distinct(F.flatten(F.transform("l", lambda x: x["cited"])))
    return per.join(one, "query_id", "left").select("query_id", answer.alias("answer"), cited.alias("cited"), "steps", F.size(found).cast("long").alias("with_evidence"), bad_name)


def decompose(queries: DataFrame, model_fn: enrich.ModelFn, most: int = 4, lang: str = "en") -> DataFrame:
    """(query_id, vault, part, query): the sub-queries that a model makes of each query, at most ``most``; the query itself if it makes none, or fails."""
    said = stored(enrich.ask(queries.select(*KEY, prompts.build_prompt("decompose", {"n": F.lit(most), "query": F.col("query")}, lang).alias("prompt_text")), model_fn, "decompose", KEY, kind="decompose", lang=lang), "decompose")
    subs = F.slice(rs.parse_decompose(F.coalesce("response", F.lit(""))), 1, most)
    told = queries.join(said.select(*KEY, subs.alias("subs")), KEY)
    return told.select(*KEY, F.posexplode(F.when(F.size("subs") > 1, F.col("subs")).otherwise(F.array("query"))).alias("part", "query"))


def answer_decomposed(queries: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, policy: Overlap | Model | None = None, model_fn: enrich.ModelFn = enrich.echo_model, subs: DataFrame | None = None, lang: str = "en", **options) -> DataFrame:
    """(query_id, answer, cited, steps, parts with evidence, failed): the sub-queries of each query are walked and answered each, then one answer is made of them.

    ``subs`` (query_id, vault, part, query) are the model's (`decompose`) unless they are given. A query is asked in one vault.
    """
    subs = stored(subs if subs is not None else decompose(queries, model_fn, lang=lang), "subs")
    key = F.concat_ws("/", "query_id", "part")
    walks = stored(navigate(subs.select(key.alias("query_id"), "vault", "query"), nodes, edges, policy, **options), "walks")
    said = answers(walks, nodes, model_fn, lang, options.get("max_tokens")).join(walks.select(*KEY, "query", "steps"), KEY).withColumnRenamed("query_id", "key").drop("vault")
    told = subs.select(key.alias("key"), "query_id", F.col("part").alias("pos")).join(said.withColumnRenamed("query", "sub"), "key")
    return _merged(queries, told.filter("error IS NULL"), told, model_fn, lang, F.col("sub"), "failed", F.col("sub"), "[all parts failed]")


def chat_turn(turns: DataFrame, asked: DataFrame, nodes: DataFrame, edges: DataFrame | None = None, policy: Overlap | Model | None = None, model_fn: enrich.ModelFn = enrich.echo_model, lang: str = "en", n_history: int = 3, answer_chars: int = 200, **options) -> DataFrame:
    """The next turn of many sessions: (session_id, turn, question, rewritten, answer, error, cited), to be appended to ``turns``.

    ``turns`` are (session_id, turn, question, answer), ``asked`` (session_id, vault, question). A question with turns
    before it is first rewritten so that it stands alone; the rewritten one is walked, and answered with the history.
    """
    back = Window.partitionBy("session_id").orderBy(F.desc("turn"))
    last = turns.join(asked.select("session_id"), "session_id", "left_semi").withColumn("k", F.row_number().over(back))
    n = last.groupBy("session_id").agg(F.max("turn").alias("turn"))
    line = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), F.substring("answer", 1, answer_chars))
    said = last.filter(F.col("k") <= n_history).groupBy("session_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("history"))
    told = stored(asked.join(n, "session_id", "left").join(said, "session_id", "left").select("session_id", "vault", "question", (F.coalesce("turn", F.lit(0)) + 1).alias("turn"), F.coalesce("history", F.lit("")).alias("history")), "asked")
    rows = told.filter("history <> ''").select("session_id", prompts.build_prompt("rewrite", {"history": F.col("history"), "query": F.col("question")}, lang).alias("prompt_text"))
    again = stored(enrich.ask(rows, model_fn, "rewrite", ["session_id"], kind="rewrite", lang=lang), "rewritten").select("session_id", tx.strip(F.col("response")).alias("again"))
    told = told.join(again, "session_id", "left").withColumn("rewritten", F.coalesce(F.nullif("again", F.lit("")), "question")).drop("again")
    walks = stored(navigate(told.select(F.col("session_id").alias("query_id"), "vault", F.col("rewritten").alias("query")), nodes, edges, policy, **options), "walks")
    history = told.select(F.col("session_id").alias("query_id"), "vault", "history")
    got = answers(walks, nodes, model_fn, lang, options.get("max_tokens"), history)
    return told.join(got.withColumnRenamed("query_id", "session_id").drop("vault", "status"), "session_id").select("session_id", "turn", "question", "rewritten", "answer", "error", "cited")
