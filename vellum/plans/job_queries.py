"""Queries over sinks, prompts, model enrichment, retrieval walks and streams."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import changes, corpus, enrich, entities as en, links, navigate as nav, prompts, sections, usage
from ..sources import files
from ..sources.keyed import cache_at
from ..sources.tables import fresh_path, stored
from ..streaming import usage_streams as us
from .corpus_queries import notes, queries_, raw_notes, thinned
from .registry import query
from .usage_queries import events
from .views import TABLES, VIEWS, view


def sql_prompt(kind: str, fields: dict[str, str], lang: str = "en", with_system: bool = False) -> str:
    """The SQL text that fills a template."""
    out = []
    for text, name in prompts.parts_of(kind, lang, with_system):
        out.append("'" + text.replace("'", "''") + "'")
        if name:
            cap = prompts.CAPS.get(kind, {}).get(name)
            out.append(f"substring({fields[name]}, 1, {cap})" if cap else f"coalesce({fields[name]}::VARCHAR, '')")
    return " || ".join(out)


def echo(sql: str) -> str:
    return f"length({sql}) || ':' || substring({sql}, greatest(1, length({sql}) - 19))"


# Sinks


@query("SELECT event_id, phase, prompt, ts::DATE::VARCHAR AS day FROM usage_src")
def write_usage(spark, sf):
    path = fresh_path(spark, "usage")
    half = events(spark, sf)
    for rest in (0, 1):
        files.write_usage(half.filter(F.col("event_id") % 2 == rest), path)
    return spark.read.parquet(path).select("event_id", "phase", "prompt", F.col("day").cast("string").alias("day"))


@query("SELECT count(*) AS cleared, 0 AS left FROM usage_src")
def clear_usage(spark, sf):
    path = fresh_path(spark, "usage")
    events(spark, sf).write.parquet(path)
    n = files.clear_usage(spark, path)
    return spark.read.parquet(path).agg(F.lit(n).cast("long").alias("cleared"), F.count(F.lit(1)).alias("left"))


@query("SELECT path, mtime FROM snapshot_cur")
def write_snapshot(spark, sf):
    path = fresh_path(spark, "snapshots")
    files.write_snapshot(view(spark, sf, "snapshot_prev"), path, 1)
    files.write_snapshot(view(spark, sf, "snapshot_cur"), path, 2)
    return files.load_snapshot(spark, path)


PAGE_FILES = "(SELECT regexp_replace(trim(regexp_replace(name, '[^\\w\\s\\p{L}-]', '', 'g')), '\\s+', '-', 'g') || '.md' AS file, max(key) AS key FROM entities GROUP BY 1)"


def entities(spark, sf):
    return en.aggregate_entities(stored(en.mention_facts(view(spark, sf, "model_output_src").select(F.col("doc_id").alias("note_id"), "response"))))


@query(f"SELECT 'pages' AS part, file AS name, 1 AS n FROM {PAGE_FILES} UNION ALL SELECT 'index', category, count(*) FROM entities GROUP BY category UNION ALL SELECT 'log', '', 2")
def write_pages(spark, sf):
    path = fresh_path(spark, "wiki")
    found = stored(entities(spark, sf))
    pages = en.pages_by_slug(found.withColumn("content", F.concat(F.lit("# "), "name")))
    for _ in range(2):
        files.write_pages(pages, en.entity_index(found), en.compile_log(found, 1), path)
    back = lambda part: spark.read.parquet(f"{path}/{part}")
    one = F.lit(1).cast("long")
    out = back("pages").select(F.lit("pages").alias("part"), F.col("file").alias("name"), one.alias("n"))
    out = out.unionByName(back("index").groupBy(F.lit("index").alias("part"), F.col("category").alias("name")).agg(F.count(F.lit(1)).alias("n")))
    return out.unionByName(back("log").agg(F.count(F.lit(1)).alias("n")).select(F.lit("log").alias("part"), F.lit("").alias("name"), "n"))


@query("SELECT query_id, query, count(*) AS n FROM queries_src, (VALUES (1), (2)) GROUP BY query_id, query")
def write_query_log(spark, sf):
    path = fresh_path(spark, "query_log")
    for _ in range(2):
        files.write_query_log(queries_(spark, sf), path)
    return spark.read.parquet(path).groupBy("query_id", "query").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT query_id AS pos, '## ' || query || chr(10) || chr(10) || CASE WHEN query_id % 4 = 0 THEN '[ERROR] late' ELSE 'a' || query_id END || chr(10) AS value FROM queries_src")
def export_batch(spark, sf):
    bad = F.when(F.col("query_id") % 4 == 0, "late")
    return files.export_batch(queries_(spark, sf).select(F.col("query_id").alias("pos"), "query", F.concat(F.lit("a"), "query_id").alias("answer"), bad.alias("error")))


# Prompts and enrichment

FIELDS = {"title": "title", "content": "body", "note": "title", "query": "title", "path": "node_id", "candidates": "body", "notes": "body", "history": "node_id", "n": "4", "parts": "body", "name": "title", "category": "vault", "mentions": "node_id", "xrefs": "node_id"}
KINDS = [(kind, lang) for kind in prompts.TEMPLATES for lang in ("en", "ko")]


@query(" UNION ALL ".join(f"SELECT vault, node_id, '{k}' AS kind, '{lang}' AS lang, length(p) AS n, sha256(p) AS sha FROM (SELECT vault, node_id, {sql_prompt(k, FIELDS, lang, True)} AS p FROM notes_src)" for k, lang in KINDS))
def build_prompts(spark, sf):
    cols = {k: F.lit(4) if c == "4" else F.col(c) for k, c in FIELDS.items()}
    filled = [F.struct(F.lit(k).alias("kind"), F.lit(lang).alias("lang"), prompts.build_prompt(k, cols, lang, True).alias("p")) for k, lang in KINDS]
    each = raw_notes(spark, sf).select("vault", "node_id", F.explode(F.array(*filled)).alias("x"))
    return each.select("vault", "node_id", "x.kind", "x.lang", F.length("x.p").cast("long").alias("n"), F.sha2("x.p", 256).alias("sha"))


SUMMARY = sql_prompt("summary", {"title": "title", "content": "body"})


@query(f"""SELECT vault, node_id, CASE WHEN mtime % 3 = 0 THEN 'old' ELSE trim({echo(SUMMARY)}, ' ' || chr(10) || '"''') END AS summary, mtime % 3 = 0 AS cached
  FROM (SELECT n.*, s.doc_id AS mtime FROM notes n JOIN notes_src s USING (vault, node_id) WHERE tier = 'atomic')""")
def summarize_notes(spark, sf):
    mtimes = raw_notes(spark, sf).select("vault", "node_id", F.col("doc_id").alias("mtime"))
    dated = notes(spark, sf).join(mtimes, ["vault", "node_id"])
    cache = mtimes.filter("mtime % 3 = 0").withColumn("response", F.lit(' "old" '))
    return enrich.summarize_notes(dated, cache=cache)[0].drop("mtime")


@query(f"""SELECT vault, node_id, trim({echo(SUMMARY)}, ' ' || chr(10) || chr(34) || chr(39)) AS summary, 1 AS calls_a_note, true AS cached
  FROM (SELECT n.*, s.doc_id FROM notes n JOIN notes_src s USING (vault, node_id) WHERE tier = 'atomic')""")
def summarize_cached(spark, sf):
    """Three runs with a cache that lasts: two notes in three, then all of them, then again. What an earlier run asked is not asked again."""
    dated = notes(spark, sf).join(raw_notes(spark, sf).select("vault", "node_id", F.col("doc_id").alias("mtime")), ["vault", "node_id"])
    cache = cache_at(spark, buckets=8)
    asked = [enrich.summarize_notes(some, cache=cache)[1] for some in (dated.filter("mtime % 3 > 0"), dated)]
    said, _ = enrich.summarize_notes(dated, cache=cache)
    n = asked[0].unionByName(asked[1]).count() / max(1, cache.entries().count())  # of both runs together
    return said.select("vault", "node_id", "summary", F.lit(n).cast("int").alias("calls_a_note"), "cached")


def counting_model(batch):
    """Echoes, and reports a thousand tokens of prompt and a hundred of answer for each call."""
    return [enrich.Reply(text, 1000, 100) for text in enrich.echo_model(batch)]


WAVE, BUDGET = 40, 100_000
REACHED = f"{WAVE} * ceil({BUDGET} / ({WAVE} * 1100))"


@query(f"""SELECT least(n, {REACHED})::BIGINT AS calls, least(n, {REACHED})::BIGINT * 1100 AS tokens, greatest(0, n - {REACHED})::BIGINT AS left_out, first_left_out FROM (
    SELECT count(*) AS n, min(CASE WHEN k > {REACHED} THEN vault || '/' || node_id END) AS first_left_out FROM (
      SELECT vault, node_id, row_number() OVER (ORDER BY vault, node_id) AS k FROM notes WHERE tier = 'atomic'))""")
def summarize_budget(spark, sf):
    """Summaries in waves until the tokens that the model reports reach the budget."""
    todo = notes(spark, sf).withColumn("mtime", F.lit(0))
    said, used, left = enrich.summarize_within(todo, BUDGET, counting_model, WAVE)
    rest = todo.filter("tier = 'atomic'").join(said.select("vault", "node_id"), ["vault", "node_id"], "left_anti").agg(F.min(F.concat_ws("/", "vault", "node_id")))
    told = used.agg(F.count(F.lit(1)).alias("calls"), F.sum(F.col("prompt") + F.col("completion")).alias("tokens"))
    return told.select("calls", "tokens", F.lit(left).cast("long").alias("left_out"), rest.scalar().alias("first_left_out"))


def system_model(batch):
    """Answers with the length of the standing part and of the rest, and reports these as tokens."""
    return [enrich.Reply(f"{len(system)}+{len(user)}", len(system) + len(user), 7) for system, user in batch]


ANSWER, STANDING = sql_prompt("answer", {"query": "query", "notes": "query"}), len(prompts.SYSTEM["answer"]["en"])


@query(f"SELECT query_id, '{STANDING}+' || length(p) AS response, {STANDING} + length(p) AS prompt, 7 AS completion, true AS cacheable FROM (SELECT query_id, {ANSWER} AS p FROM queries_src)")
def track_real_usage(spark, sf):
    """Calls of a model that takes the standing part apart and reports its own tokens."""
    rows = queries_(spark, sf).select("query_id", prompts.build_prompt("answer", {"query": F.col("query"), "notes": F.col("query")}).alias("prompt_text"))
    said = enrich.ask(rows, enrich.SystemModel(system_model), "final", ["query_id"], kind="answer")
    return said.select("query_id", "response", "prompt", F.col("completion").cast("int").alias("completion"), "cacheable")


def section_rows(spark, sf):
    kept = sections.section_ranges(thinned(spark, sf))
    return sections.section_texts(kept, raw_notes(spark, sf))


SECTION = sql_prompt("section_summary", {"note": "note", "title": "title", "content": "body"})


@query(f"""WITH r AS (SELECT t.vault, t.node_id, t.note_title AS note, t.title, t.seq, t.kept_seq, t.start_line, coalesce(min(o.start_line), t.n_lines + 1) AS end_line
    FROM thinned t LEFT JOIN thinned o ON o.vault = t.vault AND o.node_id = t.node_id AND o.seq > t.seq AND o.level <= t.level
    GROUP BY t.vault, t.node_id, t.note_title, t.title, t.seq, t.kept_seq, t.start_line, t.n_lines),
  x AS (SELECT r.vault, r.node_id || '#' || lpad(kept_seq::VARCHAR, 4, '0') AS section_id, note, r.title, string_agg(l.line, chr(10) ORDER BY l.line_no) AS body
    FROM r JOIN lines l ON l.vault = r.vault AND l.node_id = r.node_id AND l.line_no >= r.start_line AND l.line_no < r.end_line GROUP BY r.vault, r.node_id, kept_seq, note, r.title),
  f AS (SELECT *, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda y: trim(y)), lambda y: y <> '' AND NOT starts_with(y, '#'))[1], '') AS s FROM x)
  SELECT vault, section_id, CASE WHEN length(body) // 3 >= 200 THEN trim({echo(SECTION)}, ' ' || chr(10) || chr(34) || chr(39)) WHEN length(s) > 160 THEN rtrim(substring(s, 1, 160)) || '…' ELSE s END AS summary FROM f""")
def summarize_sections(spark, sf):
    return enrich.summarize_sections(section_rows(spark, sf))[0]


@query("SELECT count(*) AS built, (SELECT count(*) FROM notes WHERE tier = 'long' AND node_id LIKE 'en/%') AS cached FROM notes WHERE tier = 'long' AND node_id NOT LIKE 'en/%'")
def build_subtrees(spark, sf):
    long = corpus.filter_tier(notes(spark, sf), "long")
    cache = long.filter(F.col("node_id").startswith("en/")).select("vault", "node_id")
    built = sections.thin_sections(sections.section_tree(changes.cache_misses(long, cache, ["vault", "node_id"])))
    n = built.select("vault", "node_id").distinct().agg(F.count(F.lit(1)).alias("built"))
    return n.select("built", changes.cache_hits(long, cache, ["vault", "node_id"]).agg(F.count(F.lit(1))).scalar().alias("cached"))


@query(f"SELECT 'summarize' AS phase, count(*) AS calls, sum(greatest(1, length({SUMMARY}) // 3))::BIGINT AS prompt, sum(greatest(1, length({echo(SUMMARY)}) // 3))::BIGINT AS completion FROM notes WHERE tier = 'atomic'")
def track_usage(spark, sf):
    _, used = enrich.summarize_notes(notes(spark, sf).withColumn("mtime", F.lit(0)))
    return used.groupBy("phase").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))


def first_word_model(batch):
    """Names the first word of the note's text as its one entity."""
    return [f"ENTITY: {body.split()[0]} | Concept | d" if (body := p.split("\n\n", 2)[2]).split() else "NONE" for p in batch]


@query("""SELECT lower(regexp_extract(text, '^\\s*(\\S+)', 1)) AS key, 'concept' AS category, count(*) AS n_mentions FROM documents WHERE trim(text) <> '' GROUP BY 1""")
def extract_entities(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("note_id"), F.lit("t").alias("title"), F.replace("text", F.lit("|"), F.lit("/")).alias("body"))
    said, _ = enrich.extract_entities(docs, first_word_model)
    return en.aggregate_entities(stored(en.mention_facts(said))).select("key", "category", "n_mentions")


@query(f"SELECT file, key FROM {PAGE_FILES}")
def generate_pages(spark, sf):
    facts = stored(en.mention_facts(view(spark, sf, "model_output_src").select(F.col("doc_id").alias("note_id"), "response")))
    pages, _ = enrich.generate_pages(en.xref_hint(en.aggregate_entities(facts)), facts)
    return en.pages_by_slug(pages).select("file", "key")


# Retrieval


def walk_inputs(spark, sf):
    raw = notes(spark, sf).withColumn("summary", tx.fallback_summary(F.regexp_replace("body", r"(?s)\A---\n.*?\n---\n", "")))
    raw = stored(raw, "notes")
    found = links.resolve_links(links.note_links(raw), raw).filter("vault = target_vault").select("vault", "source_id", "pos", "raw_target", "target_id")
    long = corpus.filter_tier(raw, "long")
    texts = sections.section_texts(sections.section_ranges(sections.thin_sections(sections.section_tree(long))), long)
    return stored(nav.build_nodes(raw, texts), "nodes"), stored(found, "edges")


def asked(spark, sf):
    return queries_(spark, sf).withColumn("vault", F.concat(F.lit("src"), F.col("query_id") % 20))


@query()
def navigate(spark, sf):
    nodes, edges = walk_inputs(spark, sf)
    return nav.navigate(asked(spark, sf), nodes, edges)


@query()
def navigate_trace(spark, sf):
    nodes, edges = walk_inputs(spark, sf)
    return nav.trace_rows(nav.navigate(asked(spark, sf), nodes, edges))


def guide(batch):
    """A stand-in for a model, a function of each prompt: picks the first candidate shown, finds a note enough if it holds any of the question's last three words, and echoes in answers."""
    out = []
    for p in batch:
        ids, question = re.findall(r"^   node_id: (.*)$", p, re.MULTILINE), re.search(r"Question: (.*)", p)
        if "Reply SELECT" in p:
            out.append(f"SELECT: {ids[0]}" if ids else "DONE: nothing")
        elif "Reply SUFFICIENT" in p:
            last = question[1].split()[-3:]
            body = p.split("\n\nNote: ", 1)[1]
            out.append("SUFFICIENT: there" if any(w in body for w in last) else "INSUFFICIENT: not there")
        elif p.startswith("Split into"):
            words = p.rsplit("\n\n", 1)[1].split()
            out.append("\n".join(f"SUB: {' '.join(words[i::2])}" for i in range(2)) if len(words) > 3 else "SINGLE")
        else:
            out.append(f"{len(p)}:{p[-20:]}")
    return out


@query()
def navigate_model(spark, sf):
    """Walks that a model decides."""
    nodes, edges = walk_inputs(spark, sf)
    return nav.navigate(asked(spark, sf), nodes, edges, nav.Model(guide))


@query()
def navigate_vaults(spark, sf):
    """Every query in every vault that the notes have."""
    nodes, edges = walk_inputs(spark, sf)
    vaults = nodes.select("vault").distinct().select(F.rank().over(Window.orderBy("vault")).alias("pos"), "vault")  # a row a vault
    return nav.answer_vaults(queries_(spark, sf), stored(vaults, "vaults"), nodes, edges)


@query()
def navigate_vaults_decomposed(spark, sf):
    """Every query, split by a model, in every vault: parts are answered inside of each vault, and vaults after that."""
    nodes, edges = walk_inputs(spark, sf)
    vaults = nodes.select("vault").distinct().select(F.rank().over(Window.orderBy("vault")).alias("pos"), "vault")  # a row a vault
    return nav.answer_vaults(queries_(spark, sf), stored(vaults, "vaults"), nodes, edges, model_fn=guide, split=True)


@query()
def navigate_decomposed(spark, sf):
    """Queries that a model splits, whose parts are walked and whose answers are made one."""
    nodes, edges = walk_inputs(spark, sf)
    return nav.answer_decomposed(asked(spark, sf), nodes, edges, model_fn=guide)


@query()
def answer_status(spark, sf):
    nodes, edges = walk_inputs(spark, sf)
    walks = nav.navigate(asked(spark, sf), nodes, edges, nav.Model(guide), max_tokens=3000)
    return nav.answer_status(walks, 3000).groupBy("status").agg(F.count(F.lit(1)).alias("queries"), F.sum("tokens").alias("tokens"))


def moody(batch):
    """Echoes, but fails on prompts whose length is a multiple of seven."""
    if any(len(p) % 7 == 0 for p in batch):
        raise RuntimeError("no answer")
    return enrich.echo_model(batch)


@query()
def batch_answers(spark, sf):
    """Answers of the whole table of queries from the notes that their walks cite; where the model fails the row has the error, and the report says so."""
    nodes, edges = walk_inputs(spark, sf)
    walks = stored(nav.navigate(asked(spark, sf), nodes, edges), "walks")
    told = stored(nav.answers(walks, nodes, moody), "answers").join(queries_(spark, sf), "query_id")
    rows = told.select(F.col("query_id").alias("pos"), "query", "answer", "error")
    stopped = nav.until_error(rows).select("pos", F.lit(True).alias("before_stop"))
    return files.export_batch(rows).join(stopped, "pos", "left").select("pos", "value", F.coalesce("before_stop", F.lit(False)).alias("before_stop"))


HISTORY = "coalesce(string_agg('Q: ' || question || chr(10) || 'A: ' || substring(answer, 1, 200), chr(10) ORDER BY p) FILTER (p IS NOT NULL), '')"


@query(f"""SELECT session_id, turn, {echo(sql_prompt("rewrite", {"history": "history", "query": "question"}))} AS rewritten FROM (
    SELECT session_id, turn, any_value(q) AS question, substring({HISTORY}, 1, 100000) AS history FROM (
      SELECT a.session_id, a.turn, a.question AS q, b.turn AS p, b.question, b.answer, row_number() OVER (PARTITION BY a.session_id, a.turn ORDER BY b.turn DESC) AS k
      FROM turns_src a LEFT JOIN turns_src b ON b.session_id = a.session_id AND b.turn < a.turn) WHERE k <= 3 GROUP BY session_id, turn)""")
def chat_rewrites(spark, sf):
    """Follow-ups rewritten with their history, all turns of all sessions in one job, as the answers before them are known."""
    told = usage.recent_history(view(spark, sf, "turns_src"))
    history = F.array_join(F.transform("history", lambda h: F.concat(F.lit("Q: "), h["question"], F.lit("\nA: "), h["answer"])), "\n")
    rows = told.select("session_id", "turn", prompts.build_prompt("rewrite", {"history": history, "query": F.col("question")}).alias("prompt_text"))
    return enrich.enrich(rows, ["session_id", "turn"], phase="rewrite")[0].select("session_id", "turn", F.col("response").alias("rewritten"))


@query()
def chat_answers(spark, sf):
    """The last question of every session asked again in a vault: rewritten, walked, answered with its history, and appended to the session's turns."""
    nodes, edges = walk_inputs(spark, sf)
    turns = view(spark, sf, "turns_src")
    last = turns.groupBy("session_id").agg(F.max_by("question", "turn").alias("question")).withColumn("vault", F.concat(F.lit("src"), F.pmod("session_id", F.lit(20))))
    path = fresh_path(spark, "turns")
    turns.select("session_id", F.col("turn").cast("long").alias("turn"), "question", "answer", F.array().cast("array<string>").alias("cited")).write.parquet(path)
    fresh = nav.chat_turn(spark.read.parquet(path), last, nodes, edges)
    fresh.select("session_id", F.col("turn").cast("long").alias("turn"), "question", "answer", "cited").write.mode("append").parquet(path)
    return spark.read.parquet(path)


# Streams


def event_stream(spark, sf):
    """The events table as a stream, in the shape of the usage view."""
    base = us.read_stream(spark, f"{sf}/events.parquet")
    name = "events_stream_" + sf.encode().hex()
    base.createOrReplaceTempView(name)
    return spark.sql(re.sub(TABLES.pattern, f"FROM `{name}`", VIEWS["usage_src"])).withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT event_id, phase, prompt FROM usage_src")
def tail_usage(spark, sf):
    return us.streamed(spark, lambda path, check: us.tail_usage(event_stream(spark, sf), path, check)).select("event_id", "phase", "prompt")


@query("SELECT ts::DATE::VARCHAR AS day, phase, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion FROM usage_src GROUP BY ALL")
def stream_rollup(spark, sf):
    """The log in a shuffled order, in several batches: rows that come too late are the batch rollup's, and both together are the whole."""
    path, out = fresh_path(spark, "shuffled"), fresh_path(spark, "rollup")
    events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(5, F.xxhash64("event_id")).write.parquet(path)
    us.stream_rollup(us.read_stream(spark, path + "/", 1), out, fresh_path(spark, "checkpoint"), fold_after=2)
    return us.rollup_with_late(spark, out).withColumn("day", F.col("day").cast("string"))


@query("SELECT phase, count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion FROM usage_src GROUP BY phase")
def stream_totals(spark, sf):
    return us.latest(us.streamed(spark, lambda path, check: us.stream_totals(event_stream(spark, sf), path, check)), ["phase"])


def listing(spark, sf, name):
    """A snapshot view with paths as they are in a vault: strings."""
    return view(spark, sf, name).withColumn("path", F.concat(F.lit("n/"), F.col("path"), F.lit(".md")))


@query("SELECT 'n/' || path || '.md' AS path, kind FROM diff")
def watch_changes(spark, sf):
    """Two polls: the second finds what changed since the first."""
    path = fresh_path(spark, "watch")
    us.watch_changes(spark, listing(spark, sf, "snapshot_prev"), path, 1)
    return us.watch_changes(spark, listing(spark, sf, "snapshot_cur"), path, 2)


@query("SELECT 'n/' || s.doc_id || '.md' AS path, t.kept_seq, t.title, t.subtree_tokens FROM thinned t JOIN notes_src s USING (vault, node_id) WHERE s.doc_id % 10 <> 1")
def watch_rebuild(spark, sf):
    """Section trees of all notes after two polls: built for what was added or modified, gone for what was deleted."""
    path, raw = fresh_path(spark, "watch"), raw_notes(spark, sf).withColumn("path", F.concat(F.lit("n/"), F.col("doc_id"), F.lit(".md")))
    us.watch_changes(spark, listing(spark, sf, "snapshot_prev"), path, 1)
    us.watch_changes(spark, listing(spark, sf, "snapshot_cur"), path, 2)

    def rebuild(touched):
        some = raw.join(touched, "path", "left_semi")
        kept = sections.thin_sections(sections.section_tree(some)).join(raw.select("vault", "node_id", "path"), ["vault", "node_id"])
        return kept.select("path", F.substring_index("section_id", "#", -1).cast("long").alias("kept_seq"), "title", "subtree_tokens")

    into = us.streamed(spark, lambda out, check: us.watch_rebuild(spark, path, check, rebuild, out))
    return us.current(into, "path")


@query("""SELECT session_id, min(ts) AS start, max(ts) AS last_active, count(*) AS turns FROM (
    SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM usage_src)) GROUP BY session_id, n""")
def stream_sessions(spark, sf):
    """The log in a shuffled order, in several batches, all within the watermark."""
    path = fresh_path(spark, "shuffled")
    events(spark, sf).select("event_id", "session_id", F.col("ts").cast("timestamp").alias("ts")).repartitionByRange(4, F.xxhash64("event_id")).write.parquet(path)
    table = us.streamed(spark, lambda out, check: us.stream_sessions(us.read_stream(spark, path + "/", 1), out, check, late="3650 days"))
    return us.open_sessions(table)


@query("SELECT kind, event_id FROM (SELECT 'backfill' AS kind, event_id FROM usage_src ORDER BY ts DESC, event_id DESC LIMIT 50) UNION ALL SELECT kind, event_id FROM (SELECT 'new' AS kind, event_id FROM usage_src ORDER BY ts, event_id LIMIT 200)")
def tail_follow(spark, sf):
    """The last fifty events as of now, then the log as a stream until two hundred events have passed."""
    path = fresh_path(spark, "tail")
    us.follow(event_stream(spark, sf), path, fresh_path(spark, "checkpoint"), log=events(spark, sf), backfill=50, most=200, seconds=120)
    return spark.read.parquet(path).filter("kind <> 'heartbeat'").select("kind", "event_id")


@query("SELECT session_id, CASE WHEN session_id % 2 = 0 THEN 0 ELSE count(*) END AS turns FROM turns_src GROUP BY session_id")
def clear_session(spark, sf):
    """The turns of every session as a stream, then a row that clears every other session."""
    path = fresh_path(spark, "turns")
    turns = view(spark, sf, "turns_src").select("session_id", "turn", "question", F.lit("").alias("control"))
    turns.unionByName(turns.filter("session_id % 2 = 0").select("session_id", F.lit(1 << 40).alias("turn"), F.lit(None).cast("string").alias("question"), F.lit("clear").alias("control")).distinct()).write.parquet(path)
    table = us.streamed(spark, lambda out, check: us.drain(us.session_history(us.read_stream(spark, path)), us._append_to(out), check, "update"))
    return us.latest(table, ["session_id"]).select("session_id", "turns")
