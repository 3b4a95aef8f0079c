"""Queries over usage events, sessions, budgets, snapshots and caches."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import changes, corpus, usage
from ..sources import files
from ..sources.keyed import cache_at
from ..sources.tables import fresh_path
from .corpus_queries import notes, raw_notes
from .registry import query
from .views import view

SUMS = "count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, round(sum(elapsed), 6) AS elapsed"
FLAT = "array_to_string(list_transform({0}, lambda x: x.phase || ':' || x.calls || ':' || x.prompt || ':' || x.completion), ',')"


def events(spark, sf):
    return view(spark, sf, "usage_src")


@query(f"SELECT {SUMS} FROM usage_src")
def usage_totals(spark, sf):
    return usage.usage_totals(events(spark, sf))


@query(f"SELECT phase, {SUMS} FROM usage_src GROUP BY phase")
def usage_by_phase(spark, sf):
    return usage.usage_by_phase(events(spark, sf))


@query(f"""SELECT CASE grouping_id(phase, day) WHEN 1 THEN 'phase' WHEN 2 THEN 'day' ELSE 'total' END AS section, coalesce(phase, day::VARCHAR, '-') AS key, {SUMS}
  FROM (SELECT *, ts::DATE AS day FROM usage_src) GROUP BY GROUPING SETS ((phase), (day), ())""")
def usage_report(spark, sf):
    return usage.usage_report(events(spark, sf))


@query("SELECT event_id, ts, phase, prompt FROM usage_src WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20 12:00:00' AND phase = 'select'")
def filter_events(spark, sf):
    since, until = (usage.parse_time_bound(x) for x in ("2024-01-03", "2024-01-20T12:00:00"))
    return usage.filter_events(events(spark, sf), since, until, "select").select("event_id", "ts", "phase", "prompt")


@query("SELECT event_id, ts, phase FROM usage_src ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_events(spark, sf):
    return usage.recent_events(events(spark, sf), 50).select("event_id", "ts", "phase")


BY_PHASE = "string_agg(phase || ':' || calls || ':' || prompt || ':' || completion, ',' ORDER BY phase)"
DAYS = "(SELECT unnest(generate_series(date '2024-01-01' - INTERVAL 2 DAY, (SELECT max(ts) FROM usage_src)::DATE::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day)"
DAILY = f"""(SELECT s.day, coalesce(sum(calls), 0)::BIGINT AS calls, coalesce(sum(prompt), 0)::BIGINT AS prompt, coalesce(sum(completion), 0)::BIGINT AS completion,
    round(coalesce(sum(elapsed), 0), 5) AS elapsed, coalesce({BY_PHASE}, '') AS by_phase
  FROM {DAYS} s LEFT JOIN (SELECT ts::DATE AS day, phase, {SUMS} FROM usage_src GROUP BY ALL) p ON p.day = s.day GROUP BY s.day)"""


def flat(df):
    text = F.array_join(F.transform(F.map_entries("by_phase"), lambda e: F.concat_ws(":", e["key"], e["value"]["calls"].cast("string"), e["value"]["prompt"].cast("string"), e["value"]["completion"].cast("string"))), ",")
    return df.withColumn("by_phase", text).withColumn("elapsed", F.round("elapsed", 5)).withColumn("day", F.col("day").cast("string"))


@query(f"SELECT day::VARCHAR AS day, calls, prompt, completion, elapsed, by_phase FROM {DAILY}")
def rollup_daily(spark, sf):
    return flat(usage.rollup_daily(events(spark, sf), since=date(2023, 12, 30)))


@query(f"SELECT day::VARCHAR AS day, calls, prompt, completion, elapsed, by_phase FROM {DAILY} WHERE day BETWEEN '2024-01-02' AND '2024-01-09'")
def query_daily(spark, sf):
    return flat(usage.query_daily(usage.rollup_daily(events(spark, sf), since=date(2023, 12, 30)), date(2024, 1, 2), date(2024, 1, 9)))


@query("SELECT count(*) FILTER (cacheable) AS cacheable_calls, count(*) FILTER (cacheable) / count(*) AS ratio FROM usage_src")
def cacheable_ratio(spark, sf):
    return usage.cacheable_ratio(events(spark, sf))


@query("""SELECT round(f, 6) AS first_call, round(r, 6) AS rest_mean, round(f - r, 6) AS savings, round(CASE WHEN f > 0 THEN greatest(0, least(1, (f - r) / f)) ELSE 0 END, 6)::DOUBLE AS hit_rate, samples
  FROM (SELECT arg_min(elapsed, (ts, event_id)) AS f, (sum(elapsed) - arg_min(elapsed, (ts, event_id))) / (count(*) - 1) AS r, count(*) AS samples FROM usage_src WHERE cacheable)""")
def cache_savings(spark, sf):
    return usage.cache_savings(events(spark, sf))


@query("""WITH t AS (SELECT 'usage_' AS p, '' AS phase, count(*) AS calls, sum(prompt) AS prompt, sum(completion) AS completion, round(sum(elapsed), 6) AS elapsed FROM usage_src
    UNION ALL SELECT 'phase_', phase, count(*), sum(prompt), sum(completion), round(sum(elapsed), 6) FROM usage_src GROUP BY phase)
  SELECT p || k || '_total' AS name, 'counter' AS kind, phase, CASE k WHEN 'calls' THEN calls WHEN 'prompt' THEN prompt WHEN 'completion' THEN completion ELSE elapsed END::DOUBLE AS value
  FROM t, (VALUES ('calls'), ('prompt'), ('completion'), ('elapsed')) n(k)
  UNION ALL SELECT 'notes', 'gauge', '', count(*)::DOUBLE FROM notes_src""")
def usage_metrics(spark, sf):
    gauges = corpus.corpus_health(notes(spark, sf).withColumn("summary", F.lit(""))).select(F.lit("notes").alias("name"), F.col("notes").alias("value"))
    return usage.usage_metrics(events(spark, sf), gauges).select("name", "kind", F.coalesce(F.col("labels")["phase"], F.lit("")).alias("phase"), "value")


@query(f"""SELECT CASE grouping_id(phase, day) WHEN 1 THEN 'phase' WHEN 2 THEN 'daily' ELSE 'total' END AS section, coalesce(phase, day::VARCHAR, '-') AS key,
    count(*) AS calls, sum(prompt)::BIGINT AS prompt, sum(completion)::BIGINT AS completion, sum(elapsed)::DECIMAL(18,6)::DECIMAL(18,3)::VARCHAR AS elapsed
  FROM (SELECT *, ts::DATE AS day FROM usage_src) GROUP BY GROUPING SETS ((phase), (day), ())
  UNION ALL SELECT * FROM (SELECT 'event', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, prompt, completion, elapsed::DECIMAL(18,6)::DECIMAL(18,3)::VARCHAR FROM usage_src ORDER BY ts DESC, event_id DESC LIMIT 20)""")
def export_usage(spark, sf):
    return usage.export_usage(events(spark, sf))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'select=' || doc_id || '/' || n_chars END AS told FROM documents""")
def json_breakdown(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    entry = F.struct(F.col("doc_id").alias("calls"), F.col("n_chars").alias("prompt"), F.lit(0).cast("long").alias("completion"), F.lit(0.5).alias("elapsed"))
    text = F.when(F.col("doc_id") % 3 == 0, "{broken").otherwise(F.to_json(F.create_map(F.lit("select"), entry)))
    back = docs.select("doc_id", tx.breakdown_from_json(text).alias("m"))
    told = F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]["calls"].cast("string"), F.lit("/"), e["value"]["prompt"].cast("string")))
    return back.select("doc_id", F.array_join(told, ",").alias("told"))


@query("""SELECT doc_id, greatest(1, n_chars * (doc_id % 3) // (doc_id % 3 + doc_id % 5 + 2)) AS explore, greatest(1, n_chars * (doc_id % 5) // (doc_id % 3 + doc_id % 5 + 2)) AS evaluate,
  greatest(1, n_chars * 2 // (doc_id % 3 + doc_id % 5 + 2)) AS answer, NULL::VARCHAR AS error FROM documents WHERE doc_id % 7 <> 0
  UNION ALL SELECT doc_id, NULL, NULL, NULL, 'shares must not be negative' FROM documents WHERE doc_id % 7 = 0""")
def split_budget(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    last = F.when(F.col("doc_id") % 7 == 0, "-1").otherwise("2")
    ratios = F.concat_ws(":", (F.col("doc_id") % 3).cast("string"), (F.col("doc_id") % 5).cast("string"), last)
    return docs.select("doc_id", tx.split_budget(ratios, F.col("n_chars")).alias("b")).select("doc_id", "b.*")


RUNS = "SELECT source AS run, doc_id AS pos, n_chars AS tokens FROM documents"


def runs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("run"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("tokens"))


@query(f"SELECT * FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM ({RUNS})) WHERE used_before < 20000")
def budget_cutoff(spark, sf):
    return usage.budget_cutoff(runs(spark, sf), 20_000)


@query(f"""SELECT * FROM (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY run ORDER BY wave RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before
  FROM (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY pos) - 1) // 4 AS wave FROM ({RUNS}))) WHERE used_before < 20000""")
def budget_waves(spark, sf):
    return usage.budget_waves(runs(spark, sf), 20_000, 4)


@query("""SELECT session_id, turn, tokens, sum(tokens) OVER (PARTITION BY session_id ORDER BY turn)::BIGINT AS session_tokens, 5000 - tokens AS left
  FROM (SELECT session_id, event_id % 10 AS turn, sum(prompt + completion)::BIGINT AS tokens FROM usage_src GROUP BY ALL)""")
def turn_usage(spark, sf):
    return usage.turn_usage(events(spark, sf).withColumn("turn", F.col("event_id") % 10), 5000)


@query("""SELECT session_id, event_id, count(*) OVER w AS calls, sum(prompt + completion) OVER w::BIGINT AS tokens, round(sum(elapsed) OVER w, 6) AS elapsed
  FROM usage_src WINDOW w AS (PARTITION BY session_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def live_usage(spark, sf):
    return usage.live_usage(events(spark, sf))


@query("""SELECT session_id, turn, coalesce(string_agg(question || '=' || substring(answer, 1, 200), '|' ORDER BY p) FILTER (p IS NOT NULL), '') AS history FROM (
    SELECT a.session_id, a.turn, b.turn AS p, b.question, b.answer, row_number() OVER (PARTITION BY a.session_id, a.turn ORDER BY b.turn DESC) AS k
    FROM turns_src a LEFT JOIN turns_src b ON b.session_id = a.session_id AND b.turn < a.turn) WHERE k <= 3 GROUP BY session_id, turn""")
def recent_history(spark, sf):
    told = F.array_join(F.transform("history", lambda h: F.concat(h["question"], F.lit("="), h["answer"])), "|")
    return usage.recent_history(view(spark, sf, "turns_src")).select("session_id", "turn", told.alias("history"))


@query("""SELECT session_id, min(ts) AS start, max(ts) AS last_active, count(*) AS turns FROM (
    SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS n FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM usage_src)) GROUP BY session_id, n""")
def session_ttl(spark, sf):
    return usage.sessions(events(spark, sf))


CUT = "(SELECT (min(ts) + (max(ts) - min(ts)) / 2)::DATE FROM usage_src)"


@query(f"SELECT 'kept' AS part, event_id AS key, prompt AS calls FROM usage_src WHERE ts >= {CUT} UNION ALL SELECT 'day', epoch(ts::DATE)::BIGINT, count(*) FROM usage_src WHERE ts < {CUT} GROUP BY ts::DATE")
def retention(spark, sf):
    """Days of a stored log before a cutoff are rolled up, and their folders dropped."""
    path, rollups = fresh_path(spark, "usage"), fresh_path(spark, "rollups")
    files.write_usage(events(spark, sf), path)
    low, high = events(spark, sf).agg(F.min("ts"), F.max("ts")).first()
    files.retain_usage(spark, path, rollups, (low + (high - low) / 2).date())
    old = spark.read.parquet(rollups).filter("calls > 0").select(F.lit("day").alias("part"), F.unix_timestamp(F.col("day").cast("timestamp")).alias("key"), "calls")
    return spark.read.parquet(path).select(F.lit("kept").alias("part"), F.col("event_id").alias("key"), F.col("prompt").alias("calls")).unionByName(old)


# Snapshots and caches


@query("SELECT * FROM diff")
def snapshot_diff(spark, sf):
    return changes.snapshot_diff(view(spark, sf, "snapshot_prev"), view(spark, sf, "snapshot_cur"))


@query("SELECT count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'modified') AS modified, count(*) FILTER (kind = 'deleted') AS deleted FROM diff", "change_counts")
def change_counts(spark, sf):
    return changes.change_counts(snapshot_diff(spark, sf))


@query("SELECT path FROM diff WHERE kind <> 'added'")
def stale_ids(spark, sf):
    return changes.stale_ids(snapshot_diff(spark, sf))


KEYS = ["vault", "node_id", "mtime", "model"]


def wanted(spark, sf):
    return raw_notes(spark, sf).select("vault", "node_id", F.col("doc_id").alias("mtime"), F.lit("m1").alias("model"))


def cached(spark, sf):
    """Entries of an earlier run: one in ten notes is missing, another has changed since, a third was made by another model."""
    ten = F.col("doc_id") % 10
    had = raw_notes(spark, sf).filter(ten != 0)
    return had.select("vault", "node_id", (F.col("doc_id") - (ten == 1).cast("int")).alias("mtime"), F.when(ten == 2, "m0").otherwise("m1").alias("model"), F.length("body").alias("value"))


@query("SELECT vault, node_id, doc_id AS mtime, length(body) AS value FROM notes_src WHERE doc_id % 10 > 2")
def cache_hit(spark, sf):
    return changes.cache_hits(wanted(spark, sf), cached(spark, sf), KEYS).select("vault", "node_id", "mtime", "value")


@query("SELECT vault, node_id, doc_id AS mtime FROM notes_src WHERE doc_id % 10 <= 2")
def cache_miss(spark, sf):
    return changes.cache_misses(wanted(spark, sf), cached(spark, sf), KEYS).select("vault", "node_id", "mtime")


@query("SELECT vault, node_id, CASE WHEN doc_id % 10 <= 2 THEN 1 ELSE 0 END AS saved, CASE WHEN doc_id % 10 <= 2 THEN -1 ELSE length(body) END AS value FROM notes_src")
def cache_upsert(spark, sf):
    """A table that an earlier run left, and what this run makes of its misses merged into it."""
    cache = cache_at(spark, value="value int", buckets=8)
    cache.save(cached(spark, sf))
    cache.save(cache.misses(wanted(spark, sf)).withColumn("value", F.lit(-1)))
    return cache.entries().select("vault", "node_id", (F.col("value") == -1).cast("int").alias("saved"), "value")


@query("SELECT source AS owner, count(*) FILTER (doc_id % 10 > 2) AS hits, count(*) FILTER (doc_id % 10 <= 2) AS misses FROM documents GROUP BY source")
def cache_by_vault(spark, sf):
    rows = wanted(spark, sf).withColumn("path", F.concat(F.lit("/"), F.col("vault"), F.lit("/"), F.col("node_id")))
    roots = rows.select("vault", F.concat(F.lit("/"), F.col("vault")).alias("root")).distinct()
    owned = corpus.owner_vault(rows.select("path", "node_id", "mtime", "model"), roots, "src0")
    hit = owned.join(cached(spark, sf), KEYS, "left")
    return hit.groupBy(F.col("vault").alias("owner")).agg(F.count("value").alias("hits"), F.count_if(F.col("value").isNull()).alias("misses"))


BOUNDS = """SELECT event_id, CASE event_id % 6 WHEN 0 THEN substring(cast(ts AS varchar(30)), 1, 10) WHEN 1 THEN replace(substring(cast(ts AS varchar(30)), 1, 19), ' ', 'T')
    WHEN 2 THEN substring(cast(ts AS varchar(30)), 1, 19) WHEN 3 THEN 'yesterday' WHEN 4 THEN '' ELSE '2024-13-' || cast(event_id AS varchar(20)) END AS said FROM usage_src"""


@query(f"""SELECT event_id, CASE WHEN event_id % 6 < 3 THEN strftime(try_cast(said AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS bound,
  CASE WHEN event_id % 6 IN (3, 5) THEN 'neither a date nor a timestamp: ' || said END AS error FROM ({BOUNDS})""")
def parse_time_bound(spark, sf):
    """Dates and timestamps as parameters come, one an event; those that are neither are told, and no bound is none."""
    view(spark, sf, "usage_src").createOrReplaceTempView("usage_src_bounds")
    told = spark.sql(BOUNDS.replace("usage_src", "usage_src_bounds")).select("event_id", usage.time_bound(F.col("said")).alias("b"))
    return told.select("event_id", F.date_format("b.bound", "yyyy-MM-dd HH:mm:ss").alias("bound"), "b.error")
