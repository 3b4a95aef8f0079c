"""Queries over model responses and the entities in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import responses as rs
from ..operators import entities as en
from ..operators.mention_store import MentionStore
from ..sources.bitmaps import among
from ..sources.tables import fresh_path, stored
from .registry import query
from .usage_queries import snapshot_diff
from .views import view


def outputs(spark, sf):
    return view(spark, sf, "model_output_src").select(F.col("doc_id").alias("note_id"), "response")


def picks(spark, sf):
    return view(spark, sf, "select_output_src")


@query("""SELECT query_id, CASE query_id % 5 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'DONE' END AS action, CASE WHEN query_id % 5 < 2 THEN said END AS value,
  CASE WHEN query_id % 5 > 1 THEN 'no SELECT or DONE line' END AS error FROM select_output_src""")
def parse_select(spark, sf):
    return picks(spark, sf).select("query_id", rs.parse_select(F.col("response")).alias("p")).select("query_id", "p.*")


@query("""SELECT query_id, CASE query_id % 5 WHEN 2 THEN 'SELECT' WHEN 3 THEN 'DONE' END AS action, CASE WHEN query_id % 5 IN (2, 3) THEN said END AS value,
  CASE WHEN query_id % 5 NOT IN (2, 3) THEN 'no JSON object' END AS error FROM select_output_src""")
def parse_select_json(spark, sf):
    return picks(spark, sf).select("query_id", rs.parse_select_json(F.col("response")).alias("p")).select("query_id", "p.*")


def judged(spark, sf):
    n, t = F.col("query_id") % 4, F.col("said")
    text = F.when(n == 0, F.concat(F.lit("Hm.\nSUFFICIENT: "), t)).when(n == 1, F.concat(F.lit(" INSUFFICIENT: "), t, F.lit(" ")))
    json = F.when(n == 2, F.concat(F.lit('{"sufficient": "false", "reason": " '), t, F.lit(' "}'))).otherwise(F.concat(F.lit('```\n{"sufficient": false, "reason": "'), t, F.lit('"}\n```')))
    return picks(spark, sf).select("query_id", F.coalesce(text, json).alias("response"))


@query("""SELECT query_id, CASE query_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS sufficient, CASE WHEN query_id % 4 < 2 THEN said END AS reason,
  CASE WHEN query_id % 4 > 1 THEN 'no SUFFICIENT or INSUFFICIENT line' END AS error, CASE query_id % 4 WHEN 2 THEN true WHEN 3 THEN false END AS json_sufficient,
  CASE WHEN query_id % 4 > 1 THEN said END AS json_reason FROM select_output_src""")
def parse_evaluate(spark, sf):
    told = judged(spark, sf).select("query_id", rs.parse_evaluate(F.col("response")).alias("p"), rs.parse_evaluate_json(F.col("response")).alias("j"))
    return told.select("query_id", "p.*", F.col("j.sufficient").alias("json_sufficient"), F.col("j.reason").alias("json_reason"))


@query("""SELECT query_id, CASE WHEN query_id % 5 IN (0, 2) THEN 'SELECT' ELSE 'DONE' END AS action, said AS value,
  CASE WHEN query_id % 5 IN (2, 3) THEN 1 ELSE 3 END AS attempt FROM select_output_src WHERE query_id % 5 <> 4 UNION ALL SELECT query_id, NULL, NULL, NULL FROM select_output_src WHERE query_id % 5 = 4""")
def parse_with_fallback(spark, sf):
    told = picks(spark, sf).select("query_id", rs.parse_with_fallback(F.col("response"), F.col("response")).alias("p"))
    return told.select("query_id", "p.action", "p.value", "p.attempt")


@query("""SELECT item_id AS query_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS sub FROM (
    SELECT item_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda w: w <> '') AS ws FROM benchmark WHERE item_id % 3 <> 0)""")
def parse_decompose(spark, sf):
    """Every word of an item as a line of a model's reply; one reply in three says that the question is single."""
    words = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")
    said = F.concat(F.lit("Here:\n"), F.array_join(F.transform(words, lambda w: F.concat(F.lit(" sub: "), w)), "\n"), F.when(F.col("item_id") % 3 == 0, "\nSINGLE").otherwise(""))
    told = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.posexplode(rs.parse_decompose(said)).alias("pos", "sub"))
    return told.withColumn("pos", F.col("pos").cast("long"))


@query("SELECT doc_id AS note_id, name, category, description FROM mentions")
def parse_entities(spark, sf):
    return outputs(spark, sf).select("note_id", F.inline(rs.parse_entities(F.col("response"))))


@query("SELECT doc_id AS note_id, 0 AS pos, key, name, category, description FROM mentions")
def mention_facts(spark, sf):
    return en.mention_facts(outputs(spark, sf))


@query("""SELECT key, arg_min(name, doc_id) AS name, arg_min(category, doc_id) AS category, arg_min(description, doc_id) AS first_description, count(*) AS n_mentions, min(doc_id) AS first_note
  FROM mentions GROUP BY key""")
def aggregate_entities(spark, sf):
    return en.aggregate_entities(stored(en.mention_facts(outputs(spark, sf)), "mentions"))


def entities(spark, sf):
    return en.aggregate_entities(stored(en.mention_facts(outputs(spark, sf)), "mentions"))


@query("""SELECT key, string_agg(doc_id::VARCHAR || ':' || description, chr(10) ORDER BY doc_id) AS mentions
  FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS k FROM mentions) WHERE k <= 50 GROUP BY key""")
def first_mentions(spark, sf):
    said = F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["note_id"].cast("string"), m["description"])), "\n")
    return en.first_mentions(en.mention_facts(outputs(spark, sf)), en.SHOWN_MENTIONS).select("key", said.alias("mentions"))


@query("""SELECT category, row_number() OVER (PARTITION BY category ORDER BY name, key) AS position,
  '- [[' || regexp_replace(trim(regexp_replace(name, '[^\\w\\s\\p{L}-]', '', 'g')), '\\s+', '-', 'g') || ']] — ' || first_description AS line FROM entities""")
def entity_index(spark, sf):
    return en.entity_index(entities(spark, sf))


@query("SELECT (SELECT count(*) FROM model_output_src) AS sources, count(*) AS entities, count(*) AS pages FROM entities")
def compile_log(spark, sf):
    return en.compile_log(entities(spark, sf), outputs(spark, sf).count())


@query("""WITH f AS (SELECT DISTINCT name FROM entities ORDER BY name LIMIT 21)
  SELECT key, array_to_string(list_filter((SELECT list(name ORDER BY name) FROM f), lambda x: x <> e.name)[1:20], '|') AS xrefs FROM entities e""")
def xref_hint(spark, sf):
    return en.xref_hint(entities(spark, sf)).select("key", F.array_join("xrefs", "|").alias("xrefs"))


@query("""SELECT source AS query_id, string_agg(id, ',' ORDER BY first) AS cited FROM (SELECT source, 'n' || n_chars % 50 AS id, min(doc_id) AS first FROM documents GROUP BY source, n_chars % 50) GROUP BY source""")
def merge_citations(spark, sf):
    parts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("query_id"), F.col("doc_id").alias("part"), F.array(F.concat(F.lit("n"), F.col("n_chars") % 50), F.concat(F.lit("n"), F.col("n_chars") % 50)).alias("cited"))
    return en.merge_citations(parts).select("query_id", F.array_join("cited", ",").alias("cited"))


@query("SELECT source AS query_id, doc_id AS node_id FROM documents WHERE doc_id % 3 <> 1")
def unvisited(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("query_id"), F.col("doc_id").alias("node_id"))
    return en.unvisited(rows, rows.filter("node_id % 3 = 1"))


@query("""SELECT query_id, node_id, shown FROM (SELECT source AS query_id, doc_id AS node_id, shown, count(*) FILTER (NOT shown) OVER (PARTITION BY source) AS n
  FROM (SELECT *, source < 'src2' OR doc_id % 2 = 0 AS shown FROM documents)) WHERE NOT shown OR n = 0""")
def suppress_shown(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("source").alias("query_id"), F.col("doc_id").alias("node_id"), ((F.col("source") < "src2") | (F.col("doc_id") % 2 == 0)).alias("shown"))
    return en.suppress_shown(rows)


@query("""SELECT 'select' AS kind, count(*) AS responses, count(*) AS nonempty, count(*) AS short, count(*) FILTER (query_id % 5 < 2) AS parsable, count(*) FILTER (query_id % 5 < 2 AND query_id % 2 = 0) AS "right",
    count(*) FILTER (query_id % 5 < 2 AND query_id % 2 = 0) AS passed FROM select_output_src
  UNION ALL SELECT 'summary', count(*), count(*), count(*) FILTER (length(trim(text, ' ' || chr(10))) < 300), count(*), count(*), count(*) FILTER (length(trim(text, ' ' || chr(10))) < 300) FROM benchmark""")
def response_quality(spark, sf):
    a = picks(spark, sf).select(F.lit("select").alias("kind"), "response", F.when(F.col("query_id") % 2 == 0, F.col("said")).otherwise("else").alias("expected"))
    b = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.lit("summary").alias("kind"), F.col("text").alias("response"), F.lit(None).cast("string").alias("expected"))
    return en.response_quality(a.unionByName(b))


@query("""SELECT key, count(*) AS n_mentions, min(doc_id) AS first_note FROM (
    SELECT key, doc_id FROM mentions WHERE doc_id % 10 NOT IN (1, 2, 0) UNION ALL SELECT key, doc_id FROM mentions WHERE doc_id % 10 IN (0, 2)) GROUP BY key""")
def compile_incremental(spark, sf):
    """The state before holds residues 1 to 9; then, in three change sets, residue 0 is added, 1 deleted, and 2 modified."""
    store = MentionStore(spark, fresh_path(spark, "compile"), "long")
    facts = en.mention_facts(outputs(spark, sf))
    store.apply(facts.filter("note_id % 10 <> 0").select(F.col("note_id").alias("path")).distinct(), facts.filter("note_id % 10 <> 0"))
    diff = stored(snapshot_diff(spark, sf), "diff")
    for kind in ("added", "deleted", "modified"):
        some = diff.filter(F.col("kind") == kind)
        changed = some.filter("kind <> 'deleted'").select(F.col("path").alias("note_id"))
        store.apply(some, en.mention_facts(among(outputs(spark, sf), changed, "note_id")))
        store.vacuum()
    return store.entities().select("key", "n_mentions", "first_note")


@query("SELECT file, key FROM (SELECT regexp_replace(trim(regexp_replace(name, '[^\\w\\s\\p{L}-]', '', 'g')), '\\s+', '-', 'g') || '.md' AS file, max(key) AS key FROM entities GROUP BY 1)")
def pages_by_slug(spark, sf):
    return en.pages_by_slug(entities(spark, sf).withColumn("content", F.concat(F.lit("# "), "name"))).select("file", "key")


