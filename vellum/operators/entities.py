"""Entities compiled from model responses over notes: mentions, entities, index, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import responses as rs
from ..functions import text as tx
from .corpus import numbered

XREFS = 20
#: Mentions that a prompt shows of an entity.
SHOWN_MENTIONS = 50


def mention_facts(responses: DataFrame, note: str = "note_id") -> DataFrame:
    """A row for each entity line of (note, response), with its place in the response."""
    each = responses.select(F.col(note).alias("note_id"), F.posexplode(rs.parse_entities(F.col("response"))).alias("pos", "e"))
    return each.select("note_id", F.col("pos").cast("long").alias("pos"), tx.entity_key(F.col("e.name")).alias("key"), "e.name", "e.category", "e.description")


def aggregate_entities(mentions: DataFrame) -> DataFrame:
    """Entities by key: name, category and first description are those of the first mention, by note and place; and the number of mentions.

    Mentions themselves stay rows of their own (`mention_facts`): an entity that every note names is still one small row.
    Only places are compared in the aggregate; the texts of the one mention that a key needs are fetched by it.
    """
    place = F.struct("note_id", "pos")
    per = mentions.groupBy("key").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n_mentions"))
    return first_texts(mentions, per)


def first_texts(mentions: DataFrame, per: DataFrame) -> DataFrame:
    """Entities (key, place of the first mention, number of mentions) with the texts of that mention."""
    first = per.select(F.col("at.note_id").alias("note_id"), F.col("at.pos").alias("pos"), "key", "n_mentions")
    told = mentions.select("note_id", "pos", "key", "name", "category", F.col("description").alias("first_description"))
    return told.join(first, ["note_id", "pos", "key"]).select("key", "name", "category", "first_description", "n_mentions", F.col("note_id").alias("first_note")).dropDuplicates(["key"])  # a repeated row is one mention's text twice


def first_mentions(mentions: DataFrame, n: int) -> DataFrame:
    """(key, mentions): the first n mentions of each entity in order, for a prompt. Ranks are cut before the shuffle, so no key is collected whole."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy("note_id", "pos"))
    some = mentions.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return some.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("note_id", "pos", "description"))).alias("mentions"))


def entity_index(entities: DataFrame) -> DataFrame:
    """Index lines (category, position, line): the entities of each category (blank: other) by name with their first description, a row each."""
    line = F.concat(F.lit("- [["), F.regexp_replace(tx.file_slug(F.col("name")), r"\.md$", ""), F.lit("]] — "), F.col("first_description"))
    rows = entities.select(F.coalesce(F.nullif("category", F.lit("")), F.lit("other")).alias("category"), "name", "key", line.alias("line"))
    return numbered(rows, ["category"], ["name", "key"], "position", 1).select("category", "position", "line")


def compile_log(entities: DataFrame, n_sources: int) -> DataFrame:
    return entities.agg(F.lit(n_sources).cast("long").alias("sources"), F.count(F.lit(1)).alias("entities"), F.count_if(F.col("n_mentions") > 0).alias("pages"))


def xref_hint(entities: DataFrame, n: int = XREFS) -> DataFrame:
    """With each entity up to n names of others: the first names in order, without its own."""
    first = [r[0] for r in entities.select("name").distinct().orderBy("name").limit(n + 1).collect()]  # n + 1 rows at most
    names = F.array(*[F.lit(x) for x in first]).cast("array<string>")
    return entities.withColumn("xrefs", F.slice(F.filter(names, lambda x: x != F.col("name")), 1, n))


def pages_by_slug(pages: DataFrame) -> DataFrame:
    """(file, content): one page a file name; of entities with the same one the later key wins."""
    return pages.groupBy(tx.file_slug(F.col("name")).alias("file")).agg(F.max_by("content", "key").alias("content"), F.max("key").alias("key"))


def incremental_mentions(old: DataFrame, diff: DataFrame, fresh: DataFrame) -> DataFrame:
    """Mentions after a change: without those of changed and deleted notes, with those extracted anew."""
    gone = diff.filter("kind <> 'added'").select(F.col("path").alias("note_id"))
    return old.join(gone, "note_id", "left_anti").unionByName(fresh)


def merge_citations(parts: DataFrame, label: Column | None = None) -> DataFrame:
    """(query_id, part, cited) rows to one list a query: each id once, in the order of first occurrence, with a ``label::`` if given."""
    each = parts.select("query_id", "part", F.posexplode("cited").alias("k", "id"), *([label.alias("label")] if label is not None else []))
    named = F.concat(F.col("label"), F.lit("::"), F.col("id")) if label is not None else F.col("id")
    first = each.groupBy("query_id", named.alias("id")).agg(F.min(F.struct("part", "k")).alias("at"))
    return first.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("cited"))


def unvisited(candidates: DataFrame, visited: DataFrame) -> DataFrame:
    return candidates.join(visited, ["query_id", "node_id"], "left_anti")


def suppress_shown(candidates: DataFrame) -> DataFrame:
    """Candidates (query_id, node_id, shown) without those already shown, unless a query would be left with none."""
    left = F.count_if(~F.col("shown")).over(Window.partitionBy("query_id"))
    return candidates.withColumn("_left", left).filter(~F.col("shown") | (F.col("_left") == 0)).drop("_left")


def response_quality(responses: DataFrame) -> DataFrame:
    """Per kind of prompt (kind, response, expected): how many responses are non-empty, short, parsable, right, and pass in all."""
    text = tx.strip(F.coalesce("response", F.lit("")))
    select, sub = rs.parse_select(F.col("response")), F.size(rs.parse_decompose(F.col("response")))
    kind = F.col("kind")
    evaluated = rs.parse_evaluate(F.col("response"))["error"].isNull()
    parsable = F.when(kind == "select", select["error"].isNull()).when(kind == "evaluate", evaluated).when(kind == "decompose", sub > 0).otherwise(text != "")
    short = F.when(kind == "summary", F.length(text) < 300).otherwise(True)
    right = F.when(kind == "select", F.coalesce(select["value"] == F.col("expected"), F.lit(False))).otherwise(True)
    rules = responses.select("kind", (text != "").alias("a"), short.alias("b"), parsable.alias("c"), right.alias("d"))
    return rules.groupBy("kind").agg(F.count(F.lit(1)).alias("responses"), *[F.count_if(c).alias(n) for c, n in (("a", "nonempty"), ("b", "short"), ("c", "parsable"), ("d", "right"))], F.count_if(F.col("a") & F.col("b") & F.col("c") & F.col("d")).alias("passed"))
