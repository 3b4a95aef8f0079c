"""The link graph: links of notes resolved against titles and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.tables import stored


def note_links(notes: DataFrame) -> DataFrame:
    """A row a link: (vault, source_id, source_title, pos, raw_target, anchor)."""
    each = notes.select("vault", F.col("node_id").alias("source_id"), F.col("title").alias("source_title"), F.posexplode(tx.extract_links_anchored(F.col("body"))).alias("pos", "link"))
    return each.select("vault", "source_id", "source_title", F.col("pos").cast("long").alias("pos"), F.col("link.target").alias("raw_target"), F.col("link.anchor").alias("anchor"))


def title_index(notes: DataFrame) -> DataFrame:
    return notes.select(tx.normalize_title(F.col("title")).alias("key"), F.col("vault").alias("target_vault"), F.col("node_id").alias("target_id"), F.col("title").alias("target_title"))


def _keyed(links: DataFrame) -> DataFrame:
    return links.withColumn("key", tx.normalize_title(F.regexp_replace("raw_target", r"^.*/", "")))


def resolve_links(links: DataFrame, notes: DataFrame, strict: bool = False) -> DataFrame:
    """All notes that a link means: those with its title; with a path in front also only where the file's path ends so.

    ``strict`` asks for whole folder names in front. A bare title is an equi-join on the title, whose rows are all links;
    one that very many links name is split by the engine's skew join. A link with a path meets only notes that it
    fits: notes are keyed by the ends of their paths, in the few lengths that links to their title have.
    """
    index, keyed = title_index(notes), _keyed(links)
    bare = keyed.filter(~F.contains("raw_target", F.lit("/"))).join(index, "key")
    paths = keyed.filter(F.contains("raw_target", F.lit("/"))).withColumn("end", F.concat("raw_target", F.lit(".md")))
    sizes = paths.select("key", F.length("end").alias("n")).distinct()
    ends = index.join(sizes, "key").filter(F.length("target_id") >= F.col("n")).withColumn("end", F.right("target_id", F.col("n")))
    if strict:
        ends = ends.filter((F.length("target_id") == F.col("n")) | (F.substring("target_id", -(F.col("n") + 1), F.lit(1)) == "/"))
    out = ["vault", "source_id", "source_title", "pos", "raw_target", "anchor", "target_vault", "target_id", "target_title"]
    return bare.select(*out).unionByName(paths.join(ends, ["key", "end"]).select(*out))


def dangling_links(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links without any note; a wrong path never falls back to the title alone."""
    there = title_index(notes).select("key").distinct()
    plain = ~F.contains("raw_target", F.lit("/"))
    # a bare title needs to be told only that some note has it; only links with a path look at the notes themselves
    bare = _keyed(links.filter(plain)).join(there, "key", "left_anti").drop("key")
    found = resolve_links(links.filter(~plain), notes).select("vault", "source_id", "pos").distinct()
    return bare.unionByName(links.filter(~plain).join(found, ["vault", "source_id", "pos"], "left_anti"))


def title_counts(notes: DataFrame) -> DataFrame:
    """A row a title: how many notes have it."""
    return title_index(notes).groupBy("key").agg(F.count(F.lit(1)).alias("n_notes"))


def dangling_preview(dangling: DataFrame, n: int = 10) -> DataFrame:
    """The first n dangling links, and on each row how many more there are."""
    more = dangling.agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    return dangling.orderBy("vault", "source_id", "pos").limit(n).withColumn("more", more.scalar())


def anchor_links(resolved: DataFrame, sections: DataFrame) -> DataFrame:
    """Target nodes of links: the first section of the note with the anchor's title, or else the note."""
    keyed = sections.groupBy(F.col("vault").alias("target_vault"), F.col("node_id").alias("target_id"), tx.normalize_title(F.col("title")).alias("anchor_key")).agg(F.min_by("section_id", "seq").alias("section_id"))
    return resolved.withColumn("anchor_key", tx.normalize_title(F.col("anchor"))).join(keyed, ["target_vault", "target_id", "anchor_key"], "left").withColumn("target_node", F.coalesce("section_id", "target_id")).drop("anchor_key", "section_id")


def lookup_title(titles: DataFrame, notes: DataFrame) -> DataFrame:
    """All notes of each title asked for, whatever its case and spaces."""
    return titles.withColumn("key", tx.normalize_title(F.col("title"))).join(title_index(notes), "key").select("title", "target_vault", "target_id")


def outgoing(resolved: DataFrame, sources: DataFrame) -> DataFrame:
    return resolved.join(sources, ["vault", "source_id"], "left_semi")


def backlinks(resolved: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges to exact target nodes (column target_node: a section hit sits on the section)."""
    return resolved.join(targets, ["target_vault", "target_node"], "left_semi")


def orphan_notes(notes: DataFrame, resolved: DataFrame) -> DataFrame:
    """Notes without an edge in either direction; a link to oneself is one."""
    touched = resolved.select("vault", F.col("source_id").alias("node_id")).unionByName(resolved.select(F.col("target_vault").alias("vault"), F.col("target_id").alias("node_id")))
    return notes.join(touched, ["vault", "node_id"], "left_anti")


def link_totals(links: DataFrame, notes: DataFrame, count_paths: bool = False) -> DataFrame:
    """Resolved edges, dangling links, and ambiguous (source, title) pairs.

    A link with a path is not counted as ambiguous, unless ``count_paths``, which counts it when it still has
    more than one note. Links by title alone are counted by the number of notes of each title, not edge by edge.
    """
    plain = ~F.contains("raw_target", F.lit("/"))
    place = ["vault", "source_id", "pos"]
    bare = _keyed(links.filter(plain)).join(title_counts(notes), "key", "left").withColumn("n", F.coalesce("n_notes", F.lit(0).cast("long"))).select(*place, "key", "n")
    paths = resolve_links(links.filter(~plain), notes).groupBy(*place, tx.normalize_title(F.col("raw_target")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    n_paths = links.filter(~plain).agg(F.count(F.lit(1)))
    many = bare.unionByName(paths) if count_paths else bare
    pairs = many.filter("n > 1").select("vault", "source_id", "key").distinct().agg(F.count(F.lit(1)))
    zero = F.lit(0).cast("long")
    by_title = bare.agg(F.coalesce(F.sum("n"), zero).alias("edges"), F.count_if(F.col("n") == 0).alias("none"))
    by_path = paths.agg(F.struct(F.coalesce(F.sum("n"), zero).alias("edges"), F.count(F.lit(1)).alias("found")).alias("s"))
    told = by_title.select("edges", "none", by_path.scalar().alias("p"), n_paths.scalar().alias("n_paths"), pairs.scalar().alias("ambiguous"))
    return told.select((F.col("edges") + F.col("p.edges")).alias("resolved"), (F.col("none") + F.col("n_paths") - F.col("p.found")).alias("dangling"), "ambiguous")


def top_linked(resolved: DataFrame, top: int = 10) -> DataFrame:
    """Incoming links per note title; section hits count for their note."""
    return resolved.groupBy(F.col("target_title").alias("title")).agg(F.count(F.lit(1)).alias("incoming")).orderBy(F.desc("incoming"), "title").limit(top)


def top_outgoing(resolved: DataFrame, top: int = 10) -> DataFrame:
    return resolved.groupBy(F.col("source_title").alias("title")).agg(F.count(F.lit(1)).alias("outgoing")).orderBy(F.desc("outgoing"), "title").limit(top)


def link_neighbours(start: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """Notes within so many links of each query's start notes, each once with the least number of hops.

    ``start`` is (query_id, vault, node_id), ``edges`` (vault, source_id, target_vault, target_id). One join
    a hop, the visited ones taken out before the next. Each hop is stored, so a plan never has more than one.
    """
    step = edges.select("vault", F.col("source_id").alias("node_id"), "target_vault", "target_id").distinct()
    step = stored(step, "steps")
    seen = front = stored(start.select("query_id", "vault", "node_id", F.lit(0).cast("long").alias("hop")), "hop")
    for hop in range(1, hops + 1):
        near = front.join(step, ["vault", "node_id"]).select("query_id", F.col("target_vault").alias("vault"), F.col("target_id").alias("node_id")).distinct()
        front = stored(near.join(seen, ["query_id", "vault", "node_id"], "left_anti").withColumn("hop", F.lit(hop).cast("long")), "hop")
        seen = seen.unionByName(front)
    return seen
