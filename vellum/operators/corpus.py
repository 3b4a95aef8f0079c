"""Corpus tables: notes with tokens, tiers and frontmatter; folders; vaults; filters and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import text as tx
from ..sources.tables import stored

NOTE_KEY = ["vault", "node_id"]


def build_notes(raw: DataFrame) -> DataFrame:
    """Notes from (vault, node_id, title, body): tokens, tier and frontmatter, computed where the note is read."""
    tokens = tx.estimate_tokens(F.col("body"))
    # the fold is the element of an array that is exploded, so that no field computes it again
    fields = F.array(F.struct(tokens.alias("token_count"), fm.note_fields(F.col("body")).alias("f"))).alias("one")
    notes = raw.select("vault", "node_id", "title", "body", F.explode(fields).alias("one"))
    return notes.select("vault", "node_id", "title", "body", "one.token_count", tx.classify_tier(F.col("one.token_count")).alias("tier"), "one.f.tags", "one.f.date", "one.f.aliases", "one.f.raw")


def with_positions(notes: DataFrame) -> DataFrame:
    """Each note's place in its vault's order of ids. To be asked for of slim rows: they are sorted over all tasks."""
    return numbered(notes, ["vault"], ["node_id"], "position")


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str, first: int = 0) -> DataFrame:
    """Rows numbered inside their group by ``order``; a group may span any number of tasks.

    A sort by range gives each task a stretch of the order, a window numbers the rows of a stretch, and the rows of a
    group in the stretches before it are added from a table of one row for each group and task.
    """
    dealt = stored(rows.repartitionByRange(*group, *order).withColumn("_task", F.spark_partition_id()), "stretches")
    counts = dealt.groupBy(*group, "_task").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(c).alias(f"_g_{c}") for c in group], F.col("_task").alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    same = F.col("_task") == F.col("_t")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = F.row_number().over(Window.partitionBy(*group, "_task").orderBy(*order))
    return dealt.join(counts, same).withColumn(name, (F.col("_ahead") + inside - 1 + first).cast("long")).select(*rows.columns, name)


def in_folder(notes: DataFrame, folder: str | None) -> DataFrame:
    """The notes below a folder; None is the whole vault."""
    return notes.filter(F.col("node_id").startswith(folder.rstrip("/") + "/")) if folder else notes


def ancestors(node_id: Column) -> Column:
    """Folders above a path, the root ``.`` first."""
    parts = F.split(node_id, "/")
    depth = F.size(parts) - 1
    above = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")))
    return F.concat(F.array(F.lit(".")), F.coalesce(above, F.array().cast("array<string>")))


def folder_nodes(notes: DataFrame) -> DataFrame:
    """Folders of the notes' paths with their parent and their place among its folders, by name."""
    folders = notes.select("vault", F.explode(ancestors(F.col("node_id"))).alias("folder")).distinct()
    parent = F.when(F.col("folder") != ".", tx.parent_folder(F.col("folder")))
    place = F.row_number().over(Window.partitionBy("vault", "parent").orderBy("folder")) - 1
    return folders.withColumn("parent", parent).withColumn("position", place.cast("long"))


def union_vaults(notes: DataFrame, n_vaults: int) -> DataFrame:
    """One list of notes; ids get the prefix ``vault::`` if there is more than one vault."""
    return notes.withColumn("node_id", F.concat(F.col("vault"), F.lit("::"), F.col("node_id"))) if n_vaults > 1 else notes


def dedup_vaults(paths: DataFrame) -> DataFrame:
    """(pos, path): the first of each path, order kept."""
    return paths.groupBy("path").agg(F.min("pos").alias("pos"))


def filter_tags(notes: DataFrame, tags: list[str]) -> DataFrame:
    """Notes that share a tag, in either case; no tags asked for, no filter."""
    if not tags:
        return notes
    return notes.filter(F.arrays_overlap(F.transform("tags", lambda t: F.lower(t)), F.array(*[F.lit(t.lower()) for t in tags])))


def filter_dates(notes: DataFrame, after: str | None = None, before: str | None = None) -> DataFrame:
    """Dates compared as strings, bounds included; notes without a date stay."""
    keep = F.lit(True)
    if after:
        keep = keep & (F.col("date") >= after)
    if before:
        keep = keep & (F.col("date") <= before)
    return notes.filter(F.col("date").isNull() | keep)


def prune_folders(folders: DataFrame, kept: DataFrame) -> DataFrame:
    """Folders that still have a kept note below them; the root always stays."""
    alive = kept.select("vault", F.explode(ancestors(F.col("node_id"))).alias("folder")).distinct()
    return folders.join(alive, ["vault", "folder"], "left_semi").unionByName(folders.filter("folder = '.'").join(alive, ["vault", "folder"], "left_anti"))


def filter_tier(notes: DataFrame, tier: str, without_summary: bool = False) -> DataFrame:
    out = notes.filter(F.col("tier") == tier)
    return out.filter(F.col("summary").isNull() | (F.col("summary") == "")) if without_summary else out


def nonblank_notes(notes: DataFrame) -> DataFrame:
    return notes.filter(tx.has_text(F.col("body")))


def tier_stats(notes: DataFrame) -> DataFrame:
    """Notes and tokens of each tier and in total; empty tiers show 0."""
    spark = notes.sparkSession
    got = notes.rollup("tier").agg(F.count(F.lit(1)).alias("notes"), F.sum("token_count").alias("tokens")).withColumn("tier", F.coalesce("tier", F.lit("total")))
    every = spark.createDataFrame([(t,) for t in ("micro", "atomic", "long", "total")], "tier string")
    zero = F.lit(0).cast("long")
    return F.broadcast(every).join(got, "tier", "left").select("tier", F.coalesce("notes", zero).alias("notes"), F.coalesce("tokens", zero).alias("tokens"))


def corpus_profile(notes: DataFrame) -> DataFrame:
    """Per vault: notes, tokens, and the largest note, the first of equals."""
    first = F.min_by(F.struct("title", "token_count"), F.struct(-F.col("token_count"), F.col("node_id"))).alias("l")
    return notes.groupBy("vault").agg(F.count(F.lit(1)).alias("notes"), F.sum("token_count").alias("tokens"), first).select("vault", "notes", "tokens", F.col("l.title").alias("largest"), F.col("l.token_count").alias("largest_tokens"))


def corpus_health(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("tier") == "long").alias("long_notes"), F.count_if(F.coalesce(F.col("summary"), F.lit("")) != "").alias("summarised"))


def tag_histogram(notes: DataFrame, top: int = 20) -> DataFrame:
    """Notes per tag, most first; equal counts in the order in which tags are first seen."""
    seen = notes.select("vault", "node_id", F.posexplode("tags").alias("k", "tag"))
    counts = seen.groupBy("tag").agg(F.count(F.lit(1)).alias("notes"), F.min(F.struct("vault", "node_id", "k")).alias("first"))
    return counts.orderBy(F.desc("notes"), "first").limit(top).select("tag", "notes")


def folder_fanout(notes: DataFrame) -> DataFrame:
    """Per vault: folders that hold notes, and how many they hold on average and at most."""
    per = notes.groupBy("vault", tx.parent_folder(F.col("node_id")).alias("folder")).count()
    return per.groupBy("vault").agg(F.count(F.lit(1)).alias("folders"), F.avg("count").alias("avg_notes"), F.max("count").alias("max_notes"))


def owner_vault(paths: DataFrame, roots: DataFrame, primary: str) -> DataFrame:
    """The longest of the ``roots`` (vault, root) that contains each ``path``; none: the primary vault.

    Equi-joins on the ancestors of a path rather than comparing every path with every root.
    """
    above = paths.select("path", F.explode(ancestors(F.concat(F.col("path"), F.lit("/")))).alias("root"))
    best = above.join(roots, "root").groupBy("path").agg(F.max_by("vault", F.length("root")).alias("vault"))
    return paths.join(best, "path", "left").withColumn("vault", F.coalesce("vault", F.lit(primary)))
