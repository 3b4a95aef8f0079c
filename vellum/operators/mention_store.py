"""The state of a compile between runs: mentions by note, and what each entity is by them, kept up to date by change sets.

Mentions lie in hash buckets of their note. Of each entity and bucket there is one small row: how many mentions, and the
place of the first of them; its texts stay with the mention. A change set rewrites the buckets of its notes, where mentions
of other notes are not shuffled, and the rows of entities that had or have a mention in these notes; nothing else is read.
An entity that every note names has as many rows as there are buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bitmaps import apart, not_among
from ..sources.keyed import BUCKETS, KeyedTable
from ..sources.tables import stored
from .entities import aggregate_entities, first_texts


class MentionStore:
    """Below a folder; ``note`` is the type of note ids."""

    def __init__(self, spark: SparkSession, folder: str, note: str = "string", buckets: int = BUCKETS):
        self.mentions = KeyedTable(spark, f"{folder}/mentions", f"note_id {note}, pos long, key string, name string, category string, description string", ["note_id"], buckets)
        self.parts = KeyedTable(spark, f"{folder}/entities", f"key string, part int, n long, first struct<note_id: {note}, pos: long>", ["key"], buckets)

    def apply(self, diff: DataFrame, fresh: DataFrame) -> None:
        """A change set (path, kind) and the mentions (note_id, pos, key, name, category, description) found anew in its added and modified notes."""
        notes = stored(diff.select(F.col("path").alias("note_id")).distinct(), "changed_notes")
        # mentions of notes that the change set does not name are not of this change
        fresh = stored(fresh.select(*self.mentions.schema.names), "fresh")
        fresh = not_among(fresh, stored(fresh.select("note_id").distinct().join(notes, "note_id", "left_anti"), "strangers"), "note_id").filter("note_id IS NOT NULL")
        buckets = self.mentions.touched(notes)
        gone = stored(self.mentions.read(buckets).join(notes, "note_id", "left_semi").select("key"), "gone")
        keys = stored(gone.unionByName(fresh.select("key")).distinct(), "touched_keys")

        def renew(old: DataFrame) -> tuple[DataFrame, DataFrame]:
            stay, maybe = apart(old, notes, "note_id")
            return stay, maybe.join(notes, "note_id", "left_anti").unionByName(fresh)

        self.mentions.change(notes, renew)
        now = self.mentions.read(buckets).withColumn("part", self.mentions._bucket()).join(keys, "key", "left_semi")
        at = F.struct("note_id", "pos")
        new = now.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"))
        place = F.array(*[F.lit(b) for b in buckets]).cast("array<int>")  # at most as many as there are buckets
        seen = keys.withColumn("_seen", F.lit(True))

        def replace(old: DataFrame) -> DataFrame:
            kept = old.join(seen, "key", "left").filter(F.col("_seen").isNull() | ~F.array_contains(place, F.col("part"))).drop("_seen")
            return kept.unionByName(new.select(*old.columns))

        self.parts.change(keys, replace)

    def entities(self) -> DataFrame:
        """As `aggregate_entities` gives them over all mentions: (key, name, category, first_description, n_mentions, first_note)."""
        per = self.parts.read().groupBy("key").agg(F.sum("n").alias("n_mentions"), F.min("first").alias("at"))
        return first_texts(self.mentions.read(), per)

    def vacuum(self, keep: int = 2) -> int:
        """Drop what only versions before the last ``keep`` name; how many folders of buckets went."""
        return self.mentions.vacuum(keep) + self.parts.vacuum(keep)

    def recompiled(self) -> DataFrame:
        """The same from all mentions at once."""
        return aggregate_entities(self.mentions.read())
