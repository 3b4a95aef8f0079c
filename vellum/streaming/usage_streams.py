"""Structured Streaming over the usage log, chat turns and change sets."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import changes, usage
from ..sources.files import list_notes, load_snapshot, write_snapshot
from ..sources.tables import fresh_path, move, names_in, remove, stored


def read_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream with the schema that it has now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path.rstrip('/')}*")  # a pattern: the source takes a plain path for a folder


def drain(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, a batch at a time, then stop; called again, it goes on from its checkpoint."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


def _append_to(path: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch under its own id, so a batch that runs again replaces itself."""
    return lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/n={n}")


def tail_usage(events: DataFrame, path: str, checkpoint: str) -> None:
    """Copy new events to a table as they come. Offsets tell what is new, so bursts and equal times lose nothing."""
    drain(events, _append_to(path), checkpoint)


DAILY = ["calls", "prompt", "completion"]
#: After so many batches the parts of a stream's rollup are folded into one.
FOLD_AFTER = 20


def stream_rollup(events: DataFrame, path: str, checkpoint: str, late: str = "1 day", fold_after: int = FOLD_AFTER) -> None:
    """Daily totals by phase as they come: each batch adds a part, and parts are folded so that files stay few. `rollup_so_far` reads them.

    An event older than the latest one of the batches before, less ``late``, is not added: it is kept whole in the table of
    late rows, for the batch rollup (`rollup_with_late`). A batch that runs again replaces its part.
    """
    spark = events.sparkSession
    delay = spark.sql(f"SELECT cast(INTERVAL {late} AS INTERVAL DAY TO SECOND) AS d").first()[0]

    def sink(batch: DataFrame, n: int) -> None:
        marks = _parts(spark, f"{path}/marks", n)
        mark = spark.read.parquet(*marks).agg(F.max("mark")).first()[0] if marks else None
        old = F.col("ts") < F.lit(mark - delay) if mark else F.lit(False)
        batch.filter(old).write.mode("overwrite").parquet(f"{path}/late/n={n:09d}")
        per = batch.filter(~old).groupBy(F.to_date("ts").alias("day"), "phase").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
        per.write.mode("overwrite").parquet(f"{path}/parts/n={n:09d}")
        batch.agg(F.greatest(F.max("ts"), F.lit(mark).cast("timestamp")).alias("mark")).write.mode("overwrite").parquet(f"{path}/marks/n={n:09d}")
        if n and n % fold_after == 0:
            _fold(spark, path, n)

    drain(events, sink, checkpoint)


def _parts(spark: SparkSession, path: str, before: int | None = None) -> list[str]:
    """Parts ``n=…`` of a table, those before a batch; a fold ``n=…-folded`` stands for itself and all up to it."""
    names = sorted(x for x in names_in(spark, path) if x.startswith("n="))
    at = lambda x: int(x[2:11])
    names = [x for x in names if before is None or at(x) < before]
    folds = [at(x) for x in names if x.endswith("-folded")]
    last = max(folds, default=-1)
    return [f"{path}/{x}" for x in names if at(x) > last or at(x) == last and x.endswith("-folded")]


def _fold(spark: SparkSession, path: str, n: int) -> None:
    """Parts up to batch n become one. The fold is whole before they go, and readers take it as soon as it is there."""
    for table, make in (("parts", lambda df: df.groupBy("day", "phase").agg(*[F.sum(c).alias(c) for c in DAILY])), ("marks", lambda df: df.agg(F.max("mark").alias("mark"))), ("late", lambda df: df)):
        some = _parts(spark, f"{path}/{table}", n + 1)
        make(spark.read.parquet(*some)).coalesce(1 if table == "marks" else 8).write.mode("overwrite").parquet(f"{path}/{table}/_fold")
        move(spark, f"{path}/{table}/_fold", f"{path}/{table}/n={n:09d}-folded")
        for old in some:
            remove(spark, old)


def rollup_so_far(spark: SparkSession, path: str) -> DataFrame:
    """(day, phase, calls, prompt, completion) of the events that came in time."""
    return spark.read.parquet(*_parts(spark, f"{path}/parts")).groupBy("day", "phase").agg(*[F.sum(c).alias(c) for c in DAILY])


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(*_parts(spark, f"{path}/late"))


def rollup_with_late(spark: SparkSession, path: str) -> DataFrame:
    """The rollup with the late rows, reduced by the batch rollup, added to their days."""
    late = usage.rollup_daily(late_rows(spark, path)).select("day", F.explode("by_phase").alias("phase", "t")).select("day", "phase", *[F.col(f"t.{c}").alias(c) for c in DAILY])
    return rollup_so_far(spark, path).unionByName(late).groupBy("day", "phase").agg(*[F.sum(c).alias(c) for c in DAILY])


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key of an upserted table."""
    rest = [c for c in table.columns if c not in (*keys, "batch", "n")]
    return table.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_l")).select(*keys, "_l.*")


def stream_totals(events: DataFrame, path: str, checkpoint: str) -> None:
    """Running totals by phase since the checkpoint began; a new checkpoint is the reset."""
    per = events.groupBy("phase").agg(F.count(F.lit(1)).alias("calls"), F.sum("prompt").alias("prompt"), F.sum("completion").alias("completion"))
    drain(per, _append_to(path), checkpoint, "update")


SESSION = "session_id long, start timestamp, last_active timestamp, turns long"
#: Ids share so many states: a state is read and written once a batch for all its ids.
STATES = 8192
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Sessions(StatefulProcessor):
    """The open sessions of the ids of a bucket in one state (columns id, start, last, turns); a timer drops those that no turn can reach any more.

    A turn goes to the sessions within ``ttl`` of it: none is a session of its own, one grows, and may begin earlier,
    and two become one. A start that is no more is told with no turns.
    """

    def __init__(self, ttl_seconds: int):
        self.gap = ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "sessions binary")

    def _sessions(self) -> np.ndarray:
        got = self.open.get()
        return np.frombuffer(got[0], np.int64).reshape(4, -1) if got is not None else np.zeros((4, 0), dtype=np.int64)

    def _keep(self, sessions: np.ndarray) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if sessions.shape[1]:
            self.open.update((sessions.tobytes(),))
            self.handle.registerTimer((int(sessions[2].min()) + self.gap) // 1000 + 1)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was, both = self._sessions(), []
        for part in rows:
            at = part["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
            both.append(np.stack([part["session_id"].to_numpy().astype(np.int64), at, at, np.ones_like(at)]))
        each = np.concatenate([was, *both], axis=1)
        ids, start, last, n = each[:, np.lexsort((each[2], each[1], each[0]))]
        reach = pd.Series(last).groupby(ids).cummax().to_numpy()
        first = np.ones(len(ids), dtype=bool)
        first[1:] = (ids[1:] != ids[:-1]) | (start[1:] > reach[:-1] + self.gap)
        at = np.flatnonzero(first)
        now = np.stack([ids[at], start[at], np.maximum.reduceat(last, at), np.add.reduceat(n, at)])
        self._keep(now)
        rows_of = lambda x, k: pd.MultiIndex.from_arrays(list(x[:k]))
        gone = was[:, ~rows_of(was, 2).isin(rows_of(now, 2))]
        told = np.concatenate([now[:, ~rows_of(now, 4).isin(rows_of(was, 4))], np.stack([gone[0], gone[1], gone[1], np.zeros_like(gone[0])])], axis=1)
        yield pd.DataFrame({"session_id": told[0], "start": told[1].astype("datetime64[us]"), "last_active": told[2].astype("datetime64[us]"), "turns": told[3]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._sessions()
        self._keep(sessions[:, (sessions[2] + self.gap) // 1000 >= timerValues.getCurrentWatermarkInMs()])
        return iter(())

    def close(self) -> None:
        pass


def stream_sessions(turns: DataFrame, path: str, checkpoint: str, ttl_seconds: int = 3600, late: str = "1 hour") -> None:
    """Sessions by idle time, upserted by (session_id, start): (session_id, start, last_active, turns). `open_sessions` reads them.

    Turns may come in any order within ``late``: whatever it was, the sessions are those of the batch. A turn that
    is later than the watermark is dropped. State is held for an id's open sessions only.
    """
    conf, (key, rocks) = turns.sparkSession.conf, ROCKS
    was = conf.get(key, None)
    conf.set(key, rocks)  # lists and timers need this store
    try:
        rows = turns.select("session_id", "ts", F.pmod(F.xxhash64("session_id"), F.lit(STATES)).alias("bucket")).withWatermark("ts", late)
        per = rows.groupBy("bucket").transformWithStateInPandas(Sessions(ttl_seconds), SESSION, "Update", "EventTime")
        drain(per, _append_to(path), checkpoint, "update")
    finally:
        conf.set(key, was) if was else conf.unset(key)


def open_sessions(table: DataFrame) -> DataFrame:
    """The sessions of a table that `stream_sessions` writes, without starts that have moved or been joined."""
    return latest(table, ["session_id", "start"]).filter("turns > 0")


def follow(events: DataFrame, path: str, checkpoint: str, log: DataFrame | None = None, backfill: int = 0, most: int | None = None, seconds: float | None = None, heartbeat: float = 15.0) -> int:
    """Tail a log to a table of (kind, event_id, ts, phase, prompt, completion): how many new events came.

    First the last ``backfill`` events of ``log``, oldest first, then new ones as they come, until ``most`` have passed or
    ``seconds`` are over. After ``heartbeat`` seconds without any, a row of that kind says that the tail is alive.
    What a batch holds beyond ``most`` is kept beside the checkpoint, and comes first when the tail goes on from there.
    """
    spark, rest = events.sparkSession, f"{checkpoint}-unread"
    kept = ["event_id", "ts", "phase", "prompt", "completion"]
    put = lambda rows, kind, name: rows.select(F.lit(kind).alias("kind"), *kept).write.mode("overwrite").parquet(f"{path}/n={name}")
    if log is not None and backfill:
        put(usage.recent_events(log, backfill).orderBy("ts", "event_id"), "backfill", "backfill")
    passed: dict[int, int] = {}

    def take(rows: DataFrame, n: int, name: str) -> None:
        left = None if most is None else max(0, most - sum(k for b, k in passed.items() if b != n))
        if left is None or rows.count() <= left:
            put(rows, "new", name)
        else:
            put(rows.orderBy("ts", "event_id").limit(left), "new", name)
            told = spark.read.parquet(f"{path}/n={name}").select("event_id")
            rows.join(told, "event_id", "left_anti").select(*kept).write.mode("overwrite").parquet(f"{rest}/n={name}")
        passed[n] = spark.read.parquet(f"{path}/n={name}").count()

    def sink(batch: DataFrame, n: int) -> None:
        take(batch, n, f"{n:09d}")

    if before := [f"{rest}/{x}" for x in names_in(spark, rest)]:
        again = stored(spark.read.parquet(*before), "unread")  # what is left of it is written anew
        for x in before:
            remove(spark, x)
        take(again, -1, f"again-{uuid.uuid4().hex}")

    query = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(processingTime="1 second").start()
    began = spoke = time.monotonic()
    seen = beats = 0
    try:
        while not query.awaitTermination(0.5):
            now, count = time.monotonic(), sum(passed.values())
            if count > seen:
                seen, spoke = count, now
            if (most is not None and count >= most) or (seconds is not None and now - began >= seconds):
                break
            if now - spoke >= heartbeat:
                spoke, beats = now, beats + 1
                put(events.sparkSession.range(1).select(*[(F.current_timestamp() if c == "ts" else F.lit(None)).cast(events.schema[c].dataType).alias(c) for c in kept]), "heartbeat", f"beat{beats:09d}")
    finally:
        query.stop()
    return sum(passed.values())


HISTORY = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("last_question", T.StringType()), T.StructField("error", T.StringType())])
HISTORY_STATE = T.StructType([T.StructField("turns", T.LongType()), T.StructField("last_question", T.StringType())])


def session_history(turns: DataFrame) -> DataFrame:
    """Per session and batch: how many turns its history holds. A row with ``control = 'clear'`` drops it; for an unknown session that is an error.

    Rows are (session_id, turn, question, control). The state is a count and one question, whatever the session's length.
    """

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, last = state.get if state.exists else (0, None)
        error = None
        rows = pd.concat(list(parts)).sort_values("turn")
        for r in rows.itertuples(index=False):
            if r.control == "clear":
                error = None if n else "unknown session"
                n, last = 0, None
            else:
                n, last, error = n + 1, r.question, None
        if n:
            state.update((n, last))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"session_id": [key[0]], "turns": [n], "last_question": [last], "error": [error]})

    return turns.groupBy("session_id").applyInPandasWithState(fold, HISTORY, HISTORY_STATE, "update", GroupStateTimeout.NoTimeout)


def watch_changes(spark: SparkSession, listing: DataFrame, path: str, snapshot_id: int) -> DataFrame | None:
    """One poll: the change set against the last snapshot before this one, appended to ``changes``, and the snapshot moved on.

    None, and nothing written, if nothing changed. The change set is whole before the snapshot, and a poll that runs
    again finds the same one. Snapshots older than the one before go.
    """
    before = load_snapshot(spark, f"{path}/snapshots", snapshot_id)
    diff = stored(changes.snapshot_diff(before, listing := stored(listing, "listing")), "diff")
    if diff.isEmpty():
        if before is None:
            write_snapshot(listing, f"{path}/snapshots", snapshot_id)
        return None
    out = f"{path}/changes/poll={snapshot_id:012d}"
    diff.write.mode("overwrite").parquet(out)
    write_snapshot(listing, f"{path}/snapshots", snapshot_id)
    for name in [x for x in sorted(names_in(spark, f"{path}/snapshots")) if x.startswith("snapshot_id=")][:-2]:
        remove(spark, f"{path}/snapshots/{name}")
    return spark.read.parquet(out)


def watch_folder(spark: SparkSession, root: str, path: str, folder: str | None = None, every: str = "10 seconds", polls: int | None = None, seconds: float | None = None, tell: Callable[[DataFrame, int], None] | None = None) -> int:
    """Poll a folder of notes by a stream whose batches are the polls: how many change sets came.

    A clock is the stream's source; each of its batches lists names and times, no contents, below ``folder`` of ``root``,
    and makes a version of the snapshot under its own number, so a batch that runs again is the same poll. Versions
    and the clock's checkpoint are below ``path``: a watch that starts there again goes on from the last snapshot.
    ``tell`` gets each change set that is not empty. Ends after so many ``polls`` or ``seconds``, or when it is stopped.
    """
    done: dict[int, bool] = {}

    def poll(_: DataFrame, n: int) -> None:
        if polls is not None and len(done) >= polls and n not in done:
            return
        found = watch_changes(spark, list_notes(spark, root, folder), path, n + 1)
        if found is not None and tell:
            tell(found, n + 1)
        done[n] = found is not None

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    query = clock.writeStream.option("checkpointLocation", f"{path}/clock").foreachBatch(poll).trigger(processingTime=every).start()
    began = time.monotonic()
    try:
        while not query.awaitTermination(0.2):
            if polls is not None and len(done) >= polls or seconds is not None and time.monotonic() - began >= seconds:
                break
    finally:
        query.stop()
    return sum(done.values())


def watch_rebuild(spark: SparkSession, path: str, checkpoint: str, rebuild: Callable[[DataFrame], DataFrame], into: str) -> None:
    """Hand each new change set to ``rebuild`` (touched paths in, derived rows with their path out) and store what it makes, and which paths changed at all.

    Paths are of the type that the change sets have.
    """
    if not names_in(spark, f"{path}/changes"):
        return
    told = spark.read.parquet(f"{path}/changes").drop("poll").schema
    stream = spark.readStream.schema(told).option("recursiveFileLookup", "true").parquet(f"{path}/changes")

    def sink(batch: DataFrame, n: int) -> None:
        # several polls may come in one batch: a path is gone if its last change says so, and that is the snapshot's to tell
        there = load_snapshot(spark, f"{path}/snapshots").select("path")
        touched = batch.select("path").distinct()
        made = rebuild(touched.join(there, "path", "left_semi")).withColumn("changed", F.lit(False))
        marks = touched.withColumn("changed", F.lit(True))
        _append_to(into)(made.unionByName(marks, allowMissingColumns=True), n)

    drain(stream, sink, checkpoint)


def current(table: DataFrame, key: str) -> DataFrame:
    """The rows that `watch_rebuild` made of each path when it last changed; none of paths that went."""
    last = table.filter("changed").groupBy(key).agg(F.max("batch").alias("batch"))
    return table.filter(~F.col("changed")).join(last, [key, "batch"], "left_semi").drop("changed", "batch", "n")


def streamed(spark: SparkSession, run: Callable[[str, str], None]) -> DataFrame:
    """Run a stream into a fresh table and read it."""
    path, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "checkpoint")
    run(path, checkpoint)
    return spark.read.parquet(path)
