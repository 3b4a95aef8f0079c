"""Streams and polls against what a batch over all rows gives."""

import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.operators import usage
from vellum.sources import files
from vellum.streaming import usage_streams as us

START = 1_700_000_000


def turns_of(spark, rows):
    return spark.createDataFrame(rows, "session_id long, m long").select("session_id", F.timestamp_seconds(F.lit(START) + F.col("m") * 60).alias("ts"))


def as_minutes(rows):
    minute = lambda t: (int(t.timestamp()) - START) // 60
    return sorted((r.session_id, minute(r.start), minute(r.last_active), r.turns) for r in rows)


def test_sessions_in_any_order_and_batching(spark, tmp_path):
    """Turns shuffled over batches, a start of the stream anew between them: starts move, sessions join, equal times count."""
    rng = random.Random(0)
    rows = [(s, rng.randint(0, 900)) for s in range(6) for _ in range(rng.randint(1, 14))]
    rows += rows[:5]
    want = as_minutes(usage.sessions(turns_of(spark, rows)).collect())
    rng.shuffle(rows)
    path, out, check = (str(tmp_path / x) for x in ("turns", "out", "check"))
    for k in range(0, len(rows), len(rows) // 3 + 1):
        turns_of(spark, rows[k : k + len(rows) // 3 + 1]).coalesce(1).write.mode("append").parquet(path)
        us.stream_sessions(us.read_stream(spark, path + "/"), out, check, late="2 days")
    assert as_minutes(us.open_sessions(spark.read.parquet(out)).collect()) == want


def test_a_late_turn_moves_a_start_and_joins_two_sessions(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("turns", "out", "check"))
    seen = []
    for batch in ([(1, 30)], [(1, 10)], [(1, 130)], [(1, 80)]):
        turns_of(spark, batch).coalesce(1).write.mode("append").parquet(path)
        us.stream_sessions(us.read_stream(spark, path + "/"), out, check, late="3 hours")
        seen.append([r[1:] for r in as_minutes(us.open_sessions(spark.read.parquet(out)).collect())])
    assert seen == [[(30, 30, 1)], [(10, 30, 2)], [(10, 30, 2), (130, 130, 1)], [(10, 130, 4)]]


def test_sessions_that_no_turn_can_reach_leave_the_state(spark, tmp_path):
    """Days apart: the watermark passes sessions, timers drop them, and the table keeps them."""
    path, out, check = (str(tmp_path / x) for x in ("turns", "out", "check"))
    rows = [(1, 0), (2, 5), (1, 30), (1, 3000), (2, 3000), (1, 6000), (2, 6010), (1, 6050)]
    for some in (rows[:3], rows[3:5], rows[5:]):
        turns_of(spark, some).coalesce(1).write.mode("append").parquet(path)
        us.stream_sessions(us.read_stream(spark, path + "/"), out, check, late="10 minutes")
    assert as_minutes(us.open_sessions(spark.read.parquet(out)).collect()) == as_minutes(usage.sessions(turns_of(spark, rows)).collect())


def events_of(spark, rows):
    made = spark.createDataFrame(rows, "event_id long, h long, phase string")
    return made.select("event_id", F.timestamp_seconds(F.lit(START) + F.col("h") * 3600).alias("ts"), "phase", F.lit(3).cast("long").alias("prompt"), F.lit(1).cast("long").alias("completion"), F.lit(0.5).alias("elapsed"))


def test_rollup_splits_off_late_rows_and_stays_few_files(spark, tmp_path):
    path, out, check = (str(tmp_path / x) for x in ("log", "out", "check"))
    rng = random.Random(2)
    hours = [5, 60, 20, 61, 62, 3, 90, 100, 99, 10, 120, 121]
    rows = [[(100 * k + i, h - rng.choice([0, 0, 1]), rng.choice("ab")) for i in range(5)] for k, h in enumerate(hours)]
    for some in rows:
        events_of(spark, some).coalesce(1).write.mode("append").parquet(path)
        us.stream_rollup(us.read_stream(spark, path + "/"), out, check, late="1 day", fold_after=4)
    late = {r.event_id // 100 for r in us.late_rows(spark, out).collect()}
    assert late == {2, 5, 9}  # over a day before the latest event of the batches before them
    whole = [r for some in rows for r in some]
    as_rows = lambda df: sorted(map(tuple, df.select("day", "phase", *us.DAILY).collect()))
    per = usage.rollup_daily(events_of(spark, whole)).select("day", F.explode("by_phase").alias("phase", "t")).select("day", "phase", "t.*")
    assert as_rows(us.rollup_with_late(spark, out)) == as_rows(per)
    assert sum(r[2] for r in as_rows(us.rollup_so_far(spark, out))) == len(whole) - 5 * len(late)
    for table in ("parts", "marks", "late"):
        assert sorted(x for x in os.listdir(f"{out}/{table}")) == ["n=000000008-folded", "n=000000009", "n=000000010", "n=000000011"]


def test_a_tail_goes_on_with_what_it_did_not_take(spark, tmp_path):
    events_of(spark, [(i, i, "p") for i in range(30)]).coalesce(1).write.parquet(str(tmp_path / "log"))
    stream, check = us.read_stream(spark, str(tmp_path / "log")), str(tmp_path / "check")
    assert us.follow(stream, str(tmp_path / "a"), check, most=11, seconds=60) == 11
    assert us.follow(stream, str(tmp_path / "b"), check, most=4, seconds=60) == 4
    assert us.follow(stream, str(tmp_path / "c"), check, seconds=4) == 15
    ids = [sorted(r.event_id for r in spark.read.parquet(str(tmp_path / x)).collect()) for x in "abc"]
    assert ids == [list(range(11)), list(range(11, 15)), list(range(15, 30))]


@pytest.fixture
def vault(tmp_path):
    (tmp_path / "vault" / "Research").mkdir(parents=True)
    (tmp_path / "vault" / ".hidden").mkdir()
    (tmp_path / "vault" / "Other").mkdir()
    for name in ("Research/alpha.md", "Research/beta.md", ".hidden/config.md", "Other/gamma.md", "Research/.dot.md"):
        (tmp_path / "vault" / name).write_text(f"# {name}")
    (tmp_path / "vault" / "Research" / "notes.txt").write_text("no note")
    return tmp_path / "vault"


def kinds(df):
    return {(r.path, r.kind) for r in df.collect()}


def test_listing(spark, vault):
    paths = lambda *a: {r.path for r in files.list_notes(spark, str(vault), *a).collect()}
    assert paths() == {"Research/alpha.md", "Research/beta.md", "Other/gamma.md"}
    assert paths("Research") == {"Research/alpha.md", "Research/beta.md"} and paths("Gone") == set()
    plan = files.list_notes(spark, str(vault))._jdf.queryExecution().optimizedPlan().toString()
    assert "decode" not in plan and "sha2" not in plan


def test_watching_a_folder(spark, vault, tmp_path):
    """Polls, added, modified and deleted notes, a poll without changes, a watch that starts again from its snapshot."""
    state, told = str(tmp_path / "state"), []
    tell = lambda df, n: told.append(kinds(df))
    watch = lambda polls: us.watch_folder(spark, str(vault), state, "Research", every="1 second", polls=polls, seconds=60, tell=tell)
    assert watch(2) == 1 and told == [{("Research/alpha.md", "added"), ("Research/beta.md", "added")}]
    (vault / "Research" / "new.md").write_text("new")
    (vault / "Research" / "beta.md").unlink()
    os.utime(vault / "Research" / "alpha.md", (1_800_000_000, 1_800_000_000))
    (vault / "Other" / "gamma.md").write_text("outside of the folder")
    assert watch(1) == 1
    assert told[1:] == [{("Research/new.md", "added"), ("Research/beta.md", "deleted"), ("Research/alpha.md", "modified")}]
    assert watch(1) == 0 and len(told) == 2
    (vault / "Research" / "new.md").unlink()
    assert watch(1) == 1 and told[2:] == [{("Research/new.md", "deleted")}]
    assert len(os.listdir(f"{state}/snapshots")) == 2 and len(os.listdir(f"{state}/changes")) == 3


def test_snapshots(spark, tmp_path):
    """None without a snapshot, the last one, one before a version, and none if the last cannot be read."""
    path = str(tmp_path / "snapshots")
    listing = spark.createDataFrame([("a.md", 1), ("b.md", 2)], "path string, mtime long")
    assert files.load_snapshot(spark, path) is None
    files.write_snapshot(listing, path, 3)
    files.write_snapshot(listing.filter("mtime = 1"), path, 12)
    assert files.load_snapshot(spark, path).count() == 1 and files.load_snapshot(spark, path, 12).count() == 2
    for name in os.listdir(f"{path}/snapshot_id=000000000012"):
        if name.endswith(".parquet"):
            (tmp_path / "snapshots" / "snapshot_id=000000000012" / name).write_text("not json }{")
        elif name.endswith(".crc"):
            os.unlink(f"{path}/snapshot_id=000000000012/{name}")
    assert files.load_snapshot(spark, path) is None
    found = us.watch_changes(spark, listing, str(tmp_path), 13)
    assert kinds(found) == {("a.md", "added"), ("b.md", "added")}


def test_rebuilding_what_changed(spark, tmp_path):
    """Change sets with paths of a vault; only touched notes are built anew, and rows of gone ones go."""
    path, built = str(tmp_path / "watch"), []
    listing = lambda rows: spark.createDataFrame(rows, "path string, mtime long")

    def rebuild(touched):
        built.append(sorted(r.path for r in touched.collect()))
        return touched.withColumn("made", F.upper("path"))

    run = lambda: us.watch_rebuild(spark, path, str(tmp_path / "check"), rebuild, str(tmp_path / "out"))
    run()  # nothing has been watched yet
    us.watch_changes(spark, listing([("n/a.md", 1), ("n/b.md", 1), ("n/c.md", 1)]), path, 1)
    run()
    assert us.watch_changes(spark, listing([("n/a.md", 1), ("n/b.md", 1), ("n/c.md", 1)]), path, 2) is None
    us.watch_changes(spark, listing([("n/a.md", 1), ("n/b.md", 2)]), path, 3)
    run()
    assert built == [["n/a.md", "n/b.md", "n/c.md"], ["n/b.md"]]
    assert sorted(r.made for r in us.current(spark.read.parquet(str(tmp_path / "out")), "path").collect()) == ["N/A.MD", "N/B.MD"]


def test_many_ids_share_a_state(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(us, "STATES", 2)
    rows = [(i, m) for i in range(40) for m in (i, i + 30, i + 100)]
    path, out, check = (str(tmp_path / x) for x in ("turns", "out", "check"))
    for part in (rows[::2], rows[1::2]):
        turns_of(spark, part).write.mode("append").parquet(path)
        us.stream_sessions(us.read_stream(spark, path + "/"), out, check, late="2 days")
    assert as_minutes(us.open_sessions(spark.read.parquet(out)).collect()) == as_minutes(usage.sessions(turns_of(spark, rows)).collect())
