"""Usage analytics over an event log: (event_id, ts, session_id, phase, prompt, completion, elapsed, cacheable)."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTALS = ["calls", "prompt", "completion", "elapsed"]


def parse_time_bound(text: str | None) -> datetime | None:
    """An ISO date or timestamp of a parameter; ValueError if it is neither."""
    return datetime.fromisoformat(text) if text else None


def time_bound(text: Column) -> Column:
    """The same for a column, as (bound, error): a null or blank text is no bound, and one that is neither date nor timestamp an error."""
    blank = F.coalesce(F.trim(text) == "", F.lit(True))
    shape = text.rlike(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)?)?$")
    bound = F.when(shape & ~blank, F.try_to_timestamp(text))
    return F.struct(bound.alias("bound"), F.when(~blank & bound.isNull(), F.concat(F.lit("neither a date nor a timestamp: "), text)).alias("error"))


def _totals() -> list[Column]:
    zero = F.lit(0).cast("long")
    return [
        F.count("event_id").alias("calls"), F.coalesce(F.sum("prompt"), zero).alias("prompt"), F.coalesce(F.sum("completion"), zero).alias("completion"),
        F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)), 6).alias("elapsed"),
    ]


def filter_events(events: DataFrame, since: datetime | None = None, until: datetime | None = None, phase: str | None = None) -> DataFrame:
    """Events from ``since`` on, before ``until``, of one phase; the bounds reach the Parquet scan."""
    for keep in ([F.col("ts") >= F.lit(since)] if since else []) + ([F.col("ts") < F.lit(until)] if until else []) + ([F.col("phase") == phase] if phase else []):
        events = events.filter(keep)
    return events


def usage_totals(events: DataFrame) -> DataFrame:
    return events.agg(*_totals())


def usage_by_phase(events: DataFrame) -> DataFrame:
    return events.groupBy("phase").agg(*_totals())


def recent_events(events: DataFrame, n: int | None = None) -> DataFrame:
    """Newest first; events of one time in the order of their ids."""
    out = events.orderBy(F.desc("ts"), F.desc("event_id"))
    return out.limit(n) if n else out


def usage_report(events: DataFrame, phase: str | None = None) -> DataFrame:
    """Total, phase and day sections in one pass of grouping sets. ``phase`` restricts the phase section, not the total."""
    days = events.withColumn("day", F.to_date("ts"))
    sets = days.groupingSets([["phase"], ["day"], []], "phase", "day").agg(F.grouping_id().alias("gid"), *_totals())
    section = F.when(F.col("gid") == 1, "phase").when(F.col("gid") == 2, "day").otherwise("total")
    out = sets.select(section.alias("section"), F.coalesce("phase", F.col("day").cast("string"), F.lit("-")).alias("key"), *TOTALS)
    return out.filter((F.col("section") != "phase") | (F.col("key") == phase)) if phase else out


def rollup_daily(events: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """A row a day from ``since`` (or the first day) to ``until`` (or the last), zeros for empty days, with a map by phase.

    Days are those of the session's time zone. Phases are few, so a day's map is small; events are reduced to
    a row per day and phase before anything is collected into it.
    """
    per = events.groupBy(F.to_date("ts").alias("day"), "phase").agg(*_totals())
    inside = per
    if since:
        inside = inside.filter(F.col("day") >= F.lit(since))
    if until:
        inside = inside.filter(F.col("day") <= F.lit(until))
    entry = F.struct("phase", F.struct(*TOTALS))
    got = inside.groupBy("day").agg(*[F.sum(c).alias(c) for c in TOTALS], F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_phase"))
    span = inside.agg(F.coalesce(F.lit(since).cast("date"), F.min("day")).alias("a"), F.coalesce(F.lit(until).cast("date"), F.max("day")).alias("b"))
    days = span.filter("a <= b").select(F.explode(F.sequence("a", "b")).alias("day"))
    zero = F.lit(0).cast("long")
    none = F.create_map().cast("map<string, struct<calls: bigint, prompt: bigint, completion: bigint, elapsed: double>>")
    out = days.join(got, "day", "left")
    return out.select("day", *[F.coalesce(c, zero).alias(c) for c in TOTALS[:3]], F.round(F.coalesce("elapsed", F.lit(0.0)), 6).alias("elapsed"), F.coalesce("by_phase", none).alias("by_phase"))


def query_daily(daily: DataFrame, since: date | None = None, until: date | None = None) -> DataFrame:
    """Days of a rollup, both bounds included, in order."""
    if since:
        daily = daily.filter(F.col("day") >= F.lit(since))
    if until:
        daily = daily.filter(F.col("day") <= F.lit(until))
    return daily.orderBy("day")


def cacheable_ratio(events: DataFrame) -> DataFrame:
    hits = F.count_if(F.col("cacheable"))
    n = F.count(F.lit(1))
    return events.agg(hits.alias("cacheable_calls"), F.coalesce(F.try_divide(hits.cast("double"), n), F.lit(0.0)).alias("ratio"))


def cache_savings(events: DataFrame) -> DataFrame:
    """Latency of the first cacheable call against the mean of the rest; zeros below two samples.

    The first call is a minimum over (time, id), so there is no global sort.
    """
    got = events.filter("cacheable").agg(F.count(F.lit(1)).alias("samples"), F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("total"), F.min_by("elapsed", F.struct("ts", "event_id")).alias("first"))
    some = F.col("samples") >= 2
    first = F.when(some, F.col("first")).otherwise(0.0)
    rest = F.when(some, (F.col("total") - F.col("first")) / (F.col("samples") - 1)).otherwise(0.0)
    rate = F.when(first > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (first - rest) / first))).otherwise(0.0)
    return got.select(F.round(first, 6).alias("first_call"), F.round(rest, 6).alias("rest_mean"), F.round(first - rest, 6).alias("savings"), F.round(rate, 6).alias("hit_rate"), "samples")


def usage_metrics(events: DataFrame, gauges: DataFrame | None = None) -> DataFrame:
    """One tall table (name, kind, labels, value) of counters in total and by phase, and of gauges (name, value)."""
    tall = lambda df, suffix, labels: df.select(F.explode(F.map_from_arrays(F.array(*[F.lit(f"{suffix}{c}_total") for c in TOTALS]), F.array(*[F.col(c).cast("double") for c in TOTALS]))).alias("name", "value"), labels.alias("labels"))
    none = F.create_map().cast("map<string,string>")
    out = tall(usage_totals(events), "usage_", none).unionByName(tall(usage_by_phase(events), "phase_", F.create_map(F.lit("phase"), F.col("phase")))).withColumn("kind", F.lit("counter"))
    if gauges is not None:
        out = out.unionByName(gauges.select("name", F.col("value").cast("double").alias("value"), none.alias("labels"), F.lit("gauge").alias("kind")))
    return out.select("name", "kind", "labels", "value")


def export_usage(events: DataFrame, n_recent: int = 20) -> DataFrame:
    """The report as rows (section, key, calls, prompt, completion, elapsed with three decimals) to be written as CSV."""
    three = F.col("elapsed").cast("decimal(18,6)").cast("decimal(18,3)").cast("string").alias("elapsed")  # halves away from zero
    head = usage_report(events).select(F.when(F.col("section") == "day", "daily").otherwise(F.col("section")).alias("section"), "key", "calls", "prompt", "completion", three)
    last = recent_events(events, n_recent).select(F.lit("event").alias("section"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("key"), F.lit(1).cast("long").alias("calls"), "prompt", "completion", three)
    return head.unionByName(last)


def export_usage_json(events: DataFrame) -> DataFrame:
    """The report as one JSON document: the total and phases."""
    by = usage_by_phase(events).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("phase", F.struct(*TOTALS))))).alias("by_phase"))
    return usage_totals(events).select(F.struct(*TOTALS).alias("total"), by.scalar().alias("by_phase")).select(F.to_json(F.struct("total", "by_phase")).alias("report"))


def budget_cutoff(items: DataFrame, cap: int, run: str = "run", pos: str = "pos", tokens: str = "tokens") -> DataFrame:
    """Items that are reached, in order, while the tokens used before them are under the cap of their run."""
    before = F.coalesce(F.sum(tokens).over(Window.partitionBy(run).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return items.withColumn("used_before", before).filter(F.col("used_before") < cap)


def budget_waves(items: DataFrame, cap: int, size: int, run: str = "run", pos: str = "pos", tokens: str = "tokens") -> DataFrame:
    """The same, looked at only between waves of ``size`` items."""
    wave = F.floor((F.row_number().over(Window.partitionBy(run).orderBy(pos)) - 1) / size).cast("long")
    told = items.withColumn("wave", wave)
    before = F.sum(tokens).over(Window.partitionBy(run).orderBy("wave").rangeBetween(Window.unboundedPreceding, -1))
    return told.withColumn("used_before", F.coalesce(before, F.lit(0).cast("long"))).filter(F.col("used_before") < cap)


def turn_usage(calls: DataFrame, cap: int | None = None) -> DataFrame:
    """Per session and turn: tokens of the turn, of the session so far, and what the turn has left of a budget of its own."""
    per = calls.groupBy("session_id", "turn").agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"))
    so_far = F.sum("tokens").over(Window.partitionBy("session_id").orderBy("turn"))
    out = per.withColumn("session_tokens", so_far)
    return out.withColumn("left", F.lit(cap).cast("long") - F.col("tokens")) if cap else out


def live_usage(steps: DataFrame, request: str = "session_id") -> DataFrame:
    """Calls, tokens and time of a request after each of its steps."""
    upto = Window.partitionBy(request).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(request, "event_id", F.count(F.lit(1)).over(upto).alias("calls"), F.sum(F.col("prompt") + F.col("completion")).over(upto).alias("tokens"), F.round(F.sum("elapsed").over(upto), 6).alias("elapsed"))


def recent_history(turns: DataFrame, n: int = 3, chars: int = 200) -> DataFrame:
    """With each turn the n turns before it, answers cut to ``chars``."""
    back = Window.partitionBy("session_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list(F.struct("question", F.substring("answer", 1, chars).alias("answer"))).over(back))


def sessions(turns: DataFrame, ttl: str = "1 hour") -> DataFrame:
    """Sessions that end after more than an hour without a turn: (session_id, start, end, turns). A gap of exactly an hour goes on."""
    got = turns.groupBy("session_id", F.session_window("ts", ttl)).agg(F.count(F.lit(1)).alias("turns"), F.max("ts").alias("last_active"))
    return got.select("session_id", F.col("session_window.start").alias("start"), "last_active", "turns")
