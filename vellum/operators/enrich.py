"""Batch enrichment by a model: only what the cache does not have is asked, in batches, on the executors."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as tx
from ..sources.keyed import Cache
from ..sources.tables import stored
from . import corpus, prompts
from .changes import cache_hits, cache_misses
from .entities import SHOWN_MENTIONS, first_mentions

#: Prompts that a model gets at a time.
ASKED = 500
SAID = "response string, error string, phase string, prompt long, completion long, elapsed double, cacheable boolean"


class Reply(NamedTuple):
    """What a model says, and the tokens that it has counted itself; without these they are estimated."""

    text: str | None
    prompt: int | None = None
    completion: int | None = None


ModelFn = Callable[[list[str]], list[str | Reply]]


@dataclass(frozen=True)
class SystemModel:
    """A model that takes the standing part of a prompt apart: ``fn`` gets (system, user) pairs."""

    fn: Callable[[list[tuple[str, str]]], list[str | Reply]]


def echo_model(batch: list[str]) -> list[str]:
    """The default model needs none: the length of a prompt and its last 20 characters."""
    return [f"{len(p)}:{p[-20:]}" for p in batch]


def ask(rows: DataFrame, model_fn: ModelFn | SystemModel, phase: str, keys: list[str], retries: int = 0, strict: bool = False, kind: str | None = None, lang: str = "en") -> DataFrame:
    """(keys, response, error, phase, prompt, completion, elapsed, cacheable) of rows with keys and ``prompt_text``.

    A `SystemModel` gets the system text of the prompt's ``kind`` beside each prompt; such calls are cacheable. A model that fails on a batch is asked prompt by prompt, each up to ``retries`` times more, so one bad row
    gets an ``error`` and no other; with ``strict`` the job fails instead.
    Tokens are those that a reply reports, else they are estimated from characters; the time of a batch is shared evenly.
    """
    apart = isinstance(model_fn, SystemModel)
    system = prompts.SYSTEM.get(kind or "", {}).get(lang, "") if apart else ""
    call = (lambda batch: model_fn.fn([(system, p) for p in batch])) if apart else model_fn

    kept = rows.select(*keys, "prompt_text")
    kinds = T.StructType([f for f in kept.schema if f.name != "prompt_text"] + list(T.StructType.fromDDL(SAID)))
    schema = to_arrow_schema(kinds)

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        """A batch's rows a stretch at a time: only these are ever Python strings."""
        for batch in batches:
            for low in range(0, len(batch), ASKED):
                yield batch.slice(low, ASKED).to_pandas()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in few(batches):
            asked, began = list(pdf.pop("prompt_text")), time.perf_counter()
            try:
                said, errors = list(call(asked)), [None] * len(asked)
            except Exception:
                said, errors = [], []
                for p in asked:
                    for left in range(retries, -1, -1):
                        try:
                            answer, error = call([p])[0], None
                            break
                        except Exception as e:
                            if strict and not left:
                                raise
                            answer, error = None, f"{type(e).__name__}: {e}"
                    said.append(answer)
                    errors.append(error)
            each = (time.perf_counter() - began) / max(1, len(asked))
            said = [r if isinstance(r, Reply) else Reply(r) for r in said]
            guess = lambda t: max(1, len(t) // tx.CHARS_PER_TOKEN) if t else 0
            told = lambda n, t: guess(t) if n is None else n
            out = pdf.assign(
                response=[r.text for r in said], error=errors, phase=phase, prompt=[told(r.prompt, system + p) for r, p in zip(said, asked, strict=True)],
                completion=[told(r.completion, r.text) for r in said], elapsed=each, cacheable=bool(system),
            )
            yield pa.RecordBatch.from_pandas(out[schema.names], schema=schema, preserve_index=False)

    return kept.mapInArrow(run, kinds)



def enrich(rows: DataFrame, keys: list[str], model_fn: ModelFn = echo_model, phase: str = "model", cache: DataFrame | Cache | None = None, retries: int = 0, strict: bool = False, kind: str | None = None, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(responses, usage): the cached response of each row or a fresh one, and a usage event for each fresh one.

    ``rows`` has the keys and ``prompt_text``, ``cache`` the keys and ``response``. Fresh answers are stored
    before they are used twice, so a model is asked once; a `Cache` gets them too, and its keys are those of the rows.
    """
    if isinstance(cache, Cache):
        cache, keeper = stored(cache.entries(rows).select(*keys, "response"), "cached"), cache
    else:
        keeper = None
    misses = cache_misses(rows, cache, keys) if cache is not None else rows
    fresh = stored(ask(misses, model_fn, phase, keys, retries, strict, kind, lang), "responses")
    if keeper:
        keeper.save(fresh.filter("error IS NULL"))
    out = fresh.select(*keys, "response", "error", F.lit(False).alias("cached"))
    if cache is not None:
        out = cache_hits(rows.select(*keys), cache, keys).select(*keys, "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")).unionByName(out)
    return out, fresh.filter("error IS NULL").select("phase", "prompt", "completion", "elapsed", "cacheable")


def _to_summarize(notes: DataFrame, keys: list[str], lang: str) -> DataFrame:
    todo = notes.filter("tier = 'atomic'")
    if "summary" in notes.columns:
        todo = todo.filter(F.coalesce("summary", F.lit("")) == "")
    return todo.select(*keys, prompts.build_prompt("summary", {"title": F.col("title"), "content": F.col("body")}, lang).alias("prompt_text"))


def _stamped(notes: DataFrame, cache: DataFrame | Cache | None, model: str) -> tuple[DataFrame, list[str]]:
    keys = cache.keys if isinstance(cache, Cache) else ["vault", "node_id", "mtime"]
    return notes.withColumn("model", F.lit(model)) if "model" in keys else notes, keys


def summarize_notes(notes: DataFrame, model_fn: ModelFn | SystemModel = echo_model, cache: DataFrame | Cache | None = None, lang: str = "en", model: str = "echo") -> tuple[DataFrame, DataFrame]:
    """Summaries of atomic notes that have none: (vault, node_id, mtime, summary, cached), and the usage.

    With a `Cache` what it has under the same time and ``model`` is not asked again, and what is asked is kept there.
    """
    notes, keys = _stamped(notes, cache, model)
    said, usage = enrich(_to_summarize(notes, keys, lang), keys, model_fn, "summarize", cache, kind="summary", lang=lang)
    return said.select("vault", "node_id", "mtime", tx.clean_summary(F.col("response")).alias("summary"), "cached"), usage


def summarize_within(notes: DataFrame, max_tokens: int, model_fn: ModelFn | SystemModel = echo_model, wave: int = 1000, cache: Cache | None = None, lang: str = "en", model: str = "echo") -> tuple[DataFrame, DataFrame, int]:
    """`summarize_notes` under a budget: (summaries, usage, how many notes were left out).

    Notes go in order, ``wave`` of them at a time. Before each wave the tokens that the model has used so far, as it
    counts them itself or else as estimated, are looked at, and once they reach ``max_tokens`` no further wave begins.
    Cached notes use none and are given whatever the budget. Every wave is stored, and kept by the `Cache`, so a run that goes
    on after one that ended asks only for what is missing.
    """
    notes, keys = _stamped(notes, cache, model)
    todo = _to_summarize(notes, keys, lang)
    parts = []
    if cache:
        parts.append(stored(cache.hits(todo.drop("prompt_text")).select(*keys, "response", F.lit(None).cast("string").alias("error"), F.lit(True).alias("cached")), "cached"))
        todo = cache.misses(todo)
    line = stored(corpus.numbered(todo, [], ["vault", "node_id"], "place"), "line")
    n, used, begun, spent = line.count(), 0, 0, []
    while begun < n and used < max_tokens:
        some = line.filter((F.col("place") >= begun) & (F.col("place") < begun + wave)).drop("place")
        said, usage = enrich(some, keys, model_fn, "summarize", kind="summary", lang=lang)
        if cache:
            cache.save(said.filter("error IS NULL"))
        used += usage.agg(F.coalesce(F.sum(F.col("prompt") + F.col("completion")), F.lit(0))).first()[0]
        parts.append(said)
        spent.append(usage)
        begun += wave
    none = "phase string, prompt long, completion long, elapsed double, cacheable boolean"
    spark = notes.sparkSession
    usage = reduce(DataFrame.unionByName, spent) if spent else spark.createDataFrame([], none)
    said = reduce(DataFrame.unionByName, parts) if parts else line.limit(0).select(*keys, F.lit("").alias("response"), F.lit(False).alias("cached"))
    return said.select("vault", "node_id", "mtime", tx.clean_summary(F.col("response")).alias("summary"), "cached"), usage, max(0, n - begun)


def summarize_sections(sections: DataFrame, model_fn: ModelFn = echo_model, least: int = 200, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """Sections (vault, section_id, note_title, title, text): a model's summary from ``least`` tokens on, else the first line; empty for an empty text."""
    long = tx.estimate_tokens(F.col("text"), 0) >= least
    first = tx.fallback_summary(F.col("text"))
    asked = sections.filter(long).select("vault", "section_id", prompts.build_prompt("section_summary", {"note": F.col("note_title"), "title": F.col("title"), "content": F.col("text")}, lang).alias("prompt_text"))
    said, usage = enrich(asked, ["vault", "section_id"], model_fn, "summarize", kind="section_summary", lang=lang)
    kept = sections.filter(long).select("vault", "section_id", first.alias("first")).join(said, ["vault", "section_id"])
    clean = tx.clean_summary(F.coalesce("response", F.lit("")))
    by_model = kept.select("vault", "section_id", F.when(clean == "", F.col("first")).otherwise(clean).alias("summary"))
    return by_model.unionByName(sections.filter(~long).select("vault", "section_id", first.alias("summary"))), usage


def extract_entities(notes: DataFrame, model_fn: ModelFn, lang: str = "en") -> tuple[DataFrame, DataFrame]:
    """(note_id, response) over notes (note_id, title, body) that are not blank, and the usage."""
    todo = notes.filter(tx.has_text(F.col("body")))
    asked = todo.select("note_id", prompts.build_prompt("entities", {"title": F.col("title"), "content": F.col("body")}, lang).alias("prompt_text"))
    said, usage = enrich(asked, ["note_id"], model_fn, "compile", kind="entities", lang=lang)
    return said.select("note_id", F.coalesce("response", F.lit("")).alias("response")), usage


def generate_pages(entities: DataFrame, mentions: DataFrame, model_fn: ModelFn = echo_model, lang: str = "en", shown: int = SHOWN_MENTIONS) -> tuple[DataFrame, DataFrame]:
    """(key, name, content) of entities (with xrefs) from their first ``shown`` mentions, and the usage."""
    entities = entities.join(first_mentions(mentions, shown), "key")
    told = F.array_join(F.transform("mentions", lambda m: F.concat(F.lit("- ["), m["note_id"].cast("string"), F.lit("]: "), m["description"])), "\n")
    fields = {"name": F.col("name"), "category": F.col("category"), "mentions": told, "xrefs": F.array_join("xrefs", ", ")}
    asked = entities.filter("n_mentions > 0").select("key", "name", prompts.build_prompt("page", fields, lang).alias("prompt_text"))
    said, usage = enrich(asked, ["key", "name"], model_fn, "compile", kind="page", lang=lang)
    return said.filter("error IS NULL").select("key", "name", F.col("response").alias("content")), usage
