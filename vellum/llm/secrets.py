"""Secret scans with corpus-wide ownership frequency.

Each text is scanned for candidates. Their hashes are then counted over the corpus by distinct repositories
and owners: what many owners have is a copied example, what one owner has looks live. The verdict decides
which of the candidates that only look random (no keyword, no known prefix) are reported at all.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attach, materialize

#: Kinds in the order of the report. ``random`` is the one that needs an owner's verdict.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LONG_HEX = re.compile(r"[0-9a-f]{24}")
DIGIT = re.compile(r"[0-9]")
LEAST_ENTROPY = 3.5
#: A value is a widely copied example from so many owners on, or from so many repositories on, whoever owns them.
EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 6


def _entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def scan(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of all candidates of a text, sorted; positions are code points, end exclusive."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if LONG_HEX.search(text):
        found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= 24]
    if DIGIT.search(text):
        found.sort()
        starts, ends = [f[0] for f in found], list(accumulate((f[2] for f in found), max))
        for m in RANDOM.finditer(text):
            s = m[0]
            before = bisect_left(starts, m.end())  # base spans that begin before its end; it meets one if any of them ends after its start
            if DIGIT.search(s) and not s.isdigit() and not (before and ends[before - 1] > m.start()) and _entropy(s) >= LEAST_ENTROPY:
                found.append((m.start(), 3, m.end(), s))
    return sorted(found)


def _scan_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        found = [[{"start": a, "kind": k, "end": b, "value": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest()} for a, k, b, v in scan(t or "")] for t in pdf.pop("text")]
        yield pdf.assign(found=found)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """One row a document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, reach``.

    A value is an example if EXAMPLE_OWNERS or more owners or EXAMPLE_REPOS or more repositories have it, and
    live if it is not and one owner has it. Base spans are always reported, a ``random`` span (20 or more
    characters with digits, 3.5 bits a character) unless its value is an example. ``n_live`` and ``n_example``
    count the reported spans of either sort, ``reach`` lists owners:repositories of each of them in order. An owner is a value of
    ``owner_col``, a repository one of ``repo_cols``; null is an owner like any other. A null text is empty;
    repeated rows are documents of their own; other columns are ignored; an empty table gives an empty result.
    """
    repo = F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repo_cols])
    slim = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), repo.alias("repo"), F.col(text_col).alias("text"))
    slim = slim.mapInPandas(_scan_all, "row_id long, doc_id long, owner string, repo string, found array<struct<start: long, kind: int, end: long, value: string>>")
    slim = materialize(slim, "candidates")
    each = slim.select("row_id", "doc_id", "owner", "repo", F.explode("found").alias("f")).select("row_id", "doc_id", "owner", "repo", "f.*")
    uses = each.groupBy("value", "owner", "repo").agg(F.count(F.lit(1)).alias("uses"))
    uses = uses.groupBy("value", "owner").agg(F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("repos"))
    uses = uses.groupBy("value").agg(F.sum("uses").alias("uses"), F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    uses = materialize(uses, "ownership")
    n_spans = uses.agg(F.coalesce(F.sum("uses"), F.lit(0))).first()[0]
    told = attach(each, uses, "value", "uses", int(n_spans))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("repos") >= EXAMPLE_REPOS)
    told = told.withColumn("example", example)
    span = F.struct("start", "kind", "end", "owners", "repos", "example")
    per_doc = told.filter((F.col("kind") < 3) | ~F.col("example")).groupBy("row_id", "doc_id").agg(F.array_sort(F.collect_list(span)).alias("s"))
    none = F.array().cast("array<struct<start: bigint, kind: int, end: bigint, owners: bigint, repos: bigint, example: boolean>>")
    rest = slim.filter(F.size("found") == 0).select("row_id", "doc_id", none.alias("s"))
    dropped = slim.filter(F.size("found") > 0).select("row_id", "doc_id").join(per_doc.select("row_id"), "row_id", "left_anti").select("row_id", "doc_id", none.alias("s"))
    out = per_doc.unionByName(rest).unionByName(dropped)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda keep: F.size(F.filter("s", keep)).cast("long")
    of = lambda k: lambda x: x["kind"] == k
    return out.select(
        "doc_id",
        *[count(of(k)).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(said(F.filter("s", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        said(F.col("s")).alias("spans"),
        count(lambda x: (x["owners"] == 1) & ~x["example"]).alias("n_live"),
        count(lambda x: x["example"]).alias("n_example"),
        F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["owners"].cast("string"), x["repos"].cast("string"))), ",").alias("reach"),
    )
