"""Parsers of model responses as Column expressions: typed fields and an ``error``, never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import lines_of, strip

# The line of an entity, and a code fence around an answer.
ENTITY_LINE = r"(?m)^ENTITY:\s*(.+?)\s*\|\s*(.+?)\s*\|\s*(.+)$"
CODE_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


def _first_marked(response: Column, marks: list[str]) -> Column:
    """The first line that begins with one of the marks, or null."""
    def begins(x: Column) -> Column:
        out = x.startswith(marks[0])
        for m in marks[1:]:
            out = out | x.startswith(m)
        return out

    return F.get(F.filter(F.transform(lines_of(strip(response)), strip), begins), F.lit(0))


def _after(line: Column, mark: str) -> Column:
    return strip(F.substring(line, len(mark) + 1, 1 << 30))


def parse_select(response: Column) -> Column:
    """(action, value, error) of the first ``SELECT:`` or ``DONE:`` line."""
    line = _first_marked(response, ["SELECT:", "DONE:"])
    action = F.when(line.startswith("SELECT:"), "SELECT").when(line.startswith("DONE:"), "DONE")
    value = F.when(action == "SELECT", _after(line, "SELECT:")).when(action == "DONE", _after(line, "DONE:"))
    return F.struct(action.alias("action"), value.alias("value"), F.when(line.isNull(), "no SELECT or DONE line").alias("error"))


def json_snippet(response: Column) -> Column:
    """From the first ``{`` to the last ``}``, inside a code fence if there is one; null without."""
    text = F.when(F.regexp_like(response, F.lit(CODE_FENCE)), F.regexp_extract(response, CODE_FENCE, 1)).otherwise(response)
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def _field(payload: Column, *names: str) -> Column:
    given = [F.when(~F.lower(F.coalesce(payload[n], F.lit(""))).isin("", "null", "false", "0"), payload[n]) for n in names]
    return strip(F.coalesce(*given, F.lit("")))


def parse_select_json(response: Column) -> Column:
    """(action, value, error) of a JSON answer."""
    snippet = json_snippet(response)
    payload = F.from_json(snippet, "map<string,string>")
    action = F.upper(F.coalesce(payload["action"], F.lit("")))
    node, reason = _field(payload, "node_id", "node"), _field(payload, "reason", "message")
    error = (
        F.when(snippet.isNull(), "no JSON object").when(payload.isNull(), "invalid JSON")
        .when(~action.isin("SELECT", "DONE"), "unknown action").when((action == "SELECT") & (node == ""), "SELECT without node_id")
    )
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(action).alias("action"), good(F.when(action == "SELECT", node).otherwise(reason)).alias("value"), error.alias("error"))


def parse_evaluate(response: Column) -> Column:
    """(sufficient, reason, error) of the first ``SUFFICIENT:`` or ``INSUFFICIENT:`` line."""
    line = _first_marked(response, ["SUFFICIENT:", "INSUFFICIENT:"])
    enough = line.startswith("SUFFICIENT:")
    reason = F.when(enough, _after(line, "SUFFICIENT:")).when(~enough, _after(line, "INSUFFICIENT:"))
    return F.struct(enough.alias("sufficient"), reason.alias("reason"), F.when(line.isNull(), "no SUFFICIENT or INSUFFICIENT line").alias("error"))


def parse_evaluate_json(response: Column) -> Column:
    """The same from JSON. Any value but false, null, 0 and an empty one counts as true: the string "false" too."""
    snippet = json_snippet(response)
    payload = F.from_json(snippet, "map<string,string>")
    there = F.array_contains(F.map_keys(payload), "sufficient")
    raw = F.regexp_extract(snippet, r'"sufficient"\s*:\s*("(?:[^"\\]|\\.)*"|\[\s*\]|\{\s*\}|[^,}\s]+)', 1)
    enough = ~raw.isin("false", "null", "0", "0.0", '""', "[]", "{}")
    error = F.when(snippet.isNull(), "no JSON object").when(payload.isNull(), "invalid JSON").when(~there, "no sufficient field")
    good = lambda c: F.when(error.isNull(), c)
    return F.struct(good(enough).alias("sufficient"), good(strip(F.coalesce(payload["reason"], F.lit("")))).alias("reason"), error.alias("error"))


def parse_with_fallback(first: Column, retry: Column, as_json: bool = True) -> Column:
    """(action, value, error, attempt): the first response, else the retry, else a JSON retry read as text."""
    parse = parse_select_json if as_json else parse_select
    tries = [(parse(first), 1), (parse(retry), 2)] + ([(parse_select(retry), 3)] if as_json else [])
    pick = lambda field: F.coalesce(*[F.when(t["error"].isNull(), t[field]) for t, _ in tries])
    attempt = F.coalesce(*[F.when(t["error"].isNull(), F.lit(n)) for t, n in tries])
    return F.struct(pick("action").alias("action"), pick("value").alias("value"), F.when(attempt.isNull(), tries[1][0]["error"]).alias("error"), attempt.alias("attempt"))


def parse_decompose(response: Column) -> Column:
    """Sub-queries of ``SUB:`` lines; none if any line begins with ``SINGLE``."""
    lines = F.transform(lines_of(strip(response)), strip)
    subs = F.filter(F.transform(F.filter(lines, lambda x: F.upper(x).startswith("SUB:")), lambda x: _after(x, "SUB:")), lambda x: x != "")
    return F.when(F.exists(lines, lambda x: F.upper(x).startswith("SINGLE")), F.array().cast("array<string>")).otherwise(subs)


def parse_entities(response: Column) -> Column:
    """(name, category, description) of ``ENTITY: a | b | c`` lines; a text that is ``NONE`` has none."""
    whole = F.regexp_extract_all(response, F.lit(ENTITY_LINE), 0)
    fields = F.transform(whole, lambda m: F.split(F.regexp_replace(m, ENTITY_LINE, "$1\n$2\n$3"), "\n"))  # no field holds a line break
    part = lambda x, k: strip(F.get(x, F.lit(k)))
    rows = F.transform(fields, lambda x: F.struct(part(x, 0).alias("name"), F.lower(part(x, 1)).alias("category"), part(x, 2).alias("description")))
    return F.filter(F.when(F.upper(strip(response)) == "NONE", F.slice(rows, 1, 0)).otherwise(rows), lambda r: r["name"] != "")
