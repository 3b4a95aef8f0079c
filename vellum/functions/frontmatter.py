"""Frontmatter of notes as a fold over the lines of its block, inside one expression: no shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

EMPTY = "map<string,string>"


def _unquote(c: Column) -> Column:
    return F.regexp_replace(c, r"""^["']+|["']+$""", "")


def parse_list_value(raw: Column) -> Column:
    """``[a, "b"]`` as an array without quotes; a scalar as an array of one; empty as an empty one. Commas split always."""
    inner = strip(F.coalesce(raw, F.lit("")))
    listed = inner.startswith("[") & inner.endswith("]")
    items = F.when(listed, F.split(F.regexp_replace(inner, r"^\[|\]$", ""), ",")).otherwise(F.array(inner))
    return F.filter(F.transform(items, lambda x: _unquote(strip(x))), lambda x: x != "")


def frontmatter_block(body: Column) -> Column:
    """The lines between a ``---`` at the very beginning and the next ``---`` line; null if there is no such block."""
    found = F.regexp_extract(body, r"(?s)\A---[ \t]*\n(.*?)(?:(?<=\n)|\A)---[ \t]*(?:\n|\z)", 1)
    there = F.regexp_like(body, F.lit(r"(?s)\A---[ \t]*\n(?:.*?\n)?---[ \t]*(?:\n|\z)"))
    return F.when(there, F.split(found, "\n"))


def frontmatter_raw(body: Column) -> Column:
    """The block as a map: keys in lower case, a later key wins, dash lists become ``[a, b]``."""
    state = "struct<key: string, items: array<string>, out: map<string,string>>"
    zero = F.struct(F.lit(None).cast("string").alias("key"), F.array().cast("array<string>").alias("items"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("out")).cast(state)

    def put(out: Column, key: Column, value: Column) -> Column:
        return F.map_concat(F.map_filter(out, lambda k, _: k != key), F.create_map(key, value))

    def flush(a: Column) -> Column:
        full = a["key"].isNotNull() & (F.size(a["items"]) > 0)
        return F.when(full, put(a["out"], F.coalesce(a["key"], F.lit("")), F.concat(F.lit("["), F.array_join(a["items"], ", "), F.lit("]")))).otherwise(a["out"])

    none = F.array().cast("array<string>")

    def step(a: Column, line: Column) -> Column:
        s = strip(line)
        item = s.startswith("- ") & a["key"].isNotNull()
        key = F.lower(strip(F.substring_index(s, ":", 1)))
        value = strip(F.regexp_replace(s, r"^[^:]*:", ""))
        more = F.struct(a["key"].alias("key"), F.concat(a["items"], F.array(_unquote(strip(F.substring(s, 3, 1 << 30))))).alias("items"), a["out"].alias("out"))
        pair = F.struct(key.alias("key"), none.alias("items"), F.when(value != "", put(flush(a), key, value)).otherwise(flush(a)).alias("out"))
        other = F.struct(F.lit(None).cast("string").alias("key"), none.alias("items"), flush(a).alias("out"))
        return F.when(s == "", a).when(item, more.cast(state)).when(F.contains(s, F.lit(":")), pair.cast(state)).otherwise(other.cast(state))

    return F.aggregate(F.coalesce(frontmatter_block(body), none), zero, step, flush)


def frontmatter_fields(raw: Column) -> Column:
    """tags (or else tag), date and aliases of a raw map."""
    tags = parse_list_value(raw["tags"])
    return F.struct(
        F.when(F.size(tags) > 0, tags).otherwise(parse_list_value(raw["tag"])).alias("tags"), raw["date"].alias("date"), parse_list_value(raw["aliases"]).alias("aliases"), raw.alias("raw"),
    )


def note_fields(body: Column) -> Column:
    """`frontmatter_fields` of a note's body, with the fold over its lines computed once."""
    return F.get(F.transform(F.array(frontmatter_raw(body)), frontmatter_fields), F.lit(0))
