"""Scalar functions on note texts, all as Column expressions that stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the corpus rules.
CHARS_PER_TOKEN = 3
MICRO_BELOW, ATOMIC_BELOW = 500, 3000
CONTENT_CAP = 20_000
SUMMARY_CHARS = 160
TOKEN_SEPARATORS = r"""(?U)[\s,.;:!?\-()\[\]{}"'`/\\]+"""
LINK = r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]"
LINK_WITH_ANCHOR = r"\[\[([^\]|#]+)(?:#([^\]|]+))?(?:\|[^\]]*)?\]\]"
BREAKS = r"\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}"
LINE_BREAKS = rf"\r\n|[{BREAKS}]"

FIRST_LINE = rf"(?U)(?:\A|[{BREAKS}])[\s&&[^{BREAKS}]]*([^\s#{BREAKS}][^{BREAKS}]*)"


def strip(c: Column) -> Column:
    """Without white space at either end; `trim` alone takes off blanks only."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def has_text(c: Column) -> Column:
    """Whether there is anything but white space; looks no further than that."""
    return F.rlike(c, F.lit(r"(?U)\S"))


def estimate_tokens(text: Column, empty: int = 1) -> Column:
    """A third of the characters, at least 1; for an empty text ``empty``."""
    guess = F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")
    return F.when(F.length(text) == 0, F.lit(empty).cast("long")).otherwise(guess)


def classify_tier(tokens: Column) -> Column:
    return F.when(tokens < MICRO_BELOW, "micro").when(tokens < ATOMIC_BELOW, "atomic").otherwise("long")


def extract_links(body: Column) -> Column:
    """Targets of ``[[target#anchor|alias]]``, in order, repeats included."""
    return F.transform(F.regexp_extract_all(body, F.lit(LINK), 1), strip)


def extract_links_anchored(body: Column) -> Column:
    """(target, anchor) of all links in order; links with a blank target drop, a blank anchor is null."""
    whole = F.regexp_extract_all(body, F.lit(LINK_WITH_ANCHOR), 0)
    one = lambda m, k: strip(F.regexp_extract(m, LINK_WITH_ANCHOR, k))
    pairs = F.transform(whole, lambda m: F.struct(one(m, 1).alias("target"), F.nullif(one(m, 2), F.lit("")).alias("anchor")))
    return F.filter(pairs, lambda p: p["target"] != "")


def normalize_title(title: Column) -> Column:
    return F.lower(F.regexp_replace(strip(title), r"(?U)\s+", " "))


def titles_match(a: Column, b: Column) -> Column:
    return normalize_title(a) == normalize_title(b)


def tokenize(text: Column, min_len: int = 2) -> Column:
    return F.filter(F.split(F.lower(text), TOKEN_SEPARATORS), lambda t: F.length(t) >= min_len)


def token_counts(text: Column) -> Column:
    """How many tokens a text has, and each different one with its count, all within the row: (len, counts of (token, tf))."""
    once = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))

    def runs(tokens: Column) -> Column:
        places = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)))
        first = F.filter(places, lambda i: (i < F.size(tokens)) & ~F.get(tokens, i).eqNullSafe(F.get(tokens, i - 1)))
        counts = once(first, lambda at: F.transform(at, lambda i, k: F.struct(F.get(tokens, i).alias("token"), (F.coalesce(F.get(at, k + 1), F.size(tokens)) - i).cast("long").alias("tf"))))
        return F.struct(F.size(tokens).alias("len"), counts.alias("counts"))

    return F.when(text.isNotNull(), once(F.sort_array(tokenize(text)), runs))


def lines_of(text: Column) -> Column:
    return F.split(text, LINE_BREAKS)


def section_slice(body: Column, start: Column, end: Column) -> Column:
    """Lines [start, end), counted from 1; without a range the whole note."""
    lines = F.split(body, "\n")
    inside = F.greatest(F.lit(1), start)
    part = F.array_join(F.slice(lines, inside, F.greatest(F.lit(0), F.least(end, F.size(lines) + 1) - inside)), "\n")
    return F.when(start.isNull() | end.isNull(), body).otherwise(part)


def truncate_content(text: Column, cap: int = CONTENT_CAP, marker: str = "\n\n[... truncated ...]") -> Column:
    return F.when(F.length(text) > cap, F.concat(F.substring(text, 1, cap), F.lit(marker))).otherwise(text)


def fallback_summary(text: Column, most: int = SUMMARY_CHARS) -> Column:
    """The first line that is neither blank nor a heading, cut to ``most`` characters. The search ends at this line."""

    def cut(line: Column) -> Column:
        return F.when(F.length(line) > most, F.concat(F.regexp_replace(F.substring(line, 1, most), r"(?U)\s+$", ""), F.lit("…"))).otherwise(line)

    return F.get(F.transform(F.array(strip(F.regexp_extract(text, FIRST_LINE, 1))), cut), F.lit(0))


def clean_summary(answer: Column) -> Column:
    """A model's line without blanks and quotes around it."""
    return strip(F.regexp_replace(strip(answer), r"""^["']+|["']+$""", ""))


def file_slug(name: Column) -> Column:
    kept = F.regexp_replace(name, r"(?U)[^\w\s-]", "")
    return F.concat(F.regexp_replace(strip(kept), r"(?U)\s+", "-"), F.lit(".md"))


def entity_key(name: Column) -> Column:
    return F.lower(strip(name))


def note_of_section(node_id: Column, kind: Column) -> Column:
    """The note that a section belongs to: its id up to the last ``#``."""
    return F.when(kind == "section", F.regexp_replace(node_id, "#[^#]*$", "")).otherwise(node_id)


def parent_folder(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def candidate_line(kind: Column, tokens: Column, tags: Column, date: Column, linked_from: Column, title: Column, summary: Column, node_id: Column) -> Column:
    """How a candidate is shown to a model: kind, size, tags, date, cross-reference, title, summary; its id on a second line."""
    given = lambda c: c.isNotNull() & (c != "")
    return F.concat(
        F.concat(F.lit("["), kind, F.lit("]")),
        F.when(tokens.isNotNull(), F.concat(F.lit(" ~"), tokens.cast("string"), F.lit(" tokens"))).otherwise(""),
        F.when(F.size(tags) > 0, F.concat(F.lit(" #"), F.array_join(tags, ", #"))).otherwise(""),
        F.when(given(date), F.concat(F.lit(" ("), date, F.lit(")"))).otherwise(""),
        F.when(given(linked_from), F.concat(F.lit(" [xref: "), linked_from, F.lit("]"))).otherwise(""),
        F.lit(" "), title, F.when(given(summary), F.concat(F.lit(" — "), summary)).otherwise(""), F.lit("\n   node_id: "), node_id,
    )


BREAKDOWN = "map<string, struct<calls: bigint, prompt: bigint, completion: bigint, elapsed: double>>"


def breakdown_from_json(text: Column) -> Column:
    """A phase breakdown; what is not one is empty."""
    return F.coalesce(F.from_json(text, BREAKDOWN), F.from_json(F.lit("{}"), BREAKDOWN))


def split_budget(ratios: Column, total: Column) -> Column:
    """Caps (explore, evaluate, answer) of ``a:b:c`` shares of a total, each at least 1, and what is wrong with the shares if something is."""
    parts = F.split(ratios, ":")
    n = F.transform(parts, lambda p: F.try_to_number(strip(p), F.lit("S999999999999")))
    total_ratio = F.aggregate(n, F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + F.coalesce(x, F.lit(0))).cast("decimal(38,0)"))
    error = (
        F.when(F.size(parts) != 3, "expected three shares")
        .when(F.exists(n, lambda x: x.isNull()), "shares must be whole numbers")
        .when(F.exists(n, lambda x: x < 0), "shares must not be negative")
        .when(total_ratio == 0, "shares must not all be zero")
        .when(total.isNull() | (total <= 0), "a total is needed")
    )
    cap = lambda i: F.when(error.isNull(), F.greatest(F.lit(1), F.floor(total * F.get(n, F.lit(i)) / total_ratio)).cast("long"))
    return F.struct(cap(0).alias("explore"), cap(1).alias("evaluate"), cap(2).alias("answer"), error.alias("error"))
