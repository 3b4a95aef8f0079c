"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; runs of one role become one block; blocks are
concatenated to one text with a loss mask over the assistant's words.

Template of a block::

    ### <role>: <text><cut><text></turn>\n

``#`` and ``<`` begin every control string, so inside texts they are written ``\\h`` and ``\\l``, and the
escape itself ``\\b``. No control string can then occur in a text, and `read_chats` gives every text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

OPEN, ROLE_END, CUT, CLOSE = "### ", ": ", "<cut>", "</turn>\n"


def _swap(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


TEXT_ESCAPES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l")]
ROLE_ESCAPES = [*TEXT_ESCAPES, (":", "\\c")]


def escape(text: Column) -> Column:
    return _swap(text, TEXT_ESCAPES)


def unescape(text: Column) -> Column:
    return _swap(text, [(b, a) for a, b in reversed(TEXT_ESCAPES)])


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv_id``, ``formatted``, ``loss_mask``.

    Turns sort by turn number, then role, then text, nulls first. A null text or role counts as empty, a null
    conversation id is a conversation of its own, repeated rows are repeated turns, and columns other than
    the four named are ignored. No rows in, no rows out. A conversation is one row of the result, so it is
    as long as a row may be (2 GB); every step is linear in its length.

    ``loss_mask`` is a run-length mask over the code points of ``formatted``: each run skips ``skip`` points
    of markup and then covers ``take`` points of one escaped text, which counts for the loss if ``loss``.
    """
    blank = F.lit("")
    of = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text")).alias("t"),
    )
    told = of.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        """A turn with what stands before it: a cut after a turn of the same role, else the end of the block before and a head."""
        same = F.coalesce(F.get("turns", i - 1)["role"] == t["role"], F.lit(False))
        head = F.concat(F.when(i > 0, CLOSE).otherwise(""), F.lit(OPEN), _swap(t["role"], ROLE_ESCAPES), F.lit(ROLE_END))
        return F.struct(F.when(same, CUT).otherwise(head).alias("before"), escape(t["text"]).alias("text"), (t["role"] == learn).alias("loss"))

    told = told.select("conv_id", F.transform("turns", piece).alias("pieces"))
    whole = F.concat(F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"])), ""), F.lit(CLOSE))
    mask = F.transform("pieces", lambda p: F.struct(F.length(p["before"]).alias("skip"), F.length(p["text"]).alias("take"), p["loss"].alias("loss")))
    return told.select("conv_id", whole.alias("formatted"), mask.alias("loss_mask"))


def read_chats(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), merged blocks taken apart again."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def parts(b: Column) -> Column:
        def texts(two: Column) -> Column:
            role = _swap(F.substring(F.get(two, F.lit(0)), len(OPEN) + 1, 1 << 30), [(y, x) for x, y in reversed(ROLE_ESCAPES)])
            return let(role, lambda r: F.transform(F.split(F.get(two, F.lit(1)), CUT), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))))

        return let(F.split(b, ROLE_END, 2), texts)

    return F.flatten(F.transform(blocks, parts))


def under_mask(formatted: Column, mask: Column) -> Column:
    """What the runs of a mask that count for the loss cover, cut out of the formatted text and unescaped: an array of texts.

    Control strings part the text into as many pieces as there are runs, and a run covers the end of its piece: the text is
    cut once, and each piece on its own. A run whose skipped points are not the head of its piece and one control string is an error.
    """
    pieces = F.split(formatted, f"{CUT}|{CLOSE}")
    runs = F.arrays_zip(mask.alias("run"), F.slice(pieces, 1, F.size(mask)).alias("piece"))
    head = lambda x: x["run"]["skip"] - F.length(x["piece"]) + x["run"]["take"]
    fits = lambda x: (x["run"]["take"] == 0) | head(x).isin(0, len(CUT), len(CLOSE))
    cut = lambda x: F.when(fits(x), F.right(x["piece"], x["run"]["take"])).otherwise(F.raise_error(F.lit("the mask does not fit the text")).cast("string"))
    return F.transform(F.filter(runs, lambda x: x["run"]["loss"]), lambda x: unescape(cut(x)))


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests of what `read_chats` and the loss mask give back from `format_chats` output; the mask alone says what counts for the loss."""
    back = formatted.select("conv_id", "formatted", under_mask(F.col("formatted"), F.col("loss_mask")).alias("parts"), read_chats(F.col("formatted")).alias("back"))
    told = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = back.select("conv_id", F.size("back").cast("long").alias("n_turns"), told.alias("told"), F.array_join("parts", "").alias("under"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"), "formatted_chars",
    )
