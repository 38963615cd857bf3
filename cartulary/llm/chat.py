"""Chat formatting with Spark expressions only: one marked text per conversation, and back.

A block holds adjacent turns of one role::

    <|im_start|>role
    first text<|im_sep|>second text<|im_end|>

Role and texts are escaped, so that no control string of this or another common template can come
from them: a backslash goes behind the first character of each control string, and of anything
that would read like an escaped one, so one backslash less always gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

# Control strings without their first character, as a pattern.
_CONTROL = (
    r"/?s>|\|[A-Za-z0-9_]{1,64}\|>|<SYS>>|</SYS>>|/?INST\]|(?:start|end)_of_turn>|(?:bos|eos|pad|unk)>"
)
_ESCAPE = rf"([<\[])(?=\\*(?:{_CONTROL}))"
_UNESCAPE = rf"([<\[])\\(?=\\*(?:{_CONTROL}))"


def escape(text: Column) -> Column:
    """The text with no control string in it."""
    return F.regexp_replace(text, _ESCAPE, "$1\\\\")


def unescape(text: Column) -> Column:
    """The text that ``escape`` was given."""
    return F.regexp_replace(text, _UNESCAPE, "$1")


def _role_line(role: Column) -> Column:
    """A role without line breaks of its own; ``%`` marks what was replaced."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(line: Column) -> Column:
    return F.replace(F.replace(unescape(line), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def format_chats(
    turns: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """A row per conversation: the id, ``formatted`` and ``loss_spans``.

    Turns are sorted by number, then role, then text, nulls first, so repeated turns have one
    order and all of them stay. Adjacent turns of one role share a block. ``loss_spans`` lists
    ``start`` and ``length``, in code points of ``formatted``, of the text of each ``loss_role``
    turn, without marks. A null text or role is empty; a null id is a conversation like any
    other; other columns are left out. An empty table gives an empty table. A conversation has to
    fit in a row, as its text does.
    """
    sort_key = F.struct(
        F.col(turn_column).alias("turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("role"),
        F.coalesce(F.col(text_column), F.lit("")).alias("text"),
    )
    sorted_turns = turns.groupBy(F.col(id_column)).agg(
        F.array_sort(F.collect_list(sort_key)).alias("turns")
    )
    # A turn's marks stand in front of its text; what closes a block belongs to the next turn.
    n = F.size("turns")
    previous = F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t.role))
    pieces = F.transform(
        F.arrays_zip(F.col("turns").alias("turn"), F.slice(previous, 1, n).alias("before")),
        lambda p: F.struct(
            F.when(p["before"].isNull(), F.concat(F.lit(START), _role_line(p["turn"]["role"]), F.lit("\n")))
            .when(p["before"] == p["turn"]["role"], F.lit(SEPARATOR))
            .otherwise(
                F.concat(F.lit(f"{END}\n{START}"), _role_line(p["turn"]["role"]), F.lit("\n"))
            )
            .alias("mark"),
            escape(p["turn"]["text"]).alias("body"),
            (p["turn"]["role"] == loss_role).alias("loss"),
        ),
    )
    built = sorted_turns.select(F.col(id_column), pieces.alias("pieces"))
    empty = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<struct<start:int,length:int>>").alias("spans"),
    )

    def step(state: Column, p: Column) -> Column:
        start = state["at"] + F.char_length(p["mark"])
        length = F.char_length(p["body"])
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length).alias("at"),
            F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return built.select(
        F.col(id_column),
        F.concat(
            F.array_join(F.transform("pieces", lambda p: F.concat(p["mark"], p["body"])), ""),
            F.lit(f"{END}\n"),
        ).alias("formatted"),
        F.aggregate("pieces", empty, step)["spans"].alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text: an array of ``role`` and ``text``, unescaped."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda b: b != "")

    def turns(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substr(
            block,
            F.char_length(role) + 2,
            F.char_length(block) - F.char_length(role) - 1 - len(END) - 1,
        )
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1),
            lambda t: F.struct(_role_back(role).alias("role"), unescape(t).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped."""
    return F.transform(
        spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))
    )
