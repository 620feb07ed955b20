"""Chat formatting with Spark expressions only: sorted turns, merged runs of a role, one template."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, BREAK, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"

# Every control string opens with "<|". Inside a text one backslash more goes between "<" and "|",
# so "<|" never stands there, and one backslash less restores it.
_OPEN, _ESCAPED_OPEN = r"<(\\*)\|", r"<\\(\\*)\|"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _OPEN, r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED_OPEN, "<$1|")


def _escape_role(role: Column) -> Column:
    """A role is one line of the output: backslash and line feed are written as two characters."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    plain = F.replace(unescape(role), F.lit("\\\\"), F.lit("\\\x00"))
    return F.replace(F.replace(plain, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\"))


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``(conv_id, formatted, segments, n_messages)``.

    Turns are ordered by number, then role and text (nulls first); repeated rows all stay. Adjacent
    turns of one role become one message, with a separator between their texts. ``formatted`` is
    the training text; ``segments`` cuts it into ``(text, loss)`` pieces, whose ``loss`` flag is the
    mask: true for the texts of ``loss_role`` only, never for markers. Null texts and roles count
    as empty; rows without a conversation id form a conversation with a null id. An empty table
    gives no rows; other columns are ignored.
    """
    rows = turns.select(
        F.col(conv_col).alias(conv_col),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    sorted_turns = rows.groupBy(conv_col).agg(F.array_sort(F.collect_list("t")).alias("turns"))
    turns_, n = F.col("turns"), F.size("turns")
    begins = F.filter(
        F.sequence(F.lit(1), n),
        lambda i: (i == 1) | (F.element_at("turns", i)["role"] != F.element_at("turns", F.greatest(i - 1, F.lit(1)))["role"]),
    )
    runs = sorted_turns.select(conv_col, "turns", begins.alias("begins"))
    messages = runs.select(
        conv_col,
        F.transform(
            "begins",
            lambda b, k: F.struct(
                F.element_at("turns", b)["role"].alias("role"),
                F.transform(
                    F.slice(turns_, b, F.coalesce(F.try_element_at("begins", k + 2), n + 1) - b), lambda t: t["text"]
                ).alias("texts"),
            ),
        ).alias("messages"),
    )
    pieces = messages.select(
        conv_col,
        F.flatten(F.transform("messages", lambda m: _segments(m, loss_role))).alias("segments"),
        F.size("messages").alias("n_messages"),
    )
    return pieces.select(
        conv_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "n_messages"
    )


def _segments(message: Column, loss_role: str) -> Column:
    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    head = piece(F.concat(F.lit(START), _escape_role(message["role"]), F.lit("\n")), F.lit(False))
    texts = F.flatten(
        F.transform(
            message["texts"],
            lambda t, i: F.when(i == 0, F.array(piece(escape(t), message["role"] == loss_role))).otherwise(
                F.array(piece(F.lit(BREAK), F.lit(False)), piece(escape(t), message["role"] == loss_role))
            ),
        )
    )
    return F.concat(F.array(head), texts, F.array(piece(F.lit(END), F.lit(False))))


def parse_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: ``array<struct<role, text>>``, unescaped and unmerged."""
    # Split at the literal markers; the part after the last END is empty.
    parts = F.split(formatted, r"<\|im_end\|>\n")
    messages = F.slice(parts, 1, F.size(parts) - 1)
    return F.flatten(F.transform(messages, _turns))


def _turns(message: Column) -> Column:
    cut = F.locate("\n", message)
    role = _unescape_role(F.substring(message, F.lit(len(START) + 1), cut - 1 - len(START)))
    texts = F.split(F.substring(message, cut + 1, F.length(message)), r"<\|im_sep\|>")
    return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))


def loss_text(segments: Column) -> Column:
    """All text under the mask, unescaped, with nothing between the pieces."""
    masked = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(masked, lambda s: unescape(s["text"])), "")
