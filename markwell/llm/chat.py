"""Chat formatting with a grammar round trip, in DataFrame functions only.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn. The parser is deterministic: a conversation is cut at every
``<|im_start|>``; a part is a role up to the first line break, then a text, then ``<|im_end|>\\n``, and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    """Reversible: every ``<``, backslashes, ``|`` gets one more backslash, so no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """As ``escape``, and the role stays on one line."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    pairs = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(pairs, lambda part: F.replace(part, F.lit("\\n"), F.lit("\n"))), "\\")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(rendered: Column) -> Column:
    """Turns ``(role, text, body_chars, skip_chars)`` of a rendered conversation; null for a part that breaks the grammar."""
    parts = F.split(rendered, r"<\|im_start\|>", -1)

    def turn(part: Column) -> Column:
        line = F.instr(part, "\n")
        body = F.substr(part, line + 1, F.greatest(F.length(part) - line - len(END) - 1, F.lit(0)))
        good = (line > 0) & F.endswith(part, F.lit(END + "\n")) & (F.length(part) - line > len(END)) & (F.instr(body, END) == 0)
        return F.when(
            good,
            F.struct(
                unescape_role(F.substr(part, F.lit(1), line - 1)).alias("role"),
                unescape(body).alias("text"),
                F.length(body).cast("long").alias("body_chars"),
                (F.lit(len(START)) + line).cast("long").alias("skip_chars"),
            ),
        )

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def returns_same(role: Column, text: Column, rendered: Column) -> Column:
    turns = parse(rendered)
    only = F.get(turns, F.lit(0))
    same = F.startswith(rendered, F.lit(START)) & (F.size(turns) == 1) & (only["role"] == role) & (only["text"] == text)
    return F.coalesce(same, F.lit(False))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: ``formatted`` text, the ``turns`` read back from it, and what the loss mask covers.

    A turn is rendered as it is; if the parser doesn't give back the same role and text, its text is escaped; if that isn't
    enough, its role too. Whole conversations are parsed once more: ``round_trip`` says whether they equal the source.
    ``loss_runs`` is the mask, a pair per turn: characters to skip, then characters under the mask; the closing string follows.

    Rows go by ``turn``, null first; equal turns by role, then text; repeated rows are turns of their own. Null role or text:
    empty. Null conversation ids form one conversation. An empty table gives no rows; further columns are not read. A
    conversation is one row of the result, so its own turns meet in one task; each turn is settled before that.
    """
    plain = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    forms = [
        render_turn(F.col("role"), F.col("text")),
        render_turn(F.col("role"), escape(F.col("text"))),
        render_turn(escape_role(F.col("role")), escape(F.col("text"))),
    ]
    settled = F.when(returns_same(F.col("role"), F.col("text"), forms[0]), forms[0])
    settled = settled.when(returns_same(F.col("role"), F.col("text"), forms[1]), forms[1]).otherwise(forms[2])
    gathered = (
        plain.withColumn("rendered", settled)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("source"))
        .withColumn("formatted", F.array_join(F.transform("source", lambda x: x["rendered"]), ""))
        .withColumn("turns", parse(F.col("formatted")))
    )
    wanted = F.transform("source", lambda x: F.struct(x["role"], x["text"]))
    found = F.transform("turns", lambda x: F.struct(x["role"], x["text"]))
    trained = F.filter("turns", lambda x: x["role"] == TRAINED)
    runs = F.transform(
        "turns",
        lambda x: F.when(
            x["role"] == TRAINED, F.struct(x["skip_chars"].alias("skip"), x["body_chars"].alias("take"))
        ).otherwise(F.struct((x["skip_chars"] + x["body_chars"]).alias("skip"), F.lit(0).cast("long").alias("take"))),
    )
    return gathered.select(
        "conv_id",
        "formatted",
        F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
        F.array_join(F.transform(trained, lambda x: x["text"]), "").alias("loss_text"),
        runs.alias("loss_runs"),
        F.coalesce(wanted == found, F.lit(False)).alias("round_trip"),
    )
