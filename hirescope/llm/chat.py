"""Chat formatting by prefix-target expansion, in SQL functions alone.

Every turn is written as ``### role: text</turn>`` and a line end. Inside roles
and texts the template's control strings are escaped, so that they can be read
back: a backslash becomes ``\\b``, ``###`` becomes ``\\h``, ``</turn>`` becomes
``\\t``, and in roles a colon becomes ``\\c``.

``expanded`` gives a row for every assistant turn (``target``, its place from 0):
all turns before it, then the reply, of which only the text is trainable
(``loss_start`` and ``loss_length``, code points of the escaped text). One more row
a conversation, with a null target and no loss, holds all its turns, so that turns
after the last reply are in the output too.

Nulls: a null text or role is empty; a null conversation id is a conversation of
its own. Turns are put in order of turn, role, text (nulls first); repeated rows
are repeated turns. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
TRAINED = "assistant"
# Escapes in the order they are written; read back in the opposite order.
CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_CODES = (*CODES, (":", "\\c"))


def escaped(text: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _mark(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role, ROLE_CODES), F.lit(AFTER_ROLE))


def expanded(turns: DataFrame) -> DataFrame:
    """conv_id, target, formatted, loss_start (from 0), loss_length."""
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))).alias("_turns"))
    listed = listed.select("conv_id", F.transform("_turns", lambda t: F.struct(
        t["role"].alias("role"), _mark(t["role"]).alias("mark"), escaped(t["text"]).alias("text"))).alias("_turns"))

    def joined(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda t: F.concat(t["mark"], t["text"], F.lit(END))), "")

    nothing = F.lit(None).cast("int")
    whole = F.struct(nothing.alias("target"), joined(F.col("_turns")).alias("formatted"),
                     nothing.alias("loss_start"), nothing.alias("loss_length"))

    def example(i: Column) -> Column:
        reply = F.get("_turns", i)
        before = joined(F.slice("_turns", F.lit(1), i))
        return F.struct(i.alias("target"), F.concat(before, reply["mark"], reply["text"], F.lit(END)).alias("formatted"),
                        (F.length(before) + F.length(reply["mark"])).alias("loss_start"),
                        F.length(reply["text"]).alias("loss_length"))

    places = F.filter(F.sequence(F.lit(0), F.size("_turns") - 1), lambda i: F.get("_turns", i)["role"] == TRAINED)
    rows = F.concat(F.array(whole), F.transform(places, example))
    return listed.select("conv_id", F.inline(rows))


def read_back(examples: DataFrame) -> DataFrame:
    """Each conversation's turns and trainable text, from the output alone:
    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars (code
    points of all the conversation's rows)."""
    ended = F.split("formatted", END)
    parts = F.slice(ended, F.lit(1), F.size(ended) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(F.substr(part, F.lit(len(OPEN) + 1)), AFTER_ROLE, 1)
        text = F.substr(part, F.length(role) + F.lit(len(OPEN) + len(AFTER_ROLE) + 1))
        return F.concat(unescaped(role, ROLE_CODES), F.lit("\n"), unescaped(text), F.lit("\n"))

    turns = F.when(F.col("target").isNull(), F.transform(parts, turn))
    loss = unescaped(F.substr(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_length")))
    rows = examples.select(
        "conv_id", "target", F.size(turns).cast("long").alias("_n"), F.sha2(F.array_join(turns, ""), 256).alias("_turns"),
        F.when(F.col("target").isNotNull(), loss).alias("_loss"), F.length("formatted").cast("long").alias("_chars"))
    replies = F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("target").isNotNull(), F.struct("target", "_loss")))), lambda x: x["_loss"]), "")
    return rows.groupBy("conv_id").agg(
        F.max(F.when(F.col("target").isNull(), F.col("_n"))).alias("n_turns"), F.max("_turns").alias("turns_sha256"),
        replies.alias("_loss"), F.sum("_chars").alias("formatted_chars"),
    ).select("conv_id", "n_turns", "turns_sha256", F.length("_loss").cast("long").alias("loss_chars"),
             F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars")
