"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Method: every assistant turn of a conversation becomes an example of its own: all turns before it are context, and only
that reply is trainable. Turns after the last reply are kept as an example without a target.

Template: a turn is `<s>`, then `[INST] ` (for all roles but the trained one), the role, a new line, the text, `[/INST]`
likewise, then `</s>`. Texts and roles are escaped: `\\` becomes `\\\\`, and each control string gets a `\\` after its first
character, so none is left inside; a new line in a role gets one before it. Unescaping drops each `\\` before a character.

Edge cases: null texts and roles are empty strings. Turns of equal number are ordered by role and text; a null turn
comes first. A null conv_id is a conversation of its own. A conversation without replies is one example without a
target. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template (fixed values).
BEGIN, END, OPEN, CLOSE = "<s>", "</s>", "[INST] ", " [/INST]"
CONTROL = r"(?:(<)(/?s>)|(\[)(/?INST\]))"
TURN = r"(?s)<s>(?:\[INST\] )?((?:[^\\\n]++|\\.)*+)\n(.*?)(?: \[/INST\])?</s>"


def escape(text: Column) -> Column:
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turn(role: Column, text: Column, trained: str) -> Column:
    name = F.regexp_replace(escape(role), "\n", "\\\\\n")
    given = F.concat(F.lit(BEGIN + OPEN), name, F.lit("\n"), escape(text), F.lit(CLOSE + END))
    return F.when(role == trained, F.concat(F.lit(BEGIN), name, F.lit("\n"), escape(text), F.lit(END))).otherwise(given)


def expand(conversations: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per example: conv_id, example (1..), turns, text, loss_start and loss_length.

    text is the formatted example; loss_start (from 1) and loss_length mark the escaped reply in it, in code points;
    loss_length is null where there is no target.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    done = whole.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"]).alias("roles"),
        F.transform("turns", lambda t: format_turn(t["role"], t["text"], trained)).alias("parts"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
    )
    last = F.size("roles")
    at = F.filter(F.sequence(F.lit(1), last), lambda k: (F.element_at("roles", k) == trained) | (k == last))
    each = done.select("conv_id", "roles", "parts", "sizes", F.posexplode(at).alias("example", "turns"))
    text = F.array_join(F.slice("parts", 1, F.col("turns")), "")
    target = F.element_at("roles", F.col("turns")) == trained
    size = F.element_at("sizes", F.col("turns"))
    each = each.select("conv_id", (F.col("example") + 1).alias("example"), "turns", text.alias("text"), target.alias("target"), size.alias("size"))
    start = F.length("text") - len(END) - F.col("size") + 1
    return each.select(
        "conv_id",
        "example",
        "turns",
        "text",
        F.when(F.col("target"), start).alias("loss_start"),
        F.when(F.col("target"), F.col("size")).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the examples alone: the turns of the longest one, and all text under the loss masks."""
    turns = F.transform(F.expr(f"regexp_extract_all(text, r'{TURN}', 0)"), lambda m: F.struct(
        unescape(F.regexp_extract(m, TURN, 1)).alias("role"), unescape(F.regexp_extract(m, TURN, 2)).alias("text")))
    reply = unescape(F.substring(F.col("text"), F.col("loss_start"), F.col("loss_length")))
    found = examples.select(
        "conv_id",
        "example",
        F.col("text"),
        F.when(F.col("loss_length").isNotNull(), reply).alias("reply"),
    )
    whole = found.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("text"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "reply"))), lambda x: F.coalesce(x["reply"], F.lit(""))), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    return whole.select("conv_id", turns.alias("turns"), "loss", "formatted_chars")
